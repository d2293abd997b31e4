"""Written tables between steps, in the folder that driver and executors share, and joins on keys that may be hot."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Salts of a key that many rows may share.
SALTS = 16


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local folder only where that is unset and Spark runs locally."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = getattr(shared_folder, "own", None) or "file://" + tempfile.mkdtemp(prefix="tessera-")
        shared_folder.own = found
    return found.rstrip("/")


class Written:
    """Tables of one run, as Parquet in a folder of their own: columns can be pruned, and a lost executor costs a read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.paths = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{len(self.paths):03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = out, path
        return out

    def all(self, tables: list[DataFrame]) -> DataFrame:
        """The rows of several tables of one schema, in one scan."""
        return self.spark.read.schema(tables[0].schema).parquet(*(self.paths[id(t)][1] for t in tables))

    def drop(self, *tables: DataFrame) -> None:
        """Removes tables that nothing reads any more."""
        for table in tables:
            if id(table) in self.paths:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths[id(table)][1])
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffled(table: DataFrame) -> DataFrame:
    """The table for a join that may not broadcast it.

    Spark goes by the bytes of a table's files, and URLs in Parquet are some hundred times smaller than in a task's memory;
    a copy for each salt isn't counted at all. So tables that grow with the documents would be whole in each task.
    """
    return table.hint("merge")


def meet(rows: DataFrame, facts: DataFrame, keys: list[str], by: list[str | Column], salts: int = SALTS) -> DataFrame:
    """rows with the columns of facts, which has one small row for a key; rows without one get nulls, and so does a null key.

    Any number of rows may share a key: they are dealt over `salts` copies of the fact by a hash of the columns `by`.
    """
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    copies = facts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(shuffled(copies), [*keys, "__salt"], "left").drop("__salt")
