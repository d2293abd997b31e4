"""What the operators of this subpackage share: written tables, salted ranks and a few columns."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ship(module: str) -> None:
    """Sends the functions of a module along with the tasks that call them, so workers need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local one where that is unset and Spark is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = getattr(shared_dir, "own", None) or "file://" + tempfile.mkdtemp(prefix="tessera-")
        shared_dir.own = found
    return found.rstrip("/")


def worker_cache() -> dict:
    """A dictionary that lasts as long as a Python worker; tasks that it serves one after another share it."""
    return vars(sys.modules.setdefault("_tessera_worker", types.ModuleType("_tessera_worker")))


class Scratch:
    """Written tables of one run of an operator, in a folder of their own under shared_dir.

    put() cuts the lineage: a lost executor costs a read of the table, not the work before it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def put(self, df: DataFrame, name: str = "table") -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tessera_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for x in tables:
            remove(self.spark, x._tessera_path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def sampled_texts(docs: DataFrame, limit: int, seed: str) -> DataFrame:
    """(text): at most `limit` different texts of docs (text), those of the smallest hashes; null and empty ones aside.

    Copies count once, so a text of any number of copies brings one row.
    """
    own = docs.filter("length(text) > 0").select("text", F.xxhash64("text", F.lit(seed)).alias("__mark"))
    marks = own.select("__mark").distinct().orderBy("__mark").limit(limit)
    return own.join(F.broadcast(marks), "__mark").groupBy("__mark").agg(F.min("text").alias("text")).select("text")


def cumulated(df: DataFrame, group: list[str], order: list[str], weight: str | None, before: str, salts: int = 64) -> DataFrame:
    """Adds, as a long, the sum of `weight` (rows, where it is None) over what goes before a row in its group.

    Rows go by (salt, order), the salt being a hash of `order` with a seed of its own, as groups may come from a hash of
    `order` too; `order` must tell rows apart for the same sums on every run. No task gets a whole group: a salt's first
    sum comes from the sums of (group, salt), at most groups x salts.
    """
    n = F.lit(1) if weight is None else F.col(weight)
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(F.lit("salt"), *order), F.lit(salts)).cast("int"))
    sums = salted.groupBy(*group, "__salt").agg(F.sum(n).alias("__n"))
    earlier = Window.partitionBy(*group).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    first = sums.select(*group, "__salt", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__first"))
    within = Window.partitionBy(*group, "__salt").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = salted.withColumn("__own", F.coalesce(F.sum(n).over(within), F.lit(0)))
    return summed.join(first, [*group, "__salt"]).withColumn(before, (F.col("__first") + F.col("__own")).cast("long")).drop("__salt", "__first", "__own")


def salts_for(rows: int) -> int:
    """So many salts that a group of all rows falls into parts of a million at most, and 64 at least."""
    return max(64, rows // 1_000_000)


ship(__name__)
