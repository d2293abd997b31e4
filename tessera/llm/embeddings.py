"""Near-duplicate embeddings: sign hashing in several tables, exact cosines, connected components.

Equal vectors are one class from the start. The signs of random hyperplanes put classes in buckets, a table at a time;
verified links give components; and as links never leave a component, the links of a vector are counted by comparing
the component's classes in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from tessera.llm.common import Scratch, ship, table
from tessera.llm.links import linked_components, shared_buckets

ship(__name__)

#: At a cosine of 0.93 a sign agrees with probability 0.880, so that a pair meets in one of 112 tables of 18 signs with
#: probability 0.99999; unrelated vectors meet in a table once in 262,144.
TABLES, SIGNS, SEED = 112, 18, 20_240_501
#: Classes of a label that SIGNS and TABLES are for. At GROWTH times as many a label takes one sign more, which parts as
#: many vectors at a cosine of 0.2, and so many tables more that a pair at `least` still meets with the same probability.
PLAIN, GROWTH = 1500, 1.75
#: Classes of a component that a task compares with as many others at once.
BLOCK = 512
#: Cosines from products of matrices this near to the threshold are reckoned anew, pair by pair.
NEAR = 1e-9


def planes(dims: int, tables: int, signs: int) -> np.ndarray:
    return np.random.default_rng([SEED, dims]).standard_normal((dims, tables * signs))


def tables_for(signs: int, least: float, tables: int = TABLES, plain: int = SIGNS) -> int:
    """So many tables of `signs` signs that a pair at `least` meets as surely as in `tables` tables of `plain` signs."""
    agree = 1 - np.arccos(least) / np.pi
    return int(np.ceil(tables * np.log1p(-(agree**plain)) / np.log1p(-(agree**signs))))


def classes(vectors: DataFrame) -> DataFrame:
    """(key, first, label, vector, copies): a row for each usable vector and label; first is the smallest id of its copies.

    key is a number of the class that lasts once the result is written.
    """
    v = F.col("vector")
    usable = v.isNotNull() & F.col("label").isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    found = vectors.filter(usable).groupBy("label", "vector").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
    return found.select(F.monotonically_increasing_id().alias("key"), "first", "label", "vector", "copies")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(column), -1)
    m = m / np.abs(m).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _by_length(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) for each length of vector in a batch."""
    sizes = np.array(batch.column(column).value_lengths())
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        yield rows, _matrix(batch.column(column).take(pa.array(rows)))


def pairwise(left: np.ndarray, right: np.ndarray, least: float) -> np.ndarray:
    """Whether the cosine of unit vectors, row by row, is at least `least`: every link is decided by this sum."""
    return (left * right).sum(axis=1) >= least


def linked(left: np.ndarray, right: np.ndarray, least: float) -> np.ndarray:
    """The matrix of links, as pairwise() decides them."""
    cosine = left @ right.T
    out = cosine >= least
    i, j = np.nonzero(np.abs(cosine - least) < NEAR)
    if len(i):
        out[i, j] = pairwise(left[i], right[j], least)
    return out


def buckets(found: DataFrame, least: float, tables: int = TABLES, signs: int = SIGNS) -> DataFrame:
    """(bucket, id) for found (id, label, vector): a hash of label, length, table and signs, in every table of its label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int], np.ndarray] = {}
        for whole in batches:
            more = np.array(whole.column(3))
            for n in np.unique(more):
                own = signs + int(n)
                count, weights = tables_for(own, least, tables, signs), 1 << np.arange(own, dtype=np.int64)
                part = whole.take(pa.array(np.flatnonzero(more == n)))
                for at in range(0, part.num_rows, 2048):
                    batch = part.slice(at, 2048)
                    for rows, unit in _by_length(batch, 2):
                        dims = unit.shape[1]
                        if (dims, own) not in known:
                            known[dims, own] = planes(dims, count, own)
                        codes = (unit @ known[dims, own] > 0).reshape(len(rows), count, own) @ weights
                        taken = batch.take(pa.array(rows))
                        yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.array(np.full(len(rows), dims, np.int32)), pa.FixedSizeListArray.from_arrays(pa.array(codes.ravel()), count).cast(pa.list_(pa.int64()))], ["id", "label", "dims", "codes"])

    grown = F.ceil(F.log(F.count(F.lit(1)) / PLAIN) / F.log(F.lit(GROWTH)))
    large = found.groupBy("label").agg(F.greatest(F.lit(0), grown).cast("int").alias("more")).filter("more > 0")
    rows = found.select("id", "label", "vector").join(large, "label", "left").select("id", "label", "vector", F.coalesce("more", F.lit(0)).alias("more"))
    coded = rows.mapInArrow(run, rows.select("id", "label").schema.add("dims", "integer").add("codes", ArrayType(LongType())))
    return coded.select("id", "label", "dims", F.posexplode("codes").alias("table", "code")).select(F.xxhash64("label", "dims", "table", "code").alias("bucket"), "id")


def cosine_links(found: DataFrame, least: float):
    """verify() for linked_components: pairs of the same label and length whose cosine is at least `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, left in _by_length(batch, 2):
                right = batch.column(3).take(pa.array(rows))
                same = np.array(right.value_lengths()) == left.shape[1]
                rows, left = rows[same], left[same]
                if len(rows):
                    near = pairwise(left, _matrix(right.filter(pa.array(same))), least)
                    yield batch.select(["a", "b"]).take(pa.array(rows[near]))

    def verify(pairs: DataFrame) -> DataFrame:
        one, two = (found.select(F.col("id").alias(x), F.col("label").alias(f"l{x}"), F.col("vector").alias(f"v{x}")) for x in "ab")
        both = pairs.join(one, "a").join(two, "b").filter("la = lb").select("a", "b", "va", "vb")
        return both.mapInArrow(run, pairs.select("a", "b").schema)

    return verify


def near_blocks(least: float):
    """near() for linked_components: the links between two blocks (label, vector)."""

    def near(left: pa.Table, right: pa.Table) -> np.ndarray:
        left, right = left.combine_chunks().to_batches()[0], right.combine_chunks().to_batches()[0]
        out = np.zeros((left.num_rows, right.num_rows), bool)
        for i, a in _by_length(left, 1):
            for j, b in _by_length(right, 1):
                if a.shape[1] == b.shape[1]:
                    out[np.ix_(i, j)] = linked(a, b, least)
        labels = np.array(left.column(0)), np.array(right.column(0))
        return out & (labels[0][:, None] == labels[1][None, :])

    return near


def count_links(members: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """(id, others): linked vectors in other classes, for members (component, id, copies, label, vector).

    The classes of a component fall into blocks of about `block` by a hash; a task compares two blocks and returns counts,
    not pairs. Components of one block, nearly all, are compared once.
    """
    sizes = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    own = members.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    cell = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j")))
    cells = own.withColumn("cell", F.explode(cell)).select("component", "cell.i", "cell.j", "own", "id", "copies", "label", "vector")
    cells = cells.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")

    def counts(key: tuple, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows)
        own, ids, copies, labels, vectors = (t.column(k).combine_chunks() for k in range(3, 8))
        own, copies, labels = np.array(own), np.array(copies), np.array(labels)
        total = np.zeros(t.num_rows, np.int64)
        for at, unit in _by_length(pa.RecordBatch.from_arrays([vectors], ["v"]), 0):
            near = linked(unit, unit, least)
            near &= labels[at][:, None] == labels[at][None, :]
            if key[1] != key[2]:
                near &= own[at][:, None] != own[at][None, :]
            np.fill_diagonal(near, False)
            total[at] = near @ copies[at]
        return pa.RecordBatch.from_arrays([ids, pa.array(total)], ["id", "others"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            keys = np.stack([np.array(batch.column(k)) for k in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if key is not None and tuple(keys[a]) != key:
                    yield counts(key, held)
                    held = []
                key = tuple(keys[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield counts(key, held)

    return cells.mapInArrow(run, "id long, others long").groupBy("id").agg(F.sum("others").alias("others"))


def near_embeddings(vectors: DataFrame, least: float = 0.93, tables: int = TABLES, signs: int = SIGNS) -> DataFrame:
    """(id, n_links, component_id, kept) for vectors (id long, label, vector array<float>), one row for each row.

    Vectors link where labels are equal and not null, lengths are equal and the cosine, in double precision, is at least
    `least`. Vectors that are null, empty, zero or hold a null or non-finite component have no links and are components
    of their own, as are those with a null label. Rows that repeat a vector are copies and link; rows that repeat an id
    count as vectors each, with the links of their own vector. component_id is the smallest id that links reach, kept
    tells whether it is the row's own; a null id reaches others and is never theirs, unless all are null. Other columns
    are left out. No rows give no rows. Buckets of unlike vectors aside, no pair is emitted: hot groups are classes or
    blocks.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    vectors = vectors.select("id", "label", "vector")
    found = scratch.put(classes(vectors), "classes")
    named = found.select(F.col("key").alias("id"), "label", "vector")
    shared = shared_buckets(scratch.put(buckets(named, least, tables, signs), "buckets"), scratch)
    parts = linked_components(shared, named, cosine_links(named, least), near_blocks(least), scratch)
    members = found.withColumnRenamed("key", "id").join(parts, "id")
    others = scratch.put(count_links(members.select("component", "id", "copies", "label", "vector"), least), "others")
    firsts = members.groupBy("component").agg(F.min("first").alias("component_id"))
    of_class = parts.join(firsts, "component").join(others, "id", "left").select(F.col("id").alias("key"), "component_id", "others")
    summed = found.join(of_class, "key", "left")
    summed = scratch.put(summed.select("label", "vector", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component_id", "first").alias("component_id")), "summed")
    out = vectors.join(summed, ["label", "vector"], "left")
    component = F.coalesce("component_id", "id")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), "label", F.col("embedding").alias("vector"))
    return near_embeddings(vectors).withColumnRenamed("id", "vec_id")


def oracle() -> str:
    """DuckDB SQL for op1: all pairs of a label."""
    return """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
        r AS (SELECT vec_id AS id, vec_id AS seen FROM embeddings UNION SELECT r.id, l.b FROM r JOIN l ON r.seen = l.a),
        n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
        c AS (SELECT id, min(seen) AS component_id FROM r GROUP BY id)
        SELECT id AS vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, id = component_id AS kept FROM c LEFT JOIN n ON n.a = c.id"""
