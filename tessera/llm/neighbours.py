"""Approximate nearest neighbours by inner product: cross-polytope hashing, several probes of several tables, exact reranking.

A pseudo-rotation, three rounds of random signs and a fast Hadamard transform, turns a vector; its code is the signed axis
nearest to it, of as many axes as the number of vectors asks for. A vector is in one bucket of each table, a query looks
into the buckets of its nearest axes. Vectors of unlike norms get one more coordinate, by which the nearest in angle is the
one with the largest inner product. Whatever a query meets in a bucket is compared by its inner product, in double
precision on the vectors as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import Scratch, ship, table

ship(__name__)

#: Tables; vectors of a bucket, about, that the number of axes is chosen for; seed of the signs.
TABLES, BUCKET, SEED = 10, 128, 20_250_117
#: Queries of the bounded sample whose true neighbours fix the number of probes, and the share of those that must be met.
SAMPLE, MET = 64, 0.97
#: Vectors of a bucket that a task holds at once; queries pass by in batches.
BLOCK = 4096
#: Products of matrices this near to a query's floor are still taken, as the exact sum may differ by rounding.
SLACK = 1e-9
FOUND = "query long, key long, low long, score double"


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of rows whose length is a power of two, scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        pairs = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def axes_for(rows: int, dims: int, bucket: int = BUCKET) -> tuple[int, ...]:
    """Numbers of axes of the polytopes of a code, so that its buckets hold about `bucket` of `rows` vectors each."""
    codes, out = rows / bucket, []
    while codes >= 2:
        out.append(min(dims, 1 << int(np.log2(codes / 2))))
        codes /= 2 * out[-1]
    return tuple(out)


class Tables:
    """The rotations of all tables for unit vectors of one length."""

    def __init__(self, dims: int, rows: int, largest: float, tables: int = TABLES, bucket: int = BUCKET):
        self.dims, self.largest = dims, largest
        self.padded = 1 << int(np.ceil(np.log2(dims + 1)))
        self.axes = axes_for(rows, self.padded, bucket)
        self.tables = tables if self.axes else 1  # without axes all is one bucket
        self.signs = np.random.default_rng([SEED, dims]).choice([-1.0, 1.0], (tables, len(self.axes), 3, self.padded))

    def unit(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Rows as unit vectors with a further coordinate: nearest in angle is largest in inner product."""
        scaled = x / (np.abs(x).max(axis=1, keepdims=True) if query else self.largest)
        norms = (scaled * scaled).sum(axis=1)
        out = np.zeros((len(x), self.padded))
        out[:, : self.dims] = scaled / np.sqrt(norms)[:, None] if query else scaled
        if not query:
            out[:, self.dims] = np.sqrt(np.maximum(0.0, 1.0 - norms))
        return out

    def turned(self, unit: np.ndarray, t: int) -> list[np.ndarray]:
        """The coordinates on the axes of each polytope of table t."""
        out = []
        for p, count in enumerate(self.axes):
            y = unit
            for signs in self.signs[t, p]:
                y = hadamard(y * signs)
            out.append(y[:, :count])
        return out

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """(rows, tables): the bucket of each vector in each table."""
        out = np.zeros((len(unit), self.tables), np.int64)
        for t in range(self.tables):
            for y in self.turned(unit, t):
                axis = np.abs(y).argmax(axis=1)
                negative = np.take_along_axis(y, axis[:, None], 1)[:, 0] < 0
                out[:, t] = out[:, t] * (2 * y.shape[1]) + axis + negative * y.shape[1]
        return out

    def signed(self, y: np.ndarray) -> np.ndarray:
        return np.concatenate((y, -y), axis=1)

    def probes(self, unit: np.ndarray, count: int) -> np.ndarray:
        """(rows, tables, probes): the buckets with the largest sums of coordinates, -1 where there are no more."""
        out = np.full((len(unit), self.tables, count), -1, np.int64)
        for t in range(self.tables):
            best, codes = np.zeros((len(unit), 1)), np.zeros((len(unit), 1), np.int64)
            for y in self.turned(unit, t):
                s = self.signed(y)
                few = np.argsort(-s, axis=1, kind="stable")[:, :count]
                total = best[:, :, None] + np.take_along_axis(s, few, 1)[:, None, :]
                every = codes[:, :, None] * s.shape[1] + few[:, None, :]
                total, every = total.reshape(len(unit), -1), every.reshape(len(unit), -1)
                first = np.argsort(-total, axis=1, kind="stable")[:, :count]
                best, codes = np.take_along_axis(total, first, 1), np.take_along_axis(every, first, 1)
            out[:, t, : codes.shape[1]] = codes
        return out

    def ranks(self, query: np.ndarray, found: np.ndarray) -> np.ndarray:
        """For pairs of rows, the smallest number of buckets before the one of `found` that the query looks into, over all tables."""
        out = np.full(len(query), np.iinfo(np.int64).max)
        for t in range(self.tables):
            ours, theirs = self.turned(query, t), self.turned(found, t)
            sums, own = [self.signed(y) for y in ours], np.zeros(len(query))
            for s, y in zip(sums, theirs, strict=True):
                own += np.take_along_axis(s, self.signed(y).argmax(axis=1)[:, None], 1)[:, 0]
            for i in range(len(query)):
                # Sums over all polytopes that are larger: each but the last polytope's sums, against the last one's in order.
                rest = np.zeros(1)
                for s in sums[:-1]:
                    rest = (rest[:, None] + s[i][None, :]).ravel()
                last = np.sort(sums[-1][i]) if sums else np.zeros(1)
                before = int((len(last) - np.searchsorted(last, own[i] - rest + 1e-12, side="left")).sum()) if sums else 0
                out[i] = min(out[i], before)
        return out


def exact(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products row by row, summed from the first component to the last."""
    out = np.zeros(len(left))
    for k in range(left.shape[1]):
        out += left[:, k] * right[:, k]
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def best(x: np.ndarray, y: np.ndarray, lows: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, inner product): the k best of y for each of x, by product and then by the smaller of lows.

    A matrix product finds what may count, exact sums decide. What is below a row's floor is left out.
    """
    scores = x @ y.T
    least = np.full(len(x), -np.inf) if floor is None else floor
    if len(y) > k:
        least = np.maximum(least, np.partition(scores, len(y) - k, axis=1)[:, -k])
    i, j = np.nonzero(scores >= least[:, None] - SLACK)
    own = exact(x[i], y[j])
    if floor is not None:
        i, j, own = (c[own >= floor[i]] for c in (i, j, own))
    order = np.lexsort((lows[j], -own, i))
    i, j, own = i[order], j[order], own[order]
    first = np.searchsorted(i, np.arange(len(x)))
    few = np.arange(len(i)) - first[i] < k
    return i[few], j[few], own[few]


def classes(vectors: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """(key, low, dims, vector, ids): a row for each different usable vector, with the k + 1 smallest of its ids, the first of them low.

    More ids can't be among a query's k nearest, its own aside. The ids of a vector of any number of copies are cut twice,
    the first time in groups by a hash.
    """
    v = F.col("vector")
    usable = v.isNotNull() & F.col("id").isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.filter(usable).select("id", "vector").distinct()
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    few = rows.withColumn("n", F.row_number().over(Window.partitionBy("vector", "salt").orderBy("id"))).filter(F.col("n") <= k + 1)
    found = few.groupBy("vector").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("ids"))
    return scratch.put(found.select(F.monotonically_increasing_id().alias("key"), F.col("ids")[0].alias("low"), F.size("vector").alias("dims"), "vector", "ids"), "classes")


def nearest_in_blocks(points: DataFrame, queries: list[tuple[int, np.ndarray]], k: int) -> DataFrame:
    """(query, key, low, score): for a bounded list of queries the k nearest of each batch of points (key, low, vector), by plain products."""
    ids, x = np.array([q for q, _ in queries], np.int64), np.stack([v for _, v in queries])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                keys, lows = np.array(batch.column(0)), np.array(batch.column(1))
                i, j, own = best(x, _matrix(batch.column(2)), lows, k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(keys[j]), pa.array(lows[j]), pa.array(own)], ["query", "key", "low", "score"])

    return points.select("key", "low", "vector").mapInArrow(run, FOUND)


def cut(found: DataFrame, k: int) -> DataFrame:
    """The k best of found (query, key, low, score) for each query, with their place as n."""
    by_query = Window.partitionBy("query").orderBy(F.desc("score"), "low", "key")
    return found.withColumn("n", F.row_number().over(by_query)).filter(F.col("n") <= k)


def probes_for(points: DataFrame, queries: DataFrame, hashes: Tables, k: int, sample: int = SAMPLE, met: float = MET) -> int:
    """Buckets of a table that a query looks into, so that a share `met` of the sample's true neighbours is in one of them.

    The sample is at most `sample` queries (id, vector), those of the smallest hashes; its neighbours come from products
    with all points (key, vector). The driver gets sample x k vectors at most.
    """
    if not hashes.axes:
        return 1
    chosen = queries.orderBy(F.xxhash64("id"), "id").limit(sample).select("id", "vector").collect()
    if not chosen:
        return 1
    asked = [(i, np.array(r.vector, float)) for i, r in enumerate(chosen)]
    near = cut(nearest_in_blocks(points, asked, k + 1), k + 1)
    pairs = near.join(points.select("key", "vector"), "key").select("query", "vector").collect()
    x, y = np.stack([asked[r.query][1] for r in pairs]), np.array([r.vector for r in pairs], float)
    other = (x != y).any(axis=1)
    if not other.any():
        return 1
    ranks = hashes.ranks(hashes.unit(x[other], True), hashes.unit(y[other], False))
    return int(np.quantile(ranks, met, method="higher")) + 1


def _hashed(rows: DataFrame, hashes: Tables, probes: range | None, extra: str) -> DataFrame:
    """(bucket, <extra>, vector): a row for each table, or for those probes of each table, of rows (<extra>, vector)."""
    names = [*extra.split(", "), "vector"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                unit = hashes.unit(_matrix(batch.column(len(names) - 1)), probes is not None)
                codes = hashes.codes(unit)[:, :, None] if probes is None else hashes.probes(unit, probes.stop)[:, :, probes.start :]
                row, t, p = np.nonzero(codes >= 0)
                taken = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(codes[row, t, p] * hashes.tables + t), *taken.columns], ["bucket", *names])

    return rows.select(*names).mapInArrow(run, rows.select(F.lit(0).cast("long").alias("bucket"), *names).schema)


def _searched(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, key, low, score): what queries (bucket, query, floor, vector) find in points (bucket, key, low, vector), the k best of each block.

    A bucket falls into blocks of about BLOCK points by a hash, and its queries go to each. A task holds one block and lets
    queries pass, so that a bucket of any size and any number of queries fits. What is below a query's floor is left out.
    """
    parts = points.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    none = F.lit(None)
    held = points.join(parts, "bucket").select(F.xxhash64("bucket", F.pmod(F.xxhash64("key"), F.col("parts"))).alias("cell"), F.lit(0).alias("side"), F.col("key").alias("id"), "low", none.cast("double").alias("floor"), "vector")
    asked = queries.join(parts, "bucket").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)))
    asked = asked.select(F.xxhash64("bucket", "part").alias("cell"), F.lit(1).alias("side"), F.col("query").alias("id"), none.cast("long").alias("low"), "floor", "vector")
    cells = held.unionByName(asked).repartition("cell").sortWithinPartitions("cell", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, keys, lows, blocks = None, [], [], []
        for whole in batches:
            ids_of = np.stack([np.array(whole.column(0)), np.array(whole.column(1))], axis=1)
            cuts = [0, *(np.flatnonzero((ids_of[1:] != ids_of[:-1]).any(axis=1)) + 1).tolist(), len(ids_of)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                part, (here, side) = whole.slice(a, b - a), ids_of[a].tolist()
                if here != cell:
                    cell, keys, lows, blocks = here, [], [], []
                if side == 0:
                    keys.append(np.array(part.column(2)))
                    lows.append(np.array(part.column(3)))
                    blocks.append(_matrix(part.column(5)))
                elif blocks:
                    if len(blocks) > 1:
                        keys, lows, blocks = [np.concatenate(keys)], [np.concatenate(lows)], [np.concatenate(blocks)]
                    for at in range(0, part.num_rows, 512):
                        some = part.slice(at, 512)
                        i, j, own = best(_matrix(some.column(5)), blocks[0], lows[0], k, np.array(some.column(4)))
                        if len(i):
                            yield pa.RecordBatch.from_arrays([pa.array(np.array(some.column(2))[i]), pa.array(keys[0][j]), pa.array(lows[0][j]), pa.array(own)], ["query", "key", "low", "score"])

    return cells.mapInArrow(run, FOUND)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, tables: int = TABLES, bucket: int = BUCKET, met: float = MET) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of vectors (id long, vector) that are found for queries (id long, vector).

    Nearness is the inner product in double precision, ties go to the smaller id; a query's own id is no candidate. Vectors
    that are null or zero, or hold null or non-finite components, and those without an id, take no part; vectors of
    another length than a query's are no candidates of it. Rows that repeat id and vector count once; an id with several
    vectors is a candidate with each, and a query with each, whose best k count together. Copies of a vector are one class, so a vector
    that a third of all rows share costs what one costs. Nothing is cut among candidates: all of a bucket are compared.
    Every row is indexed. No rows, or no queries, give no rows; other columns are left out.

    The k nearest in a query's first bucket of each table give it a floor, which spares the further probes what can't
    count. Buckets are blocks of cells, and no task holds more than a block and a batch of queries.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neighbours")
    every = classes(vectors, k, scratch)
    norm = F.sqrt(F.aggregate(F.transform("vector", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x))
    sizes = every.groupBy("dims").agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("largest")).orderBy("dims").collect()
    v = F.col("vector")
    fit = v.isNotNull() & F.col("id").isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    # A query has a number of its own, as several may share an id.
    asked = scratch.put(queries.filter(fit).select("id", "vector").distinct().withColumn("query", F.monotonically_increasing_id()), "queries")
    found = None
    for of in sizes:  # one length, as a rule
        hashes = Tables(of.dims, of.n, of.largest, tables, bucket)
        points, own = every.filter(F.col("dims") == of.dims), asked.filter(F.size("vector") == of.dims)
        probes = probes_for(points, own, hashes, k, met=met)
        held = scratch.put(_hashed(points, hashes, None, "key, low"), "points")
        bare = F.lit(float("-inf"))
        # k + 1, as one of them may be the query's own; fewer give no floor.
        first = scratch.put(cut(_searched(held, _hashed(own.withColumn("floor", bare), hashes, range(1), "query, floor"), k + 1).distinct(), k + 1), "first")
        floors = first.filter(F.col("n") == k + 1).select("query", F.col("score").alias("floor"))
        ready = own.join(floors, "query", "left").withColumn("floor", F.coalesce("floor", bare))
        both = first.drop("n")
        if probes > 1:
            both = both.unionByName(_searched(held, _hashed(ready, hashes, range(1, probes), "query, floor"), k + 1))
        found = both if found is None else found.unionByName(both)
    if found is None:
        found = spark.createDataFrame([], FOUND)
    top = scratch.put(cut(found.distinct(), k + 1), "best")
    named = top.join(every.select("key", "ids"), "key").join(asked.select("query", F.col("id").alias("query_id")), "query")
    rows = named.select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id").distinct()
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector"))
    return nearest(vectors, vectors.filter("id % 20 = 0"))
