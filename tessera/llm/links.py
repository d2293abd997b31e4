"""Verified links from buckets of candidates, and connected components, as joins and aggregations.

A bucket holds the ids that some hash puts together. The one that meets most ids over all buckets leads it: leader and
member are compared first, so a bucket of any size costs a comparison a member. Ids in buckets that this leaves with more
than one component are put in finer buckets by an exact filter, where there is one, and meet further leaders. What still
is in several components is compared in blocks inside tasks, across components only, so no link between components is
lost and no group emits all its pairs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, ship

ship(__name__)

#: Rounds of components() before it gives up; each at least halves the longest path that is left.
ROUNDS = 60
#: Ids, and bytes of payload, in a block of ids that a task compares with another; about, as a hash deals them out.
BLOCK, BLOCK_BYTES = 256, 16_000_000
#: Leaders of a bucket, one after another, before its rest is compared in blocks.
LEADERS = 3


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) of every id in edges (a, b): component is the smallest id that links reach.

    Each round hangs every neighbour of an id, and the id itself, from the smallest of them (larger ones first, then
    smaller ones), until every id hangs from one id that hangs from none. A hub of any degree is a row for each of its
    edges and is aggregated before it is shuffled; rounds grow with the logarithm of the longest path.
    """
    now = scratch.put(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(ROUNDS):
        roles = now.select(F.col("a").alias("id"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(now.select(F.col("b").alias("id"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
        if roles.groupBy("id").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).filter("hangs > 1 or hangs > 0 and holds > 0").isEmpty():
            return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        # Large star: neighbours above an id hang from its smallest neighbour.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = scratch.put(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        # Small star: an id and its smaller neighbours hang from the smallest of them.
        below = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(below, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = scratch.put(small.unionByName(below.select("a", F.col("m").alias("b"))).distinct(), "edges")
        scratch.drop(now, large)
        now = after
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")


def shared_buckets(buckets: DataFrame, scratch: Scratch) -> DataFrame:
    """(bucket, id, met): the buckets (bucket, id) that hold several ids; met is how many ids an id meets in all of them."""
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("bucket", "n")
    shared = scratch.put(buckets.join(sizes, "bucket").select("bucket", "id", "n"), "shared")
    met = scratch.put(shared.join(shared.groupBy("id").agg(F.sum("n").alias("met")), "id").select("bucket", "id", "met"), "met")
    scratch.drop(shared)
    return met


def linked_components(shared: DataFrame, payload: DataFrame, verify: Callable[[DataFrame], DataFrame], near: Callable, scratch: Scratch, weight: str | None = None, narrow: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(id, component) of the ids in shared_buckets() that have a link, by verified links only.

    payload (id, ...) holds what is compared. verify takes distinct pairs (a, b) and returns those that are links. near
    takes the payload columns of two blocks as Arrow tables and returns their matrix of links. weight is a payload column
    with the bytes of a row, where they differ much. narrow takes ids and returns buckets (bucket, id) of which every two
    linked ids share one: an exact filter for the ids that the first leaders leave in several components.
    """
    found, mixed = _by_leaders(shared, None, verify, scratch, LEADERS if narrow is None else 1)
    if mixed is not None and narrow is not None:
        finer = narrow(mixed.select("id").distinct())
        found, mixed = _by_leaders(shared_buckets(finer, scratch), found, verify, scratch, LEADERS)
        scratch.drop(finer)
    if mixed is None:
        return found
    more = scratch.put(_across(mixed, payload, near, scratch, weight), "more-links")
    return found if more.isEmpty() else _merged(found, more, scratch)


def _by_leaders(now: DataFrame, found: DataFrame | None, verify: Callable, scratch: Scratch, rounds: int) -> tuple[DataFrame, DataFrame | None]:
    """Components (id, component) after at most `rounds` rounds, and what is left: (bucket, id, component, top, leader), or None.

    A round compares each bucket's leader with the members of other components, a comparison a member at most. The leader
    then leaves the bucket, as no link of its own can be missing there, and buckets of one component leave altogether. A
    round without links is the last.
    """
    own = F.coalesce("component", "id")

    def mixed(rows: DataFrame) -> DataFrame:
        several = rows.groupBy("bucket").agg(F.min(own).alias("low"), F.max(own).alias("high")).filter("low < high").select("bucket")
        return rows.join(several, "bucket")

    now = now.withColumn("component", F.lit(None).cast("long")) if found is None else scratch.put(mixed(now.join(found, "id", "left").select("bucket", "id", "met", "component")), "mixed")
    for _ in range(rounds):
        leaders = now.groupBy("bucket").agg(F.max(F.struct("met", (-F.col("id")).alias("minus"), own.alias("own"))).alias("top"))
        leaders = leaders.select("bucket", F.col("top.met").alias("top"), (-F.col("top.minus")).alias("leader"), F.col("top.own").alias("leads"))
        led = scratch.put(now.select("bucket", "id", "met", "component").join(leaders, "bucket").filter(F.col("id") != F.col("leader")), "led")
        pairs = led.filter(own != F.col("leads")).select(F.least("leader", "id").alias("a"), F.greatest("leader", "id").alias("b")).distinct()
        links = scratch.put(verify(pairs), "star-links")
        none = links.isEmpty()
        if found is None:
            found = scratch.put(components(links, scratch), "components")
        elif not none:
            found = _merged(found, links, scratch)
        now = scratch.put(mixed(led.drop("component").join(found, "id", "left")), "mixed")
        scratch.drop(led, links)
        if none:
            break
    return found, None if now.isEmpty() else now.select("bucket", "id", "component", "top", "leader")


def _merged(found: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Components after further links (a, b): those of found (id, component) are joined as wholes."""
    ends = [found.select(F.col("id").alias(x), F.col("component").alias(f"c{x}")) for x in "ab"]
    edges = links.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    moved = scratch.put(components(edges, scratch), "moved")
    to = moved.select(F.col("id").alias("component"), F.col("component").alias("to"))
    after = found.join(to, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    alone = moved.join(found.select("id"), "id", "left_anti").select("id", "component")
    return scratch.put(after.unionByName(alone), "components")


def _across(named: DataFrame, payload: DataFrame, near: Callable, scratch: Scratch, weight: str | None) -> DataFrame:
    """Links (a, b) between components of the ids that share a bucket, in named (bucket, id, component, top, leader).

    Ids fall into blocks by the leader that most ids meet, by component (or none) and a hash. Two blocks meet where a
    bucket holds ids of both, unless they are of one component; a task compares them and returns links that join the
    components in it, at most one for each id.
    """
    home = F.max(F.struct("top", (-F.col("leader")).alias("minus")))["minus"]
    ids = named.groupBy("id").agg(home.alias("home"), F.first("component").alias("component"))
    sized = scratch.put(ids.join(payload.select("id", (F.lit(1) if weight is None else F.col(weight)).alias("bytes")), "id"), "homes")
    parts = sized.groupBy("home", "component").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("id"), F.col("parts"))
    same = F.expr("a.home = b.home AND a.component <=> b.component")
    blocks = sized.alias("a").join(parts.alias("b"), same).select("id", "a.component", F.xxhash64("a.home", F.coalesce("a.component", F.lit(-1)), part).alias("block"))
    blocks = scratch.put(blocks, "blocks")
    in_bucket = scratch.put(named.select("bucket", "id").join(blocks, "id").select("bucket", "block", "component").distinct(), "bucket-blocks")
    other = in_bucket.select("bucket", F.col("block").alias("other"), F.col("component").alias("others"))
    cells = in_bucket.join(other, "bucket").filter("block <= other AND NOT coalesce(component = others, false)").select("block", "other").distinct()
    cells = scratch.put(cells.withColumn("cell", F.xxhash64("block", "other")), "cells")
    sides = cells.select("cell", F.lit(0).alias("side"), "block").unionByName(cells.filter("block <> other").select("cell", F.lit(1).alias("side"), F.col("other").alias("block")))
    rows = sides.join(blocks, "block").join(payload, "id").withColumn("own", F.coalesce("component", "id"))
    columns = [c for c in payload.columns if c not in ("id", weight)]
    rows = rows.select("cell", "side", "id", "own", *columns).repartition("cell").sortWithinPartitions("cell", "side")
    return rows.mapInArrow(_joining(near), "a long, b long")


def _joining(near: Callable):
    import numpy as np
    import pyarrow as pa

    def links(t: pa.Table) -> pa.RecordBatch:
        side, ids, own = (np.array(t.column(k)) for k in (1, 2, 3))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        right = right if len(right) else left
        data = t.select(range(4, t.num_columns))
        found = near(data.take(pa.array(left)), data.take(pa.array(right)))
        found &= own[left][:, None] != own[right][None, :]
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = x = root.get(root[x], root[x])
            return x

        out = []
        for i, j in zip(*(x.tolist() for x in np.nonzero(found)), strict=True):
            a, b = top(int(own[left[i]])), top(int(own[right[j]]))
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append(sorted((int(ids[left[i]]), int(ids[right[j]]))))
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    def run(batches):
        key, held = None, []
        for batch in batches:
            keys = np.array(batch.column(0))
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if key is not None and keys[a] != key:
                    yield links(pa.Table.from_batches(held))
                    held = []
                key = keys[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield links(pa.Table.from_batches(held))

    return run
