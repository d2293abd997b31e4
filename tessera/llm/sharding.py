"""Shards by balanced label propagation: linked documents move towards their neighbours' shards under quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, cumulated, salts_for, table, text_or_empty

#: Rounds of propagation at most; what is left then is split over the rooms that are left.
ROUNDS = 12
#: Groups of more than a shard's capacity over LARGE, at most LARGE times the shards, find their shards first.
LARGE = 8


def _by_range(bounds: list[tuple[int, int, int]], at: Column) -> Column:
    """The shard of the range (shard, begin, end) that holds `at`; ranges are as many as shards."""
    out = F.lit(None).cast("int")
    for shard, begin, end in bounds:
        if end > begin:
            out = F.when((at >= begin) & (at < end), shard).otherwise(out)
    return out


def _ranges(rooms: list[int]) -> list[tuple[int, int, int]]:
    out, at = [], 0
    for shard, n in enumerate(rooms):
        out.append((shard, at, at + n))
        at += n
    return out


def _large(groups: dict[str, dict[int, int]], room: list[int]) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(hub, shard, n) for a few large groups {hub: {shard: n}}, the largest first, and for what is left of them.

    Their places are taken from `room`.

    A group of more than a shard goes to whole shards as long as it fills them. Each takes the shard that has room for it
    and most of its documents; a rest that fits nowhere is left to the rounds.
    """
    out, left, most = [], [], max(room)
    for hub, there in sorted(groups.items(), key=lambda x: (-sum(x[1].values()), x[0])):
        rest = sum(there.values())
        while rest:
            n = min(rest, max(room)) if rest > most else rest
            fits = [s for s, free in enumerate(room) if free >= n > 0]
            if not fits:
                left.append((hub, 0, rest))
                break
            shard = max(fits, key=lambda s: (there.get(s, 0), -s))
            out.append((hub, shard, n))
            room[shard] -= n
            rest -= n
    return out, left


def _propagate(blocks: DataFrame, room: list[int], salts: int) -> DataFrame:
    """(hub, target, all) that a round grants, for blocks (hub, shard, n): n documents of a hub, all alike, in a shard.

    The documents of a hub see their neighbours' shards by a join and ask to move together to the one with most of them
    among those that have room for all; where none has, to a shard with room by a hash. Requests to a shard are granted
    as long as its room lasts.
    """
    free = F.array(*[F.struct(F.lit(s).alias("shard"), F.lit(int(n)).cast("long").alias("room")) for s, n in enumerate(room)])
    sizes = blocks.groupBy("hub").agg(F.sum("n").alias("all"))
    seen = blocks.join(sizes, "hub").filter(F.get(free, F.col("shard"))["room"] >= F.col("all"))
    best = seen.groupBy("hub").agg(F.max(F.struct("n", (-F.col("shard")).alias("minus"))).alias("top")).select("hub", (-F.col("top.minus")).alias("near"))
    fits = F.filter(free, lambda s: s["room"] >= F.col("all"))
    other = F.get(fits, F.pmod(F.xxhash64("hub"), F.greatest(F.size(fits), F.lit(1))).cast("int"))["shard"]
    asked = sizes.join(best, "hub", "left").select("hub", "all", F.coalesce("near", other).alias("target")).filter("target is not null")
    asked = cumulated(asked, ["target"], ["hub"], "all", "before", salts)
    return asked.filter(F.col("before") + F.col("all") <= F.get(free, F.col("target"))["room"]).select("hub", "target", "all")


def _split(groups: DataFrame, room: list[int], salts: int) -> DataFrame:
    """(hub, shard, n) for groups (hub, all) that fit no shard whole: they fill the rooms one after another, largest first."""
    over = cumulated(groups.withColumn("whole", F.lit(0)), ["whole"], ["hub"], "all", "before", salts)
    order = sorted(range(len(room)), key=lambda s: (-room[s], s))
    ranges = dict(zip(order, _ranges([room[s] for s in order]), strict=True))
    to = F.array(*[F.struct(F.lit(s).alias("shard"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for s, (_, a, b) in ranges.items()])
    parts = over.select("hub", "all", "before", F.explode(to).alias("to")).select("hub", F.col("to.shard").alias("shard"), (F.least(F.col("to.b"), F.col("before") + F.col("all")) - F.greatest(F.col("to.a"), F.col("before"))).alias("n"))
    return parts.filter("n > 0")


def shard_rows(docs: DataFrame, shards: int, rounds: int = ROUNDS) -> DataFrame:
    """Adds `shard` (0 to shards - 1) to docs (id, hub, ...): counts at most one apart, documents of a hub together.

    Documents with the same non-null hub are linked and begin on shards by a hash of their id. The state is a row for each
    hub and shard, so a hub of any size has `shards` rows at most. In each round the hubs that have no place yet move to
    the shard with most of their documents that has room for all; a hub is cut only if it is larger than a shard, or if
    after the rounds no shard has room for it. Hubs of more than an eighth of a shard, at most eight times the shards, go
    first. Documents are only touched once, at the end; those without links fill the shards up. Null hubs have no links;
    repeated rows count each, null ids too; fewer documents than shards leave the last shards empty; no rows give no
    rows. Texts aren't looked at. Other columns are kept, but for `shard`, which is replaced; no name is reserved.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    names = [c for c in docs.columns if c != "shard"]
    inner = docs.select(F.col("id").alias("__id"), F.col("hub").alias("hub"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"))
    hubs = inner.filter("hub is not null").groupBy("hub", F.pmod(F.xxhash64("__id"), F.lit(shards)).cast("int").alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    linked = hubs.groupBy("hub").agg(F.sum("n").alias("all")).filter("all > 1").select("hub")
    total = docs.count()
    salts = salts_for(total)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    blocks = scratch.put(hubs.join(linked, "hub").select("hub", "shard", "n"), "blocks")
    least = max(1, total // shards // LARGE)
    large: dict[str, dict[int, int]] = {}
    for r in blocks.join(blocks.groupBy("hub").agg(F.sum("n").alias("all")).filter(F.col("all") > least).select("hub"), "hub").collect():  # at most LARGE * shards hubs
        large.setdefault(r.hub, {})[r.shard] = r.n
    first, left = _large(large, room)
    kind = "hub string, shard int, n long"
    placed = [spark.createDataFrame(first, kind)]
    open_ = blocks.join(spark.createDataFrame([(h,) for h in large], "hub string"), "hub", "left_anti")
    open_ = scratch.put(open_.unionByName(spark.createDataFrame(left, kind)), "open")
    for _ in range(rounds):
        granted = scratch.put(_propagate(open_, room, salts), "granted")
        taken = {r.target: r.n for r in granted.groupBy("target").agg(F.sum("all").alias("n")).collect()}
        if not taken:
            break
        room = [n - taken.get(s, 0) for s, n in enumerate(room)]
        placed.append(granted.select("hub", F.col("target").alias("shard"), F.col("all").alias("n")))
        after = scratch.put(open_.join(granted.select("hub"), "hub", "left_anti"), "open")
        scratch.drop(open_)
        open_ = after
    split = scratch.put(_split(open_.groupBy("hub").agg(F.sum("n").alias("all")), room, salts), "split")
    taken = {r.shard: r.n for r in split.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    room = [n - taken.get(s, 0) for s, n in enumerate(room)]
    every = split
    for p in placed:
        every = every.unionByName(p)

    # Where a hub's documents go: its shards with the number of documents that each takes.
    summed = every.groupBy("hub", "shard").agg(F.sum("n").alias("n"))
    places = scratch.put(summed.groupBy("hub").agg(F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("__parts")), "places")
    rows = inner.join(places, "hub", "left")
    one = rows.filter("size(__parts) = 1").select("__row", F.col("__parts")[0]["shard"].alias("shard"))
    cut = cumulated(rows.filter("size(__parts) > 1"), ["hub"], ["__id"], None, "__rank", salts)
    step = lambda acc, p: F.struct((acc["end"] + p["n"]).alias("end"), F.when(acc["shard"].isNull() & (F.col("__rank") < acc["end"] + p["n"]), p["shard"]).otherwise(acc["shard"]).alias("shard"))
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(None).cast("int").alias("shard"))
    cut = cut.select("__row", F.aggregate("__parts", start, step)["shard"].alias("shard"))
    alone = cumulated(rows.filter("__parts is null").withColumn("__all", F.lit(0)), ["__all"], ["__id"], None, "__rank", salts)
    alone = alone.select("__row", _by_range(_ranges(room), F.col("__rank")).alias("shard"))
    return one.unionByName(cut).unionByName(alone).select(*[F.col(f"__row.`{c}`").alias(c) for c in names], "shard")


def op9_sharding(spark: SparkSession, sf_dir: str, shards: int = 16) -> DataFrame:
    raw = F.encode(text_or_empty(), "utf-8")
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(raw).cast("long").alias("text_crc32"), F.sha2(raw, 256).alias("hub")
    )
    scratch = Scratch(spark, "sharding")
    docs = scratch.put(docs, "sizes")
    out = scratch.put(shard_rows(docs, shards), "shards")
    slots = cumulated(out, ["shard"], ["id"], None, "slot", salts_for(docs.count()))
    return slots.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
