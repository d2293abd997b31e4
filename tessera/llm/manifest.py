"""Merkle manifest: one digest for a table, a digest for each group of its rows, and a proof for each row.

A row is a leaf; the leaves of a group, in order, are the first level of its tree, and the groups' roots, in order, the
first level of the top tree. The order is dealt out by ranges, so a part of the rows is a stretch of leaves, and what it
can't resolve alone is a sparse forest: nodes at its two edges, keyed by (tree, level, index). Forests form a monoid: the
union of two, in which every run of siblings that is complete becomes its parent. A run's arity is known from the number
of leaves. Forests are merged in rounds of FAN at a time, each written, until one is left whose only node is the root. A
proof needs what its part holds and a few nodes beside the part's edges, which the rounds have met.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import Scratch, ship, table

ship(__name__)

#: Siblings of a run; rows of a part, about; forests that a round merges at once.
ARITY, PART_ROWS, FAN = 3, 32_768, 16
#: The number of the tree of groups.
TOP = -1
NODE = "tree long, level int, idx long, size long, digest string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """A value as its part of a leaf: - for null, else its UTF-8 bytes with their number before them."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


class Forest:
    """Nodes {(tree, level, index): digest} without their parents, of trees whose numbers of leaves are known."""

    def __init__(self, sizes: dict[int, int], arity: int = ARITY):
        self.sizes, self.arity, self.nodes = sizes, arity, {}
        self.made: dict[tuple[int, int, int], str] = {}  # whatever was a node here, resolved or not

    def width(self, tree: int, level: int) -> int:
        out = self.sizes[tree]
        for _ in range(level):
            out = -(-out // self.arity)
        return out

    def add(self, nodes: dict[tuple[int, int, int], str]) -> Forest:
        """The union with further nodes, resolved: runs that are complete become their parents, level by level."""
        self.made |= nodes
        fresh, held, widths = dict(nodes), self.nodes, {}
        while fresh:
            held |= fresh
            runs, fresh = {(t, level, i // self.arity) for t, level, i in fresh}, {}
            for t, level, run in runs:
                if (t, level) not in widths:
                    widths[t, level] = self.width(t, level)
                width, at = widths[t, level], run * self.arity
                if width == 1:
                    if t != TOP:
                        fresh[TOP, 0, t] = held.pop((t, level, 0))
                    continue
                keys = [(t, level, k) for k in range(at, min(at + self.arity, width))]
                if all(k in held for k in keys):
                    fresh[t, level + 1, run] = digest("".join(held.pop(k) for k in keys))
            self.made |= fresh
        return self


def beside(tree: int, first: int, last: int, size: int, arity: int = ARITY) -> list[tuple[int, int, int]]:
    """Nodes that proofs of the leaves first..last need and that these leaves alone don't make."""
    out, level, low, high = [], 0, first, last  # low..high: nodes of this level made of those leaves alone
    a, b, width = first, last, size
    while width > 1:
        for run in {a // arity, b // arity}:
            out += [(tree, level, k) for k in range(run * arity, min(run * arity + arity, width)) if not low <= k <= high]
        low, high = -(-low // arity), (high // arity if high == width - 1 else (high + 1) // arity - 1)
        a, b, width, level = a // arity, b // arity, -(-width // arity), level + 1
    return out


class Path:
    """Siblings of nodes, of which those of the last path are kept, as leaves come in order."""

    def __init__(self, get: Callable[[int, int, int], str], sizes: dict[int, int], arity: int = ARITY):
        self.get, self.sizes, self.arity, self.last = get, sizes, arity, {}

    def steps(self, tree: int, index: int) -> list[tuple[str, str, bool]]:
        """From a leaf to the root: the digests left and right of the node, and whether its parent is a tree's root."""
        return self._from(tree, 0, index, self.sizes[tree])

    def _from(self, tree: int, level: int, index: int, width: int) -> list[tuple[str, str, bool]]:
        if width == 1:
            return [] if tree == TOP else self._from(TOP, 0, tree, self.sizes[TOP])
        key = (tree, index)
        if self.last.get((tree == TOP, level), (None,))[0] == key:
            return self.last[tree == TOP, level][1]
        run = index - index % self.arity
        left = "".join(self.get(tree, level, k) for k in range(run, index))
        right = "".join(self.get(tree, level, k) for k in range(index + 1, min(run + self.arity, width)))
        above = -(-width // self.arity)
        out = [(left, right, above == 1 and tree != TOP), *self._from(tree, level + 1, index // self.arity, above)]
        self.last[tree == TOP, level] = key, out
        return out


def fold(leaf: str, steps: list[tuple[str, str, bool]]) -> tuple[str, str]:
    """(root of the leaf's tree, root of all) from a leaf and what stands beside its path."""
    subroot = None
    for left, right, ends in steps:
        leaf = digest(left + leaf + right)
        subroot = leaf if ends else subroot
    return subroot, leaf


def _placed(rows: pa.Table, context: pa.Table):
    """(sizes of trees, nodes from elsewhere) of a part, and its rows in order with their trees and indexes."""
    sizes, by_group, given = {}, {}, {}
    for kind, group, tree, a, b, size, text in zip(*(context.column(k).to_pylist() for k in ("kind", "group", "tree", "a", "b", "size", "digest")), strict=True):
        if kind == "span":
            by_group[group], sizes[tree] = (tree, a), size
        elif kind == "top":
            sizes[TOP] = size
        else:
            given[tree, a, b] = text
    rows = rows.sort_by("row")
    seen: dict[int, int] = {}
    places = []
    for group in rows.column("group").to_pylist():
        tree, first = by_group[group]
        places.append((tree, first + seen.get(tree, 0)))
        seen[tree] = seen.get(tree, 0) + 1
    return sizes, given, rows, places


def _grown(sizes: dict[int, int], rows: pa.Table, places: list[tuple[int, int]]) -> Forest:
    return Forest(sizes).add({(t, 0, i): leaf for (t, i), leaf in zip(places, rows.column("leaf").to_pylist(), strict=True)})


def _nodes(found: dict[tuple[int, int, int], str], sizes: dict[int, int], **more) -> pa.Table:
    keys = sorted(found)
    columns = {"tree": pa.array([k[0] for k in keys], pa.int64()), "level": pa.array([k[1] for k in keys], pa.int32()), "idx": pa.array([k[2] for k in keys], pa.int64()), "size": pa.array([sizes[k[0]] for k in keys], pa.int64()), "digest": pa.array([found[k] for k in keys], pa.string())}
    return pa.table({k: pa.array([v] * len(keys), pa.int64()) for k, v in more.items()} | columns)


def _leaves_to_forest(key: tuple, rows: pa.Table, context: pa.Table) -> pa.Table:
    sizes, _, rows, places = _placed(rows, context)
    forest = _grown(sizes, rows, places)
    return _nodes(forest.nodes, sizes, forest=key[0].as_py())


def _merge(key: tuple, nodes: pa.Table) -> pa.Table:
    """The forests of a group as one; nodes that it met but resolved stay in the table as met ones, for proofs."""
    columns = {k: nodes.column(k).to_pylist() for k in ("tree", "level", "idx", "size", "digest")}
    sizes = dict(zip(columns["tree"], columns["size"], strict=True))
    sizes[TOP] = nodes.column("groups")[0].as_py()
    forest = Forest(sizes).add(dict(zip(zip(columns["tree"], columns["level"], columns["idx"], strict=True), columns["digest"], strict=True)))
    out = _nodes(forest.made, sizes, forest=key[0].as_py())
    return out.append_column("open", pa.array([(t, level, i) in forest.nodes for t, level, i in sorted(forest.made)], pa.bool_()))


def _wanted(key: tuple, context: pa.Table) -> pa.Table:
    """What a part needs from elsewhere: nodes beside its stretches of leaves and beside its stretch of whole groups."""
    spans = [(t, a, b, size) for kind, t, a, b, size in zip(*(context.column(k).to_pylist() for k in ("kind", "tree", "a", "b", "size")), strict=True) if kind == "span"]
    groups = next(size for kind, size in zip(context.column("kind").to_pylist(), context.column("size").to_pylist(), strict=True) if kind == "top")
    out = set()
    for t, a, b, size in spans:
        if b - a < size:
            out.update(beside(t, a, b - 1, size))
    trees = sorted(t for t, _, _, _ in spans)
    whole = [t for t, a, b, size in spans if b - a == size]
    # Groups that lie in several parts are wanted like any other node of the top tree.
    out.update(beside(TOP, trees[0], trees[-1], groups))
    ragged = {(TOP, 0, t) for t in trees if t not in whole}
    while ragged:
        out |= ragged
        level = next(iter(ragged))[1]
        width = groups
        for _ in range(level):
            width = -(-width // ARITY)
        ragged = {(TOP, level + 1, k // ARITY) for _, _, k in ragged} if width > 1 else set()
    keys = sorted(out)
    return pa.table({"part": pa.array([key[0].as_py()] * len(keys), pa.int64()), "tree": pa.array([k[0] for k in keys], pa.int64()), "level": pa.array([k[1] for k in keys], pa.int32()), "idx": pa.array([k[2] for k in keys], pa.int64())})


def _prove(key: tuple, rows: pa.Table, context: pa.Table) -> pa.Table:
    sizes, given, rows, places = _placed(rows, context)
    known = _grown(sizes, rows, places).made | given
    path = Path(lambda t, level, i: known[t, level, i], sizes)
    subroots, proofs, folded = [], [], []
    for (tree, index), leaf, now in zip(places, rows.column("leaf").to_pylist(), rows.column("now").to_pylist(), strict=True):
        steps = path.steps(tree, index)
        subroots.append(fold(leaf, steps)[0] or leaf)
        proofs.append(digest("".join(left + right for left, right, _ in steps)))
        folded.append(fold(now, steps)[1])
    return rows.select(["id", "leaf"]).append_column("subroot", pa.array(subroots, pa.string())).append_column("proof_sha256", pa.array(proofs, pa.string())).append_column("folded_root", pa.array(folded, pa.string()))


def merkle_manifest(leaves: DataFrame, part_rows: int = PART_ROWS, fan: int = FAN) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) for leaves (id, group, leaf, now), a row for each.

    leaf is a row's digest and now that of the row as it is found later; folded_root is what `now` and the leaf's siblings
    give, and verified tells whether that is the root. Leaves of a group ascend by id (null first), those of equal ids by
    digest; rows that repeat an id are leaves each. Groups ascend bytewise, null before all, as a group of its own. A
    group of one leaf is its own root, and so is one group's root that of all; its proof is the digest of no text. No rows
    give no rows; other columns are left out.

    Rows are dealt by ranges of (group, id, digest), so a group of any size lies in many parts of about `part_rows`. A
    part brings some nodes a level at its edges to the rounds; numbers of leaves are counted by (part, group). The driver
    gets one node, the root, and the numbers of rows, parts and groups.
    """
    spark = leaves.sparkSession
    scratch = Scratch(spark, "manifest")
    plain = scratch.put(leaves.select("id", "group", "leaf", "now"), "leaves")
    parts = max(1, -(-plain.count() // part_rows))
    row = F.monotonically_increasing_id()
    dealt = plain.repartitionByRange(parts, "group", "id", "leaf").sortWithinPartitions("group", "id", "leaf")
    rows = scratch.put(dealt.withColumn("row", row).withColumn("part", F.shiftright("row", 33)), "ordered")
    # Stretches of leaves, (part, group), with the group's number, first index, and size.
    counts = scratch.put(rows.groupBy("part", "group").agg(F.count(F.lit(1)).alias("n")), "counts")
    of_group = Window.partitionBy("group").orderBy("part")
    spans = counts.withColumn("a", F.coalesce(F.sum("n").over(of_group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("size", F.sum("n").over(Window.partitionBy("group")))
    spans = spans.withColumn("begins", (F.col("a") == 0).cast("long"))
    spans = scratch.put(spans.withColumn("own", F.sum("begins").over(Window.partitionBy("part").orderBy("group"))), "stretches")
    begun = spans.groupBy("part").agg(F.sum("begins").alias("begun"))
    before = begun.select("part", F.coalesce(F.sum("begun").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    groups, last_part = spans.agg(F.coalesce(F.sum("begins"), F.lit(0)), F.coalesce(F.max("part"), F.lit(0))).first()
    spans = spans.join(before, "part").withColumn("tree", F.col("before") + F.col("own") - 1)
    span = spans.select("part", F.lit("span").alias("kind"), "group", "tree", "a", (F.col("a") + F.col("n")).alias("b"), "size", F.lit(None).cast("string").alias("digest"))
    null = F.lit(None).cast("long")
    top = begun.select("part", F.lit("top").alias("kind"), F.lit(None).cast("string").alias("group"), null.alias("tree"), null.alias("a"), null.alias("b"), F.lit(groups).cast("long").alias("size"), F.lit(None).cast("string").alias("digest"))
    context = scratch.put(span.unionByName(top), "context")
    by_part = lambda df: df.groupBy("part")
    nodes = by_part(rows).cogroup(by_part(context)).applyInArrow(_leaves_to_forest, f"forest long, {NODE}")
    # Rounds; `met` are the tables of nodes that some round has met.
    forest, met, left = scratch.put(nodes, "forests"), [], last_part + 1
    while True:
        left = -(-left // fan)
        grouped = forest.withColumn("forest", F.floor(F.col("forest") / fan).cast("long")).withColumn("groups", F.lit(groups).cast("long")).groupBy("forest")
        merged = scratch.put(grouped.applyInArrow(_merge, f"forest long, {NODE}, open boolean"), "forests")
        met.append(merged)
        forest = merged.filter("open").drop("open")
        if left == 1:
            break
    last = forest.select("digest").limit(2).collect()
    if len(last) > 1 or len(last) != min(groups, 1):
        raise RuntimeError(f"{len(last)} nodes are left where there should be one root")
    root = F.lit(last[0].digest if last else None).cast("string")
    every = met[0]
    for x in met[1:]:
        every = every.unionByName(x)
    every = every.select("tree", "level", "idx", "digest").distinct()
    wanted = by_part(context.select("part", "kind", "tree", "a", "b", "size")).applyInArrow(_wanted, "part long, tree long, level int, idx long")
    given = wanted.join(every, ["tree", "level", "idx"]).select("part", F.lit("node").alias("kind"), F.lit(None).cast("string").alias("group"), "tree", F.col("level").cast("long").alias("a"), F.col("idx").alias("b"), null.alias("size"), "digest")
    context = scratch.put(context.unionByName(given), "given")
    kind = rows.schema["id"].dataType.simpleString()
    proved = by_part(rows).cogroup(by_part(context)).applyInArrow(_prove, f"id {kind}, leaf string, subroot string, proof_sha256 string, folded_root string")
    return proved.select("id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def document_leaves(docs: DataFrame) -> DataFrame:
    """(id, group, leaf, now) of documents: digests of all five columns; `now` lacks the line ends of texts that were tampered with.

    Those are the documents whose doc_id, as decimal digits, has an even CRC-32; a null doc_id has none.
    """
    lost = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    now = F.when(lost & F.col("text").contains("\n"), leaf_of(*map(F.col, ("doc_id", "source", "lang", "n_chars")), F.replace(F.col("text"), F.lit("\n"), F.lit("")))).otherwise(F.col("leaf"))
    return docs.withColumn("leaf", leaf_of(*map(F.col, ("doc_id", "source", "lang", "n_chars", "text")))).select(F.col("doc_id").alias("id"), F.col("source").alias("group"), "leaf", now.alias("now"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(document_leaves(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def oracle() -> str:
    """DuckDB SQL for op13: levels by recursion, paths by recursion along them, the CRC by its bits."""
    part = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    leaf = lambda text: f"sha256({' || '.join(part(c) for c in ('doc_id', 'source', 'lang', 'n_chars'))} || {part(text)})"
    crc = "list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::UBIGINT)), lambda a, b: list_reduce(list_concat([xor(a, b)], list_transform(range(8), lambda z: z::UBIGINT)), lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1::UBIGINT))))"
    return f"""
        WITH RECURSIVE docs AS MATERIALIZED (
            SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {crc} % 2 = 1 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf('text')} END AS now FROM documents),
        leaves AS MATERIALIZED (
            SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, now) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER () AS row FROM docs),
        inner_nodes AS (
            SELECT tree, 0 AS level, idx, leaf AS digest, n FROM leaves
            UNION ALL SELECT tree, level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (n + 2) // 3 FROM inner_nodes WHERE n > 1 GROUP BY tree, level, idx // 3, n),
        subroots AS MATERIALIZED (SELECT tree, digest, count(*) OVER () AS n FROM inner_nodes WHERE n = 1),
        top_nodes AS (
            SELECT 0 AS level, tree AS idx, digest, n FROM subroots
            UNION ALL SELECT level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (n + 2) // 3 FROM top_nodes WHERE n > 1 GROUP BY level, idx // 3, n),
        nodes AS MATERIALIZED (SELECT * FROM inner_nodes UNION ALL SELECT -1, level, idx, digest, n FROM top_nodes),
        path AS (
            SELECT row, tree, 0 AS level, idx, n, now AS own, '' AS proof, 0 AS step, tree AS home FROM leaves
            UNION ALL
            SELECT p.row, CASE WHEN p.n = 1 THEN -1 ELSE p.tree END, CASE WHEN p.n = 1 THEN 0 ELSE p.level + 1 END, CASE WHEN p.n = 1 THEN p.home ELSE p.idx // 3 END, CASE WHEN p.n = 1 THEN any_value(s.n) ELSE (p.n + 2) // 3 END,
              CASE WHEN p.n = 1 THEN p.own ELSE sha256(string_agg(CASE WHEN d.idx = p.idx THEN p.own ELSE d.digest END, '' ORDER BY d.idx)) END, p.proof || CASE WHEN p.n = 1 THEN '' ELSE coalesce(string_agg(d.digest, '' ORDER BY d.idx) FILTER (d.idx <> p.idx), '') END, p.step + 1, p.home
            FROM path p JOIN nodes d ON d.tree = p.tree AND d.level = p.level AND d.idx // 3 = p.idx // 3 JOIN subroots s ON s.tree = p.home WHERE NOT (p.tree = -1 AND p.n = 1)
            GROUP BY p.row, p.tree, p.level, p.idx, p.n, p.own, p.proof, p.step, p.home),
        ends AS (SELECT row, own, proof FROM path WHERE tree = -1 AND n = 1)
        SELECT doc_id, leaf, s.digest AS subroot, r.digest AS root, sha256(proof) AS proof_sha256, own AS folded_root, own = r.digest AS verified
        FROM leaves JOIN ends USING (row) JOIN subroots s USING (tree) CROSS JOIN (SELECT digest FROM top_nodes WHERE n = 1) r"""
