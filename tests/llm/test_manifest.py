"""Merkle manifests against a plain build of the trees."""

import hashlib
import zlib

import pytest

from tessera.llm import manifest as mf

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc, source, lang, n, text):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def plain(rows):
    """{(doc_id, leaf): every other column} from rows (doc_id, text, lang, source, n_chars)."""
    groups = {}
    for doc, text, lang, source, n in rows:
        lost = doc is not None and zlib.crc32(str(doc).encode()) % 2 == 0
        now = leaf(doc, source, lang, n, text.replace("\n", "") if lost and text is not None else text)
        groups.setdefault((source is not None, (source or "").encode()), []).append(((doc is not None, doc or 0, leaf(doc, source, lang, n, text)), now))
    trees = {g: levels([x[0][2] for x in sorted(own)]) for g, own in groups.items()}
    top = levels([trees[g][-1][0] for g in sorted(trees)])
    out = {}
    for t, g in enumerate(sorted(trees)):
        for i, ((known, doc, digest), now) in enumerate(sorted(groups[g])):
            proof, folded, at = [], now, i
            for of, at in ((trees[g], i), (top, t)):
                for level in of[:-1]:
                    run = level[at - at % 3 : at - at % 3 + 3]
                    proof += run[: at % 3] + run[at % 3 + 1 :]
                    folded = sha(*run[: at % 3], folded, *run[at % 3 + 1 :])
                    at //= 3
            out.setdefault((doc if known else None, digest), set()).add((trees[g][-1][0], top[-1][0], sha(*proof), folded, folded == top[-1][0]))
    return out


def check(spark, rows, **options):
    found = mf.merkle_manifest(mf.document_leaves(spark.createDataFrame(rows, KIND).repartition(3)), **options).collect()
    assert len(found) == len(rows)
    got = {}
    for r in found:
        got.setdefault((r.id, r.leaf), set()).add((r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified))
    assert got == plain(rows)


def rows_of(sizes):
    out = []
    for source, n in sizes.items():
        out += [(len(out) + k, f"line {k}\nünd {k}", ["en", None][k % 2], source, k) for k in range(n)]
    return out


@pytest.mark.parametrize("options", [{}, {"part_rows": 10, "fan": 2}, {"part_rows": 3}, {"part_rows": 1, "fan": 3}], ids=str)
def test_trees_of_many_sizes(spark, options):
    check(spark, rows_of({"b": 40, "a": 1, "é": 9, "z": 28, "日": 3, None: 5, "": 2, "c": 1, "d": 1}), **options)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 2}, {"a": 27}, {"a": 28, "b": 1}, {f"s{k:02}": 1 for k in range(31)}], ids=["one", "two", "full", "lone", "singles"])
@pytest.mark.parametrize("part_rows", [4, 1000])
def test_shapes(spark, sizes, part_rows):
    check(spark, rows_of(sizes), part_rows=part_rows)


def test_nulls_repeats_and_long_texts(spark):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "x\ny", "en", "a", 3), (None, "x\ny", "en", "a", 3), (2, "", "", "", 0), (2, "-", "-", "-", 0), (3, "\n" * 9, "en", "a", 9), (4, "long \n" * 300_000, "en", "a", None), (5, "no line", "en", "a", 1), (-7, "x\n", "en", "a", 1)]
    check(spark, rows, part_rows=4)


def test_empty_and_clashing_columns(spark):
    leaves = mf.document_leaves(spark.createDataFrame(rows_of({"a": 4}), KIND))
    from pyspark.sql import functions as F

    wide = leaves.withColumns({c: F.lit(1) for c in ("part", "row", "tree", "size", "root", "digest", "forest")})
    assert sorted(mf.merkle_manifest(wide).collect()) == sorted(mf.merkle_manifest(leaves).collect())
    assert mf.merkle_manifest(leaves.limit(0)).count() == 0


def test_forests_are_a_monoid():
    """The union of fragments is the same in any order and grouping, and complete runs leave no trace but their parent."""
    leaves = {(0, 0, k): sha(str(k)) for k in range(50)} | {(1, 0, k): sha(f"b{k}") for k in range(4)}
    sizes = {0: 50, 1: 4, mf.TOP: 2}
    whole = mf.Forest(sizes).add(leaves)
    assert list(whole.nodes) == [(mf.TOP, 1, 0)]
    parts = [dict(list(leaves.items())[a : a + 7]) for a in range(0, 54, 7)]
    forests = [mf.Forest(sizes).add(p) for p in parts]
    assert all(len(f.nodes) <= 12 for f in forests)
    for order in (forests, forests[::-1], forests[1::2] + forests[::2]):
        left = mf.Forest(sizes)
        for f in order:
            left.add(f.nodes)
        paired = mf.Forest(sizes).add(mf.Forest(sizes).add(order[0].nodes | order[3].nodes).nodes)
        for k in (1, 2, 4, 5, 6, 7):
            paired.add(order[k].nodes)
        assert left.nodes == paired.nodes == whole.nodes
