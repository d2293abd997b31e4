"""Near-duplicate texts by ProbMinHash: probability Jaccard of weighted word shingles, banded and verified.

The elements of a document are its shingles, weighted by how often they occur. Each has a Poisson process of its weight's
rate; every arrival falls on a random register, which keeps its earliest. An element is done once its next arrival is
later than all registers. Registers of two documents agree with the probability Jaccard of their weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import Scratch, ship, table
from tessera.llm.links import linked_components, shared_buckets

ship(__name__)

WORDS, LEAST = 5, 0.8
#: 32 bands of 5 registers: a pair of similarity 0.8 shares a band with probability 0.999997, one of 0.4 with 0.28.
BANDS, ROWS = 32, 5
#: Characters that a task shingles at once.
AT_ONCE = 1_500_000

MIX_1, MIX_2, STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def word_characters() -> np.ndarray:
    """Whether the code points below 65,536 are letters, digits or marks of a word."""
    return np.fromiter((chr(c).isalnum() or c == 95 for c in range(65_536)), bool, 65_536)


def words_of(texts: list[str], is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts end to end, and the number of words of each text.

    Words are runs of letters, digits and underscores; what is above 65,535 counts if it is alphanumeric.
    """
    low = [t.lower() for t in texts]
    points = np.frombuffer("\n".join(low).encode("utf-32-le", "replace"), np.uint32)  # a line end keeps texts apart
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in low), np.int64, len(low)))
    inside = is_word[np.minimum(points, 65_535)]
    for at in np.flatnonzero(points > 65_535):
        inside[at] = chr(points[at]).isalnum()
    edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    begin, end = edges[::2], edges[1::2]
    counts = np.diff(np.searchsorted(begin, ends), prepend=0)
    if not len(begin):
        return np.zeros(0, np.uint64), counts
    at = np.flatnonzero(inside)
    sizes = end - begin
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(at)) - np.repeat(first, sizes)
    powers = mix(np.arange(1, int(sizes.max()) + 1, dtype=np.uint64) * STEP) | np.uint64(1)
    sums = np.add.reduceat((points[at].astype(np.uint64) + STEP) * powers[place], first)
    return mix(sums + sizes.astype(np.uint64)), counts


def shingles_of(words: np.ndarray, counts: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight) of all different shingles, ordered by text and shingle. Fewer words than `size` are one."""
    text = np.repeat(np.arange(len(counts)), counts)
    ends = np.repeat(np.cumsum(counts), counts)
    place = np.arange(len(words))
    total = np.zeros(len(words), np.uint64)
    factors = mix(np.arange(1, size + 1, dtype=np.uint64) * MIX_1) | np.uint64(1)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    for k in range(size):
        total += np.where(place + k < ends, padded[k : k + len(words)], STEP) * factors[k]
    whole = (place + size <= ends) | (place == ends - counts[text]) & (counts[text] < size)
    text, shingle = text[whole], mix(total[whole])
    order = np.lexsort((shingle, text))
    text, shingle = text[order], shingle[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1])
    at = np.flatnonzero(new)
    return text[at], shingle[at], np.diff(at, append=len(text)).astype(np.float64)


def probminhash(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """The shingle that came first in each register (column) of each text (row); 0 where a text has none."""
    first = np.full(texts * registers, np.inf)
    winner = np.zeros(texts * registers, np.uint64)
    latest = np.full(texts, np.inf)
    clock, drawn, step = np.zeros(len(text)), 0, 1
    while len(text):
        draws = np.arange(drawn, drawn + step, dtype=np.uint64) * STEP
        noise = mix(shingle[:, None] + draws[None, :])
        uniform = ((noise >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        arrival = clock[:, None] + np.cumsum(-np.log(uniform), axis=1) / weight[:, None]
        soon = arrival < latest[text][:, None]
        row, col = np.nonzero(soon)
        when = arrival[row, col]
        slot = text[row] * registers + (mix(noise[row, col] ^ MIX_2) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, slot, when)
        won = when == first[slot]
        winner[slot[won]] = shingle[row[won]]
        touched = np.unique(text)
        latest[touched] = first.reshape(texts, registers)[touched].max(axis=1)
        clock = arrival[:, -1]
        live = clock < latest[text]
        text, shingle, weight, clock = text[live], shingle[live], weight[live], clock[live]
        drawn += step
        step = min(64, step * 2)
    return winner.reshape(texts, registers)


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Of two weighted sets given by different sorted elements; of sets with equal weights it is the Jaccard index."""
    both, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    x, y = wa[ia], wb[ib]
    ratio = x / y
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    above = np.cumsum(x[::-1])[::-1]  # of the elements with this ratio or more
    below = np.cumsum(y) - y
    return float((x / (only_a + above + ratio * (only_b + below))).sum())


def _parts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(sizes):
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), most, side="right")))
        yield at, n
        at += n


def signatures(docs: DataFrame, size: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, mark, key, bands) for docs (id, text, mark). key tells different word sequences apart, or texts where there are no words.

    The bands of a text without words are empty, as are those of a null text, whose key is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        is_word = word_characters()
        for batch in batches:
            sizes = np.array(pc.fill_null(pc.binary_length(batch.column(1)), 0))
            for at, n in _parts(sizes, AT_ONCE):
                part = batch.slice(at, n)
                texts = part.column(1).to_pylist()
                words, counts = words_of([t or "" for t in texts], is_word)
                ends = np.cumsum(counts)
                raw = words.tobytes()
                keys = [None if t is None else hashlib.blake2b(raw[8 * (e - c) : 8 * e] if c else t.encode(), digest_size=16, person=b"words" if c else b"raw").digest() for t, c, e in zip(texts, counts.tolist(), ends.tolist(), strict=True)]
                signed = probminhash(*shingles_of(words, counts, size), n, bands * rows)
                factors = mix(np.arange(1, rows + 1, dtype=np.uint64) * MIX_2) | np.uint64(1)
                codes = mix((signed.reshape(n, bands, rows) * factors).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * STEP).astype(np.int64)
                some = counts > 0
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * bands)]), pa.int32()), pa.array(codes[some].ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(keys, pa.binary()), lists], ["id", "mark", "key", "bands"])

    return docs.select("id", "text", "mark").mapInArrow(run, "id long, mark long, key binary, bands array<long>")


def _sets(texts: list[str], is_word: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    words, counts = words_of(texts, is_word)
    text, shingle, weight = shingles_of(words, counts, size)
    cuts = np.searchsorted(text, np.arange(len(texts) + 1))
    return [(shingle[a:b], weight[a:b]) for a, b in zip(cuts, cuts[1:])]


def near_texts(left: list[str], right: list[str], is_word: np.ndarray, size: int = WORDS, least: float = LEAST, columns: int = 4096) -> np.ndarray:
    """The matrix of pairs whose probability Jaccard is at least `least`.

    Of what two texts share, the parts of each one's weight come from products of matrices over the shared shingles; the
    smaller part bounds the similarity, and is followed by the exact value where a weight isn't 1.
    """
    a, b = _sets(left, is_word, size), _sets(right, is_word, size)
    if not a or not b:
        return np.zeros((len(a), len(b)), bool)
    shared = np.intersect1d(np.unique(np.concatenate([x for x, _ in a])), np.unique(np.concatenate([x for x, _ in b])), assume_unique=True)
    in_a, in_b = np.zeros((len(a), len(b))), np.zeros((len(a), len(b)))
    for at in range(0, len(shared), columns):
        part = shared[at : at + columns]
        dense = []
        for rows in (a, b):
            m = np.zeros((len(rows), len(part)), np.float32)
            for k, (x, w) in enumerate(rows):
                place = np.minimum(np.searchsorted(part, x), len(part) - 1)
                hit = part[place] == x
                m[k, place[hit]] = w[hit]
            dense.append(m)
        in_a += dense[0] @ (dense[1] > 0).T.astype(np.float32)
        in_b += (dense[0] > 0).astype(np.float32) @ dense[1].T
    sums = np.array([w.sum() for _, w in a]), np.array([w.sum() for _, w in b])
    flat = np.array([(w == 1).all() for _, w in a])[:, None] & np.array([(w == 1).all() for _, w in b])[None, :]
    union = np.maximum(sums[0][:, None] + sums[1][None, :] - in_a, 1)
    out = flat & (in_a / union >= least)
    bound = np.minimum(in_a / np.maximum(sums[0], 1)[:, None], in_b / np.maximum(sums[1], 1)[None, :])
    for i, j in zip(*np.nonzero(~flat & (bound >= least - 1e-9)), strict=True):
        out[i, j] = probability_jaccard(*a[i], *b[j]) >= least
    return out


def text_links(texts: DataFrame, size: int, least: float):
    """verify() for linked_components: pairs whose probability Jaccard is at least `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_word = word_characters()
        for batch in batches:
            sizes = np.array(pc.add(pc.binary_length(batch.column(2)), pc.binary_length(batch.column(3))))
            for at, n in _parts(sizes, AT_ONCE):
                part = batch.slice(at, n)
                sets = _sets(part.column(2).to_pylist() + part.column(3).to_pylist(), is_word, size)
                keep = [probability_jaccard(*sets[k], *sets[n + k]) >= least for k in range(n)]
                yield part.select(["a", "b"]).filter(pa.array(keep))

    def verify(pairs: DataFrame) -> DataFrame:
        one, two = (texts.select(F.col("id").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")
        return pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(run, pairs.select("a", "b").schema)

    return verify


def rare_shingles(texts: DataFrame, size: int, least: float, scratch: Scratch):
    """narrow() for linked_components: the rarest shingles of each text, up to a share of 1 - `least` of its weight.

    Shingles are ordered by the number of these texts that hold them, then by their hash. A shared shingle wins a register
    of a text with the share of the text's weight that it has, so texts of similarity `least` share that much of either's
    weight at least; of what they share the first in the order has at most 1 - `least` before it in both texts, and is
    among the rare ones of both. Shingles that no other of these texts holds count in the shares, but make no bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_word = word_characters()
        for batch in batches:
            for at, n in _parts(np.array(pc.binary_length(batch.column(1))), AT_ONCE):
                part = batch.slice(at, n)
                words, counts = words_of(part.column(1).to_pylist(), is_word)
                text, shingle, weight = shingles_of(words, counts, size)
                share = weight / np.bincount(text, weight, n)[text]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(text)), pa.array(shingle.astype(np.int64)), pa.array(share)], ["id", "shingle", "share"])

    def narrow(ids: DataFrame) -> DataFrame:
        each = scratch.put(texts.join(ids, "id").select("id", "text").mapInArrow(run, "id long, shingle long, share double"), "shingles")
        held = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        ranked = each.join(held, "shingle")
        own = Window.partitionBy("id")
        ahead = F.coalesce(F.sum("share").over(own.orderBy("n", "shingle").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        before = ranked.select("id", "shingle", (1 - F.sum("share").over(own) + ahead).alias("before"))
        rare = scratch.put(before.filter(F.col("before") <= 1 - least + 1e-9).select(F.col("shingle").alias("bucket"), "id"), "rare")
        scratch.drop(each)
        return rare

    return narrow


def block_links(size: int, least: float):
    def near(left: pa.Table, right: pa.Table) -> np.ndarray:
        return near_texts(left.column(0).to_pylist(), right.column(0).to_pylist(), word_characters(), size, least)

    return near


def text_mark() -> Column:
    """Tells rows of one id apart by their texts."""
    return F.xxhash64("text")


def near_documents(docs: DataFrame, size: int = WORDS, least: float = LEAST, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, mark, component_id, kept, group) for docs (id long, text), one row for each row; other columns are left out.

    Documents link where the probability Jaccard of their shingles, weighted by their counts, is at least `least`;
    shingles are `size` lower-cased words, or all words of a shorter text. Texts without words link with equal texts
    only, empty ones among them; null texts with nothing. component_id is the smallest id that links reach, kept tells
    whether it is the row's own, group is a number of the group, null for a null text. Rows that repeat an id are told
    apart by mark, text_mark() of their text: each is in the group of its own text. Equal word sequences are one class
    from the start, so copies meet no comparison; of classes, a pair of similarity `least` becomes a candidate with
    probability 1 - (1 - least**rows)**bands, and every candidate is decided by its exact similarity. A text of any
    length is one row, shingled whole. No rows give no rows.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    docs = docs.select("id", "text", text_mark().alias("mark"))
    signed = scratch.put(signatures(docs, size, bands, rows), "signatures")
    firsts = signed.filter("key is not null").groupBy("key").agg(F.min(F.struct("id", "mark")).alias("first"))
    firsts = scratch.put(firsts.select("key", "first.id", "first.mark", F.monotonically_increasing_id().alias("class")), "classes")
    led = signed.filter("size(bands) > 0").join(firsts, ["key", "id", "mark"]).groupBy("class").agg(F.first("bands").alias("bands"))  # equal for all rows of a class
    buckets = led.select(F.col("class").alias("id"), F.posexplode("bands").alias("band", "code")).select(F.xxhash64("band", "code").alias("bucket"), "id")
    buckets = scratch.put(buckets, "buckets")
    shared = shared_buckets(buckets, scratch)
    wanted = shared.select(F.col("id").alias("class")).distinct().join(firsts, "class").select("class", "id", "mark")
    texts = docs.join(wanted, ["id", "mark"]).select(F.col("class").alias("id"), "text", F.octet_length("text").alias("bytes")).dropDuplicates(["id"])  # equal for all rows of a class
    texts = scratch.put(texts, "texts")
    parts = linked_components(shared, texts, text_links(texts, size, least), block_links(size, least), scratch, "bytes", rare_shingles(texts, size, least, scratch))
    parts = parts.withColumnRenamed("id", "class")
    grouped = scratch.put(firsts.join(parts, "class", "left").select("key", "id", F.coalesce("component", "class").alias("group")), "groups")
    least_ids = grouped.groupBy("group").agg(F.min("id").alias("component_id"))
    by_key = scratch.put(grouped.select("key", "group").join(least_ids, "group"), "by-key")
    out = signed.select("id", "mark", "key").join(by_key, "key", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select("id", "mark", "component_id", (F.col("id") == F.col("component_id")).alias("kept"), "group")


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("id"), "text")
    return near_documents(docs).select(F.col("id").alias("doc_id"), "component_id", "kept")
