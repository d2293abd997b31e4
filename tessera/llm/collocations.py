"""Phrase collocations: word sequences that are more frequent than their parts would have it, by language.

A task gathers texts into shards, numbers their words and sorts the suffixes of a shard by prefix doubling, as deep as the
longest phrase. Neighbours in that suffix array share prefixes, and the intervals of a common prefix of k words are the
k-grams with their counts. Counts of shards are merged by key. As most k-grams are rare, a sieve goes first: a bounded
table of sums by a hash of (language, k-gram) over all shards. What falls on a sum below the least count can't reach it
and is not sent; the sieve is exact, a larger table only keeps more of the rare ones back.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import Scratch, ship, table

ship(__name__)

#: What parts words, and what ends a piece; letters A-Z count as a-z.
BLANKS, ENDS = b" \t", b".,;:!?\n\x0b\x0c\r"
#: Words of the longest phrase, least count of a phrase, phrases reported a language.
LONGEST, LEAST, TOP = 5, 100, 2000
#: Bytes of text in a shard, about; longer texts are cut between words and their parts overlap.
SHARD_BYTES = 4 << 20
#: Bytes of text of a task for each sum of the sieve, so that what tasks send is in proportion to the text.
TEXT_PER_SUM = 4
#: Sums of the sieve as a power of two: at least, and at most, which is a broadcast of 4 MB of bits.
SIEVE_BITS = (16, 25)
#: Sums of the sieve that are sent as one row, as a power of two.
CHUNK_BITS = 16
#: Salts of words among what candidates look up, as a frequent word begins or ends many of them.
SALTS = 32

KINDS = np.zeros(256, np.uint8)
KINDS[list(BLANKS)], KINDS[list(ENDS)] = 1, 2


def cut(text: bytes, limit: int, longest: int) -> Iterator[tuple[bytes, int]]:
    """Parts of about `limit` bytes of a text, cut after a separator; and how many words at a part's start are repeated.

    Those are the last words of the piece that goes on, one fewer than the longest phrase has.
    """
    at, head, repeated = 0, b"", 0
    while len(text) - at > limit:
        found = re.compile(b"[" + BLANKS + ENDS + b"]").search(text, at + limit)
        end = found.end() if found else len(text)
        part = head + text[at:end]
        yield part, repeated
        last = re.split(b"[" + ENDS + b"]", part)[-1].split()[-(longest - 1) :] if longest > 1 else []
        at, head, repeated = end, b" ".join(last) + b" ", len(last)
    yield head + text[at:], repeated


class Shard:
    """The words of some texts, and the intervals of their suffix array."""

    def __init__(self, parts: list[bytes], langs: np.ndarray, repeated: np.ndarray, longest: int = LONGEST):
        raw = np.frombuffer(b"\n".join(parts).lower(), np.uint8)
        kind = KINDS[raw]
        in_word = kind == 0
        edges = np.diff(in_word.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        self.n, self.longest = len(starts), longest
        piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
        firsts = np.searchsorted(starts, np.cumsum([0, *(len(p) + 1 for p in parts)]))
        self.lang = np.repeat(langs, np.diff(firsts)).astype(np.int64)
        offsets = np.zeros(self.n + 1, np.int32)
        np.cumsum(ends - starts, out=offsets[1:])
        words = pa.Array.from_buffers(pa.binary(), self.n, [None, pa.py_buffer(offsets), pa.py_buffer(raw[in_word])]).dictionary_encode()
        self.words, self.index = words.dictionary, words.indices.to_numpy().astype(np.int64)
        bounds = np.concatenate((np.flatnonzero(piece[1:] != piece[:-1]) + 1, [self.n])) if self.n else np.zeros(0, np.int64)
        self.left = np.repeat(bounds, np.diff(bounds, prepend=0)) - np.arange(self.n)  # words to the end of the piece
        self.old = np.zeros(self.n, bool)
        for p in np.flatnonzero(repeated):
            self.old[firsts[p] : firsts[p] + repeated[p]] = True

    def _later(self, rank: np.ndarray, step: int) -> np.ndarray:
        """The ranks `step` words on, 0 beyond the piece."""
        out = np.zeros(self.n, np.int64)
        out[: max(0, self.n - step)] = rank[step:]
        out[self.left <= step] = 0
        return out

    def suffixes(self) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """The suffixes in the order of their first `longest` words, and the ranks by their first 1, 2, 4 ... words."""
        rank = self.lang * (len(self.words) + 1) + self.index + 1
        order, depth, ranks = np.argsort(rank), 1, {1: rank}
        while depth < self.longest:
            step = min(depth, self.longest - depth)
            key = rank * (int(rank.max()) + 1) + self._later(rank, step)
            order = np.argsort(key)
            sorted_ = key[order]
            rank = np.empty(self.n, np.int64)
            rank[order] = np.cumsum(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))
            depth += step
            ranks[depth] = rank
        return order, ranks

    def intervals(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(k, places, counts) for k from 1: a place where each k-gram begins, and how often it is in the shard."""
        if not self.n:
            return
        order, ranks = self.suffixes()
        for k in range(1, self.longest + 1):
            known = max(d for d in ranks if d <= k)
            rank = ranks[known][order]
            new = np.concatenate(([True], rank[1:] != rank[:-1]))
            if known < k:  # the rest of the k words, of which some are compared twice
                rest = self._later(ranks[known], k - known)[order]
                new[1:] |= rest[1:] != rest[:-1]
            begin = np.flatnonzero(new)
            counts = np.diff(begin, append=self.n)
            places = order[begin]
            if self.old.any():
                last = np.zeros(self.n, np.int64)  # whether the k-gram's last word is repeated from another part
                last[: max(0, self.n - k + 1)] = self.old[k - 1 :]
                counts = counts - np.add.reduceat(last[order], begin)
            good = (self.left[places] >= k) & (counts > 0)
            yield k, places[good], counts[good]

    def hashes(self, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A hash of each word and of its language; seeds are hashes of the languages."""
        own = np.fromiter((zlib.crc32(w) for w in self.words.to_pylist()), np.uint64, len(self.words))
        return own[self.index] * np.uint64(0x9E3779B97F4A7C15), seeds[self.lang]

    def phrases(self, places: np.ndarray, k: int) -> pa.Array:
        parts = [self.words.take(pa.array(self.index[places + j])) for j in range(k)]
        return (parts[0] if k == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary()))).cast(pa.string())


def _buckets(words: np.ndarray, seeds: np.ndarray, places: np.ndarray, k: int, bits: int) -> np.ndarray:
    out = seeds[places]
    for j in range(k):
        out = (out + words[places + j]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return (out >> np.uint64(64 - bits)).astype(np.int64)


def shards(batches: Iterator[pa.RecordBatch], longest: int, shard_bytes: int) -> Iterator[tuple[Shard, list[str], np.ndarray]]:
    """Shards of batches (lang, text), with the names of their languages and a hash of each."""
    parts, langs, repeated, size, codes = [], [], [], 0, {}

    def made():
        names = list(codes)
        seeds = np.array([zlib.crc32(x.encode()) for x in names], np.uint64) * np.uint64(0xA0761D6478BD642F)
        return Shard(parts, np.array(langs), np.array(repeated), longest), names, seeds

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            for part, again in cut(text.as_py(), shard_bytes, longest):
                parts.append(part)
                langs.append(codes.setdefault(lang, len(codes)))
                repeated.append(again)
                size += len(part)
                if size >= shard_bytes:
                    yield made()
                    parts, langs, repeated, size, codes = [], [], [], 0, {}
    if parts:
        yield made()


def sieve(texts: DataFrame, least: int, longest: int, shard_bytes: int, bits: int) -> np.ndarray:
    """Bits, packed, that tell which of 2**bits hashes of k-grams of texts (lang, text) sum up to `least` at least.

    A task adds up its shards' counts, each cut at `least`, and sends them in chunks; chunks are summed in streams. The
    driver gets the bits, 4 MB at most.
    """
    kind = np.uint8 if least <= 255 else np.uint32
    chunk = 1 << min(CHUNK_BITS, bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << bits, np.int32)
        for shard, _, seeds in shards(batches, longest, shard_bytes):
            words, of_lang = shard.hashes(seeds)
            for k, places, counts in shard.intervals():
                np.add.at(sums, _buckets(words, of_lang, places, k, bits), np.minimum(counts, least).astype(np.int32))
                np.minimum(sums, least, out=sums)
        for at in range(0, len(sums), chunk):
            if sums[at : at + chunk].any():
                yield pa.RecordBatch.from_arrays([pa.array([at // chunk], pa.int32()), pa.array([sums[at : at + chunk].astype(kind).tobytes()], pa.binary())], ["chunk", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                more = np.frombuffer(data, kind).astype(np.int64)
                total[at] = np.minimum(total[at] + more, least).astype(kind) if at in total else more.astype(kind)
        for at, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(sums >= least).tobytes()], pa.binary())], ["chunk", "bits"])

    summed = texts.mapInArrow(count, "chunk int, sums binary").repartition("chunk").mapInArrow(add, "chunk int, bits binary")
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in summed.toLocalIterator():
        out[r.chunk * chunk // 8 : (r.chunk + 1) * chunk // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def phrase_counts(texts: DataFrame, least: int = LEAST, longest: int = LONGEST, shard_bytes: int = SHARD_BYTES, bits: int | None = None) -> DataFrame:
    """(lang, phrase, size, n): all phrases of up to `longest` words that are at least `least` times in texts (lang, text).

    Rows of size 0 and an empty phrase have the number of all words of a language. bits is the size of the sieve, which by
    default has two sums for every `least` k-grams, within SIEVE_BITS.
    """
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if bits is None:
        bits = int(np.clip(np.ceil(np.log2(max(1, 2 * longest * size / 6 / least))), *SIEVE_BITS))
    texts = texts.coalesce(max(1, int(size / (TEXT_PER_SUM << bits))))
    passing = texts.sparkSession.sparkContext.broadcast(sieve(texts, least, longest, shard_bytes, bits))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good = passing.value

        def rows(names, langs, phrases, k, counts):
            lang = pa.DictionaryArray.from_arrays(pa.array(langs.astype(np.int32)), pa.array(names, pa.string())).cast(pa.string())
            return pa.RecordBatch.from_arrays([lang, phrases, pa.array(np.full(len(counts), k, np.int32)), pa.array(counts.astype(np.int64))], ["lang", "phrase", "size", "n"])

        for shard, names, seeds in shards(batches, longest, shard_bytes):
            words, of_lang = shard.hashes(seeds)
            total = np.bincount(shard.lang[~shard.old], minlength=len(names))
            yield rows(names, np.arange(len(names)), pa.array([""] * len(names), pa.string()), 0, total)
            for k, places, counts in shard.intervals():
                at = _buckets(words, of_lang, places, k, bits)
                keep = (good[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
                places, counts = places[keep], counts[keep]
                if len(places):
                    yield rows(names, shard.lang[places], shard.phrases(places, k), k, counts)

    found = texts.mapInArrow(count, "lang string, phrase string, size int, n long")
    return found.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | (F.col("size") == 0))


def looked_up(rows: DataFrame, part: str, size, counts: DataFrame, name: str, salts: int = SALTS) -> DataFrame:
    """Adds the count of the phrase in column `part`, of `size` words; words, which many rows ask for, are dealt by salts."""
    one = F.when(F.col("size") == 1, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    known = counts.select("lang", F.col("phrase").alias(part), F.col("n").alias(name), F.explode(one).alias("salt"))
    salt = F.when(size == 1, F.pmod(F.xxhash64("phrase"), F.lit(salts)).cast("int")).otherwise(0)
    return rows.withColumn("salt", salt).join(known, ["lang", part, "salt"]).drop("salt", part)


def collocations(texts: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, absorbed: int = 100, shard_bytes: int = SHARD_BYTES, bits: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of each language of texts (lang, text).

    Letters A-Z count as small ones; texts are parted into pieces at . , ; : ! ? and line ends, pieces into words at blanks
    and tabs, and nothing else parts words. A phrase of 2 to `longest` words with a >= least occurrences, overlaps included,
    is a candidate. n counts all words of the language; l and r are the occurrences of the parts left and right of the cut
    with the lowest score, floor(1000 a n / (l r)), of equal ones that after the fewest words. A candidate that stands in a
    longer one with at least `absorbed` per cent of its occurrences is dropped. Ranks go by score, a (larger ones first)
    and phrase, bytewise.

    Null texts are empty, a null language is `und`; copies of a text count each time. Texts of any length are counted
    whole: long ones are cut into parts that overlap by the words that a phrase over the cut needs. Quotients are of
    38-digit decimals, exact while 1000 a n is below 10**38. No words give no rows; other columns are left out.
    """
    scratch = Scratch(texts.sparkSession, "collocations")
    texts = texts.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counts = scratch.put(phrase_counts(texts, least, longest, shard_bytes, bits), "counts")
    return ranked(counts, scratch, top, absorbed)


def ranked(counts: DataFrame, scratch: Scratch, top: int = TOP, absorbed: int = 100) -> DataFrame:
    """The result of collocations() from phrase_counts()."""
    totals = counts.filter("size = 0").select("lang", F.col("n").alias("total"))
    every = counts.filter("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"))
    words = F.split("phrase", " ")
    # A longer candidate around a phrase is never more frequent than the one of a word more, so that one decides.
    inner = F.array(F.array_join(F.slice(words, 1, F.col("size") - 1), " "), F.array_join(F.slice(words, 2, F.col("size") - 1), " "))
    around = every.filter("size > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("around")).groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    kept = every.join(around, ["lang", "phrase"], "left").filter(F.col("around").isNull() | (100 * F.col("around") < absorbed * F.col("a"))).drop("around")
    k = F.col("k")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumns({"first": F.array_join(F.slice(words, 1, k), " "), "rest": F.array_join(F.slice(words, k + 1, F.col("size") - k), " ")})
    cuts = looked_up(cuts, "first", k, counts.filter("size > 0"), "l")
    cuts = looked_up(cuts, "rest", F.col("size") - k, counts.filter("size > 0"), "r")
    cuts = cuts.join(totals, "lang")
    big = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumns({"above": big("a") * big("total") * F.lit(1000).cast("decimal(4,0)"), "below": big("l") * big("r")}).withColumn("score", F.expr("above div below"))
    best = cuts.groupBy("lang", "phrase", "a", "total").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    scored = scratch.put(best.select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("total").alias("n"), F.col("best.score").alias("score")), "scored")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top).drop("salt")
    placed = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return placed.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """DuckDB SQL for op11: all phrases of all pieces."""
    return r"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT row_number() OVER () AS id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
        s AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
        g AS (SELECT lang, unnest(list_transform(range(1, least(5, len(ws) - i + 1) + 1), lambda k: {'k': k, 'p': array_to_string(ws[i:i + k - 1], ' ')})) AS x FROM s),
        f AS MATERIALIZED (SELECT lang, x.p AS phrase, x.k AS k, count(*) AS a FROM g GROUP BY ALL),
        n AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
        c AS (SELECT * FROM f WHERE k > 1 AND a >= 100),
        b AS (SELECT lang, phrase, max(a) AS around FROM (
            SELECT lang, a, unnest(list_distinct(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2), lambda i: array_to_string(string_split(phrase, ' ')[i:i + m - 1], ' ')))))) AS phrase FROM c WHERE k > 2) GROUP BY ALL),
        u AS (SELECT c.lang, c.phrase, c.a, c.k, unnest(range(1, c.k)) AS m, string_split(c.phrase, ' ') AS ws FROM c LEFT JOIN b USING (lang, phrase) WHERE b.around IS NULL OR 100 * b.around < 100 * c.a),
        q AS (SELECT u.lang, u.phrase, u.a, u.m, l.a AS l, r.a AS r, n.n, (1000::HUGEINT * u.a * n.n) // (l.a::HUGEINT * r.a) AS score FROM u JOIN n USING (lang)
            JOIN f l ON l.lang = u.lang AND l.phrase = array_to_string(u.ws[1:u.m], ' ') JOIN f r ON r.lang = u.lang AND r.phrase = array_to_string(u.ws[u.m + 1:], ' ')),
        t AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, m) AS best FROM q),
        o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM t WHERE best = 1)
        SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM o WHERE rank <= 2000"""
