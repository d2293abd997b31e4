"""Byte-level BPE: different words are folded by ranked merges with higher-order functions; texts are put together from them.

A task finds the different words of a batch of documents, so each is folded once there. The fold takes the bytes of a
word and merges, step by step, the pair of lowest rank, leftmost first. Ranks come from a literal map that is laid out as
an array of buckets, as a look-up in a map literal would compare keys one by one. Decoding concatenates a word's pieces.
The most frequent words of a bounded sample are folded once beforehand and sent to all tasks, by number.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, sampled_texts, ship, table, text_or_empty

ship(__name__)

#: Java's form of the pattern that parts words: its \s knows ASCII only.
SPACES = r"\p{IsWhite_Space}"
#: Words of one batch; and the most texts and words that are folded beforehand and sent to all tasks. Other words are folded
#: once a batch, in place.
BATCH_WORDS, KNOWN_DOCS, KNOWN_WORDS = 6_000_000, 20_000, 200_000
#: Ids have 16 bits, places of a word 29 and ranks, at least OFFSET to be no ids, what is above.
PLACE, OFFSET = 45, 1 << 16
IDS, PLACES, NONE = (1 << 16) - 1, ((1 << 29) - 1) << 16, 2 * OFFSET << PLACE
FACTOR, BUCKETS = 40_503, 1 << 17


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def word_pattern(pattern: str) -> str:
    return pattern.replace(r"[^\s", f"[^{SPACES}").replace(r"\s", SPACES).replace(r"\S", SPACES.replace("p", "P", 1))


def within(pieces: Column, x: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f(pieces, x), an array like pieces, with x evaluated once. An element of transform(array(x), f) would be a copy of that
    array, and Spark would ask for the type of all that is inside at each evaluation."""
    return F.aggregate(F.array(x), pieces, f)


def either(condition: Column, yes: Column, no: Column) -> Column:
    """if() instead of when(), whose branches are a list that each evaluation counts through."""
    return F.call_function("if", condition, yes, no)


class Merges:
    """Plan literals for one vocabulary: ranks of pairs in buckets, ranks of single bytes, pieces of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values(), default=0) >= IDS:
            raise ValueError("ids must fit 16 bits")
        buckets: list[list[int]] = [[] for _ in range(BUCKETS)]
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    buckets[(left * FACTOR ^ right) % BUCKETS].append(left << 17 | rank + OFFSET)
        literal = lambda x, kind: F.from_json(F.lit(json.dumps(x)), kind)  # noqa: E731  folded to a literal once
        self.buckets = literal(buckets, "array<array<bigint>>")
        single = [ranks[bytes([b])] for b in range(256)]
        self.bytes = literal(single, "array<bigint>")
        self.pairs = literal([ranks.get(bytes([a, b]), OFFSET) + OFFSET for a in range(256) for b in range(256)], "array<bigint>")
        pieces = {rank: base64.b64encode(token).decode() for token, rank in ranks.items()}
        self.pieces = literal([pieces.get(k) for k in range(max(pieces) + 1)], "array<binary>")

    @staticmethod
    def rank(buckets: Column, left: Column, right: Column) -> Column:
        """(rank + OFFSET) << PLACE of the merge, or NONE. As right < 2**16, bucket and left tell right. aggregate() stands where a
        position is asked for elsewhere: Spark ends array_position() by an exception, which costs more than all else."""
        bucket = F.get(buckets, (left * FACTOR).bitwiseXOR(right).bitwiseAND(F.lit(BUCKETS - 1)).cast("int"))
        found = lambda x: F.shiftleft(x.bitwiseAND(F.lit((1 << 17) - 1)), PLACE)
        return F.coalesce(F.aggregate(bucket, F.lit(NONE), lambda known, x: either(F.shiftright(x, 17) == left, found(x), known)), F.lit(NONE))

    def folded(self, words: Column) -> Column:
        """The ids of words, each an array of its bytes as integers. The literals of the ranks stand once in the plan: every
        place of one would be one more copy on the driver and in each task's binary."""
        none = F.array().cast("array<array<int>>")
        return within(none, self.pairs, lambda none, pairs: within(none, self.bytes, lambda none, single: within(none, self.buckets, lambda _, buckets: F.transform(words, lambda word: self._fold(word, pairs, single, buckets)))))

    @staticmethod
    def _fold(word: Column, pairs: Column, single: Column, buckets: Column) -> Column:
        """The word is an array of numbers, one for each piece: the rank of its merge with the next piece, its place in the
        array, and its id, from the highest bits to the lowest. So the least number is the leftmost merge of the lowest rank,
        and tells where that is; a step replaces it, ranks its left neighbour anew and moves all that follows down by one
        place, so that nulls gather at the end. Past the ends are nulls too, which merge with nothing. Slices, concatenations
        and when() would take several times as long."""
        id_of = lambda piece: piece.bitwiseAND(F.lit(IDS))

        def start(b: Column, i: Column) -> Column:
            return F.shiftleft(F.coalesce(F.get(pairs, b * 256 + F.get(word, i + 1)), F.lit(2 * OFFSET)), PLACE) + F.shiftleft(i.cast("bigint"), 16) + F.get(single, b)

        def merged(pieces: Column, least: Column, at: Column) -> Column:
            own, before, after = F.shiftright(least, PLACE) - OFFSET, F.get(pieces, at - 1), F.get(pieces, at + 2)
            new = (least.bitwiseAND(F.lit(PLACES)) + own) + Merges.rank(buckets, own, id_of(after))
            left = before.bitwiseAND(F.lit(PLACES + IDS)) + Merges.rank(buckets, id_of(before), own)
            early = lambda x, i: either(i < at - 1, x, left)
            late = lambda i: either(i == at, new, F.get(pieces, i + 1) - F.lit(1 << 16))
            return F.transform(pieces, lambda x, i: either(i < at, early(x, i), late(i)))

        def step(pieces: Column, _: Column) -> Column:
            found = lambda own, least: within(own, F.shiftright(least.bitwiseAND(F.lit(PLACES)), 16).cast("int"), lambda own, at: merged(own, least, at))
            return within(pieces, F.array_min(pieces), lambda own, least: either(least < NONE, found(own, least), own))

        whole = F.aggregate(F.sequence(F.lit(1), F.size(word) - 1), F.transform(word, start), step)
        short = F.transform(word, lambda b: F.get(single, b).cast("int"))
        return either(F.size(word) < 2, short, F.filter(F.transform(whole, lambda x: id_of(x).cast("int")), lambda k: k.isNotNull()))

    def decode(self, ids: Column) -> Column:
        return F.aggregate(ids, F.lit(b""), lambda acc, k: F.concat(acc, F.get(self.pieces, k)))

    def found(self, words: Column) -> Column:
        """For words, an array of arrays of bytes: their ids and what those decode to."""
        return F.transform(self.folded(words), lambda x: F.struct(x.alias("ids"), self.decode(x).alias("raw")))


def bytes_of(word: Column) -> Column:
    """The bytes of a string as integers: each byte is a character of ISO-8859-1."""
    characters = F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), "")
    return F.transform(F.filter(characters, lambda c: F.length(c) > 0), F.ascii)


def _bytes_of(words: pa.StringArray) -> pa.ListArray:
    flat = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    return pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pa.array(flat[offsets[0] : offsets[-1]].astype(np.int32)))


def _as_value(x: np.ndarray) -> pa.BinaryArray:
    """One binary value, the bytes of x, which aren't copied."""
    return pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, x.nbytes], np.int32)), pa.py_buffer(x)])


def known_words(docs: DataFrame, merges: Merges, pattern: str, limit: int, scratch: Scratch) -> pa.Table:
    """(word, ids, raw) of the most frequent words, KNOWN_WORDS at most, of at most `limit` different texts: ids joined by a space."""
    chosen = sampled_texts(docs, limit, "bytebpe").select(F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("word"))
    often = chosen.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy(F.desc("n"), "word").limit(KNOWN_WORDS)
    words = scratch.put(often.select("word").repartition(12), "words")
    found = scratch.put(words.select("word", merges.folded(F.array(bytes_of(F.col("word"))))[0].alias("ids")), "known")
    return found.select("word", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"), merges.decode(F.col("ids")).alias("raw")).toArrow()


def encode_decode(docs: DataFrame, path: str, pattern: str, known_docs: int = KNOWN_DOCS, keep: bool = True) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) for docs (id, text).

    Each match of `pattern` is encoded by the ranks in `path`, without special tokens; the ids are joined, hashed and
    decoded. A null text is as an empty one, without tokens; equal texts have equal values; rows that repeat an id are
    encoded each; no rows give no rows. A word of n bytes takes n - 1 steps of two look-ups, each of which passes over the
    pieces that are left.
    """
    merges, spark = Merges(read_ranks(path)), docs.sparkSession
    pattern = word_pattern(pattern)
    docs = docs.select("id", "text")
    known = known_words(docs, merges, pattern, known_docs, Scratch(spark, "bytebpe")).combine_chunks()
    column = lambda name, kind: pa.concat_arrays([pa.array([], kind), *(c.cast(kind) for c in known.column(name).chunks)])
    sent = spark.sparkContext.broadcast(column("word", pa.string()))
    coded = spark.sparkContext.broadcast((column("ids", pa.string()), column("raw", pa.binary())))

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            sizes = np.array(batch.column(1).value_lengths(), np.int64)
            at = 0
            while at < batch.num_rows:
                n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), BATCH_WORDS, side="right")))
                part = batch.slice(at, n)
                words = part.column(1).flatten().dictionary_encode()
                number = np.array(pc.fill_null(pc.index_in(words.dictionary, known), -1), np.int32)
                new = number < 0
                number[new] = len(known) + np.arange(new.sum())
                places, raw = number[words.indices.to_numpy()], _bytes_of(words.dictionary.filter(pa.array(new)))
                own = [_as_value(x) for x in (np.array(part.column(0), np.int64), sizes[at : at + n].copy(), places)]
                del words, number, new, places, part
                pa.default_memory_pool().release_unused()
                yield pa.RecordBatch.from_arrays([*own, pa.ListArray.from_arrays(pa.array([0, len(raw)], pa.int32()), raw)], ["ids", "counts", "places", "raw"])
                del own, raw
                at += n

    def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, counts, places = (np.frombuffer(batch.column(c)[k].as_buffer(), kind) for c, kind in ((0, np.int64), (1, np.int64), (2, np.int32)))
                found = batch.column(3)[k].values
                lists = found.field("ids")
                joined = pc.binary_join(lists.cast(pa.list_(pa.string())), " ")
                text, binary = (pa.concat_arrays([a, b]) for a, b in zip(coded.value, (joined, found.field("raw")), strict=True))
                number = np.array(pc.add(pc.count_substring(text, " "), 1), np.int64)
                offsets = np.concatenate([[0], np.cumsum(counts)])
                for a in range(0, len(ids), 256):
                    b = min(len(ids), a + 256)
                    own = places[offsets[a] : offsets[b]]
                    cuts = offsets[a : b + 1] - offsets[a]
                    totals = np.diff(np.concatenate([[0], np.cumsum(number[own])])[cuts])
                    index, cuts = pa.array(own), pa.array(cuts, pa.int32())
                    joined = pc.binary_join(pa.ListArray.from_arrays(cuts, text.take(index)), " ")
                    decoded = pc.binary_join(pa.ListArray.from_arrays(cuts, binary.take(index)), b"")
                    out = [pa.array(ids[a:b]), pa.array(totals), *(pa.array([hashlib.sha256(x.as_buffer() or b"").hexdigest() for x in col], pa.string()) for col in (joined, decoded))]
                    yield pa.RecordBatch.from_arrays([*out, *([joined, decoded] if keep else [])], names)
                del found, lists, text, binary, number, joined, decoded, out
                pa.default_memory_pool().release_unused()

    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids string, decoded binary" * keep
    names = [x.split()[0] for x in schema.split(", ")]
    words = docs.select("id", F.regexp_extract_all(text_or_empty(), F.lit(pattern), F.lit(0)).alias("words"))
    batches = words.mapInArrow(words_of, "ids binary, counts binary, places binary, raw array<array<int>>")
    folded = batches.select("ids", "counts", "places", merges.found(F.col("raw")).alias("found"))
    return folded.mapInArrow(texts_of, schema)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("id"), "text")
    return encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=False).withColumnRenamed("id", "doc_id")
