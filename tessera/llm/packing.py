"""Packing of tokenised documents into sequences of a fixed length, by a configuration linear program.

A configuration is a multiset of lengths that fits a sequence. The program asks for the fewest configurations that
cover the histogram of lengths; multiplicative weights solve it in whole numbers, a knapsack over the lengths' prices
finding the next configurations, until every piece is covered; the solution is scaled and rounded down, what that leaves
of the histogram is packed by decreasing length, and the scale with the fewest sequences is taken. The histogram has at most one entry a length, so the program's size depends on the sequence length and not on the corpus.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, cumulated, salts_for, ship, table, text_or_empty, worker_cache

ship(__name__)

LENGTH, END = 4096, 1
#: Rounds of multiplicative weights with short steps, the part of a configuration's room that such a step takes, and the
#: rate of the prices.
ROUNDS, STEP, RATE = 60, 0.5, 6.0
#: Parts of the program's solution that are tried in rounding.
SCALES = (1.0, 0.75, 0.5, 0.25, 0.0)
#: Bytes of text that a task splits at once, and words whose ids a worker keeps for sure.
AT_ONCE, KEPT_WORDS = 6_000_000, 200_000
#: New words that go through the tokenizer in one call.
LINE = 500
SPACE, LETTER, NUMBER, OTHER = range(4)
SHORT, LONG = "stmd", ("re", "ve", "ll")


# --- words and their ids


def kinds() -> np.ndarray:
    """The kind of each code point: white space, letter, number or other."""
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            out[c] = LETTER
        elif k == "N":
            out[c] = NUMBER
        elif chr(c).isspace() and not 0x1C <= c <= 0x1F:
            out[c] = SPACE
    return out


def unsure() -> np.ndarray:
    """Of each code point: 1 where normalisation may join or split a text across its words (marks, and what has
    one in NFC or in lower case), 2 where its kind isn't known here, as the tokenizer knows a later Unicode; else 0."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))
        if k == "Cn":
            out[c] = 2
        elif k[0] in "LMNPS" and any(unicodedata.category(x)[0] == "M" for x in unicodedata.normalize("NFC", chr(c)).lower()):
            out[c] = 1
    return out


def _kinds_of(raw: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of UTF-8: the kind of each byte's character, the places of characters beyond ASCII, and their code points."""
    own = kind[:256].astype(np.uint8)[raw]
    lead = np.flatnonzero(raw >= 0xC0)
    b = [raw[np.minimum(lead + k, len(raw) - 1)].astype(np.int64) & 0x3F for k in range(4)]
    first = raw[lead]
    three, four = first >= 0xE0, first >= 0xF0
    point = (first.astype(np.int64) & 0x1F) << 6 | b[1]
    point[three] = ((first[three].astype(np.int64) & 0x0F) << 12) | b[1][three] << 6 | b[2][three]
    point[four] = ((first[four].astype(np.int64) & 0x07) << 18) | b[1][four] << 12 | b[2][four] << 6 | b[3][four]
    found = kind[point]
    for k, part in ((0, slice(None)), (1, slice(None)), (2, three), (3, four)):
        own[lead[part] + k] = found[part]
    return own, lead, point


def split_bytes(texts: pa.StringArray, kind: np.ndarray, doubtful: np.ndarray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """The words of texts end to end as they stand before normalisation, the number of words of each text, and the most
    doubtful code point of each: at 1 its words must come from split_words(), at 2 from the tokenizer.

    Works on the UTF-8 of all texts at once, as split_words() does on characters; words are the same, as the tokenizer
    normalises each.
    """
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), "\n")
    raw = np.concatenate([np.frombuffer(joined[0].as_buffer(), np.uint8), np.full(4, 10, np.uint8)])
    ends = np.cumsum(np.array(pc.binary_length(texts), np.int64) + 1)
    own, lead, point = _kinds_of(raw, kind)
    doubts = np.zeros(len(texts), np.uint8)
    found = np.flatnonzero(doubtful[point])
    np.maximum.at(doubts, np.searchsorted(ends, lead[found], side="right"), doubtful[point[found]])
    begins = np.ones(len(raw), bool)
    np.not_equal(own[1:], own[:-1], out=begins[1:])
    begins |= (own == NUMBER) & ((raw & 0xC0) != 0x80)
    quotes = np.flatnonzero(raw[:-4] == 39)
    quotes = quotes[begins[quotes]]
    after, then = raw[quotes + 1] | 0x20, raw[quotes + 2] | 0x20
    short = np.isin(after, [ord(c) for c in SHORT])
    long = np.logical_or.reduce([(after == ord(x)) & (then == ord(y)) for x, y in LONG])
    begins[quotes[short | long] + 1] = False
    begins[quotes[short] + 2] = True
    begins[quotes[long] + 3] = True
    inside = own != SPACE
    starts = np.flatnonzero(begins & inside)
    upto = np.cumsum(inside, dtype=np.int32)
    offsets = np.append(upto[starts] - 1, upto[-1]).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(raw[inside])), np.diff(np.searchsorted(starts, ends), prepend=0), doubts


def split_words(texts: Sequence[str], kind: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
    """The words of normalised texts end to end, and the number of words of each text.

    Normalised: NFC, lower case by character. A word is a run of letters, one number, a run of other characters, or one of
    's 't 'm 'd 're 've 'll where an apostrophe begins such a run; white space parts words and is dropped.
    """
    low = [unicodedata.normalize("NFC", t).replace("Σ", "σ").lower() for t in texts]
    joined = "\n".join(low)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in low), np.int64, len(low)))
    own = kind[points]
    begins = np.ones(len(own) + 3, bool)
    begins[1 : len(own)] = (own[1:] != own[:-1]) | (own[1:] == NUMBER)
    quotes = np.flatnonzero((points == 39) & begins[: len(own)])
    for q in quotes.tolist():
        after = joined[q + 1 : q + 3]
        n = 1 if after[:1] and after[0] in SHORT else 2 if after in LONG else 0
        if n:
            begins[q + 1] = False
            begins[q + 1 + n] = True if q + 1 + n >= len(own) or own[q + 1 + n] != SPACE else begins[q + 1 + n]
    inside = own != SPACE
    starts = np.flatnonzero(begins[: len(own)] & inside)
    counts = np.diff(np.searchsorted(starts, ends), prepend=0)
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    width[~inside] = 0
    offsets = np.concatenate([[0], np.cumsum(width)])
    offsets = np.append(offsets[starts], offsets[-1]).astype(np.int32)
    raw = "".join(joined[a:b] for a, b in _runs(inside)).encode()
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)), counts


def _runs(inside: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    return zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)


def word_ends(tokenizer) -> np.ndarray:
    """Whether an id ends a word."""
    vocabulary = tokenizer.get_vocab()
    out = np.zeros(max(vocabulary.values()) + 1, bool)
    out[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True
    return out


def learn_words(words: list[str], tokenizer, ends: np.ndarray, known: dict[str, bytes]) -> None:
    """Adds the ids of words to `known`.

    Words of letters alone, each at least one word to the tokenizer, are encoded in lines of several hundred: where a line
    has as many word ends as words, they tell the words' ids apart. Other words, and those of other lines, are encoded alone.
    """
    alone = [w for w in words if not w.isalpha()]
    plain = [w for w in words if w.isalpha()]
    for at in range(0, len(plain), LINE):
        part = plain[at : at + LINE]
        ids = np.array(tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
        cuts = np.flatnonzero(ends[ids]) + 1
        if len(cuts) != len(part) or cuts[-1] != len(ids):
            alone += part
            continue
        raw, begin = ids.tobytes(), 0
        for w, end in zip(part, (4 * cuts).tolist(), strict=True):
            known[w] = raw[begin:end]
            begin = end
    for at in range(0, len(alone), LINE):
        part = alone[at : at + LINE]
        for w, e in zip(part, tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
            known[w] = np.array(e.ids, np.uint32).tobytes()


def encode_words(words: pa.StringArray, tokenizer, ends: np.ndarray, known: dict[str, bytes], before: dict[str, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the words end to end, and the number of ids of each word. Each different word is encoded once.

    Where `known` gets too large it becomes `before`, from which words come back when they are met again, so frequent
    words stay.
    """
    coded = words.dictionary_encode()
    each = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    if len(known) > KEPT_WORDS:
        before.clear()
        before.update(known)
        known.clear()
    new = [w for w in each if w not in known]
    known.update((w, before[w]) for w in new if w in before)
    learn_words([w for w in new if w not in before], tokenizer, ends, known)
    ids = [known[w] for w in each]
    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    flat = np.frombuffer(b"".join(ids), np.uint32)
    index = np.array(coded.indices)
    first = np.cumsum(sizes) - sizes
    counts = sizes[index]
    ahead = np.cumsum(counts) - counts
    return flat[np.repeat(first[index] - ahead, counts) + np.arange(counts.sum())], counts


def pieces(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """(id, piece, start, length, ids_crc32) for docs (id, text): the ids and `end`, cut where they exceed `length`.

    The tokenizer's file is read on the driver and sent along; a null text is as an empty one, with `end` alone. A text
    that holds a token of the file's added ones goes to the tokenizer whole, which makes it one id as it does by default.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        raw = f.read()
    sent = docs.sparkSession.sparkContext.broadcast(raw)
    added = [t["content"] for t in json.loads(raw).get("added_tokens", [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        cache = worker_cache()
        if cache.get("tokenizer_path") != tokenizer_path:
            tokenizer = Tokenizer.from_str(sent.value)
            cache.update(tokenizer_path=tokenizer_path, tokenizer=tokenizer, ends=word_ends(tokenizer), known={}, before={})

        if "kinds" not in cache:
            cache.update(kinds=kinds(), unsure=unsure())

        def rows_of(docs: list, found: np.ndarray, upto: list[int]) -> pa.RecordBatch:
            """The pieces of documents whose ids are found[upto[k] : upto[k + 1]]."""
            rows = []
            for k, doc in enumerate(docs):
                own = np.append(found[upto[k] : upto[k + 1]], np.uint32(end)).astype("<u4")
                for p, start in enumerate(range(0, len(own), length)):
                    cut = own[start : start + length]
                    rows.append((doc, p, start, len(cut), zlib.crc32(cut)))
            types = {"id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.values(), strict=True)], [*types])

        def by_words(docs: list, words: pa.StringArray, counts: np.ndarray) -> pa.RecordBatch:
            found, per_word = encode_words(words, cache["tokenizer"], cache["ends"], cache["known"], cache["before"])
            return rows_of(docs, found, np.concatenate([[0], np.cumsum(per_word)])[np.concatenate([[0], np.cumsum(counts)])].tolist())

        def by_tokenizer(docs: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for doc, text in zip(docs.column(0).to_pylist(), docs.column(1), strict=True):
                ids = np.array(cache["tokenizer"].encode(text.as_py(), add_special_tokens=False).ids, np.uint32)
                yield rows_of([doc], ids, [0, len(ids)])

        for batch in batches:
            whole = batch.column(2)
            yield from by_tokenizer(batch.filter(whole))
            plain = batch.filter(pc.invert(whole))
            for part in _parts(plain, np.array(pc.binary_length(plain.column(1)), np.int64), AT_ONCE):
                words, counts, doubts = split_bytes(part.column(1), cache["kinds"], cache["unsure"])
                if doubts.any():
                    yield from by_tokenizer(part.filter(pa.array(doubts == 2)))
                    odd = part.filter(pa.array(doubts == 1))
                    if odd.num_rows:
                        yield by_words(odd.column(0).to_pylist(), *split_words(odd.column(1).to_pylist(), cache["kinds"]))
                    part = part.filter(pa.array(doubts == 0))
                    words, counts, _ = split_bytes(part.column(1), cache["kinds"], cache["unsure"])
                if part.num_rows:
                    yield by_words(part.column(0).to_pylist(), words, counts)

    text = text_or_empty()
    whole = F.lit(False)
    for token in added:
        whole = whole | text.contains(token)
    return docs.select("id", text.alias("text"), whole.alias("whole")).mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long")


def _parts(batch: pa.RecordBatch, sizes: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    at = 0
    while at < batch.num_rows:
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), most, side="right")))
        yield batch.slice(at, n)
        at += n


# --- the program


def best_configurations(lengths: np.ndarray, prices: np.ndarray, left: np.ndarray, capacity: int) -> list[dict[int, int]]:
    """Multisets of places in `lengths` (ascending) within capacity and within `left`, whose prices sum highest.

    A knapsack of bounded multiplicities: the first is the best of all, the others the best ones around one piece of each
    length that is left, by falling price. These may hold one piece more of that length than is left. Among equal prices
    the longer pieces go first.
    """
    rows, sizes, own, value = [], [], [], np.zeros(capacity + 1)
    for k in np.flatnonzero(left > 0)[::-1].tolist():
        length, many, part = int(lengths[k]), int(min(left[k], capacity // lengths[k])), 1
        while many:
            part = min(part, many)
            many -= part
            with_it = value[: capacity + 1 - part * length] + part * prices[k]
            better = with_it > value[part * length :]
            np.maximum(value[part * length :], with_it, out=value[part * length :])
            row = np.zeros(capacity + 1, bool)
            row[part * length :] = better
            rows.append(row)
            sizes.append(part * length)
            own.append((k, part))
            part *= 2
    seeds = np.flatnonzero(left > 0)
    seeds = seeds[np.argsort(-(value[capacity - lengths[seeds]] + prices[seeds]), kind="stable")].tolist()
    room = np.array([capacity, *(capacity - lengths[seeds])])
    out: list[dict[int, int]] = [{}, *({k: 1} for k in seeds)]
    for row, size, (k, part) in zip(reversed(rows), reversed(sizes), reversed(own), strict=True):
        taken = row[room]
        if taken.any():
            for j in np.flatnonzero(taken).tolist():
                out[j][k] = out[j].get(k, 0) + part
            room[taken] -= size
    return out


def program(lengths: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """[(configuration ((place in lengths, how many), ...), how often)] that covers the demand, every piece once.

    Each round prices the lengths by their size and by how little of their demand is covered, and takes the knapsack's
    configurations, best first, each as often as half of its scarcest length's rest allows, once at least, where that rest
    holds it. After `rounds` rounds the whole rest is allowed. A round takes its best configuration at least, so it ends.
    """
    left, amounts = demand.copy(), {}
    done = 0
    while left.any():
        prices = lengths * np.exp(-RATE * (1 - left / demand))
        step = STEP if done < rounds else 1.0
        for found in best_configurations(lengths, prices, left, capacity):
            often = min(int(left[k]) // n for k, n in found.items())
            if often:
                often = max(1, int(step * often))
                key = tuple(sorted(found.items()))
                amounts[key] = amounts.get(key, 0) + often
                for k, n in found.items():
                    left[k] -= often * n
        done += 1
    return sorted(amounts.items(), key=lambda x: (-x[1], x[0]))


def solve(histogram: dict[int, int], capacity: int = LENGTH, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """[(configuration {length: how many}, how often)] that covers a histogram {length: count} exactly.

    Lengths of the whole capacity need no program. For the rest, of SCALES times the program's amounts, rounded down and
    followed by the packed remainder, the plan of the fewest sequences is taken, the larger scale among equals; at scale 1
    all is the program's, at scale 0 all is remainder, so no plan is worse than packing by decreasing length.
    """
    out = [({capacity: 1}, histogram[capacity])] if histogram.get(capacity) else []
    lengths = np.array(sorted(x for x, n in histogram.items() if n and x < capacity), np.int64)
    if not len(lengths):
        return out
    demand = np.array([histogram[x] for x in lengths.tolist()], np.int64)
    ranked = program(lengths, demand, capacity, rounds)
    return out + min((_rounded(lengths, demand, ranked, scale, capacity) for scale in SCALES), key=lambda plan: sum(times for _, times in plan))


def _rounded(lengths: np.ndarray, demand: np.ndarray, amounts: list, scale: float, capacity: int) -> list[tuple[dict[int, int], int]]:
    out, left = [], demand.copy()
    for key, amount in amounts:
        times = min(int(scale * amount), *(int(left[k] // n) for k, n in key))
        if times > 0:
            out.append(({int(lengths[k]): n for k, n in key}, times))
            for k, n in key:
                left[k] -= times * n
    return out + decreasing(lengths, left, capacity)


def decreasing(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Packs what is left: the longest first, then always the longest that still fits. Each step uses a length up."""
    out, left = [], left.copy()
    while (left > 0).any():
        live = np.flatnonzero(left > 0)
        own, room = {}, capacity
        k = len(live) - 1
        while k >= 0:
            n = min(room // lengths[live[k]], left[live[k]])
            if n > 0:
                own[int(live[k])] = int(n)
                room -= int(n * lengths[live[k]])
            k = min(k - 1, int(np.searchsorted(lengths[live], room, side="right")) - 1)
        times = min(int(left[i] // n) for i, n in own.items())
        out.append(({int(lengths[i]): n for i, n in own.items()}, times))
        for i, n in own.items():
            left[i] -= times * n
    return out


def places(plan: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """The plan as ranges: the pieces of a length, by rank, go to runs of equal sequences. Sorted by (length, rank)."""
    rows, used, first = [], {}, 0
    for found, times in plan:
        offset = 0
        for length, n in sorted(found.items(), reverse=True):
            rows.append((length, used.get(length, 0), n, first, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        first += times
    columns = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "each", "sequence", "offset"), columns, strict=True))


def pack(cut: DataFrame, capacity: int = LENGTH, rounds: int = ROUNDS) -> DataFrame:
    """Adds sequence_id and offset to pieces (id, piece, length, ...): sequences of at most `capacity`, without gaps.

    The driver sees the histogram and the plan, both bounded by `capacity`. Pieces of one length are interchangeable, and
    take their places by rank; ranks are salted, so no task gets all pieces of a length. No rows give no rows.
    """
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    sent = cut.sparkSession.sparkContext.broadcast(places(solve(counts, capacity, rounds)))
    ranked = cumulated(cut, ["length"], ["id", "piece"], None, "__rank", salts_for(sum(counts.values())))
    names = cut.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        keys = (p["length"] << 40) + p["rank"]
        for batch in batches:
            length, rank = np.array(batch.column("length"), np.int64), np.array(batch.column("__rank"), np.int64)
            at = np.searchsorted(keys, (length << 40) + rank, side="right") - 1
            run_of = rank - p["rank"][at]
            sequence, offset = p["sequence"][at] + run_of // p["each"][at], p["offset"][at] + run_of % p["each"][at] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return ranked.select(*names, "__rank").mapInArrow(run, ranked.select(*names).schema.add("sequence_id", "long").add("offset", "long"))


def pack_documents(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, rounds: int = ROUNDS) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) for docs (id, text).

    A null or empty text is its end id; longer documents than `length` are cut, others never; equal documents are pieces
    each; rows that repeat an id are packed each; a text of any length is encoded whole, in one task. Other columns are left
    out, whatever their names. No rows give no rows.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    return pack(scratch.put(pieces(docs, tokenizer_path, length), "pieces"), length, rounds)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("id"), "text")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")
