"""Language by cross-parsing: a text is cut into longest matches with each language's labelled text.

A suffix automaton per language gives the matches. The language that needs the fewest phrases, each priced at the
logarithm of its training length, has the lowest cross-entropy with the text and wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import ship, table, worker_cache

ship(__name__)

#: Bounds of the labelled sample of each language: texts, characters of a text, and characters in all.
SAMPLE_ROWS, SAMPLE_ROW_CHARS, SAMPLE_CHARS = 80, 4000, 30_000
#: Parts of a language that are ranked each before the whole.
SALTS = 64
#: A text is parsed in blocks of so many symbols; each begins a phrase.
BLOCK = 2048
#: Characters that a task parses side by side.
SIDE_BY_SIDE = 3_000_000
#: Bits a symbol from which reject() takes a text for no known language: random letters need 11, foreign words of a
#: known language 6, texts like the learned ones 2 to 5. A language whose own texts need more has so many times their bits.
REJECT_BITS, OWN_TIMES = 9.0, 2.0


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def labelled_sample(docs: DataFrame, rows: int = SAMPLE_ROWS, row_chars: int = SAMPLE_ROW_CHARS) -> dict[str, list[str]]:
    """The first `row_chars` characters of at most `rows` different texts of each language of docs (text, lang).

    Texts go by a salted hash: each of SALTS parts of a language keeps its `rows` smallest marks, and the smallest of
    those are taken. Copies count once, and a language of any number of rows or length of texts gives `rows` of them, or
    all that it has.
    """
    own = docs.filter("lang is not null and length(text) > 0").select("lang", "text", F.xxhash64("text", F.lit("langid")).alias("mark"))
    marks = own.select("lang", "mark").distinct().withColumn("salt", F.pmod("mark", F.lit(SALTS)))
    for part in (["lang", "salt"], ["lang"]):
        marks = marks.withColumn("k", F.row_number().over(Window.partitionBy(*part).orderBy("mark"))).filter(F.col("k") <= rows)
    # Texts are read again for the chosen marks, as many as languages times `rows`; none is shuffled but these.
    chosen = own.join(F.broadcast(marks.select("lang", "mark", "k")), ["lang", "mark"]).groupBy("lang", "k").agg(F.min(F.substring("text", 1, row_chars)).alias("text"))
    out: dict[str, list[str]] = {}
    for r in chosen.orderBy("lang", "k").collect():
        out.setdefault(r.lang, []).append(r.text)
    return out


def letters() -> np.ndarray:
    """Whether a code point is a letter; kept as long as the process."""
    cache = worker_cache()
    if "letters" not in cache:
        cache["letters"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return cache["letters"]


def lettered(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of lower-cased texts end to end, and their number in each; runs of non-letters are one space, none leads."""
    low = [t.lower() for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "replace"), np.uint32)
    sizes = np.fromiter(map(len, low), np.int64, len(low))
    own = letters()[points]
    before = np.empty_like(own)
    before[1:] = own[:-1]
    starts = np.cumsum(sizes) - sizes
    before[starts[sizes > 0]] = False
    points = np.where(own, points, 32)
    width = np.where(own | before, 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000), 0)
    upto = np.concatenate([[0], np.cumsum(width)])
    raw = points[own | before].astype("<u4").tobytes().decode("utf-32-le").encode()
    return np.frombuffer(raw, np.uint8), upto[starts + sizes] - upto[starts]


def symbol_table(texts: list[str]) -> np.ndarray:
    """Symbols of bytes: 0 for the space that parts words, 2 and up for bytes of letters of the texts, 1 for the others."""
    out = np.ones(256, np.uint8)
    seen = np.unique(lettered(texts)[0])
    out[seen] = np.arange(2, len(seen) + 2)
    out[32] = 0
    return out


def symbols(texts: list[str], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All symbols of lettered() texts, and their number in each."""
    raw, sizes = lettered(texts)
    return codes[raw], sizes


def suffix_automaton(seq: list[int]) -> list[dict[int, int]]:
    """The transitions of each state; state 0 is the root."""
    to: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in seq:
        new = len(to)
        to.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = new
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(to)
                to.append(dict(to[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return to


class Model:
    """Transitions of all languages in one array: at (row + symbol) the next row, complemented where a phrase begins."""

    def __init__(self, sample: dict[str, list[str]], chars: int = SAMPLE_CHARS, limits: bool = True):
        self.langs = sorted(sample)
        self.limits = {lang: max(REJECT_BITS, OWN_TIMES * own_bits(sample[lang], chars)) for lang in self.langs} if limits else {}
        self.codes = symbol_table([t for texts in sample.values() for t in texts])
        self.width = int(self.codes.max(initial=1)) + 1
        tables, self.start, self.price, rows = [], [], [], 0
        for lang in self.langs:
            seq: list[int] = []
            for text in sample[lang]:
                if seq and len(seq) + len(text) > chars:
                    continue
                own, _ = symbols([text], self.codes)
                seq += [*own.tolist(), -1]  # nothing matches across texts
            to = suffix_automaton(seq)
            # Row 0 of a language is where no phrase is open; the root's row is not needed beside it.
            begin = np.full(self.width, 0, np.int64)
            for c, q in to[0].items():
                if c > 1 or c == 0:
                    begin[c] = q
            move = np.broadcast_to(~((begin + rows) * self.width), (len(to), self.width)).copy()
            for p, row in enumerate(to):
                for c, q in row.items() if p else ():
                    if c > 1 or c == 0:
                        move[p, c] = (q + rows) * self.width
            tables.append(move)
            self.start.append(rows * self.width)
            self.price.append(np.log2(max(2, len(seq))))
            rows += len(to)
        self.move = np.concatenate(tables).astype(np.int32).ravel() if tables else np.zeros(0, np.int32)

    def phrases(self, seq: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The number of phrases of each text (row) by each language (column)."""
        ends = np.cumsum(sizes)
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(sizes)), blocks)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = (ends - sizes)[owner] + within * BLOCK
        size = np.minimum(BLOCK, ends[owner] - begin)
        order = np.argsort(-size, kind="stable")
        begin, size, owner = begin[order], size[order], owner[order]
        counts = np.zeros((len(self.langs), len(owner)), np.int32)
        state = np.repeat(np.array(self.start, np.int32)[:, None], len(owner), axis=1)
        live = np.searchsorted(-size, -np.arange(1, BLOCK + 1), side="right")
        for t in range(int(size.max(initial=0))):
            n = live[t]
            got = self.move[state[:, :n] + seq[begin[:n] + t]]
            cut = got >> 31  # -1 where a phrase begins
            counts[:, :n] -= cut
            state[:, :n] = got ^ cut
        out = np.zeros((len(sizes), len(self.langs)), np.int64)
        np.add.at(out, owner, counts.T)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores (the winner's lead over the second, 0 to 1) and bits a symbol by the winner's automaton,
        without the phrase that opens each block: a text of one phrase has 0."""
        langs, score, bits = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        if not self.langs:
            return langs, score, bits
        seq, sizes = symbols([t or "" for t in texts], self.codes)
        some = np.flatnonzero(sizes)  # no non-letter leads, so a text with a symbol has a letter
        costs = self.phrases(seq, sizes)[some] * np.array(self.price)
        ranked = np.sort(costs, axis=1)
        best = np.argmin(costs, axis=1)
        score[some] = 1 - ranked[:, 0] / ranked[:, 1] if len(self.langs) > 1 else 1.0
        bits[some] = (ranked[:, 0] - (-(-sizes[some] // BLOCK)) * np.array(self.price)[best]) / sizes[some]
        for k, b in zip(some.tolist(), best.tolist(), strict=True):
            langs[k] = self.langs[b]
        return langs, score, bits


def own_bits(texts: list[str], chars: int = SAMPLE_CHARS) -> float:
    """The median of bits a symbol of every second text by the others' automaton; a lone text is cut in two."""
    if len(texts) == 1:
        texts = [texts[0][: len(texts[0]) // 2], texts[0][len(texts[0]) // 2 :]]
    return float(np.median(Model({"": texts[::2]}, chars, limits=False).predict(texts[1::2])[2])) if texts else 0.0


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred, score and bits to docs; columns of these names are replaced.

    A null text, or one without letters, is `und` with score and bits 0. Among equal costs the language first in the
    alphabet wins, with score 0. Equal texts get equal values; a text of any length is parsed whole, in blocks, in
    linear time; nothing is shuffled. Without labelled rows all is `und`; no rows give no rows.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(vars(model))
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "bits")]
    place = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.__new__(Model)
        vars(own).update(sent.value)
        for batch in batches:
            sizes = np.array(pc.fill_null(pc.binary_length(batch.column(place)), 0))
            at = 0
            while at < batch.num_rows:
                n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), SIDE_BY_SIDE, side="right")))
                part = batch.slice(at, n)
                langs, score, bits = own.predict(part.column(place).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(score), pa.array(bits)], [*kept, "lang_pred", "score", "bits"])
                at += n

    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double").add("bits", "double")
    return docs.select(*kept).mapInArrow(run, schema)


def learn(docs: DataFrame) -> Model:
    """From text and lang of the documents that aren't held out."""
    return Model(labelled_sample(docs.filter(~held_out(F.col("doc_id"))).select("text", "lang")))


def reject(docs: DataFrame, limits: dict[str, float]) -> DataFrame:
    """The documents (with lang_pred and bits) that are in some learned language: below the `limits` of bits a symbol of
    the language, a model's `limits`; und has none."""
    limit = F.lit(None).cast("double")
    for lang, most in limits.items():
        limit = F.when(F.col("lang_pred") == lang, most).otherwise(limit)
    return docs.filter(F.col("bits") < limit)


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs.select("doc_id", "text"), learn(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits")
