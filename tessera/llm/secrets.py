"""Secrets in texts: three base patterns, and character Markov models of random strings and ordinary identifiers.

DataFrame functions only. Positions are code points: the pieces that split() leaves between matches and the matches
themselves tell where each match begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import sampled_texts, table, text_or_empty

#: Fixed patterns of the base rules; Java's (?i) folds ASCII letters only.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "markov")

#: What the models look at: runs of these characters with at least MARKOV_MIN of them.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
MARKOV_MIN = 20
RUN = r"[A-Za-z0-9+/_=-]{%d,}"
#: A run is reported whose mean log-likelihood ratio a character (nats, random over ordinary) is at least this: the second
#: for runs that lack letters or lack digits, as long words do. Of random letters in either case 99 in 100 reach it at 20.
THRESHOLD, PLAIN_THRESHOLD = 0.9, 1.4
#: Bounds of the labelled samples: documents whose words are ordinary identifiers, and generated random strings.
SAMPLE_DOCS, SAMPLE_WORDS, SAMPLE_RANDOM = 120, 300, 1500
#: Characters of a line of one sign among the ordinary strings.
SIGNS = 200

SPAN = "struct<kind:int,start:int,end:int>"


def _matches(text: Column, pattern: str, keep, maybe: Column) -> Column:
    """array<struct(start, end, found)> of the leftmost non-overlapping matches for which keep(match) holds."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("found"))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,found:string>>").alias("spans"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["found"])
        span = F.array(F.struct(start.alias("start"), end.alias("end"), x["found"].alias("found")))
        return F.struct(end.alias("at"), F.when(keep(x["found"]), F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    none = F.array().cast("array<struct<start:int,end:int,found:string>>")
    return F.when(maybe, F.aggregate(pairs, first, add, lambda acc: acc["spans"])).otherwise(none)


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of each base kind; a pattern's cheap test comes first, as most texts hold none."""
    return {
        "assign": _matches(text, ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8, text.rlike(ASSIGN)),
        "access": _matches(text, ACCESS, lambda m: F.length(m) >= 16, text.contains("AKIA")),
        "hex": _matches(text, HEX, lambda m: F.length(m) >= 32, text.rlike(r"[0-9a-f]{32}")),
    }


# --- the models


def random_strings(spark: SparkSession, n: int) -> DataFrame:
    """Labelled random strings: digests of a counter as hex of either case, base64 and base62."""
    seed = F.sha2(F.col("id").cast("string"), 512)
    shapes = [F.substring(seed, 1, 40), F.upper(F.substring(seed, 41, 32)), F.substring(F.base64(F.unhex(seed)), 1, 40), F.translate(F.substring(F.base64(F.unhex(seed)), 41, 32), "+/=", "xY7")]
    return spark.range(n).select(F.explode(F.array(*shapes)).alias("word"))


def ordinary_strings(docs: DataFrame, limit: int) -> DataFrame:
    """Labelled ordinary identifiers: the words of at most `limit` documents outside their base spans, alone and joined.

    Different texts are chosen by a hash, whatever their order or number, and give up to SAMPLE_WORDS words each; words
    that hold digits are left out, and pairs of neighbours give compound identifiers, with and without a number. Lines of
    one sign are ordinary too.
    """
    sign = F.substring(F.lit(ALPHABET), F.col("id").cast("int") + 1, F.lit(1))
    plain = docs.sparkSession.range(len(ALPHABET)).select(F.repeat(sign, SIGNS).alias("word"))
    chosen = sampled_texts(docs, limit, "secrets")
    clear = F.regexp_replace(F.regexp_replace(F.col("text"), ASSIGN, " "), f"{ACCESS}|[0-9a-f]{{32,}}", " ")
    words = F.filter(F.split(clear, r"[^A-Za-z_-]+"), lambda w: F.length(w).between(2, 40))
    words = F.slice(words, 1, SAMPLE_WORDS)
    number = lambda w: F.pmod(F.xxhash64(w), F.when(F.length(w) % 2 == 0, 10).otherwise(3000)).cast("string")
    shapes = [
        lambda a, b: F.concat(a, F.lit("_"), b),
        lambda a, b: F.concat(a, F.lit("-"), b, F.lit("-"), number(a)),
        lambda a, b: F.concat(a, F.lit("/"), b),
        lambda a, b: F.concat(F.lower(a), F.initcap(b), number(b)),
        lambda a, b: F.concat(F.initcap(a), number(b), F.initcap(b)),
        lambda a, b: F.concat(F.upper(a), F.lit("_"), F.upper(b), F.lit("_"), number(a)),
    ]
    joined = [F.zip_with(words, F.slice(words, 2, SAMPLE_WORDS), shape) for shape in shapes]
    return chosen.select(F.explode(F.concat(words, *joined)).alias("word")).filter("word is not null").unionByName(plain)


def bigram_counts(words: DataFrame) -> DataFrame:
    pairs = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))
    return words.filter("length(word) > 1").select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


def train(docs: DataFrame, limit: int = SAMPLE_DOCS, random: int = SAMPLE_RANDOM, smooth: float = 1.0) -> list[float]:
    """log P(b|a, random) - log P(b|a, ordinary) by index(a) * len(ALPHABET) + index(b); as many numbers as pairs.

    The counts that reach the driver are at most the pairs of ALPHABET, for any number of documents.
    """
    import math

    spark, k = docs.sparkSession, len(ALPHABET)
    at = {c: i for i, c in enumerate(ALPHABET)}

    def logs(words: DataFrame) -> list[float]:
        counts = [smooth] * (k * k)
        for r in bigram_counts(words.filter(F.col("word").rlike(r"^[A-Za-z0-9+/_=-]+$"))).collect():
            counts[at[r.pair[0]] * k + at[r.pair[1]]] += r.n
        rows = [sum(counts[i * k : (i + 1) * k]) for i in range(k)]
        return [math.log(n / rows[i // k]) for i, n in enumerate(counts)]

    return [round(a - b, 5) for a, b in zip(logs(random_strings(spark, random)), logs(ordinary_strings(docs, limit)), strict=True)]


def likelihood_ratio(word: Column, model: list[float]) -> Column:
    """The mean log-likelihood ratio a transition of a word over ALPHABET."""
    k = len(ALPHABET)
    ratios = F.split(F.lit(" ".join(map(str, model))), " ").cast("array<double>")
    # Code points to places in ALPHABET: one literal array, so a step is two look-ups.
    place = F.split(F.lit(" ".join(str(max(0, ALPHABET.find(chr(c)))) for c in range(128))), " ").cast("array<int>")
    raw = F.transform(F.split(word, ""), lambda c: F.get(place, F.ascii(c)))
    step = lambda acc, c: F.struct((acc["sum"] + F.when(acc["last"] >= 0, F.get(ratios, acc["last"] * k + c)).otherwise(0.0)).alias("sum"), c.alias("last"))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("last"))
    return F.aggregate(F.slice(raw, 1, F.length(word)), start, step, lambda acc: acc["sum"]) / F.greatest(F.length(word) - 1, F.lit(1))


def markov_spans(text: Column, model: list[float], least: int = MARKOV_MIN, threshold: float = THRESHOLD) -> Column:
    """The runs that look random: every run of `least` characters or more is scored."""
    run = RUN % least
    needed = lambda m: F.when(m.rlike("[0-9]") & m.rlike("[A-Za-z]"), threshold).otherwise(F.greatest(F.lit(threshold), F.lit(PLAIN_THRESHOLD)))
    keep = lambda m: likelihood_ratio(m, model) >= needed(m)
    return _matches(text, run, keep, text.rlike(run))


def scan(docs: DataFrame, model: list[float] | None = None) -> DataFrame:
    """Adds n_assign, n_access, n_hex, base_spans and all_spans to `docs` (text, ...); columns of these names are replaced.

    Spans are struct(kind, start, end), kind a place in KINDS, by start and then kind. The models add runs that overlap no
    base span; a base span always stays. Spans of two kinds may overlap and all stay, the kind first in KINDS before
    others of one start. A null text is as an empty one and has none; equal texts get equal spans; a text of any length is
    scanned whole, in one row and without a shuffle; no rows give no rows.
    """
    model = train(docs) if model is None else model
    text = text_or_empty()
    found = base_spans(text) | {"markov": markov_spans(text, model)}
    out = docs.withColumns({f"__{k}": c for k, c in found.items()})
    spans = {k: F.transform(F.col(f"__{k}"), _of_kind(i)) for i, k in enumerate(KINDS)}
    ordered = lambda spans: F.array_sort(spans, _by_start)
    base = F.concat(spans["assign"], spans["access"], spans["hex"])
    extra = F.filter(spans["markov"], lambda s: ~F.exists(F.col("base_spans"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    out = out.withColumns({f"n_{k}": F.size(f"__{k}").cast("long") for k in KINDS[:3]}).withColumn("base_spans", ordered(base))
    out = out.withColumn("all_spans", F.when(F.size("__markov") > 0, ordered(F.concat(F.col("base_spans"), extra))).otherwise(F.col("base_spans")))
    return out.drop(*(f"__{k}" for k in KINDS))


def _of_kind(i: int):
    return lambda s: F.struct(F.lit(i).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))


def _by_start(a: Column, b: Column) -> Column:
    return F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(a["kind"] < b["kind"], -1).when(a["kind"] > b["kind"], 1).otherwise(0)


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each run of overlapping spans replaced by one mark; texts without spans stay as they are."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def cut(acc: Column, s: Column) -> Column:
        gap = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), gap.alias("out"))

    whole = F.aggregate(spans, start, cut, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = scan(docs)
    return spans.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(written(F.col("base_spans")), 256).alias("base_sha256"), written(F.col("all_spans")).alias("spans"))
