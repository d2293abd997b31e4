"""Phrase collocations against plain counting."""

import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import collocations
from tessera.llm.common import Scratch

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def plain(rows, least, longest, top, absorbed=100):
    counts, totals = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, longest + 1):
                    if i + k <= len(words):
                        counts[lang, tuple(words[i : i + k])] += 1
    found = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, words), a in found.items():
        inside = any(o == lang and len(w) > len(words) and 100 * b >= absorbed * a and any(w[i : i + len(words)] == words for i in range(len(w))) for (o, w), b in found.items())
        if not inside:
            cuts = [(1000 * a * totals[lang] // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            out.append((lang, -score, -a, " ".join(words).encode(), counts[lang, words[:k]], counts[lang, words[k:]]))
    rows, places = [], collections.Counter()
    for lang, score, a, phrase, left, right in sorted(out):
        places[lang] += 1
        if places[lang] <= top:
            rows.append((lang, places[lang], phrase.decode(), -a, left, right, totals[lang], -score))
    return rows


def texts():
    rng = np.random.default_rng(11)
    words = ["the", "of", "New", "york", "ÉTÉ", "été", "日本", "x y", "a-b", "it's"]
    rows = []
    for k in range(60):
        own = []
        for _ in range(int(rng.integers(1, 90))):
            own.append(str(rng.choice(words)) + str(rng.choice(["", "", "", "", ",", ".", "\n", "\r\n", " \t", "!?"])))
            if rng.random() < 0.2:
                own += ["in", "New", "York", "city"]
        rows.append((["en", "fr", None][k % 3], " ".join(own)))
    rows += [("en", None), ("en", ""), (None, "..."), ("de", "ja ja ja ja ja ja ja ja"), ("de", "ja"), ("fr", rows[1][1]), ("fr", rows[1][1]), ("xx", "  \t "), ("en", "the\x85of the\x85of the\x85of the\x1cof")]
    return rows + [("en", " ".join(rng.choice(words[:3], 3000)))]


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 40}, {"shard_bytes": 700, "bits": 3}, {"bits": 25}], ids=str)
def test_collocations_against_plain_counts(spark, options):
    rows = texts()
    docs = spark.createDataFrame([(a, b, 1, "k", 2) for a, b in rows], "lang string, text string, n int, phrase string, size int").repartition(3)
    got = [tuple(r[c] for c in COLUMNS) for r in collocations.collocations(docs, least=4, longest=4, top=25, **options).orderBy("lang", "rank").collect()]
    assert got == plain(rows, 4, 4, 25) and len(got) > 50


@pytest.mark.parametrize("longest,absorbed", [(2, 100), (3, 60), (5, 80), (7, 100)])
def test_other_lengths_and_shares(spark, longest, absorbed):
    rows = texts()[:40]
    got = [tuple(r) for r in collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), least=3, longest=longest, top=2000, absorbed=absorbed, shard_bytes=300).orderBy("lang", "rank").collect()]
    assert got == plain(rows, 3, longest, 2000, absorbed)


def test_large_counts_are_exact(spark):
    """Products of counts beyond 64 bits, as a corpus of 10**16 words has them."""
    n, a, left, right = 10**16 + 7, 3 * 10**13 + 1, 5 * 10**14 + 3, 7 * 10**13 + 9
    counts = spark.createDataFrame([("en", "", 0, n), ("en", "of", 1, left), ("en", "the", 1, right), ("en", "of the", 2, a), ("en", "the of", 2, a)], "lang string, phrase string, size int, n long")
    got = [tuple(r) for r in collocations.ranked(counts, Scratch(spark, "t")).collect()]
    score = 1000 * a * n // (left * right)
    assert got == [("en", 1, "of the", a, left, right, n, score), ("en", 2, "the of", a, right, left, n, score)]


def test_a_shard_has_all_its_intervals():
    text = b"a b a b a b c a b"
    shard = collocations.Shard([text, b"a b"], np.array([0, 0]), np.array([0, 0]), 3)
    got = {(k, shard.phrases(places, k)[i].as_py()): int(counts[i]) for k, places, counts in shard.intervals() for i in range(len(places))}
    want = collections.Counter()
    for piece in (text.decode().split(), ["a", "b"]):
        for i in range(len(piece)):
            for k in range(1, 4):
                if i + k <= len(piece):
                    want[k, " ".join(piece[i : i + k])] += 1
    assert got == dict(want)


def test_no_words(spark):
    docs = spark.createDataFrame([("en", None), (None, " .")], "lang string, text string")
    assert collocations.collocations(docs).count() == 0 and collocations.collocations(docs.limit(0)).count() == 0
    assert collocations.phrase_counts(docs.select(F.lit("x").alias("lang"), F.lit("one").alias("text"))).collect()[0].n == 2
