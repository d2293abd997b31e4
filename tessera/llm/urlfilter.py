"""URL verdicts: host and path rules first, then a weighted vocabulary found by an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ship, table, worker_cache

ship(__name__)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The default vocabulary, in English; read_vocabulary() reads another from a file. Words that have a plain meaning beside
#: the unwanted one are soft, single letters and words of other topics are left out.
#: One of these in a url rejects it.
STRICT = (
    "porn", "porno", "pornography", "xxx", "hentai", "camgirl", "camgirls", "milf", "blowjob", "gangbang", "bukkake", "creampie", "fetish", "bdsm", "escorts", "xvideos", "sexcam", "sexcams", "sexchat", "sextoys",
    "casino", "casinos", "roulette", "blackjack", "sportsbook", "bookmaker", "baccarat", "warez", "keygen", "keygens", "nulled", "cracked", "malware", "phishing", "ransomware", "botnet", "spyware", "spam", "viagra", "cialis", "levitra", "tramadol", "xanax",
)
#: SOFT_LIMIT different ones of these reject it.
SOFT = (
    "adult", "adults", "sex", "sexy", "nude", "nudes", "naked", "erotic", "erotica", "escort", "dating", "hookup", "webcam", "cam", "cams", "amateur", "mature", "teen", "babes", "lingerie", "strip", "swinger",
    "bet", "bets", "betting", "odds", "poker", "slot", "slots", "jackpot", "lottery", "lotto", "bingo", "gambling", "wager", "bonus", "win", "winner", "prize", "free", "cheap", "discount", "deals", "promo", "coupon",
    "loan", "loans", "payday", "credit", "debt", "forex", "crypto", "bitcoin", "invest", "profit", "pills", "pill", "pharmacy", "drugs", "steroids", "diet", "weightloss", "crack", "serial", "torrent", "torrents", "download", "hack", "cheats",
)
SOFT_LIMIT = 2

#: (verdict, host, path) as the contract of op10 gives them.
OP10_RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for urls without ://."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER), F.coalesce(path, F.lit(""))


def by_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, block before allow among equals; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def read_vocabulary(path: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Strict and soft terms of a text file with lines `strict term` or `soft term`; empty lines and lines of # are skipped."""
    found: dict[str, list[str]] = {"strict": [], "soft": []}
    with open(path, encoding="utf-8") as f:
        for line in map(str.strip, f):
            if line and not line.startswith("#"):
                kind, _, term = line.partition(" ")
                found[kind].append(term.strip().translate(str.maketrans(UPPER, LOWER)))
    return tuple(found["strict"]), tuple(found["soft"])


def automaton_of(terms: tuple[tuple[str, ...], tuple[str, ...]]):
    """The automaton of (strict, soft) terms, built once for each Python worker."""
    import ahocorasick

    cache = worker_cache()
    if cache.get("url_terms") != terms:
        automaton = ahocorasick.Automaton()
        for kind, own in enumerate(terms):
            for term in own:
                automaton.add_word(term, (kind, term))
        automaton.make_automaton()
        cache.update(url_terms=terms, url_automaton=automaton)
    return cache["url_automaton"]


def vocabulary_hits(strict: Sequence[str], soft: Sequence[str]):
    """A pandas UDF: struct(strict, soft), the numbers of different strict and soft terms in a lower-cased url.

    A term counts only where no ASCII letter or digit stands before or after it.
    """
    strict = tuple(dict.fromkeys(strict))
    soft = tuple(t for t in dict.fromkeys(soft) if t not in strict)

    @F.pandas_udf("strict int, soft int")
    def hits(urls: pd.Series) -> pd.DataFrame:
        automaton = automaton_of((strict, soft))
        word = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
        rows = []
        for url in urls:
            seen = (set(), set())
            for end, (kind, term) in automaton.iter(url) if len(automaton) else ():
                begin = end - len(term) + 1
                if (begin == 0 or url[begin - 1] not in word) and (end + 1 == len(url) or url[end + 1] not in word):
                    seen[kind].add(term)
            rows.append((len(seen[0]), len(seen[1])))
        return pd.DataFrame(rows, columns=["strict", "soft"])

    return hits


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = (), strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, soft_limit: int = SOFT_LIMIT, url: str = "url") -> DataFrame:
    """Adds host, path, rule, verdict, strict_hits and soft_hits to `pages`; columns of these names are replaced.

    A fitting rule decides; else the vocabulary: block on one strict term or on soft_limit different soft ones.
    A null or empty url has empty parts and no hits, so it is allowed; a url of any length is searched whole, in linear
    time; a term that is strict and soft counts as strict; a repeated row is judged each time; an empty table gives an
    empty result. Nothing is shuffled: the rules and terms are plan literals, their number a parameter.
    """
    host, path = url_parts(F.col(url))
    hits = vocabulary_hits(strict, soft)(F.translate(F.coalesce(F.col(url), F.lit("")), UPPER, LOWER))
    out = pages.withColumns({"host": host, "path": path, "__hits": hits})
    out = out.withColumn("__rule", by_rule(F.col("host"), F.col("path"), rules))
    verdict = F.when((F.col("__hits.strict") > 0) | (F.col("__hits.soft") >= soft_limit), "block").otherwise("allow")
    return out.withColumns(
        {"rule": F.col("__rule.rule"), "verdict": F.coalesce(F.col("__rule.verdict"), verdict), "strict_hits": F.col("__hits.strict"), "soft_hits": F.col("__hits.soft")}
    ).drop("__hits", "__rule")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, OP10_RULES).select("page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits")


def oracle() -> str:
    """DuckDB SQL for op10: the vocabulary as one pattern a term."""
    lower = f"translate(coalesce(url, ''), '{UPPER}', '{LOWER}')"
    count = lambda terms: " + ".join(f"CAST(regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS INTEGER)" for t in terms)
    ordered = sorted(OP10_RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    case = lambda pick: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{pick(v, h, p)}'" for v, h, p in ordered) + " END"
    return f"""
        WITH parts AS (
            SELECT page_id, {lower} AS u,
                translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
                coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages),
        hits AS (SELECT *, CAST({count(STRICT)} AS INTEGER) AS strict_hits, CAST({count(SOFT)} AS INTEGER) AS soft_hits FROM parts)
        SELECT page_id, host, path, {case(lambda v, h, p: h + p)} AS rule,
            coalesce({case(lambda v, h, p: v)}, CASE WHEN strict_hits > 0 OR soft_hits >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
            strict_hits, soft_hits
        FROM hits"""
