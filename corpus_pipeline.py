"""A training corpus from raw documents: language ID, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the shared folder and reads
it again as the next one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import langid, minhash, packing, secrets
from tessera.llm.common import Scratch, table, text_or_empty

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Language, groups of near-duplicates and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled documents among them teach; those without letters or language go.

    Each row is judged by its whole text alone, so repeated rows stay or go together; null and empty texts go. Of
    languages with equal scores the first by name is taken, which doesn't change who stays. No rows give no rows; columns
    beside those of documents are not read.
    """
    model = langid.learn(docs)
    return langid.reject(langid.identify(docs.select(*COLUMNS), model), model.limits).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id.

    Rows that repeat a doc_id are judged each by its own text; where several rows of a group have its smallest doc_id, that
    of the smallest mark of its text stays, and of rows with equal texts the first by lang, source and n_chars. Rows
    without a doc_id or a text all stay. Texts of any length are compared whole; ties in similarity can't matter, as
    groups are what links reach. No rows give no rows.
    """
    docs = docs.select(*COLUMNS)
    scratch = Scratch(spark, "near-duplicates")
    named = docs.filter("doc_id is not null")
    groups = scratch.put(minhash.near_documents(named.select(F.col("doc_id").cast("long").alias("id"), "text")), "groups")
    kept = groups.filter("group is not null").groupBy("group").agg(F.min(F.struct("id", "mark")).alias("top")).select(F.col("top.id").alias("doc_id"), F.col("top.mark").alias("__mark"))
    stays = named.filter("text is not null").withColumn("__mark", minhash.text_mark()).join(kept, ["doc_id", "__mark"], "left_semi")
    again = groups.filter("group is not null").groupBy(F.col("id").alias("doc_id"), F.col("mark").alias("__mark")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id", "__mark")
    once = stays.join(again, ["doc_id", "__mark"], "left_anti")
    rest = stays.join(again, ["doc_id", "__mark"], "left_semi").groupBy("doc_id", "__mark").agg(F.min(F.struct("lang", "source", "n_chars", "text")).alias("first"))
    rest = rest.select("doc_id", "first.text", "first.lang", "first.source", "first.n_chars")
    return once.select(*COLUMNS).unionByName(rest.select(*COLUMNS)).unionByName(docs.filter("doc_id is null or text is null"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by a mark; texts without one stay as they are.

    Whole texts of any length are scanned; null and empty texts stay so, repeated rows are treated alike, overlapping spans
    are replaced once. No rows give no rows; columns beside those of documents are not read.
    """
    found = secrets.scan(docs.select(*COLUMNS))
    clean = F.when(F.col("text").isNotNull(), secrets.redact(text_or_empty(), F.col("all_spans")))
    marked = F.size("all_spans") > 0
    return found.select("doc_id", clean.alias("text"), "lang", "source", F.when(marked, F.length(clean).cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens and their places in sequences of 4096.

    A null or empty text is the final id alone; longer texts are cut into whole pieces, none is dropped. Pieces of equal
    length may take each other's places. Rows that repeat a doc_id are packed each. No rows give no rows.
    """
    import public_tokenizers

    docs = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("without_secrets", without_secrets), ("packed", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
