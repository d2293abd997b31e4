from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm.queries import oracle_sql, queries


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "123 !!", "en", "s", 6), (None, "the words of this text", "en", "s", 22)], docs.schema)
    docs = docs.unionByName(odd).unionByName(docs.limit(1)).withColumn("bits", F.lit(1.0))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        kept[name] = docs.collect()
        docs = spark.createDataFrame(kept[name], docs.schema)
    ids = {k: [r.doc_id for r in v] for k, v in kept.items()}
    assert not {9001, 9002, 9003} & set(ids["language"]) and None in ids["language"]
    assert len(ids["language"]) >= 198 and len(ids["near_duplicates"]) < len(ids["language"])
    assert len(ids["near_duplicates"]) == len(set(ids["near_duplicates"]))
    assert sorted(map(str, ids["without_secrets"])) == sorted(map(str, ids["near_duplicates"]))
    assert not any("token = \"" in r.text for r in kept["without_secrets"])
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).select("doc_id").distinct().count() == len(kept["without_secrets"])


def test_every_query_with_sql_is_registered():
    assert set(oracle_sql()) <= set(queries()) and len(queries()) == 10


def test_stages_of_no_and_bare_rows(spark):
    """No rows, and rows without a text or a doc_id; a column of no concern, named as one of the stages' own, is not read."""
    import corpus_pipeline as p

    schema = "doc_id long, text string, lang string, source string, n_chars long, id long"
    none = spark.createDataFrame([], schema)
    for name, stage in p.STAGES:
        out = stage(spark, none, "")
        assert out.collect() == [] and (name == "packed" or out.columns == list(p.COLUMNS))
    bare = spark.createDataFrame([(1, None, None, None, None, 5), (None, "a b c d e f", "en", "s", 11, 5), (2, "", "en", "s", 0, 6), (2, "", "en", "s", 0, 6)], schema)
    assert sorted((r.doc_id or -1, r.text or "") for r in p.near_duplicates(spark, bare, "").collect()) == sorted((r.doc_id or -1, r.text or "") for r in bare.dropDuplicates(["doc_id", "text"]).collect())
    assert sorted((r.doc_id or -1, r.text or "") for r in p.without_secrets(spark, bare, "").collect()) == sorted((r.doc_id or -1, r.text or "") for r in bare.collect())
    assert [(r.doc_id, r.length) for r in p.packed(spark, bare.filter("doc_id is not null"), "").orderBy("doc_id").collect()] == [(1, 1), (2, 1), (2, 1)]
