"""Tables that grow with the documents are joined without being whole in a task's memory."""

from tessera.plans import queries as q


def test_no_join_of_crawls_broadcasts(spark):
    """Spark takes small Parquet files for small tables; their rows, copied for each salt, were broadcast whole to each task."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100m")
    try:
        for name in ("redirect_chains", "discover_urls", "discover_more_urls"):
            plan = q.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Broadcast" not in plan, name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
