import os

import pytest
from pyspark.sql import functions as F
from tracewake.plans import change_queries, detail_queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")
def test_query_texts_of_whole_change_sets(spark, rows):
    by = ["base_snapshot_id", "target_snapshot_id"]
    n = change_queries.p1_found(spark, DATA).groupBy(*by).agg(F.count_distinct("path").cast("int").alias("n"))
    texts = detail_queries.change_query_texts(spark, DATA)
    assert rows(texts.select(*by, F.regexp_count("semantic", F.lit("\n- ")).alias("n"))) == rows(n)
    assert n.agg(F.max("n")).first()[0] > 3
