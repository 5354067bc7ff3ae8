from tracewake.operators import evaluate


def test_status_counts_and_unfinished_commits(spark, rows):
    status = ["succeeded", "failed", "not_run"]
    results = spark.range(300).selectExpr("id AS commit", "CASE WHEN id < 200 THEN 'hybrid' ELSE 'semantic' END AS method").crossJoin(spark.createDataFrame(list(enumerate(status)), "k long, status string")).filter("commit % 3 = k").drop("k")
    assert rows(evaluate.method_status(results)) == sorted([("hybrid", "failed", 67), ("hybrid", "not_run", 66), ("hybrid", "succeeded", 67), ("semantic", "failed", 33), ("semantic", "not_run", 34), ("semantic", "succeeded", 33)], key=repr)
    assert rows(evaluate.unfinished(results)) == sorted((("hybrid" if i < 200 else "semantic", status[i % 3], i) for i in range(300) if i % 3), key=repr)
    assert evaluate.method_status(results.limit(0)).count() == 0


def test_status_of_all_eligible_commits(spark):
    import os

    import pytest
    from tracewake.plans import detail_queries, evaluation_queries

    data = "/root/testdata/sf0.001"
    if not os.path.exists(data):
        pytest.skip("no test data")
    n = evaluation_queries.commit_selection(spark, data).count()
    counts = {(r["method"], r["status"]): r["n_commits"] for r in detail_queries.method_status_counts(spark, data).collect()}
    assert sum(counts.values()) == n
    assert detail_queries.method_status_commits(spark, data).count() == sum(c for (_, s), c in counts.items() if s != "succeeded")
