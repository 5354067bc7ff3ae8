import numpy as np
from pyspark.sql import functions as F
from tracewake.llm.neighbours import fit_index, mutual_pairs, nearest

SCHEMA = "model_id string, input_hash string, dimensions int, vector array<float>"


def clustered(n, d, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    return centres[rng.choice(12, n, p=[0.34] + [0.06] * 11)] + 0.7 * rng.normal(size=(n, d))


def brute(x, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    return np.argsort(-s, axis=1)[:, :k], s


def test_recall_against_brute_force(spark):
    x = clustered(3000, 24, 0)
    rows = [("m", f"h{i:05d}", 24, [float(v) for v in r * (1 + i % 50)]) for i, r in enumerate(x)]
    found = nearest(spark.createDataFrame(rows, SCHEMA), 10, queries=F.substring("key", 2, 5).cast("int") % 20 == 0, list_rows=64, query_lists=16, query_ratio=1.5).collect()
    got: dict = {}
    for r in found:
        got.setdefault(int(r["key"][1:]), set()).add(int(r["neighbour"][1:]))
    best, s = brute(x, 10)
    assert set(got) == set(range(0, 3000, 20))
    assert np.mean([len(got[i] & set(best[i])) / 10 for i in got]) >= 0.95
    assert all(abs(r["similarity"] - s[int(r["key"][1:]), int(r["neighbour"][1:])]) < 1e-4 for r in found)


def test_recall_of_the_default_setting_with_hundreds_of_lists(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(150, 32))
    x = centres[rng.choice(150, 6000, p=[0.3] + [0.7 / 149] * 149)] + 0.35 * rng.normal(size=(6000, 32))
    rows = [("m", f"h{i:05d}", 32, [float(v) for v in r]) for i, r in enumerate(x)]
    found = nearest(spark.createDataFrame(rows, SCHEMA), 10, queries=F.substring("key", 2, 5).cast("int") % 20 == 0, list_rows=24).collect()
    got: dict = {}
    for r in found:
        got.setdefault(int(r["key"][1:]), set()).add(int(r["neighbour"][1:]))
    best, _ = brute(x, 10)
    assert np.mean([len(got.get(i, set()) & set(best[i])) / 10 for i in range(0, 6000, 20)]) >= 0.9


def test_graph_finds_the_nearest_centroid():
    x = clustered(4000, 16, 1)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    index = fit_index(x, 40_000, 128)
    assert len(index.entries) < len(index.centroids)
    ids, _ = index.search(x[:1000])
    assert np.mean(ids[:, 0] == (x[:1000] @ index.centroids.T).argmax(1)) > 0.97


def test_blocks_keep_every_pair(spark):
    x = clustered(120, 8, 2)
    rows = [("m", f"h{i:03d}", 8, [float(v) for v in r]) for i, r in enumerate(x)]
    found = nearest(spark.createDataFrame(rows, SCHEMA), 5, list_rows=1000, block_rows=20).collect()
    best, _ = brute(x, 5)
    assert {(int(r["key"][1:]), int(r["neighbour"][1:])) for r in found} == {(i, j) for i in range(120) for j in best[i]}


def test_copies_ties_and_bad_vectors(spark, rows):
    good = [1.0, 2.0, 3.0]
    data = [("m", f"c{i:02d}", 3, good) for i in range(40)] + [("m", "c00", 3, good), ("m", "long", 3, [2.0, 4.0, 6.0]), ("m", "near", 3, [1.0, 2.0, 3.1])]
    data += [("m", "null", 3, None), ("m", "zero", 3, [0.0] * 3), ("m", "nan", 3, [float("nan"), 1.0, 1.0]), ("m", "inf", 3, [float("inf"), 1.0, 1.0]), ("m", "short", 3, [1.0, 2.0]), ("m", "hole", 3, [1.0, None, 1.0]), (None, "x", 3, good), ("n", "c00", 2, [1.0, 0.0]), ("n", "a", 2, [0.0, 1.0]), ("n", "a", 2, [1.0, 0.1])]
    df = spark.createDataFrame(data, SCHEMA).withColumn("key", F.lit(1)).withColumn("model", F.lit("z"))
    found = nearest(df, 3)
    keys = {r["key"] for r in found.collect()}
    assert keys == {"a", "c00", "c01", "c02", "c03", "near"}
    assert rows(found.filter("key = 'near'").select("neighbour", "rank")) == [("c00", 1), ("c01", 2), ("c02", 3)]
    assert rows(mutual_pairs(found, 0.95).filter("model = 'm'").select("a", "b"))[0] == ("c00", "c01")
    assert rows(nearest(df.filter("model_id = 'n'"), 3).select("key", "neighbour")) == [("a", "c00"), ("c00", "a")]
    assert nearest(df.limit(0), 3).count() == 0


def test_every_queried_copy_has_neighbours(spark):
    rng = np.random.default_rng(4)
    copies = [f"c{i:03d}" for i in range(60)]
    others = {f"d{i:03d}": [float(v) for v in rng.normal(size=4)] for i in range(90)}
    data = [("m", c, 4, [1.0 * (1 + i % 3), 2.0 * (1 + i % 3), 3.0 * (1 + i % 3), 0.0]) for i, c in enumerate(copies)] + [("m", k, 4, v) for k, v in others.items()]
    # A further copy that has another vector too, one that d000 is nearest to.
    data += [("m", "c055", 4, others["d000"])]
    df = spark.createDataFrame(data, SCHEMA)
    for k, due in ((3, [c for c in copies if int(c[1:]) % 11 == 0 and c != "c000"]), (70, copies)):
        found = nearest(df, k, queries=F.col("key").isin(due), copies=True, lists=9, query_lists=9, member_ratio=9.0, query_ratio=9.0).collect()
        got: dict = {}
        for r in sorted(found, key=lambda r: r["rank"]):
            got.setdefault(r["key"], []).append(r["neighbour"])
        assert set(got) == set(due) and {len(v) for v in got.values()} == {k}
        if k == 3:
            assert all(got[c] == ["c000", "c001", "c002"] for c in due if c != "c055")
            assert got["c055"] == ["c000", "c001", "c002"]
    assert {r["key"] for r in nearest(df, 3, copies=True).select("key").distinct().collect()} == set(copies) | set(others)


def test_large_lists_get_lists_of_their_own(spark):
    x = clustered(4000, 16, 5)
    rows = [("m", f"h{i:05d}", 16, [float(v) for v in r]) for i, r in enumerate(x)]
    found = nearest(spark.createDataFrame(rows, SCHEMA), 10, queries=F.substring("key", 2, 5).cast("int") % 20 == 0, list_rows=64, max_lists=3, split_rows=300, query_lists=8, query_ratio=1.3).collect()
    best, s = brute(x, 10)
    got: dict = {}
    for r in found:
        got.setdefault(int(r["key"][1:]), set()).add(int(r["neighbour"][1:]))
    assert set(got) == set(range(0, 4000, 20)) and {len(v) for v in got.values()} == {10}
    assert np.mean([len(got[i] & set(best[i])) / 10 for i in got]) >= 0.9
    assert all(abs(r["similarity"] - s[int(r["key"][1:]), int(r["neighbour"][1:])]) < 1e-4 for r in found)
