import pytest
from pyspark.sql import functions as F
from tracewake.functions import paths, text, vectors
from tracewake.functions.random import mulberry32
from tracewake.operators import evaluate, evidence, fusion, graph, history, ingest, lexical, semantic


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokens(spark):
    found = one(spark, text.tokenize(F.lit("releaseLockLua RELEASE_LOCK_LUA HTTPServer v2Foo __x café")))
    assert found == ["release", "lock", "lua", "releaselocklua", "httpserver", "v2foo", "x", "café"]
    assert one(spark, text.tokenize(F.lit(None).cast("string"))) == []
    assert one(spark, text.query_terms(F.lit("The index of lockRow"), F.array(F.lit("some"), F.lit("getId")))) == ["lock", "row", "lockrow", "some", "getid", "get"]


@pytest.mark.parametrize(
    ("source", "specifier", "wanted"),
    [("src/a/b.ts", "../c", "src/c"), ("a.ts", "./b/./c", "b/c"), ("a.ts", "../../x", "../../x"), ("src/b.ts", ".", "src"), ("src/b.ts", "..", "")],
)
def test_relative_paths(spark, source, specifier, wanted):
    assert one(spark, paths.join_relative(F.lit(source), F.lit(specifier))) == wanted


def test_policy(spark, rows):
    entries = [
        ("120000", "a.ts", 1), ("160000", "m", None), ("100644", "dist/a.ts", 1), ("100644", "Dist/a.ts", 1), ("100644", "x/package-lock.json", 1), ("100644", "A.MIN.JS", 1), ("100644", "a.py", 1),
        ("100644", ".gitignore", 1), ("100644", "a.ts", None), ("100644", "a.MD", 1048576), ("100644", "a.yml", 1048577),
    ]
    found = {r["path"] + str(r["size"]): r["reason"] or r["kind"] for r in ingest.classify_tree(spark.createDataFrame(entries, "mode string, path string, size long")).collect()}
    assert list(found.values()) == ["symlink", "submodule", "generated", "code", "generated", "generated", "unsupported_type", "unsupported_type", "oversized", "document", "oversized"]


def test_contents(spark):
    data = [(b"\xef\xbb\xbfa\r\nb\rc",), (b"a\x00b",), (b"\xff",), (b"",)]
    found = [r["c"] for r in spark.createDataFrame(data, "d binary").select(ingest.normalise_content(F.col("d")).alias("c")).collect()]
    assert [(r["text"], r["byte_length"], r["reason"]) for r in found] == [("a\nb\nc", 5, None), (None, None, "binary"), (None, None, "not_utf8"), ("", 0, None)]


def test_vectors(spark):
    a = lambda *x: F.array(*[F.lit(float(v)).cast("float") for v in x])
    assert one(spark, vectors.cosine(a(1, 2), a(2, 1))) == pytest.approx(0.8)
    assert one(spark, vectors.cosine(a(0, 0), a(2, 1))) == 0
    with pytest.raises(Exception, match="length"):
        one(spark, vectors.cosine(a(1), a(2, 1)))
    assert [one(spark, vectors.is_valid(v, F.lit(2))) for v in (a(1, 0), a(0, 0), a(1), a(float("nan"), 1))] == [True, False, False, False]
    assert one(spark, vectors.from_bytes(vectors.to_bytes(a(1.5, -2)))) == [1.5, -2]


@pytest.mark.parametrize(("seed", "wanted"), [(20261014, [0.19576451717875898, 0.89535868098028, 0.07554438407532871]), (2667729199, [0.6837100561242551, 0.702551462687552, 0.8209013962186873])])
def test_generator(spark, seed, wanted):
    assert [r[0] for r in spark.range(3).select(mulberry32(seed, F.col("id"))).collect()] == wanted


FILES = [(1, "src/billing.ts"), (2, "src/invoice.ts"), (3, "test/billing.test.ts"), (4, "src/ledger.ts"), (5, "src/other.ts")]


def test_graph_and_deterministic_rank(spark, rows):
    by = ["snapshot_id"]
    files = spark.createDataFrame([(7, i, i + 100, p, "code", f"s{i}") for i, p in FILES], "snapshot_id long, artifact_id long, version_id long, path string, kind string, sha256 string")
    texts = {2: "import { a } from './billing.js';", 3: "import '../src/billing';\nimport t from '../src/billing'", 1: "import type { L } from './ledger.js'; export * from './other'; // import x from './invoice'"}
    contents = spark.createDataFrame([(f"s{i}", texts.get(i, "")) for i, _ in FILES], "sha256 string, text string")
    found = graph.content_imports(contents).filter("specifier IS NOT NULL")
    imports = files.join(found, "sha256").select(*by, F.col("artifact_id").alias("source_id"), F.col("path").alias("source_path"), "specifier")
    edge = graph.edges(graph.resolve_imports(imports, files, by), files, by)
    assert rows(edge.select("source_id", "target_id", "kind")) == [(1, 4, "imports"), (2, 1, "imports"), (3, 1, "imports"), (3, 1, "test-to-source")]
    signals = graph.structural_signals(edge, files.filter("artifact_id = 1"), by)
    assert rows(signals.select("artifact_id", "signal")) == [(2, "incoming-import"), (3, "test-to-source"), (4, "outgoing-import")]
    none = lexical.lexical_matches(files, contents, [])
    ranked = fusion.deterministic_rank(fusion.deterministic_candidates(none, graph.signal_counts(signals, by), files, by), by)
    assert rows(ranked.select("rank", "path", "category")) == [(1, "src/invoice.ts", "critical-structural"), (2, "test/billing.test.ts", "critical-structural"), (3, "src/ledger.ts", "weak-structural")]
    semantic_side = files.filter("artifact_id >= 4").select("snapshot_id", "artifact_id", "version_id", "path", (F.col("artifact_id") - 3).alias("rank"))
    fused = fusion.fuse(ranked, semantic_side, by)
    assert [r["path"] for r in fused.orderBy("rank").collect()] == ["src/ledger.ts", "src/invoice.ts", "test/billing.test.ts", "src/other.ts"]
    assert fusion.fuse(ranked.repartition(7).orderBy(F.rand(3)), semantic_side.orderBy(F.rand(4)), by).orderBy("rank").collect() == fused.orderBy("rank").collect()
    assert evidence.eligible_rank(fused, files.filter("artifact_id = 4"), by).orderBy("rank").first()["eligible_rank"] == 1


def test_import_scan(spark):
    source = "import a, { b as c } from \"x\";\nimport * as d from 'y'\n/* import e from 'z' */ const s = `import f from 'w'`;\nimport('dyn'); import g = require('q'); export { h } from 'v';\nimport 'side';"
    found = one(spark, graph.import_declarations(F.lit(source)))
    assert [(d["specifier"], d["start_line"]) for d in found] == [("x", 1), ("y", 2), ("side", 5)]
    assert one(spark, graph.import_declarations(F.lit("import a from 'x' /* no end"))) is None


def test_lexical_rank_does_not_depend_on_order(spark):
    files = spark.createDataFrame([(1, 1, 11, "docs/checkout.md", "a"), (1, 2, 12, "src/other.ts", "b"), (1, 3, 13, "src/none.ts", "c")], "snapshot_id long, artifact_id long, version_id long, path string, sha256 string")
    contents = spark.createDataFrame([("a", "reservation lock"), ("b", "a lock"), ("c", None), ("a", "reservation lock")], "sha256 string, text string")
    terms = ["checkout", "reservation", "lock"]
    ranked = lexical.lexical_rank(lexical.lexical_matches(files, contents, terms), ["snapshot_id"]).orderBy("rank")
    assert [(r["path"], r["category"], r["matched_terms"]) for r in ranked.collect()] == [("docs/checkout.md", "path-and-multi-content", ["checkout", "lock", "reservation"]), ("src/other.ts", "single-term", ["lock"])]
    again = lexical.lexical_rank(lexical.lexical_matches(files.orderBy(F.rand(1)).repartition(3), contents, terms[::-1]), ["snapshot_id"]).orderBy("rank")
    assert again.select("path", "rank").collect() == ranked.select("path", "rank").collect()


def test_embedding_inputs(spark, rows):
    assert semantic.embedding_inputs("a.md", "# t", 400) == ["search_document: File: a.md\n\n# t"]
    body = "# a\n" + "x" * 150 + "\n## b\n" + "y" * 150 + "\n" + "😀" * 300
    found = semantic.embedding_inputs("a.md", body, 300)
    texts = [f.split("\n\n", 1)[1] for f in found]
    assert "".join(texts).replace("\n", "") == body.replace("\n", "") and all(semantic._units(f) <= 300 for f in found)
    with pytest.raises(ValueError):
        semantic.embedding_inputs("p" * 200, "x" * 500, 300)
    chunks = semantic.chunk_files(spark.createDataFrame([(1, "a.txt", "w\n" * 400), (2, "b.txt", None)], "id long, path string, text string"), 300)
    assert chunks.select("id").distinct().count() == 1
    embedded = semantic.embed(semantic.missing_inputs(chunks, spark.createDataFrame([], "model_id string, input_hash string"), "m"), lambda ts: [[float(len(t)), 1.0] for t in ts], "m")
    assert embedded.count() == chunks.select("input_hash").distinct().count()


def test_metrics_and_decision(spark):
    placed = spark.createDataFrame([(1, 2), (1, 6), (1, 30), (2, None)], "commit long, position int")
    found = {r["commit"]: r for r in evaluate.commit_metrics(placed, ["commit"]).collect()}
    assert [found[1][f"found{k}"] for k in (3, 5, 10, 20)] == [1, 1, 2, 2] and found[1]["mrr20"] == evaluate.SCALE // 2
    assert found[2]["recall20"] == 0 and found[2]["mrr20"] == 0 and found[1]["recall3"] == evaluate.SCALE // 3
    population = spark.createDataFrame([(0, 1), (1, 2), (2, 4)], "member long, v long")
    sums = [r["v"] for r in evaluate.replicate_sums(population, ["v"], 20261014, 4).orderBy("replicate").collect()]
    draws = [int(r[0] * 3) for r in spark.range(12).select(mulberry32(20261014, F.col("id"))).collect()]
    assert sums == [sum([1, 2, 4][d] for d in draws[i : i + 3]) for i in range(0, 12, 3)]


def test_sibling_tests(spark, rows):
    inputs = spark.createDataFrame([("src/a.b.ts",), ("lib/index.ts",)], "path string").withColumn("c", F.lit(1))
    tests = spark.createDataFrame([("src/a.b.test.ts",), ("src/__tests__/a.b.x.ts",), ("test/a.b.spec.js",), ("test/lib.test.ts",), ("test/a.test.ts",)], "path string").withColumn("c", F.lit(1))
    assert rows(evaluate.sibling_tests(inputs, tests, ["c"]).select("path", "tier", "rank")) == [("src/__tests__/a.b.x.ts", 2, 2), ("src/a.b.test.ts", 1, 1), ("test/a.b.spec.js", 3, 4), ("test/lib.test.ts", 3, 3)]


def test_history(spark, rows):
    commits = spark.createDataFrame([("e", ["c", "d"]), ("d", ["b"]), ("c", ["b"]), ("b", ["a"]), ("a", []), ("x", [])], "sha string, parents array<string>")
    assert rows(history.reachable(commits, spark.createDataFrame([("d",)], "sha string"))) == [("a",), ("b",), ("d",)]
    assert rows(history.history(commits, "e", "b").select("sha")) == [("c",), ("d",), ("e",)]
    assert history.is_ancestor(commits, "a", "e") and not history.is_ancestor(commits, "x", "e") and history.is_ancestor(commits, "e", "e")
    tree = "path string, object_sha string, mode string"
    base = spark.createDataFrame([("a", "1", "100644"), ("b", "2", "100644"), ("c", "3", "100644"), ("l", "4", "100644")], tree)
    target = spark.createDataFrame([("a", "9", "100644"), ("d", "2", "100644"), ("c", "3", "100644"), ("l", "4", "120000"), ("n", "7", "100644")], tree)
    assert rows(history.diff_trees(base, target)) == [("added", "n", None), ("modified", "a", None), ("renamed", "d", "b"), ("type_changed", "l", None)]


def test_global_rank(spark):
    rows = spark.range(5000).select(((F.col("id") * 7919) % 4999).alias("v"), "id").repartition(7)
    ranked = history.global_rank(rows, [F.desc("v"), F.col("id")]).orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == list(range(1, 5001))
    assert [(r["v"], r["id"]) for r in ranked] == sorted(((r["v"], r["id"]) for r in ranked), key=lambda x: (-x[0], x[1]))
    assert history.global_rank(rows.limit(0), [F.col("id")]).count() == 0
