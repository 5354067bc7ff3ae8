from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from tracewake.functions import paths, text
from tracewake.operators import graph, lexical, search, semantic

FILES = [(1, "src/billing.ts"), (2, "src/invoice.ts"), (3, "test/billing.test.ts"), (4, "src/ledger.ts"), (5, "src/other.ts")]
TEXTS = {1: "import type { L } from './ledger.js';\nexport const bill = 1", 2: "// top\nimport { bill } from './billing.js';\nimport * as again from \"./billing\";\nbill();", 3: "import '../src/billing';\ntest()", 4: "ledger", 5: "reservation lock"}
BY = ["snapshot_id"]


@pytest.fixture(scope="module")
def corpus(spark):
    files = spark.createDataFrame([(7, i, i + 100, p, "code", f"s{i}") for i, p in FILES], "snapshot_id long, artifact_id long, version_id long, path string, kind string, sha256 string")
    contents = spark.createDataFrame([(f"s{i}", t) for i, t in TEXTS.items()], "sha256 string, text string")
    found = graph.content_imports(contents).filter("specifier IS NOT NULL")
    imports = files.join(found, "sha256").select(*BY, F.col("artifact_id").alias("source_id"), F.col("path").alias("source_path"), "specifier")
    resolved = graph.resolve_imports(imports, files, BY)
    paths = files.select(F.col("artifact_id").alias("id"), "path")
    chunks = spark.createDataFrame([("m", 7, i, 0, f"h{i}") for i in (2, 4, 5)], "model_id string, snapshot_id long, artifact_id long, chunk_index int, input_hash string")
    vectors = spark.createDataFrame([("m", "h2", 2, [1.0, 0.0]), ("m", "h4", 2, [1.0, 1.0]), ("m", "h5", 2, [0.0, 1.0]), ("m", "h6", 2, [0.0, 0.0])], "model_id string, input_hash string, dimensions int, vector array<float>")
    return search.Corpus(files, lexical.content_tokens(contents), lexical.path_tokens(paths), graph.edges(resolved, files, BY), chunks, vectors, BY), resolved, contents


def change(spark):
    changes = spark.createDataFrame([(7, "Fix the reservation", ["src/billing.ts", "src/none.ts"])], "snapshot_id long, description string, changed array<string>")
    return changes, spark.createDataFrame([(7, "m", [1.0, 0.1])], "snapshot_id long, model_id string, vector array<float>")


def test_relationships(spark, corpus, rows):
    c = corpus[0]
    wanted = c.files.filter("artifact_id = 1").select(*BY, "artifact_id")
    into = graph.relationships(c.edges, c.files, wanted, BY, "incoming")
    assert rows(into.select("relationship", "source_path", "target_path", "source_version_id")) == [("imports", "src/invoice.ts", "src/billing.ts", 102), ("imports", "test/billing.test.ts", "src/billing.ts", 103), ("test-to-source", "test/billing.test.ts", "src/billing.ts", 103)]
    assert rows(graph.relationships(c.edges, c.files, wanted, BY, "outgoing").select("relationship", "target_path")) == [("imports", "src/ledger.ts")]
    assert graph.relationships(c.edges, c.files, wanted.limit(0), BY, "incoming").count() == 0
    with pytest.raises(ValueError):
        graph.relationships(c.edges, c.files, wanted, BY, "both")


def test_declarations(corpus):
    c, resolved, contents = corpus
    found = {(r["source_id"], r["target_id"]): r["declarations"] for r in graph.edge_declarations(resolved, c.files, contents, BY).collect()}
    assert set(found) == {(1, 4), (2, 1), (3, 1)}
    two = found[2, 1]
    assert [(d["specifier"], d["start_line"], d["end_line"]) for d in two] == [("./billing.js", 2, 2), ("./billing", 3, 3)] and two[0]["excerpt"]["text"].startswith("import { bill }")


def test_search_and_investigation(spark, corpus, rows):
    c = corpus[0]
    changes, queries = change(spark)
    run = search.search_hybrid(c, changes, queries)
    assert rows(run.matches.select("artifact_id", "content_terms", "path_terms")) == [(1, [], ["billing"]), (2, ["billing"], []), (3, ["billing"], ["billing"]), (5, ["reservation"], [])]
    assert [r["artifact_id"] for r in run.semantic.orderBy("rank").collect()] == [2, 4, 5]
    assert search.inconsistent_candidates(run.fused, run, c).count() == 0
    bad = search.inconsistent_candidates(run.fused.withColumn("path", F.when(F.col("artifact_id") == 4, "x").otherwise(F.col("path"))), run, c)
    assert rows(bad.select("artifact_id", "problem")) == [(4, "not in the snapshot")]
    lost = search.Corpus(c.files, c.content_index, c.path_index, c.edges.filter("source_id <> 2"), c.chunks, c.embeddings, BY)
    assert rows(search.inconsistent_candidates(run.fused, run, lost).select("artifact_id", "problem")) == [(2, "a signal without an edge")]
    with pytest.raises(Exception, match="a signal without an edge"):
        search.construct_evidence(run, lost, changes, "m")[0].collect()
    best, evidence = search.construct_evidence(run, c, changes, "m")
    assert {r["path"] for r in best.collect()} == {"src/invoice.ts", "test/billing.test.ts", "src/ledger.ts", "src/other.ts"}
    assert rows(evidence.filter("version_id = 102").select("ordinal", "type")) == [(1, "structural"), (2, "lexical"), (3, "semantic"), (4, "fusion")]
    found = {r["path"]: r for r in search.investigate_changes(c, changes, queries, "m").collect()}
    assert found["src/ledger.ts"]["open_question"] == "target" and found["src/ledger.ts"]["limitations"] == ["dependency", "coarse"]
    assert found["src/other.ts"]["limitations"] == ["no-tie"] and found["test/billing.test.ts"]["limitations"] == ["coarse", "dissimilar"]
    assert search.investigate_changes(c, changes.limit(0), queries.limit(0), "m").count() == 0


def counted(df, seen):
    """The same rows, each of them counted whenever it is read."""

    def run(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    return df.mapInPandas(run, df.schema)


def test_every_part_of_an_investigation_is_done_once(spark, corpus):
    c, _, contents = corpus
    texts, edges = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    lists = replace(c, content_index=lexical.content_token_lists(counted(contents, texts)), edges=counted(c.edges, edges))
    changes, queries = change(spark)
    # Edges are read into and out of what changed, and once more by the check.
    found = search.investigate_changes(lists, changes, queries, "m").collect()
    assert texts.value == len(TEXTS) and edges.value <= 3 * c.edges.count()
    assert sorted(found, key=repr) == sorted(search.investigate_changes(c, changes, queries, "m").collect(), key=repr)


def test_matches_are_the_same_by_lists_of_tokens(spark, corpus, rows):
    c, _, contents = corpus
    terms = search.change_terms(change(spark)[0], BY)
    # A content in two rows, an artifact with two contents, and one whose content is unknown.
    files = c.files.unionByName(c.files.filter("artifact_id = 2").withColumn("sha256", F.lit("s5"))).unionByName(c.files.filter("artifact_id = 3").withColumn("sha256", F.lit(None).cast("string")))
    lists = lexical.index_matches(files, terms, lexical.content_token_lists(contents.unionByName(contents)), c.path_index, BY)
    assert rows(lists) == rows(lexical.index_matches(files, terms, c.content_index, c.path_index, BY))
    assert rows(lists.filter("artifact_id = 2").select("content_terms", "path_terms", "matched_terms")) == [(["billing", "reservation"], [], ["billing", "reservation"])]


def written(spark):
    """Bytes of all shuffles that the session has written so far."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(30_000)
    return context.statusStore().executorList(True).apply(0).totalShuffleWrite()


@pytest.mark.parametrize("index", [lexical.content_tokens, lexical.content_token_lists])
def test_tokens_that_nobody_asks_for_stay(spark, rows, index):
    terms = spark.createDataFrame([(7, "asked"), (8, "other"), (8, "asked")], "snapshot_id long, term string")
    files = spark.range(200).select((F.col("id") % 2 + 7).alias("snapshot_id"), F.col("id").alias("artifact_id"), F.col("id").cast("string").alias("sha256"))
    # Two thousand tokens in each content, of which a query asks for one or two.
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda i: F.md5(F.concat_ws("-", i, "id"))), " ")
    contents = spark.range(200).select(F.col("id").cast("string").alias("sha256"), F.concat(words, F.when(F.col("id") < 3, " Asked Other").otherwise("")).alias("text"))
    names = spark.createDataFrame([(5, "src/other.ts"), (4, "src/asked.ts")], "id long, path string")
    before = written(spark)
    # Lists this small would be broadcast otherwise.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = rows(lexical.index_matches(files, terms, index(contents), lexical.path_tokens(names), BY))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [(m[0], m[1], m[2], m[3]) for m in found] == [(7, 0, ["asked"], []), (7, 2, ["asked"], []), (7, 4, [], ["asked"]), (8, 1, ["asked", "other"], []), (8, 5, [], ["other"])]
    assert written(spark) - before < 500_000


def test_no_terms_and_many_terms(spark, corpus, rows):
    c = corpus[0]
    none = spark.createDataFrame([], "snapshot_id long, term string")
    assert lexical.index_matches(c.files, none, c.content_index, c.path_index, BY).count() == 0
    # More terms than there are hash values, so that every token may be asked for.
    many = spark.range(4 * 2**lexical.SLOTS).select(F.lit(9).cast("long").alias("snapshot_id"), F.col("id").cast("string").alias("term"))
    few = search.change_terms(change(spark)[0], BY)
    assert rows(lexical.index_matches(c.files, few.unionByName(many), c.content_index, c.path_index, BY)) == rows(lexical.index_matches(c.files, few, c.content_index, c.path_index, BY))


def test_candidates_are_ranked_once_for_their_evidence(spark, corpus):
    c = corpus[0]
    changes, queries = change(spark)
    run = search.search_hybrid(c, changes, queries)
    ranked = spark.sparkContext.accumulator(0)
    best, evidence = search.construct_evidence(replace(run, fused=counted(run.fused, ranked)), c, changes, "m")
    assert best.count() and evidence.count()
    assert ranked.value == run.fused.count()


def test_imports_meet_files_at_stems(spark, rows):
    names = ["src/a", "src/a.js", "src/.js", "src/a.d.ts", "src/index", "src/a/index.js", "index", "src/a.json", "a.jsx.js"]
    specifiers = [n if n.endswith(".js") else f"{n}{e}" for n in names for e in ("", ".js")]
    met = spark.createDataFrame([(n, s) for n, s in zip(sorted(names * 2, key=names.index), specifiers)], "joined string, specifier string")
    apart = met.select("joined", F.inline(paths.candidates(F.col("joined"), F.col("specifier")))).filter(paths.stem(F.col("joined")) != paths.stem(F.col("path")))
    assert apart.count() == 0
    files = spark.createDataFrame([(i, p) for i, p in enumerate(["src/x.ts", "src/a.tsx", "src/a/index.ts", "src/a.js.ts", "src/a.ts", "src/b.js", "src/b.ts", "src/a.css"])], "artifact_id long, path string")
    imports = files.filter("artifact_id = 0").select(F.col("artifact_id").alias("source_id"), F.col("path").alias("source_path"), F.explode(F.array(*[F.lit(s) for s in ("./a", "./a.js", "./b.js", "./a/index", "./a.css", "./x", "./none")])).alias("specifier"))
    assert rows(graph.resolve_imports(imports, files, []).select("specifier", "target_id")) == [("./a", 4), ("./a.css", 7), ("./a.js", 3), ("./a/index", 2), ("./b.js", 5)]


def test_digest_keys_are_apart(spark):
    hexes = spark.createDataFrame([("ab" * 32,), ("AB" * 32,), ("ab",), ("x" * 32,), ("",)], "s string")
    assert hexes.select(text.digest_key(F.col("s")).alias("k")).distinct().count() == 5
    assert hexes.limit(1).select(F.length(text.digest_key(F.col("s")))).first()[0] == 32


def test_chunks_are_made_again(spark):
    body = "# a\n" + "x" * 900 + "\n## b\n" + "y" * 500
    files = spark.createDataFrame([(1, "a.md", body), (2, "b.txt", None), (3, "c.md", "short")], "artifact_id long, path string, text string")
    half = semantic.chunk_files(files.filter("artifact_id = 1"), 400).drop("input")
    whole = semantic.chunk_files(files.filter("artifact_id <> 1"), 800).drop("input")
    found = semantic.reconstruct_chunks(files, half.unionByName(whole), 800).orderBy("artifact_id", "chunk_index").collect()
    assert "".join(r["chunk_text"] for r in found if r["artifact_id"] == 1).replace("\n", "") == body.replace("\n", "")
    assert [r["chunk_text"] for r in found if r["artifact_id"] == 3] == ["short"]
    gone = semantic.reconstruct_chunks(files, whole.withColumn("input_hash", F.lit("other")), 800).collect()
    assert all(r["chunk_text"] is None for r in gone) and gone


def test_index_counts(spark, rows):
    one = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "sha256 string")
    assert rows(lexical.index_counts(one, one.filter("sha256 = 'b'"))) == [(2, 1)]
