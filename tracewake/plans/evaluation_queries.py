"""Queries on history signals, the evaluation and checks of data, with their SQL.

Orders stand for commits (their line items' parts are the changed files) and every part has a class by its key.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewake.functions import text
from tracewake.functions.random import mulberry32
from tracewake.operators import evaluate, grounding, history, validate
from tracewake.operators.ingest import table_digest
from tracewake.session import cut_lineage, table

#: The seeds of both bootstrap runs.
SEED, SECOND_SEED = 20261014, 2667729199


def _commits(spark, root):
    k = F.col("o_orderkey")
    parents = F.when(k % 50 == 0, 0).when(k % 17 == 0, 2).otherwise(1)
    return table(spark, root, "orders").select(k.alias("commit"), F.col("o_orderdate").alias("time"), parents.alias("n_parents"), F.concat(F.lit("fix #"), F.col("o_custkey").cast("string")).alias("subject"))


def _changes(spark, root):
    rows = table(spark, root, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("part")).distinct()
    return rows.select("commit", "part", F.concat(F.lit("p"), F.col("part").cast("string")).alias("path"), F.when(F.col("part") % 4 == 0, "test").when(F.col("part") % 4 == 1, "doc").otherwise("source").alias("class"))


_HISTORY = """c AS (SELECT o_orderkey AS commit, o_orderdate AS time, CASE WHEN o_orderkey % 50 = 0 THEN 0 WHEN o_orderkey % 17 = 0 THEN 2 ELSE 1 END AS n_parents, o_custkey AS reference FROM orders),
f AS (SELECT DISTINCT l_orderkey AS commit, l_partkey AS part, 'p' || l_partkey AS path, CASE l_partkey % 4 WHEN 0 THEN 'test' WHEN 1 THEN 'doc' ELSE 'source' END AS class FROM lineitem)"""
_SEEDS = "path IN ('p1', 'p2', 'p3')"
_JUDGED = f"""{_HISTORY}, n AS (SELECT commit, count(*) AS n, count(*) FILTER (WHERE class = 'source') AS inputs, count(*) FILTER (WHERE class <> 'source') AS targets FROM f GROUP BY 1),
judged AS (SELECT c.commit, time, CASE WHEN n_parents = 0 THEN 'root' WHEN n_parents > 1 THEN 'merge' WHEN c.commit IN (7, 11, 13) THEN 'design_case' WHEN coalesce(n, 0) = 0 THEN 'no_changes' WHEN n > 10 THEN 'too_many_changes' WHEN inputs = 0 THEN 'no_source_input' WHEN targets = 0 THEN 'no_target' END AS reason FROM c LEFT JOIN n USING (commit)),
eligible AS (SELECT commit, time, row_number() OVER (ORDER BY time, commit) - 1 AS eligible_index FROM judged WHERE reason IS NULL)"""


def _touched(spark, root):
    return _changes(spark, root).join(_commits(spark, root), "commit")


def _seeds(spark):
    return spark.createDataFrame([("p1",), ("p2",), ("p3",)], "path string")


def cochange(spark, root):
    return history.cochange(_touched(spark, root).select("commit", "path", "time"), _seeds(spark))


def issue_references(spark, root):
    return _commits(spark, root).select("commit", F.explode(text.issue_references(F.col("subject"))).alias("reference"))


def issue_links(spark, root):
    return history.issue_links(_changes(spark, root), issue_references(spark, root), _seeds(spark))


def _judged(spark, root):
    return evaluate.judge_commits(_commits(spark, root), _changes(spark, root), ["7", "11", "13"])


def commit_selection(spark, root):
    return evaluate.eligible(_judged(spark, root))


def rejection_histogram(spark, root):
    return evaluate.rejection_histogram(_judged(spark, root))


def even_sample(spark, root):
    return evaluate.even_sample(commit_selection(spark, root)).select("position", "commit", "eligible_index")


def _targets(spark, root):
    e = commit_selection(spark, root).select("commit")
    return _changes(spark, root).filter("class <> 'source'").join(e, "commit").select("commit", "part", "path", F.col("class").alias("kind"))


def _placed(spark, root, method: str):
    """A ranking in closed form: the target with key p stands at (p * m + commit) % 37 + 1, if that is at most 30."""
    m = {"hybrid": 5, "baseline": 11}[method]
    spot = (F.col("part") * m + F.col("commit")) % 37 + 1
    return _targets(spark, root).withColumn("position", F.when(spot <= 30, spot)).withColumn("method", F.lit(method))


def _metrics(spark, root):
    both = _placed(spark, root, "hybrid").unionByName(_placed(spark, root, "baseline"))
    return evaluate.commit_metrics(both, ["commit", "method", "kind"])


_METRICS = f"""{_JUDGED}, t AS (SELECT f.commit, part, path, class AS kind FROM f JOIN eligible USING (commit) WHERE class <> 'source'),
placed AS (SELECT *, 'hybrid' AS method, CASE WHEN (part * 5 + commit) % 37 < 30 THEN (part * 5 + commit) % 37 + 1 END AS position FROM t
  UNION ALL SELECT *, 'baseline', CASE WHEN (part * 11 + commit) % 37 < 30 THEN (part * 11 + commit) % 37 + 1 END FROM t),
metrics AS (SELECT commit, method, kind, count(*) AS n_targets, {", ".join(f"count(*) FILTER (WHERE position <= {k}) AS found{k}, count(*) FILTER (WHERE position <= {k}) * 232792560 // count(*) AS recall{k}" for k in evaluate.KS)},
  min(position) AS first_rank, CASE WHEN min(position) <= 20 THEN 232792560 // min(position) ELSE 0 END AS mrr20 FROM placed GROUP BY 1, 2, 3)"""


def recall_mrr(spark, root):
    return _metrics(spark, root)


def macro_average(spark, root):
    return evaluate.macro(_metrics(spark, root), ["method", "kind"])


def paired_difference(spark, root):
    return evaluate.macro(evaluate.paired(_metrics(spark, root), "hybrid", "baseline", ["commit", "kind"]), ["kind"])


def strata(spark, root):
    t = _targets(spark, root)
    linked = t.filter("kind = 'test' AND (part div 4) % 2 = 0")
    return evaluate.strata(t, linked).groupBy("stratum").agg(F.count("*").alias("n_targets"), F.countDistinct("commit").alias("n_commits"))


def mulberry_draws(spark, root):
    return table(spark, root, "orders").select("o_orderkey", F.round(mulberry32(SEED, F.col("o_orderkey")), 12).alias("u"))


_MUL = "(({0}) & 65535) * (({1}) & 65535) + (((((({0}) >> 16) * (({1}) & 65535)) + ((({0}) & 65535) * (({1}) >> 16))) & 65535) << 16)"


def _mul(a: str, b: str) -> str:
    return f"(({_MUL.format(a, b)}) & 4294967295)"


def draws_sql(relation: str, number: str, seed: int | str = SEED) -> str:
    """CTEs that end in ``draws``: the columns of ``relation`` and ``u``, Mulberry32 in 64-bit integers."""
    step = f"(({seed} + {_mul(f'(({number} + 1) & 4294967295)', '1831565813')}) & 4294967295)"
    t1 = _mul("xor(a, a >> 15)", "a | 1")
    t2 = f"xor(t, (t + {_mul('xor(t, t >> 7)', 't | 61')}) & 4294967295)"
    return f"m1 AS (SELECT *, {step}::BIGINT AS a FROM {relation}), m2 AS (SELECT *, {t1}::BIGINT AS t FROM m1), m3 AS (SELECT * REPLACE ({t2} AS t) FROM m2), draws AS (SELECT * EXCLUDE (a, t), xor(t, t >> 14) / 4294967296.0::DOUBLE AS u FROM m3)"


def _population(spark, root):
    d = evaluate.paired(_metrics(spark, root).filter("kind = 'test'"), "hybrid", "baseline", ["commit", "kind"])
    sample = evaluate.even_sample(commit_selection(spark, root), 200).select("commit", "position")
    rows = d.join(F.broadcast(sample), "commit")
    return rows.withColumn("member", (F.row_number().over(Window.orderBy("position")) - 1).cast("long")).select("member", "recall10", "mrr20")


_POPULATION = f"""{_METRICS}, total AS (SELECT count(*) AS n FROM eligible), spots AS (SELECT i AS position, CASE WHEN n <= 200 THEN i ELSE i * n // 200 END AS eligible_index FROM range(200) r(i), total),
pop AS (SELECT row_number() OVER (ORDER BY position) - 1 AS member, h.recall10 - b.recall10 AS recall10, h.mrr20 - b.mrr20 AS mrr20 FROM spots JOIN eligible USING (eligible_index)
  JOIN metrics h ON h.commit = eligible.commit AND h.method = 'hybrid' AND h.kind = 'test' JOIN metrics b ON b.commit = h.commit AND b.method = 'baseline' AND b.kind = 'test'),
size AS (SELECT count(*) AS m FROM pop), numbers AS (SELECT i // m AS replicate, i, m FROM size, range((SELECT 10000 * m FROM size)) r(i)), seeds AS (SELECT unnest([{SEED}, {SECOND_SEED}]) AS seed), seeded AS (SELECT * FROM numbers, seeds)"""
_SUMS = f"{_POPULATION}, {draws_sql('seeded', 'i', 'seed')}, sums AS (SELECT seed, replicate, sum(recall10)::BIGINT AS recall10, sum(mrr20)::BIGINT AS mrr20 FROM draws JOIN pop ON member = floor(u * m)::BIGINT GROUP BY 1, 2)"


def _both_seeds(spark, root):
    """The population, and its replicate sums by either seed."""
    population = cut_lineage(_population(spark, root))
    each = [evaluate.replicate_sums(population, ["recall10", "mrr20"], seed).withColumn("seed", F.lit(seed).cast("long")) for seed in (SEED, SECOND_SEED)]
    return population, each[0].unionByName(each[1])


def bootstrap_sums(spark, root):
    return _both_seeds(spark, root)[1].select("seed", "replicate", "recall10", "mrr20")


def bootstrap_ci(spark, root):
    population, sums = _both_seeds(spark, root)
    return evaluate.interval(sums, "recall10", population.count(), by=["seed"]).select("seed", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"))


def decision(spark, root):
    """The rule over a grid of populations, sums and interval signs."""
    grid = spark.range(2 * 4 * 3 * 3 * 3 * 3).select(
        (F.col("id") % 2 == 1).alias("incomplete_run"), F.array(F.lit(5), F.lit(20), F.lit(47), F.lit(50))[(F.col("id") / 2 % 4).cast("int")].cast("long").alias("population"),
        *[((F.floor(F.col("id") / d) % 3) - 1).alias(n) for n, d in (("a", 8), ("b", 24), ("c", 72), ("z", 216))],
    )
    whole = F.col("population") * F.lit(evaluate.SCALE).cast("long")
    rows = grid.select(
        "incomplete_run", "population", (F.col("a") * whole / 8).cast("long").alias("sibling_sum"), (F.col("z") * 0.25 - 0.1).alias("sibling_lower"), (F.col("z") * 0.25 + 0.1).alias("sibling_upper"),
        (F.col("b") * whole / 10).cast("long").alias("deterministic_sum"), (F.col("b") * 0.2 - 0.1).alias("deterministic_lower"), (F.col("b") * 0.2 + 0.1).alias("deterministic_upper"),
        (F.col("c") * whole / 15).cast("long").alias("semantic_sum"), (F.col("c") * 0.2 - 0.1).alias("semantic_lower"), (F.col("c") * 0.2 + 0.1).alias("semantic_upper"),
    )
    return evaluate.decide(rows).groupBy("rule", "outcome").agg(F.count("*").alias("n"))


def sibling_tests(spark, root):
    """Tests named after the code files of each repository."""
    rows = table(spark, root, "artifact").filter("kind = 'code' AND path IS NOT NULL").select("repository_id", "path").distinct()
    test = F.col("path").contains(".test.") | F.col("path").contains(".spec.")
    return evaluate.sibling_tests(rows.filter(~test), rows.filter(test), ["repository_id"])


_SIBLING = """WITH a AS (SELECT DISTINCT repository_id AS r, path FROM artifact WHERE kind = 'code' AND path IS NOT NULL),
i AS (SELECT r, path, row_number() OVER (PARTITION BY r ORDER BY path) - 1 AS input_index, regexp_extract(path, '^(.*)/[^/]*$', 1) AS d, regexp_extract(path, '[^/]*$') AS b FROM a WHERE path NOT LIKE '%.test.%' AND path NOT LIKE '%.spec.%'),
s AS (SELECT *, CASE WHEN regexp_extract(b, '^(.+)\\.[^.]*$', 1) = '' THEN b ELSE regexp_extract(b, '^(.+)\\.[^.]*$', 1) END AS s, regexp_extract(d, '[^/]*$') AS folder FROM i),
t AS (SELECT r, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS d, regexp_extract(path, '[^/]*$') AS b FROM a WHERE path LIKE '%.test.%' OR path LIKE '%.spec.%'),
o AS (SELECT s.r, t.path, input_index, CASE WHEN t.d = s.d AND (starts_with(t.b, s || '.test.') OR starts_with(t.b, s || '.spec.')) THEN 1
  WHEN t.d = CASE WHEN s.d = '' THEN '__tests__' ELSE s.d || '/__tests__' END AND starts_with(t.b, s || '.') THEN 2
  WHEN starts_with(t.b, s || '.test.') OR starts_with(t.b, s || '.spec.') OR (s = 'index' AND s.d <> '' AND (starts_with(t.b, folder || '.test.') OR starts_with(t.b, folder || '.spec.'))) THEN 3 END AS tier FROM s JOIN t ON t.r = s.r),
b AS (SELECT r, path, min((tier, input_index)) AS k FROM o WHERE tier IS NOT NULL GROUP BY 1, 2)
SELECT r AS repository_id, path, k[1] AS tier, k[2] AS input_index, row_number() OVER (PARTITION BY r ORDER BY k[1], k[2], path) AS rank FROM b QUALIFY rank <= 20"""


def ranking_violations(spark, root):
    rows = table(spark, root, "orders").select(
        (F.col("o_custkey") % 50).alias("list"), F.when(F.col("o_orderkey") % 501 == 0, 0).otherwise(F.row_number().over(Window.partitionBy(F.col("o_custkey") % 50).orderBy("o_orderkey"))).alias("rank"),
        (F.col("o_orderkey") - F.when(F.col("o_orderkey") % 700 == 1, 50).otherwise(0)).alias("version_id"), F.col("o_orderkey").cast("string").alias("path"),
    )
    return validate.ranking_violations(rows, ["list"])


def referential_checks(spark, root):
    t = lambda n: table(spark, root, n)
    return validate.referential_checks(
        {
            "version without artifact": (t("artifact_version"), "artifact_id", t("artifact"), "id"),
            "version without snapshot": (t("artifact_version"), "snapshot_id", t("repository_snapshot"), "id"),
            "version without content": (t("artifact_version").withColumn("content_sha256", F.lower("content_sha256")), "content_sha256", t("content"), "sha256"),
            "chunk without embedding": (t("semantic_chunk"), "input_hash", t("semantic_embedding"), "input_hash"),
            "order without customer": (t("orders"), "o_custkey", t("customer"), "c_custkey"),
        }
    )


def identity_conflicts(spark, root):
    """Paths that stand for several artifacts of a repository if letter case is left out."""
    rows = table(spark, root, "artifact").select("repository_id", F.lower("path").alias("path"), "id")
    return validate.identity_conflicts(rows, ["repository_id", "path"], "id")


def content_integrity(spark, root):
    return validate.content_integrity(table(spark, root, "content"))


def content_digest(spark, root):
    return table_digest(table(spark, root, "content"), ["sha256"])


def _claims(spark, root):
    """A statement with its citations for each artifact, of a form by its id."""
    n = F.col("id")
    rows = table(spark, root, "artifact").dropDuplicates(["id"])
    pick = lambda values: F.array(*[F.lit(v) for v in values])[(n % len(CLAIMS)).cast("int")]
    listed = lambda c: F.when(c != "", F.array(c)).otherwise(F.array().cast("array<string>"))
    name = F.concat(F.lit("holder"), n.cast("string"))
    return rows.select(
        "id", F.replace(pick([c[0] for c in CLAIMS]), F.lit("HOLDER"), name).alias("statement"), F.lit("Fix the reservation lock").alias("description"), F.array(F.concat(F.lit("src/m"), (n % 7).cast("string"), F.lit("/"), name, F.lit(".ts"))).alias("changed_paths"),
        F.lit("src/other/file.ts").alias("candidate_path"), listed(pick([c[1] for c in CLAIMS])).alias("candidate_is"), listed(pick([c[2] for c in CLAIMS])).alias("chunk_texts"),
        F.array(F.concat(F.lit("import { release } from './"), name, F.lit("';"))).alias("declaration_texts"), F.when(pick([c[3] for c in CLAIMS]) != "", F.array(pick([c[3] for c in CLAIMS]))).alias("matched_terms"),
    )


def grounding_guards(spark, root):
    """Statements that their citations do not carry, each guard failing for some."""
    return grounding.grounding_problems(_claims(spark, root)).select("id", "problem")


#: Forms of statements: text, ends of cited edges, text of a cited chunk, a matched term, and the problem, if any.
CLAIMS = (
    ("The candidate imports HOLDER.ts.", "target", "", "", "import-direction"), ("The candidate imports HOLDER.ts.", "source", "", "", ""), ("The changed file imports it.", "source", "", "", "import-direction"),
    ("It does not import HOLDER.js.", "source", "", "", "import-denied"), ("It calls `release`.", "source", "", "", "symbol-only-imported"), ("It calls `release`, but imports nothing.", "source", "release();", "", ""),
    ("It uses the helper 'settle'.", "source", "", "", "symbol-not-shown"), ("It holds three unit tests.", "source", "", "", "test-count"), ("It holds three unit tests.", "source", "it();", "", ""),
    ("The file mentions 'reservation'.", "", "", "", "term-not-recorded"), ("The file mentions 'reservation'.", "", "", "reservation", ""), ("It does not contain 'lock'.", "", "", "lock", "term-matched"),
    ("The description does not mention 'lock'.", "", "", "lock", ""), ("It depends on HOLDER.ts.", "target", "", "", ""),
)


QUERIES = {
    f.__name__: f
    for f in (
        cochange, issue_references, issue_links, commit_selection, rejection_histogram, even_sample, recall_mrr, macro_average, paired_difference, strata, mulberry_draws, bootstrap_sums, bootstrap_ci, decision, sibling_tests,
        ranking_violations, referential_checks, identity_conflicts, content_integrity, content_digest, grounding_guards,
    )
}
_MACRO = "count(*) AS population, " + ", ".join(f"sum({m})::BIGINT AS {m}_sum" for m in evaluate.METRICS)
SQL = {
    "cochange": f"WITH {_HISTORY}, s AS (SELECT DISTINCT commit FROM f WHERE {_SEEDS}), k AS (SELECT path, count(DISTINCT commit) AS n_commits, max(time) AS latest FROM f JOIN s USING (commit) JOIN c USING (commit) WHERE NOT {_SEEDS} GROUP BY 1) SELECT *, row_number() OVER (ORDER BY n_commits DESC, latest DESC, path) AS rank FROM k",
    "issue_references": f"WITH {_HISTORY} SELECT commit, reference::VARCHAR AS reference FROM c",
    "issue_links": f"WITH {_HISTORY}, s AS (SELECT DISTINCT reference FROM f JOIN c USING (commit) WHERE {_SEEDS}), k AS (SELECT path, count(DISTINCT reference) AS n_references FROM f JOIN c USING (commit) WHERE reference IN (SELECT reference FROM s) AND NOT {_SEEDS} GROUP BY 1) SELECT *, row_number() OVER (ORDER BY n_references DESC, path) AS rank FROM k",
    "commit_selection": f"WITH {_JUDGED} SELECT * FROM eligible",
    "rejection_histogram": f"WITH {_JUDGED} SELECT coalesce(reason, 'eligible') AS reason, count(*) AS n_commits FROM judged GROUP BY 1",
    "even_sample": f"WITH {_JUDGED}, total AS (SELECT count(*) AS n FROM eligible) SELECT i AS position, commit, eligible_index FROM range(50) r(i), total JOIN eligible ON eligible_index = CASE WHEN n <= 50 THEN i ELSE i * n // 50 END",
    "recall_mrr": f"WITH {_METRICS} SELECT * FROM metrics",
    "macro_average": f"WITH {_METRICS} SELECT method, kind, {_MACRO} FROM metrics GROUP BY 1, 2",
    "paired_difference": f"WITH {_METRICS}, d AS (SELECT h.commit, h.kind, {', '.join(f'h.{m} - b.{m} AS {m}' for m in evaluate.METRICS)} FROM metrics h JOIN metrics b ON b.commit = h.commit AND b.kind = h.kind AND b.method = 'baseline' WHERE h.method = 'hybrid') SELECT kind, {_MACRO} FROM d GROUP BY 1",
    "strata": f"WITH {_METRICS}, x AS (SELECT commit, unnest(CASE WHEN kind = 'doc' THEN ['doc'] WHEN (part // 4) % 2 = 0 THEN ['test', 'test-with-link'] ELSE ['test', 'test-without-link'] END) AS stratum FROM t) SELECT stratum, count(*) AS n_targets, count(DISTINCT commit) AS n_commits FROM x GROUP BY 1",
    "mulberry_draws": f"WITH {draws_sql('orders', 'o_orderkey')} SELECT o_orderkey, round(u, 12) AS u FROM draws",
    "bootstrap_sums": f"WITH {_SUMS} SELECT * FROM sums",
    "bootstrap_ci": f"WITH {_SUMS} SELECT seed, round(quantile_cont(recall10, 0.025) / (232792560.0::DOUBLE * (SELECT m FROM size)), 6) AS lower, round(quantile_cont(recall10, 0.975) / (232792560.0::DOUBLE * (SELECT m FROM size)), 6) AS upper FROM sums GROUP BY 1",
    "decision": """WITH g AS (SELECT id % 2 = 1 AS inc, [5, 20, 47, 50][(id // 2) % 4 + 1] AS p, (id // 8) % 3 - 1 AS a, (id // 24) % 3 - 1 AS b, (id // 72) % 3 - 1 AS c, (id // 216) % 3 - 1 AS z FROM range(648) r(id)),
      e AS (SELECT inc, p, a >= 1 AS tenth, z >= 1 AS above, b <= -1 OR (c <= -1) AS base, a <= -1 AND z <= -1 AS worse FROM g),
      d AS (SELECT CASE WHEN inc THEN 'incomplete-run' WHEN p < 20 THEN 'minimum-test-targets' WHEN worse THEN 'negative-sibling' WHEN base AND NOT above THEN 'negative-baseline' WHEN tenth AND above AND NOT base THEN 'supported' WHEN above AND NOT tenth THEN 'mixed-small-effect' WHEN tenth AND above AND base THEN 'mixed-baseline' ELSE 'none-applies' END AS rule FROM e)
      SELECT rule, CASE WHEN rule LIKE 'negative%' THEN 'negative' WHEN rule = 'supported' THEN 'supported' WHEN rule LIKE 'mixed%' THEN 'mixed' ELSE 'inconclusive' END AS outcome, count(*) AS n FROM d GROUP BY 1""",
    "sibling_tests": _SIBLING,
    "ranking_violations": """WITH r AS (SELECT o_custkey % 50 AS list, CASE WHEN o_orderkey % 501 = 0 THEN 0 ELSE row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) END AS rank, o_orderkey - CASE WHEN o_orderkey % 700 = 1 THEN 50 ELSE 0 END AS version_id FROM orders)
      SELECT list, (count(*) FILTER (WHERE rank < 1))::BIGINT AS n_invalid_ranks, count(*) - count(DISTINCT rank) AS n_repeated_ranks, count(*) - count(DISTINCT version_id) AS n_repeated_versions, 0::BIGINT AS n_repeated_paths FROM r GROUP BY 1
      HAVING count(*) FILTER (WHERE rank < 1) > 0 OR count(*) <> count(DISTINCT rank) OR count(*) <> count(DISTINCT version_id)""",
    "referential_checks": """SELECT 'version without artifact' AS "check", count(*) AS n_violations FROM artifact_version WHERE artifact_id NOT IN (SELECT id FROM artifact)
      UNION ALL SELECT 'version without snapshot', count(*) FROM artifact_version WHERE snapshot_id NOT IN (SELECT id FROM repository_snapshot)
      UNION ALL SELECT 'version without content', count(*) FROM artifact_version WHERE lower(content_sha256) NOT IN (SELECT sha256 FROM content)
      UNION ALL SELECT 'chunk without embedding', count(*) FROM semantic_chunk WHERE input_hash NOT IN (SELECT input_hash FROM semantic_embedding)
      UNION ALL SELECT 'order without customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)""",
    "grounding_guards": f"SELECT * FROM (SELECT DISTINCT id, [{', '.join(f"'{c[4]}'" for c in CLAIMS)}][id % {len(CLAIMS)} + 1] AS problem FROM artifact) WHERE problem <> ''",
    "identity_conflicts": "SELECT repository_id, lower(path) AS path, count(DISTINCT id) AS n_identities FROM artifact GROUP BY 1, 2 HAVING count(DISTINCT id) > 1",
    "content_integrity": "SELECT count(*) AS n_contents, count(*) FILTER (WHERE sha256(text) <> lower(sha256)) AS n_wrong_digest, count(*) FILTER (WHERE strlen(text) <> byte_length) AS n_wrong_length FROM content",
}
