"""Queries on the assembly of an evaluation over a workload in closed form, with their SQL.

Thirty commits: commit i changes src/m{i}.ts, with targets test/m{i}.test.ts (linked if i is even), docs/m{i}.md if 3 divides i, and
test/n{i}.test.ts if 5 divides i. Each method places the k-th target at a rank in closed form, among thirty other files.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewake.operators import assemble, evaluate, validate
from tracewake.plans.evaluation_queries import SECOND_SEED, SEED, draws_sql

COMMITS, OTHERS = 30, 30


def _cases(spark):
    return spark.range(COMMITS).select(F.col("id").alias("commit"), F.col("id").alias("position"), (F.col("id") % 11 != 10).alias("links_known"))


def _targets(spark):
    i = F.col("id")
    name = lambda head, tail: F.concat(F.lit(head), i.cast("string"), F.lit(tail))
    each = F.array_compact(
        F.array(
            F.when(i % 3 == 0, F.struct(name("docs/m", ".md").alias("path"), F.lit("doc").alias("kind"))), F.struct(name("test/m", ".test.ts").alias("path"), F.lit("test").alias("kind")),
            F.when(i % 5 == 0, F.struct(name("test/n", ".test.ts").alias("path"), F.lit("test").alias("kind"))),
        )
    )
    return spark.range(COMMITS).select(i.alias("commit"), F.inline(each))


def _linked(targets):
    return targets.filter("commit % 2 = 0 AND path LIKE 'test/m%'").select("commit", "path")


def _failures(spark, scenario: str):
    """Of the scenario with failures: retrieval fails for commit 7, the description arm for commit 8, and commit 9 was never prepared."""
    rows = [] if scenario == "complete" else [(7, "semantic", "retrieval"), (8, "no-description", "retrieval"), *[(9, m, "preparation") for m in assemble.METHODS]]
    return spark.createDataFrame(rows, "commit long, method string, stage string")


def _rankings(spark, targets):
    """Whole rankings with the input in front, from which it is removed before places are given."""
    order = F.row_number().over(Window.partitionBy("commit").orderBy("path"))
    among_tests = F.row_number().over(Window.partitionBy("commit", "kind").orderBy("path"))
    t = targets.withColumn("k", order).withColumn("kt", among_tests)
    place = {
        "hybrid": F.col("k"), "deterministic": F.col("k") + 3, "semantic": F.when(F.col("commit") % 2 == 1, F.col("k") + 2).otherwise(F.col("k") + 11), "sibling": F.when(F.col("kind") == "test", F.col("kt") + 20), "no-description": F.col("k") + 5,
    }
    placed = t.select("commit", "path", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), p.cast("int").alias("at")) for m, p in place.items()])).alias("p")).select("commit", "path", "p.method", "p.at").filter("at IS NOT NULL")
    taken = placed.groupBy("commit", "method").agg(F.collect_set("at").alias("taken"))
    free = F.array_except(F.sequence(F.lit(1), F.lit(OTHERS) + F.size("taken")), "taken")
    others = taken.select("commit", "method", F.posexplode(free).alias("n", "at")).select("commit", F.concat(F.lit("other/f"), F.col("n").cast("string"), F.lit(".ts")).alias("path"), "method", "at")
    inputs = spark.range(COMMITS).select(F.col("id").alias("commit"), F.concat(F.lit("src/m"), F.col("id").cast("string"), F.lit(".ts")).alias("path"))
    first = taken.select("commit", "method").join(inputs, "commit").select("commit", "path", "method", F.lit(0).alias("at"))
    ranked = placed.unionByName(others).unionByName(first).withColumn("rank", F.col("at") + 1)
    return evaluate.scored_ranking(ranked, inputs, ["commit", "method"], depth=10**6).select("commit", "method", "path", "position")


def _assembled(spark, scenario: str):
    cases, targets = _cases(spark), _targets(spark)
    status = assemble.method_cases(cases, _failures(spark, scenario))
    ranks = assemble.target_ranks(targets, status, _rankings(spark, targets))
    return cases, status, ranks, assemble.stratum_metrics(ranks, assemble.memberships(cases, targets, _linked(targets)))


def assembly_cases(spark, root):
    """Status of every method of every case, and where it placed the targets."""
    _, status, ranks, _ = _assembled(spark, "failures")
    return status.join(ranks.select("commit", "method", "path", "position"), ["commit", "method"], "left").select("commit", "method", "status", "path", "position")


def assembly_metrics(spark, root):
    return _assembled(spark, "failures")[3]


def _columns(found):
    return found.select("stratum", "series", "population", *[f"{m}_sum" for m in evaluate.METRICS], *[F.round(f"{m}_{e}", 9).alias(f"{m}_{e}") for m in evaluate.METRICS for e in ("lower", "upper")])


def assembly_primary(spark, root):
    """Macro values and intervals of four methods and three differences in every stratum."""
    cases, status, _, metrics = _assembled(spark, "complete")
    return _columns(assemble.primary(metrics, status, cases, SEED))


def assembly_sensitivity(spark, root):
    """With and without descriptions, over the commits on which both ran."""
    cases, status, _, metrics = _assembled(spark, "failures")
    return _columns(assemble.sensitivity(metrics, status, cases, SECOND_SEED))


def assembly_checks(spark, root):
    """Statistics some of which were altered: the checks name each."""
    cases, status, _, metrics = _assembled(spark, "complete")
    found = assemble.primary(metrics, status, cases, SEED)
    at = lambda stratum, series: (F.col("stratum") == stratum) & (F.col("series") == series)
    change = {"population": (at("doc", "hybrid"), F.col("population") + 1), "recall3_sum": (at("test", "semantic"), F.col("recall3_sum") + 1), "mrr20_lower": (at("test", "hybrid - sibling"), F.col("mrr20_upper") + 1), "recall5_sum": (at("doc", "hybrid - semantic"), F.lit(evaluate.SCALE).cast("long") * 1000)}
    for column, (where, value) in change.items():
        found = found.withColumn(column, F.when(where, value).otherwise(F.col(column)))
    return validate.results_violations(found, metrics, evaluate.SCALE)


def assembly_decision(spark, root):
    """The decision of both scenarios."""
    out = None
    for scenario in ("complete", "failures"):
        cases, status, _, metrics = _assembled(spark, scenario)
        found = assemble.outcome(assemble.primary(metrics, status, cases, SEED), COMMITS, spark).select(F.lit(scenario).alias("scenario"), "rule", "outcome")
        out = found if out is None else out.unionByName(found)
    return out


QUERIES = {f.__name__: f for f in (assembly_cases, assembly_metrics, assembly_primary, assembly_sensitivity, assembly_checks, assembly_decision)}

_WORK = f"""c AS (SELECT i AS commit, i % 11 <> 10 AS links_known FROM range({COMMITS}) r(i)),
t0 AS (SELECT commit, links_known, unnest([x for x in [CASE WHEN commit % 3 = 0 THEN {{'path': 'docs/m' || commit || '.md', 'kind': 'doc'}} END, {{'path': 'test/m' || commit || '.test.ts', 'kind': 'test'}}, CASE WHEN commit % 5 = 0 THEN {{'path': 'test/n' || commit || '.test.ts', 'kind': 'test'}} END] if x IS NOT NULL]) AS x FROM c),
t AS (SELECT commit, links_known, x.path AS path, x.kind AS kind, row_number() OVER (PARTITION BY commit ORDER BY x.path) AS k, row_number() OVER (PARTITION BY commit, x.kind ORDER BY x.path) AS kt FROM t0),
methods AS (SELECT unnest(['hybrid', 'deterministic', 'semantic', 'sibling', 'no-description']) AS method)"""


def _status(scenario: str) -> str:
    rule = "'succeeded'" if scenario == "complete" else "CASE WHEN commit = 9 THEN 'not_run' WHEN (commit = 7 AND method = 'semantic') OR (commit = 8 AND method = 'no-description') THEN 'failed' ELSE 'succeeded' END"
    return f"""{_WORK}, status AS (SELECT commit, method, {rule} AS status FROM c, methods),
ranks AS (SELECT t.*, method, CASE method WHEN 'hybrid' THEN k WHEN 'deterministic' THEN 3 + k WHEN 'semantic' THEN CASE WHEN commit % 2 = 1 THEN 2 + k ELSE 11 + k END WHEN 'sibling' THEN CASE WHEN kind = 'test' THEN 20 + kt END ELSE 5 + k END AS position FROM t JOIN status USING (commit) WHERE status = 'succeeded'),
s AS (SELECT *, unnest(CASE WHEN kind = 'doc' THEN ['doc'] WHEN NOT links_known THEN ['test'] WHEN commit % 2 = 0 AND path LIKE 'test/m%' THEN ['test', 'test-with-link'] ELSE ['test', 'test-without-link'] END) AS stratum FROM ranks),
metrics AS (SELECT commit, method, stratum, count(*) AS n_targets, {", ".join(f"count(*) FILTER (WHERE position <= {k}) AS found{k}, count(*) FILTER (WHERE position <= {k}) * 232792560 // count(*) AS recall{k}" for k in evaluate.KS)},
  min(position) AS first_rank, CASE WHEN min(position) <= 20 THEN 232792560 // min(position) ELSE 0 END AS mrr20 FROM s GROUP BY 1, 2, 3)"""


def _statistics(scenario: str, methods: tuple[str, ...], compared: tuple[str, ...], seed: int, population: str) -> str:
    listed = ", ".join(f"'{m}'" for m in methods)
    differences = "".join(f" UNION ALL SELECT a.stratum, a.commit, '{methods[0]} - {o}', {', '.join(f'a.{m} - b.{m}' for m in evaluate.METRICS)} FROM used a JOIN used b USING (stratum, commit) WHERE a.method = '{methods[0]}' AND b.method = '{o}'" for o in compared)
    order = "CASE stratum " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(assemble.STRATA)) + " END"
    ends = ", ".join(f"round(quantile_cont({m}, {q}) / (any_value(population) * 232792560.0::DOUBLE), 9) AS {m}_{e}" for m in evaluate.METRICS for e, q in (("lower", 0.025), ("upper", 0.975)))
    return f"""WITH {_status(scenario)}, used AS (SELECT * FROM metrics WHERE method IN ({listed}) AND {population}),
series AS (SELECT stratum, commit, method AS series, {", ".join(evaluate.METRICS)} FROM used{differences}),
members AS (SELECT stratum, commit, row_number() OVER (PARTITION BY stratum ORDER BY commit) - 1 AS member FROM (SELECT DISTINCT stratum, commit FROM used)),
sizes AS (SELECT stratum, count(*) AS m FROM members GROUP BY 1), starts AS (SELECT *, coalesce(sum(m * 10000) OVER (ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM sizes),
numbers AS (SELECT stratum, m, j // m AS replicate, start + j AS id FROM (SELECT stratum, m, start, unnest(range(m * 10000)) AS j FROM starts)), {draws_sql("numbers", "id", seed)},
drawn AS (SELECT stratum, replicate, floor(u * m)::BIGINT AS member FROM draws), valued AS (SELECT * FROM series JOIN members USING (stratum, commit)),
sums AS (SELECT stratum, series, replicate, {", ".join(f"sum({m})::BIGINT AS {m}" for m in evaluate.METRICS)} FROM drawn JOIN valued USING (stratum, member) GROUP BY 1, 2, 3),
point AS (SELECT stratum, series, count(*) AS population, {", ".join(f"sum({m})::BIGINT AS {m}_sum" for m in evaluate.METRICS)} FROM series GROUP BY 1, 2),
bounds AS (SELECT stratum, series, {ends} FROM sums JOIN point USING (stratum, series) GROUP BY 1, 2)
SELECT * FROM point JOIN bounds USING (stratum, series)"""


SQL = {
    "assembly_cases": f"WITH {_status('failures')} SELECT s.commit, s.method, s.status, r.path, r.position FROM status s LEFT JOIN ranks r ON r.commit = s.commit AND r.method = s.method",
    "assembly_metrics": f"WITH {_status('failures')} SELECT * FROM metrics",
    "assembly_primary": _statistics("complete", ("hybrid", *assemble.BASELINES), assemble.BASELINES, SEED, "true"),
    "assembly_sensitivity": _statistics("failures", ("hybrid", "no-description"), ("no-description",), SECOND_SEED, "commit NOT IN (8, 9)"),
    "assembly_checks": "SELECT * FROM (VALUES ('doc', 'hybrid', 'the population is another'), ('test', 'semantic', 'a sum is another'), ('test', 'hybrid - sibling', 'an interval ends before it begins'), ('doc', 'hybrid - semantic', 'a sum exceeds the population')) v(stratum, series, problem)",
    "assembly_decision": "SELECT 'complete' AS scenario, 'supported' AS rule, 'supported' AS outcome UNION ALL SELECT 'failures', 'incomplete-run', 'inconclusive'",
}
