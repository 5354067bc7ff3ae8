"""Commit selection, exact retrieval metrics, bootstrap intervals and the decision."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewake.functions import paths
from tracewake.functions.random import mulberry32

#: Fixed values of the evaluation protocol.
SCALE = 232_792_560
KS = (3, 5, 10, 20)
DEPTH = 20
MAX_CHANGES = 10
SAMPLE = 50
REPLICATES = 10_000
MIN_POPULATION = 20
METRICS = ("recall3", "recall5", "recall10", "recall20", "mrr20")


def judge_commits(commits: DataFrame, changes: DataFrame, design_cases: list[str] | None = None, most: int = MAX_CHANGES) -> DataFrame:
    """``commit, time, reason``: the first rule that a commit fails, null if it is eligible.

    ``commits`` has ``commit, time, n_parents``; ``changes`` has ``commit, path, class``, the class being that of the path in the base or null.
    """
    seen = changes.groupBy("commit").agg(F.count("*").alias("n"), F.count_if(F.col("class") == "source").alias("inputs"), F.count_if(F.col("class").isin("test", "doc")).alias("targets"))
    rows = commits.join(seen, "commit", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    reason = F.when(F.col("n_parents") == 0, "root").when(F.col("n_parents") > 1, "merge")
    if design_cases:
        reason = reason.when(F.col("commit").cast("string").isin([str(c) for c in design_cases]), "design_case")
    reason = reason.when(n("n") == 0, "no_changes").when(n("n") > most, "too_many_changes").when(n("inputs") == 0, "no_source_input").when(n("targets") == 0, "no_target")
    return rows.select("commit", "time", reason.alias("reason"))


def rejection_histogram(judged: DataFrame) -> DataFrame:
    return judged.groupBy(F.coalesce("reason", F.lit("eligible")).alias("reason")).agg(F.count("*").alias("n_commits"))


def eligible(judged: DataFrame) -> DataFrame:
    """Adds ``eligible_index`` from 0 by time and commit.

    Counts by day come first, so that only ordering within a day is a sort and no task holds the history.
    """
    rows = judged.filter("reason IS NULL").withColumn("day", F.to_date("time"))
    before = rows.groupBy("day").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1))).select("day", F.coalesce("before", F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("day").orderBy("time", "commit"))
    return rows.join(before, "day").select("commit", "time", (F.col("before") + inside - 1).cast("long").alias("eligible_index"))


def even_sample(rows: DataFrame, size: int = SAMPLE) -> DataFrame:
    """Rows at floor(i * n / size) for i below ``size``, or all if there are no more; adds ``position``."""
    n = rows.agg(F.count("*").alias("total"))
    spots = rows.sparkSession.range(size).crossJoin(F.broadcast(n)).select(
        F.col("id").alias("position"), F.when(F.col("total") <= size, F.col("id")).otherwise(F.floor(F.col("id") * F.col("total") / F.lit(size))).cast("long").alias("eligible_index")
    )
    return rows.join(F.broadcast(spots), "eligible_index")


def scored_ranking(ranked: DataFrame, inputs: DataFrame, by: list[str], depth: int = DEPTH) -> DataFrame:
    """The first ``depth`` of each ranking after its inputs are removed, with ``position`` from 1."""
    left = ranked.join(inputs.select(*[c for c in by if c in inputs.columns], "path").distinct(), [*[c for c in by if c in inputs.columns], "path"], "left_anti")
    return left.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy("rank"))).filter(F.col("position") <= depth)


def positions(targets: DataFrame, ranking: DataFrame, by: list[str]) -> DataFrame:
    """Targets with their ``position``, null if they are not ranked."""
    return targets.join(ranking.select(*by, "path", "position"), [*by, "path"], "left")


def commit_metrics(placed: DataFrame, by: list[str]) -> DataFrame:
    """Found counts, first rank, and each metric times SCALE as an exact integer; missing targets stay in the denominator."""
    hit = lambda k: F.count_if(F.coalesce(F.col("position") <= k, F.lit(False)))
    rows = placed.groupBy(*by).agg(F.count("*").alias("n_targets"), *[hit(k).alias(f"found{k}") for k in KS], F.min("position").alias("first_rank"))
    exact = lambda top, bottom: F.when(top % bottom == 0, F.expr("0") + (top - top % bottom) / bottom).otherwise(F.raise_error(F.lit("a quotient is not whole")).cast("double")).cast("long")
    for k in KS:
        rows = rows.withColumn(f"recall{k}", exact(F.col(f"found{k}") * F.lit(SCALE), F.col("n_targets")))
    return rows.withColumn("mrr20", F.when(F.col("first_rank") <= DEPTH, exact(F.lit(SCALE).cast("long"), F.col("first_rank"))).otherwise(F.lit(0).cast("long")))


def macro(metrics: DataFrame, by: list[str], names=METRICS) -> DataFrame:
    """Exact sums and population of each group: the average is sum / (SCALE * population)."""
    return metrics.groupBy(*by).agg(F.count("*").alias("population"), *[F.sum(m).alias(f"{m}_sum") for m in names])


def paired(metrics: DataFrame, method: str, baseline: str, by: list[str], names=METRICS) -> DataFrame:
    """Per-commit differences of two methods over commits that both have."""
    a = metrics.filter(F.col("method") == method).select(*by, *[F.col(m).alias(f"a_{m}") for m in names])
    b = metrics.filter(F.col("method") == baseline).select(*by, *[F.col(m).alias(f"b_{m}") for m in names])
    return a.join(b, by).select(*by, *[(F.col(f"a_{m}") - F.col(f"b_{m}")).alias(m) for m in names])


def strata(targets: DataFrame, linked: DataFrame) -> DataFrame:
    """Targets (``commit, path, kind``) once for each stratum they are in; ``linked`` has ``commit, path``."""
    flagged = targets.join(linked.select("commit", "path").distinct().withColumn("linked", F.lit(True)), ["commit", "path"], "left")
    names = F.when(F.col("kind") == "doc", F.array(F.lit("doc"))).otherwise(F.array(F.lit("test"), F.when(F.coalesce("linked", F.lit(False)), "test-with-link").otherwise("test-without-link")))
    return flagged.select("commit", "path", "kind", F.explode(names).alias("stratum"))


def replicate_sums(population: DataFrame, values: list[str], seed: int, replicates: int = REPLICATES, offset: int = 0) -> DataFrame:
    """``replicate`` and the sum of each value over its draws, with replacement, from ``population`` (``member`` from 0).

    Draw j of replicate r is number offset + r * m + j of one generator; as draws depend on their number only, they are made in parallel.
    The population of an evaluation is a few hundred commits; its size is asked first, and one beyond a million is joined rather than broadcast.
    """
    m = population.count()
    if m == 0:
        raise ValueError("an empty population has no replicates")
    spark = population.sparkSession
    draws = spark.range(replicates * m).select(
        F.floor(F.col("id") / F.lit(m)).cast("long").alias("replicate"), F.floor(mulberry32(seed, F.col("id") + F.lit(offset)) * F.lit(m)).cast("long").alias("member")
    )
    side = population.select("member", *values)
    return draws.join(F.broadcast(side) if m <= 1_000_000 else side, "member").groupBy("replicate").agg(*[F.sum(v).alias(v) for v in values])


def interval(sums: DataFrame, value: str, population: int, low: float = 0.025, high: float = 0.975, by: list[str] | None = None) -> DataFrame:
    """Linear-interpolation percentiles of the replicate sums as averages."""
    d = F.lit(float(SCALE) * population)
    return sums.groupBy(*(by or [])).agg((F.percentile(value, F.lit(low)) / d).alias("lower"), (F.percentile(value, F.lit(high)) / d).alias("upper"))


def decide(evidence: DataFrame) -> DataFrame:
    """``outcome, rule`` of one row with ``incomplete_run, population`` and for each of sibling, deterministic, semantic its ``_sum, _lower, _upper``.

    At least a tenth: 10 * sum >= SCALE * population. Materially worse: 20 * sum <= -SCALE * population and the interval below zero.
    """
    whole = F.lit(SCALE).cast("long") * F.col("population")
    worse = lambda b: (F.col(f"{b}_sum") * 20 <= -whole) & (F.col(f"{b}_upper") < 0)
    tenth, above = F.col("sibling_sum") * 10 >= whole, F.col("sibling_lower") > 0
    baseline = worse("deterministic") | worse("semantic")
    rule = (
        F.when(F.col("incomplete_run"), "incomplete-run").when(F.col("population") < MIN_POPULATION, "minimum-test-targets").when(worse("sibling"), "negative-sibling").when(baseline & ~above, "negative-baseline")
        .when(tenth & above & ~baseline, "supported").when(above & ~tenth, "mixed-small-effect").when(tenth & above & baseline, "mixed-baseline").otherwise("none-applies")
    )
    outcome = F.when(rule.startswith("negative"), "negative").when(rule == "supported", "supported").when(rule.startswith("mixed"), "mixed").otherwise("inconclusive")
    return evidence.select("*", rule.alias("rule"), outcome.alias("outcome"))


def sibling_tests(inputs: DataFrame, tests: DataFrame, by: list[str], depth: int = DEPTH) -> DataFrame:
    """Tests that are named after an input: beside it, in its ``__tests__``, or anywhere; ``by, path, tier, input_index, rank``.

    Each rule is an equi-join on a key made from the path, so no input meets all tests. A file named a.b.test.x is a test of a and of a.b alike.
    """
    order = Window.partitionBy(*by).orderBy("path")
    i = inputs.select(*by, "path").distinct().withColumn("input_index", F.row_number().over(order) - 1).withColumn("d", paths.dirname(F.col("path"))).withColumn("s", paths.stem(paths.basename(F.col("path"))))
    parts = F.split(paths.basename(F.col("path")), r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), ".").alias("s"), F.get(parts, n).alias("next")))
    t = tests.select(*by, "path").distinct().select(*by, F.col("path").alias("test"), paths.dirname(F.col("path")).alias("td"), F.inline(prefixes)).filter("next IS NOT NULL")
    of = t.filter(F.col("next").isin("test", "spec") & (F.size(F.split("test", r"\.")) > 2))
    beside = i.join(of.withColumnRenamed("td", "d"), [*by, "d", "s"]).select(*by, "test", "input_index", F.lit(1).alias("tier"))
    folder = F.when(F.col("d") == "", "__tests__").otherwise(F.concat("d", F.lit("/__tests__")))
    inside = i.withColumn("td", folder).join(t, [*by, "td", "s"]).select(*by, "test", "input_index", F.lit(2).alias("tier"))
    names = F.when((F.col("s") == "index") & (F.col("d") != ""), F.array("s", paths.basename(F.col("d")))).otherwise(F.array("s"))
    anywhere = i.select(*by, "input_index", F.explode(names).alias("s")).join(of, [*by, "s"]).select(*by, "test", "input_index", F.lit(3).alias("tier"))
    best = beside.union(inside).union(anywhere).groupBy(*by, "test").agg(F.min(F.struct("tier", "input_index")).alias("b")).select(*by, F.col("test").alias("path"), "b.tier", "b.input_index")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("tier", "input_index", "path")))
    return ranked.filter(F.col("rank") <= depth)


def method_status(results: DataFrame) -> DataFrame:
    """``method, status, n_commits``: commits by method and status."""
    return results.groupBy("method", "status").agg(F.count("*").alias("n_commits"))


def unfinished(results: DataFrame) -> DataFrame:
    """``method, status, commit``: one row for each commit that failed or did not run."""
    return results.filter("status IN ('failed', 'not_run')").select("method", "status", "commit")
