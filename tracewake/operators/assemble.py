"""From rankings and failures of an evaluation to per-case results and statistics with intervals by stratum."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewake.functions.random import mulberry32
from tracewake.operators import evaluate, search

#: Strata in the order in which they draw, the ranking methods, and those that are compared with the first.
STRATA = ("test", "doc", "test-with-link", "test-without-link")
METHODS = ("hybrid", "deterministic", "semantic", "sibling", "no-description")
BASELINES = ("sibling", "deterministic", "semantic")


def five_arms(corpus: search.Corpus, changes: DataFrame, queries: DataFrame, bare_queries: DataFrame, inputs: DataFrame, tests: DataFrame, depth: int = evaluate.DEPTH) -> DataFrame:
    """``by, method, path, position``: the first ``depth`` of each arm's ranking of each change, its inputs removed.

    One hybrid search gives three arms; a second one, with an empty description and the vectors of ``bare_queries``, the fourth; tests named after inputs are the fifth.
    ``inputs`` and ``tests`` have ``by, path``.
    """
    by = corpus.by
    run = search.search_hybrid(corpus, changes, queries)
    bare = search.search_hybrid(corpus, changes.withColumn("description", F.lit("")), bare_queries)
    siblings = evaluate.sibling_tests(inputs, tests, by, depth=2**31 - 1)
    lists = {"hybrid": run.fused, "deterministic": run.deterministic, "semantic": run.semantic, "sibling": siblings, "no-description": bare.fused}
    every = None
    for method in METHODS:
        ranked = lists[method].select(*by, F.lit(method).alias("method"), "path", "rank")
        every = ranked if every is None else every.unionByName(ranked)
    return evaluate.scored_ranking(every, inputs, [*by, "method"], depth).select(*by, "method", "path", "position")


def method_cases(cases: DataFrame, failures: DataFrame) -> DataFrame:
    """``commit, method, status``: every method of every case; a failure at the stage of preparation means that it was not run.

    ``cases`` has ``commit, links_known``; ``failures`` has ``commit, method, stage``.
    """
    every = cases.select("commit", F.explode(F.array(*[F.lit(m) for m in METHODS])).alias("method"))
    bad = failures.groupBy("commit", "method").agg(F.bool_or(F.col("stage") == "preparation").alias("not_run"))
    status = F.when(F.col("not_run").isNull(), "succeeded").when(F.col("not_run"), "not_run").otherwise("failed")
    return every.join(bad, ["commit", "method"], "left").select("commit", "method", status.alias("status"))


def target_ranks(targets: DataFrame, status: DataFrame, rankings: DataFrame) -> DataFrame:
    """``commit, method, path, kind, position``: the place of each target in each method that succeeded, null if it is not ranked."""
    ran = status.filter("status = 'succeeded'").select("commit", "method")
    return evaluate.positions(targets.join(ran, "commit"), rankings, ["commit", "method"])


def memberships(cases: DataFrame, targets: DataFrame, linked: DataFrame) -> DataFrame:
    """``commit, path, stratum``: strata of each target; those of links only where the links of the case are known."""
    each = evaluate.strata(targets, linked).join(cases.select("commit", "links_known"), "commit")
    return each.filter(F.col("links_known") | F.col("stratum").isin("test", "doc")).select("commit", "path", "stratum")


def stratum_metrics(ranks: DataFrame, members: DataFrame) -> DataFrame:
    """The exact metrics of each ``commit, method, stratum``."""
    return evaluate.commit_metrics(ranks.join(members, ["commit", "path"]), ["commit", "method", "stratum"])


def common_population(status: DataFrame, methods: tuple[str, ...] = ("hybrid", "no-description")) -> DataFrame:
    """Commits on which all these methods succeeded."""
    good = status.filter(F.col("method").isin(*methods) & (F.col("status") == "succeeded"))
    return good.groupBy("commit").agg(F.count_distinct("method").alias("n")).filter(F.col("n") == len(methods)).select("commit")


def stratum_members(metrics: DataFrame, cases: DataFrame) -> DataFrame:
    """``stratum, commit, member``: members of each stratum from 0 in the order of ``position``, without a window over all cases.

    Before a case come as many members of its stratum as earlier ranges of positions hold and as precede it in its own.
    """
    each = metrics.select("stratum", "commit").distinct().join(cases.select("commit", "position"), "commit").withColumn("part", F.floor(F.col("position") / 1000))
    counts = each.groupBy("stratum", "part").agg(F.count("*").alias("n"))
    earlier = counts.alias("a").join(counts.alias("b"), (F.col("a.stratum") == F.col("b.stratum")) & (F.col("b.part") < F.col("a.part")), "left")
    before = earlier.groupBy(F.col("a.stratum").alias("stratum"), F.col("a.part").alias("part")).agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("stratum", "part").orderBy("position"))
    return each.join(before, ["stratum", "part"]).select("stratum", "commit", (F.col("before") + inside - 1).cast("long").alias("member"))


def strata_draws(spark, sizes: dict[str, int], seed: int, replicates: int = evaluate.REPLICATES) -> DataFrame:
    """``stratum, replicate, member``: one sample for each stratum, all from one generator that goes on from stratum to stratum in their order.

    A stratum without members draws nothing. As a draw depends on its number only, all are made in parallel.
    """
    ends, at = [], 0
    for stratum in STRATA:
        size = sizes.get(stratum, 0)
        if size:
            ends.append((stratum, size, at))
            at += size * replicates
    draws = spark.range(at).withColumn("u", mulberry32(seed, F.col("id")))
    if not ends:
        return draws.select(F.lit("").alias("stratum"), F.col("id").alias("replicate"), F.col("id").alias("member"))
    name, number = F.lit(ends[0][0]), F.struct(F.lit(ends[0][1]).alias("m"), F.lit(ends[0][2]).cast("long").alias("start"))
    for stratum, size, start in ends[1:]:
        name = F.when(F.col("id") >= start, stratum).otherwise(name)
        number = F.when(F.col("id") >= start, F.struct(F.lit(size).alias("m"), F.lit(start).cast("long").alias("start"))).otherwise(number)
    rows = draws.select("id", "u", name.alias("stratum"), number.alias("n"))
    return rows.select("stratum", F.floor((F.col("id") - F.col("n.start")) / F.col("n.m")).cast("long").alias("replicate"), F.floor(F.col("u") * F.col("n.m")).cast("long").alias("member"))


def series(metrics: DataFrame, methods: tuple[str, ...], compared: tuple[str, ...]) -> DataFrame:
    """Metrics of each method, and differences of the first method and each compared one, as ``stratum, commit, series`` rows."""
    own = metrics.filter(F.col("method").isin(*methods)).select("stratum", "commit", F.col("method").alias("series"), *evaluate.METRICS)
    for other in compared:
        d = evaluate.paired(metrics, methods[0], other, ["stratum", "commit"])
        own = own.unionByName(d.withColumn("series", F.lit(f"{methods[0]} - {other}")))
    return own


def stratum_statistics(metrics: DataFrame, cases: DataFrame, methods: tuple[str, ...], compared: tuple[str, ...], seed: int, replicates: int = evaluate.REPLICATES) -> DataFrame:
    """``stratum, series, population`` with the exact sum of each metric and both ends of its interval, as rates.

    The draws of a stratum are shared by all its methods, metrics and differences. The population of an evaluation is a few hundred commits; its draws, not it, are the large side.
    """
    members = stratum_members(metrics.filter(F.col("method").isin(*methods)), cases)
    sizes = {r["stratum"]: r["n"] for r in members.groupBy("stratum").agg(F.count("*").alias("n")).collect()}
    values = series(metrics, methods, compared).join(members, ["stratum", "commit"])
    point = values.groupBy("stratum", "series").agg(F.count("*").alias("population"), *[F.sum(m).alias(f"{m}_sum") for m in evaluate.METRICS])
    drawn = strata_draws(metrics.sparkSession, sizes, seed, replicates).join(values, ["stratum", "member"])
    sums = drawn.groupBy("stratum", "series", "replicate").agg(*[F.sum(m).alias(m) for m in evaluate.METRICS])
    ends = [F.percentile(m, F.lit(q)).alias(f"{m}_{end}") for m in evaluate.METRICS for end, q in (("lower", 0.025), ("upper", 0.975))]
    whole = F.col("population") * F.lit(float(evaluate.SCALE))
    found = point.join(sums.groupBy("stratum", "series").agg(*ends), ["stratum", "series"])
    return found.select("stratum", "series", "population", *[f"{m}_sum" for m in evaluate.METRICS], *[(F.col(f"{m}_{e}") / whole).alias(f"{m}_{e}") for m in evaluate.METRICS for e in ("lower", "upper")])


def primary(metrics: DataFrame, status: DataFrame, cases: DataFrame, seed: int, replicates: int = evaluate.REPLICATES) -> DataFrame | None:
    """The statistics of the main analysis, or none if one of its methods did not succeed on every case."""
    needed = (METHODS[0], *BASELINES)
    if not status.filter(F.col("method").isin(*needed) & (F.col("status") != "succeeded")).isEmpty():
        return None
    return stratum_statistics(metrics, cases, needed, BASELINES, seed, replicates)


def sensitivity(metrics: DataFrame, status: DataFrame, cases: DataFrame, seed: int, replicates: int = evaluate.REPLICATES) -> DataFrame:
    """The statistics with and without descriptions, over the commits on which both succeeded."""
    both = common_population(status)
    return stratum_statistics(metrics.join(both, "commit"), cases, ("hybrid", "no-description"), ("no-description",), seed, replicates)


def outcome(statistics: DataFrame | None, population: int, spark) -> DataFrame:
    """``rule, outcome`` of the registered decision on the statistics of the main analysis; incomplete without any."""
    names = [f"{b}_{x}" for b in BASELINES for x in ("sum", "lower", "upper")]
    if statistics is None:
        rows = spark.createDataFrame([(True, population)], "incomplete_run boolean, population long").select("*", *[F.lit(None).cast("double").alias(n) for n in names])
    else:
        test = statistics.filter("stratum = 'test'")
        pick = lambda b, x: F.max(F.when(F.col("series") == f"{METHODS[0]} - {b}", F.col(f"recall10_{x}"))).alias(f"{b}_{x}")
        rows = test.agg(F.lit(False).alias("incomplete_run"), F.lit(population).cast("long").alias("population"), *[pick(b, x) for b in BASELINES for x in ("sum", "lower", "upper")])
    return evaluate.decide(rows).select("rule", "outcome")
