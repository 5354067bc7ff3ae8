"""Checks of rankings, tables, reports and statements."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ranking_violations(ranked: DataFrame, by: list[str]) -> DataFrame:
    """Lists whose ranks are not distinct whole numbers from 1, or that name a version or path twice; none if all are sound."""
    found = ranked.groupBy(*by).agg(
        F.count_if((F.col("rank") < 1) | F.col("rank").isNull()).alias("n_invalid_ranks"), (F.count("*") - F.countDistinct("rank")).alias("n_repeated_ranks"),
        (F.count("*") - F.countDistinct("version_id")).alias("n_repeated_versions"), (F.count("*") - F.countDistinct("path")).alias("n_repeated_paths"),
    )
    return found.filter("n_invalid_ranks + n_repeated_ranks + n_repeated_versions + n_repeated_paths > 0")


def identity_conflicts(rows: DataFrame, keys: list[str], identity: str) -> DataFrame:
    """Keys that stand for several identities."""
    return rows.groupBy(*keys).agg(F.countDistinct(identity).alias("n_identities")).filter("n_identities > 1")


def referential_checks(checks: dict[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """``check, n_violations``: rows whose key the other table lacks."""
    out = None
    for name, (rows, key, other, other_key) in checks.items():
        known = other.select(F.col(other_key).alias("__key")).distinct()
        bad = rows.filter(F.col(key).isNotNull()).join(known, F.col(key) == F.col("__key"), "left_anti").agg(F.count("*").alias("n_violations")).select(F.lit(name).alias("check"), "n_violations")
        out = bad if out is None else out.unionByName(bad)
    return out


def content_integrity(contents: DataFrame) -> DataFrame:
    return contents.agg(
        F.count("*").alias("n_contents"), F.count_if(F.sha2("text", 256) != F.lower("sha256")).alias("n_wrong_digest"), F.count_if(F.octet_length("text") != F.col("byte_length")).alias("n_wrong_length")
    )


def manifest_violations(commits: DataFrame) -> DataFrame:
    """Broken invariants of a selection: ``commit, problem``. Rows have ``commit, eligible_index, inputs, targets`` (arrays of paths)."""
    problem = (
        F.when(F.size("inputs") == 0, "no input").when(F.size("targets") == 0, "no target").when(F.arrays_overlap("inputs", "targets"), "a path is both input and target")
        .when(F.sort_array("inputs") != F.col("inputs"), "inputs are not sorted").when(F.sort_array("targets") != F.col("targets"), "targets are not sorted")
        .when(F.size(F.array_distinct("inputs")) != F.size("inputs"), "a repeated input").when(F.col("eligible_index") < 0, "a negative index")
    )
    return commits.select("commit", problem.alias("problem")).filter("problem IS NOT NULL")


def record_violations(results: DataFrame, ranking: DataFrame, inputs: DataFrame) -> DataFrame:
    """Method results with both or neither of a ranking and a failure, and rankings that hold an input: ``commit, method, problem``."""
    has = ranking.select("commit", "method").distinct().withColumn("ranked", F.lit(True))
    both = results.join(has, ["commit", "method"], "left").withColumn("ranked", F.coalesce("ranked", F.lit(False)))
    xor = both.filter(F.col("ranked") == F.col("failure").isNotNull()).select("commit", "method", F.lit("a ranking or a failure, not both or neither").alias("problem"))
    held = ranking.join(inputs.select("commit", "path").distinct(), ["commit", "path"], "left_semi").select("commit", "method", F.lit("the ranking holds an input").alias("problem")).distinct()
    return xor.unionByName(held)


def results_violations(statistics: DataFrame, metrics: DataFrame, scale: int) -> DataFrame:
    """``stratum, series, problem`` of statistics that their metrics do not bear out.

    Of each series of a method: its population and exact sums must be those of the metrics. Of all: recall must not fall as more is looked at (differences aside), no sum may exceed the whole population, and an interval must not end before it begins.
    """
    names = [c.removesuffix("_sum") for c in statistics.columns if c.endswith("_sum")]
    own = metrics.groupBy("stratum", F.col("method").alias("series")).agg(F.count("*").alias("__n"), *[F.sum(m).alias(f"__{m}") for m in names])
    rows = statistics.join(own, ["stratum", "series"], "left")
    difference = F.col("series").contains(" - ")
    recalls = sorted((m for m in names if m.startswith("recall")), key=lambda m: int(m.removeprefix("recall")))
    any_of = lambda conditions: reduce(lambda a, b: a | b, conditions, F.lit(False))
    problem = (
        F.when(~difference & F.col("__n").isNull(), "no metrics of such a series").when(~difference & (F.col("population") != F.col("__n")), "the population is another")
        .when(any_of(~difference & (F.col(f"{m}_sum") != F.col(f"__{m}")) for m in names), "a sum is another")
        .when(any_of(F.abs(f"{m}_sum") > F.col("population") * F.lit(scale) for m in names), "a sum exceeds the population")
        .when(~difference & any_of(F.col(f"{a}_sum") > F.col(f"{b}_sum") for a, b in zip(recalls, recalls[1:])), "recall falls as more is looked at")
        .when(any_of(F.col(f"{m}_lower") > F.col(f"{m}_upper") for m in names), "an interval ends before it begins")
    )
    return rows.select("stratum", "series", problem.alias("problem")).filter("problem IS NOT NULL")


#: Limits of a report.
MOST_STATEMENT, MOST_FINDINGS, MOST_CITATIONS = 1000, 10, 20
CLASSIFICATIONS = ("likely_affected", "potentially_affected", "no_impact_indicated", "insufficient_evidence")
def classification_problem(classification, cited):
    """Column: likely_affected needs a located import by the candidate among ``cited`` (array of type, candidate_is, n_declarations); no_impact_indicated is never shown by evidence."""
    located = F.exists(cited, lambda e: (e["type"] == "structural") & (e["candidate_is"] == "source") & (e["n_declarations"] > 0))
    return F.when((classification == "likely_affected") & ~located, "not-located").when(classification == "no_impact_indicated", "not-shown").when(~classification.isin(*CLASSIFICATIONS), "unknown")


def report_problems(report: dict, known_ids: set[str]) -> list[str]:
    """What is wrong with an assessment: its shape, its limits, and citations of evidence that does not exist."""
    if not isinstance(report, dict) or set(report) - {"classification", "findings", "limitations"}:
        return ["the report has unknown fields"]
    out = []
    if report.get("classification") not in CLASSIFICATIONS:
        out.append("unknown classification")
    findings = report.get("findings")
    if not isinstance(findings, list) or len(findings) > MOST_FINDINGS:
        return [*out, f"findings must be a list of at most {MOST_FINDINGS}"]
    for i, f in enumerate(findings):
        text, ids = f.get("statement"), f.get("evidence_ids")
        if not isinstance(text, str) or not text.strip() or len(text) > MOST_STATEMENT:
            out.append(f"finding {i}: a statement of 1 to {MOST_STATEMENT} characters is needed")
        if not isinstance(ids, list) or not ids or len(ids) > MOST_CITATIONS or len(set(ids)) != len(ids):
            out.append(f"finding {i}: 1 to {MOST_CITATIONS} distinct citations are needed")
        elif missing := [x for x in ids if x not in known_ids]:
            out.append(f"finding {i}: unknown evidence {missing[0]}")
    return out


def leaks(document: str, forbidden: Sequence[str] = ("repoPath", "sourcePath", "databasePath")) -> list[str]:
    """Forbidden keys and absolute paths in a JSON document."""
    out: list[str] = []

    def walk(value, at: str) -> None:
        if isinstance(value, dict):
            for k, v in value.items():
                out.extend([f"{at}.{k}: forbidden key"] if k in forbidden else [])
                walk(v, f"{at}.{k}")
        elif isinstance(value, list):
            for i, v in enumerate(value):
                walk(v, f"{at}[{i}]")
        elif isinstance(value, str) and re.search(r"(?:^|[\s\"'(])(?:/(?:home|root|Users|srv|tmp|var)/|[A-Za-z]:\\)", value):
            out.append(f"{at}: absolute path")

    walk(json.loads(document), "$")
    return out
