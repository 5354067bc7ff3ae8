"""Signals from commit history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewake.functions import text
from tracewake.operators.lexical import lexical_rank
from tracewake.session import cut_lineage

#: Fixed value: the collection size that the term weight assumes.
COLLECTION = 10_000


def global_rank(rows: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """Adds ranks from 1 over all rows in a total ``order`` without bringing them into one task.

    Rows are cut into ranges of the order, numbered within each, and moved up by the rows of the ranges before: one number a range.
    """
    ranges = cut_lineage(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    before = ranges.groupBy("__range").agg(F.count("*").alias("n")).select(
        "__range", F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before")
    )
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranges.join(F.broadcast(before), "__range").withColumn(name, (F.col("__before") + inside).cast("long")).drop("__range", "__before")


def reachable(commits: DataFrame, heads: DataFrame, rounds: int = 64) -> DataFrame:
    """``sha`` of every commit that ``heads`` (``sha``) reach, themselves included, by the edges of ``commits`` (``sha, parents``).

    Round r follows paths of exactly 2^r edges, so a history n commits deep takes about log2 n rounds, each written to the
    checkpoint folder. When a round adds nothing, every parent of a found commit is found.
    """
    found = cut_lineage(heads.select("sha").distinct())
    jump = cut_lineage(commits.select("sha", F.explode("parents").alias("to")).distinct())
    for _ in range(rounds):
        added = cut_lineage(jump.join(found, "sha", "left_semi").select(F.col("to").alias("sha")).distinct().join(found, "sha", "left_anti"))
        if added.isEmpty():
            return found
        found = cut_lineage(found.union(added))
        onward = jump.select(F.col("sha").alias("to"), F.col("to").alias("far"))
        jump = cut_lineage(jump.join(onward, "to").select("sha", F.col("far").alias("to")).distinct())
    raise RuntimeError(f"a history deeper than 2^{rounds}")


def is_ancestor(commits: DataFrame, ancestor: str, of: str) -> bool:
    spark = commits.sparkSession
    return not reachable(commits, spark.createDataFrame([(of,)], "sha string")).filter(F.col("sha") == ancestor).isEmpty()


def history(commits: DataFrame, head: str, since: str | None = None) -> DataFrame:
    """Commits reachable from ``head`` and not from ``since``."""
    spark = commits.sparkSession
    one = lambda sha: reachable(commits, spark.createDataFrame([(sha,)], "sha string"))
    kept = one(head) if since is None else one(head).join(one(since), "sha", "left_anti")
    return commits.join(kept, "sha", "left_semi")


def diff_trees(base: DataFrame, target: DataFrame) -> DataFrame:
    """``status, path, previous_path`` of two trees (``path, object_sha, mode``): added, deleted, modified, type_changed, and exact renames.

    A rename pairs a deleted and an added path with the same blob, in path order among several.
    """
    b = base.select("path", F.col("object_sha").alias("b"), F.substring("mode", 1, 3).alias("bm"))
    t = target.select("path", F.col("object_sha").alias("t"), F.substring("mode", 1, 3).alias("tm"))
    both = b.join(t, "path", "full_outer")
    status = F.when(F.col("b").isNull(), "added").when(F.col("t").isNull(), "deleted").when(F.col("bm") != F.col("tm"), "type_changed").when(F.col("b") != F.col("t"), "modified")
    changed = both.withColumn("status", status).filter("status IS NOT NULL").withColumn("sha", F.coalesce("b", "t"))
    order = Window.partitionBy("status", "sha").orderBy("path")
    numbered = changed.withColumn("n", F.row_number().over(order))
    gone = numbered.filter("status = 'deleted'").select("sha", "n", F.col("path").alias("previous_path"))
    new = numbered.filter("status = 'added'").join(gone, ["sha", "n"], "left")
    renamed = new.filter("previous_path IS NOT NULL")
    kept = numbered.filter("status = 'deleted'").join(renamed.select("sha", "n"), ["sha", "n"], "left_anti").union(numbered.filter("status NOT IN ('added', 'deleted')").select(*_order(numbered)))
    return (
        kept.select("status", "path", F.lit(None).cast("string").alias("previous_path"))
        .union(new.filter("previous_path IS NULL").select("status", "path", "previous_path"))
        .union(renamed.select(F.lit("renamed").alias("status"), "path", "previous_path"))
    )


def _order(df: DataFrame) -> list[str]:
    return ["sha", "n", *[c for c in df.columns if c not in ("sha", "n")]]


def cochange(changes: DataFrame, seeds: DataFrame) -> DataFrame:
    """Files that changed in a commit together with a seed: ``path, n_commits, latest, rank``.

    ``changes`` has ``commit, path, time``; ``seeds`` has ``path``. A file is counted beside other seeds but not beside itself; seeds are left out of the ranking.
    """
    s = seeds.select("path").distinct()
    touched = changes.join(s, "path", "left_semi").select("commit").distinct()
    counted = changes.join(touched, "commit", "left_semi").join(s, "path", "left_anti").groupBy("path").agg(F.countDistinct("commit").alias("n_commits"), F.max("time").alias("latest"))
    return global_rank(counted, [F.desc("n_commits"), F.desc("latest"), F.col("path")])


def issue_links(changes: DataFrame, references: DataFrame, seeds: DataFrame) -> DataFrame:
    """Files of commits that name an issue which a commit of a seed names too: ``path, n_references, rank``.

    ``references`` has ``commit, reference``.
    """
    s = seeds.select("path").distinct()
    of_seeds = changes.join(s, "path", "left_semi").select("commit").distinct()
    named = references.join(of_seeds, "commit", "left_semi").select("reference").distinct()
    # A commit names few issues; pairs of file and reference are formed after the join on commits.
    linked = references.join(named, "reference", "left_semi").distinct().join(changes.select("commit", "path").distinct(), "commit").join(s, "path", "left_anti")
    counted = linked.groupBy("path").agg(F.countDistinct("reference").alias("n_references"))
    return global_rank(counted, [F.desc("n_references"), F.col("path")])


def term_weights(matches: DataFrame, by: list[str]) -> DataFrame:
    """``by, artifact_id, tfidf``: the sum over matched terms of ln(10000 / candidates with the term)."""
    each = matches.select(*by, "artifact_id", F.explode("matched_terms").alias("term"))
    df = each.groupBy(*by, "term").agg(F.countDistinct("artifact_id").alias("df"))
    return each.join(df, [*by, "term"]).groupBy(*by, "artifact_id").agg(F.sum(F.log(F.lit(float(COLLECTION)) / F.col("df"))).alias("tfidf"))


def evidence_tier(structural, lexical_terms, path_terms):
    """Tier 1 structural, 2 a path match or three terms, 3 some term, 4 none."""
    return F.when(structural, 1).when((path_terms > 0) | (lexical_terms >= 3), 2).when(lexical_terms > 0, 3).otherwise(4)


def tfidf_rank(matches: DataFrame, by: list[str]) -> DataFrame:
    """Matches with ``category, tfidf, rank``: by category, weight, length of the path and path."""
    weighed = lexical_rank(matches, by).drop("rank").join(term_weights(matches, by), [*by, "artifact_id"]).withColumn("tfidf", F.round("tfidf", 9))
    order = Window.partitionBy(*by).orderBy(text.precedence(F.col("category"), text.LEXICAL), F.desc("tfidf"), text.utf16_length(F.col("path")), "path", "artifact_id")
    return weighed.withColumn("rank", F.row_number().over(order))


def provenance(candidates: DataFrame) -> DataFrame:
    """How many candidates have structural evidence only, lexical only, or both, and how many changed themselves or did not; input has booleans ``structural, lexical, changed``."""
    s, t = F.col("structural"), F.col("lexical")
    return candidates.agg(
        F.count_if(s & ~t).alias("only_structural"), F.count_if(~s & t).alias("only_lexical"), F.count_if(s & t).alias("both"), F.count_if("changed").alias("changed"), F.count_if(~F.col("changed")).alias("unchanged")
    )
