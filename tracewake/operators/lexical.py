"""Inverted index and ranked lexical search over all snapshots at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewake.functions import text


def content_tokens(contents: DataFrame) -> DataFrame:
    """``token, sha256``: each distinct token of each content. A content without tokens has no row."""
    return contents.select(F.explode(text.tokenize(F.col("text"))).alias("token"), F.lower("sha256").alias("sha256"))


def content_token_lists(contents: DataFrame) -> DataFrame:
    """``sha256, tokens``: the index by content, with the distinct tokens of each in one row."""
    return contents.select(F.lower("sha256").alias("sha256"), text.tokenize(F.col("text")).alias("tokens"))


def path_tokens(artifacts: DataFrame) -> DataFrame:
    """``token, artifact_id``."""
    rows = artifacts.filter(F.col("path").isNotNull()).dropDuplicates(["id"])
    return rows.select(F.explode(text.tokenize(F.col("path"))).alias("token"), F.col("id").alias("artifact_id"))


def document_frequency(tokens: DataFrame, of: str = "sha256") -> DataFrame:
    return tokens.groupBy("token").agg(F.countDistinct(of).alias("document_frequency"))


def content_frequency(contents: DataFrame) -> DataFrame:
    """``token, document_frequency`` over distinct contents. Contents are made distinct by their token lists, so neither texts nor pairs of token and content are shuffled."""
    each = contents.select(F.lower("sha256").alias("sha256"), text.tokenize(F.col("text")).alias("tokens")).dropDuplicates(["sha256"])
    return each.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("document_frequency"))


def unindexed(contents: DataFrame, marked: DataFrame) -> DataFrame:
    """Contents without a completion mark; the mark also covers contents without any token."""
    return contents.join(marked.select("sha256"), "sha256", "left_anti")


def is_indexed(versions: DataFrame, marked_contents: DataFrame, tokens_of_paths: DataFrame) -> bool:
    """Whether every version's content is marked and its artifact has path tokens."""
    missing = versions.join(marked_contents.select("sha256"), "sha256", "left_anti").select("version_id")
    unnamed = versions.join(tokens_of_paths.select("artifact_id").distinct(), "artifact_id", "left_anti").select("version_id")
    return missing.unionByName(unnamed).isEmpty()


def matching_contents(contents: DataFrame, terms: list[str]) -> DataFrame:
    """``sha256, terms``: the searched terms that each content has, found where the text is read.

    For a query of a few terms this needs no shuffle of an index; with a stored index, join ``content_tokens`` instead.
    """
    wanted = F.array(*[F.lit(t) for t in sorted(set(terms))])
    found = F.sort_array(F.array_intersect(text.tokenize(F.col("text")), wanted))
    return contents.select(F.lower("sha256").alias("sha256"), found.alias("content_terms")).filter(F.size("content_terms") > 0)


def lexical_matches(versions: DataFrame, contents: DataFrame, terms: list[str]) -> DataFrame:
    """Versions that match a term in content or path, with sorted ``content_terms, path_terms, matched_terms``. No terms, no rows."""
    if not terms:
        return versions.limit(0).select("*", *[F.array().cast("array<string>").alias(c) for c in ("content_terms", "path_terms", "matched_terms")])
    wanted = F.array(*[F.lit(t) for t in sorted(set(terms))])
    paths = F.sort_array(F.array_intersect(text.tokenize(F.col("path")), wanted))
    none = F.array().cast("array<string>")
    hits = matching_contents(contents, terms).dropDuplicates(["sha256"])
    joined = versions.withColumn("path_terms", paths).join(hits, "sha256", "left").withColumn("content_terms", F.coalesce("content_terms", none))
    return joined.withColumn("matched_terms", F.sort_array(F.array_union("content_terms", "path_terms"))).filter(F.size("matched_terms") > 0)


def strength_order():
    return [F.desc(F.size("matched_terms")), F.desc(F.size("path_terms")), text.utf16_length(F.col("path")), F.col("path"), F.col("artifact_id")]


def lexical_rank(matches: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``category`` and the total-order ``rank`` within ``by``."""
    rows = matches.withColumn("category", text.lexical_category(F.size("matched_terms"), F.size("path_terms")))
    order = Window.partitionBy(*by).orderBy(text.precedence(F.col("category"), text.LEXICAL), *strength_order())
    return rows.withColumn("rank", F.row_number().over(order))


#: Hash values that terms are told apart by before their lists move, as a power of two: 128 KB of bits.
SLOTS = 20


def _slot(token: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(token), 64 - SLOTS)


def _asked_slots(terms: DataFrame) -> DataFrame:
    """``__slots``, one row of fixed size: a bit for each hash value, set if one of the terms has it."""
    each = terms.select(_slot(F.col("term")).alias("slot")).select(F.shiftright("slot", 6).alias("id"), F.expr("shiftleft(1L, cast(slot & 63 AS int))").alias("bit"))
    words = terms.sparkSession.range(2**SLOTS // 64).join(each.groupBy("id").agg(F.bit_or("bit").alias("bits")), "id", "left")
    return words.agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))["bits"].alias("__slots"))


def _perhaps_asked(token: Column) -> Column:
    """Whether a term has the token's hash value: true for every term, and for few other tokens while terms are far fewer than hash values."""
    slot = _slot(token)
    return F.getbit(F.get("__slots", F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(63).cast("int")) == 1


def index_matches(files: DataFrame, terms: DataFrame, content_index: DataFrame, path_index: DataFrame, by: list[str]) -> DataFrame:
    """Matches of many queries at once by the stored index: ``by, artifact_id`` with sorted ``content_terms, path_terms, matched_terms``.

    ``files`` has ``by, artifact_id, sha256``, ``terms`` has ``by, term``, the indexes ``token, sha256`` or ``tokens, sha256``, and ``token, artifact_id``. No text is read.
    Tokens of a content or a path move in one row, without those that no query at all asks for by their hash values, and meet the terms of the file's own query last.
    """
    asked = terms.groupBy(*by).agg(F.collect_set("term").alias("__asked"))
    slots = F.broadcast(_asked_slots(terms))

    def lists(index: DataFrame, key: str, name: str) -> DataFrame:
        told = index.crossJoin(slots)
        if "tokens" in index.columns:
            found = told.select(key, F.filter("tokens", _perhaps_asked).alias(name))
        else:
            found = told.filter(_perhaps_asked(F.col("token"))).groupBy(key).agg(F.collect_set("token").alias(name))
        return found.filter(F.size(name) > 0)

    rows = files.select(*by, "artifact_id", "sha256").join(lists(path_index, "artifact_id", "__path"), "artifact_id", "left").join(lists(content_index, "sha256", "__content"), "sha256", "left").drop("sha256")
    held = lambda name: F.coalesce(F.array_intersect(name, "__asked"), F.array().cast("array<string>")).alias(name)
    rows = rows.filter("__path IS NOT NULL OR __content IS NOT NULL").join(asked, by).select(*by, "artifact_id", held("__path"), held("__content")).filter((F.size("__path") > 0) | (F.size("__content") > 0))
    # An artifact may have several contents, and a content several rows of the index.
    every = lambda name: F.sort_array(F.array_distinct(F.flatten(F.collect_list(name))))
    found = rows.groupBy(*by, "artifact_id").agg(every("__content").alias("content_terms"), every("__path").alias("path_terms"))
    return found.withColumn("matched_terms", F.sort_array(F.array_union("content_terms", "path_terms")))


def index_counts(contents: DataFrame, marked: DataFrame) -> DataFrame:
    """``to_index, reused``: contents that an indexing run has to read, and those whose mark it finds."""
    known = marked.select("sha256").distinct().withColumn("known", F.lit(True))
    rows = contents.select("sha256").distinct().join(known, "sha256", "left")
    return rows.agg(F.count_if(F.col("known").isNull()).alias("to_index"), F.count_if("known").alias("reused"))


def substring_matches(rows: DataFrame, terms: list[str], name: str = "text") -> DataFrame:
    """Rows whose text holds a term anywhere, letter case aside, with sorted ``terms``; null texts hold none."""
    lower = F.lower(name)
    held = F.array_compact(F.array(*[F.when(lower.contains(t.lower()), F.lit(t)) for t in sorted(set(terms))]))
    return rows.filter(F.col(name).isNotNull()).withColumn("terms", held).filter(F.size("terms") > 0)
