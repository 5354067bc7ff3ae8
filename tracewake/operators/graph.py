"""Import edges between the files of a snapshot."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewake.functions import paths, text

def _mask(source: str) -> str | None:
    """The text with comments, templates and regular expressions blanked, strings kept; null if a token does not end."""
    out, i, n = list(source), 0, len(source)
    previous = ""
    depth: list[int] = []
    while i < n:
        c = source[i]
        if source.startswith("//", i):
            j = source.find("\n", i)
            j = n if j < 0 else j
        elif source.startswith("/*", i):
            j = source.find("*/", i + 2)
            if j < 0:
                return None
            j += 2
        elif c in "'\"":
            j = i + 1
            while j < n and source[j] not in (c, "\n"):
                j += 2 if source[j] == "\\" else 1
            if j >= n or source[j] != c:
                return None
            i, previous = j + 1, c
            continue
        elif c == "`" or (c == "}" and depth and depth[-1] == 0):
            if c == "}":
                depth.pop()
            j = i + 1
            while j < n and source[j] != "`" and not source.startswith("${", j):
                j += 2 if source[j] == "\\" else 1
            if j >= n:
                return None
            if source[j] == "$":
                depth.append(0)
                j += 1
            j += 1
            previous = "`"
        elif c == "/" and (previous in "=(,:;!&|?{}[+-*%~^<>" or previous == ""):
            j, inside = i + 1, False
            while j < n and source[j] != "\n" and (inside or source[j] != "/"):
                inside = source[j] == "[" or (inside and source[j] != "]")
                j += 2 if source[j] == "\\" else 1
            j = min(n, j + 1)
            previous = ")"
        else:
            if depth:
                depth[-1] += (c == "{") - (c == "}")
            if not c.isspace():
                previous = c
            i += 1
            continue
        for k in range(i, min(j, n)):
            if out[k] != "\n":
                out[k] = " "
        i = j
    return "".join(out)


def _declarations(source: str | None):
    import re

    if not source or "import" not in source:
        return []
    masked = _mask(source)
    if masked is None:
        return None
    found = []
    clause = r"(?:type\s+)?(?:[\w$]+(?:\s*,\s*)?)?(?:\{[^{}'\"`;]*\}|\*\s*as\s+[\w$]+)?\s*from\s*"
    for m in re.finditer(rf"(?<![\w$.])import\s*(?:{clause})?(['\"])((?:[^'\"\\\n]|\\.)*)\1\s*(?:with\s*\{{[^}}]*\}}\s*)?;?", masked):
        line = source.count("\n", 0, m.start()) + 1
        found.append((m.group(2), m.start(), m.end(), line, line + source.count("\n", m.start(), m.end())))
    return found


def import_declarations(source: Column) -> Column:
    """Import declarations in source order with offsets and lines; null where a comment, string or template does not end.

    ``import x from``, ``import {a} from``, ``import * as``, ``import type`` and ``import 's'`` count; export-from, require, ``import x =`` and
    ``import()`` do not. A scanner that knows comments, strings, templates and regular expressions, not a full parser.
    """
    schema = T.ArrayType(
        T.StructType([T.StructField("specifier", T.StringType())] + [T.StructField(c, T.IntegerType()) for c in ("start", "end", "start_line", "end_line")])
    )

    @F.pandas_udf(schema)
    def scan(s: pd.Series) -> pd.Series:
        return s.map(_declarations, na_action=None)

    return scan(source)


def content_imports(contents: DataFrame) -> DataFrame:
    """``sha256, status, specifier`` of each content and each distinct specifier; a content without imports has one row with a null specifier."""
    scanned = contents.select(F.lower("sha256").alias("sha256"), import_declarations(F.col("text")).alias("found"))
    return scanned.select(
        "sha256", F.when(F.col("found").isNull(), "syntax_error").otherwise("parsed").alias("status"), F.explode_outer(F.array_distinct(F.transform("found", lambda d: d["specifier"]))).alias("specifier")
    )


def resolve_imports(imports: DataFrame, files: DataFrame, by: list[str]) -> DataFrame:
    """``by, source_id, specifier, target_id``: the first existing path of each relative specifier, exact suffixes before ``.js`` as ``.ts``.

    ``imports`` has ``by, source_id, source_path, specifier``; ``files`` has ``by, artifact_id, path``. Files that import themselves give no row.
    """
    relative = imports.filter(F.col("specifier").startswith("."))
    joined = paths.join_relative(F.col("source_path"), F.col("specifier"))
    # One row an import and one a file meet at their stems; which of the candidates a file is, if any, is told then.
    tried = relative.select(*by, "source_id", "specifier", joined.alias("__joined")).withColumn("__stem", paths.stem(F.col("__joined")))
    met = tried.join(files.select(*by, "path", F.col("artifact_id").alias("target_id")).withColumn("__stem", paths.stem(F.col("path"))), [*by, "__stem"])
    hits = met.withColumn("priority", F.array_min(F.filter(paths.candidates(F.col("__joined"), F.col("specifier")), lambda c: c["path"] == F.col("path"))["priority"])).filter("priority IS NOT NULL")
    best = hits.groupBy(*by, "source_id", "specifier").agg(F.min_by("target_id", "priority").alias("target_id"))
    return best.filter("source_id <> target_id")


def edges(resolved: DataFrame, files: DataFrame, by: list[str]) -> DataFrame:
    """``by, source_id, target_id, kind``: imports, and test-to-source as well where the importing file is a test."""
    named = files.select(*by, F.col("artifact_id").alias("source_id"), paths.is_test(F.col("path")).alias("test"))
    kinds = F.when(F.col("test"), F.array(F.lit("imports"), F.lit("test-to-source"))).otherwise(F.array(F.lit("imports")))
    pairs = resolved.select(*by, "source_id", "target_id").distinct()
    return pairs.join(named, [*by, "source_id"]).select(*by, "source_id", "target_id", F.explode(kinds).alias("kind"))


def structural_signals(edge: DataFrame, changed: DataFrame, by: list[str]) -> DataFrame:
    """``by, artifact_id, signal, changed_id``: what ties a file to a changed one.

    test-to-source suppresses incoming-import for the same pair; outgoing-import is the changed file importing this one.
    """
    ids = changed.select(*by, F.col("artifact_id").alias("changed_id")).distinct()
    into = edge.join(ids.withColumnRenamed("changed_id", "target_id"), [*by, "target_id"]).groupBy(*by, F.col("source_id").alias("artifact_id"), F.col("target_id").alias("changed_id")).agg(
        F.max(F.col("kind") == "test-to-source").alias("test")
    )
    incoming = into.select(*by, "artifact_id", F.when(F.col("test"), "test-to-source").otherwise("incoming-import").alias("signal"), "changed_id")
    out = edge.filter("kind = 'imports'").join(ids.withColumnRenamed("changed_id", "source_id"), [*by, "source_id"])
    return incoming.unionByName(out.select(*by, F.col("target_id").alias("artifact_id"), F.lit("outgoing-import").alias("signal"), F.col("source_id").alias("changed_id")).distinct())


#: Signals from the strongest.
SIGNALS = ("test-to-source", "incoming-import", "outgoing-import")


def signal_counts(signals: DataFrame, by: list[str]) -> DataFrame:
    each = F.sort_array(F.collect_set(F.struct(text.precedence(F.col("signal"), SIGNALS).alias("order"), "signal", "changed_id")))
    return signals.groupBy(*by, "artifact_id").agg(
        F.transform(each, lambda s: F.struct(s["signal"].alias("signal"), s["changed_id"].alias("changed_id"))).alias("signals"),
        *[F.count_if(F.col("signal") == s).alias("n_" + s.replace("-", "_")) for s in SIGNALS],
    )


def linked(pairs: DataFrame, edge: DataFrame) -> DataFrame:
    """Rows ``a, b`` of ``pairs`` joined by an edge in either direction."""
    ways = edge.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).union(edge.select("target_id", "source_id")).distinct()
    return pairs.join(ways, ["a", "b"], "left_semi")


def relationships(edge: DataFrame, files: DataFrame, wanted: DataFrame, by: list[str], direction: str) -> DataFrame:
    """Edges into (``incoming``) or out of (``outgoing``) the ``wanted`` artifacts (``by, artifact_id``), with version, path and kind of both ends.

    Which artifacts import a file and which tests do, or what a file imports; by source path, target path and kind where order matters.
    """
    if direction not in ("incoming", "outgoing"):
        raise ValueError("direction is incoming or outgoing")
    end = "target_id" if direction == "incoming" else "source_id"
    kept = edge.withColumnRenamed("kind", "relationship").join(wanted.select(*by, F.col("artifact_id").alias(end)).distinct(), [*by, end], "left_semi")
    for side in ("source", "target"):
        named = files.select(*by, F.col("artifact_id").alias(f"{side}_id"), F.col("version_id").alias(f"{side}_version_id"), F.col("path").alias(f"{side}_path"), F.col("kind").alias(f"{side}_kind"))
        kept = kept.join(named, [*by, f"{side}_id"])
    return kept.select(*by, "relationship", *[f"{s}_{c}" for s in ("source", "target") for c in ("id", "version_id", "path", "kind")])


#: Fixed value: UTF-16 units of a declaration that evidence shows.
DECLARATION_CHARACTERS = 500


def edge_declarations(resolved: DataFrame, files: DataFrame, contents: DataFrame, by: list[str]) -> DataFrame:
    """``by, source_id, target_id, declarations``: specifier, lines and excerpt of every import declaration behind an edge, in source order.

    ``resolved`` has ``by, source_id, specifier, target_id`` as from :func:`resolve_imports`; a source that cannot be read to its end has none.
    """
    found = contents.select(F.lower("sha256").alias("sha256"), "text", F.explode(import_declarations(F.col("text"))).alias("d"))
    shown = found.select("sha256", F.col("d.specifier").alias("specifier"), "d.start", "d.start_line", "d.end_line", text.excerpt(F.substr("text", F.col("d.start") + 1, F.col("d.end") - F.col("d.start")), DECLARATION_CHARACTERS).alias("excerpt"))
    sources = files.select(*by, F.col("artifact_id").alias("source_id"), "sha256")
    each = resolved.join(sources, [*by, "source_id"]).join(shown.dropDuplicates(["sha256", "start"]), ["sha256", "specifier"])
    listed = F.sort_array(F.collect_set(F.struct("start", "specifier", "start_line", "end_line", "excerpt")))
    return each.groupBy(*by, "source_id", "target_id").agg(F.transform(listed, lambda d: d.dropFields("start")).alias("declarations"))
