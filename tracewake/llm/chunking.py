"""Cuts long texts into overlapping chunks at natural boundaries."""

from __future__ import annotations

import functools
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("boundary", T.StringType())]))

_BLANK = r"\n[ \t]*\r?\n[ \t\r\n]*(?=\S)"
_LINE = r"\n"
_SENTENCE = r"[.!?;:][ \t]+(?=\S)"
_WORD = r"\s(?=\S)"
#: Per kind of file, from the strongest boundary to the weakest: a name and a pattern whose end is a place to cut.
BOUNDARIES = {
    "document": (("heading", r"(?:^|\n)(?=#{1,6}[ \t]|[^\n]+\n(?:=+|-{3,})[ \t]*\r?(?:\n|$))"), ("paragraph", _BLANK), ("line", _LINE), ("sentence", _SENTENCE), ("word", _WORD)),
    "code": (
        (
            "declaration",
            r"\n(?=(?:/\*\*|@\w|export\b|import\b|(?:async\s+)?function\b|(?:abstract\s+)?class\b|interface\b|type\s+\w|enum\b|namespace\b|declare\b|const\b|let\b|var\b|def\b|module\.exports\b|exports\.))",
        ),
        ("paragraph", _BLANK),
        ("line", _LINE),
        ("sentence", r"[;{},](?=.)"),
        ("word", _WORD),
    ),
    "config": (("heading", r"\n(?=[^\s\]})#-]|  \"|- )"), ("paragraph", _BLANK), ("line", _LINE), ("sentence", r"[,;](?=.)"), ("word", _WORD)),
}
_KINDS = {e: kind for kind, ends in {"document": "md mdx txt rst", "config": "json yml yaml toml ini"}.items() for e in ends.split()}


def kind_of(path: str | None) -> str:
    name = (path or "").rsplit("/", 1)[-1].lower()
    return _KINDS.get(name.rsplit(".", 1)[-1], "code") if "." in name else "document"


@functools.cache
def _patterns(kind: str):
    return tuple((name, re.compile(p)) for name, p in BOUNDARIES[kind])


def plan_offsets(sums: Sequence[int], tiers: Sequence[tuple[str, Sequence[int]]], limit: int, overlap: int, hard: Callable[[int, int], int] = lambda start, end: end) -> list[tuple[int, int, str]]:
    """``(start, end, boundary)`` of chunks of tokens whose lengths have the prefix sums ``sums`` (from 0).

    ``tiers`` are sorted token numbers at which a chunk may end, the strongest kind first. The last token under the limit and, in each tier, the last boundary up to it are
    found by binary search; one that leaves the chunk at least half full comes before any other. The next chunk begins at the first token that lies no more than ``overlap`` before the
    end. Without a boundary a chunk is cut at the limit, or where ``hard`` moves that; a token longer than the limit stands alone.
    """
    count = len(sums) - 1
    spans, start = [], 0
    while sums[count] - sums[start] > limit:
        at = sums[start]
        most = max(bisect_right(sums, at + limit) - 1, start + 1)
        end, boundary = 0, ""
        for least in (at + max(overlap, limit // 2), at + overlap):
            for name, ends in tiers:
                i = bisect_right(ends, most)
                if i and sums[ends[i - 1]] > least:
                    end, boundary = ends[i - 1], name
                    break
            if end:
                break
        if not end:
            end, boundary = hard(start, most), "hard"
        spans.append((start, end, boundary))
        if end == count:
            return spans
        start = max(bisect_left(sums, sums[end] - overlap), start + 1)
    return [*spans, (start, count, "end")]


def plan_spans(text: str | None, path: str | None, limit: int | None, overlap: int | None) -> list[tuple[int, int, str]]:
    """``(start, end, boundary)`` in code points of the chunks of one text; see :func:`chunk_rows`."""
    if not text:
        return []
    size = len(text)
    if limit is None or limit < 1 or size <= limit:
        return [(0, size, "end")]
    overlap = min(max(overlap or 0, 0), limit - 1)
    tiers = [(name, [m.end() for m in pattern.finditer(text)]) for name, pattern in _patterns(kind_of(path))]
    between = lambda start, end: end - (text[end - 1] == "\r" and text[end] == "\n" and end - 1 > start + overlap)
    # Every code point is a token of length one, so its prefix sums are the positions.
    return plan_offsets(range(size + 1), tiers, limit, overlap, between)


def plan_token_spans(lengths: list[int], boundaries: list[int], limit: int, overlap: int) -> list[tuple[int, int]]:
    """Token ranges whose summed ``lengths`` stay under ``limit``; ``boundaries`` are sorted token numbers."""
    return [(a, b) for a, b, _ in plan_offsets([0, *accumulate(lengths)], [("boundary", boundaries)], limit, overlap)]


@F.pandas_udf(SPANS)
def _spans(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    whole = lambda x: None if pd.isna(x) else int(x)
    for texts, paths, limits, overlaps in batches:
        yield pd.Series([plan_spans(t, p, whole(n), whole(o)) for t, p, n, o in zip(texts, paths, limits, overlaps)])


def spans(text: Column, path: Column, limit: Column, overlap: Column) -> Column:
    """The chunk spans of a text; short and null texts never reach Python."""
    long = F.length(text) > limit
    one = F.when(F.length(text) > 0, F.array(F.struct(F.lit(0).alias("start"), F.length(text).alias("end"), F.lit("end").alias("boundary")))).otherwise(F.array().cast(SPANS))
    return F.when(long, _spans(F.when(long, text), path, limit, overlap)).otherwise(one)


def chunk_rows(rows: DataFrame, text: str = "text", path: str = "path", limit: str = "char_limit", overlap: str = "overlap_chars") -> DataFrame:
    """One row per chunk of every row, with the row's other columns.

    Adds ``chunk_index`` (from 0), ``chunk_start``, ``chunk_end`` (code points), ``boundary`` and
    ``chunk_text``. A chunk has at most ``limit`` code points and begins exactly ``overlap`` before the end of the
    one before, so the text can be put together again. It ends at the last boundary of the
    strongest kind that leaves it at least half full, else at the last of any kind, else at the limit (never
    between CR and LF where that can be helped).

    Null and empty texts have no chunk. A null or non-positive limit is no limit; a null or negative overlap
    is none; an overlap of the limit or more counts as the limit less one. Repeated rows give repeated chunks. Columns
    named as the new ones are replaced.
    """
    added = ("chunk_index", "chunk_start", "chunk_end", "boundary", "chunk_text")
    kept = [c for c in rows.columns if c not in (text, *added)]
    planned = rows.withColumn("__spans", spans(F.col(text), F.col(path), F.col(limit), F.col(overlap)))
    return planned.select(*kept, F.col(text).alias("__text"), F.posexplode("__spans").alias("chunk_index", "__span")).select(
        *kept,
        "chunk_index",
        F.col("__span.start").alias("chunk_start"),
        F.col("__span.end").alias("chunk_end"),
        F.col("__span.boundary").alias("boundary"),
        F.col("__text").substr(F.col("__span.start") + 1, F.col("__span.end") - F.col("__span.start")).alias("chunk_text"),
    )
