"""Embedding inputs, embeddings cached by hash, and exact similarity ranking."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewake.functions import vectors

#: Fixed values of the input format.
WIDEST_LABEL = len("search_document: File:  (Chunk 999999)\n\n")
LEAST_BUDGET = 200
MARKDOWN, CODE = (".md", ".mdx"), (".ts", ".js", ".tsx", ".jsx")


def _units(text: str) -> int:
    """Length in UTF-16 code units."""
    return len(text) + sum(c > "￿" for c in text)


def _lines(text: str) -> list[str]:
    return [line + "\n" for line in text.split("\n")]


def _slices(text: str, budget: int) -> Iterator[str]:
    part, size = [], 0
    for c in text:
        n = 2 if c > "￿" else 1
        if size + n > budget and part:
            yield "".join(part)
            part, size = [], 0
        part.append(c)
        size += n
    if part:
        yield "".join(part)


def _fill(parts, budget: int, larger: Callable[[str], Iterator[str]]) -> Iterator[str]:
    """Joins neighbours while they fit; a part over the budget is handed on."""
    held = ""
    for part in parts:
        if _units(held) + _units(part) <= budget:
            held += part
            continue
        if held:
            yield held
        if _units(part) > budget:
            yield from larger(part)
            held = ""
        else:
            held = part
    if held:
        yield held


def parts_of(path: str, text: str) -> list[str]:
    lower = path.lower()
    if lower.endswith(MARKDOWN):
        return re.split(r"(?m)(?=^#+ )", text)
    if lower.endswith(CODE):
        return re.split(r"(?m)(?=^\s*(?:export |function |class ))", text)
    return _lines(text)


def split_parts(path: Column, text: Column) -> Column:
    """The parts of a text as :func:`parts_of` cuts it, those that are not empty, without leaving the JVM."""
    lower = F.lower(path)
    ends = lambda suffixes: reduce(lambda a, b: a | b, (lower.endswith(s) for s in suffixes))
    lines = F.transform(F.split(text, "\n"), lambda line: F.concat(line, F.lit("\n")))
    cut = F.when(ends(MARKDOWN), F.split(text, r"(?m)(?=^#+ )")).when(ends(CODE), F.split(text, r"(?m)(?=^\s*(?:export |function |class ))")).otherwise(lines)
    return F.filter(cut, lambda p: F.length(p) > 0)


def embedding_inputs(path: str, text: str, most: int) -> list[str]:
    """The inputs of one file: the whole, or numbered pieces of at most ``most`` UTF-16 units."""
    whole = f"search_document: File: {path}\n\n{text}"
    if _units(whole) <= most:
        return [whole]
    budget = most - WIDEST_LABEL - _units(path)
    if budget < LEAST_BUDGET:
        raise ValueError(f"the path {path!r} leaves no room within {most} characters")
    by_lines = lambda part: _fill(_lines(part), budget, lambda line: _slices(line, budget))
    return [f"search_document: File: {path} (Chunk {i})\n\n{c}" for i, c in enumerate(_fill(parts_of(path, text), budget, by_lines))]


#: Fixed values of the older input format: units up to which a file stays whole, and units below which parts are joined.
OLD_WHOLE, OLD_PART = 28_672, 25_000


def _packed(parts, size: Callable[[str], int], larger: Callable[[str], list[str]]) -> list[str]:
    """Neighbours joined while they stay below OLD_PART; a part above it is handed on."""
    found, held = [], ""
    for part in parts:
        if _units(held) + size(part) < OLD_PART:
            held += part
            continue
        found += [held] if held else []
        over = _units(part) > OLD_PART
        found += larger(part) if over else []
        held = "" if over else part
    return found + ([held] if held else [])


def older_inputs(path: str, text: str) -> list[str]:
    """The inputs of one file in the older format, whose parts are larger and whose lines are never cut."""
    whole = f"search_document: File: {path}\n\n{text}"
    if _units(whole) <= OLD_WHOLE:
        return [whole]
    by_lines = lambda part: _packed(_lines(part), lambda line: _units(line) - 1, lambda line: [line])
    return [f"search_document: File: {path} (Chunk {i})\n\n{c}" for i, c in enumerate(_packed(parts_of(path, text), _units, by_lines))]


def first_hits(scored: DataFrame, by: list[str]) -> DataFrame:
    """Of each path its most similar chunk, with ``rank`` by similarity and path."""
    best = scored.groupBy(*by, "path").agg(F.max("similarity").alias("similarity"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("similarity"), "path")))


def chunk_files(files: DataFrame, most: int, path: str = "path", text: str = "text") -> DataFrame:
    """Adds ``chunk_index, input, input_hash`` to each file, a row for each input. Packing is greedy, so it runs per file in Python; files are independent."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(paths: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([embedding_inputs(p, t, most) if t is not None else [] for p, t in zip(paths, texts)])

    kept = [c for c in files.columns if c != text]
    rows = files.withColumn("__inputs", split(F.col(path), F.col(text))).select(*kept, F.posexplode("__inputs").alias("chunk_index", "input"))
    return rows.withColumn("input_hash", F.sha2("input", 256))


def missing_inputs(chunks: DataFrame, known: DataFrame, model: str) -> DataFrame:
    """Inputs that the model has no embedding of yet, once each."""
    have = known.filter(F.col("model_id") == model).select("input_hash")
    return chunks.select("input_hash", "input").dropDuplicates(["input_hash"]).join(have, "input_hash", "left_anti")


def embed(inputs: DataFrame, provider: Callable[[list[str]], list[list[float]]], model: str, batch: int = 16) -> DataFrame:
    """``model_id, input_hash, dimensions, vector``. ``provider`` is called on executors with up to ``batch`` texts; a rejected batch is tried text by text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, found = frame["input"].tolist(), []
            for i in range(0, len(texts), batch):
                try:
                    found += provider(texts[i : i + batch])
                except ValueError:
                    for t in texts[i : i + batch]:
                        found += provider([t])
            yield pd.DataFrame({"model_id": model, "input_hash": frame["input_hash"], "dimensions": [len(v) for v in found], "vector": found})

    return inputs.mapInPandas(run, "model_id string, input_hash string, dimensions int, vector array<float>")


def word_count_vector(text: Column, vocabulary: list[str]) -> Column:
    """A predictable embedding for tests: occurrences of each word, and 0.01."""
    lower = F.lower(text)
    return F.array(*[(F.size(F.split(lower, re.escape(w))) - 1).cast("float") for w in vocabulary], F.lit(0.01).cast("float"))


def check_compatible(known: DataFrame, model: str, dimensions: int) -> None:
    other = known.filter((F.col("model_id") == model) & (F.col("dimensions") != dimensions)).limit(1).count()
    if other:
        raise ValueError(f"embeddings of {model} exist with other than {dimensions} dimensions")


def chunk_similarity(chunks: DataFrame, embeddings: DataFrame, queries: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Chunks with ``similarity`` to the query of their ``model_id``. Each embedding is compared once, however many chunks share it.

    With ``by``, columns of chunks and queries, every group has a query of its own, and chunks meet that of their group.
    """
    valid = embeddings.filter(vectors.is_valid(F.col("vector"), F.col("dimensions"))).dropDuplicates(["model_id", "input_hash"])
    each = chunks.dropDuplicates(["model_id", "snapshot_id", "artifact_id", "chunk_index"])
    asked = queries.select("model_id", *by, F.col("vector").alias("query"))
    if by:
        return each.join(asked, ["model_id", *by]).join(valid.select("model_id", "input_hash", "vector"), ["model_id", "input_hash"]).withColumn("similarity", vectors.cosine(F.col("vector"), F.col("query"))).drop("vector", "query")
    scored = valid.join(asked, "model_id").select("model_id", "input_hash", vectors.cosine(F.col("vector"), F.col("query")).alias("similarity"))
    return each.join(scored, ["model_id", "input_hash"])


#: UTF-16 units of a chunk that evidence shows, and the least limit that chunking is tried again with.
CHUNK_CHARACTERS, LEAST_LIMIT = 1000, 100


def reconstruct_chunks(files: DataFrame, chunks: DataFrame, most: int) -> DataFrame:
    """Chunks (``artifact_id, chunk_index, input_hash``) with ``chunk_text``: the source text of the embedded input, null if it cannot be made again.

    ``files`` has ``artifact_id, path, text``. A file is cut again at ``most`` units and, as indexing does after a rejection, at halves of it, until an input has the stored hash.
    """

    @F.pandas_udf(T.StringType())
    def again(paths: pd.Series, texts: pd.Series, index: pd.Series, wanted: pd.Series) -> pd.Series:
        out = []
        for p, t, i, h in zip(paths, texts, index, wanted):
            limit, found = most, None
            while found is None and t is not None and limit >= LEAST_LIMIT:
                try:
                    inputs = embedding_inputs(p, t, limit)
                except ValueError:
                    break
                if i < len(inputs) and hashlib.sha256(inputs[i].encode("utf-8", "replace")).hexdigest() == h:
                    found = inputs[i].split("\n\n", 1)[1]
                limit //= 2
            out.append(found)
        return pd.Series(out, dtype=object)

    rows = chunks.drop("path", "text").join(files.select("artifact_id", "path", "text"), "artifact_id")
    return rows.withColumn("chunk_text", again("path", "text", "chunk_index", "input_hash")).drop("path", "text")


def best_chunks(scored: DataFrame, by: list[str]) -> DataFrame:
    """The most similar chunk of each artifact, the lower index among equals."""
    best = F.max(F.struct("similarity", (-F.col("chunk_index")).alias("chunk"), "input_hash"))
    return scored.groupBy(*by, "artifact_id").agg(best.alias("b"), F.count("*").alias("n_chunks")).select(
        *by, "artifact_id", "b.similarity", (-F.col("b.chunk")).cast("int").alias("best_chunk_index"), "n_chunks"
    )


def semantic_rank(best: DataFrame, by: list[str]) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("similarity"), "path", "artifact_id")
    return best.withColumn("rank", F.row_number().over(order))
