"""Tells machine-made, built, copied and bulk-data files from hand-written source."""

from __future__ import annotations

import json
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CODE = r"(?i)\.(ts|mts|tsx|js|mjs|cjs|jsx)$"
#: Contents and bytes of text of the bounded training sample, chosen by their hash, bytes of a text beyond which it is not trained on, and files of no class kept from the sample.
SAMPLE_CONTENTS, SAMPLE_BYTES, SAMPLE_TEXT, SAMPLE_PLAIN = 12_000, 24 << 20, 256 << 10, 2_000
#: Buckets of hashed character n-grams and of hashed path parts; length of an n-gram.
GRAM_BUCKETS, PART_BUCKETS, GRAM = 1 << 14, 1 << 10, 5
#: Margins among which held-out repositories choose the one from which a file is put in a class.
DECISIONS = tuple(round(0.05 * i, 2) for i in range(17))
CLASSES = ("generated", "built", "third_party", "data")

_HEADER = re.compile(r"\A﻿?(?:\s*(?://[^\n]*|/\*.*?(?:\*/|\Z)|#![^\n]*))*", re.S)
_TAIL = re.compile(r"//[#@] ?source(?:Mapping)?URL=[^\n]*")
_GENERATED = re.compile(r"@generated|auto-?generated|automatically generated|\b(?:code )?generated (?:by|from)\b|do not (?:edit|modify)|instead of editing|will be overwritten", re.I)
_BANNER = re.compile(r"@preserve|@license|\(c\) |licen[cs]e: |released under|freely distributed|^\s*/\*!", re.I | re.M)
_BUILT = re.compile(r"__esModule|\b__(?:assign|extends|awaiter|rest)\b|__webpack_|=== void 0")
_PATH = {
    "generated": re.compile(r"(?:^|/)__generated__/|[._](?:gen|pb|generated|autogen)\.[a-z]+$", re.I),
    "built": re.compile(r"[.-](?:min|bundle)\.[a-z]+$|(?:^|/)(?:dist|out|build)/[^/]+\.min\.", re.I),
    "third_party": re.compile(r"(?:^|/)(?:vendor|third_party|external|contrib|node_modules|bower_components)/", re.I),
}
#: Folders and words of file names that name the class.
_TELLING = frozenset("__generated__ gen pb generated autogen min bundle vendor third_party external contrib node_modules bower_components".split())
_LITERAL = re.compile(r"`[^`]*`|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", re.S)
_NUMBERS = re.compile(r"\[[\s\d.,+\-eExXa-fA-F\[\]]{200,}\]?")
_SCOPE = re.compile(r"""['"]@([\w.-]+)/""")


def body_of(text: str) -> str:
    """The text without its opening comments and source-map line, which would give the class away."""
    return _TAIL.sub("", text[_HEADER.match(text).end() :])


def weak_classes(path: str, text: str) -> tuple[bool, ...]:
    """Classes that giveaways show: notices and banners in the opening comments, telling paths, and the shape of the text."""
    header = _HEADER.match(text).group()
    body = text[len(header) :]
    size = max(1, len(body))
    lines = body.split("\n")
    dense = max(map(len, lines)) >= 300 and sum(c.isspace() for c in body) < 0.1 * size and sum(not c.isalnum() for c in body) > 0.22 * size
    # Prose is a fifth of spaces; encoded or tabular data has few.
    literal = max((len(m.group()) for m in _LITERAL.finditer(body) if 10 * sum(c.isspace() for c in m.group()) < len(m.group())), default=0)
    numbers = sum(len(m.group()) for m in _NUMBERS.finditer(body))
    data = len(body) > 200 and max(literal, numbers) > 0.75 * len(body)
    generated = bool(_GENERATED.search(header)) or bool(_PATH["generated"].search(path))
    built = not data and (dense or bool(_PATH["built"].search(path)) or len(_BUILT.findall(body)) >= 2)
    banner = bool(_BANNER.search(header)) and not dense
    return generated, built, banner or bool(_PATH["third_party"].search(path)), data


def parts_of(path: str, scope: str, copies: int) -> list[str]:
    """Path components and words without those that name the class, and what the file's surroundings say: whose package scopes it names, and whether other repositories hold the same content."""
    folders = path.lower().split("/")
    name = folders.pop()
    words = re.split(r"[._-]+|\d+", name)
    return [f"d:{f}" for f in folders if f not in _TELLING] + [f"w:{w}" for w in words if w and w not in _TELLING] + [f"n:{len(folders)}", f"s:{scope}", "c:many" if copies > 1 else "c:one"]


def part_numbers(parts: list[str]) -> list[int]:
    import xxhash

    return [xxhash.xxh32_intdigest(p) % PART_BUCKETS for p in parts]


def gram_features(bodies: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Body, bucket and value of the character n-grams of all bodies: logarithms of counts, each body scaled to a norm of one. Digits are one character."""
    encoded = [b.encode("utf-8", "replace") for b in bodies]
    data = np.frombuffer(b"\n".join(encoded) + b"\n" * GRAM, np.uint8).copy()
    data[(data >= 48) & (data <= 57)] = 48
    n = len(data) - GRAM + 1
    h = np.zeros(n, np.uint32)
    for i in range(GRAM):
        h = h * np.uint32(0x01000193) ^ data[i : i + n]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    bucket = ((h >> np.uint32(12)) % np.uint32(GRAM_BUCKETS)).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum([len(e) + 1 for e in encoded])])
    rows, columns, values = [], [], []
    for i in range(len(encoded)):
        counts = np.bincount(bucket[bounds[i] : bounds[i + 1]], minlength=GRAM_BUCKETS)
        at = np.flatnonzero(counts)
        v = 1 + np.log(counts[at])
        rows.append(np.full(len(at), i))
        columns.append(at)
        values.append(v / np.sqrt(v @ v) if len(at) else v)
    return tuple(np.concatenate(x) if x else np.empty(0, int) for x in (rows, columns, values))


@dataclass
class Classifiers:
    """Linear support-vector classifiers, one for each class: weights of n-grams (per thousand) and of path parts, and an offset."""

    grams: np.ndarray
    parts: np.ndarray
    offset: np.ndarray
    #: Margin from which a file is in each class.
    decision: np.ndarray

    def text_scores(self, bodies: list[str]) -> np.ndarray:
        row, column, value = gram_features(bodies)
        return np.stack([np.bincount(row, value * self.grams[column, c], minlength=len(bodies)) for c in range(len(CLASSES))], 1)

    def path_scores(self, paths: list[str], scopes: list[str], copies: list[int]) -> np.ndarray:
        numbers = [part_numbers(parts_of(*x)) for x in zip(paths, scopes, copies)]
        return np.array([self.parts[n].sum(0) / len(n) ** 0.5 for n in numbers]).reshape(-1, len(CLASSES)) + self.offset


def _fit(features, labels: np.ndarray, weight: np.ndarray, penalty: float = 3e-6, rounds: int = 100) -> np.ndarray:
    """Weights that minimise the mean squared hinge loss with an L2 penalty, by accelerated gradient steps over the whole sample.

    Rows have a norm of at most the root of three, which bounds the curvature and so gives the step.
    """
    row, column, value, size = features
    y = np.where(labels, 1.0, -1.0).astype(np.float32)
    share = (weight / weight.sum(0)).astype(np.float32)
    # Entries by row for margins and by column for gradients; every row has its constant feature.
    by_row, by_column = np.argsort(row, kind="stable"), np.argsort(column, kind="stable")
    rows_at = np.flatnonzero(np.diff(row[by_row], prepend=-1))
    columns_at = np.flatnonzero(np.diff(column[by_column], prepend=-1))
    known = column[by_column][columns_at]
    row_column, row_value = column[by_row], value[by_row, None].astype(np.float32)
    column_row, column_value = row[by_column], value[by_column, None].astype(np.float32)
    w = look = np.zeros((size, labels.shape[1]), np.float32)
    t, rate = 1.0, np.float32(1.0 / (2 * 3 + penalty))
    for _ in range(rounds):
        margin = np.add.reduceat(row_value * look[row_column], rows_at, axis=0)
        pull = 2 * share * y * np.maximum(0, 1 - y * margin)
        gradient = np.float32(penalty) * look
        gradient[known] -= np.add.reduceat(column_value * pull[column_row], columns_at, axis=0)
        new = look - rate * gradient
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        look = new + np.float32((t - 1) / s) * (new - w)
        w, t = new, s
    return w.astype(np.float64)


def train(paths: list[str], texts: list[str], scopes: list[str], copies: list[int], repositories: list[int], most_plain: int = SAMPLE_PLAIN) -> tuple[Classifiers, dict]:
    """Classifiers fitted to the weak classes with giveaways masked, and what they do on repositories that were held out.

    Files without a giveaway that a first fit places firmly in a class are then taken for members, those near the border are left out, and the fit is repeated.
    First this is done without a fifth of the repositories; all files of these choose the margins from which a file is in a class. The last fit is to all.
    Of files without a giveaway the first ``most_plain`` are fitted to.
    """
    labels = np.array([weak_classes(p, t) for p, t in zip(paths, texts)])
    row, column, value = gram_features([body_of(t) for t in texts])
    numbers = [part_numbers(parts_of(p, s, c)) for p, s, c in zip(paths, scopes, copies)]
    sizes = np.array([len(x) for x in numbers])
    row = np.concatenate([row, np.repeat(np.arange(len(texts)), sizes), np.arange(len(texts))]).astype(np.int32)
    column = np.concatenate([column, np.concatenate(numbers).astype(np.int64) + GRAM_BUCKETS, np.full(len(texts), GRAM_BUCKETS + PART_BUCKETS)]).astype(np.int32)
    value = np.concatenate([value, np.repeat(1 / np.sqrt(sizes), sizes), np.ones(len(texts))]).astype(np.float32)
    held = np.array([r % 5 == 0 for r in repositories])
    any_label = labels.any(1)
    plain = ~any_label & (np.cumsum(~any_label) <= most_plain)
    # Data is known by its shape, not by a mark that may be missing, so what has not the shape stays outside the class.
    marks = np.arange(len(CLASSES)) != CLASSES.index("data")

    def weights(y: np.ndarray, used: np.ndarray) -> np.ndarray:
        out = np.ones(y.shape) * used[:, None]
        for c in range(y.shape[1]):
            positive = y[:, c] & used
            out[positive, c] = np.clip((used.sum() - positive.sum()) / max(1, positive.sum()), 1, 10) ** 0.5
        return out

    def fit(y: np.ndarray, used: np.ndarray, rounds: int = 100) -> np.ndarray:
        number = np.cumsum(used) - 1
        at = used[row]
        return _fit((number[row[at]], column[at], value[at], GRAM_BUCKETS + PART_BUCKETS + 1), y[used], weights(y, used)[used], rounds=rounds)

    def margins(w: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(row, value * w[column, c], minlength=len(texts)) for c in range(len(CLASSES))], 1)

    def twice(used: np.ndarray) -> np.ndarray:
        first = margins(fit(labels, used, 50))
        second = labels | ((first > 0.5) & marks & ~any_label[:, None])
        nearest = first[:, marks].max(1)
        unsure = ~any_label & (nearest > -0.1) & (nearest <= 0.5)
        return fit(second, used & ~unsure)

    decision, report = np.full(len(CLASSES), DECISIONS[len(DECISIONS) // 2]), {"held_out": int(held.sum()), "marked": int((held & any_label).sum())}
    used = any_label | plain
    if held.any() and (labels & ~held[:, None]).any() and (plain & ~held).any():
        scores = margins(twice(used & ~held))
        decision = np.where(marks, border(scores[held][:, marks].max(1)), known_border(scores[held][:, ~marks][:, 0], labels[held][:, ~marks][:, 0]))
        over = scores - decision
        found = over.max(1) > 0
        report |= {"found_marked": int((held & any_label & found).sum()), "found_unmarked": int((held & ~any_label & found).sum()), "near_border": int((held & (np.abs(over).min(1) < 0.1)).sum())}
    w = twice(used)
    return Classifiers(w[:GRAM_BUCKETS].astype(np.float32), w[GRAM_BUCKETS:-1], w[-1], decision), report | {f"from_{c}": float(d) for c, d in zip(CLASSES, decision)} | {"trained_on": int(used.sum())}


def border(scores: np.ndarray) -> float:
    """The margin of DECISIONS around which scores are rarest, the middle one of equal ones: that a file bears no mark says
    nothing, but files of either sort lie close together."""
    near = np.array([(np.abs(scores - d) < 0.15).sum() for d in DECISIONS])
    best = np.flatnonzero(near == near.min())
    return DECISIONS[int(best[len(best) // 2])]


def known_border(scores: np.ndarray, labels: np.ndarray) -> float:
    """The margin of DECISIONS that parts known members from others best, at three quarters of equal ones, as members are the fewer."""
    wrong = np.array([(labels & (scores <= d)).sum() + (~labels & (scores > d)).sum() for d in DECISIONS])
    best = np.flatnonzero(wrong == wrong.min())
    return DECISIONS[int(best[len(best) * 3 // 4])]


def _sha(name: str):
    sha = F.lower(F.trim(name))
    return F.when(sha.rlike("^[0-9a-f]{64}$"), F.unhex(sha)).otherwise(F.encode(sha, "UTF-8"))


def code_files(versions: DataFrame, artifacts: DataFrame, repositories: DataFrame) -> DataFrame:
    """``artifact_id, sha, path, repository_id, own, copies``: each content of each code path once, with its repository's name and whether others hold it."""
    paths = artifacts.filter(F.col("path").rlike(CODE)).groupBy(F.col("id").alias("artifact_id")).agg(F.min("path").alias("path"), F.min("repository_id").alias("repository_id"))
    names = repositories.groupBy(F.col("id").alias("repository_id")).agg(F.min(F.lower(F.trim("repo_name"))).alias("own"))
    held = versions.select("artifact_id", _sha("content_sha256").alias("sha")).distinct().join(paths, "artifact_id").join(names, "repository_id", "left")
    spread = held.groupBy("sha").agg((F.min("repository_id") != F.max("repository_id")).alias("many"))
    return held.join(spread, "sha").withColumn("copies", F.when(F.col("many"), 2).otherwise(1)).drop("many")


def _scope(scopes, path: str, own: str):
    package = F.regexp_extract(F.lower(path), r"(?:^|/)packages/([^/]+)/", 1)
    return F.when(F.coalesce(F.size(scopes), F.lit(0)) <= 0, "none").when(F.exists(scopes, lambda s: (s == F.coalesce(F.col(own), F.lit(""))) | (s == package)), "own").otherwise("foreign")


def scopes_of(text: str) -> list[str]:
    return sorted({s.lower() for s in _SCOPE.findall(text)})


def _own(own: str | None, path: str) -> set[str]:
    return {own or "", *re.findall(r"(?:^|/)packages/([^/]+)/", path.lower())[:1]}


def _train_table(sample: pa.Table) -> pa.Table:
    rows = sample.sort_by("sha").to_pylist()
    marked = [any(weak_classes(r["path"], r["text"])) for r in rows]
    left = SAMPLE_PLAIN
    used = []
    for r, m in zip(rows, marked):
        left -= not m
        if m or left >= 0 or (r["repository_id"] or 0) % 5 == 0:
            used.append(r)
    if not any(marked) or all(marked):
        return pa.table({"fitted": pa.array([], pa.binary()), "report": pa.array([], pa.string())})
    named = [scopes_of(r["text"]) for r in used]
    scope = ["none" if not n else "own" if _own(r["own"], r["path"]) & set(n) else "foreign" for r, n in zip(used, named)]
    fitted, report = train([r["path"] for r in used], [r["text"] for r in used], scope, [r["copies"] for r in used], [r["repository_id"] or 0 for r in used])
    return pa.table({"fitted": [pickle.dumps(fitted)], "report": [json.dumps(report)]})


def train_on(files: DataFrame, contents: DataFrame, sample_contents: int = SAMPLE_CONTENTS, sample_bytes: int = SAMPLE_BYTES) -> tuple[Classifiers | None, dict]:
    """Fits the classifiers on about ``sample_contents`` contents chosen by their hash, and not much more than ``sample_bytes`` of text: all marked files among them and SAMPLE_PLAIN others.

    The fit is one task, which holds no more than that; only the weights come to the driver. Texts longer than SAMPLE_TEXT are scored like all others but not trained on.
    """
    short = contents.filter(F.octet_length("text") <= SAMPLE_TEXT)
    size = short.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    step = max(1, size["n"] // sample_contents, -(-(size["b"] or 0) // sample_bytes))
    chosen = lambda df: df.filter(F.pmod(F.xxhash64("sha"), F.lit(step)) == 0)
    texts = chosen(short.select(_sha("sha256").alias("sha"), "text"))
    one = chosen(files).groupBy("sha").agg(F.min(F.struct("path", "repository_id", "own", "copies")).alias("f"))
    sample = texts.join(one, "sha").dropDuplicates(["sha"]).select("sha", "text", "f.*")
    found = sample.withColumn("whole", F.lit("sample")).groupBy("whole").applyInArrow(_train_table, "fitted binary, report string").collect()
    return (pickle.loads(found[0]["fitted"]), json.loads(found[0]["report"])) if found else (None, {})


def held_out_report(versions: DataFrame, artifacts: DataFrame, contents: DataFrame, repositories: DataFrame) -> DataFrame:
    """``measure, value``: the margin that held-out repositories chose, and how many of their marked and unmarked files it finds."""
    report = train_on(code_files(versions, artifacts, repositories), contents)[1]
    return versions.sparkSession.createDataFrame([(k, float(v)) for k, v in report.items()], "measure string, value double")


def not_handwritten(versions: DataFrame, artifacts: DataFrame, contents: DataFrame, repositories: DataFrame) -> DataFrame:
    """``version_id, reason, margin``: versions of code files that are not written by hand.

    The classifiers are linear, so a file's margin is that of its text plus that of its path: every content is scored
    once where it is read and only the scores move, never the text. The reason is the class with the greatest margin.

    Files without any text, contents that are missing, and versions without an artifact row are no cases; repeated rows
    count once; a null path is no code. Without marked or without plain files in the sample nothing can be told and nothing comes out.
    """
    files = code_files(versions, artifacts, repositories)
    fitted, _ = train_on(files, contents)
    spark = versions.sparkSession
    kind = versions.schema["id"].dataType.simpleString()
    if fitted is None:
        return spark.createDataFrame([], f"version_id {kind}, reason string, margin double")
    shared = spark.sparkContext.broadcast(fitted)

    def score_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                texts = batch.column(1).slice(a, 512).to_pylist()
                scores = own.text_scores([body_of(t) for t in texts]).astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, 512), pa.array(list(scores), pa.list_(pa.float32())), pa.array([scopes_of(t) for t in texts], pa.list_(pa.string()))], names=["sha", "text_scores", "scopes"]
                )

    def score_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            paths, scopes, copies = (batch.column(i).to_pylist() for i in (2, 3, 4))
            texts = np.asarray(batch.column(5).flatten()).reshape(-1, len(CLASSES))
            total = texts + own.path_scores(paths, scopes, copies)
            over = total - own.decision
            keep = np.flatnonzero(over.max(1) > 0) if len(total) else np.empty(0, int)
            take = pa.array(keep)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array([CLASSES[i] for i in over[keep].argmax(1)], pa.string()), pa.array(total[keep].max(1).astype(np.float64))],
                names=["artifact_id", "sha", "reason", "margin"],
            )

    scored = (
        contents.select(_sha("sha256").alias("sha"), "text").filter(F.length(F.trim("text")) > 0).mapInArrow(score_texts, "sha binary, text_scores array<float>, scopes array<string>").dropDuplicates(["sha"])
    )
    named = files.join(scored, "sha").select("artifact_id", "sha", "path", _scope(F.col("scopes"), "path", "own").alias("scope"), "copies", "text_scores")
    artifact = versions.schema["artifact_id"].dataType.simpleString()
    found = named.mapInArrow(score_paths, f"artifact_id {artifact}, sha binary, reason string, margin double")
    every = versions.select(F.col("id").alias("version_id"), "artifact_id", _sha("content_sha256").alias("sha")).filter("version_id IS NOT NULL")
    return every.join(found, ["artifact_id", "sha"]).groupBy("version_id").agg(F.max(F.struct("margin", "reason")).alias("m")).select("version_id", "m.reason", "m.margin")
