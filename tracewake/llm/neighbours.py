"""The most similar vectors of every vector, by balanced posting lists around graph-searched centroids."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of the bounded sample that centroids are fitted on, at most this many (about) for each model.
SAMPLE_ROWS = 24_000
#: Vectors that a posting list is meant to hold, before replication, and the most lists of a model.
LIST_ROWS = 256
MAX_LISTS = 4096
#: Members of a list from which it gets lists of its own, so that work stays in proportion where lists grow, and
#: members that a list is expected to hold from which it is searched in pairs of blocks, so that no task holds it all.
SPLIT_ROWS, BLOCK_ROWS = 4096, 65_536
#: Neighbours of a centroid in the graph, and the width of its search.
DEGREE, BEAM = 20, 8


@dataclass
class Index:
    """Centroids of one model, the graph between them, entry points, and search blocks by list."""

    centroids: np.ndarray
    graph: np.ndarray
    entries: np.ndarray
    blocks: np.ndarray

    def search(self, queries: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the best centroids of each query, best first, by a best-first walk of the graph."""
        parts = [self._search(queries[i : i + 2048], beam) for i in range(0, len(queries), 2048)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        count, n = len(self.centroids), len(q)
        beam = min(beam, count)
        first = q @ self.centroids[self.entries].T
        take = min(beam, len(self.entries))
        order = np.argpartition(-first, take - 1, axis=1)[:, :take]
        ids, sims = np.full((n, beam), -1), np.full((n, beam), -np.inf, dtype=np.float32)
        ids[:, :take], sims[:, :take] = self.entries[order], np.take_along_axis(first, order, 1)
        if len(self.entries) < count:
            seen, open_ = np.zeros((n, count), dtype=bool), ids >= 0
            seen[:, self.entries] = True
            active = np.arange(n)
            while len(active):
                waiting = np.where(open_[active], sims[active], -np.inf)
                at = waiting.argmax(1)
                alive = waiting[np.arange(len(active)), at] > -np.inf
                active, at = active[alive], at[alive]
                if not len(active):
                    break
                open_[active, at] = False
                near = self.graph[ids[active, at]]
                fresh = ~seen[active[:, None], near]
                seen[active[:, None], near] = True
                found = np.einsum("bgd,bd->bg", self.centroids[near], q[active])
                found[~fresh] = -np.inf
                all_sims = np.concatenate([sims[active], found], 1)
                best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
                sims[active] = np.take_along_axis(all_sims, best, 1)
                ids[active] = np.take_along_axis(np.concatenate([ids[active], near], 1), best, 1)
                open_[active] = np.take_along_axis(np.concatenate([open_[active], fresh], 1), best, 1)
                open_[active] &= sims[active] > -np.inf
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def fit_index(sample: np.ndarray, rows: int, list_rows: int = LIST_ROWS, max_lists: int = MAX_LISTS, block_rows: int = BLOCK_ROWS) -> Index:
    """Balanced spherical k-means on ``sample`` (unit vectors) of a collection of ``rows``."""
    rng = np.random.default_rng(20)
    lists = int(min(max(1, rows // list_rows), max_lists, max(1, len(sample) // 4)))
    distinct = np.unique(sample, axis=0)
    lists = min(lists, len(distinct))
    centroids = distinct[rng.choice(len(distinct), lists, replace=False)].astype(np.float32)
    penalty = np.zeros(lists, dtype=np.float32)
    for _ in range(10):
        own = (sample @ centroids.T - penalty).argmax(1)
        size = np.bincount(own, minlength=lists)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 0, sums / np.maximum(norm, 1e-9), centroids).astype(np.float32)
        # An overfull list pushes its border away; an empty one moves into the fullest.
        penalty = (0.02 * np.clip(np.log(np.maximum(size, 1) * lists / len(sample)), -2, 2)).astype(np.float32)
        for empty in np.flatnonzero(size == 0):
            centroids[empty] = sample[rng.choice(np.flatnonzero(own == size.argmax()))]
    share = np.bincount((sample @ centroids.T).argmax(1), minlength=lists) / len(sample)
    near = centroids @ centroids.T
    np.fill_diagonal(near, -2)
    degree = max(1, min(DEGREE, lists - 1))
    graph = np.argsort(-near, axis=1)[:, :degree]
    count = min(lists, max(48, 4 * int(lists**0.5)))
    return Index(centroids, graph, np.sort(rng.choice(lists, count, replace=False)), np.ceil(share * rows * 2 / block_rows).clip(1).astype(int))


def _unit(vectors: pa.Array, dimensions: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and unit vectors of the valid vectors of a batch, by number of dimensions."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(vectors), -1))
    wanted = np.asarray(pc.fill_null(dimensions, -2)) if dimensions is not None else lengths
    found = []
    for d in np.unique(lengths[(lengths == wanted) & (lengths > 0)]):
        at = np.flatnonzero((lengths == d) & (lengths == wanted))
        flat = pc.list_flatten(vectors.take(pa.array(at)))
        x = np.asarray(flat.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, d)
        norm = np.sqrt((x * x).sum(1))
        good = np.isfinite(norm) & (norm > 0)
        found.append((at[good], (x[good] / norm[good, None]).astype(np.float32)))
    return found


#: Vectors move as 16-bit fixed point, half the bytes of floats: a cosine then errs by about 1e-5.
_STEP = np.float32(1 / 32767)


def pack(unit: np.ndarray) -> list[bytes]:
    return [c.tobytes() for c in np.round(unit / _STEP).astype(np.int16)]


def unpack(packed: list[bytes]) -> np.ndarray:
    x = np.stack([np.frombuffer(b, np.int16) for b in packed]).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


PREPARED = "model string, key string, class binary, unit binary"


def prepared(rows: DataFrame, model: str, key: str, vector: str, dimensions: str | None) -> DataFrame:
    """Unit vectors in fixed point with a digest of the direction; vectors that are null, zero, not finite or of wrong length are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, unit in _unit(batch.column(2), batch.column(3) if dimensions else None):
                if len(at):
                    # Rounded, so that one direction has one digest whatever the length.
                    codes = np.round(unit * 2**20).astype(np.int32)
                    take = pa.array(at)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pc.binary_join_element_wise(batch.column(0).take(take).cast(pa.string()), str(unit.shape[1]), "\x1f"),
                            batch.column(1).take(take).cast(pa.string()),
                            pa.array([hashlib.blake2b(c.tobytes(), digest_size=12).digest() for c in codes], pa.binary()),
                            pa.array(pack(unit), pa.binary()),
                        ],
                        names=["model", "key", "class", "unit"],
                    )

    columns = [F.col(model).cast("string").alias("model"), F.col(key).cast("string").alias("key"), F.col(vector).alias("vector")]
    return (
        rows.select(*columns, *([F.col(dimensions).alias("dimensions")] if dimensions else []))
        .filter("model IS NOT NULL AND key IS NOT NULL AND vector IS NOT NULL")
        .mapInArrow(run, PREPARED)
    )


def fit(rows: DataFrame, sample_rows: int = SAMPLE_ROWS, list_rows: int = LIST_ROWS, max_lists: int = MAX_LISTS, block_rows: int = BLOCK_ROWS) -> dict[str, Index]:
    """An index for each model of ``rows`` (as from :func:`prepared`), fitted on executors.

    Each model's sample holds about ``sample_rows`` rows chosen by a hash of the key. Only centroids
    come to the driver: at most MAX_LISTS of a model.
    """
    counts = {r["model"]: r["n"] for r in rows.groupBy("model").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    step = F.create_map(*[F.lit(x) for m, n in counts.items() for x in (m, max(1, n // sample_rows))])
    sample = rows.filter(F.pmod(F.xxhash64("key"), step[F.col("model")]) == 0).select("model", "unit")

    def one(table: pa.Table) -> pa.Table:
        name = table.column("model")[0].as_py()
        x = unpack(table.column("unit").to_pylist())
        index = fit_index(x, counts[name], list_rows, max_lists, block_rows)
        dump = [getattr(index, f).astype(t).tobytes() for f, t in (("centroids", np.float32), ("graph", np.int32), ("entries", np.int32), ("blocks", np.int32))]
        return pa.table({"model": [name], "dims": [x.shape[1]], **{f"p{i}": pa.array([d], pa.binary()) for i, d in enumerate(dump)}})

    found = sample.groupBy("model").applyInArrow(one, "model string, dims long, p0 binary, p1 binary, p2 binary, p3 binary").collect()
    result = {}
    for r in found:
        lists = len(r["p3"]) // 4
        result[r["model"]] = Index(
            np.frombuffer(r["p0"], np.float32).reshape(lists, r["dims"]), np.frombuffer(r["p1"], np.int32).reshape(lists, -1), np.frombuffer(r["p2"], np.int32), np.frombuffer(r["p3"], np.int32)
        )
    return result


CELLS = "model string, cell long, member boolean, query boolean, key string, unit binary"


def _post(rows: DataFrame, indexes, lists: int, member_ratio: float, query_lists: int, query_ratio: float) -> DataFrame:
    """Sends each row to the cells in which it is a member or asks.

    A list is a cell unless it was expected to be large; then its members and queries are cut into blocks by
    a hash and every pair of blocks is a cell, so that no task holds the list and every query meets every member.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = indexes.value
        for batch in batches:
            models = batch.column(0).to_pylist()
            asks = np.asarray(batch.column(4).to_numpy(zero_copy_only=False), bool)
            holds = np.asarray(batch.column(5).to_numpy(zero_copy_only=False), bool)
            for name in dict.fromkeys(models):
                index = known.get(name)
                if index is None:
                    continue
                at = np.flatnonzero(np.array([m == name for m in models]))
                x = unpack(batch.column(3).take(pa.array(at)).to_pylist())
                ids, sims = index.search(x, max(BEAM, lists, query_lists))
                far = np.sqrt(np.maximum(0, 2 - 2 * sims))
                place = np.arange(ids.shape[1])
                member = holds[at][:, None] & (place < lists) & (far <= member_ratio * far[:, :1] + 1e-6) & (ids >= 0)
                query = asks[at][:, None] & (place < query_lists) & (far <= query_ratio * far[:, :1] + 1e-6) & (ids >= 0)
                row, col = np.nonzero(member | query)
                to, is_member, is_query = ids[row, col].astype(np.int64), member[row, col], query[row, col]
                blocks = index.blocks[to]
                cells, take, m, q = [to[blocks == 1] << 32], [row[blocks == 1]], [is_member[blocks == 1]], [is_query[blocks == 1]]
                for i in np.flatnonzero(blocks > 1):
                    n = int(blocks[i])
                    own = int.from_bytes(hashlib.blake2b(x[row[i]].tobytes() + bytes(batch.column(1)[int(at[row[i]])].as_py(), "utf-8"), digest_size=4).digest(), "little") % n
                    pairs = {(own, j) for j in range(n) if is_member[i]} | {(j, own) for j in range(n) if is_query[i]}
                    for a, b in sorted(pairs):
                        cells.append(np.array([(int(to[i]) << 32) + a * n + b]))
                        take.append(row[i : i + 1])
                        m.append(np.array([bool(is_member[i]) and a == own]))
                        q.append(np.array([bool(is_query[i]) and b == own]))
                pick = pa.array(at[np.concatenate(take)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pick), pa.array(np.concatenate(cells)), pa.array(np.concatenate(m)), pa.array(np.concatenate(q)), batch.column(1).take(pick), batch.column(3).take(pick)],
                    names=["model", "cell", "member", "query", "key", "unit"],
                )

    return rows.mapInArrow(run, CELLS)


FOUND = "model string, key string, neighbour string, similarity double"


def _best(z: np.ndarray, own: np.ndarray, y: np.ndarray, owner: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries, members and cosines of the ``k`` best members of each query ``z`` among vectors ``y`` of members ``owner``, in ascending order; ``own`` is the member that a query is itself."""
    found: list[list] = [[], [], []]
    # A member that has several vectors is as similar as the best of them.
    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.empty(0, int)
    names = owner[starts]
    for a in range(0, len(z) if len(y) else 0, 1024):
        sims = np.round((z[a : a + 1024] @ y.T).astype(np.float64), 6)
        if len(starts) < len(y):
            sims = np.maximum.reduceat(sims, starts, axis=1)
        self_ = own[a : a + 1024]
        at = np.searchsorted(names, self_)
        same = np.flatnonzero((at < len(names)) & (names[np.minimum(at, len(names) - 1)] == self_))
        sims[same, at[same]] = -3
        floor = np.full(len(sims), least)
        if sims.shape[1] > k:
            floor = np.maximum(floor, -np.partition(-sims, k - 1, axis=1)[:, k - 1])
        row, col = np.nonzero((sims >= floor[:, None]) & (sims > -2))
        for out, values in zip(found, _first(a + row, names[col], sims[row, col], k)):
            out.append(values)
    return tuple(np.concatenate(x) if x else np.empty(0, int) for x in found)


def _first(row: np.ndarray, member: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of each row; among ties the lower member, which has the smaller key."""
    order = np.lexsort((member, -sims, row))
    row, member, sims = row[order], member[order], sims[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], member[kept], sims[kept]


def _best_by_lists(z, own, y, owner, k: int, least: float, settings: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same through lists of the members' own, fitted here."""
    lists, member_ratio, query_lists, query_ratio, list_rows = settings
    rng = np.random.default_rng(len(y))
    index = fit_index(y if len(y) <= SAMPLE_ROWS else y[np.sort(rng.choice(len(y), SAMPLE_ROWS, replace=False))], len(y), list_rows)

    def lists_of(x: np.ndarray, most: int, ratio: float) -> list[np.ndarray]:
        ids, sims = index.search(x, max(BEAM, most))
        far = np.sqrt(np.maximum(0, 2 - 2 * sims))
        row, col = np.nonzero((np.arange(ids.shape[1]) < most) & (far <= ratio * far[:, :1] + 1e-6) & (ids >= 0))
        to = ids[row, col]
        order = np.lexsort((row, to))
        cuts = np.searchsorted(to[order], np.arange(len(index.centroids) + 1))
        return [row[order][cuts[i] : cuts[i + 1]] for i in range(len(index.centroids))]

    if not len(z):
        return _best(z, own, y, owner, k, least)
    parts = [
        (q, _best(z[q], own[q], y[m], owner[m], k, least)) for m, q in zip(lists_of(y, lists, member_ratio), lists_of(z, query_lists, query_ratio)) if len(m) and len(q)
    ]
    row, member, sims = (np.concatenate([q[r[0]] if i == 0 else r[i] for q, r in parts] or [np.empty(0, int)]) for i in range(3))
    # A border member is in several lists.
    order = np.lexsort((-sims, member, row))
    row, member, sims = row[order], member[order], sims[order]
    fresh = np.concatenate([[True], (row[1:] != row[:-1]) | (member[1:] != member[:-1])]) if len(row) else np.empty(0, bool)
    return _first(row[fresh], member[fresh], sims[fresh], k)


def _search_cells(cells: DataFrame, k: int, least: float, split: int, settings: tuple) -> DataFrame:
    def one(table: pa.Table) -> pa.Table:
        name = table.column("model")[0].as_py()
        keys = np.array(table.column("key").to_pylist(), dtype=object)
        x = unpack(table.column("unit").to_pylist())
        member = table.column("member").to_numpy()
        query = table.column("query").to_numpy()
        order = np.argsort(keys[member].astype(str), kind="stable")
        names, y = keys[member][order], x[member][order]
        asked, z = keys[query], x[query]
        fresh = np.concatenate([[True], names[1:] != names[:-1]]) if len(names) else np.empty(0, bool)
        owner, names = np.cumsum(fresh) - 1, names[fresh]
        number = {n: i for i, n in enumerate(names)}
        own = np.array([number.get(n, -1) for n in asked], int)
        row, col, sims = _best_by_lists(z, own, y, owner, k, least, settings) if len(y) > split else _best(z, own, y, owner, k, least)
        row, col = row.astype(int), col.astype(int)
        return pa.table({"model": pa.array([name] * len(row), pa.string()), "key": pa.array(asked[row].tolist(), pa.string()), "neighbour": pa.array(names[col].tolist(), pa.string()), "similarity": pa.array(sims.astype(np.float64))})

    return cells.groupBy("model", "cell").applyInArrow(one, FOUND)


def nearest(
    rows: DataFrame,
    k: int = 10,
    model: str = "model_id",
    key: str = "input_hash",
    vector: str = "vector",
    dimensions: str | None = "dimensions",
    queries=None,
    least: float = -1.0,
    lists: int = 4,
    member_ratio: float = 1.15,
    query_lists: int = 8,
    query_ratio: float = 1.3,
    sample_rows: int = SAMPLE_ROWS,
    list_rows: int = LIST_ROWS,
    max_lists: int = MAX_LISTS,
    split_rows: int = SPLIT_ROWS,
    block_rows: int = BLOCK_ROWS,
    copies: bool = False,
) -> DataFrame:
    """``model, key, neighbour, similarity, rank``: up to ``k`` rows of the same model most similar to each row by cosine.

    Every vector is a member of its nearest list and of further ones, up to ``lists``, whose centroid is at most
    ``member_ratio`` times as far (border vectors are thus replicated); it asks the lists within ``query_ratio``.
    ``queries``, a condition on the key column, limits who asks, never who answers. Neighbours under ``least`` are
    left out before the results of the lists meet. Ties go to the smaller key. There are up to ``max_lists`` lists; where the data outgrow these, a list
    of more than ``split_rows`` members is searched through lists of its own, and one
    expected to hold more than ``block_rows`` in pairs of blocks.

    Repeated rows count once; a key with several vectors is as similar as its best. Of rows with one direction only the k + 1 smallest keys are members and ask: no
    other can be among anyone's k nearest when ties go to the smaller key. With ``copies`` one asker for each direction asks for its further keys that ``queries`` admits, and what it finds is
    given to each of them, so that every such key has its rows; without, they have none. Vectors of one model but different dimensions are kept apart. Null, zero, non-finite and wrongly long vectors take part in nothing; an empty table gives an empty result.
    """
    base = prepared(rows, model, key, vector, dimensions)
    indexes = fit(base, sample_rows, list_rows, max_lists, block_rows)
    spark = rows.sparkSession
    first = Window.partitionBy("model", "class").orderBy("key")
    placed = base.withColumn("place", F.dense_rank().over(first))
    members = placed.filter(F.col("place") <= k + 1)
    # Partitioned as the window is, so this moves nothing.
    members = members.groupBy("model", "class", "key").agg(F.first("unit").alias("unit")).select("model", "key", "class", "unit")
    condition = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    asking = members.withColumn("query", condition).withColumn("member", F.lit(True))
    asker = F.concat(F.lit("\x1e"), F.hex("class"))
    if copies:
        further = placed.filter(F.col("place") > k + 1).select("model", "key", "class", "unit").filter(condition)
        for_all = further.groupBy("model", "class").agg(F.first("unit").alias("unit")).select("model", asker.alias("key"), "class", "unit")
        asking = asking.unionByName(for_all.withColumn("query", F.lit(True)).withColumn("member", F.lit(False)))
    cells = _post(asking, spark.sparkContext.broadcast(indexes), lists, member_ratio, query_lists, query_ratio)
    # An asker for others does not know itself; one row more, since a key that has several vectors may be found for itself.
    found = _search_cells(cells, k + copies, least, split_rows, (lists, member_ratio, query_lists, query_ratio, list_rows))
    if copies:
        who = further.select("model", asker.alias("asker"), F.col("key").alias("copy")).distinct()
        theirs = found.filter(F.col("key").startswith("\x1e")).withColumnRenamed("key", "asker").join(who, ["model", "asker"]).filter("copy <> neighbour")
        found = found.filter(~F.col("key").startswith("\x1e")).unionByName(theirs.select("model", F.col("copy").alias("key"), "neighbour", "similarity"))
    found = found.groupBy("model", "key", "neighbour").agg(F.max("similarity").alias("similarity"))
    best = Window.partitionBy("model", "key").orderBy(F.desc("similarity"), "neighbour")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.withColumn("model", F.regexp_replace("model", "\x1f[0-9]+$", ""))


def mutual_pairs(found: DataFrame, least: float) -> DataFrame:
    """``model, a, b, similarity`` (a < b) of rows that are each among the other's nearest."""
    both = found.filter(F.col("similarity") >= least).groupBy("model", F.least("key", "neighbour").alias("a"), F.greatest("key", "neighbour").alias("b"))
    return both.agg(F.count_distinct("key").alias("ways"), F.max("similarity").alias("similarity")).filter("ways = 2").drop("ways")
