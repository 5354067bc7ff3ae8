"""Evaluation passages inside training texts, by size-partitioned MinHash containment search."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tracewake.session import cut_lineage

#: Letters and digits of a shingle. Spacing may differ inside and between words, so shingles run across them; eight are about a word and a half.
GRAM = 8
#: Bins of a signature (one-permutation hashing: a shingle's hash names its bin and competes for that bin's minimum); letters of a strip
#: (a domain is a block of two strips of a text, so that it holds any passage of a strip's length); letters and step of the windows of items, which are the queries.
BINS, STRIP, WINDOW, STEP = 256, 112, 112, 28
#: Domains are parted by size; each part has its own number of equal bins for each size of query.
PARTS = (28, 56, 112, 224)
#: Containment: the share of a window's own shingles that a domain must hold to be searched, and of a passage's shingles to be one; chance of finding a domain that holds as much.
CONTAINED, CHANCE = 0.25, 0.999
#: Words running that a document must hold: twenty, less two at either end that edits may hide; what a shingle of the item that is skipped costs a chain.
WORDS, SKIP = 16, 0.2
#: Shingles running that another item has in the same order: so many are an instruction. A shingle is an item's own if no more than this share of all items, or that item alone, has it.
INSTRUCTION, OWN = 32, 0.01
#: Bytes of item text that are sent to every task at once; more are searched in parts.
MOST_ITEM_BYTES = 2 << 20

_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,80}>|\\[nrt]")
_KEEP = re.compile(r"[^\W_]+")
_SHIFT = np.uint64(56)
_LOW = np.uint64((1 << 56) - 1)
_LONG = GRAM + INSTRUCTION - 1
_POWERS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 2**64) for i in range(_LONG)], dtype=np.uint64)


def squeeze(text: str | None) -> tuple[str, list[int]]:
    """The letters and digits of a text in lower case, without mark-up, and where each word begins in them."""
    words = _KEEP.findall(_TAG.sub(" ", html.unescape(text or "")).lower())
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w)
    return "".join(words), starts


def _codes(squeezed: str) -> np.ndarray:
    return np.frombuffer(squeezed.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def shingles(squeezed: str, size: int = GRAM) -> np.ndarray:
    """A 64-bit hash of every shingle."""
    codes = _codes(squeezed)
    n = max(0, len(codes) - size + 1)
    h = np.zeros(n, np.uint64)
    for i, p in enumerate(_POWERS[:size]):
        h += codes[i : i + n] * p
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def signatures(h: np.ndarray, domain: np.ndarray, count: int) -> np.ndarray:
    """The least hash of each bin of each of ``count`` domains, all ones where a bin is empty; ``domain`` is that of each shingle."""
    least = np.full(count * BINS, _LOW)
    bins = (h >> _SHIFT).astype(np.int64)
    np.minimum.at(least, domain * BINS + bins, h & _LOW)
    return least.reshape(count, BINS)


_BIN_KEYS = np.arange(BINS, dtype=np.uint64) << _SHIFT


def needed(query: int, size: int) -> int:
    """Equal bins that a domain of up to ``size`` shingles shows, but for one case in a thousand, if it contains enough of a query of so many.

    The containment asked for is a similarity by the sizes of both: common shingles over those of either.
    """
    common = CONTAINED * query
    union = max(size, common) + query - common
    filled = int(BINS * (1 - math.exp(-union / BINS)))
    similar = common / union
    below, m = 0.0, 0
    while m < filled:
        below += math.comb(filled, m) * similar**m * (1 - similar) ** (filled - m)
        if below > 1 - CHANCE:
            return max(1, m)
        m += 1
    return max(1, filled)


#: Equal bins by size of query and part of domains.
_NEEDED = np.array([[needed(max(1, q), part) for part in PARTS] for q in range(WINDOW + 1)])


@dataclass
class Items:
    """The searched side.

    ``keys`` are the signature bins of all windows, ``windows`` the window of each, ``owners`` and ``sizes`` the item and the number of own shingles of each window. ``grams`` are all shingles with item, position
    and kind: 2 if it is the item's own, 1 if many items have it, 0 in an instruction. ``starts`` are the places of each item's words, ``flags`` and ``gram_flags`` tell quickly that a key or a shingle is unknown.
    """

    ids: np.ndarray
    keys: np.ndarray
    windows: np.ndarray
    owners: np.ndarray
    sizes: np.ndarray
    grams: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
    starts: list[np.ndarray]
    flags: np.ndarray
    gram_flags: np.ndarray
    #: Shingles that the shortest passage of each item must show.
    least: np.ndarray


_FLAGS = 1 << 22


def _flag(keys: np.ndarray) -> np.ndarray:
    return ((keys ^ (keys >> _SHIFT)) & np.uint64(_FLAGS - 1)).astype(np.int64)


def hashes_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, and distinct shingles as long as an instruction."""
    squeezed = squeeze(text)[0]
    return np.unique(shingles(squeezed)), np.unique(shingles(squeezed, _LONG))


def _counted(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate(parts) if parts else np.empty(0, np.uint64), return_counts=True)


def build_items(rows: list[tuple], counts: tuple | None = None, total: int | None = None) -> Items:
    """``rows`` are (id, text). ``counts`` are the shingles, their numbers of items, and the long shingles that more than one of all ``total`` items have; if not given, these rows are all.

    What many items have, or two have running, may be an instruction or a manner and is evidence for none.
    """
    rows = sorted({(r[0], r[1]) for r in rows if r[0] is not None and r[1]}, key=lambda r: (str(r[0]), r[1]))
    texts = [squeeze(t) for _, t in rows]
    if counts is None:
        by: dict = {}
        for i, t in rows:
            by.setdefault(i, []).append(hashes_of(t))
        short, number = _counted([np.unique(np.concatenate([x[0] for x in each])) for each in by.values()])
        long, held = _counted([np.unique(np.concatenate([x[1] for x in each])) for each in by.values()])
        counts, total = (short[number > 1], number[number > 1], long[held > 1]), len(by)
    common = counts[0][counts[1] > max(1, int(OWN * (total or 0)))]
    keys, windows, owners, sizes, grams = [], [], [], [], []
    for k, (squeezed, _) in enumerate(texts):
        h = shingles(squeezed)
        edge = np.zeros(len(h) + 1, int)
        run = np.flatnonzero(np.isin(shingles(squeezed, _LONG), counts[2]))
        np.add.at(edge, run, 1)
        np.add.at(edge, run + INSTRUCTION, -1)
        kinds = np.where(np.cumsum(edge)[:-1] > 0, 0, np.where(np.isin(h, common), 1, 2))
        grams.append((h, np.full(len(h), k), np.arange(len(h)), kinds))
        for a in range(0, max(1, len(h) - WINDOW + STEP), STEP):
            part = np.unique(h[a : a + WINDOW][kinds[a : a + WINDOW] == 2])
            if len(part):
                sign = signatures(part, np.zeros(len(part), np.int64), 1)[0]
                found = (sign | _BIN_KEYS)[sign != _LOW]
                keys.append(found)
                windows.append(np.full(len(found), len(owners)))
                owners.append(k)
                sizes.append(len(part))
    keys, windows = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((keys, np.uint64), (windows, int)))
    order = np.argsort(keys, kind="stable")
    values, whose, places, kinds = (np.concatenate(x) for x in zip(*grams)) if grams else (np.empty(0, np.uint64), *[np.empty(0, int)] * 3)
    by = np.lexsort((places, whose, values))
    flags, gram_flags = np.zeros(_FLAGS, bool), np.zeros(_FLAGS, bool)
    flags[_flag(keys)] = True
    gram_flags[_flag(values)] = True
    least = np.array([CONTAINED * ((st[WORDS - 1 :] - st[: len(st) - WORDS + 1]).min() - GRAM) if len(st) >= WORDS else np.inf for st in (np.array(t[1]) for t in texts)])
    return Items(
        np.array([r[0] for r in rows], dtype=object), keys[order], windows[order].astype(np.int32), np.array(owners, int), np.array(sizes, int),
        (values[by], whose[by].astype(np.int32), places[by].astype(np.int32), kinds[by].astype(np.int8)), [np.array(t[1]) for t in texts], flags, gram_flags, least,
    )


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ranges, the number of the range and the place of each element."""
    many = hi - lo
    which = np.repeat(np.arange(len(lo)), many)
    return which, np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())


def candidates(hashes: list[np.ndarray], items: Items) -> list[list[int]]:
    """Of each text, the items of which some domain may contain a window.

    Every domain is parted by its size; it meets the windows with which it shares a bin, and those count with which it
    shows as many equal bins as its part and the size of the window ask for.
    """
    found: list[list[int]] = [[] for _ in hashes]
    lengths = np.array([len(h) for h in hashes])
    if not lengths.sum() or not len(items.keys):
        return found
    strips = -(-lengths // STRIP)
    first = np.concatenate([[0], np.cumsum(strips)])
    text = np.repeat(np.arange(len(hashes)), strips)
    place = np.concatenate([np.arange(n) for n in lengths])
    least = signatures(np.concatenate(hashes), np.repeat(first[:-1], lengths) + place // STRIP, int(first[-1]))
    # A strip and the next of the same text are a block; the last strip of a longer text lies in the block before.
    last = np.zeros(len(text), bool)
    last[first[1:][strips > 0] - 1] = True
    pair = np.flatnonzero(~last)
    alone = np.flatnonzero(last & (strips[text] == 1))
    blocks = np.concatenate([np.minimum(least[pair], least[pair + 1]), least[alone]])
    owner = np.concatenate([text[pair], text[alone]])
    size = np.concatenate([np.minimum(2 * STRIP, lengths[text[pair]] - (pair - first[text[pair]]) * STRIP), lengths[text[alone]]])
    part = np.searchsorted(PARTS, size)
    flat = (blocks | _BIN_KEYS).ravel()
    likely = np.flatnonzero(items.flags[_flag(flat)] & (blocks.ravel() != _LOW))
    lo, hi = np.searchsorted(items.keys, flat[likely]), np.searchsorted(items.keys, flat[likely], side="right")
    which, at = _spread(lo, hi)
    if not len(at):
        return found
    met, equal = np.unique((likely[which] // BINS) * np.int64(len(items.owners)) + items.windows[at], return_counts=True)
    block, window = met // len(items.owners), met % len(items.owners)
    good = equal >= _NEEDED[np.minimum(items.sizes[window], WINDOW), part[block]]
    for t, k in sorted(set(zip(owner[block[good]].tolist(), items.owners[window[good]].tolist()))):
        found[t].append(k)
    return found


def passages(texts: list[str | None], items: Items) -> list[list[tuple[int, int, float]]]:
    """``(item, words, share)`` of every item of which each text holds a passage."""
    hashes = [shingles(squeeze(t)[0]) for t in texts]
    values, whose, places, kinds = items.grams
    out = []
    for h, likely in zip(hashes, candidates(hashes, items)):
        out.append([])
        if not likely:
            continue
        known = np.flatnonzero(items.gram_flags[_flag(h)])
        which, at = _spread(np.searchsorted(values, h[known]), np.searchsorted(values, h[known], side="right"))
        text_at, met = known[which], whose[at]
        shown = np.bincount(met, minlength=len(items.ids))
        for k in likely:
            if shown[k] < items.least[k]:
                continue
            of = met == k
            words, share = longest_passage(text_at[of], places[at[of]].astype(int), kinds[at[of]], items.starts[k])
            if words >= WORDS and share >= CONTAINED:
                out[-1].append((k, words, share))
    return out


def longest_passage(text_at: np.ndarray, item_at: np.ndarray, kinds: np.ndarray, starts: np.ndarray) -> tuple[int, float]:
    """Words of the longest running passage of the item in the text, and the share of its shingles found.

    Shingles at which text and item agree, in text order, are chained while both go on together: steps of at
    most 90 characters whose lengths differ by at most 30, about what a few changed words leave. Each goes on from the
    chain that has found most and skipped least, or begins one. A chain counts from its first own shingle to its last and as far as
    shared ones join these without a gap, but for an instruction's; in between every shingle counts. Of chains that hold CONTAINED of their shingles the longest is returned.
    """
    own = kinds == 2
    if not own.any() or len(starts) < WORDS:
        return 0, 0.0
    # Where the unbroken run of each shingle begins and ends.
    by = np.lexsort((text_at, text_at - item_at))
    cut = (np.diff(text_at[by]) != 1) | (np.diff(item_at[by]) != 1) | (kinds[by][1:] == 0) | (kinds[by][:-1] == 0)
    heads, tails = np.flatnonzero(np.concatenate([[True], cut])), np.flatnonzero(np.concatenate([cut, [True]]))
    lead, trail = np.empty_like(item_at), np.empty_like(item_at)
    lead[by], trail[by] = np.repeat(item_at[by][heads], tails - heads + 1), np.repeat(item_at[by][tails], tails - heads + 1)
    inside = (item_at >= lead[own].min()) & (item_at <= trail[own].max())
    text_at, item_at, own, lead, trail = (x[inside] for x in (text_at, item_at, own, lead, trail))
    # The shortest run of so many words, less what counts as within a chain, needs so many shingles.
    if len(np.unique(item_at)) < CONTAINED * ((starts[WORDS - 1 :] - starts[: len(starts) - WORDS + 1]).min() - GRAM):
        return 0, 0.0
    n = len(text_at)
    score, count = np.ones(n), np.ones(n, int)
    # Of the chain that ends at each shingle: its first and last own shingle, and the shingles found up to them.
    first, last, before, upto = np.where(own, np.arange(n), -1), np.where(own, np.arange(n), -1), np.zeros(n, int), own.astype(int)
    begin, end = np.searchsorted(text_at, text_at - 120), np.searchsorted(text_at, text_at)
    for j in range(n):
        a, b = int(begin[j]), int(end[j])
        if a == b:
            continue
        step = item_at[j] - item_at[a:b]
        fits = (step > 0) & (step <= 90) & (np.abs(step - text_at[j] + text_at[a:b]) <= 30)
        gain = np.where(fits, score[a:b] - SKIP * (step - 1), 0)
        p = a + int(gain.argmax())
        if gain[p - a] <= 0:
            continue
        score[j] += gain[p - a]
        count[j] += count[p]
        if first[p] >= 0:
            first[j], before[j] = first[p], before[p]
            if own[j]:
                upto[j] = count[j]
            else:
                last[j], upto[j] = last[p], upto[p]
        elif own[j]:
            before[j], upto[j] = count[p], count[j]
    known = first >= 0
    start, stop = lead[first], trail[last]
    share = np.where(known, (upto - before + item_at[first] - start + stop - item_at[last]) / np.maximum(1, stop - start + 1), 0)
    # A word counts if half of it, or so, lies within the chain.
    words = np.where(known, np.searchsorted(starts, stop + GRAM - 2) - np.searchsorted(starts, start - 2), 0)
    best = np.lexsort((share, words, share >= CONTAINED))[-1]
    return int(words[best]), float(share[best])


def _shared_hashes(items: DataFrame, item: str, text: str) -> DataFrame:
    """``long, h, n``: shingles that more than one item has, short and long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j, t in enumerate(batch.column(1).to_pylist()):
                both = hashes_of(t)
                for long, h in enumerate(both):
                    name = batch.column(0).take(pa.array(np.full(len(h), j)))
                    yield pa.RecordBatch.from_arrays([name, pa.array(np.full(len(h), bool(long))), pa.array(h.view(np.int64))], names=["i", "long", "h"])

    kind = items.schema[item].dataType.simpleString()
    each = items.select(item, text).mapInArrow(run, f"i {kind}, long boolean, h long")
    return each.groupBy("long", "h").agg(F.count_distinct("i").alias("n")).filter("n > 1")


def leaked(documents: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", most_bytes: int = MOST_ITEM_BYTES) -> DataFrame:
    """``doc, item, n_words, share``: every document that holds a passage of an item, whole or in part.

    Case, punctuation, spacing (also inside words), mark-up and some words may differ. What many items share
    is evidence for none, but counts within a passage. Null and empty texts hold nothing; repeated items count once, an item with several texts leaks with any of them, repeated documents count each.

    Items are sent to every task, ``most_bytes`` of their text at once. More are searched in parts by a hash of their id, each against all documents; how
    many items share a shingle is counted over all of them beforehand, so that the result is that of one part. No document is shuffled.
    """
    known = items.filter(F.col(item).isNotNull() & (F.length(item_text) > 0)).select(item, item_text).distinct()
    size = known.agg(F.sum(F.octet_length(item_text)).alias("b"), F.count_distinct(item).alias("n")).first()
    parts = max(1, -(-(size["b"] or 0) // most_bytes))
    if parts == 1:
        return _search(documents, build_items([tuple(r) for r in known.collect()]), items, doc, text, item)
    shared = cut_lineage(_shared_hashes(known, item, item_text))
    numbered = cut_lineage(known.withColumn("part", F.pmod(F.xxhash64(item), F.lit(parts))))
    out = None
    for p in range(parts):
        rows = [(r[0], r[1]) for r in numbered.filter(F.col("part") == p).select(item, item_text).collect()]
        own = _part_counts(shared, documents.sparkSession, rows)
        found = _search(documents, build_items(rows, own, size["n"]), items, doc, text, item)
        out = found if out is None else out.unionByName(found)
    return out


def _part_counts(shared: DataFrame, spark, rows: list[tuple]) -> tuple:
    """Of the shingles of a part's items, those that other items share."""
    both = [hashes_of(t) for _, t in rows]
    wanted = [np.unique(np.concatenate([b[long] for b in both] or [np.empty(0, np.uint64)])).view(np.int64) for long in (0, 1)]
    table = pa.table({"long": np.repeat([False, True], [len(w) for w in wanted]), "h": np.concatenate(wanted)})
    found = shared.join(spark.createDataFrame(table), ["long", "h"]).toArrow()
    long, h, n = (found.column(c).to_numpy() for c in ("long", "h", "n"))
    return h[~long].view(np.uint64), n[~long], h[long].view(np.uint64)


def _search(documents: DataFrame, built: Items, items: DataFrame, doc: str, text: str, item: str) -> DataFrame:
    known = documents.sparkSession.sparkContext.broadcast(built)
    item_type = to_arrow_type(items.schema[item].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = known.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            start = 0
            while start < len(texts):
                # Texts are taken together up to some length, which saves calls and bounds memory.
                stop, held = start, 0
                while stop < len(texts) and (stop == start or held + len(texts[stop]) <= 1 << 18):
                    held += len(texts[stop])
                    stop += 1
                best: dict = {}
                for j, found in enumerate(passages(texts[start:stop], own)):
                    for k, w, s in found:
                        best[start + j, own.ids[k]] = max(best.get((start + j, own.ids[k]), (0, 0.0)), (w, s))
                start = stop
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([at[0] for at in best], pa.int64())), pa.array([at[1] for at in best], item_type), pa.array([v[0] for v in best.values()], pa.int32()),
                        pa.array([float(v[1]) for v in best.values()], pa.float64()),
                    ],
                    names=[doc, item, "n_words", "share"],
                )

    schema = f"{doc} {documents.schema[doc].dataType.simpleString()}, {item} {items.schema[item].dataType.simpleString()}, n_words int, share double"
    return documents.select(doc, text).filter(F.col(text).isNotNull()).mapInArrow(run, schema)
