"""Token ids of texts by a byte-level BPE vocabulary given as a rank file."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public split pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of an unsplit piece above which it is encoded as a tree of halves.
LEAF = 2048
#: Characters of a text above which its parts are encoded by tasks of their own.
LONG = 1 << 20


class Encoder:
    """Ids of a text; exact for pieces of any length.

    Pieces of the split pattern longer than ``leaf`` bytes are encoded as two halves, each by the same
    rule, then joined: windows of growing width around the join are encoded anew until the
    tokens next to both window edges agree with those outside. Agreement is checked with the pair rule
    of byte-pair encoding: a token sequence is the encoding of its bytes if and only if every two
    neighbours are the encoding of their own bytes.
    """

    def __init__(self, vocabulary: str = VOCABULARY, leaf: int = LEAF):
        import regex
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = tiktoken.Encoding("unsplit", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(PATTERN)
        self.long_run = regex.compile(rf"\p{{L}}{{{leaf // 4},}}|\p{{N}}{{{leaf // 4},}}|[^\s\p{{L}}\p{{N}}]{{{leaf // 4},}}|\s{{{leaf // 4},}}")
        self.leaf = leaf
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.pair = functools.lru_cache(1 << 16)(self._pair)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if len(text) < self.leaf // 4 or not self.long_run.search(text):
            return self.bpe.encode_ordinary(text)
        ids: list[int] = []
        plain = 0
        for m in self.split.finditer(text):
            if m.end() - m.start() >= self.leaf // 4:
                ids += self.bpe.encode_ordinary_batch([text[plain : m.start()]], num_threads=1)[0] if plain < m.start() else []
                ids += self.tree(m.group().encode())
                plain = m.end()
        return ids + (self.bpe.encode_ordinary(text[plain:]) if plain < len(text) else [])

    def piece(self, data: bytes) -> list[int]:
        """One piece that no split pattern cuts."""
        return self.whole._encode_single_piece(data)

    def tree(self, data: bytes, pool: ThreadPoolExecutor | None = None) -> list[int]:
        if len(data) <= self.leaf:
            return self.piece(data)
        middle = len(data) // 2
        if pool is None and len(data) > 64 * self.leaf:
            with ThreadPoolExecutor(2) as own:
                left, right = own.map(lambda part: self.tree(part, own), (data[:middle], data[middle:]))
        else:
            left, right = self.tree(data[:middle], pool), self.tree(data[middle:], pool)
        return self.join(left, right)

    def _pair(self, a: int, b: int) -> bool:
        return self.piece(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        width = 8
        while True:
            i, j = max(0, len(left) - width), min(len(right), width)
            window = self.piece(b"".join(self.bytes_of[t] for t in left[i:] + right[:j]))
            agree_left = i == 0 or self.pair(left[i - 1], window[0])
            agree_right = j == len(right) or self.pair(window[-1], right[j])
            if agree_left and agree_right:
                return left[:i] + window + right[j:]
            width *= 2

    def parts(self, text: str, size: int) -> list[str]:
        """Cuts ``text`` into parts of about ``size`` characters whose ids, concatenated, are those of the text.

        A cut is made only between a character that is not white space and one that is, in front of a run
        that the pattern can't join to what is before it; a text without such a place stays whole.
        """
        cuts, at = [0], size
        while at < len(text):
            m = self._place.search(text, at)
            if not m:
                break
            cuts.append(m.start() + 1)
            at = m.start() + 1 + size
        return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]

    @functools.cached_property
    def _place(self):
        import regex

        return regex.compile(r"\p{L}(?=[ \n]\p{L})")


@functools.lru_cache(4)
def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    return Encoder(vocabulary)


def encode(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Ids of each text without special tokens; null and empty texts give an empty list, and strings that look like special tokens are ordinary text."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(vocabulary)
        for texts in batches:
            yield texts.map(own.encode, na_action=None)

    return ids(text)


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, long: int = LONG) -> DataFrame:
    """``key, ids`` of every row.

    Texts up to ``long`` characters are encoded where they are read, without a shuffle. Longer ones
    are cut at places where the split pattern must cut too; the parts are encoded by
    different tasks and concatenated in order. Repeated rows come out as often as they come in.
    """
    rows = documents.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    short = rows.filter(F.coalesce(F.length("__text"), F.lit(0)) <= long).select(F.col("__key").alias(key), encode(F.col("__text"), vocabulary).alias("ids"))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def parts(texts: pd.Series) -> pd.Series:
        own = encoder(vocabulary)
        return texts.map(lambda t: own.parts(t, long // 8))

    cut = (
        rows.filter(F.length("__text") > long)
        .withColumn("__row", F.monotonically_increasing_id())
        .select("__row", "__key", F.posexplode(parts("__text")).alias("__at", "__part"))
        .repartition("__row", "__at")
    )
    whole = cut.select("__row", "__key", "__at", encode(F.col("__part"), vocabulary).alias("__ids")).groupBy("__row").agg(
        F.first("__key").alias(key), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__ids"))), lambda x: x["__ids"])).alias("ids")
    )
    return short.unionByName(whole.drop("__row"))
