"""Subject areas of documents, from labelling functions weighed by a latent accuracy model."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewake.session import cut_lineage

#: Hand-labelled documents that the lexicon is learned from, about this many at most, chosen by a hash of the id.
LABELLED_DOCUMENTS = 20_000
#: A term is of one to so many words, is in so many labelled documents, and so large a share of these have its subject.
TERM_WORDS, TERM_DOCUMENTS, TERM_SHARE = 4, 3, 0.7
#: Characters of a labelled document beyond which the lexicon is not learned from it, and terms of all vocabularies that are sent to every task at most.
LABELLED_CHARACTERS, MOST_TERMS = 50_000, 2_000_000
#: Subjects that a count is coded with.
_SUBJECTS = 1 << 20
#: Least posterior probability of a subject that is assigned.
ASSIGNED = 0.5
#: Labelling functions that read the text, each with a vocabulary of its own, and the mark of its terms.
READERS = {"lexicon": "L", "address": "A", "section": "S"}

_HUMP = re.compile(r"(?<=[a-zß-ÿ])(?=[A-Z])")
_WORD = re.compile(r"[^\W\d_]+|\n")
_SENTENCE = re.compile(r"(?<=[.!?;:])\s+|\n+|\s\|\s")
_ADDRESS = re.compile(r"`|[a-zß-ÿ][A-Z]|\w[_/]\w")
_SECTION = re.compile(r"\s*(?:#{1,6}\s|[-*+|]\s|\d+[.)]\s|\w+(?:\(\w+\))?:\s)")


def lines_of(texts: list[str]) -> list[str]:
    """The words of each text in lower case, between single blanks; identifiers are taken apart. The texts have no line breaks."""
    each = " ".join(_WORD.findall(_HUMP.sub(" ", "\n".join(texts)).lower())).split("\n")
    return [f" {t.strip(' ')} " for t in each]


def parts_of(text: str) -> list[tuple[str, str, bool]]:
    """Of each sentence its words, the words of its identifiers, paths and code spans, and whether it is a heading, list item, table row, labelled line or the opening.

    Words stand between blanks, those of separate identifiers in separate lines.
    """
    sentences = [s for s in _SENTENCE.split(text) if s]
    spans = [" ".join(p for p in s.split() if _ADDRESS.search(p)) if _ADDRESS.search(s) else "" for s in sentences]
    addresses = ["\n".join(lines_of(p.split(" "))) if p else "" for p in spans]
    return [(w, a, k == 0 or bool(_SECTION.match(s))) for k, (s, w, a) in enumerate(zip(sentences, lines_of(sentences), addresses))]


def terms_of(words: str) -> Iterator[str]:
    """The word sequences of each line."""
    for line in words.split("\n"):
        each = line.split()
        for k in range(len(each)):
            for n in range(1, min(TERM_WORDS, len(each) - k) + 1):
                yield " ".join(each[k : k + n])


class Vocabulary:
    """Terms that each name a subject, looked up all at once."""

    def __init__(self, terms: dict[str, int]):
        self.terms = terms
        self.tree = ahocorasick.Automaton()
        for term, subject in terms.items():
            self.tree.add_word(f" {term} ", subject)
        if terms:
            self.tree.make_automaton()

    def named(self, words: str) -> set[int]:
        return {s for _, s in self.tree.iter(words)} if self.terms and words else set()


def votes_of(text: str | None, lexicon: Vocabulary, address: Vocabulary, section: Vocabulary) -> list[tuple[int, int, int, int, int]]:
    """``(subject, lexicon, rival, address, section)`` of each subject that some function names; the others abstain from it.

    lexicon: sentences with a term of the subject, to 4; rival: the most of any other subject, to 4; address: sentences that name it by a term
    of identifiers, paths or code spans, to 2; section: whether a heading, list item, table row, labelled line or the opening names it by a term of such.
    """
    own, code, head = Counter(), Counter(), Counter()
    for words, addresses, heading in parts_of(text or ""):
        own.update(lexicon.named(words))
        code.update(address.named(addresses))
        if heading:
            head.update(section.named(words))
    first = own.most_common(2)
    rival = lambda s: next((m for q, m in first if q != s), 0)
    return [(s, min(own[s], 4), min(rival(s), 4), min(code[s], 2), min(head[s], 1)) for s in sorted(own.keys() | code.keys() | head.keys())]


def learn_vocabularies(documents: DataFrame, labels: DataFrame, subjects: list[str], doc: str, text: str) -> dict[str, dict[str, int]]:
    """For each function that reads the text, the terms that mark one subject: most labelled documents with the term have it, beyond what chance gives to so many terms.

    The address function learns from identifiers, paths and code spans only, the section function from headings and the like.
    """
    number = {s: i for i, s in enumerate(subjects)}
    hand = labels.filter(F.col("subject").isin(subjects)).groupBy(F.col("doc_id").alias(doc)).agg(F.collect_set("subject").alias("subjects"))
    step = max(1, hand.count() // LABELLED_DOCUMENTS)
    hand = hand.filter(F.pmod(F.xxhash64(doc), F.lit(step)) == 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: Counter = Counter()
            for t, named in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                numbers = [number[s] for s in named]
                found = set()
                for words, addresses, heading in parts_of(t):
                    found.update("L" + x for x in terms_of(words))
                    found.update("A" + x for x in terms_of(addresses))
                    if heading:
                        found.update("S" + x for x in terms_of(words))
                n.update((x, -1) for x in found)
                for s in numbers:
                    n.update((x, s) for x in found)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in n], pa.string()), pa.array([k[1] for k in n], pa.int32()), pa.array(list(n.values()), pa.int64())], names=["term", "subject", "n"])

    read = documents.select(doc, text).filter(F.length(text) <= LABELLED_CHARACTERS).join(F.broadcast(hand), doc)
    counted = read.select(text, "subjects").mapInArrow(count, "term string, subject int, n long")
    # Partitioned by term, both aggregations stay in place. A subject and its count make one number, of which the greatest is the first of the most frequent.
    counts = counted.repartition("term").groupBy("term", "subject").agg(F.sum("n").alias("n"))
    coded = F.when(F.col("subject") >= 0, F.col("n") * _SUBJECTS + (_SUBJECTS - 1 - F.col("subject")))
    terms = counts.groupBy("term").agg(F.max(F.when(F.col("subject") == -1, F.col("n"))).alias("c"), F.max(coded).alias("code"))
    terms = terms.select("term", "c", F.floor(F.col("code") / _SUBJECTS).alias("k"), (_SUBJECTS - 1 - F.col("code") % _SUBJECTS).cast("int").alias("s"))
    terms = cut_lineage(terms.filter((F.col("c") >= TERM_DOCUMENTS) & (F.col("term") != "") & (F.col("k") >= TERM_SHARE * F.col("c"))))
    labelled = read.agg(F.count("*").alias("all"), *[F.count_if(F.array_contains("subjects", s)).alias(f"n{i}") for i, s in enumerate(subjects)]).first()
    if not labelled["all"]:
        return {name: {} for name in READERS}
    base = {i: labelled[f"n{i}"] / labelled["all"] for i in range(len(subjects)) if labelled[f"n{i}"]}
    candidates = terms
    tests = {r[0]: max(2, r[1]) for r in candidates.groupBy(F.substring("term", 1, 1)).count().collect()}
    prior = F.create_map(*[F.lit(x) for s, q in base.items() for x in (s, min(q, 0.999))])[F.col("s")]
    share = F.least(F.col("k") / F.col("c"), F.lit(1 - 1e-12))
    surprise = F.col("c") * (share * F.log(share / prior) + (1 - share) * F.log((1 - share) / (1 - prior)))
    least = F.create_map(*[F.lit(x) for mark, n in (tests or {"": 2}).items() for x in (mark, float(np.log(n)))])[F.substring("term", 1, 1)]
    kept = candidates.filter((share > prior) & (surprise > least)).select("term", "s").limit(MOST_TERMS + 1).collect()
    if len(kept) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms mark a subject; learn from fewer labelled documents")
    return {name: {r["term"][1:]: r["s"] for r in kept if r["term"][0] == mark} for name, mark in READERS.items()}


def fit_accuracies(patterns: np.ndarray, n: np.ndarray, yes: np.ndarray, no: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Posterior that a subject is meant, by vote pattern, from an expectation-maximisation of the functions' accuracies.

    ``patterns`` has a level of each labelling function in each column; ``n`` the pairs with the pattern, of which
    hand labels affirm ``yes`` and deny ``no``. Hand labels are one more function whose accuracy is learned.
    """
    levels = patterns.max(0) + 1
    own, rival = patterns[:, 0] // 5, patterns[:, 0] % 5
    post = (yes + 0.5 * ((rival <= own) & (own > 0)) + 0.25) / (yes + no + 1)
    for _ in range(rounds):
        mass = np.stack([n * (1 - post), n * post])
        share = mass.sum(1) / mass.sum()
        log = np.repeat(np.log(np.maximum(share, 1e-9))[:, None], len(n), 1)
        for f, size in enumerate(levels):
            table = np.stack([np.bincount(patterns[:, f], m, size) for m in mass]) + 0.5
            table /= table.sum(1, keepdims=True)
            log += np.log(table[:, patterns[:, f]])
        hand = np.stack([[(m * (no / np.maximum(n, 1))).sum(), (m * (yes / np.maximum(n, 1))).sum()] for m in mass]) + np.array([[4.0, 1.0], [1.0, 4.0]])
        hand /= hand.sum(1, keepdims=True)
        # The hand labels of a pattern speak for its pairs on average.
        weight = 1 / np.maximum(1, yes + no) ** 0.5
        log += weight * (yes * np.log(hand[:, 1:]) + no * np.log(hand[:, :1]))
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -60, 60)))
        if np.abs(new - post).max() < 1e-6:
            return new
        post = new
    return post


@dataclass
class Assigned:
    """Pairs of document and subject with the levels of all functions, and each pattern of levels with its pairs and posterior."""

    levels: DataFrame
    patterns: list[tuple]
    subjects: list[str]


FUNCTIONS = ("lexicon", "address", "section", "common")


def fit_subjects(documents: DataFrame, labels: DataFrame, areas: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source") -> Assigned | None:
    subjects = sorted({r[0] for r in areas.select("subject").distinct().collect() if r[0] is not None})
    spark = documents.sparkSession
    if not subjects:
        return None
    learned = spark.sparkContext.broadcast(learn_vocabularies(documents, labels, subjects, doc, text))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = [Vocabulary(learned.value[name]) for name in READERS]
        for batch in batches:
            rows = [(j, *v) for j, t in enumerate(batch.column(2).to_pylist()) for v in votes_of(t, *readers)]
            take = pa.array([r[0] for r in rows], pa.int64())
            columns = [pa.array([r[i] for r in rows], pa.int32()) for i in range(1, 6)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *columns], names=[doc, "source", "s", "own", "rival", "address", "section"])

    kind = documents.schema[doc].dataType.simpleString()
    read = documents.select(doc, F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), text).filter(F.length(F.trim(text)) > 0)
    votes = cut_lineage(read.mapInArrow(vote, f"{doc} {kind}, source string, s int, own int, rival int, address int, section int"))

    by = votes.filter("own > 0 AND own >= rival").groupBy("source", "s").agg(F.count("*").alias("n"))
    share = by.join(by.groupBy("source").agg(F.sum("n").alias("all")), "source").select(
        "source", "s", F.when((F.col("all") >= 20) & (F.col("n") > 0.3 * F.col("all")), 2).when((F.col("all") >= 20) & (F.col("n") < 0.05 * F.col("all")), 0).otherwise(1).alias("common")
    )
    number = F.create_map(*[F.lit(x) for i, s in enumerate(subjects) for x in (s, i)])
    hand = labels.filter(F.col("subject").isin(subjects)).groupBy(F.col("doc_id").alias(doc)).agg(F.collect_set(number[F.col("subject")]).alias("hand"))
    levels = votes.join(share, ["source", "s"], "left").select(
        doc, "s", (F.col("own") * 5 + F.col("rival")).alias("lexicon"), "address", "section", F.coalesce("common", F.lit(1)).alias("common")
    )
    levels = cut_lineage(levels.join(hand, doc, "left").withColumn("hand", F.array_contains("hand", F.col("s"))))
    seen = levels.groupBy(*FUNCTIONS).agg(F.count("*").alias("n"), F.count_if("hand").alias("yes"), F.count_if(~F.col("hand")).alias("no")).orderBy(*FUNCTIONS).collect()
    if not seen:
        return None
    column = lambda *names: np.array([[r[c] for c in names] for r in seen])
    post = fit_accuracies(column(*FUNCTIONS), column("n")[:, 0], column("yes")[:, 0], column("no")[:, 0])
    # At most 25 x 3 x 2 x 3 patterns.
    return Assigned(levels, [(*(r[f] for f in FUNCTIONS), r["n"], float(p)) for r, p in zip(seen, post)], subjects)


def assign_subjects(documents: DataFrame, labels: DataFrame, areas: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc, subject, probability``: the subjects that each document is about.

    Labelling functions vote, each by itself, on subjects or abstain: lexicon (sentences with a term of the subject against those of its
    strongest rival), address (terms of identifiers, paths and code spans), section (terms of headings, list items and the like) and source (how common the subject
    is in the document's source). Each reader of the text has a vocabulary of its own, so any can name a subject that the others miss. Their accuracies are learned without knowing the truth from how often the vote
    patterns occur over all documents, hand labels being one more, fallible, function. Subjects with a posterior of
    ASSIGNED or more come out. Whatever the language, terms come from the labelled documents.

    Null, empty and blank texts have no subject, nor has anything if there are no labels. Repeated labels count once;
    labels of unknown subjects or documents are passed over. A null source is a source of its own.
    """
    spark = documents.sparkSession
    found = fit_subjects(documents, labels, areas, doc, text, source)
    if found is None:
        return spark.createDataFrame([], f"{doc} {documents.schema[doc].dataType.simpleString()}, subject string, probability double")
    known = spark.createDataFrame([(*p[:4], p[5]) for p in found.patterns], ", ".join(f"{f} int" for f in FUNCTIONS) + ", probability double")
    name = F.element_at(F.array(*[F.lit(s) for s in found.subjects]), F.col("s") + 1)
    return found.levels.join(F.broadcast(known), list(FUNCTIONS)).filter(F.col("probability") >= ASSIGNED).select(doc, name.alias("subject"), "probability")


def function_accuracies(documents: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """``function, coverage, accuracy, alone``: of each labelling function the share of all named pairs on which it votes for the subject, the
    share of these whose subject is meant by the fitted model, and the number of pairs that it alone names. The source votes only on pairs that another function names."""
    found = fit_subjects(documents, labels, areas)
    rows = []
    patterns = np.array([p[:5] for p in found.patterns]) if found else np.zeros((0, 5), int)
    post, n = np.array([p[5] for p in found.patterns]) if found else np.zeros(0), patterns[:, 4]
    votes = {"lexicon": (patterns[:, 0] // 5 > 0) & (patterns[:, 0] // 5 >= patterns[:, 0] % 5), "address": patterns[:, 1] > 0, "section": patterns[:, 2] > 0, "source": patterns[:, 3] == 2}
    named = {"lexicon": patterns[:, 0] // 5 > 0, "address": votes["address"], "section": votes["section"]}
    for name, v in votes.items():
        alone = v & (sum(x for x in named.values()) == 1) if name in named else np.zeros(len(v), bool)
        rows.append((name, float(n[v].sum() / max(1, n.sum())), float((n * post)[v].sum() / max(1, n[v].sum())), int(n[alone].sum())))
    return documents.sparkSession.createDataFrame(rows, "function string, coverage double, accuracy double, alone long")
