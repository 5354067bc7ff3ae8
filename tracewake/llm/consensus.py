"""Consensus labels, agreement and annotator reliability from disagreeing annotators."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewake.session import cut_lineage

LABELS = ("likely_affected", "potentially_affected", "no_impact_indicated", "insufficient_evidence")
SUFFICIENCY = ("fully_sufficient", "partially_sufficient", "completely_inadequate")
K, LEVELS = len(LABELS), len(SUFFICIENCY) + 1
#: Hashed item features beside a constant one; pseudo-judgements with which an annotator starts as an average one.
FEATURES, PSEUDO = 512, 6.0
#: L2 penalties among which items held out choose, rounds in which each of them is fitted, and parts of the items.
PENALTIES, TRIAL_ROUNDS, FOLDS = (1.0, 10.0, 100.0, 1000.0), 15, 2
#: Relative change of the likelihood at which the fit ends, and rounds after which it ends with a warning.
TOLERANCE, WARN_ROUNDS = 1e-6, 400
#: Annotators whose confusion matrices are sent to every task, 16 numbers each; the matrices of more are joined to their judgements.
SENT_ANNOTATORS = 200_000


def canonical(label: Column) -> Column:
    """A label whatever its case, blanks or separators."""
    return F.regexp_replace(F.regexp_replace(F.lower(label), r"^[\s_-]+|[\s_-]+$", ""), r"[\s_-]+", "_")


def index_of(value: Column, names: tuple[str, ...]) -> Column:
    return F.nullif(F.array_position(F.array(*[F.lit(n) for n in names]), F.coalesce(value, F.lit(""))), F.lit(0)) - 1


def judgements(records: DataFrame) -> DataFrame:
    """``case_id, version, annotator_id, label, evidence, path``: the latest valid judgement of each annotator on each candidate.

    A label that is unknown after clean-up or null, a null annotator, and any true field in blinding_verification
    make a record no judgement. Of equal times the greater annotation_id is the later; a null time is the earliest.
    """
    blind = F.lit(False)
    for name in records.schema["blinding_verification"].dataType.names:
        blind = blind | F.coalesce(F.col(f"blinding_verification.{name}"), F.lit(False))
    label = index_of(canonical(F.col("reference_assessment.classification")), LABELS)
    evidence = index_of(canonical(F.col("reference_assessment.evidence_sufficiency")), SUFFICIENCY)
    valid = records.filter(~blind & F.col("annotator_id").isNotNull()).select(
        "case_id", F.col("candidate_version_id").alias("version"), "annotator_id", label.cast("int").alias("label"), evidence.cast("int").alias("evidence"),
        F.col("candidate_path").alias("path"), F.struct(F.coalesce(F.col("annotated_at").cast("timestamp"), F.lit("0001-01-01").cast("timestamp")).alias("t"), "annotation_id").alias("order"),
    ).filter("label IS NOT NULL")
    latest = valid.groupBy("case_id", "version", "annotator_id").agg(F.max(F.struct("order", "label", "evidence", "path")).alias("r"))
    return latest.select("case_id", "version", "annotator_id", "r.label", "r.evidence", "r.path")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and the row of each."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    return np.asarray(pc.list_flatten(column).to_numpy(zero_copy_only=False)), np.repeat(np.arange(len(sizes)), sizes)


def _normal(log: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of logarithms as shares, and the logarithm of each row's sum."""
    top = log.max(1, keepdims=True)
    share = np.exp(log - top)
    total = share.sum(1, keepdims=True)
    return share / total, (top + np.log(total))[:, 0]


@dataclass
class Items:
    """A batch of items: their features with values (the constant one last) and their judgements."""

    batch: pa.RecordBatch

    def __post_init__(self):
        self.n = self.batch.num_rows
        at, row = _lists(self.batch.column("features"))
        value = 1 / np.sqrt(np.maximum(1, np.bincount(row, minlength=self.n)))
        self.at, self.row = np.concatenate([at, np.full(self.n, FEATURES)]).astype(int), np.concatenate([row, np.arange(self.n)])
        self.value = np.concatenate([value[row], np.ones(self.n)])
        self.fold = np.asarray(self.batch.column("fold"))
        self.who, self.of = _lists(self.batch.column("who"))
        self.said = _lists(self.batch.column("said"))[0].astype(int)
        self.evidence = _lists(self.batch.column("evidence"))[0].astype(int)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, K))
        np.add.at(out, self.row, weights[self.at] * self.value[:, None])
        return out

    def gradient(self, rest: np.ndarray) -> np.ndarray:
        out = np.zeros((FEATURES + 1, K))
        np.add.at(out, self.at, rest[self.row] * self.value[:, None])
        return out


@dataclass
class Model:
    """What annotators say of each true label, what evidence goes with it, and the classifier that gives the label prior."""

    confusion: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros((FEATURES + 1, K)))
    #: Of a true and a given label, over all annotators.
    evidence: np.ndarray = field(default_factory=lambda: np.full((K, K, LEVELS), 1 / LEVELS))
    likelihood: float = -np.inf
    rounds: int = 0
    converged: bool = False

    def posterior(self, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Posterior and prior of each label, and the log-likelihood, of each item."""
        prior, base = _normal(items.scores(self.weights))
        log = np.log(np.maximum(prior, 1e-300))
        if "heard" in items.batch.schema.names:
            log += _lists(items.batch.column("heard"))[0].reshape(-1, K)
        else:
            np.add.at(log, items.of, np.log(self.confusion[items.who, :, items.said]))
        np.add.at(log, items.of, np.log(self.evidence[:, items.said, items.evidence].T))
        post, likelihood = _normal(log)
        return post, prior, likelihood

    def sums(self, items: Items) -> list[np.ndarray]:
        """What a round needs of a batch: labels, items and likelihood, the classifier's gradient, evidence, confusions."""
        post, prior, likelihood = self.posterior(items)
        confusion, evidence = np.zeros_like(self.confusion), np.zeros((K, K, LEVELS))
        if len(confusion):
            np.add.at(confusion, (items.who, slice(None), items.said), post[items.of])
        np.add.at(evidence, (slice(None), items.said, items.evidence), post[items.of].T)
        return [post.sum(0), np.array([items.n, likelihood.sum()]), items.gradient(post - prior), evidence, confusion]

    def shapes(self) -> list[tuple]:
        return [(K,), (2,), (FEATURES + 1, K), (K, K, LEVELS), self.confusion.shape]

    def update(self, sums: list[np.ndarray], solver=None) -> None:
        """One maximisation. Without a solver the prior is the share of each label, whatever the item."""
        mass, (rows, likelihood), gradient, evidence, confusion = sums
        if len(confusion):
            self.confusion = smoothed(confusion, confusion.sum(0))
        evidence = evidence + 1.0
        self.evidence = evidence / evidence.sum(2, keepdims=True)
        if solver is None:
            self.weights = np.zeros((FEATURES + 1, K))
            self.weights[FEATURES] = np.log((mass + 1) / (rows + K))
        else:
            self.weights = self.weights + solver(gradient, self.weights)
        now = likelihood / max(rows, 1)
        self.converged = abs(now - self.likelihood) <= TOLERANCE * abs(now)
        self.likelihood, self.rounds = now, self.rounds + 1

    def share(self) -> np.ndarray:
        return _normal(self.weights[FEATURES:])[0][0]

    def reliability(self) -> np.ndarray:
        return np.einsum("akk,k->a", self.confusion, self.share())


def smoothed(confusion: np.ndarray, pooled: np.ndarray) -> np.ndarray:
    """Confusion matrices drawn to the average one."""
    pooled = pooled + 1
    confusion = confusion + PSEUDO * pooled / pooled.sum(1, keepdims=True)
    return confusion / confusion.sum(2, keepdims=True)


def diagonal(right: np.ndarray) -> np.ndarray:
    """Matrices of annotators who are right so often and else name any other label alike."""
    return np.eye(K) * right[:, None, None] + (1 - np.eye(K)) * ((1 - right) / (K - 1))[:, None, None]


class Solver:
    """A step of the classifier that never lowers its penalised likelihood: half of each feature's products with all features bounds its curvature."""

    def __init__(self, products: np.ndarray, penalty: float):
        self.penalty = np.full(FEATURES + 1, penalty)
        self.penalty[FEATURES] = 1e-3
        self.curve = products / 2 + self.penalty

    def __call__(self, gradient: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return (gradient - self.penalty[:, None] * weights) / self.curve[:, None]


def total(items: DataFrame, of, shapes: list[tuple]) -> list[np.ndarray]:
    """Sums over all items of the arrays, of these shapes, that ``of`` gives for a batch. Only sums leave a task, and only those that are not zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                flat += np.concatenate([a.ravel() for a in of(Items(batch))])
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], names=["at", "value"])

    sizes = [int(np.prod(s)) for s in shapes]
    size = sum(sizes)
    found = items.mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    flat = np.zeros(size)
    flat[found.column("at").to_numpy()] = found.column("value").to_numpy()
    return [part.reshape(s) for part, s in zip(np.split(flat, np.cumsum(sizes)[:-1]), shapes)]


def first_models(items: DataFrame, annotators: int) -> list[Model]:
    """Where the fit starts from: everyone alike; everyone by agreement with the others; by what others of the same item say."""

    def others(batch: Items) -> list[np.ndarray]:
        counts = np.zeros((batch.n, K))
        np.add.at(counts, (batch.of, batch.said), 1)
        rest = counts[batch.of]
        rest[np.arange(len(rest)), batch.said] -= 1
        rest = (rest / np.maximum(rest.sum(1, keepdims=True), 1)) * (rest.sum(1, keepdims=True) > 0)
        out = np.zeros((annotators, K, K))
        np.add.at(out, (batch.who, slice(None), batch.said), rest)
        return [out]

    (seen,) = total(items, others, [(annotators, K, K)])
    agreed = (np.einsum("akk->a", seen) + 1) / (seen.sum((1, 2)) + 3)
    scaled = 0.9 * agreed / agreed.max() if annotators else agreed
    return [Model(diagonal(np.full(annotators, 0.6))), Model(diagonal(np.clip(scaled, 0.26, 0.9))), Model(smoothed(seen, seen.sum(0)))]


def classifier(items: DataFrame, model: Model) -> Solver | None:
    """The step of a classifier of the model's labels with that penalty which foretells them best on items held out, of which the
    model gets the weights; none if no penalty foretells them better than the shares of the labels do. Cases are held out whole.

    A classifier that merely repeats the labels it is fitted to would confirm the annotators' errors, so it counts on other items only.
    """

    def products(batch: Items) -> list[np.ndarray]:
        own = batch.value * np.bincount(batch.row, batch.value, batch.n)[batch.row]
        return [np.stack([np.bincount(batch.at, own * (batch.fold == f)[batch.row], FEATURES + 1) for f in range(FOLDS)])]

    (curves,) = total(items, products, [(FOLDS, FEATURES + 1)])
    trials = [(f, p) for p in PENALTIES for f in range(FOLDS)]
    solvers = [Solver(curves.sum(0) - curves[f], p) for f, p in trials]
    weights = np.repeat(model.weights[None], len(trials), 0)

    def trial(batch: Items) -> list[np.ndarray]:
        post = model.posterior(batch)[0]
        gradient, fit = np.zeros((len(trials), FEATURES + 1, K)), np.zeros(len(trials))
        for t, (f, _) in enumerate(trials):
            prior = _normal(batch.scores(weights[t]))[0]
            held = batch.fold == f
            gradient[t] = batch.gradient((post - prior) * ~held[:, None])
            fit[t] = (post * np.log(np.maximum(prior, 1e-300)))[held].sum()
        return [gradient, fit]

    plain, ahead, now = None, weights, weights
    for step in range(TRIAL_ROUNDS + 1):
        weights = ahead
        gradient, fit = total(items, trial, [(len(trials), FEATURES + 1, K), (len(trials),)])
        fit = fit.reshape(len(PENALTIES), FOLDS).sum(1)
        plain = fit.max() if plain is None else plain
        before, now = now, ahead + np.stack([s(g, w) for s, g, w in zip(solvers, gradient, ahead)])
        # Momentum, as far as a step may look ahead.
        ahead = now + step / (step + 3) * (now - before)
    best = int(fit.argmax())
    if fit[best] <= plain:
        return None
    model.weights = now.reshape(len(PENALTIES), FOLDS, FEATURES + 1, K)[best].mean(0)
    return Solver(curves.sum(0), PENALTIES[best])


class Sent:
    """Fits whose annotators' matrices are sent to every task."""

    def __init__(self, items: DataFrame, annotators: int):
        self.items, self.models = items, first_models(items, annotators)

    def step(self, models: list[Model], solver=None) -> None:
        """One round of each of these models, in one pass over the items."""
        sums = total(self.items, lambda batch: [a for m in models for a in m.sums(batch)], [s for m in models for s in m.shapes()])
        for i, m in enumerate(models):
            m.update(sums[5 * i : 5 * i + 5], solver)

    def read_by(self, model: Model) -> DataFrame:
        return self.items


class Joined:
    """The same fits where annotators are too many to be sent: the matrices of each model lie in a table by annotator."""

    def __init__(self, known: DataFrame, items: DataFrame):
        self.said = cut_lineage(known.select("case_id", "version", "annotator_id", "label"))
        self.items, self.models = items, [Model(np.zeros((0, K, K))) for _ in range(3)]
        self.tables = dict(zip(map(id, self.models), self.first_tables()))
        self.heard = {id(m): self.hear(m) for m in self.models}

    def of_items(self, other: DataFrame) -> DataFrame:
        """Every judgement with the row of ``other`` about its item."""
        same = F.col("a.case_id").eqNullSafe(F.col("b.case_id")) & F.col("a.version").eqNullSafe(F.col("b.version"))
        return self.said.alias("a").join(other.alias("b"), same).select("a.annotator_id", "a.label", *[F.col(f"b.{c}") for c in other.columns if c not in ("case_id", "version")])

    def cells(self, rows: DataFrame, weight) -> DataFrame:
        """``annotator_id, c0`` and so on: sums by true and given label of the judgements' weights, of which there is one for each true label."""
        return cut_lineage(rows.groupBy("annotator_id").agg(*[F.sum(F.when(F.col("label") == s, weight(t)).otherwise(0.0)).alias(f"c{t * K + s}") for t in range(K) for s in range(K)]))

    @staticmethod
    def smoothed(cells: DataFrame) -> DataFrame:
        """``annotator_id, matrix``, as :func:`smoothed` draws them."""
        pooled = np.array([x or 0.0 for x in cells.agg(*[F.sum(f"c{i}") for i in range(K * K)]).first()]).reshape(K, K) + 1
        pooled = PSEUDO * pooled / pooled.sum(1, keepdims=True)
        row = [sum((F.col(f"c{t * K + s}") for s in range(1, K)), F.col(f"c{t * K}")) + PSEUDO for t in range(K)]
        return cells.select("annotator_id", F.array(*[(F.col(f"c{t * K + s}") + float(pooled[t, s])) / row[t] for t in range(K) for s in range(K)]).alias("matrix"))

    def first_tables(self) -> list[DataFrame]:
        """The matrices of :func:`first_models`."""
        diagonal_of = lambda right: F.array(*[right if s == t else (1 - right) / (K - 1) for t in range(K) for s in range(K)])
        counts = self.said.groupBy("case_id", "version").agg(*[F.count_if(F.col("label") == k).alias(f"n{k}") for k in range(K)])
        others = F.greatest(sum((F.col(f"n{k}") for k in range(1, K)), F.col("n0")) - 1, F.lit(1))
        seen = self.cells(self.of_items(counts), lambda t: (F.col(f"n{t}") - (F.col("label") == t).cast("int")) / others)
        agreed = (sum((F.col(f"c{k * K + k}") for k in range(1, K)), F.col("c0")) + 1) / (sum((F.col(f"c{i}") for i in range(1, K * K)), F.col("c0")) + 3)
        top = seen.agg(F.max(agreed)).first()[0]
        right = F.greatest(F.lit(0.26), F.least(F.lit(0.9), F.lit(0.9) * agreed / F.lit(top)))
        return [seen.select("annotator_id", diagonal_of(F.lit(0.6)).alias("matrix")), seen.select("annotator_id", diagonal_of(right).alias("matrix")), self.smoothed(seen)]

    def hear(self, model: Model) -> DataFrame:
        """The items with what their annotators' labels tell of each true label, as logarithms."""
        spoken = self.said.join(self.tables[id(model)], "annotator_id").groupBy("case_id", "version").agg(*[F.sum(F.log(F.col("matrix")[k * K + F.col("label")])).alias(f"h{k}") for k in range(K)])
        same = F.col("a.case_id").eqNullSafe(F.col("b.case_id")) & F.col("a.version").eqNullSafe(F.col("b.version"))
        found = self.items.alias("a").join(spoken.alias("b"), same).select("a.*", F.array(*[F.col(f"b.h{k}") for k in range(K)]).alias("heard"))
        return cut_lineage(found)

    def maximise(self, model: Model) -> None:
        """New matrices against the model's posterior."""
        items = self.heard[id(model)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                post = model.posterior(Items(batch))[0] if batch.num_rows else np.zeros((0, K))
                yield pa.RecordBatch.from_arrays([batch.column("case_id"), batch.column("version"), *[pa.array(post[:, k]) for k in range(K)]], names=["case_id", "version", *[f"p{k}" for k in range(K)]])

        kinds = f"case_id {items.schema['case_id'].dataType.simpleString()}, version {items.schema['version'].dataType.simpleString()}, " + ", ".join(f"p{k} double" for k in range(K))
        post = items.select("case_id", "version", "fold", "features", "who", "said", "evidence", "heard").mapInArrow(run, kinds)
        self.tables[id(model)] = self.smoothed(self.cells(self.of_items(post), lambda t: F.col(f"p{t}")))

    def step(self, models: list[Model], solver=None) -> None:
        for m in models:
            sums = total(self.heard[id(m)], m.sums, m.shapes())
            # The matrices and the rest are maximised against the same posterior.
            self.maximise(m)
            m.update(sums, solver)
            self.heard[id(m)] = self.hear(m)

    def read_by(self, model: Model) -> DataFrame:
        return self.heard[id(model)]


def _fit(fits: Sent | Joined) -> Model:
    """The likeliest of the fits, with a classifier as prior where it foretells; the same rounds wherever the matrices lie."""
    models = fits.models
    while not all(m.converged for m in models):
        fits.step([m for m in models if not m.converged])
        if max(m.rounds for m in models) >= WARN_ROUNDS:
            break
    model = max(models, key=lambda m: m.likelihood)
    solver = classifier(fits.read_by(model), model)
    model.converged = solver is None and model.converged
    while not model.converged and model.rounds < 2 * WARN_ROUNDS:
        fits.step([model], solver)
    return model


@dataclass
class Fit:
    """Items with judgements and features, the fitted model, and annotators with number, matrix (true by given label) and reliability."""

    items: DataFrame
    model: Model
    annotators: DataFrame


def fit_consensus(records: DataFrame, sent: int = SENT_ANNOTATORS) -> Fit:
    """The model fitted on all items, which lie in the shared checkpoint folder; each round is one pass over them.

    First expectation-maximisation with one label prior for all items, from several starts, of which the likeliest stays;
    then, if a classifier of the items' features foretells labels of items held out, with its output as each item's prior.
    It ends when the likelihood no longer changes; one that has not ended after WARN_ROUNDS gives a warning.
    """
    known = cut_lineage(judgements(records))
    spark = records.sparkSession
    names = [r[0] for r in known.select("annotator_id").distinct().orderBy("annotator_id").limit(sent + 1).collect()]
    few = len(names) <= sent
    words = F.filter(F.split(F.lower("path"), r"[/._\-]+|\d+"), lambda x: F.length(x) > 0)
    ends = F.array(F.concat(F.lit("under "), F.substring_index("path", "/", 1)), F.concat(F.lit("ends "), F.lower(F.substring_index("path", ".", -1))))
    parts = F.array_distinct(F.concat(words, ends))
    if few:
        numbers = spark.createDataFrame(list(zip(names, range(len(names)))), "annotator_id string, who int")
        numbered = known.join(F.broadcast(numbers), "annotator_id")
    else:
        numbered = known.withColumn("who", F.lit(-1))
    grouped = numbered.groupBy("case_id", "version").agg(F.collect_list(F.struct("who", "label", F.coalesce("evidence", F.lit(-1)).alias("evidence"))).alias("each"), F.min("path").alias("path"))
    features = F.transform(parts, lambda x: F.pmod(F.xxhash64(x), F.lit(FEATURES)).cast("int"))
    items = grouped.select(
        "case_id", "version", F.pmod(F.xxhash64("case_id"), F.lit(FOLDS)).cast("int").alias("fold"), F.col("each.who").alias("who"), F.col("each.label").alias("said"),
        F.transform("each", lambda x: x["evidence"] + 1).alias("evidence"), F.coalesce(features, F.array().cast("array<int>")).alias("features"),
    )
    items = cut_lineage(items)
    if few:
        model = _fit(Sent(items, len(names))) if names else Model(np.zeros((0, K, K)))
        rows = [(n, i, m.ravel().tolist()) for i, (n, m) in enumerate(zip(names, model.confusion))]
        people = spark.createDataFrame(rows, "annotator_id string, who int, matrix array<double>")
    else:
        joined = Joined(known, items)
        model = _fit(joined)
        items, people = joined.read_by(model), joined.tables[id(model)].select("annotator_id", F.lit(-1).alias("who"), "matrix")
    if names and not model.converged:
        warnings.warn(f"the consensus has not converged after {model.rounds} rounds", stacklevel=2)
    trust = sum((F.col("matrix")[k * K + k] * float(s) for k, s in enumerate(model.share())), F.lit(0.0))
    said = known.groupBy("annotator_id").agg(F.count("*").alias("n_judgements"))
    return Fit(items, model, people.join(said, "annotator_id").withColumn("reliability", trust))


def consensus(records: DataFrame, sent: int = SENT_ANNOTATORS) -> tuple[DataFrame, DataFrame]:
    """Consensus by candidate, and reliability by annotator.

    First: ``case_id, candidate_version_id, classification, evidence_sufficiency, probability, agreement, n_judgements``.
    The classification has the greatest posterior, ties going to the first of LABELS. Agreement is the share of
    agreeing pairs of judgements, null for a single one. Evidence sufficiency is that with the most weight, each judgement
    weighing by how likely its label is the consensus; null if none gave it. Candidates without a valid judgement have no row.
    Second: ``annotator_id, n_judgements, reliability``, the chance that the annotator names the right label.

    The model: every annotator has a confusion matrix drawn to the average one; the evidence that goes with a judgement
    depends on the given and the true label; the label prior of a candidate comes from a regularised classifier of its path's parts
    where that foretells labels of cases held out, and is the same for all candidates where it does not. The matrices of up to ``sent`` annotators are sent to
    every task, those of more are joined; starts, rounds and ends are the same, so the result does not depend on it.
    """
    fit = fit_consensus(records, sent)
    fitted = records.sparkSession.sparkContext.broadcast(fit.model)
    kinds = (records.schema["case_id"].dataType.simpleString(), records.schema["candidate_version_id"].dataType.simpleString())

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = fitted.value
        for batch in batches:
            if not batch.num_rows:
                continue
            items = Items(batch)
            post, _, _ = own.posterior(items)
            counts = np.zeros((items.n, K))
            np.add.at(counts, (items.of, items.said), 1)
            each = counts.sum(1)
            pairs = each * (each - 1)
            agreement = np.where(pairs > 0, (counts * (counts - 1)).sum(1) / np.maximum(pairs, 1), np.nan)
            weight = np.zeros((items.n, len(SUFFICIENCY)))
            given = items.evidence > 0
            np.add.at(weight, (items.of[given], items.evidence[given] - 1), 1e-9 + post[items.of[given], items.said[given]])
            best = np.where(weight.max(1) > 0, weight.argmax(1), -1)
            label = post.argmax(1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("case_id"), batch.column("version"), pa.array([LABELS[i] for i in label], pa.string()), pa.array([SUFFICIENCY[i] if i >= 0 else None for i in best], pa.string()),
                    pa.array(post.max(1)), pa.array(agreement, from_pandas=True), pa.array(each.astype(np.int32)),
                ],
                names=["case_id", "candidate_version_id", "classification", "evidence_sufficiency", "probability", "agreement", "n_judgements"],
            )

    found = fit.items.mapInArrow(decide, f"case_id {kinds[0]}, candidate_version_id {kinds[1]}, classification string, evidence_sufficiency string, probability double, agreement double, n_judgements int")
    return found, fit.annotators.select("annotator_id", "n_judgements", "reliability")
