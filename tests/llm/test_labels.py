import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F
from tracewake.llm import consensus, subjects

RECORD = "annotation_id long, annotator_id string, annotated_at timestamp, case_id string, candidate_path string, candidate_artifact_id long, candidate_version_id long, candidate_content_sha256 string, reference_assessment struct<classification:string,evidence_sufficiency:string,primary_rationale:string>, blinding_verification struct<reviewed_diffs_or_hindsight:boolean,reviewed_other_annotator:boolean,reviewed_model_outputs:boolean>"
OPEN = (False, None, False)


def record(i, who, item, label, day=1, blind=OPEN, evidence=None, path="src/a.ts"):
    return (i, who, datetime(2024, 1, day), f"c{item % 7}", path, 1, item, None, (label, evidence, None), blind)


def test_judgements(spark, rows):
    data = [
        record(1, "a", 1, " Likely-Affected\t"), record(2, "a", 1, "NO_IMPACT_INDICATED", 2), record(2, "a", 1, "NO_IMPACT_INDICATED", 2), record(3, "b", 1, "TODO"), record(4, "c", 1, None), record(5, "d", 1, "likely_affected", blind=(True, False, False)),
        record(6, "e", 1, "  "), record(7, None, 1, "likely_affected"), record(8, "f", 1, "insufficient evidence"), record(9, "g", 2, "potentially__affected"), record(10, "g", 2, "likely affected"),
    ]
    df = spark.createDataFrame(data, RECORD).withColumn("label", F.lit("clash"))
    assert rows(consensus.judgements(df).select("annotator_id", "version", "label")) == [("a", 1, 2), ("f", 1, 3), ("g", 2, 0)]
    found, people = consensus.consensus(df)
    assert rows(found.select("candidate_version_id", "n_judgements")) == [(1, 2), (2, 1)]
    assert found.filter("candidate_version_id = 2").first()["agreement"] is None and people.count() == 3
    none, nobody = consensus.consensus(df.limit(0))
    assert none.count() == 0 and nobody.count() == 0


def test_consensus_beats_the_majority(spark):
    rng = random.Random(5)
    truth, data = {}, []
    people = [(f"p{i}", 0.88 if i < 6 else 0.0 if i < 9 else 0.25) for i in range(12)]
    for item in range(400):
        truth[item] = rng.randrange(4)
        for who, skill in rng.sample(people, 5):
            t = truth[item]
            # The adverse ones swap labels one and three; the careless ones guess.
            said = {0: 2, 2: 0}.get(t, t) if skill == 0.0 else t if rng.random() < skill else rng.randrange(4)
            data.append(record(len(data), who, item, consensus.LABELS[said], evidence="fully_sufficient"))
    found, people_found = consensus.consensus(spark.createDataFrame(data, RECORD))
    got = {r["candidate_version_id"]: r["classification"] for r in found.collect()}
    right = np.mean([got[i] == consensus.LABELS[t] for i, t in truth.items()])
    votes: dict = {}
    for r in data:
        votes.setdefault(r[6], []).append(r[8][0])
    majority = np.mean([max(sorted(set(v)), key=v.count) == consensus.LABELS[truth[i]] for i, v in votes.items()])
    assert right > 0.93 and right > majority + 0.05
    trust = {r["annotator_id"]: r["reliability"] for r in people_found.collect()}
    assert min(trust[f"p{i}"] for i in range(6)) > 0.75 > 0.6 > max(trust[f"p{i}"] for i in range(6, 12))


def crowd(seed, items, path_of, each=3, people=20):
    """Judgements of people of whom half are careful; ``path_of`` gives a path for a truth."""
    rng = random.Random(seed)
    skill = [0.8 if i % 2 else 0.3 for i in range(people)]
    truth, data = {}, []
    for item in range(items):
        truth[item] = rng.randrange(4)
        path = path_of(truth[item], rng)
        for who in rng.sample(range(people), each):
            t = truth[item]
            said = t if rng.random() < skill[who] else rng.randrange(4)
            data.append(record(len(data), f"p{who}", item, consensus.LABELS[said], evidence=rng.choice(consensus.SUFFICIENCY), path=path))
    return truth, data


def share_right(found, truth):
    return np.mean([r["classification"] == consensus.LABELS[truth[r["candidate_version_id"]]] for r in found.collect()])


def plain(spark, data, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(consensus, "classifier", lambda *a: None)
        return consensus.consensus(spark.createDataFrame(data, RECORD))[0]


def test_features_that_tell_nothing_change_nothing(spark, monkeypatch):
    words = ["api", "jobs", "sync", "docs", "util", "core", "auth", "mail"]
    truth, data = crowd(3, 1500, lambda t, rng: "/".join(rng.sample(words, 3)) + ".ts")
    df = spark.createDataFrame(data, RECORD)
    fit = consensus.fit_consensus(df)
    assert fit.model.converged and fit.model.rounds < consensus.WARN_ROUNDS
    assert abs(share_right(consensus.consensus(df)[0], truth) - share_right(plain(spark, data, monkeypatch), truth)) < 0.01


def test_features_that_tell_help(spark, monkeypatch):
    folder = ["api", "jobs", "docs", "legacy"]
    truth, data = crowd(4, 1500, lambda t, rng: f"{folder[t] if rng.random() < 0.7 else rng.choice(folder)}/x{rng.randrange(9)}.ts")
    right = share_right(consensus.consensus(spark.createDataFrame(data, RECORD))[0], truth)
    assert right > share_right(plain(spark, data, monkeypatch), truth) + 0.03


def test_more_annotators_than_are_sent(spark, monkeypatch):
    for name, value in (("PENALTIES", (10.0,)), ("TRIAL_ROUNDS", 3), ("TOLERANCE", 1e-4)):
        monkeypatch.setattr(consensus, name, value)
    folder = ["api", "jobs", "docs", "legacy"]
    _, data = crowd(6, 120, lambda t, rng: f"{folder[t]}/a.ts", each=4, people=6)
    df = spark.createDataFrame(data, RECORD)
    sent, joined = consensus.consensus(df), consensus.consensus(df, sent=2)
    a, b = ({r["candidate_version_id"]: r for r in x[0].collect()} for x in (sent, joined))
    assert a.keys() == b.keys() and np.mean([a[i]["classification"] == b[i]["classification"] for i in a]) > 0.95
    assert all(abs(a[i]["agreement"] - b[i]["agreement"]) < 1e-12 for i in a)
    a, b = ({r["annotator_id"]: r["reliability"] for r in x[1].collect()} for x in (sent, joined))
    assert max(abs(a[w] - b[w]) for w in a) < 0.05


@pytest.mark.parametrize("tells", [True, False])
def test_the_way_of_the_matrices_changes_nothing(spark, monkeypatch, tells):
    for name, value in (("PENALTIES", (10.0,)), ("TRIAL_ROUNDS", 2), ("TOLERANCE", 1e-3)):
        monkeypatch.setattr(consensus, name, value)
    folder = ["api", "jobs", "docs", "legacy"]
    _, data = crowd(8, 100, lambda t, rng: f"{folder[t] if tells else rng.choice(folder)}/a.ts", each=3, people=6)
    # One item is judged by one annotator only, of whom nobody else tells anything.
    data += [record(len(data) + 1, "alone", 1000, consensus.LABELS[1])]
    df = spark.createDataFrame(data, RECORD)
    sent, joined = consensus.fit_consensus(df), consensus.fit_consensus(df, sent=2)
    assert sent.model.rounds == joined.model.rounds and abs(sent.model.likelihood - joined.model.likelihood) < 1e-9
    assert np.allclose(sent.model.weights, joined.model.weights, atol=1e-9) and np.allclose(sent.model.evidence, joined.model.evidence, atol=1e-9)
    a, b = ({r["annotator_id"]: r for r in f.annotators.collect()} for f in (sent, joined))
    assert a.keys() == b.keys() and all(np.allclose(a[w]["matrix"], b[w]["matrix"], atol=1e-9) and abs(a[w]["reliability"] - b[w]["reliability"]) < 1e-9 for w in a)


TERMS = {"law": ["court filing", "notary seal", "breach notice"], "music": ["drum loop", "key signature", "choir part"], "travel": ["seat map", "ferry crossing", "hotel night"]}


def corpus(n=900):
    rng = random.Random(9)
    plain = ["Nothing else changed in src/a.ts.", "This was reported by two teams.", "See #12 for the first half.", "Someone has to decide who owns the note."]
    docs, truth = [], {}
    names = sorted(TERMS)
    for d in range(n):
        about = rng.sample(names, rng.choice([1, 1, 1, 2]))
        text = [rng.choice(plain) for _ in range(rng.randint(1, 6))]
        for s in about:
            text += [f"Please check the {rng.choice(TERMS[s])} again." for _ in range(rng.randint(3, 5))]
            text.append(f"`{rng.choice(TERMS[s]).title().replace(' ', '')}Stream` is empty.")
        if rng.random() < 0.3:
            other = rng.choice([x for x in names if x not in about])
            text.append(f"(The {rng.choice(TERMS[other])} team had a similar question.)")
        rng.shuffle(text)
        docs.append((d, " ".join(text), "en", f"repo{d % 5}"))
        truth[d] = set(about)
    return docs, truth


def test_subjects(spark):
    docs, truth = corpus()
    rng = random.Random(2)
    labels = [(d, rng.choice(sorted(TERMS)) if rng.random() < 0.03 else s, "c") for d in range(300) for s in truth[d]]
    labels += labels[:20] + [(10**6, "law", "c"), (1, "unknown", "c"), (2, None, "c")]
    docs += [(5000, None, "en", "repo1"), (5001, "", None, None), (5002, "  \n", "en", "repo1"), (5003, "Plain words only.", "en", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").withColumn("s", F.lit(1)).withColumn("subject", F.lit("clash"))
    areas = spark.createDataFrame([(s, "") for s in TERMS], "subject string, description string")
    found: dict = {}
    for r in subjects.assign_subjects(df, spark.createDataFrame(labels, "doc_id long, subject string, labelled_by string"), areas).collect():
        found.setdefault(r["doc_id"], set()).add(r["subject"])
    held = range(300, 900)
    assert np.mean([found.get(d, set()) == truth[d] for d in held]) > 0.95
    assert not set(found) & {5000, 5001, 5002, 5003}
    told = {r["function"]: r for r in subjects.function_accuracies(df, spark.createDataFrame(labels, "doc_id long, subject string, labelled_by string"), areas).collect()}
    assert set(told) == {"lexicon", "address", "section", "source"} and told["lexicon"]["coverage"] > 0.5 and told["address"]["coverage"] > 0.2 and min(told["lexicon"]["accuracy"], told["address"]["accuracy"]) > 0.7
    empty = spark.createDataFrame([], "doc_id long, subject string, labelled_by string")
    assert subjects.function_accuracies(df, empty, areas).count() == 4
    assert subjects.assign_subjects(df, empty, areas).count() == 0
    assert subjects.assign_subjects(df.limit(0), empty, areas.limit(0)).count() == 0


def test_each_function_names_subjects_by_itself():
    lexicon, address, section = subjects.Vocabulary({"court filing": 0}), subjects.Vocabulary({"drum loop": 1}), subjects.Vocabulary({"seat map": 2})
    votes = lambda t: subjects.votes_of(t, lexicon, address, section)
    assert votes("x. See `drumLoop` and DrumLoopStream. A drum loop is heard.") == [(1, 0, 0, 1, 0)]
    assert votes("x. A seat map.\n# Seat map\nThe court filing.") == [(0, 1, 0, 0, 0), (2, 0, 1, 0, 1)]
    assert votes("x. a drum. loop of the court; filing") == [] and votes(None) == [] and votes("") == []
