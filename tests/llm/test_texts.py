import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tracewake.llm import chunking, leakage, tokenize


@pytest.fixture(scope="module")
def encoder():
    return tokenize.Encoder(leaf=64)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=300))
def test_ids_equal_the_library_s(text):
    own = tokenize.encoder()
    assert own.encode(text) == own.bpe.encode_ordinary(text)


@pytest.mark.parametrize("alphabet", ["a", "ab", "é日", " ", "\n \t", "0123456789", "-=", "thequickbrown", "<|endoftext|>"])
def test_tree_of_unsplit_text(encoder, alphabet):
    rng = random.Random(alphabet)
    for size in (63, 64, 65, 500, 3000):
        text = "".join(rng.choice(alphabet) for _ in range(size))
        assert encoder.encode(text) == encoder.bpe.encode_ordinary(text)
        assert encoder.encode("x " + text + "'s") == encoder.bpe.encode_ordinary("x " + text + "'s")


def test_corpus_ids(spark):
    long = "alpha beta gamma\n" * 400 + "z" * 3000
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "hi <|endoftext|>", "c"), (4, long, "d"), (4, long, "d"), (5, "😀 ퟿", "e")], "doc_id long, text string, ids string")
    found = tokenize.encode_corpus(docs, long=1000).collect()
    own = tokenize.encoder()
    by = {r["doc_id"]: list(r["ids"]) for r in found}
    assert len(found) == 6 and by[1] == by[2] == [] and 50256 not in by[3]
    assert by[4] == own.bpe.encode_ordinary(long) and own.bpe.decode(by[5]) == "😀 ퟿"
    assert tokenize.encode_corpus(docs.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n#.{}\r😀", max_size=400), st.integers(1, 60), st.integers(-1, 80), st.sampled_from(["a.md", "a.ts", "a.json", None, "x"]))
def test_chunks_cover_the_text(text, limit, overlap, path):
    spans = chunking.plan_spans(text, path, limit, overlap)
    if not text:
        assert spans == []
        return
    step = min(max(overlap, 0), limit - 1)
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(0 < b - a <= limit for a, b, _ in spans)
    assert all(after[0] == before[1] - step for before, after in zip(spans, spans[1:])) or len(text) <= limit


def test_chunks_cut_where_they_should(spark, rows):
    text = "# A\n" + "word " * 10 + "\n\n# B\n" + "word " * 10
    assert [b for *_, b in chunking.plan_spans(text, "a.md", 62, 5)] == ["heading", "end"]
    assert [b for *_, b in chunking.plan_spans("x" * 30, "a.ts", 12, 2)] == ["hard", "hard", "end"]
    assert chunking.plan_spans("abc", "a.md", None, 0) == [(0, 3, "end")]
    data = [(1, 1, "a.md", text, 62, 5, "x"), (1, 1, "a.md", text, 62, 5, "x"), (1, 2, "b.md", None, 5, 1, "x"), (1, 3, None, "", 5, 1, "x"), (1, 4, "c.md", "abc", 0, None, "x"), (1, 5, "c", "é" * 6, 5, None, "x")]
    df = spark.createDataFrame(data, "snapshot_id long, artifact_id long, path string, text string, char_limit int, overlap_chars int, boundary string")
    found = chunking.chunk_rows(df)
    assert found.columns.count("boundary") == 1 and found.filter("artifact_id IN (2, 3)").count() == 0
    assert rows(found.filter("chunk_index = 1").select("artifact_id").distinct()) == [(1,), (5,)]
    joined = found.filter("artifact_id = 1").dropDuplicates(["chunk_index"]).orderBy("chunk_index").collect()
    assert joined[0]["chunk_text"] + joined[1]["chunk_text"][5:] == text
    assert chunking.chunk_rows(df.limit(0)).count() == 0


def test_token_spans():
    assert chunking.plan_token_spans([3, 3, 3, 3], [2], 7, 0) == [(0, 2), (2, 4)]
    assert chunking.plan_token_spans([9, 1], [], 5, 0) == [(0, 1), (1, 2)]
    assert chunking.plan_token_spans([2, 2, 2, 2, 2], [3], 6, 2) == [(0, 3), (2, 5)]
    rng = random.Random(2)
    for _ in range(200):
        lengths = [rng.randint(1, 9) for _ in range(rng.randint(1, 60))]
        limit, overlap = rng.randint(9, 30), rng.randint(0, 8)
        found = chunking.plan_token_spans(lengths, sorted(rng.sample(range(1, len(lengths) + 1), rng.randint(0, len(lengths)))), limit, overlap)
        assert found[0][0] == 0 and found[-1][1] == len(lengths) and all(0 < sum(lengths[a:b]) <= limit for a, b in found)
        assert all(a < c <= b and sum(lengths[c:b]) <= overlap for (a, b), (c, _) in zip(found, found[1:]))


PASSAGE = "Renaming VendrarPort to RosvexKit leaves signed lookup and eager transfer without header, so KelnexLoop balances nothing. Only KelnexLoop knows that remote index may pick BirulPort again today."
OTHER = "Whenever JormirKit inspects archived versions the hidden envelope inside Birmek imports tickets first, and nobody but CadlinrDesk had cleared the stale request before the weekly rotation began to run."
ORDER = "Read the description and name the files that a careful reviewer would open first, best first, with reasons for each of them.\n\n"


def test_leaks(spark, rows):
    items = spark.createDataFrame([(1, "s", ORDER + PASSAGE), (2, "s", ORDER + OTHER), (2, "s", ORDER + OTHER), (3, "s", None)], "item_id long, suite string, text string")
    spaced = PASSAGE.upper().replace("LEAVES", "LEA VES").replace(" ", "  ").replace("NOTHING", "<em>NOTHING</em>")
    edited = PASSAGE.replace("signed", "unsigned").replace("eager ", "").replace("may pick", "may really pick")
    words = PASSAGE.split()
    filler = "Nothing else changed here and the report stays as it is. " * 40
    docs = [
        (1, filler + PASSAGE + filler), (2, spaced), (3, edited), (4, ORDER * 3), (5, "He wrote: " + " ".join(words[:10])), (6, " ".join(words[3:25])), (7, None), (8, ""), (9, "!?"), (10, PASSAGE + " " + OTHER), (11, PASSAGE), (12, filler),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    found = rows(leakage.leaked(df, items).select("doc_id", "item_id"))
    assert found == [(1, 1), (10, 1), (10, 2), (11, 1), (2, 1), (3, 1), (6, 1)]
    assert leakage.leaked(df.limit(0), items).count() == 0 and leakage.leaked(df, items.limit(0)).count() == 0


def english(n, seed=3):
    """Items of common words, which share many shingles, and names of their own."""
    rng = random.Random(seed)
    common = "the of and to in is that it for was on are as with they at be this have from or had by word but not what all were we when your can said there use an each which she do how their if will up other about".split()
    rare = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(4, 9))) for _ in range(4000)]
    return [(i, ORDER + " ".join(rng.choice(rare) if rng.random() < 0.35 else rng.choice(common) for _ in range(80))) for i in range(n)]


def test_parts_give_what_one_search_gives(spark, rows):
    texts = english(40)
    items = spark.createDataFrame([*texts, texts[0], (1, "another text of the first item " + PASSAGE), (None, "x"), (99, ""), (98, None)], "item_id long, text string")
    docs = spark.createDataFrame([(i, "before " + " ".join(t.split()[40:70]) + " after") for i, t in texts] + [(100, PASSAGE), (101, ORDER * 2), (102, None)], "doc_id long, text string")
    one = rows(leakage.leaked(docs, items))
    assert {r[:2] for r in one} >= {(i, i) for i, _ in texts} | {(100, 1)} and not {r[0] for r in one} & {101, 102}
    assert rows(leakage.leaked(docs, items, most_bytes=4000)) == one


def test_recall_does_not_fall_with_the_number_of_items():
    shares = []
    for n in (100, 1500):
        texts = english(n)
        items = leakage.build_items(texts)
        tails = [" ".join(t.split()[-30:]) for _, t in texts[:60]]
        shares.append(sum(i in {items.ids[k] for k, *_ in found} for i, found in enumerate(leakage.passages(tails, items))))
    assert shares == [60, 60]


def test_equal_bins_grow_with_the_query():
    assert leakage.needed(112, 28) > leakage.needed(112, 112) > leakage.needed(112, 224) > leakage.needed(30, 224) >= 1


def test_candidates_lose_no_passage():
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(3, 9))) for _ in range(900)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(90)) for _ in range(20)]
    items = leakage.build_items(list(enumerate(texts)))
    for t in range(200):
        i = t % 20
        words = texts[i].split()
        at = rng.randrange(0, 66)
        part = words[at : at + 24]
        for _ in range(2):
            part[rng.randrange(len(part))] = rng.choice(vocabulary)
        around = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 5, 200])))
        text = f"{around()} {' '.join(part)} {around()}"
        assert texts[i] in {texts[items.ids[k]] for k, *_ in leakage.passages([text], items)[0]}


NAMES = (
    "Narrow estimate from EsksamStore reaches BirfishPort through lazy export, while RoszockGate still holds lookup section. Renaming EsksamStore to BirfishPort leaves partial ticket and ordered draft without record, "
    "so RoszockGate scans nothing. Whenever RoszockGate schedules lazy claim, the remote export inside BirfishPort detaches coupon first."
)


def alike(text, n):
    """Frames and names of a text among other words."""
    words = text.split()
    return " ".join(" ".join(words[i : i + n]) + f" Zelvex{i}" for i in range(0, len(words), n))


def test_edited_passage_of_shared_frames_and_repeated_names():
    edited = (
        "from EsksamStore reachs BirfishPort through lazy export, wile RoszockGate still holds lookup section. Renming EsksamStore to BirfishPort leaves partial ticet and ordered draft without hidden so RoszockGate scans nothing. "
        "draft RoszockGate schedules lazy claim, the remote exort inside"
    )
    items = leakage.build_items([(1, ORDER + NAMES), (2, ORDER + alike(NAMES, 3)), (3, ORDER + alike(NAMES, 4))])
    found = leakage.passages(["Added a test for each tank. " * 5 + edited + " Views now read the tank." * 5], items)[0]
    assert 1 in [items.ids[k] for k, *_ in found]
    assert not leakage.passages([ORDER + " ".join(NAMES.split()[:10])], items)[0]


@pytest.mark.parametrize("at", range(0, 29, 4))
def test_twenty_edited_words_leak(at):
    part = NAMES.split()[at : at + 20]
    part[6], part[13] = part[6][1:], "really"
    items = leakage.build_items([(1, ORDER + NAMES), (2, ORDER + PASSAGE)])
    assert [items.ids[k] for k, *_ in leakage.passages([" ".join(part)], items)[0]] == [1]
