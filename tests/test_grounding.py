import pytest
from tracewake.operators import grounding as g

CHANGED = ["src/billing.ts", "src/lock/index.ts"]


@pytest.mark.parametrize(
    ("statement", "ends", "wanted"),
    [
        ("The candidate imports src/billing.ts.", ["target"], "import-direction"), ("The candidate imports billing.js.", ["source"], None), ("It imports the changed file.", ["target", "target"], "import-direction"),
        ("It imports the changed file.", ["target", "source"], None), ("billing.ts imports the candidate.", ["source"], "import-direction"), ("The changed module imports it.", ["source"], "import-direction"),
        ("The candidate is imported by billing.", ["source"], "import-direction"), ("The candidate is imported by `billing.ts`.", ["target"], None), ("It does not import billing.ts.", ["source"], "import-denied"),
        ("It does not import or use billing.ts.", ["source"], "import-denied"), ("It doesn't import ledger.ts, but imports billing.ts.", ["source"], None), ("It imports x.ts, which is changed.", ["target"], "import-direction"),
        ("It imports index.ts.", ["target"], None), ("It imports billing.test.ts.", ["target"], None), ("It imports billing.ts.", [], None), ("It depends on billing.ts.", ["target"], None),
    ],
)
def test_import_direction(statement, ends, wanted):
    assert g.import_direction(statement, CHANGED, ends) == wanted


def test_symbol_use():
    texts = ["import { release } from './lock';\nimport './side'; export * as q from \"z\";\nconst a = hold.take(1)"]
    problem = lambda s: g.symbol_use(s, texts)
    assert problem("It calls the function `release`.") == "symbol-only-imported" and problem("It uses 'other'.") == "symbol-not-shown"
    assert problem("It calls `hold.take`.") is None and problem("It calls `hold.give`.") == "symbol-not-shown" and problem("It never calls 'other'.") is None
    assert problem("It uses other.") is None and problem("It uses 'not a name'.") is None
    left = g.without_imports("import a, { b } from 'c'; x(); import type D from 'e'\ny(); import z = require('q'); export { k } from 'w'; import * as n from 'v'")
    assert "x()" in left and "y()" in left and "require" in left and not any(w in left for w in ("{ b }", "D from", "{ k }", "as n"))


@pytest.mark.parametrize(
    ("statement", "wanted"),
    [("It has three tests.", "test-count"), ("It has 12 unit and-or specs.", "test-count"), ("There are many small old new tests.", None), ("There are numerous test suites.", "test-count"), ("It has a test.", None), ("Two, tests", None), ("It holds several test cases", "test-count")],
)
def test_counts(statement, wanted):
    assert g.test_count(statement, False) == wanted and g.test_count(statement, True) is None


def test_presence():
    problem = lambda s, matched=("ledger",), path=(), texts=(): g.lexical_presence(s, {"ledger", "lock"}, None if matched is None else set(matched), set(path), set(texts))
    assert problem("The file mentions 'lock'.") == "term-not-recorded" and problem("The file mentions 'ledger'.") is None and problem("The file mentions 'other'.") is None
    assert problem("The file mentions 'Lock'.", texts=["lock"]) is None and problem("It includes 'lock'", path=["lock"]) is None
    assert problem("It does not contain 'ledger'.") == "term-matched" and problem("It does not contain 'ledger'.", path=["ledger"]) is None and problem("It does not contain 'ledger'.", None) is None
    assert problem("The change description does not mention 'ledger'.") is None and problem("It has the term 'lock'.") == "term-not-recorded"


def test_clauses():
    read = lambda s: [" ".join(w.raw for w in c) for c in g.clauses(s)]
    assert read("A b, but c d. E; f, and g, whereas h") == ["A b", "c d", "E", "f and g", "h"]


def test_rows(spark):
    rows = [
        ("It imports a.ts.", "Fix lock", ["src/holder.ts", None], "src/x.ts", ["target"], None, None, None), ("It imports holder.ts.", "Fix lock", ["src/holder.ts"], "src/x.ts", ["target", None], None, None, None),
        ("It mentions 'lock'.", "Fix lock", ["src/holder.ts"], "src/x.ts", [], [], [], ["other"]), (None, None, None, None, None, None, None, None), ("It mentions 'lock'.", "Fix lock", ["a.ts"], "x/lock.ts", [], [], [], None),
    ]
    df = spark.createDataFrame(rows, "statement string, description string, changed_paths array<string>, candidate_path string, candidate_is array<string>, chunk_texts array<string>, declaration_texts array<string>, matched_terms array<string>")
    assert sorted(r["problem"] for r in g.grounding_problems(df).collect()) == ["import-direction", "term-not-recorded"]
    assert g.grounding_problems(df.limit(0)).count() == 0


def test_first_problem():
    say = lambda s, ends=("target",), declarations=(), chunks=(): g.statement_problem(s, ["src/ipaddr.ts"], g.Cited(list(ends), list(chunks), list(declarations)), [], [], [])
    assert say("It imports ipaddr.js directly.") == "import-direction" and say("It does not import ipaddr.ts.", ["source"]) == "import-denied" and say("The changed file imports it.") is None
    assert say("It calls `parse`.", declarations=["import { parse } from './ipaddr.js'"]) == "symbol-only-imported" and say("It calls `parse`.", chunks=["parse(x)"]) is None
    assert say("Three tests cover it.") == "test-count" and say("Three tests cover it.", declarations=["import 'x'"]) == "test-count"
