import pytest
from pyspark.sql import functions as F
from tracewake.llm import ecma, handwritten, syntax
from tracewake.llm.ecma import JS, JSX, TS, TSX, dialects, is_json
from tracewake.llm.gll import Grammar

ALL, TYPES, MARKUP = 15, TS | TSX, JSX | TSX
CASES = [
    ("const a = 1;", ALL), ("", ALL), ("let x: number = 2", TYPES), ("a = b\nc = d", ALL), ("a b", 0), ("if (x) { y(); } else z()", ALL), ("const f = async (a, {b=1}, ...c) => { return a / 2 / b; }", ALL),
    ("const r = x.test(/a[/]b/g) ? `t ${a + `n${b}`} z` : null", ALL), ('<div a="1">{x}<b/></div>', MARKUP), ("<a></b>", 0), ("const f = <T,>(x: T) => x;", TYPES), ("const f = <T>(x: T) => x;", TS), ("<any>x;", TS),
    ("interface A extends B<C> { a: string; b?(x: number): void\n readonly [k: string]: any }", TYPES), ("export default class extends f() { #a = 1; static async *m() {} get x() { return 1 } }", ALL),
    ("class A { private readonly held: any; constructor(private input: any) { this.held = input; } }", TYPES), ("type F = () => { a: string };", TYPES), ("function f(a, b {", 0), ('{ "name": "x", "b": 1 }', 0),
    ("<<<<<<< HEAD\nx\n=======\ny\n>>>>>>> b", 0), ("/*\n<<<<<<< HEAD\n*/ x", ALL), ("for (const a of b) { c++; } for (;;) {} for (x in y) z", ALL), ("switch (a) { case 1: b(); break; default: { c } }", ALL),
    ("x = a < b && c > d; y = a >> 2 >>> 3 >= 4", ALL), ("const m = new Map<string, number[]>();", TYPES), ("do { x() } while (y)\nz()", ALL), ("try { a() } catch { b } finally { c }", ALL), ('import type { A } from "b"', TYPES),
    ("if (a) /re/.test(b)", ALL), ("async function* f() { for await (const x of y) yield* x; }", ALL), ("const A = (p) => (<><li key={p.id}>{p.state} text's</li></>);", MARKUP), ("const a = ;", 0), ("foo(", 0), ("`abc", 0),
    ("'abc\n'", 0), ("const o = {a: 1,, b: 2}", 0), ("function f() { return 1; }}", 0), ("const x = y!.z; abstract class Q { abstract a(): void; }", TYPES), ("# heading\n\ntext", 0), ("#!/usr/bin/env node\nx", ALL),
    ("return\n1", ALL), ("x\n++\ny", ALL), ("const s = '😀'; café = 1", ALL), ("const x = 1 // no newline", ALL), ("a ? b : c => d", ALL), ("x = {\n  get a() { return 1 },\n  async b() {},\n}", ALL),
]


@pytest.mark.parametrize(("text", "wanted"), CASES)
def test_dialects(text, wanted):
    assert dialects(text) == wanted


def test_folding_changes_nothing():
    for text, _ in CASES:
        for jsx in (False, True):
            try:
                whole = {s for s in ecma.segments(text, jsx, False)[0]}
            except ecma.Invalid:
                continue
            mask = ALL
            for s in whole:
                mask &= ecma._accepts(s, ALL)
            assert mask & (MARKUP if jsx else JS | TS) == ecma._dialects(text, jsx, MARKUP if jsx else JS | TS)[0]


@pytest.mark.parametrize(
    "text",
    ["function f() { export const x = 1; }", "if (a) { export default 3 }", "const f = () => { import 'x'; };", "try { import a from 'b' } finally { }", "function f() { x(); export { a }; y() }", "if (a) { while (b) { export * from 'c' } }"],
)
def test_blocks_hold_no_imports_and_exports(text):
    assert dialects(text) == 0
    assert dialects("namespace N { export const x = 1; export function f() { return 1 } }") == TYPES and dialects("if (a) { import('x').then(y); import.meta.url }") == ALL


#: Every list of the grammar, with a place for its items and an item.
LISTS = [
    ("import {%s} from 'x'", "a as b"), ("export {%s}", "a as b"), ("var %s", "a = 1"), ("const %s", "a = {b: 1}"), ("let {%s} = x", "a: b = 1"), ("let [%s] = x", "a = 1"), ("let [%s] = x", ""), ("function f(%s) {}", "a = 1"), ("x(%s)", "...a"),
    ("x = [%s]", "1"), ("x = [%s]", ""), ("x = [%s]", "[a, 1]"), ("x = {%s}", "a: 1"), ("x = {%s}", "'a': [1, {b: 2}]"), ("%s;", "a = 1"), ("x = (%s) => 1", "a"), ("enum E {%s}", "A = 1"), ("let x: [%s]", "a: string"), ("class A implements %s {}", "B"),
    ("interface A extends %s {}", "B.c"), ("for (let %s;;) {}", "a = 1"), ("for (%s;;) {}", "a++"), ("type A = {%s}", "a: string"), ("switch (%s) {}", "a"), ("x = `${%s}`", "a"), ("throw %s", "a"),
]


@pytest.mark.parametrize(("form", "item"), LISTS)
def test_shortening_changes_nothing(form, item):
    for n in range(2, 9):
        for items in (", ".join([item] * n), ", ".join([item] * n) + ",", ", ".join([item] * n) + " )", ", ".join([item] * n) + " 7 7", ", ".join([item] * (n - 1) + ["3 3"] + [item]), ", ".join([item] * n) + ",,"):
            for fold in (True, False):
                try:
                    found = ecma.segments(form % items, False, fold)[0]
                except ecma.Invalid:
                    continue
                for sequence in found:
                    assert ecma.recognised(ecma.shortened(sequence), JS | TS) == ecma.recognised(sequence, JS | TS), (form % items)


def test_whole_files_agree_with_folded_ones():
    import duckdb

    texts = duckdb.sql("SELECT DISTINCT text FROM '/root/testdata/sf0.001/content.parquet' WHERE text IS NOT NULL").fetchall()
    for (text,) in texts:
        for jsx, mask in ((False, JS | TS), (True, JSX | TSX)):
            try:
                (whole,) = ecma.segments(text, jsx, False)[0] or {""}
            except ecma.Invalid:
                continue
            if len(whole) < 6000:
                assert ecma.recognised(whole, mask) == ecma._dialects(text, jsx, mask)[0], text[:200]


def test_deep_json():
    for n in (20, 200_000):
        assert is_json("[" * n + "]" * n) and not is_json("[" * n + "]" * (n - 1)) and not is_json("[" * n + "1," + "]" * n)
        assert is_json('{"a":[' * n + '1.5e3, "\\u00e9"' + "]}" * n) and not is_json('{"a":[' * n + "]]" * n) and not is_json('{"a" ' * n + "}" * n)
    for text in ('{"a": 1, "b": [true, null, {}]}', "[]", "{}", "1", ""):
        assert ecma._deep_json(text) == is_json(text)
    for text in ("[1 2]", "{1: 2}", "[,1]", '{"a": 1,}', "[01]", "[1]]", '{"a"}', "[NaN]", '["\t"]', "]"):
        assert not ecma._deep_json(text) and not is_json(text)


def test_runs_of_list_items():
    rows = "export const A = [\n" + "  [1, 'a', -3],\n" * 5000 + "  [1, 'a',\n" * 0 + "];\nf(" + "1.5, -2, {a: 1}, " * 5000 + "3);"
    assert dialects(rows) == ALL and dialects(rows.replace("-3],\n];", "-3] 4\n];")) == 0
    for text, wanted in [("[" + "1," * 40 + "]", ALL), ("f(" + "a, " * 40 + ")", ALL), ("f(" + "a, " * 40 + ",)", 0), ("x = {" + "a: 1, " * 40 + "b c}", 0), ("let " + "a = 1, " * 40 + "b", ALL), ("f(" + "(a, " * 40 + ")", 0), ("f(" + "[a, " * 30 + "]" * 30 + ")", ALL)]:
        assert dialects(text) == wanted, text


def test_generalised_parsing():
    g = Grammar("S = S S | 'a' | [y]'b' ;", {"a": "a", "b": "b"}, {"x": 1, "y": 2}, "S")
    assert [g.recognise(t, set()) for t in ("a", "aaaa", "ab", "", "c")] == [3, 3, 2, 0, 0]


def test_generalised_parsing_of_empty_rules_and_conditions():
    g = Grammar("S = A* 'c' ; A = [y]'a' | B @nl 'b' | C ; B = @not('a') C* ; C = D? ; D = 'd' @same S 'd' ;", {c: c for c in "abcd"}, {"x": 1, "y": 2}, "S")
    assert [g.recognise(t, b) for t, b in [("c", set()), ("aac", set()), ("bc", {0}), ("bc", set()), ("dcdc", set()), ("dcdc", {1}), ("dcdbc", {3}), ("dacdc", set()), ("ddcdcdc", set()), ("ddcdc", set())]] == [3, 2, 3, 0, 3, 0, 3, 2, 3, 0]


def test_tokens_take_few_steps():
    """Counts lines, not seconds: a recogniser that goes through each rule anew takes 241 a token."""
    import sys

    text = "".join(f"const a{i} = b.c(d[{i}], {{ e: 'f', ...g }}) || h + i * 2;\nif (a{i} > 3) j(k);\n" for i in range(20))
    (sequence,) = ecma.segments(text, False, False)[0]
    steps = 0

    def trace(frame, event, _):
        nonlocal steps
        steps += event == "line"
        return trace

    assert ecma.recognised(sequence, ALL) == ALL
    before = sys.gettrace()
    sys.settrace(trace)
    try:
        ecma.recognised(sequence, ALL)
    finally:
        sys.settrace(before)
    assert steps < 100 * len(sequence)


def test_comments_stay_whole():
    assert dialects("a // `\n\\ b `") == 0 and dialects("a /* `\n*/ \\ b ` */") == 0
    assert dialects("a // `\n b") == ALL and dialects("/* ` */ a /**/ // */\n/**/") == ALL and dialects("a /* b") == 0


def test_json():
    assert [is_json(t) for t in ('{"a": [1, 2.5e3, null]}', "", "{'a': 1}", "[1,]", "NaN", '"a\nb"', "1" * 6000, "[" * 20_000, "// c\n{}", " 1 ")] == [True, False, False, False, False, False, True, False, False, True]


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


VERSION = "id long, repository_id long, artifact_id long, snapshot_id long, content_sha256 string, git_blob_sha string"


def test_versions(spark, rows):
    sha = lambda c: c * 64
    contents = table(spark, [(sha("a"), "let x: number"), (sha("b"), ""), (sha("c"), None), (sha("a"), "let x: number"), ("odd", "{}")], "sha256 string, text string").withColumn("path", F.lit(1))
    arts = table(spark, [(1, 1, "x.ts", "code"), (2, 1, "x.JS", "code"), (3, 1, "x.json", None), (4, 1, None, "code"), (5, 1, "x.py", "code"), (1, 1, "x.ts", "code")], "id long, repository_id long, path string, kind string")
    versions = table(spark, [(1, 1, 1, 1, sha("A"), None), (2, 1, 2, 1, sha("a"), None), (2, 1, 2, 1, sha("a"), None), (3, 1, 3, 1, sha("b"), None), (4, 1, 2, 1, sha("b"), None), (5, 1, 1, 1, sha("c"), None), (6, 1, 4, 1, sha("a"), None), (7, 1, 5, 1, sha("a"), None), (8, 1, 3, 1, "odd", None)], VERSION)
    assert rows(syntax.invalid_versions(versions, arts, contents)) == [(2,), (3,)]
    assert rows(syntax.invalid_rates(versions, arts, contents)) == [(1, "javascript", 2, 1, 0.5), (1, "json", 2, 1, 0.5), (1, "typescript", 1, 0, 0.0)]
    assert syntax.invalid_versions(versions.limit(0), arts.limit(0), contents.limit(0)).count() == 0


def test_weak_classes_and_masking():
    weak = lambda p, t: dict(zip(handwritten.CLASSES, handwritten.weak_classes(p, t)))
    assert weak("src/a.ts", "// @generated by x\nexport const a = 1;")["generated"]
    assert not any(weak("src/generated-reports/a.ts", "export const a = 1; // generated by hand, see vendor").values())
    assert weak("vendor/x.js", "a()")["third_party"] and not weak("src/vendors/x.js", "a()")["third_party"]
    assert weak("a.ts", "export const A = [\n" + "  1.5, -2.25, 3.125,\n" * 40 + "];")["data"]
    assert not weak("a.ts", "export const A = '" + "plain words of prose " * 30 + "';")["data"]
    assert handwritten.body_of("/*! lib v1 | (c) x */\n// more\ncode()\n//# sourceMappingURL=a.map") == "\ncode()\n"


def corpus(spark, n_repositories=10, per=24):
    import random

    rng = random.Random(3)
    word = lambda: rng.choice("order ledger claim zone vault cursor packet window route digest".split())
    contents, arts, versions, repositories, truth = [], [], [], [], {}
    number = 0
    for r in range(n_repositories):
        repositories.append((r, 1, f" Repo-{r}", None))
        for k in range(per):
            number += 1
            kind = ["hand", "hand", "hand", "generated", "built", "data"][k % 6]
            if kind == "hand":
                text = f"import {{ {word()} }} from '@repo-{r}/{word()}';\n\n" + "".join(f"export function {word()}{i}(input) {{\n  // keep the {word()} before the {word()}\n  return input.{word()};\n}}\n\n" for i in range(6))
            elif kind == "generated":
                text = ("// Code generated by x. DO NOT EDIT.\n" if k % 4 else "") + "".join(f"export const F_{i} = {{\n  id: {i},\n  wire: '{word()}.{i}',\n}};\n" for i in range(12))
            elif kind == "built":
                text = "!function(e,t){" + "".join(f"var {chr(97 + i)}=function(e){{for(var i=0,n=e.length;i<n;i++)e.{word()}(e[i],{i})}};" for i in range(12)) + "}(this);"
            else:
                text = "export const D = [\n" + "".join("  " + ", ".join(f"{rng.uniform(-90, 90):.4f}" for _ in range(8)) + ",\n" for _ in range(12)) + "];\n"
            contents.append((f"{number:064x}", text, len(text)))
            arts.append((number, r, f"src/{word()}/{word()}-{number}.ts", "code"))
            versions.append((number, r, number, 1, f"{number:064X}", None))
            truth[number] = kind != "hand"
    return (
        spark.createDataFrame(versions, VERSION), spark.createDataFrame(arts, "id long, repository_id long, path string, kind string"), spark.createDataFrame(contents, "sha256 string, text string, byte_length long"),
        spark.createDataFrame(repositories, "id long, project_id long, repo_name string, source_path string"), truth,
    )


def test_classifiers_find_unmarked_files(spark):
    versions, arts, contents, repositories, truth = corpus(spark)
    found = {r["version_id"] for r in handwritten.not_handwritten(versions.union(versions.limit(5)), arts, contents, repositories).collect()}
    right = sum((v in found) == t for v, t in truth.items())
    assert right / len(truth) >= 0.97
    assert handwritten.not_handwritten(versions.limit(0), arts.limit(0), contents.limit(0), repositories.limit(0)).count() == 0
    told = {r["measure"]: r["value"] for r in handwritten.held_out_report(versions, arts, contents, repositories).collect()}
    assert told["held_out"] > 0 and told["found_marked"] >= 0.9 * told["marked"] and {f"from_{c}" for c in handwritten.CLASSES} <= set(told)
    assert handwritten.held_out_report(versions.limit(0), arts, contents, repositories).count() == 0


def test_margins_are_chosen_where_scores_are_rare():
    import numpy as np

    assert 0.3 <= handwritten.border(np.array([-0.5, -0.1, 0.0, 0.05, 0.8, 0.9])) <= 0.6
    assert 0.2 <= handwritten.known_border(np.array([-0.4, 0.2, 0.7, 0.9]), np.array([False, False, True, True])) < 0.7


def test_telling_parts_of_paths_are_masked():
    parts = handwritten.parts_of("vendor/x/__generated__/ledger.min.gen.ts", "own", 1)
    assert not any(p.split(":")[1] in handwritten._TELLING for p in parts) and "w:ledger" in parts and "d:x" in parts


@pytest.mark.parametrize("n", [3, 12, 30])
def test_nested_type_lists(n):
    nested = lambda closed: "type Z = " + "".join(f"A{i}<B{i}, " for i in range(n)) + "X" + ">" * closed + " | " + " | ".join("abcdefghij" * 7) + ";"
    assert [dialects(nested(n + d)) for d in (-1, 0, 1)] == [0, TYPES, 0]
    templates = lambda closed: "x = [" + "".join("a, `${b, " for _ in range(n)) + "c" + "}`" * closed + "];" + "y;" * 40
    assert [dialects(templates(n + d)) for d in (-1, 0, 1)] == [0, ALL, 0]
