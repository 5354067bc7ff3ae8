"""Whether statements about a candidate hold against the evidence that they cite.

A statement is read as clauses of marked words. A guard looks for one explicit claim: a verb of its list, what stands
before it and what follows it. What it cannot read so it leaves alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewake.functions import text

#: Names that many files share.
GENERIC_STEMS = ("index", "main", "mod", "types", "utils", "constants", "config", "helpers")
#: Words that negate a clause, and words after a comma that begin a new one.
NEGATIONS = ("not", "no", "never", "none", "without", "neither", "nor")
CONTRASTS = ("but", "while", "whereas")
#: Verbs that claim use, and nouns that may stand between them and the name.
USES = (
    "uses", "use", "using", "used", "calls", "call", "calling", "called", "invokes", "invoke", "invoking", "executes", "execute", "executing", "exercises", "exercise", "exercising",
    "tests", "test", "testing",
)
USED_KINDS = ("function", "method", "class", "symbol", "helper", "api", "constant")
#: Words that count, and what is counted.
COUNTS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "multiple", "several", "many", "numerous", "various")
COUNTED = (("tests",), ("specs",), ("test", "cases"), ("test", "suites"))
#: Words that claim presence, and words by which a clause is about the change.
PRESENCE = (
    "contain", "contains", "containing", "mention", "mentions", "mentioning", "mentioned", "reference", "references", "referencing", "include", "includes", "including",
    "matches", "matched", "matching", "occurrence", "occurrences",
)
CHANGE_WORDS = ("change", "changes", "changed", "description", "commit", "diff", "query")

_PIECE = re.compile(r"\S+")
_LEAD, _TRAIL, _QUOTES = "([{'\"`", ")]}'\"`.,;:!?", "'\"`"
_NAME = re.compile(r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*\Z")


@dataclass(frozen=True)
class Word:
    """A word of a statement without what encloses it."""

    raw: str
    quoted: bool
    after: str

    @property
    def low(self) -> str:
        return self.raw.lower()

    @property
    def plain(self) -> str:
        """The word if nothing encloses or follows it."""
        return self.low if not self.after and not self.quoted else ""


def words_of(statement: str) -> list[Word]:
    found = []
    for m in _PIECE.finditer(statement):
        piece = m.group()
        start, end = 0, len(piece)
        while start < end and piece[start] in _LEAD:
            start += 1
        while end > start and piece[end - 1] in _TRAIL:
            end -= 1
        lead, after = piece[:start], piece[end:]
        quoted = start > 0 and lead[-1] in _QUOTES and after[:1] == lead[-1]
        found.append(Word(piece[start:end], quoted, after))
    return found


def clauses(statement: str) -> list[list[Word]]:
    """Words of each sentence, and of both halves where a contrast follows a comma."""
    found: list[list[Word]] = [[]]
    pending = False
    for word in words_of(statement):
        if pending and word.plain in CONTRASTS:
            found.append([])
        else:
            found[-1].append(word)
        pending = word.after.endswith(",")
        if word.after[-1:] in (".", ";", "!", "?"):
            found.append([])
    return [c for c in found if c]


def is_negated(clause: Iterable[Word]) -> bool:
    return any(w.low in NEGATIONS or w.low.endswith(("n't", "n’t")) for w in clause)


def changed_names(paths: Sequence[str]) -> set[str]:
    """Ways to name a changed file, in lower case: by path, and unless many files share it by base name, stem and stem with .js."""
    names = set()
    for path in paths:
        base = path.rsplit("/", 1)[-1]
        stem = base.rsplit(".", 1)[0] if "." in base else base
        names.add(path.lower())
        if stem.lower() not in GENERIC_STEMS:
            names |= {n.lower() for n in (base, stem, f"{stem}.js") if len(n) >= 3}
    return names


def _mention(clause: Sequence[Word], at: int, names: set[str]) -> bool:
    """Whether a changed file is named from word ``at`` on."""
    if not 0 <= at < len(clause):
        return False
    if clause[at].low in names:
        return True
    return clause[at].plain == "changed" and at + 1 < len(clause) and clause[at + 1].low in ("file", "files", "module", "modules")


def _ends_in_mention(clause: Sequence[Word], before: int, names: set[str]) -> bool:
    """Whether a changed file is named just before word ``before``."""
    return _mention(clause, before - 1, names) or (before >= 2 and clause[before - 1].low in ("file", "files", "module", "modules") and _mention(clause, before - 2, names))


def _skip(clause: Sequence[Word], at: int, words: Sequence[str]) -> int:
    return at + 1 if at < len(clause) and clause[at].plain in words else at


@dataclass
class Imports:
    """What a clause says of imports between candidate and changed file."""

    of_changed: bool = False  # something imports the changed file, by its name
    of_which: bool = False  # something imports what "is changed"
    by_changed: bool = False  # the changed file imports something
    passive: bool = False


def read_imports(clause: Sequence[Word], names: set[str]) -> Imports:
    said = Imports()
    for v, word in enumerate(clause):
        if word.low == "imported" and v + 1 < len(clause) and clause[v + 1].low == "by":
            said.passive = True
            auxiliary = v - 2 if v and clause[v - 1].low == "not" else v - 1
            if auxiliary >= 0 and clause[auxiliary].low in ("is", "are"):
                said.by_changed |= _mention(clause, _skip(clause, v + 2, ("the",)), names)
        if word.low in ("import", "imports"):
            subject = v
            if v and clause[v - 1].low == "doesn't":
                subject = v - 1
            elif v > 1 and (clause[v - 2].low, clause[v - 1].low) == ("does", "not"):
                subject = v - 2
            said.by_changed |= _ends_in_mention(clause, subject, names)
            at = v + 1
            if at < len(clause) and clause[at].plain == "or" and _skip(clause, at + 1, ("use", "uses")) > at + 1:
                at += 2
            at = _skip(clause, at, ("from",))
            said.of_changed |= _mention(clause, _skip(clause, at, ("the",)), names)
            tail = [w.low for w in clause[at + 1 : at + 5]]
            said.of_which |= tail[:1] == ["which"] and tail[1:2] in (["is"], ["was"]) and "changed" in (tail[2:3] if tail[2:3] != ["the"] else tail[3:4])
    return said


def import_direction(statement: str, changed: Sequence[str], candidate_is: Sequence[str]) -> str | None:
    """A clause that says the opposite of what all cited edges record; ``candidate_is`` has ``source`` or ``target`` of each."""
    if not len(candidate_is):
        return None
    names = changed_names(changed)
    source, target = (all(c == end for c in candidate_is) for end in ("source", "target"))
    for clause in clauses(statement):
        said = read_imports(clause, names)
        forward = not said.by_changed and not said.passive and (said.of_changed or said.of_which)
        if is_negated(clause):
            if forward and said.of_changed and source:
                return "import-denied"
        elif (forward and target) or (said.by_changed and source):
            return "import-direction"
    return None


_TOKEN = re.compile(r"[\w$]+|'[^'\n]*'|\"[^\"\n]*\"|\S")


def without_imports(source: str) -> str:
    """The text without import and export-from declarations; what does not have their whole shape stays."""
    tokens = list(_TOKEN.finditer(source))
    words = [m.group() for m in tokens] + [""] * 3
    kept, done, i = [], 0, 0
    while i < len(tokens):
        end = _declaration_end(words, i)
        if end is None:
            i += 1
            continue
        kept.append(source[done : tokens[i].start()])
        done = tokens[end].end()
        i = end + 1
    return " ".join([*kept, source[done:]])


def _declaration_end(words: Sequence[str], i: int) -> int | None:
    """The last token of the declaration that begins at token ``i``."""
    kind, at = words[i], i + 1
    if kind not in ("import", "export"):
        return None
    semicolon = lambda k: k + 1 if words[k + 1] == ";" else k
    if kind == "import" and words[at][:1] in ("'", '"'):
        return semicolon(at)
    if words[at] == "type" and words[at + 1] not in ("from", ",", ""):
        at += 1
    while True:
        if words[at] == "{":
            while words[at] not in ("}", ""):
                at += 1
            at += 1
        elif words[at] == "*":
            at += 3 if words[at + 1] == "as" else 1
        elif kind == "import" and re.match(r"[\w$]", words[at]):
            at += 1
        else:
            return None
        if kind == "import" and at < len(words) and words[at] == ",":
            at += 1
            continue
        if at + 1 < len(words) and words[at] == "from" and words[at + 1][:1] in ("'", '"'):
            return semicolon(at + 1)
        return None


def _holds(source: str, symbol: str) -> bool:
    at = source.find(symbol)
    edge = lambda c: c.isalnum() or c in "_$"
    while at >= 0:
        end = at + len(symbol)
        if not (at and edge(source[at - 1])) and not (end < len(source) and edge(source[end])):
            return True
        at = source.find(symbol, at + 1)
    return False


def symbol_use(statement: str, texts: Sequence[str]) -> str | None:
    """A quoted symbol that a clause says is used, and that no cited text has outside of imports."""
    for clause in clauses(statement):
        if is_negated(clause):
            continue
        for v, word in enumerate(clause):
            if word.plain not in USES:
                continue
            at = _skip(clause, _skip(clause, v + 1, ("the",)), USED_KINDS)
            if at < len(clause) and clause[at].quoted and _NAME.match(clause[at].raw):
                symbol = clause[at].raw
                if not any(_holds(without_imports(t), symbol) for t in texts):
                    return "symbol-only-imported" if any(_holds(t, symbol) for t in texts) else "symbol-not-shown"
    return None


def test_count(statement: str, has_chunk: bool) -> str | None:
    """A number of tests, where no source text is cited."""
    if has_chunk:
        return None
    words = words_of(statement)
    for i, word in enumerate(words):
        if not (word.plain.isdigit() or word.plain in COUNTS):
            continue
        for between in range(3):
            at = i + 1 + between
            if any(tuple(w.low for w in words[at : at + len(c)]) == c and all(not w.after for w in words[at : at + len(c) - 1]) for c in COUNTED):
                return "test-count"
            if at >= len(words) or not re.fullmatch(r"[a-z-]+", words[at].plain):
                break
    return None


def _presence_at(clause: Sequence[Word]) -> int | None:
    for v, word in enumerate(clause):
        following = [w.low for w in clause[v + 1 : v + 3]]
        if word.low in PRESENCE or (word.low == "lexical" and following[:1] == ["evidence"]) or (word.low == "has" and following in (["the", "term"], ["the", "terms"])):
            return v
    return None


def lexical_presence(statement: str, queried: set[str], matched: set[str] | None, path_tokens: set[str], text_tokens: set[str]) -> str | None:
    """A quoted query term that a clause says is there though no evidence records it, or is absent though a cited match has it in the content.

    ``matched`` is null where no lexical evidence is cited.
    """
    for clause in clauses(statement):
        v = _presence_at(clause)
        if v is None or any(w.low in CHANGE_WORDS for w in clause[:v]):
            continue
        negated = is_negated(clause)
        for word in clause[v:]:
            term = word.low
            if not word.quoted or len(term) > 80 or not re.fullmatch(r"\w+", term) or term not in queried:
                continue
            if negated and matched is not None and term in matched and term not in path_tokens:
                return "term-matched"
            if not negated and term not in (matched or ()) and term not in text_tokens and term not in path_tokens:
                return "term-not-recorded"
    return None


@dataclass
class Cited:
    """What a statement cites: ends of edges, texts of chunks and of declarations, matched terms (null without a lexical citation)."""

    candidate_is: Sequence[str] = field(default_factory=list)
    chunks: Sequence[str] = field(default_factory=list)
    declarations: Sequence[str] = field(default_factory=list)
    matched: Sequence[str] | None = None


def statement_problem(statement: str, changed: Sequence[str], cited: Cited, queried: Sequence[str], path_tokens: Sequence[str], text_tokens: Sequence[str]) -> str | None:
    """The first guard that a statement fails: import direction, use of symbols, number of tests, presence of terms."""
    return (
        import_direction(statement, changed, cited.candidate_is) or symbol_use(statement, [*cited.chunks, *cited.declarations]) or test_count(statement, len(cited.chunks) > 0)
        or lexical_presence(statement, set(queried), None if cited.matched is None else set(cited.matched), set(path_tokens), set(text_tokens))
    )


def grounding_problems(rows: DataFrame) -> DataFrame:
    """Rows whose statement fails a guard, with the ``problem``.

    Rows have ``statement, description, changed_paths, candidate_path, candidate_is, chunk_texts, declaration_texts, matched_terms``;
    all from ``candidate_is`` on are arrays, ``matched_terms`` null where no lexical evidence is cited. Other nulls count as empty.
    """
    plain = lambda c: F.coalesce(F.array_compact(c), F.array().cast("array<string>"))
    texts = F.concat(plain("chunk_texts"), plain("declaration_texts"))
    tokens: dict[str, Column] = {
        "__queried": text.query_terms(text.lexical_query_text(F.coalesce("description", F.lit("")), plain("changed_paths"))), "__path": text.tokenize(F.col("candidate_path")),
        "__text": text.tokenize(F.array_join(texts, "\n")),
    }

    @F.pandas_udf(T.StringType())
    def check(s: pd.Series, p: pd.Series, e: pd.Series, c: pd.Series, d: pd.Series, m: pd.Series, q: pd.Series, a: pd.Series, t: pd.Series) -> pd.Series:
        out = [statement_problem(r[0] or "", list(r[1]), Cited(r[2], r[3], r[4], r[5]), r[6], r[7], r[8]) for r in zip(s, p, e, c, d, m, q, a, t)]
        return pd.Series(out, dtype=object)

    lists = [plain(c) for c in ("changed_paths", "candidate_is", "chunk_texts", "declaration_texts")]
    read = rows.withColumns(tokens)
    found = read.withColumn("problem", check("statement", *lists, "matched_terms", *tokens))
    return found.drop(*tokens).filter("problem IS NOT NULL")
