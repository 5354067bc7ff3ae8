"""Recognises plain JavaScript and TypeScript, each with and without JSX, and strict JSON."""

from __future__ import annotations

import json
import re

from tracewake.llm.gll import BREAK, END, Grammar

JS, JSX, TS, TSX = 1, 2, 4, 8
DIALECTS = {"js": JS, "jsx": JSX, "ts": TS, "tsx": TSX, "t": TS | TSX, "x": JSX | TSX}

_RESERVED = (
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with"
).split()
_CONTEXTUAL = (
    "abstract accessor any as asserts assert async await declare from get global implements infer interface is keyof let module namespace of out override private protected public readonly satisfies set static type unique yield target"
).split()
_PUNCTUATION = "{ } ( ) [ ] ; , < > . ... ?. ? : = => + - * / % ** & | ^ ! ~ && || ?? ++ -- @ <= == != === !== << op=".split()
_OTHER = ["id", "private", "number", "string", "regex", "template", "t-head", "t-middle", "t-tail", "block", "jsx<", "jsx</", "jsx-text"]
_NAMES = _RESERVED + _CONTEXTUAL + _PUNCTUATION + _OTHER
KIND = {name: chr(0x100 + i) for i, name in enumerate(_NAMES)}
WORDS = {w: KIND[w] for w in _RESERVED + _CONTEXTUAL}
_ID, _BLOCK = KIND["id"], KIND["block"]

_quoted = lambda names: " | ".join(f"'{n}'" for n in names)
GRAMMAR = f"""
Module = Item* ;
Inner = Statement* ;
Item = Statement | Import | Decorator* Export ;
Id = 'id' | {_quoted(_CONTEXTUAL)} ;
Name = Id | {_quoted(_RESERVED)} ;
Semi = ';' | @semi ;
From = 'from' 'string' (('with' | 'assert') ObjectLiteral)? Semi ;
Import = 'import' ('string' (('with' | 'assert') ObjectLiteral)? Semi | ImportClause From | [t]('type' ImportClause From) | [t]('type'? Id '=' Expression Semi)) ;
ImportClause = Id (',' (NameSpace | Imports))? | NameSpace | Imports ;
NameSpace = '*' 'as' Id ;
Imports = '{{' (ImportName (',' ImportName)* ','?)? '}}' ;
ImportName = [t]'type'? (Id | (Name | 'string') 'as' Id) ;
Export = 'export' (
    '*' ('as' (Name | 'string'))? From
  | Exports (Semi | From)
  | [t]('type' (Exports (Semi | From) | '*' ('as' Name)? From))
  | 'default' (Function | Class | [t]Interface | @not('function', 'class', '@') Assignment Semi)
  | Declaration
  | [t]('=' Expression Semi) | [t]('as' 'namespace' Id Semi) | [t]('import' 'type'? Id '=' Expression Semi) ) ;
Exports = '{{' (ExportName (',' ExportName)* ','?)? '}}' ;
ExportName = [t]'type'? (Name | 'string') ('as' (Name | 'string'))? ;
Declaration = Variables Semi | Function | Class | [t]Interface | [t]Alias | [t]Enum | [t]Namespace | [t]('declare' @same (Declaration | 'global' Body | Namespace)) ;
Variables = ('var' | 'let') Binding (',' Binding)* | 'const' Constant (',' Constant)* ;
Binding = Pattern [t]('!'? ':' Type)? ('=' Assignment)? ;
Constant = Pattern [t](':' Type)? '=' Assignment | [t](Pattern ':' Type) ;
Pattern = Id | ObjectPattern | ArrayPattern ;
ObjectPattern = '{{' (PatternPart (',' PatternPart)* ','?)? '}}' ;
PatternPart = '...' Pattern | PropertyName ':' Element | Id ('=' Assignment)? ;
ArrayPattern = '[' (Element | '...' Pattern)? (',' (Element | '...' Pattern)?)* ']' ;
Element = Pattern ('=' Assignment)? ;
Function = ('async' @same)? 'function' '*'? Id? TypeParameters? Parameters ReturnType? (Block | [t]Semi) ;
Block = '{{' Statement* '}}' | 'block' ;
Body = '{{' Item* '}}' | 'block' ;
Parameters = '(' (Parameter (',' Parameter)* ','?)? ')' ;
Parameter = Decorator* [t]Modifier* '...'? (Pattern | [t]'this') [t]'?'? [t](':' Type)? ('=' Assignment)? ;
Modifier = 'public' | 'private' | 'protected' | 'readonly' | 'override' ;
ReturnType = [t](':' Type) ;
TypeParameters = [t]('<' TypeParameter (',' TypeParameter)* ','? '>') ;
TypeParameter = ('const' | 'in' | 'out')* Id ('extends' Type)? ('=' Type)? ;
TypeArguments = [t]('<' Type (',' Type)* '>') ;
Decorator = '@' ('(' Expression ')' | Id ('.' Name)* TypeArguments? Arguments?) ;
Class = Decorator* [t]'abstract'? 'class' ClassRest ;
ClassRest = Id? TypeParameters? ('extends' LeftSide TypeArguments?)? [t]('implements' Type (',' Type)*)? '{{' Member* '}}' ;
Member = ';' | 'static' Block | Decorator* MemberModifier* ('*'? PropertyName [t]('?' | '!')? (Method | [t](':' Type)? ('=' Assignment)? Semi) | [t](IndexSignature Semi)) ;
MemberModifier = 'static' | 'async' @same | 'get' | 'set' | 'accessor' | [t]('public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'override' | 'declare') ;
Method = TypeParameters? Parameters ReturnType? (Block | [t]Semi) ;
PropertyName = Name | 'string' | 'number' | 'private' | '[' Assignment ']' ;
Statement = Block | Variables Semi | ';' | If | For | While | Do | Jump | Return | Throw | Try | Switch | Id ':' Statement | 'debugger' Semi | Function | Class
  | [t]Interface | [t]Alias | [t]Enum | [t]Namespace | [t]('declare' @same (Declaration | 'global' Body | Namespace)) | 'with' '(' Expression ')' Statement
  | @not('{{', 'function', 'class', 'block', '@') Expression Semi ;
If = 'if' '(' Expression ')' Statement ('else' Statement)? ;
For = 'for' 'await'? '(' ((Variables | Expression)? ';' Expression? ';' Expression? | (('var' | 'let' | 'const') Pattern | LeftSide) ('of' Assignment | 'in' Expression)) ')' Statement ;
While = 'while' '(' Expression ')' Statement ;
Do = 'do' Statement 'while' '(' Expression ')' ';'? ;
Jump = ('break' | 'continue') (@same Id)? Semi ;
Return = 'return' (@same Expression)? Semi ;
Throw = 'throw' @same Expression Semi ;
Try = 'try' Block ('catch' ('(' Pattern [t](':' Type)? ')')? Block ('finally' Block)? | 'finally' Block) ;
Switch = 'switch' '(' Expression ')' '{{' (('case' Expression | 'default') ':' Statement*)* '}}' ;
Interface = 'interface' @same Id TypeParameters? ('extends' Type (',' Type)*)? ObjectType ;
Alias = 'type' @same Id TypeParameters? '=' Type Semi ;
Enum = 'const'? 'enum' Id '{{' (EnumMember (',' EnumMember)* ','?)? '}}' ;
EnumMember = PropertyName ('=' Assignment)? ;
Namespace = ('namespace' | 'module') @same (Id ('.' Name)* Body | 'string' (Body | Semi)) ;
Expression = Assignment (',' Assignment)* ;
Assignment = Arrow | 'yield' (@same '*'? Assignment)? | LeftSide ('=' | 'op=' | '>' '=' ) Assignment | LeftSide '>' '>' ('>' '=' | '=') Assignment | Conditional ;
Conditional = Binary ('?' Assignment ':' Assignment)? ;
Binary = Unary (Operator Unary | [t](@same ('as' | 'satisfies') Type))* ;
Operator = '+' | '-' | '*' | '/' | '%' | '**' | '&' | '|' | '^' | '&&' | '||' | '??' | '<=' | '==' | '!=' | '===' | '!==' | '<<' | '<' | '>' | '>' '=' | '>' '>' | '>' '>' '>' | 'instanceof' | 'in' ;
Unary = ('!' | '~' | '+' | '-' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await' | [ts]('<' Type '>'))* Postfix | 'private' ;
Postfix = LeftSide (@same ('++' | '--'))? ;
LeftSide = Primary Suffix* ;
Suffix = '.' (Name | 'private') | '?.' (Name | 'private' | TypeArguments? Arguments | '[' Expression ']' | Template) | '[' Expression ']' | Arguments | Template
  | [t](@same '!') | TypeArguments (Arguments | Template) ;
Arguments = '(' ('...'? Assignment (',' '...'? Assignment)* ','?)? ')' ;
Primary = Id | 'this' | 'null' | 'true' | 'false' | 'number' | 'string' | 'regex' | 'super' | Template | ArrayLiteral | ObjectLiteral | FunctionExpression | Decorator* 'class' ClassRest
  | '(' Expression ')' | 'new' ('.' 'target' | LeftSide TypeArguments?) | 'import' ('.' Name | Arguments) | [x]Element_ ;
FunctionExpression = ('async' @same)? 'function' '*'? Id? TypeParameters? Parameters ReturnType? Block ;
Arrow = ('async' @same)? (Id | TypeParameters? Parameters ReturnType?) @same '=>' (Block | @not('{{', 'block') Assignment) ;
Template = 'template' | 't-head' Expression ('t-middle' Expression)* 't-tail' ;
ArrayLiteral = '[' ('...'? Assignment)? (',' ('...'? Assignment)?)* ']' ;
ObjectLiteral = '{{' (Property (',' Property)* ','?)? '}}' ;
Property = '...' Assignment | Id ('=' Assignment)? | PropertyName ':' Assignment | ('async' @same | 'get' | 'set')? '*'? PropertyName TypeParameters? Parameters ReturnType? Block ;
Element_ = 'jsx<' ('id' Attribute*)? ('/' '>' | '>' Child* 'jsx</' 'id'? '>') ;
Attribute = 'id' ('=' ('string' | '{{' Assignment '}}' | Element_))? | '{{' '...' Assignment '}}' ;
Child = 'jsx-text' | '{{' ('...'? Expression)? '}}' | Element_ ;
Type = FunctionType | UnionType ('extends' Type '?' Type ':' Type)? | 'asserts' (Id | 'this') ('is' Type)? | (Id | 'this') 'is' Type ;
FunctionType = ('abstract'? 'new')? TypeParameters? Parameters '=>' Type ;
UnionType = ('|' | '&')? UnaryType (('|' | '&') UnaryType)* ;
UnaryType = ('keyof' | 'unique' | 'readonly')* ('infer' Id ('extends' Type)? | PrimaryType (@same '[' Type? ']')*) ;
PrimaryType = Id ('.' Name)* (@same TypeArguments)? | 'void' | 'null' | 'true' | 'false' | 'this' | 'const' | 'string' | '-'? 'number' | 'typeof' (Id | 'this') ('.' Name)* TypeArguments? | ObjectType
  | '[' (TupleItem (',' TupleItem)* ','?)? ']' | '(' Type ')' | 'template' | 't-head' Type ('t-middle' Type)* 't-tail' | 'typeof'? 'import' '(' Type (',' ObjectLiteral)? ')' ('.' Name)* TypeArguments? ;
TupleItem = '...'? (Name '?'? ':')? Type '?'? ;
ObjectType = '{{' (TypeMember (';' | ',' | @nl))* TypeMember? '}}' ;
TypeMember = ('readonly' | 'get' | 'set')* PropertyName '?'? (':' Type | TypeParameters? Parameters ReturnType?)? | 'new'? TypeParameters? Parameters ReturnType? | IndexSignature
  | (('+' | '-')? 'readonly')? '[' Id 'in' Type ('as' Type)? ']' (('+' | '-')? '?')? (':' Type)? ;
IndexSignature = ('readonly' | 'static')* '[' Id ':' Type ']' ':' Type ;
"""
ECMA = Grammar(GRAMMAR, KIND, DIALECTS, "Module")
ECMA.closers = frozenset({KIND["}"], END})

_BLANK = r"[ \t\f\v\r\n ﻿    -   　]*+"
#: What is blank or a comment stays so, whatever follows.
_SPACE = rf"{_BLANK}(?:(?://[^\n\r  ]*+|/\*[\s\S]*?\*/){_BLANK})*+"
_TOKEN = re.compile(
    rf"({_SPACE})(?:"
    r"(?P<w>[^\W\d]\w*+(?![\w$\\‌‍]))"
    r"|(?P<p>[{}()\[\];,:~@]|\.\.\.|=>|===|!==|[!=]=|\?\.(?!\d)|\*\*=|&&=|\|\|=|\?\?=|<<=|[-+*%&|^]=|\+\+|--|&&|\|\||\?\?|\*\*|<<|<=|\.(?!\d)|[<>?=+\-*%&|^!])"
    r"|(?P<s>'[^'\\\n\r]*+(?:\\(?:\r\n|[\s\S])[^'\\\n\r]*+)*+'|\"[^\"\\\n\r]*+(?:\\(?:\r\n|[\s\S])[^\"\\\n\r]*+)*+\")"
    r"|(?P<n>(?:0[xX][0-9a-fA-F_]+|0[oO][0-7_]+|0[bB][01_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)n?(?![\w$]))"
    r"|(?P<d>/)"
    r"|(?P<q>`)"
    r"|(?P<i>\#?(?:[^\W\d]|\$|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\w$‌‍]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*)"
    r"|(?P<e>\Z))"
)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*")
_QUASI = re.compile(r"[^`\\$]*+(?:(?:\\[\s\S]|\$(?!\{))[^`\\$]*+)*+(`|\$\{)")
_JSX_NAME = re.compile(r"\s*([\w$.:-]*)")
_JSX_TAG = re.compile(_SPACE + r"""(?:(?P<n>[\w$][\w$:.-]*)|(?P<s>"[^"]*"|'[^']*')|(?P<p>[={>/<]))""")
_JSX_TEXT = re.compile(r"[^<{>}]*")
_GENERIC = re.compile(r"<\s*(?:const\s+)?[\w$]+\s*(?:,|extends\b[^/>]*>\s*\()")
_OPERAND_END = frozenset(KIND[k] for k in ("id", "private", "number", "string", "regex", "template", "t-tail", ")", "]", "}", "this", "super", "null", "true", "false", "++", "--", *_CONTEXTUAL))
_CONDITION = frozenset(KIND[k] for k in ("if", "while", "for", "with"))
_BEFORE_BLOCK = frozenset(KIND[k] for k in ("=>", "try", "else", "finally", "do"))
_BREAK_MATTERS = _OPERAND_END | frozenset(KIND[k] for k in ("return", "break", "continue", "throw", "void", "block", "debugger", "const", "typeof"))
_GOES_ON = frozenset(KIND[k] for k in ("else", "catch", "finally", "while", "instanceof", "in", "of", "as", "satisfies"))
_STARTS = frozenset(WORDS.values()) - _GOES_ON | {_ID, KIND["private"]}
_OPEN_BEFORE_STATEMENT = frozenset(KIND[k] for k in ("id", "string", ";", "{", "}", "block", *_CONTEXTUAL)) | {""}
#: Begins a sequence that stands in a block, where neither imports nor exports may be.
INNER = "\x01"


class Invalid(Exception):
    """Text that no dialect can hold."""


def segments(text: str, jsx: bool, fold: bool = True) -> tuple[set[str], bool]:
    """Statement sequences of a text as strings of token kinds, and whether ``<`` stood where an operand begins.

    With ``fold``, bodies in braces that can only be blocks are taken out and stand as one token, and sequences are cut where a
    statement surely ends; the text is valid if all are, those that begin with INNER as the statements of a block. Without, there
    is a single sequence. A BREAK before a token says that a line break precedes it where that can matter.
    """
    done: set[str] = set()
    current: list[str] = []
    frames: list[tuple[list[str], int]] = []
    stack: list = []  # of closers; for an element of JSX, its name and whether its tag is still open
    depth = 0
    previous = ""
    after_condition = False
    angle = False
    at = 0
    if text.startswith("#!"):
        at = len(text.split("\n", 1)[0])
    size = len(text)
    match = _TOKEN.match
    words, kinds = WORDS, KIND
    class_seen = was_switch = False

    while True:
        if stack and stack[-1][0] == "jsx":
            name, open_ = stack[-1][1:]
            if open_:
                m = _JSX_TAG.match(text, at)
                if not m:
                    raise Invalid
                at = m.end()
                if m.lastgroup == "n":
                    current.append(_ID)
                elif m.lastgroup == "s":
                    current.append(kinds["string"])
                else:
                    c = m.group("p")
                    if c == "/":
                        m = re.compile(r"\s*>").match(text, at)
                        if not m:
                            raise Invalid
                        at = m.end()
                        current += [kinds["/"], kinds[">"]]
                        stack.pop()
                        previous = kinds[")"]
                        after_condition = False
                    elif c == ">":
                        current.append(kinds[">"])
                        stack[-1] = ("jsx", name, False)
                    elif c == "{":
                        current.append(kinds["{"])
                        stack.append(("}", False, False, False))
                        depth += 1
                        previous = kinds["("]
                    elif c == "=":
                        current.append(kinds["="])
                    else:
                        m = _JSX_NAME.match(text, at)
                        current.append(kinds["jsx<"])
                        if m[1]:
                            current.append(_ID)
                        stack.append(("jsx", m[1], True))
                        at = m.end()
                continue
            m = _JSX_TEXT.match(text, at)
            if m.end() > at:
                current.append(kinds["jsx-text"])
            at = m.end()
            c = text[at : at + 1]
            if c == "{":
                at += 1
                current.append(kinds["{"])
                stack.append(("}", False, False, False))
                depth += 1
                previous = kinds["("]
            elif text.startswith("</", at):
                m = re.compile(r"</\s*([\w$.:-]*)\s*>").match(text, at)
                if not m or m[1] != name:
                    raise Invalid
                current += [kinds["jsx</"], *([_ID] if name else []), kinds[">"]]
                at = m.end()
                stack.pop()
                previous = kinds[")"]
                after_condition = False
            elif c == "<":
                m = _JSX_NAME.match(text, at + 1)
                current.append(kinds["jsx<"])
                if m[1]:
                    current.append(_ID)
                stack.append(("jsx", m[1], True))
                at = m.end()
            else:
                raise Invalid
            continue

        m = match(text, at)
        if m is None:
            raise Invalid
        group = m.lastindex
        at = m.end()
        broke = False
        if previous in _BREAK_MATTERS:
            space = m[1]
            broke = bool(space) and space != " " and ("\n" in space or "\r" in space or "\u2028" in space or "\u2029" in space)
        if group == _WORD:
            kind = _ID if previous in _DOTS else words.get(m[group], _ID)
            if kind == _CLASS:
                class_seen = True
            after_condition = False
        elif group == _MARK:
            c = m[group]
            kind = kinds.get(c) or _ASSIGN
            if c not in _TELLING:
                after_condition = False
            elif c == "}" and stack and stack[-1][0] == "`":
                stack.pop()
                depth -= 1
                q = _QUASI.match(text, at)
                if not q:
                    raise Invalid
                at = q.end()
                if q[1] == "`":
                    kind = kinds["t-tail"]
                else:
                    kind = kinds["t-middle"]
                    stack.append(("`", False, False, False))
                    depth += 1
                broke = after_condition = False
            elif c in "{([":
                block = False
                if c == "{" and fold:
                    block = previous in _BEFORE_BLOCK or (previous == _ROUND_END and not was_switch and not class_seen)
                stack.append((_CLOSER[c], previous in _CONDITION if c == "(" else previous in _OPEN_BEFORE_STATEMENT, block, previous == _SWITCH))
                if block:
                    frames.append((current, depth))
                    current, depth = [], 0
                    previous, after_condition, class_seen = "", False, False
                    continue
                depth += 1
                after_condition = False
                if c == "{":
                    class_seen = False
            elif c in "})]":
                if not stack or stack[-1][0] != c:
                    raise Invalid
                closes = stack.pop()
                if closes[2]:
                    if current:
                        done.add(INNER + "".join(current))
                    current, depth = frames.pop()
                    current.append(_BLOCK)
                    previous, after_condition, class_seen = _BLOCK, True, False
                    continue
                depth -= 1
                after_condition = closes[1] and c != "]"
                was_switch = closes[3]
            elif c == "<":
                operand = previous in _OPERAND_END and not after_condition
                if not operand:
                    angle = True
                    if jsx and not _GENERIC.match(text, at - 1) and re.compile(r"\s*[A-Za-z_$>]").match(text, at):
                        name = _JSX_NAME.match(text, at)
                        if broke:
                            current.append(BREAK)
                        current.append(kinds["jsx<"])
                        if name[1]:
                            current.append(_ID)
                        stack.append(("jsx", name[1], True))
                        at = name.end()
                        continue
                after_condition = False
            else:
                class_seen = after_condition = False
        elif group == _STRING:
            kind = kinds["string"]
            after_condition = False
        elif group == _NUMBER:
            kind = kinds["number"]
            after_condition = False
        elif group == _SLASH:
            if previous in _OPERAND_END and not after_condition:
                kind = kinds["/"]
                if text.startswith("=", at):
                    at += 1
                    kind = _ASSIGN
            else:
                r = _REGEX.match(text, at - 1)
                if not r:
                    raise Invalid
                at = r.end()
                kind = kinds["regex"]
            after_condition = False
        elif group == _QUOTE:
            q = _QUASI.match(text, at)
            if not q:
                raise Invalid
            at = q.end()
            kind = kinds["template"]
            if q[1] == "${":
                kind = _HEAD
                stack.append(("`", False, False, False))
                depth += 1
            after_condition = False
        elif group == _NAME:
            kind = kinds["private"] if m[group][0] == "#" else _ID
            after_condition = False
        else:
            if at < size or stack or frames:
                raise Invalid
            if current:
                done.add("".join(current))
            return done, angle

        if fold and (previous == _SEMI or previous == _BLOCK) and depth == (kind in _OPENERS) and current and kind in _ANY_START:
            if (previous == _SEMI and kind not in _GOES_ON) or (previous == _BLOCK and broke and kind in _STARTS):
                if not (current[0] == _DO and kind == _WHILE):
                    done.add((INNER if frames else "") + "".join(current))
                    current = []
        if broke and current:
            current.append(BREAK)
        current.append(kind)
        previous = kind


_WORD, _MARK, _STRING, _NUMBER, _SLASH, _QUOTE, _NAME = (_TOKEN.groupindex[g] for g in "wpsndqi")
_SEMI, _DO, _WHILE, _CLASS, _SWITCH, _ASSIGN, _HEAD, _ROUND_END = (KIND[k] for k in (";", "do", "while", "class", "switch", "op=", "t-head", ")"))
_OPENERS = frozenset(KIND[k] for k in ("{", "(", "[", "t-head"))
_DOTS = frozenset(KIND[k] for k in (".", "?."))
_CLOSER = {"{": "}", "(": ")", "[": "]"}
#: Marks that more depends on than their own kind.
_TELLING = frozenset("{([])}<;")
_ANY_START = frozenset(KIND.values()) - frozenset(KIND[k] for k in ("}", ")", "]", "block"))

#: Dialects of the sequences met so far, by kinds; the result of a sequence depends on nothing else.
_MEMO: dict[tuple[str, int], int] = {}
#: Kinds in all remembered sequences of a worker, beyond which it forgets them.
_MOST_MEMO = 24 << 20
_remembered = 0


_COMMA, _ROUND = KIND[","], {KIND["("]: KIND[")"], KIND["["]: KIND["]"], KIND["{"]: KIND["}"]}
_CLOSERS = frozenset(_ROUND.values())
#: What may be an operator or a bracket; which of them close each other only the grammar knows.
_PERHAPS_BRACKETS = frozenset(KIND[k] for k in ("<", ">", "<<", "jsx<", "jsx</", "t-head", "t-middle", "t-tail"))
_SYMBOL = re.compile(f"{BREAK}?[^{BREAK}]")
_REPEATS = re.compile(f"({_COMMA}.{{1,60}}?)\\1{{2,}}", re.S)


def _closed(item: str) -> bool:
    waiting: list[str] = []
    for c in item:
        if c in _ROUND:
            waiting.append(_ROUND[c])
        elif c in _CLOSERS and (not waiting or waiting.pop() != c):
            return False
    return not waiting


def _twice(m: re.Match) -> str:
    """Two of what is repeated, if it is a run of list items: a comma and what follows, with its brackets closed.

    A run found from the middle of an item, ``b]`` ``,[a`` repeated, holds the turned item ``,[ab]`` once less, so three of it are kept.
    What holds type brackets, mark-up or parts of templates stays whole.
    """
    unit = m[1]
    if not _PERHAPS_BRACKETS.isdisjoint(unit):
        return m[0]
    if _closed(unit):
        return unit * 2
    turned = any(c == _COMMA and _closed(unit[j:] + unit[:j]) for j, c in enumerate(unit))
    return unit * 3 if turned else m[0]


def shortened(sequence: str) -> str:
    """The sequence with runs of alike list items cut to two.

    Every list of the grammar is a loop over comma and item, so a run of three or more leads where two lead; bulk data
    thus costs as little as its first rows.
    """
    return _REPEATS.sub(_twice, sequence)


def _accepts(sequence: str, mask: int) -> int:
    global _remembered
    if sequence.count(_COMMA) > 2:
        sequence = shortened(sequence)
    key = (sequence, mask)
    found = _MEMO.get(key)
    if found is None:
        found = recognised(sequence, mask)
        if _remembered > _MOST_MEMO:
            _MEMO.clear()
            _remembered = 0
        _MEMO[key] = found
        _remembered += len(sequence) + 100
    return found


def recognised(sequence: str, mask: int) -> int:
    """The dialects of ``mask`` in which a sequence of kinds is valid."""
    inner = sequence.startswith(INNER)
    return ECMA.run(_SYMBOL.findall(sequence, inner), mask, "Inner" if inner else None)


def _dialects(text: str, jsx: bool, mask: int) -> tuple[int, bool]:
    angle = True
    for fold in (True, False):
        try:
            sequences, angle = segments(text, jsx, fold)
        except Invalid:
            # What can't be a token or a bracket out of place is so however statements are cut.
            return 0, True
        left = mask
        for s in sequences:
            left &= _accepts(s, mask)
            if not left:
                break
        if left:
            return left, angle
    return 0, angle


def dialects(text: str) -> int:
    """The dialects (JS, JSX, TS, TSX) in which a text is valid; all for an empty one."""
    found, angle = _dialects(text, False, JS | TS if "<" in text else JS | JSX | TS | TSX)
    if "<" in text:
        if angle:
            return found | _dialects(text, True, JSX | TSX)[0]
        return found | found << 1
    return found


def _no_constant(name: str):
    raise ValueError(name)


_JSON = json.JSONDecoder(parse_constant=_no_constant, parse_int=len, parse_float=len)


_JSON_TOKEN = re.compile(r"""[ \t\n\r]*(?:(?P<mark>[{}\[\]:,])|(?P<text>"(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*")|(?P<other>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)|(?P<end>\Z))""")


def _deep_json(text: str) -> bool:
    """The same for values nested however deep, with a stack of its own."""
    stack, at, wanted = [], 0, "value"
    while True:
        m = _JSON_TOKEN.match(text, at)
        if m is None:
            return False
        at, token = m.end(), m["mark"] or m.lastgroup
        if token == "end":
            return wanted == "after" and not stack
        if token in ("text", "other") and wanted in ("value", "item"):
            wanted = "after"
        elif token == "text" and wanted in ("key", "first"):
            wanted = ":"
        elif token == ":" and wanted == ":":
            wanted = "value"
        elif token in "{[" and wanted in ("value", "item"):
            stack.append(token)
            wanted = "first" if token == "{" else "item"
        elif token == "," and wanted == "after" and stack:
            wanted = "key" if stack[-1] == "{" else "value"
        elif (token == "}" and wanted in ("after", "first") or token == "]" and wanted in ("after", "item")) and stack and stack[-1] + token in ("{}", "[]"):
            stack.pop()
            wanted = "after"
        else:
            return False


def is_json(text: str) -> bool:
    """Whether a text is one strict JSON value."""
    try:
        _JSON.decode(text)
    except RecursionError:
        return _deep_json(text)
    except ValueError:
        return False
    return True
