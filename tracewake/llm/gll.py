"""A generalised LL recogniser with a graph-structured stack, for several dialects of one grammar at once."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

END = "\x03"
#: Before a token: a line break.
BREAK = "\n"


class Grammar:
    """Rules compiled to recursive transition networks, which become deterministic as texts are met.

    The text holds rules ``Name = expression ;`` with alternatives ``|``, groups ``( )``, ``? * +``, terminals in quotes, names, and
    guards ``[dialects]`` that limit the rest of an alternative's next item to some dialects. Zero-width items:
    ``@nl`` (a line break before the next token), ``@same`` (none), ``@semi`` (a statement may end here without a semicolon),
    ``@not('a','b')`` (the next token is none of these).

    A place is a state of a network and the states to return to from the rules that are taken up into it: all but enough rules to
    leave no recursion. A set of places, each with its dialects, is one state of the recogniser. What follows from it before a token
    is found out once and kept, so alternatives that begin alike, and rules that only hand on to others, cost nothing.
    """

    def __init__(self, text: str, terminals: dict[str, str], dialects: dict[str, int], start: str):
        self.terminals, self.dialects = terminals, dialects
        self.all = max(dialects.values())
        for m in dialects.values():
            self.all |= m
        self.moves: list[dict[str, list[tuple[int, int]]]] = []
        self.calls: list[list[tuple[int, str, int]]] = []
        self.jumps: list[list[tuple[int, int, tuple]]] = []
        self.final: list[int] = []
        self.starts: dict[str, int] = {}
        self.tokens = re.findall(r"'[^']*'|@\w+|\[[\w,]+\]|\w+|[=;|()?*+,]", text)
        self.at = 0
        while self.at < len(self.tokens):
            name = self._take()
            self._take("=")
            first, last = self._alternatives()
            self._take(";")
            self.final[last] = self.all
            self.starts[name] = first
        self.start = start
        self._close()

    def _take(self, wanted: str | None = None) -> str:
        t = self.tokens[self.at]
        if wanted and t != wanted:
            raise SyntaxError(f"{wanted} expected near {' '.join(self.tokens[self.at - 6 : self.at + 3])}")
        self.at += 1
        return t

    def _state(self) -> int:
        self.moves.append({})
        self.calls.append([])
        self.jumps.append([])
        self.final.append(0)
        return len(self.final) - 1

    def _alternatives(self) -> tuple[int, int]:
        first, last = self._state(), self._state()
        while True:
            a, b = self._sequence()
            self.jumps[first].append((self.all, a, ()))
            self.jumps[b].append((self.all, last, ()))
            if self.tokens[self.at] != "|":
                return first, last
            self._take()

    def _sequence(self) -> tuple[int, int]:
        first = at = self._state()
        while self.tokens[self.at] not in ("|", ")", ";"):
            mask = self.all
            while self.tokens[self.at].startswith("["):
                mask &= sum(self.dialects[d] for d in self._take()[1:-1].split(","))
            a, b = self._item()
            entry, leave = self._state(), self._state()
            self.jumps[at].append((self.all, entry, ()))
            self.jumps[entry].append((mask, a, ()))
            self.jumps[b].append((self.all, leave, ()))
            mark = self.tokens[self.at]
            if mark in ("?", "*"):
                self.jumps[entry].append((self.all, leave, ()))
            if mark in ("*", "+"):
                self.jumps[leave].append((self.all, entry, ()))
            if mark in ("?", "*", "+"):
                self._take()
            out = self._state()
            self.jumps[leave].append((self.all, out, ()))
            at = out
        return first, at

    def _item(self) -> tuple[int, int]:
        t = self._take()
        if t == "(":
            pair = self._alternatives()
            self._take(")")
            return pair
        a, b = self._state(), self._state()
        if t.startswith("'"):
            self.moves[a].setdefault(self.terminals[t[1:-1]], []).append((self.all, b))
        elif t == "@not":
            self._take("(")
            words = []
            while (w := self._take()) != ")":
                words += [self.terminals[w[1:-1]]] if w != "," else []
            self.jumps[a].append((self.all, b, ("not", frozenset(words))))
        elif t.startswith("@"):
            self.jumps[a].append((self.all, b, (t[1:],)))
        else:
            self.calls[a].append((self.all, t, b))
        return a, b

    def _close(self) -> None:
        """Folds plain jumps into the states that make them, so that only conditional ones are left, and finds what may begin each rule."""
        n = len(self.final)
        moves, calls, jumps, final = [], [], [], []
        for s in range(n):
            reach, todo = {}, [(s, self.all)]
            while todo:
                q, m = todo.pop()
                new = m & ~reach.get(q, 0)
                if new:
                    reach[q] = reach.get(q, 0) | new
                    todo += [(t, new & g) for g, t, c in self.jumps[q] if not c]
            mv: dict = {}
            cl, jp, fin = [], [], 0
            for q, m in reach.items():
                fin |= self.final[q] & m
                for k, ts in self.moves[q].items():
                    mv.setdefault(k, []).extend((g & m, t) for g, t in ts)
                cl += [(g & m, name, t) for g, name, t in self.calls[q]]
                jp += [(g & m, t, c) for g, t, c in self.jumps[q] if c]
            moves.append(mv), calls.append(cl), jumps.append(jp), final.append(fin)
        self.moves, self.calls, self.jumps, self.final = moves, calls, jumps, final
        first: dict[str, set] = {r: set() for r in self.starts}
        empty: dict[str, bool] = dict.fromkeys(self.starts, False)
        changed = True
        while changed:
            changed = False
            for r, s in self.starts.items():
                found, can_end = set(), False
                seen, todo = set(), [s]
                while todo:
                    q = todo.pop()
                    if q in seen:
                        continue
                    seen.add(q)
                    can_end |= bool(self.final[q])
                    found |= self.moves[q].keys()
                    todo += [t for _, t, _ in self.jumps[q]]
                    for _, name, t in self.calls[q]:
                        found |= first[name]
                        if empty[name]:
                            todo.append(t)
                if not found <= first[r] or can_end != empty[r]:
                    first[r] |= found
                    empty[r] |= can_end
                    changed = True
        kinds = {*self.terminals.values(), END}
        self.called = []
        for s in range(n):
            by: dict[str, list] = {}
            for k in kinds:
                these = [(g, name, t) for g, name, t in self.calls[s] if g and (empty[name] or k in first[name])]
                if these:
                    by[k] = these
            self.called.append(by)
        self.kept = self._recursive()
        self.numbers: dict[frozenset, int] = {}
        self.places: list[dict] = []
        self.rows: list[dict[str, tuple]] = []
        self.entries = {r: self._number({(s, ()): self.all}) for r, s in self.starts.items()}

    def _recursive(self) -> set[str]:
        """Rules without which none calls itself, the most called first."""
        callees = {}
        for r, s in self.starts.items():
            seen, todo, names = set(), [s], []
            while todo:
                q = todo.pop()
                if q not in seen:
                    seen.add(q)
                    names += [name for _, name, _ in self.calls[q]]
                    todo += [t for ts in self.moves[q].values() for _, t in ts] + [t for _, _, t in self.calls[q]] + [t for _, t, _ in self.jumps[q]]
            callees[r] = set(names)
        kept: set[str] = set()
        while True:
            cyclic = set()
            for r in callees.keys() - kept:
                seen, todo = set(), [r]
                while todo:
                    new = callees[todo.pop()] - kept - seen
                    seen |= new
                    todo += new
                if r in seen:
                    cyclic.add(r)
            if not cyclic:
                return kept
            kept.add(max(sorted(cyclic), key=lambda r: sum(r in callees[c] for c in cyclic) * len(callees[r] & cyclic)))

    def _number(self, places: dict) -> int:
        key = frozenset(places.items())
        if key not in self.numbers:
            self.numbers[key] = len(self.rows)
            self.places.append(places)
            self.rows.append({})
        return self.numbers[key]

    def _row(self, number: int, symbol: str) -> tuple:
        """What follows from a set of places before a token: the dialects in which the rule may end, those that take the token and the places then, and calls of kept rules as entry, dialects and places after."""
        broken, token = len(symbol) > 1, symbol[-1]
        ends, moved, called = 0, {}, {}
        reach: dict = {}
        todo = list(self.places[number].items())
        while todo:
            place, m = todo.pop()
            old = reach.get(place, 0)
            m &= ~old
            if not m:
                continue
            reach[place] = old | m
            state, back = place
            f = self.final[state] & m
            if f and back:
                todo.append(((back[-1], back[:-1]), f))
            elif f:
                ends |= f
            for g, t in self.moves[state].get(token, ()):
                if g & m:
                    moved[t, back] = moved.get((t, back), 0) | g & m
            for g, t, c in self.jumps[state]:
                if g & m:
                    what = c[0]
                    if what == "same":
                        ok = not broken
                    elif what == "nl":
                        ok = broken
                    elif what == "semi":
                        ok = broken or token in self.closers
                    else:
                        ok = token not in c[1]
                    if ok:
                        todo.append(((t, back), g & m))
            for g, name, t in self.called[state].get(token, ()):
                if not g & m:
                    continue
                if name in self.kept:
                    after = called.setdefault(name, {})
                    after[t, back] = after.get((t, back), 0) | g & m
                else:
                    over = self.final[t] == self.all and not (self.moves[t] or self.calls[t] or self.jumps[t])
                    todo.append(((self.starts[name], back if over else (*back, t)), g & m))
        union = lambda places: reduce(or_, places.values(), 0)
        row = ends, union(moved), self._number(moved) if moved else -1, tuple((self.entries[name], union(after), self._number(after)) for name, after in called.items())
        self.rows[number][symbol] = row
        return row

    def recognise(self, kinds: str, breaks: frozenset[int] | set[int], mask: int | None = None, start: str | None = None) -> int:
        """The dialects whose language holds the token sequence; ``breaks`` are the tokens that a line break comes before."""
        return self.run([BREAK + k if i in breaks else k for i, k in enumerate(kinds)], mask, start)

    def run(self, symbols: list[str], mask: int | None = None, start: str | None = None) -> int:
        """The same for a list of tokens, each with a BREAK before it where a line break is."""
        rows = self.rows
        n = len(symbols)
        symbols = [*symbols, END]
        nodes: dict = {}
        # A node of the stack: its edges (places after, parent, mask), the ends at which it was popped, and what was met in it.
        root: tuple = ([], {}, {})
        todo = [(self.entries[start or self.start], root, 0, self.all if mask is None else mask)]
        while todo:
            number, node, pos, m = todo.pop()
            while True:
                symbol = symbols[pos]
                row = rows[number].get(symbol) or self._row(number, symbol)
                f, g, target, calls = row
                if f or calls:
                    seen = node[2]
                    key = (number, pos)
                    old = seen.get(key, 0)
                    m &= ~old
                    if not m:
                        break
                    seen[key] = old | m
                    f &= m
                    if f:
                        popped = node[1]
                        old = popped.get(pos, 0)
                        f &= ~old
                        if f:
                            popped[pos] = old | f
                            for back, parent, h in node[0]:
                                if f & h:
                                    todo.append((back, parent, pos, f & h))
                    for entry, h, after in calls:
                        h &= m
                        if h:
                            key = (entry, pos)
                            child = nodes.get(key)
                            if child is None:
                                child = nodes[key] = ([], {}, {})
                            child[0].append((after, node, h))
                            for end, p in child[1].items():
                                if p & h:
                                    todo.append((after, node, end, p & h))
                            todo.append((entry, child, pos, h))
                m &= g
                if not m:
                    break
                number = target
                pos += 1
        return root[1].get(n, 0)

    closers = frozenset()
