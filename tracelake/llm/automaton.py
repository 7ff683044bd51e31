"""Grammars compiled into one deterministic automaton, whose states are made when first reached."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Stand-ins for characters beyond ASCII: white space, and all others.
_WIDE_SPACE, _WIDE = "\x85", "\x80"
LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
UPPER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
DIGITS = frozenset("0123456789")
SPACES = frozenset(" \t\n\r\x0b\x0c" + _WIDE_SPACE)
_ALL = frozenset(map(chr, range(128))) | {_WIDE, _WIDE_SPACE}


@dataclass(frozen=True)
class Node:
    """A part of a grammar: ``kind`` is set, seq, alt or rep."""

    kind: str
    chars: frozenset = frozenset()
    parts: tuple = ()
    least: int = 0
    most: int | None = None


def any_of(*chars: str | frozenset) -> Node:
    return Node("set", frozenset().union(*(frozenset(c) for c in chars)))


def none_of(*chars: str | frozenset) -> Node:
    return Node("set", _ALL - frozenset().union(*(frozenset(c) for c in chars)))


def seq(*parts) -> Node:
    return Node("seq", parts=tuple(text(p) if isinstance(p, str) else p for p in parts))


def alt(*parts) -> Node:
    return Node("alt", parts=tuple(text(p) if isinstance(p, str) else p for p in parts))


def rep(part, least: int = 0, most: int | None = None) -> Node:
    return Node("rep", parts=(text(part) if isinstance(part, str) else part,), least=least, most=most)


def text(literal: str) -> Node:
    return Node("seq", parts=tuple(Node("set", frozenset(c)) for c in literal))


def any_case(literal: str) -> Node:
    return Node("seq", parts=tuple(Node("set", frozenset((c.lower(), c.upper()))) for c in literal))


@dataclass
class _State:
    members: frozenset
    rule: str | None
    edges: dict = field(default_factory=dict)


class Automaton:
    """The union of named grammars. ``match`` gives the rule and the end of the longest match at a place.

    The grammars are joined in one nondeterministic automaton; a deterministic state is the set of its states that a text
    can be in, and is built with its transitions as texts lead there. Of rules that end at one place the first given counts.
    """

    def __init__(self, rules: dict[str, Node]):
        self.free: list[list[int]] = []
        self.steps: list[list[tuple[frozenset, int]]] = []
        self.final: dict[int, int] = {}
        self.names = list(rules)
        start = self._new()
        for n, grammar in enumerate(rules.values()):
            first, last = self._build(grammar)
            self.free[start].append(first)
            self.final[last] = n
        self.states: dict[frozenset, _State] = {}
        self.start = self._state({start})

    def _new(self) -> int:
        self.free.append([])
        self.steps.append([])
        return len(self.free) - 1

    def _build(self, g: Node) -> tuple[int, int]:
        a = self._new()
        if g.kind == "set":
            b = self._new()
            self.steps[a].append((g.chars, b))
            return a, b
        if g.kind == "seq":
            end = a
            for p in g.parts:
                first, last = self._build(p)
                self.free[end].append(first)
                end = last
            return a, end
        if g.kind == "alt":
            b = self._new()
            for p in g.parts:
                first, last = self._build(p)
                self.free[a].append(first)
                self.free[last].append(b)
            return a, b
        end = a
        for _ in range(g.least):
            first, last = self._build(g.parts[0])
            self.free[end].append(first)
            end = last
        b = self._new()
        self.free[end].append(b)
        if g.most is None:
            first, last = self._build(g.parts[0])
            self.free[end].append(first)
            self.free[last] += [first, b]
        else:
            for _ in range(g.most - g.least):
                first, last = self._build(g.parts[0])
                self.free[end].append(first)
                self.free[last].append(b)
                end = last
        return a, b

    def _state(self, members: set[int]) -> _State:
        todo, seen = list(members), set(members)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        key = frozenset(seen)
        known = self.states.get(key)
        if known is None:
            ends = [self.final[m] for m in key if m in self.final]
            known = self.states[key] = _State(key, self.names[min(ends)] if ends else None)
        return known

    def match(self, body: str, at: int) -> tuple[str, int] | None:
        state, best, n = self.start, None, len(body)
        while at < n:
            c = body[at]
            if c > "\x7f":
                c = _WIDE_SPACE if c.isspace() else _WIDE
            following = state.edges.get(c)
            if following is None:
                following = state.edges[c] = self._state({t for m in state.members for chars, t in self.steps[m] if c in chars})
            if not following.members:
                break
            state = following
            at += 1
            if state.rule is not None:
                best = state.rule, at
        return best
