"""What the parsers share."""

from __future__ import annotations

import sys
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass
from functools import wraps


@dataclass(frozen=True)
class Problem:
    pos: int
    message: str


class Bad(Exception):
    """A syntax error at ``pos``; caught where the parser can go on."""

    def __init__(self, pos: int, message: str):
        super().__init__(message)
        self.pos, self.message = pos, message


#: Calls that one character of a text may nest at most.
CALLS_A_CHARACTER = 40


def any_depth(parse: Callable) -> Callable:
    """``parse(text, ...)`` with room for as many nested calls as the text can ask for.

    Calls between Python functions are kept on the heap, not on the C stack, so depth is bounded by memory alone.
    """

    @wraps(parse)
    def run(text: str, *more):
        limit = sys.getrecursionlimit()
        sys.setrecursionlimit(max(limit, min(20_000 + CALLS_A_CHARACTER * len(text), 2**31 - 1)))
        try:
            return parse(text, *more)
        finally:
            sys.setrecursionlimit(limit)

    return run


class Lines:
    """Offsets to line numbers counted from 1; lines end at ``\\n``."""

    def __init__(self, text: str):
        self.starts = [0]
        at = text.find("\n")
        while at >= 0:
            self.starts.append(at + 1)
            at = text.find("\n", at + 1)

    def of(self, pos: int) -> int:
        return bisect_right(self.starts, pos)
