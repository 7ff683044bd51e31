"""JSON and TOML by recursive descent. Both go on after an error at the next place where a value or a line can start."""

from __future__ import annotations

import re

from tracelake.llm.syntax.common import Bad, Problem, any_depth

_JSON_SPACE = re.compile(r"[ \t\r\n]*")
_JSON_STRING = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"')
_JSON_ATOM = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false|null")
_JSON_SYNC = re.compile(r"[,\]}\n]")


class _Json:
    """Objects and arrays on a stack of its own, so that depth has no limit."""

    def __init__(self, text: str):
        self.text, self.pos, self.problems = text, 0, []

    def space(self) -> str:
        self.pos = _JSON_SPACE.match(self.text, self.pos).end()
        return self.text[self.pos : self.pos + 1]

    def scalar(self) -> None:
        m = (_JSON_STRING if self.text[self.pos] == '"' else _JSON_ATOM).match(self.text, self.pos)
        if not m:
            unclosed = self.text[self.pos] == '"'
            raise Bad(self.pos, "unterminated or malformed string" if unclosed else "expected a value")
        self.pos = m.end()

    def key(self) -> None:
        if self.space() != '"':
            raise Bad(self.pos, "expected a property name in double quotes")
        self.scalar()
        if self.space() != ":":
            raise Bad(self.pos, "expected ':'")
        self.pos += 1

    def run(self) -> list[Problem]:
        if self.text.startswith("\ufeff"):
            self.pos = 1
        open_: list[str] = []
        want = True  # a value comes next
        while True:
            try:
                c = self.space()
                if want:
                    if not c:
                        raise Bad(self.pos, "expected a value")
                    if c in "{[":
                        self.pos += 1
                        open_.append("}" if c == "{" else "]")
                        if self.space() == open_[-1]:
                            self.pos += 1
                            open_.pop()
                            want = False
                        elif c == "{":
                            self.key()
                    else:
                        self.scalar()
                        want = False
                elif not open_:
                    if c:
                        raise Bad(self.pos, "extra data after the value")
                    break
                elif c == open_[-1]:
                    self.pos += 1
                    open_.pop()
                elif c == ",":
                    self.pos += 1
                    if open_[-1] == "}":
                        self.key()
                    want = True
                else:
                    raise Bad(self.pos, f"expected ',' or '{open_[-1]}'")
            except Bad as e:
                self.problems.append(Problem(e.pos, e.message))
                m = _JSON_SYNC.search(self.text, max(e.pos, self.pos) + (not open_))
                if not m or not open_:
                    break
                self.pos, want = m.start() + (m.group() == "\n"), False
                if m.group() in "]}" and m.group() != open_[-1]:
                    self.pos += 1
        return self.problems


def json_problems(text: str) -> list[Problem]:
    return _Json(text).run()


_SPACE = re.compile(r"[ \t]*")
_BARE = re.compile(r"[A-Za-z0-9_-]+")
_BASIC = re.compile(r'"(?:[^"\\\x00-\x08\x0a-\x1f\x7f]|\\(?:[btnfr"\\]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*"')
_LITERAL = re.compile(r"'[^'\x00-\x08\x0a-\x1f\x7f]*'")
_ML_BASIC = re.compile(
    r'"""(?:[^"\\\x00-\x08\x0b\x0c\x0e-\x1f\x7f]|"(?!"")|\\(?:[btnfr"\\]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[ \t]*\r?\n[ \t\r\n]*))*"""(?:"{0,2})'
)
_ML_LITERAL = re.compile(r"'''(?:[^'\x00-\x08\x0b\x0c\x0e-\x1f\x7f]|'(?!''))*'''(?:'{0,2})")
_DATE = re.compile(
    r"(?P<y>\d{4})-(?P<m>\d\d)-(?P<d>\d\d)(?:[Tt ](?P<h>\d\d):(?P<i>\d\d):(?P<s>\d\d)(?:\.\d+)?(?:[Zz]|[-+](?P<zh>\d\d):(?P<zm>\d\d))?)?|(?P<h2>\d\d):(?P<i2>\d\d):(?P<s2>\d\d)(?:\.\d+)?"
)
_FLOAT = re.compile(r"[-+]?(?:inf|nan|(?:0|[1-9](?:_?\d)*)(?:\.\d(?:_?\d)*(?:[eE][-+]?\d(?:_?\d)*)?|[eE][-+]?\d(?:_?\d)*))(?![\w.])")
_INT = re.compile(r"(?:0x[0-9A-Fa-f](?:_?[0-9A-Fa-f])*|0o[0-7](?:_?[0-7])*|0b[01](?:_?[01])*|[-+]?(?:0|[1-9](?:_?\d)*))(?![\w.])")
_BOOL = re.compile(r"(?:true|false)(?!\w)")
_COMMENT = re.compile(r"#[^\x00-\x08\x0a-\x1f\x7f]*")
_MONTH = (31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)


class _Table(dict):
    """``header``: named in brackets; ``dotted``: made by a dotted key; ``closed``: an inline value, not to be extended."""

    header = dotted = closed = False


class _Toml:
    def __init__(self, text: str):
        self.text = text.replace("\r\n", "\n")
        self.pos, self.problems, self.root = 0, [], _Table()
        self.here = self.root

    def space(self) -> str:
        self.pos = _SPACE.match(self.text, self.pos).end()
        return self.text[self.pos : self.pos + 1]

    def line_end(self) -> None:
        if self.space() == "#":
            self.pos = _COMMENT.match(self.text, self.pos).end()
        c = self.text[self.pos : self.pos + 1]
        if c and c != "\n":
            raise Bad(self.pos, "expected the end of the line")
        self.pos += 1

    def blank(self) -> str:
        """Past spaces, line ends and comments, inside an array."""
        while True:
            c = self.space()
            if c == "#":
                self.pos = _COMMENT.match(self.text, self.pos).end()
                c = self.text[self.pos : self.pos + 1]
                if c and c != "\n":
                    raise Bad(self.pos, "invalid character in a comment")
            if c != "\n":
                return c
            self.pos += 1

    def key(self) -> list[str]:
        parts = []
        while True:
            c = self.space()
            r = _BASIC if c == '"' else _LITERAL if c == "'" else _BARE
            m = r.match(self.text, self.pos) if c else None
            if not m:
                raise Bad(self.pos, "expected a key")
            parts.append(m.group()[1:-1] if c in "\"'" else m.group())
            self.pos = m.end()
            if self.space() != ".":
                return parts
            self.pos += 1

    def run(self) -> list[Problem]:
        if self.text.startswith("\ufeff"):
            self.pos = 1
        while self.pos < len(self.text):
            start = self.pos
            try:
                c = self.space()
                if c in ("", "\n", "#"):
                    self.line_end()
                elif c == "[":
                    self.header()
                    self.line_end()
                else:
                    self.pair(self.here, inline=False)
                    self.line_end()
            except Bad as e:
                self.problems.append(Problem(e.pos, e.message))
                end = self.text.find("\n", max(start, min(e.pos, self.pos)))
                self.pos = end + 1 if end >= 0 else len(self.text)
        return self.problems

    def header(self) -> None:
        at = self.pos
        many = self.text.startswith("[[", at)
        self.pos += 2 if many else 1
        parts = self.key()
        closer = "]]" if many else "]"
        if not self.text.startswith(closer, self.pos):
            raise Bad(self.pos, f"expected '{closer}'")
        self.pos += len(closer)
        t = self.root
        for p in parts[:-1]:
            t = self.enter(t, p, at)
        last = parts[-1]
        if many:
            rows = t.setdefault(last, [])
            if not isinstance(rows, list) or (rows and rows[-1] is None):
                raise Bad(at, "cannot extend a value that is no array of tables")
            rows.append(_Table())
            self.here = rows[-1]
        else:
            new = t.get(last)
            if new is None and last not in t:
                new = t[last] = _Table()
            if not isinstance(new, _Table) or new.header or new.dotted or new.closed:
                raise Bad(at, "table is declared twice")
            new.header = True
            self.here = new

    def enter(self, t: _Table, part: str, at: int, dotted: bool = False) -> _Table:
        new = part not in t
        x = t.setdefault(part, _Table())
        if isinstance(x, list) and x and isinstance(x[-1], _Table) and not dotted:
            return x[-1]
        if not isinstance(x, _Table) or x.closed or (dotted and x.header):
            raise Bad(at, "key is in use for another value")
        if dotted and new:
            x.dotted = True
        elif dotted and not x.dotted:
            raise Bad(at, "key is in use for another value")
        return x

    def pair(self, t: _Table, inline: bool) -> None:
        at = self.pos
        parts = self.key()
        if self.space() != "=":
            raise Bad(self.pos, "expected '=' after a key")
        self.pos += 1
        self.space()
        for p in parts[:-1]:
            t = self.enter(t, p, at, dotted=True)
        value = self.value()
        if parts[-1] in t:
            raise Bad(at, "key is set twice")
        t[parts[-1]] = value

    def value(self):
        text, pos = self.text, self.pos
        c = text[pos : pos + 1]
        if c in ('"', "'"):
            triple = text.startswith(c * 3, pos)
            r = (_ML_BASIC if triple else _BASIC) if c == '"' else (_ML_LITERAL if triple else _LITERAL)
            m = r.match(text, pos)
            if not m:
                raise Bad(pos, "unterminated or malformed string")
            self.pos = m.end()
            return None
        if c == "[":
            self.pos += 1
            while self.blank() != "]":
                self.value()
                if self.blank() == ",":
                    self.pos += 1
                elif self.text[self.pos : self.pos + 1] != "]":
                    raise Bad(self.pos, "unclosed array")
            self.pos += 1
            return [None]
        if c == "{":
            self.pos += 1
            t = _Table()
            if self.space() != "}":
                while True:
                    self.pair(t, inline=True)
                    if self.space() == ",":
                        self.pos += 1
                        continue
                    break
                if self.space() != "}":
                    raise Bad(self.pos, "unclosed inline table")
            self.pos += 1
            self._close(t)
            return t
        m = _DATE.match(text, pos)
        if m:
            month, day = int(m["m"] or 1), int(m["d"] or 1)
            clock = [(m[a] or m[b] or "0") for a, b in (("h", "h2"), ("i", "i2"), ("s", "s2"))]
            leap = m["y"] is None or (int(m["y"]) % 4 == 0 and (int(m["y"]) % 100 != 0 or int(m["y"]) % 400 == 0))
            if not 1 <= month <= 12 or not 1 <= day <= _MONTH[month - 1] - (month == 2 and not leap) or int(clock[0]) > 23 or int(clock[1]) > 59 or int(clock[2]) > 59:
                raise Bad(pos, "invalid date or time")
        else:
            m = _BOOL.match(text, pos) or _FLOAT.match(text, pos) or _INT.match(text, pos)
        if not m:
            raise Bad(pos, "invalid value")
        self.pos = m.end()
        return None

    def _close(self, t: _Table) -> None:
        t.closed = True
        for x in t.values():
            if isinstance(x, _Table):
                self._close(x)


@any_depth
def toml_problems(text: str) -> list[Problem]:
    """Positions count after line ends were made ``\\n``, which keeps line numbers."""
    return _Toml(text).run()
