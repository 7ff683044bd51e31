"""Tokens of Python 3.13 source."""

from __future__ import annotations

import re

from tracelake.llm.syntax.common import Bad

NAME, NUMBER, STRING, OP, NEWLINE, INDENT, DEDENT, END, BROKEN = range(9)
#: The reserved words of Python 3.13.
KEYWORDS = frozenset(
    "False None True and as assert async await break class continue def del elif else except finally for from global if "
    "import in is lambda nonlocal not or pass raise return try while with yield".split()
)
_OPERATORS = (
    r"\*\*=|//=|>>=|<<=|\.\.\.|->|:=|==|!=|<=|>=|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|\*\*|//|<<|>>|[-+*/%@&|^~<>()\[\]{},:;.=]"
)
_DIGITS = r"[0-9](?:_?[0-9])*"
_NUMBERS = (
    r"0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+"
    rf"|(?:{_DIGITS}\.(?:{_DIGITS})?|\.{_DIGITS}|{_DIGITS}(?=[eEjJ]))(?:[eE][-+]?{_DIGITS})?[jJ]?|{_DIGITS}"
)
_QUOTE = r"(?P<prefix>[rRbBuUfF]{0,2})(?P<quote>\"\"\"|'''|\"|')"
_TOKEN = re.compile(rf"[ \t\f]*(?:(?P<string>{_QUOTE})|(?P<name>[^\W\d]\w*)|(?P<number>{_NUMBERS})|(?P<op>{_OPERATORS})|(?P<end>\r\n|\n|\r|#[^\r\n]*|\\(?:\r\n|\n|\r)))")
_INDENT = re.compile(r"[ \t\f]*")
_REST = {
    '"': re.compile(r'(?:[^"\\\r\n]|\\(?:\r\n|.))*"', re.S),
    "'": re.compile(r"(?:[^'\\\r\n]|\\(?:\r\n|.))*'", re.S),
    '"""': re.compile(r'(?:[^"\\]|\\.|"(?!""))*"""', re.S),
    "'''": re.compile(r"(?:[^'\\]|\\.|'(?!''))*'''", re.S),
}
_PREFIXES = frozenset(["", "r", "u", "b", "f", "br", "rb", "fr", "rf"])
_ESCAPE = re.compile(r"\\(?:\\|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U00(?:0[0-9a-fA-F]|10)[0-9a-fA-F]{4}|N\{[^{}]+\}|[^xuUN])", re.S)
_BYTES_ESCAPE = re.compile(r"\\(?:x[0-9a-fA-F]{2}|[^x])", re.S)
_HARD = re.compile(r"\\[xuUN]")
_WORD_AFTER_NUMBER = re.compile(r"(?:and|else|for|if|in|is|not|or)\b")
#: Limits of the language's own reader.
MOST_BRACKETS, MOST_INDENTS, MOST_FSTRINGS = 200, 100, 150
_OPEN = {"(": ")", "[": "]", "{": "}"}


def _check_escapes(body: str, pos: int, is_bytes: bool) -> None:
    one = _BYTES_ESCAPE if is_bytes else _ESCAPE
    at = body.find("\\")
    while at >= 0:
        m = one.match(body, at)
        if not m:
            raise Bad(pos + at, "malformed escape in a string")
        at = body.find("\\", m.end())


def scan_fstring(text: str, pos: int, quote: str, raw: bool, fields: list[tuple[int, int]], depth: int = 0) -> int:
    """End of the f-string whose body starts at ``pos``; puts the expressions of its fields into ``fields``."""
    n, triple = len(text), len(quote) == 3
    while pos < n:
        c = text[pos]
        if c == "\\" and not raw:
            pos += 2
            if text[pos - 1 : pos] == "N" and text[pos : pos + 1] == "{":
                pos = text.find("}", pos) + 1 or n
        elif c == "\\":
            pos += 1 if text[pos + 1 : pos + 2] in "{}" else 2
        elif text.startswith(quote, pos):
            return pos + len(quote)
        elif c in "\r\n" and not triple:
            break
        elif c == "{":
            if text.startswith("{{", pos):
                pos += 2
            else:
                pos = _scan_field(text, pos + 1, quote, raw, fields, depth)
        elif c == "}":
            if not text.startswith("}}", pos):
                raise Bad(pos, "f-string: single '}' is not allowed")
            pos += 2
        else:
            pos += 1
    raise Bad(pos, "unterminated f-string literal")


def _scan_field(text: str, pos: int, quote: str, raw: bool, fields: list[tuple[int, int]], depth: int) -> int:
    if depth > MOST_FSTRINGS:
        raise Bad(pos, "f-string: expressions nested too deeply")
    start, closing = pos, []
    while True:
        m = _TOKEN.match(text, pos)
        if not m:
            rest = text[pos : pos + 1]
            if rest == "!" or (rest.isspace() and rest):
                if rest == "!" and not closing:
                    break
                pos += 1
                continue
            raise Bad(pos, "f-string: expecting '}'")
        at = m.start(m.lastgroup if m.lastgroup not in ("prefix", "quote") else "string")
        if m["string"] is not None:
            pos = skip_string(text, m, [])
            continue
        if m["end"] is not None:
            pos = m.end()
            continue
        op = m["op"]
        if op is not None and not closing and (op[0] in ":}=" or op == "!="):
            if op == "}" or op[0] == ":":
                break
            if op == "=":
                after = re.compile(r"\s*[!:}]").match(text, m.end())
                if after and not text.startswith("!=", after.end() - 1):
                    pos = m.end()
                    fields.append((start, at))
                    return _field_end(text, pos, quote, raw, fields, depth)
        if op in _OPEN:
            closing.append(_OPEN[op])
        elif op in (")", "]", "}"):
            if not closing or closing.pop() != op:
                raise Bad(at, f"f-string: unmatched '{op}'")
        pos = m.end()
    end = pos if not m else m.start("op")
    if not text[start:end].strip():
        raise Bad(start, "f-string: valid expression required before '}'")
    fields.append((start, end))
    return _field_end(text, end, quote, raw, fields, depth)


def _field_end(text: str, pos: int, quote: str, raw: bool, fields: list[tuple[int, int]], depth: int) -> int:
    while text[pos : pos + 1].isspace():
        pos += 1
    if text[pos : pos + 1] == "!":
        if text[pos + 1 : pos + 2] not in ("r", "s", "a"):
            raise Bad(pos, "f-string: invalid conversion character")
        pos += 2
        while text[pos : pos + 1].isspace():
            pos += 1
    if text[pos : pos + 1] == ":":
        pos += 1
        while pos < len(text):
            c = text[pos]
            if c == "}":
                return pos + 1
            if c == "{":
                pos = _scan_field(text, pos + 1, quote, raw, fields, depth + 1)
            elif text.startswith(quote, pos) or (c in "\r\n" and len(quote) == 1):
                break
            else:
                pos += 2 if c == "\\" and not raw else 1
        raise Bad(pos, "f-string: expecting '}'")
    if text[pos : pos + 1] != "}":
        raise Bad(pos, "f-string: expecting '}'")
    return pos + 1


def skip_string(text: str, m: re.Match, fields: list[tuple[int, int]]) -> int:
    """End of the string literal that ``m`` begins; ``Bad`` if it is malformed."""
    prefix, quote, start = m["prefix"].lower(), m["quote"], m.start("string")
    if prefix not in _PREFIXES:
        raise Bad(start, "invalid string prefix")
    if "f" in prefix:
        end = scan_fstring(text, m.end(), quote, "r" in prefix, fields)
        if "r" not in prefix and _HARD.search(text, m.end(), end):
            bare = text[m.end() : end]
            if "{" not in bare:
                _check_escapes(bare, m.end(), False)
        return end
    r = _REST[quote].match(text, m.end())
    if not r:
        raise Bad(start, "unterminated string literal")
    body = r.group()
    if "b" in prefix and not body.isascii():
        raise Bad(start, "bytes can only contain ASCII literal characters")
    if "r" not in prefix and _HARD.search(body):
        _check_escapes(body[: -len(quote)], m.end(), "b" in prefix)
    return r.end()


def _name_end(text: str, pos: int) -> int:
    while pos < len(text) and ("a" + text[pos]).isidentifier():
        pos += 1
    return pos


class Tokens:
    """Parallel lists ``kinds``, ``texts`` and ``starts``; ``fields`` has the f-string expressions of a token by index."""

    def __init__(self, text: str):
        self.text = text
        self.kinds: list[int] = []
        self.texts: list[str] = []
        self.starts: list[int] = []
        self.fields: dict[int, list[tuple[int, int]]] = {}
        self.problems: list[Bad] = []
        self.comments: list[tuple[int, str]] = []  # those with a line of their own
        self._scan()

    def _add(self, kind: int, text: str, start: int) -> None:
        self.kinds.append(kind)
        self.texts.append(text)
        self.starts.append(start)

    def _scan(self) -> None:
        text, n, pos = self.text, len(self.text), 0
        kinds, texts, starts = self.kinds, self.texts, self.starts
        indents, alternates = [0], [0]
        brackets: list[tuple[str, int]] = []
        fresh = True  # at the start of a logical line
        if "\0" in text:
            self.problems.append(Bad(text.index("\0"), "source code cannot contain null bytes"))
        match = _TOKEN.match
        while pos < n:
            if fresh and not brackets:
                m = _INDENT.match(text, pos)
                lead, at = m.group(), m.end()
                if at >= n:
                    break
                c = text[at]
                if c == "#":
                    begin = at
                    while at < n and text[at] not in "\r\n":
                        at += 1
                    self.comments.append((begin, text[begin:at]))
                    pos = at + (2 if text.startswith("\r\n", at) else 1)
                    continue
                if c in "\r\n":
                    pos = at + (2 if text.startswith("\r\n", at) else 1)
                    continue
                if c == "\\" and text[at + 1 : at + 2] in ("\r", "\n"):
                    pos = at + (3 if text.startswith("\r\n", at + 1) else 2)
                    if not lead:
                        continue
                if "\t" in lead or "\f" in lead:
                    width = alternate = 0
                    for x in lead:
                        if x == " ":
                            width, alternate = width + 1, alternate + 1
                        elif x == "\t":
                            width, alternate = (width // 8 + 1) * 8, alternate + 1
                        else:
                            width = alternate = 0
                else:
                    width = alternate = len(lead)
                if width == indents[-1]:
                    if alternate != alternates[-1]:
                        self.problems.append(Bad(at, "inconsistent use of tabs and spaces in indentation"))
                elif width > indents[-1]:
                    if alternate <= alternates[-1]:
                        self.problems.append(Bad(at, "inconsistent use of tabs and spaces in indentation"))
                    if len(indents) >= MOST_INDENTS:
                        self.problems.append(Bad(at, "too many levels of indentation"))
                    indents.append(width)
                    alternates.append(alternate)
                    self._add(INDENT, "", at)
                else:
                    while width < indents[-1]:
                        indents.pop()
                        alternates.pop()
                        self._add(DEDENT, "", at)
                    if width != indents[-1]:
                        self.problems.append(Bad(at, "unindent does not match any outer indentation level"))
                        indents.append(width)
                        alternates.append(alternate)
                        self._add(INDENT, "", at)
                    elif alternate != alternates[-1]:
                        self.problems.append(Bad(at, "inconsistent use of tabs and spaces in indentation"))
                fresh = False
                pos = max(pos, at)
            m = match(text, pos)
            if not m:
                at = pos
                while at < n and text[at] in " \t\f":
                    at += 1
                if at >= n:
                    break
                if text[at].isidentifier():  # a letter that is no word character elsewhere
                    pos = _name_end(text, at + 1)
                    self._add(NAME, text[at:pos], at)
                    continue
                self.problems.append(Bad(at, "invalid character"))
                self._add(BROKEN, text[at], at)
                pos = at + 1
                continue
            group = m.lastgroup
            if group == "name":
                kinds.append(NAME)
                texts.append(m["name"])
                starts.append(m.start("name"))
                pos = m.end()
                if text[pos : pos + 1] > "\x7f":
                    pos = _name_end(text, pos)
                    texts[-1] = text[starts[-1] : pos]
                if not texts[-1].isascii() and not texts[-1].isidentifier():
                    self.problems.append(Bad(starts[-1], "invalid character in a name"))
            elif group == "op":
                op, at, pos = m["op"], m.start("op"), m.end()
                kinds.append(OP)
                texts.append(op)
                starts.append(at)
                if op in _OPEN:
                    if len(brackets) >= MOST_BRACKETS:
                        self.problems.append(Bad(at, "too many nested parentheses"))
                    brackets.append((op, at))
                elif op in ")]}":
                    if not brackets:
                        self.problems.append(Bad(at, f"unmatched '{op}'"))
                    elif _OPEN[brackets.pop()[0]] != op:
                        self.problems.append(Bad(at, f"closing parenthesis '{op}' does not match the opening one"))
            elif group == "number":
                word, at, pos = m["number"], m.start("number"), m.end()
                self._add(NUMBER, word, at)
                bare = word.replace("_", "")
                if len(bare) > 1 and bare[0] == "0" and bare.isdigit() and bare.strip("0"):
                    self.problems.append(Bad(at, "leading zeros in decimal integer literals are not permitted"))
                following = text[pos : pos + 1]
                if following and (following == "_" or following.isalnum()) and not _WORD_AFTER_NUMBER.match(text, pos):
                    self.problems.append(Bad(at, "invalid number literal"))
            elif group == "end":
                end, at, pos = m["end"], m.start("end"), m.end()
                if end[0] in "\r\n" and not brackets:
                    self._add(NEWLINE, end, at)
                    fresh = True
                elif end[0] == "\\" and pos >= n:
                    self.problems.append(Bad(at, "unexpected end of file after line continuation"))
            else:
                start = m.start("string")
                fields: list[tuple[int, int]] = []
                try:
                    pos = skip_string(text, m, fields)
                    self._add(STRING, text[start:pos], start)
                except Bad as e:
                    self.problems.append(e)
                    self._add(STRING, text[start : start + 1], start)
                    end = text.find("\n", max(m.end(), e.pos))
                    pos = n if end < 0 or len(m["quote"]) == 3 else end
                if fields:
                    self.fields[len(kinds) - 1] = fields
        if brackets:
            self.problems.append(Bad(brackets[-1][1], f"'{brackets[-1][0]}' was never closed"))
        if kinds and kinds[-1] not in (NEWLINE, DEDENT):
            self._add(NEWLINE, "", n)
        for _ in indents[1:]:
            self._add(DEDENT, "", n)
        self._add(END, "", n)
