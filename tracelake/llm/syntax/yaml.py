"""YAML by recursive descent over indentation; goes on after an error at the next line of an outer block."""

from __future__ import annotations

import re

from tracelake.llm.syntax.common import Bad, Problem, any_depth

_BREAK = "\n"
_UNPRINTABLE = re.compile("[^\t\n\r\x20-\x7e\x85\xa0-\ud7ff-\ufeff-\ufffd\U00010000-\U0010ffff]")
_MARKER = re.compile(r"(?:---|\.\.\.)(?=[ \t\n]|$)")
_HEADER = re.compile(r"[|>](?:[-+][1-9]?|[1-9][-+]?)?[ \t]*(?:(?<=[ \t])#[^\n]*)?(?=\n|$)")
_SINGLE = re.compile(r"'(?:[^']|'')*'")
_DOUBLE = re.compile(
    r'"(?:[^"\\]|\\(?:[0abtnvfre "/\\N_LP\t]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[ \t]*\n))*"'
)
_PROPERTY = re.compile(r"(?:&[\w-]+|!(?:<[^>\s]*>|[^\s,\[\]{}]*))(?=[\s,\]}]|$)")
_ALIAS = re.compile(r"\*[\w-]+(?=[\s?:,\]}%@`]|$)")
_PLAIN_BLOCK = re.compile(r"(?:[^\s:#]|:(?=[^\s])|(?<=[^\s])#|[ \t]+(?![\s#:])|[ \t]+(?=:[^\s]))+")
_PLAIN_FLOW = re.compile(r"(?:[^\s:#,\[\]{}]|:(?=[^\s,\[\]{}])|(?<=[^\s])#|[ \t]+(?![\s#:,\[\]{}])|[ \t]+(?=:[^\s,\[\]{}]))+")


class _Yaml:
    def __init__(self, text: str):
        self.text = text.replace("\r\n", "\n").replace("\r", "\n")
        self.n = len(self.text)
        self.pos = 0
        self.problems: list[Problem] = []

    def run(self) -> list[Problem]:
        m = _UNPRINTABLE.search(self.text)
        if m:
            self.problems.append(Problem(m.start(), "character is not allowed"))
        if self.text.startswith("\ufeff"):
            self.pos = 1
        first = True
        while True:
            start = self.pos
            try:
                if not self.document(first):
                    return self.problems
            except Bad as e:
                self.problems.append(Problem(e.pos, e.message))
                at = self.text.find("\n", max(e.pos, self.pos, start))
                if at < 0:
                    return self.problems
                self.pos = at + 1
            first = False

    # Places

    def column(self, pos: int | None = None) -> int:
        pos = self.pos if pos is None else pos
        return pos - (self.text.rfind("\n", 0, pos) + 1)

    def char(self, ahead: int = 0) -> str:
        return self.text[self.pos + ahead : self.pos + ahead + 1]

    def blank_after(self, ahead: int) -> bool:
        c = self.char(ahead)
        return not c or c in " \t\n"

    def at_marker(self) -> bool:
        return self.column() == 0 and bool(_MARKER.match(self.text, self.pos))

    def same_line(self) -> bool:
        """Past blanks and a comment; true if something else stands on this line."""
        start = self.pos
        while self.char() in (" ", "\t") and self.char():
            self.pos += 1
        if self.char() == "#" and (self.pos > start or self.pos == 0 or self.text[self.pos - 1] in " \t\n"):
            end = self.text.find("\n", self.pos)
            self.pos = self.n if end < 0 else end
        return bool(self.char()) and self.char() != "\n"

    def next_token(self) -> bool:
        """Past blanks, comments and line ends; false at the end of the text."""
        while self.pos < self.n:
            if self.column() == 0:
                while self.char() == " ":
                    self.pos += 1
                if self.char() == "\t" and self.text[self.pos : self.text.find("\n", self.pos) if "\n" in self.text[self.pos :] else self.n].strip():
                    if not self.text[self.pos :].lstrip("\t ").startswith("#"):
                        raise Bad(self.pos, "tab in the indentation")
            if self.same_line():
                return True
            if self.char() == "\n":
                self.pos += 1
        return False

    # Documents

    def document(self, first: bool) -> bool:
        directives = False
        while self.next_token():
            if self.char() == "%" and self.column() == 0:
                directives = True
                end = self.text.find("\n", self.pos)
                self.pos = self.n if end < 0 else end
            elif self.at_marker() and self.text[self.pos] == ".":
                self.pos += 3
                if self.same_line():
                    raise Bad(self.pos, "expected a document start")
            else:
                break
        if self.pos >= self.n:
            if directives:
                raise Bad(self.pos, "expected a document start")
            return False
        if self.at_marker():
            self.pos += 3
            if self.same_line():
                self.inline(-1, -1, after_marker=True)
                self.ended()
                return True
        elif directives or not first and not self.ended_by_dots:
            raise Bad(self.pos, "expected a document start")
        self.block(-1)
        self.ended()
        return True

    ended_by_dots = False

    def ended(self) -> None:
        self.ended_by_dots = False
        if self.next_token():
            if not self.at_marker():
                raise Bad(self.pos, "expected the end of the document")
            self.ended_by_dots = self.text[self.pos] == "."

    # Block structure

    def block(self, parent: int, sequence_at: int = -2) -> None:
        """The node on the following lines, deeper than ``parent``, or a sequence at column ``sequence_at``; maybe none."""
        if not self.next_token() or self.at_marker():
            return
        c = self.column()
        dash = self.char() == "-" and self.blank_after(1)
        if c <= parent and not (dash and c == sequence_at):
            return
        self.inline(parent, c, own_line=True)

    def inline(self, parent: int, column: int, own_line: bool = False, after_marker: bool = False) -> None:
        """A node that begins here. ``column``: that of a block collection which may begin here; -1 if none may."""
        c, at = self.char(), self.pos
        blocks = column >= 0
        if c == "-" and self.blank_after(1):
            if not blocks:
                raise Bad(at, "sequence entries are not allowed here")
            self.sequence(column)
        elif c == "?" and self.blank_after(1):
            if not blocks:
                raise Bad(at, "mapping keys are not allowed here")
            self.mapping(column)
        elif c in ("|", ">"):
            self.block_scalar(parent)
        elif c in ("&", "!"):
            if blocks and self.is_key():
                self.mapping(column)
                return
            self.properties()
            if self.same_line():
                if self.char() in "-" and self.blank_after(1):
                    raise Bad(self.pos, "sequence entries are not allowed here")
                self.inline(parent, -1)
            else:
                self.block(parent, parent if not own_line else -2)
        elif blocks and self.is_key():
            self.mapping(column)
        else:
            self.scalar_or_flow(parent)
            if self.same_line():
                if self.char() == ":" :
                    raise Bad(self.pos, "mapping values are not allowed here")
                raise Bad(self.pos, "unexpected text after a value")

    def is_key(self) -> bool:
        """Whether a key with its colon begins here, on one line."""
        start = self.pos
        try:
            if self.char() == ":" and self.blank_after(1):
                return True
            self.properties()
            self.same_line()
            line_end = self.text.find("\n", start)
            if self.char() not in ("", "\n", ":") or not self.blank_after(1):
                self.key_node()
            if line_end >= 0 and self.pos > line_end:
                return False
            while self.char() in (" ", "\t") and self.char():
                self.pos += 1
            return self.char() == ":" and self.blank_after(1)
        except Bad:
            return False
        finally:
            self.pos = start

    def key_node(self) -> None:
        c = self.char()
        if c == "*":
            self.alias()
        elif c in ("[", "{"):
            self.flow()
        elif c in ("'", '"'):
            self.quoted()
        else:
            self.plain_start(False)
            self.pos = _PLAIN_BLOCK.match(self.text, self.pos).end()

    def sequence(self, column: int) -> None:
        while True:
            self.pos += 1
            if self.same_line():
                self.inline(column, self.column())
            else:
                self.block(column)
            if not self.next_token() or self.at_marker():
                return
            c = self.column()
            if c < column:
                return
            if c > column:
                raise Bad(self.pos, "bad indentation of a sequence entry")
            if not (self.char() == "-" and self.blank_after(1)):
                return

    def mapping(self, column: int) -> None:
        while True:
            explicit = self.char() == "?" and self.blank_after(1)
            if explicit:
                self.pos += 1
                if self.same_line():
                    self.inline(column, self.column())
                else:
                    self.block(column, column)
                if not (self.next_token() and not self.at_marker() and self.column() == column and self.char() == ":" and self.blank_after(1)):
                    if self.pos >= self.n or self.at_marker() or self.column() < column:
                        return
                    if self.column() > column:
                        raise Bad(self.pos, "bad indentation of a mapping entry")
                    continue
            elif self.char() == "-" and self.blank_after(1):
                raise Bad(self.pos, "expected a key, found a sequence entry")
            else:
                if not self.is_key():
                    self.key_failure()
                if not (self.char() == ":" and self.blank_after(1)):
                    self.properties()
                    self.same_line()
                    if not (self.char() == ":" and self.blank_after(1)):
                        self.key_node()
                    while self.char() in (" ", "\t"):
                        self.pos += 1
            self.pos += 1
            if self.same_line():
                self.inline(column, self.column() if explicit else -1)
            else:
                self.block(column, column)
            if not self.next_token() or self.at_marker():
                return
            c = self.column()
            if c < column:
                return
            if c > column:
                raise Bad(self.pos, "bad indentation of a mapping entry")

    def key_failure(self) -> None:
        at = self.pos
        self.key_node()  # its own error, if it has one
        raise Bad(at, "could not find expected ':'")

    # Leaves

    def properties(self) -> None:
        seen = ""
        while self.char() in ("&", "!") and self.char():
            m = _PROPERTY.match(self.text, self.pos)
            if not m:
                raise Bad(self.pos, "malformed anchor or tag")
            if self.char() in seen:
                raise Bad(self.pos, "a node has one anchor and one tag at most")
            seen += self.char()
            self.pos = m.end()
            end = self.pos
            while self.char() in (" ", "\t") and self.char():
                self.pos += 1
            if self.char() not in ("&", "!"):
                self.pos = end
                return

    def alias(self) -> None:
        m = _ALIAS.match(self.text, self.pos)
        if not m:
            raise Bad(self.pos, "malformed alias")
        self.pos = m.end()

    def quoted(self) -> None:
        at = self.pos
        m = (_SINGLE if self.char() == "'" else _DOUBLE).match(self.text, at)
        if not m:
            raise Bad(at, "unterminated or malformed quoted scalar")
        body = m.group()
        if "\n---" in body or "\n..." in body:
            for x in re.finditer(r"\n(?=(?:---|\.\.\.)(?:\s|$))", body):
                raise Bad(at + x.end(), "document marker in a quoted scalar")
        self.pos = m.end()

    def plain_start(self, flow: bool) -> None:
        c = self.char()
        if not c or c in "\n,[]{}#&*!|>'\"%@`" or (c in "-?:" and (self.blank_after(1) or (flow and self.char(1) in ",[]{}"))):
            raise Bad(self.pos, f"'{c}' cannot start a value")
        if c == "\t":
            raise Bad(self.pos, "tab cannot start a value")

    def scalar_or_flow(self, parent: int) -> None:
        c = self.char()
        if c == "*":
            self.alias()
        elif c in ("[", "{"):
            self.flow()
        elif c in ("'", '"'):
            self.quoted()
        else:
            self.plain(parent)

    def plain(self, parent: int) -> None:
        """A plain scalar with its continuation lines, which are deeper than ``parent``."""
        self.plain_start(False)
        while True:
            m = _PLAIN_BLOCK.match(self.text, self.pos)
            if m:
                self.pos = m.end()
            start = self.pos
            if self.same_line() or self.text[start : self.pos].strip():
                return  # a colon, reported by the caller, or a comment, which ends the scalar
            back = self.pos
            while self.char() == "\n":
                self.pos += 1
                while self.char() == " ":
                    self.pos += 1
                while self.char() == "\t":
                    self.pos += 1
            if self.pos >= self.n or self.column() <= parent or self.at_marker() or self.char() == "#":
                self.pos = back
                return
            if self.char() == ":" and self.blank_after(1):
                raise Bad(self.pos, "mapping values are not allowed here")

    def block_scalar(self, parent: int) -> None:
        m = _HEADER.match(self.text, self.pos)
        if not m:
            raise Bad(self.pos, "malformed block scalar header")
        digit = re.search("[1-9]", m.group().split("#")[0])
        self.pos = m.end()
        indent = max(parent, 0) + int(digit.group()) if digit else None
        while self.pos < self.n:  # at a line end
            line = self.pos + 1
            at = line
            while self.text[at : at + 1] == " ":
                at += 1
            end = self.text.find("\n", line)
            end = self.n if end < 0 else end
            if at >= end:  # an empty line
                self.pos = end
                continue
            width = at - line
            if indent is None:
                if width <= parent or (width == 0 and _MARKER.match(self.text, line)):
                    return
                indent = width
            if width < indent or (width == 0 and _MARKER.match(self.text, line)):
                return
            self.pos = end

    # Flow collections

    def flow_space(self) -> None:
        while self.pos < self.n:
            if self.same_line():
                return
            if self.char() == "\n":
                self.pos += 1
                if self.at_marker():
                    raise Bad(self.pos, "document marker in a flow collection")
        raise Bad(self.pos, "unclosed flow collection")

    def flow(self) -> None:
        start = self.pos
        closer = "]" if self.char() == "[" else "}"
        self.pos += 1
        while True:
            self.flow_space()
            if self.char() == closer:
                self.pos += 1
                return
            if self.char() == ",":
                raise Bad(self.pos, "expected a node before ','")
            if self.char() == "?" and self.blank_after(1):
                self.pos += 1
                self.flow_space()
            json_like = self.char() in "\"'[{"
            if not (self.char() == ":" and (self.blank_after(1) or self.char(1) in ",[]{}")) and self.char() not in (",", closer):
                self.flow_node()
                self.flow_space()
            if self.char() == ":" and (json_like or self.blank_after(1) or self.char(1) in ",[]{}"):
                self.pos += 1
                self.flow_space()
                if self.char() not in (",", closer):
                    self.flow_node()
                    self.flow_space()
            if self.char() == ",":
                self.pos += 1
            elif self.char() != closer:
                raise Bad(start, f"expected ',' or '{closer}' in a flow collection")

    def flow_node(self) -> None:
        if self.char() in ("&", "!"):
            self.properties()
            self.flow_space()
            if self.char() in (",", "]", "}", ":"):
                return
        c = self.char()
        if c == "*":
            self.alias()
        elif c in ("[", "{"):
            self.flow()
        elif c in ("'", '"'):
            self.quoted()
        else:
            self.plain_start(True)
            while True:
                m = _PLAIN_FLOW.match(self.text, self.pos)
                if not m:
                    return
                self.pos = m.end()
                back = self.pos
                if self.same_line():
                    return
                self.flow_space()
                if self.char() in ",[]{}#" or (self.char() == ":" and (self.blank_after(1) or self.char(1) in ",[]{}")):
                    self.pos = back
                    self.flow_space()
                    return


@any_depth
def yaml_problems(text: str) -> list[Problem]:
    return _Yaml(text).run()
