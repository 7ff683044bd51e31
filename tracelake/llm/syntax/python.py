"""Python 3.13: statements by recursive descent, expressions by precedence climbing, recovery at line starts."""

from __future__ import annotations


from tracelake.llm.syntax.common import Bad, Problem, any_depth
from tracelake.llm.syntax.pylexer import BROKEN, DEDENT, END, INDENT, KEYWORDS, NAME, NEWLINE, NUMBER, OP, STRING, Tokens

#: Kinds of expressions, as far as targets and arguments must tell them apart; GROUP is a starred value, no target.
PLAIN, TARGET, NAMED, STARRED, GROUP, LITERAL, YIELD, WALRUS, CALL = range(9)

#: Binding power of binary operators; comparisons are 4, "not" is 3.
_POWER = {"or": 1, "and": 2, "|": 5, "^": 6, "&": 7, "<<": 8, ">>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "//": 10, "%": 10, "@": 10}
_COMPARE = frozenset(["<", ">", "==", ">=", "<=", "!=", "in", "not", "is"])
_AUGMENTED = frozenset(["+=", "-=", "*=", "/=", "//=", "%=", "@=", "&=", "|=", "^=", ">>=", "<<=", "**="])
_CLOSERS = frozenset([")", "]", "}", ":", "=", ",", ";", "->", ":="])
_CONSTANTS = frozenset(["True", "False", "None"])


class Parser:
    def __init__(self, text: str, tokens: Tokens | None = None):
        self.text = text
        self.tokens = tokens or Tokens(text)
        self.kinds, self.words, self.starts = self.tokens.kinds, self.tokens.texts, self.tokens.starts
        self.at = 0
        self.problems: list[Bad] = list(self.tokens.problems)

    # Tokens

    def bad(self, message: str = "invalid syntax", at: int | None = None) -> Bad:
        return Bad(self.starts[self.at if at is None else at], message)

    def op(self, text: str) -> bool:
        if self.words[self.at] == text and self.kinds[self.at] == OP:
            self.at += 1
            return True
        return False

    def word(self, text: str) -> bool:
        if self.words[self.at] == text and self.kinds[self.at] == NAME:
            self.at += 1
            return True
        return False

    def peek(self, text: str) -> bool:
        return self.words[self.at] == text and self.kinds[self.at] in (OP, NAME)

    def need(self, text: str) -> None:
        if not (self.op(text) or self.word(text)):
            raise self.bad(f"expected '{text}'")

    def name(self) -> str:
        w = self.words[self.at]
        if self.kinds[self.at] != NAME or w in KEYWORDS:
            raise self.bad("expected a name")
        self.at += 1
        return w

    # Statements

    def file(self) -> list[Problem]:
        while self.kinds[self.at] != END:
            if self.kinds[self.at] == NEWLINE or self.kinds[self.at] == DEDENT:
                self.at += 1
            elif self.kinds[self.at] == INDENT:
                self.problems.append(self.bad("unexpected indent"))
                self.at += 1
            else:
                self.guarded()
        return [Problem(e.pos, e.message) for e in sorted(self.problems, key=lambda e: e.pos)]

    def guarded(self) -> None:
        """One statement; after an error the parser goes on at the next line of this block, or an outer one."""
        start = self.at
        try:
            self.statement()
        except Bad as e:
            self.problems.append(e)
            depth = 0
            for k in self.kinds[start : self.at]:
                depth += (k == INDENT) - (k == DEDENT)
            while self.kinds[self.at] != END:
                k = self.kinds[self.at]
                if k == INDENT:
                    depth += 1
                elif k == DEDENT:
                    if depth <= 0:
                        return
                    depth -= 1
                    if not depth:
                        self.at += 1
                        return
                elif k == NEWLINE and depth <= 0 and self.kinds[self.at + 1] != INDENT:
                    self.at += 1
                    return
                self.at += 1

    def statement(self) -> None:
        w = self.words[self.at]
        if self.kinds[self.at] == NAME:
            compound = _COMPOUND.get(w)
            if compound:
                self.at += 1
                compound(self)
                return
            if w == "match" and self.match():
                return
        elif self.kinds[self.at] == OP and w == "@":
            self.decorated()
            return
        self.simple_line()

    def simple_line(self) -> None:
        while True:
            self.simple()
            if self.op(";"):
                if self.kinds[self.at] == NEWLINE:
                    self.at += 1
                    return
                continue
            if self.kinds[self.at] != NEWLINE:
                raise self.bad()
            self.at += 1
            return

    def block(self) -> None:
        self.need(":")
        if self.kinds[self.at] != NEWLINE:
            self.simple_line()
            return
        self.at += 1
        if self.kinds[self.at] != INDENT:
            raise self.bad("expected an indented block")
        self.at += 1
        while self.kinds[self.at] not in (DEDENT, END):
            if self.kinds[self.at] == INDENT:
                self.problems.append(self.bad("unexpected indent"))
                self.at += 1
                continue
            self.guarded()
        if self.kinds[self.at] == DEDENT:
            self.at += 1

    def simple(self) -> None:
        w, k = self.words[self.at], self.kinds[self.at]
        if k == NAME and w in _SIMPLE:
            self.at += 1
            _SIMPLE[w](self)
            return
        if k == NAME and w == "type" and self.kinds[self.at + 1] == NAME and self.words[self.at + 1] not in KEYWORDS and self.words[self.at + 2] in ("=", "["):
            self.at += 2
            self.type_params()
            self.need("=")
            self.expression()
            return
        self.expression_statement()

    def expression_statement(self) -> None:
        start = self.at
        first = self.star_expressions(yields=True)
        if self.op(":"):
            if first not in (TARGET, NAMED):
                raise self.bad("illegal target for annotation", start)
            self.expression()
            if self.op("="):
                self.star_expressions(yields=True)
            return
        if self.words[self.at] in _AUGMENTED and self.kinds[self.at] == OP:
            if first not in (TARGET, NAMED):
                raise self.bad("illegal target for augmented assignment", start)
            self.at += 1
            self.star_expressions(yields=True)
            return
        while self.op("="):
            self.check_target(first, start)
            start = self.at
            first = self.star_expressions(yields=True)

    def check_target(self, kind, at: int) -> None:
        if isinstance(kind, list):
            for k in kind:
                self.check_target(k, at)
        elif kind not in (TARGET, NAMED, STARRED):
            raise self.bad("cannot assign to this expression", at)

    def star_expressions(self, yields: bool = False):
        """Expressions with commas between; the kind of the one expression, or the list of kinds of a tuple."""
        if yields and self.peek("yield"):
            return self.yield_()
        first = self.star_or()
        if not self.peek(","):
            return first
        kinds = [first]
        while self.op(","):
            if not self.starts_expression():
                break
            kinds.append(self.star_or())
        return kinds

    def star_or(self, walrus: bool = False):
        if self.op("*"):
            inner = self.binary(5)
            return STARRED if isinstance(inner, list) or inner in (TARGET, NAMED) else GROUP
        return self.named() if walrus else self.expression()

    def starts_expression(self) -> bool:
        k, w = self.kinds[self.at], self.words[self.at]
        if k in (NUMBER, STRING):
            return True
        if k == NAME:
            return w not in KEYWORDS or w in ("not", "lambda", "await", "None", "True", "False", "yield")
        return k == OP and w in ("(", "[", "{", "-", "+", "~", "...", "*")

    def del_(self) -> None:
        start = self.at
        kind = self.star_expressions()
        for k in kind if isinstance(kind, list) else [kind]:
            if k == STARRED:
                raise self.bad("cannot delete starred", start)
            self.check_target(k, start)

    def return_(self) -> None:
        if self.starts_expression():
            self.star_expressions()

    def raise_(self) -> None:
        if self.starts_expression():
            self.expression()
            if self.word("from"):
                self.expression()

    def assert_(self) -> None:
        self.expression()
        if self.op(","):
            self.expression()

    def names_(self) -> None:
        self.name()
        while self.op(","):
            self.name()

    def dotted(self) -> None:
        self.name()
        while self.op("."):
            self.name()

    def import_(self) -> None:
        while True:
            self.dotted()
            if self.word("as"):
                self.name()
            if not self.op(","):
                return

    def from_(self) -> None:
        dots = 0
        while self.op(".") or self.op("..."):
            dots += 1
        if not dots or not self.peek("import"):
            self.dotted()
        self.need("import")
        if self.op("*"):
            return
        closing = self.op("(")
        while True:
            self.name()
            if self.word("as"):
                self.name()
            if not self.op(","):
                break
            if closing and self.peek(")"):
                break
        if closing:
            self.need(")")

    # Compound statements

    def if_(self) -> None:
        self.named()
        self.block()
        while self.word("elif"):
            self.named()
            self.block()
        if self.word("else"):
            self.block()

    def while_(self) -> None:
        self.named()
        self.block()
        if self.word("else"):
            self.block()

    def for_(self) -> None:
        self.targets()
        self.need("in")
        self.star_expressions()
        self.block()
        if self.word("else"):
            self.block()

    def targets(self) -> None:
        """Targets before "in": operators bind tighter than it, so they can't take it in."""
        start = self.at
        while True:
            self.op("*")
            self.check_target(self.binary(5), start)
            if not self.op(",") or self.peek("in"):
                return

    def try_(self) -> None:
        self.block()
        star = None
        while self.peek("except"):
            at = self.at
            self.at += 1
            group = self.op("*")
            if star is not None and star != group:
                raise self.bad("cannot have both 'except' and 'except*'", at)
            star = group
            if not self.peek(":"):
                self.expression()
                if self.word("as"):
                    self.name()
            elif group:
                raise self.bad("expected one or more exception types")
            self.block()
        if star is not None and self.word("else"):
            self.block()
        if self.word("finally"):
            self.block()
        elif star is None:
            raise self.bad("expected 'except' or 'finally' block")

    def with_(self) -> None:
        start = self.at
        if self.op("("):
            try:
                while True:
                    self.with_item(closers=(")", ","))
                    if not self.op(",") or self.peek(")"):
                        break
                self.need(")")
                if self.peek(":"):
                    self.block()
                    return
            except Bad:
                pass
            self.at = start
        while True:
            self.with_item(closers=(":", ","))
            if not self.op(","):
                break
        self.block()

    def with_item(self, closers: tuple[str, ...]) -> None:
        self.expression()
        if self.word("as"):
            start = self.at
            self.check_target(self.star_or(), start)
            if self.words[self.at] not in closers:
                raise self.bad()

    def def_(self) -> None:
        self.name()
        self.type_params()
        self.need("(")
        self.parameters(")", annotations=True)
        self.need(")")
        if self.op("->"):
            self.expression()
        self.block()

    def class_(self) -> None:
        self.name()
        self.type_params()
        if self.op("("):
            self.arguments()
        self.block()

    def async_(self) -> None:
        for w, f in (("def", Parser.def_), ("for", Parser.for_), ("with", Parser.with_)):
            if self.word(w):
                f(self)
                return
        raise self.bad()

    def decorated(self) -> None:
        while self.op("@"):
            self.named()
            if self.kinds[self.at] != NEWLINE:
                raise self.bad()
            self.at += 1
        w = self.words[self.at]
        if self.kinds[self.at] != NAME or w not in ("def", "class", "async"):
            raise self.bad("expected a function or class after a decorator")
        if w == "async" and self.words[self.at + 1] != "def":
            raise self.bad()
        self.statement()

    def type_params(self) -> None:
        if not self.op("["):
            return
        while True:
            if not self.op("**"):
                self.op("*")
            self.name()
            if self.op(":"):
                self.expression()
            if self.op("="):
                self.star_or()
            if not self.op(",") or self.peek("]"):
                break
        self.need("]")

    def parameters(self, closer: str, annotations: bool) -> None:
        default = star = slash = keyword_only = False
        named = 0
        while not self.peek(closer):
            at = self.at
            if self.op("/"):
                if slash or star or not named:
                    raise self.bad("invalid '/' in parameters", at)
                slash = True
            elif self.op("**"):
                self.name()
                if annotations and self.op(":"):
                    self.expression()
                if self.peek("="):
                    raise self.bad("var-keyword argument cannot have default value")
                self.op(",")
                if not self.peek(closer):
                    raise self.bad("arguments cannot follow var-keyword argument")
                return
            elif self.op("*"):
                if star:
                    raise self.bad("* argument may appear only once", at)
                star = True
                if self.peek(","):
                    following = self.words[self.at + 1]
                    if following in (closer, "**") or self.kinds[self.at + 1] != NAME:
                        raise self.bad("named arguments must follow bare *")
                elif self.peek(closer):
                    raise self.bad("named arguments must follow bare *")
                else:
                    self.name()
                    if annotations and self.op(":"):
                        self.star_or()
                    if self.peek("="):
                        raise self.bad("var-positional argument cannot have default value")
                keyword_only = True
            else:
                self.name()
                named += 1
                if annotations and self.op(":"):
                    self.expression()
                if self.op("="):
                    self.expression()
                    default = True
                elif default and not keyword_only:
                    raise self.bad("parameter without a default follows parameter with a default", at)
            if not self.op(","):
                return

    # match

    def match(self) -> bool:
        start, known = self.at, len(self.problems)
        self.at += 1
        try:
            if not self.starts_expression() and not self.peek("*"):
                raise self.bad()
            self.star_or(walrus=True)
            while self.op(",") and self.starts_expression():
                self.star_or(walrus=True)
            self.need(":")
            if self.kinds[self.at] != NEWLINE or self.kinds[self.at + 1] != INDENT or self.words[self.at + 2] != "case":
                raise self.bad()
        except Bad:
            self.at = start
            del self.problems[known:]
            return False
        self.at += 2
        while self.word("case"):
            self.pattern_list()
            if self.word("if"):
                self.named()
            self.block()
        if self.kinds[self.at] != DEDENT:
            raise self.bad("expected 'case'")
        self.at += 1
        return True

    def pattern_list(self) -> None:
        self.star_pattern()
        while self.op(","):
            if self.peek(":") or self.peek("if"):
                return
            self.star_pattern()

    def star_pattern(self) -> None:
        if self.op("*"):
            self.name()
        else:
            self.pattern()

    def pattern(self) -> None:
        self.closed_pattern()
        while self.op("|"):
            self.closed_pattern()
        if self.word("as"):
            self.name()

    def closed_pattern(self) -> None:
        k, w = self.kinds[self.at], self.words[self.at]
        if k in (NUMBER, STRING) or (k == OP and w == "-"):
            self.binary(9)
        elif k == NAME and w in _CONSTANTS:
            self.at += 1
        elif k == NAME:
            self.dotted()
            if self.op("("):
                self.pattern_items(")", named=True)
        elif self.op("("):
            self.pattern_items(")")
        elif self.op("["):
            self.pattern_items("]")
        elif self.op("{"):
            while not self.peek("}"):
                if self.op("**"):
                    self.name()
                else:
                    if self.kinds[self.at] == NAME and self.words[self.at] not in _CONSTANTS:
                        self.dotted()
                    else:
                        self.closed_pattern()
                    self.need(":")
                    self.pattern()
                if not self.op(","):
                    break
            self.need("}")
        else:
            raise self.bad()

    def pattern_items(self, closer: str, named: bool = False) -> None:
        while not self.peek(closer):
            if named and self.kinds[self.at] == NAME and self.words[self.at + 1] == "=" and self.kinds[self.at + 1] == OP:
                self.name()
                self.at += 1
            self.star_pattern()
            if not self.op(","):
                break
        self.need(closer)

    # Expressions

    def named(self):
        at = self.at
        kind = self.expression()
        if self.op(":="):
            if kind != NAMED:
                raise self.bad("cannot use assignment expressions with this target", at)
            self.expression()
            return WALRUS
        return kind

    def expression(self):
        if self.peek("lambda"):
            self.at += 1
            self.parameters(":", annotations=False)
            self.need(":")
            self.expression()
            return PLAIN
        kind = self.binary(1)
        if self.word("if"):
            self.binary(1)
            self.need("else")
            self.expression()
            return PLAIN
        return kind

    def yield_(self):
        self.at += 1
        if self.word("from"):
            self.expression()
        elif self.starts_expression():
            self.star_expressions()
        return YIELD

    def binary(self, least: int):
        """Operators that bind at least as tightly as ``least``."""
        if self.peek("not") and least <= 3:
            self.at += 1
            self.binary(3)
            kind = PLAIN
        else:
            kind = self.unary()
        while True:
            w = self.words[self.at]
            if self.kinds[self.at] not in (OP, NAME):
                return kind
            power = _POWER.get(w)
            if power is not None:
                if power < least:
                    return kind
                self.at += 1
                self.binary(power + 1)
            elif w in _COMPARE:
                if least > 4:
                    return kind
                self.at += 1
                if w == "not":
                    self.need("in")
                elif w == "is":
                    self.word("not")
                self.binary(5)
            else:
                return kind
            kind = PLAIN

    def unary(self):
        if self.kinds[self.at] == OP and self.words[self.at] in ("-", "+", "~"):
            self.at += 1
            self.unary()
            return PLAIN
        return self.power()

    def power(self):
        awaited = self.word("await")
        kind = self.primary()
        if self.op("**"):
            self.unary()
            return PLAIN
        return PLAIN if awaited else kind

    def primary(self):
        kind = self.atom()
        while self.kinds[self.at] == OP:
            w = self.words[self.at]
            if w == ".":
                self.at += 1
                self.name()
                kind = TARGET
            elif w == "(":
                self.at += 1
                self.arguments()
                kind = CALL
            elif w == "[":
                self.at += 1
                self.subscripts()
                kind = TARGET
            else:
                break
        return kind

    def subscripts(self) -> None:
        while True:
            if self.op("*"):
                self.binary(5)
            else:
                if not self.peek(":"):
                    self.named()
                for _ in range(2):
                    if self.op(":") and not (self.peek(":") or self.peek(",") or self.peek("]")):
                        self.expression()
            if not self.op(",") or self.peek("]"):
                break
        self.need("]")

    def arguments(self) -> None:
        """After the opening parenthesis, up to and with the closing one."""
        keyword = unpacked = False
        count = 0
        while not self.peek(")"):
            at = self.at
            if self.op("**"):
                self.expression()
                unpacked = True
            elif self.op("*"):
                self.expression()
                if unpacked:
                    raise self.bad("iterable argument unpacking follows keyword argument unpacking", at)
            elif self.kinds[at] == NAME and self.words[at + 1] == "=" and self.kinds[at + 1] == OP:
                self.name()
                self.at += 1
                self.expression()
                keyword = True
            else:
                self.named()
                if self.peek("for") or self.peek("async"):
                    self.comprehension()
                    if count or (self.peek(",") and self.words[self.at + 1] != ")"):
                        raise self.bad("generator expression must be parenthesized", at)
                elif self.peek("="):
                    raise self.bad("expression cannot contain assignment")
                elif keyword or unpacked:
                    raise self.bad("positional argument follows keyword argument", at)
            count += 1
            if not self.op(","):
                break
        self.need(")")

    def comprehension(self) -> None:
        while True:
            if self.word("async"):
                self.need("for")
            elif not self.word("for"):
                return
            self.targets()
            self.need("in")
            self.binary(1)
            while self.word("if"):
                at = self.at
                self.binary(1)
                if self.peek(":="):
                    self.at = at
                    self.named()

    def atom(self):
        k, w = self.kinds[self.at], self.words[self.at]
        if k == NAME:
            if w in KEYWORDS:
                if w in _CONSTANTS:
                    self.at += 1
                    return LITERAL
                raise self.bad()
            self.at += 1
            return NAMED
        if k == NUMBER:
            self.at += 1
            return LITERAL
        if k == STRING:
            return self.strings()
        if k == OP:
            if w == "(":
                return self.parenthesis()
            if w == "[":
                return self.list_()
            if w == "{":
                return self.braces()
            if w == "...":
                self.at += 1
                return LITERAL
        raise self.bad("invalid character" if k == BROKEN else "invalid syntax")

    def strings(self):
        is_bytes = None
        while self.kinds[self.at] == STRING:
            w = self.words[self.at]
            b = "b" in w[: min(i for i in (w.find("'"), w.find('"')) if i >= 0)].lower() if len(w) > 1 else is_bytes
            if is_bytes is not None and b != is_bytes:
                raise self.bad("cannot mix bytes and nonbytes literals")
            is_bytes = b
            for start, end in self.tokens.fields.get(self.at, ()):
                self.field(start, end)
            self.at += 1
        return LITERAL

    def field(self, start: int, end: int) -> None:
        inner = Parser("(" + self.text[start:end] + "\n)")
        if inner.problems:
            raise Bad(start, "f-string: invalid syntax")
        try:
            inner.at = 1
            if inner.peek("yield"):
                inner.yield_()
            else:
                inner.star_or(walrus=True)
                while inner.op(","):
                    if inner.peek(")"):
                        break
                    inner.star_or(walrus=True)
            inner.need(")")
            if inner.kinds[inner.at] != NEWLINE:
                raise inner.bad()
        except Bad as e:
            raise Bad(start, "f-string: invalid syntax") from e

    def parenthesis(self):
        self.at += 1
        if self.op(")"):
            return []
        if self.peek("yield"):
            kind = self.yield_()
            self.need(")")
            return kind
        at = self.at
        first = self.star_or(walrus=True)
        if self.peek("for") or self.peek("async"):
            if first in (STARRED, GROUP):
                raise self.bad("iterable unpacking cannot be used in comprehension", at)
            self.comprehension()
            self.need(")")
            return PLAIN
        if not self.peek(","):
            if self.words[at] == "*" and self.kinds[at] == OP:
                raise self.bad("cannot use starred expression here", at)
            self.need(")")
            return first
        kinds = [first]
        while self.op(","):
            if self.peek(")"):
                break
            kinds.append(self.star_or(walrus=True))
        self.need(")")
        return kinds

    def list_(self):
        self.at += 1
        kinds = []
        while not self.peek("]"):
            at = self.at
            kinds.append(self.star_or(walrus=True))
            if len(kinds) == 1 and (self.peek("for") or self.peek("async")):
                if kinds[0] in (STARRED, GROUP):
                    raise self.bad("iterable unpacking cannot be used in comprehension", at)
                self.comprehension()
                self.need("]")
                return PLAIN
            if not self.op(","):
                break
        self.need("]")
        return kinds

    def braces(self):
        self.at += 1
        is_dict = None
        count = 0
        while not self.peek("}"):
            at = self.at
            if self.op("**"):
                if is_dict is False:
                    raise self.bad(at=at)
                self.binary(5)
                is_dict = True
            else:
                starred = self.peek("*")
                self.star_or(walrus=True)
                if self.op(":"):
                    if is_dict is False or starred:
                        raise self.bad(at=at)
                    is_dict = True
                    self.expression()
                else:
                    if is_dict:
                        raise self.bad("':' expected after dictionary key")
                    is_dict = False
                if not count and (self.peek("for") or self.peek("async")):
                    if starred:
                        raise self.bad("iterable unpacking cannot be used in comprehension", at)
                    self.comprehension()
                    self.need("}")
                    return PLAIN
            count += 1
            if not self.op(","):
                break
        self.need("}")
        return PLAIN


_COMPOUND = {
    "if": Parser.if_,
    "while": Parser.while_,
    "for": Parser.for_,
    "try": Parser.try_,
    "with": Parser.with_,
    "def": Parser.def_,
    "class": Parser.class_,
    "async": Parser.async_,
}
_SIMPLE = {
    "pass": lambda p: None,
    "break": lambda p: None,
    "continue": lambda p: None,
    "return": Parser.return_,
    "raise": Parser.raise_,
    "assert": Parser.assert_,
    "del": Parser.del_,
    "global": Parser.names_,
    "nonlocal": Parser.names_,
    "import": Parser.import_,
    "from": Parser.from_,
}


@any_depth
def problems(text: str, tokens: Tokens | None = None) -> list[Problem]:
    """All syntax errors in the order of the text."""
    return Parser(text, tokens).file()
