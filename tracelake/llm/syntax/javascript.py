"""JavaScript (scripts and modules): statements by recursive descent, expressions by precedence climbing.

Whether a slash begins a regular expression depends on the grammar, so tokens are read as the parser asks for them.
"""

from __future__ import annotations

import re

from tracelake.llm.syntax.common import Bad, Problem, any_depth

NAME, NUMBER, STRING, TEMPLATE, REGEX, OP, PRIVATE, END = range(8)
#: Reserved words that are no identifiers anywhere.
RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else export extends false finally for function if "
    "import in instanceof new null return super switch this throw true try typeof var void while with enum".split()
)
_LINE_REST = re.compile(r"[^\n\r\u2028\u2029]*")
_SPACE = re.compile(r"(?:[\s\ufeff]|(?://|<!--)[^\n\r\u2028\u2029]*|/\*(?:[^*]|\*(?!/))*\*/)*")
_OPERATORS = (
    r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[-{}()\[\];,<>+*/%&|^!~?:=.@]"
)
_N = r"\d(?:_?\d)*"
_TOKEN = re.compile(
    rf"(?P<name>(?:[^\W\d]|[$_]|\\u(?:[0-9a-fA-F]{{4}}|\{{[0-9a-fA-F]+\}}))(?:[\w$\u200c\u200d]|\\u(?:[0-9a-fA-F]{{4}}|\{{[0-9a-fA-F]+\}}))*)"
    rf"|(?P<number>0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[oO][0-7](?:_?[0-7])*n?|0[bB][01](?:_?[01])*n?|0\d+(?![.\deE])|{_N}n|(?:{_N}(?:\.(?:{_N})?)?|\.{_N})(?:[eE][-+]?{_N})?)"
    r"|(?P<string>\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*')"
    rf"|(?P<private>\#[^\W\d][\w$]*|\#[$_][\w$]*)|(?P<op>{_OPERATORS})"
)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/(?P<flags>[\w$]*)")
_BAD_ESCAPE = re.compile(r"\\(?:x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4}|\{[0-9a-fA-F]+\}))")
_KIND = {"name": NAME, "number": NUMBER, "string": STRING, "private": PRIVATE, "op": OP}

_POWER = {
    "??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8,
    "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12,
}
_ASSIGN = frozenset(["=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="])
_PREFIX = frozenset(["!", "~", "+", "-", "typeof", "void", "delete"])
#: Kinds of expressions: a simple target, an object or array literal (may become a pattern), anything else.
TARGET, PATTERN, OTHER, ARROW = range(4)


class Parser:
    def __init__(self, text: str):
        self.text = text
        self.problems: list[Bad] = []
        self.cover: int | None = None  # where an object literal holds what only a pattern may, as in {a = 1}
        self.function = 0
        self.generator = False
        self.asynchronous = True  # top-level await is valid in modules
        self.labels: list[str] = []
        self.root = ""  # the operator of the latest binary expression without parentheses
        self.end = self.start = 0
        if text.startswith("#!"):
            self.end = len(text) if "\n" not in text else text.index("\n")
        self.kind, self.word, self.newline, self.last_end = END, "", False, 0
        self.next()

    # Tokens

    def next(self) -> None:
        self.last_end = self.end
        m = _SPACE.match(self.text, self.end)
        gap = self.text[self.end : m.end()]
        self.newline = any(c in gap for c in "\n\r\u2028\u2029")
        self.start = m.end()
        while (self.newline or not self.text[: self.start].strip()) and self.text.startswith("-->", self.start):
            m = _SPACE.match(self.text, _LINE_REST.match(self.text, self.start).end())
            self.start = m.end()
        if self.start >= len(self.text):
            self.kind, self.word, self.end = END, "", self.start
            return
        t = _TOKEN.match(self.text, self.start)
        if not t:
            if self.text[self.start] == "`":
                self.kind, self.word, self.end = TEMPLATE, "`", self.start + 1
                return
            c = self.text[self.start]
            self.kind, self.word, self.end = OP, "\0", self.start + 1
            if c in "\"'":
                self.end = min(x for x in (self.text.find("\n", self.start), len(self.text)) if x >= 0)
                raise Bad(self.start, "unterminated string")
            if self.text.startswith("/*", self.start):
                self.end = len(self.text)
                raise Bad(self.start, "unterminated comment")
            raise Bad(self.start, "invalid character")
        self.kind, self.word, self.end = _KIND[t.lastgroup], t.group(), t.end()
        if self.kind == OP and self.word == "/" and self.text.startswith("/*", self.start):
            self.end = len(self.text)
            raise Bad(self.start, "unterminated comment")
        if self.kind == NUMBER and self.text[self.end : self.end + 1] and (self.text[self.end].isalnum() or self.text[self.end] in "$_\\"):
            raise Bad(self.start, "invalid number")
        if self.kind == STRING and "\\" in self.word and _BAD_ESCAPE.search(self.word.replace("\\\\", "")):
            raise Bad(self.start, "malformed escape in a string")

    def state(self) -> tuple:
        return self.kind, self.word, self.newline, self.start, self.end, self.last_end, self.cover

    def restore(self, s: tuple) -> None:
        self.kind, self.word, self.newline, self.start, self.end, self.last_end, self.cover = s

    def is_(self, word: str) -> bool:
        return self.word == word and (self.kind == OP or self.kind == NAME)

    def take(self, word: str) -> bool:
        if self.is_(word):
            self.next()
            return True
        return False

    def need(self, word: str) -> None:
        if not self.take(word):
            raise self.bad(f"expected '{word}'")

    def bad(self, message: str = "unexpected token") -> Bad:
        return Bad(self.start, message)

    def identifier(self) -> str:
        w = self.word
        if self.kind != NAME or w in RESERVED or (w == "yield" and self.generator) or (w == "await" and self.asynchronous and self.function):
            raise self.bad("expected an identifier")
        self.next()
        return w

    def semicolon(self) -> None:
        if self.take(";") or self.is_("}") or self.kind == END or self.newline:
            return
        raise self.bad("expected ';'")

    def peek(self) -> tuple[int, str, bool]:
        s = self.state()
        try:
            self.next()
            return self.kind, self.word, self.newline
        except Bad:
            return OP, "\0", False
        finally:
            self.restore(s)

    # Statements

    def file(self) -> list[Problem]:
        while self.kind != END:
            if self.is_("}"):
                self.problems.append(self.bad("unexpected '}'"))
                self.skip()
            else:
                self.guarded()
        return [Problem(e.pos, e.message) for e in self.problems]

    def skip(self) -> None:
        while True:
            try:
                self.next()
                return
            except Bad:
                self.end = max(self.end, self.start + 1)

    def guarded(self) -> None:
        """One statement; after an error the parser goes on behind the next ';' or line that starts a statement."""
        try:
            self.statement(declarations=True)
        except Bad as e:
            self.cover = None
            if self.kind != END or not self.problems:
                self.problems.append(e)
            depth = 0
            while True:
                self.skip()
                if self.kind == END or (not depth and (self.is_("}") or self.newline)):
                    return
                if self.is_("{"):
                    depth += 1
                elif self.is_("}"):
                    depth -= 1
                elif self.is_(";") and not depth:
                    self.skip()
                    return

    def block(self) -> None:
        self.need("{")
        self.statements()

    def statements(self) -> None:
        while not self.is_("}"):
            if self.kind == END:
                raise self.bad("expected '}'")
            self.guarded()
        self.next()

    def statement(self, declarations: bool = False) -> None:
        w = self.word
        if self.kind == NAME:
            f = _STATEMENTS.get(w)
            if f:
                f(self)
                return
            if w in ("const", "class") or (w == "let" and self.let_follows()):
                if not declarations:
                    raise self.bad("declaration is not allowed here")
                if w == "class":
                    self.next()
                    self.class_(named=True)
                else:
                    self.next()
                    self.variables(w)
                    self.semicolon()
                return
            if w == "function":
                self.next()
                self.function_(named=True)
                return
            if w == "async":
                k, x, newline = self.peek()
                if k == NAME and x == "function" and not newline:
                    self.next()
                    self.next()
                    self.function_(named=True, asynchronous=True)
                    return
            if w == "import":
                k, x, _ = self.peek()
                if not (k == OP and x in ("(", ".")):
                    self.import_()
                    return
            if w == "export":
                self.export_()
                return
            if w not in RESERVED:
                k, x, _ = self.peek()
                if k == OP and x == ":":
                    self.identifier()
                    self.next()
                    self.statement()
                    return
        elif self.is_("{"):
            self.block()
            return
        elif self.take(";"):
            return
        elif self.is_("@"):
            self.decorators()
            self.statement(declarations)
            return
        self.expression()
        if self.cover is not None:
            at, self.cover = self.cover, None
            raise Bad(at, "invalid shorthand property initializer")
        self.semicolon()

    def let_follows(self) -> bool:
        k, w, _ = self.peek()
        return (k == NAME and w not in ("in", "instanceof")) or (k == OP and w in ("[", "{"))

    def decorators(self) -> None:
        while self.take("@"):
            self.left_hand()

    def variables(self, kind: str, in_for: bool = False) -> None:
        while True:
            pattern = self.is_("[") or self.is_("{")
            self.binding()
            if self.take("="):
                self.whole_assignment(no_in=in_for)
            elif (pattern or kind == "const") and not (in_for and (self.is_("of") or self.is_("in"))):
                raise self.bad("missing initializer in a declaration")
            if not self.take(","):
                return

    def binding(self) -> None:
        if self.take("["):
            while not self.is_("]"):
                if self.take(","):
                    continue
                rest = self.take("...")
                self.binding()
                if not rest and self.take("="):
                    self.assignment()
                if not self.is_("]"):
                    if rest:
                        raise self.bad("rest element must be last")
                    self.need(",")
            self.next()
        elif self.take("{"):
            while not self.is_("}"):
                if self.take("..."):
                    self.identifier()
                else:
                    simple = self.property_name()
                    if self.take(":"):
                        self.binding()
                    elif not simple:
                        raise self.bad("expected ':'")
                    if self.take("="):
                        self.assignment()
                if not self.is_("}"):
                    self.need(",")
            self.next()
        else:
            self.identifier()

    def property_name(self) -> bool:
        """True if the name can stand for a variable too."""
        if self.take("["):
            self.assignment()
            self.need("]")
            return False
        if self.kind not in (NAME, STRING, NUMBER, PRIVATE):
            raise self.bad("expected a property name")
        simple = self.kind == NAME and self.word not in RESERVED
        self.next()
        return simple

    def if_(self) -> None:
        self.next()
        self.condition()
        self.statement()
        if self.take("else"):
            self.statement()

    def condition(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def while_(self) -> None:
        self.next()
        self.condition()
        self.statement()

    def do_(self) -> None:
        self.next()
        self.statement()
        self.need("while")
        self.condition()
        self.take(";")

    def for_(self) -> None:
        self.next()
        self.take("await")
        self.need("(")
        if self.is_(";"):
            pass
        else:
            if self.is_("var") or self.is_("const") or (self.is_("let") and self.let_follows()):
                kind = self.word
                self.next()
                self.variables(kind, in_for=True)
                target = True
            else:
                target = self.expression(no_in=True) in (TARGET, PATTERN)
            if target and (self.is_("of") or self.is_("in")):
                self.cover = None
                of = self.is_("of")
                self.next()
                if of:
                    self.assignment()
                else:
                    self.expression()
                self.need(")")
                self.statement()
                return
        self.need(";")
        if not self.is_(";"):
            self.expression()
        self.need(";")
        if not self.is_(")"):
            self.expression()
        self.need(")")
        self.statement()

    def switch_(self) -> None:
        self.next()
        self.condition()
        self.need("{")
        while not self.take("}"):
            if self.take("case"):
                self.expression()
            elif not self.take("default"):
                raise self.bad("expected 'case' or 'default'")
            self.need(":")
            while not (self.is_("case") or self.is_("default") or self.is_("}")):
                if self.kind == END:
                    raise self.bad("expected '}'")
                self.guarded()

    def try_(self) -> None:
        self.next()
        self.block()
        caught = self.take("catch")
        if caught:
            if self.take("("):
                self.binding()
                self.need(")")
            self.block()
        if self.take("finally"):
            self.block()
        elif not caught:
            raise self.bad("missing catch or finally after try")

    def return_(self) -> None:
        self.next()
        if not (self.is_(";") or self.is_("}") or self.kind == END or self.newline):
            self.expression()
        self.semicolon()

    def throw_(self) -> None:
        self.next()
        if self.newline:
            raise self.bad("illegal newline after throw")
        self.expression()
        self.semicolon()

    def jump_(self) -> None:
        self.next()
        if self.kind == NAME and not self.newline:
            self.identifier()
        self.semicolon()

    def var_(self) -> None:
        self.next()
        self.variables("var")
        self.semicolon()

    def debugger_(self) -> None:
        self.next()
        self.semicolon()

    def import_(self) -> None:
        self.next()
        if self.kind != STRING:
            more = True
            if self.kind == NAME:
                self.identifier()
                more = self.take(",")
            if more:
                if self.take("*"):
                    self.need("as")
                    self.identifier()
                else:
                    self.specifiers()
            self.need("from")
        self.string_()
        if self.is_("with") or self.is_("assert"):
            self.next()
            self.object_()
        self.semicolon()

    def string_(self) -> None:
        if self.kind != STRING:
            raise self.bad("expected a string")
        self.next()

    def specifiers(self) -> None:
        self.need("{")
        while not self.take("}"):
            if self.kind not in (NAME, STRING):
                raise self.bad()
            self.next()
            if self.take("as"):
                if self.kind not in (NAME, STRING):
                    raise self.bad()
                self.next()
            if not self.is_("}"):
                self.need(",")

    def export_(self) -> None:
        self.next()
        if self.take("*"):
            if self.take("as"):
                self.next()
            self.need("from")
            self.string_()
            self.semicolon()
        elif self.is_("{"):
            self.specifiers()
            if self.take("from"):
                self.string_()
            self.semicolon()
        elif self.take("default"):
            if self.take("function"):
                self.function_(named=False)
            elif self.take("class"):
                self.class_(named=False)
            elif self.is_("async") and self.peek()[1] == "function":
                self.next()
                self.next()
                self.function_(named=False, asynchronous=True)
            else:
                self.assignment()
                self.semicolon()
        elif self.kind == NAME and self.word in ("var", "let", "const", "function", "class", "async"):
            self.statement(declarations=True)
        else:
            raise self.bad()

    # Functions and classes

    def function_(self, named: bool, asynchronous: bool = False) -> None:
        generator = self.take("*")
        if self.kind == NAME and not self.is_("("):
            self.identifier()
        elif named:
            raise self.bad("expected a function name")
        self.signature(asynchronous, generator)

    def signature(self, asynchronous: bool, generator: bool) -> None:
        outer = self.asynchronous, self.generator
        self.asynchronous, self.generator = asynchronous, generator
        self.function += 1
        try:
            self.need("(")
            self.parameters()
            self.block()
        finally:
            self.function -= 1
            self.asynchronous, self.generator = outer

    def parameters(self) -> None:
        while not self.is_(")"):
            if self.take("..."):
                self.binding()
                break
            self.binding()
            if self.take("="):
                self.assignment()
            if not self.is_(")"):
                self.need(",")
        self.need(")")

    def class_(self, named: bool) -> None:
        if self.kind == NAME and not self.is_("extends"):
            self.identifier()
        elif named:
            raise self.bad("expected a class name")
        if self.take("extends"):
            self.left_hand()
        self.need("{")
        while not self.take("}"):
            if self.take(";"):
                continue
            self.decorators()
            self.member()

    def member(self) -> None:
        if self.is_("static"):
            k, w, _ = self.peek()
            if not (k == OP and w in ("(", "=", ";", "}")):
                self.next()
                if self.is_("{"):
                    self.block()
                    return
        asynchronous = generator = False
        accessor = False
        if self.is_("async"):
            k, w, newline = self.peek()
            if not newline and not (k == OP and w in ("(", "=", ";", "}")):
                self.next()
                asynchronous = True
        if self.take("*"):
            generator = True
        elif (self.is_("get") or self.is_("set")) and not asynchronous:
            k, w, _ = self.peek()
            if not (k == OP and w in ("(", "=", ";", "}")):
                self.next()
                accessor = True
        self.property_name()
        if self.is_("("):
            self.signature(asynchronous, generator)
        elif accessor or generator or asynchronous:
            raise self.bad("expected '('")
        else:
            if self.take("="):
                self.function += 1
                try:
                    self.assignment()
                finally:
                    self.function -= 1
            self.semicolon()

    # Expressions

    def expression(self, no_in: bool = False) -> int:
        kind = self.assignment(no_in)
        while self.take(","):
            self.assignment(no_in)
            kind = OTHER
        return kind

    def assignment(self, no_in: bool = False) -> int:
        if self.kind == NAME:
            if self.is_("yield") and self.generator:
                self.next()
                if not self.newline and (self.take("*") or not (self.kind == END or self.word in (")", "]", "}", ",", ";", ":", "in", "of"))):
                    self.assignment(no_in)
                return OTHER
            if self.is_("async"):
                k, w, newline = self.peek()
                if k == NAME and not newline and w not in RESERVED and w not in ("of",):
                    s = self.state()
                    self.next()
                    self.next()
                    if self.is_("=>"):
                        self.arrow_body(True, no_in)
                        return ARROW
                    self.restore(s)
                elif k == OP and w == "(" and not newline and self.arrow_ahead(after_async=True):
                    self.next()
                    self.arrow(True, no_in)
                    return ARROW
            elif self.word not in RESERVED:
                k, w, newline = self.peek()
                if k == OP and w == "=>" and not newline:
                    self.identifier()
                    self.arrow_body(False, no_in)
                    return ARROW
        elif self.is_("(") and self.arrow_ahead():
            self.arrow(False, no_in)
            return ARROW
        before, self.cover = self.cover, None
        at = self.start
        kind = self.conditional(no_in)
        if self.kind == OP and self.word in _ASSIGN:
            if kind == OTHER or kind == ARROW or (kind == PATTERN and self.word != "="):
                raise Bad(at, "invalid assignment target")
            self.cover = before
            self.next()
            self.whole_assignment(no_in)
            return OTHER
        if self.cover is None:
            self.cover = before
        if kind != PATTERN and self.cover is not None and before is None:
            raise Bad(self.cover, "invalid shorthand property initializer")
        return kind

    def arrow_ahead(self, after_async: bool = False) -> bool:
        """Whether the parenthesis here closes right before an arrow."""
        s = self.state()
        try:
            if after_async:
                self.next()
            self.next()
            self.parameters()
            return self.is_("=>") and not self.newline
        except Bad:
            return False
        finally:
            self.restore(s)

    def arrow(self, asynchronous: bool, no_in: bool) -> None:
        self.need("(")
        self.parameters()
        self.arrow_body(asynchronous, no_in)

    def arrow_body(self, asynchronous: bool, no_in: bool) -> None:
        self.need("=>")
        outer = self.asynchronous, self.generator
        self.asynchronous, self.generator = asynchronous, False
        self.function += 1
        try:
            if self.is_("{"):
                self.block()
            else:
                self.assignment(no_in)
        finally:
            self.function -= 1
            self.asynchronous, self.generator = outer

    def conditional(self, no_in: bool) -> int:
        kind = self.binary(1, no_in)
        if self.take("?"):
            self.assignment()
            self.need(":")
            self.assignment(no_in)
            return OTHER
        return kind

    def binary(self, least: int, no_in: bool = False) -> int:
        if self.kind == PRIVATE:
            self.next()
            if not self.is_("in"):
                raise self.bad()
            kind = OTHER
            root = self.root = ""
        else:
            signed = self.kind in (OP, NAME) and self.word in _PREFIX
            kind = self.unary()
            root = self.root = ""
            if signed and self.is_("**"):
                raise self.bad("unary operator before '**' needs parentheses")
        while self.kind in (OP, NAME):
            power = _POWER.get(self.word)
            if power is None or power < least or (no_in and self.word == "in"):
                return kind
            w, at = self.word, self.start
            self.next()
            self.binary(power if w == "**" else power + 1, no_in)
            if (w == "??" and {root, self.root} & {"||", "&&"}) or (w in ("||", "&&") and "??" in (root, self.root)):
                raise Bad(at, "'??' does not mix with '||' and '&&' without parentheses")
            root = self.root = w
            kind = OTHER
        return kind

    def unary(self) -> int:
        if self.kind in (OP, NAME):
            if self.word in _PREFIX:
                self.next()
                self.unary()
                return OTHER
            if self.word in ("++", "--"):
                self.next()
                at = self.start
                if self.unary() != TARGET:
                    raise Bad(at, "invalid increment operand")
                return OTHER
            if self.word == "await" and self.asynchronous:
                k, w, _ = self.peek()
                if self.function or not (k == OP and w in ("=", ".", ";", ",", ")", "=>")):
                    self.next()
                    self.unary()
                    return OTHER
        at = self.start
        kind = self.left_hand()
        if self.kind == OP and self.word in ("++", "--") and not self.newline:
            if kind != TARGET:
                raise Bad(at, "invalid increment operand")
            self.next()
            return OTHER
        return kind

    def left_hand(self) -> int:
        if self.is_("new"):
            kind = self.new_()
        else:
            kind = self.primary()
        chained = False
        while True:
            if self.kind == TEMPLATE:
                self.template()
                kind = OTHER
            elif self.kind != OP:
                return kind
            elif self.word == ".":
                self.next()
                if self.kind not in (NAME, PRIVATE):
                    raise self.bad("expected a property name")
                self.next()
                kind = OTHER if chained else TARGET
            elif self.word == "?.":
                self.next()
                chained = True
                kind = OTHER
                if self.kind in (NAME, PRIVATE):
                    self.next()
            elif self.word == "[":
                self.next()
                self.expression()
                self.need("]")
                kind = OTHER if chained else TARGET
            elif self.word == "(":
                self.next()
                self.arguments()
                kind = OTHER
            else:
                return kind

    def new_(self) -> int:
        self.next()
        if self.take("."):
            if not self.take("target"):
                raise self.bad()
            return OTHER
        if self.is_("new"):
            self.new_()
        else:
            if self.is_("import"):
                raise self.bad()
            self.primary()
            while True:
                if self.take("."):
                    if self.kind not in (NAME, PRIVATE):
                        raise self.bad("expected a property name")
                    self.next()
                elif self.take("["):
                    self.expression()
                    self.need("]")
                elif self.kind == TEMPLATE:
                    self.template()
                else:
                    break
            if self.is_("?."):
                raise self.bad("an optional chain can't be constructed")
        if self.take("("):
            self.arguments()
        return OTHER

    def arguments(self) -> None:
        while not self.is_(")"):
            self.take("...")
            self.whole_assignment()
            if not self.is_(")"):
                self.need(",")
        self.next()

    def whole_assignment(self, no_in: bool = False) -> None:
        """An assignment expression that can't turn into a pattern later."""
        before, self.cover = self.cover, None
        self.assignment(no_in)
        if self.cover is not None:
            raise Bad(self.cover, "invalid shorthand property initializer")
        self.cover = before

    def primary(self) -> int:
        k, w = self.kind, self.word
        if k == NAME:
            if w in ("this", "null", "true", "false"):
                self.next()
                return OTHER
            if w == "function":
                self.next()
                self.function_(named=False)
                return OTHER
            if w == "class":
                self.next()
                self.class_(named=False)
                return OTHER
            if w == "async":
                k2, w2, newline = self.peek()
                if k2 == NAME and w2 == "function" and not newline:
                    self.next()
                    self.next()
                    self.function_(named=False, asynchronous=True)
                    return OTHER
            if w == "super":
                self.next()
                if not (self.is_(".") or self.is_("[") or self.is_("(")):
                    raise self.bad("unexpected 'super'")
                return OTHER
            if w == "import":
                self.next()
                if self.take("."):
                    self.identifier()
                elif not self.is_("("):
                    raise self.bad()
                return OTHER
            self.identifier()
            return TARGET
        if k in (NUMBER, STRING):
            self.next()
            return OTHER
        if k == TEMPLATE:
            self.template()
            return OTHER
        if k == OP:
            if w == "(":
                self.next()
                kind = self.expression()
                if self.cover is not None:
                    raise Bad(self.cover, "invalid shorthand property initializer")
                self.need(")")
                return TARGET if kind == TARGET else OTHER
            if w == "[":
                self.next()
                while not self.is_("]"):
                    if self.take(","):
                        continue
                    self.take("...")
                    self.assignment()
                    if not self.is_("]"):
                        self.need(",")
                self.next()
                return PATTERN
            if w == "{":
                self.object_()
                return PATTERN
            if w in ("/", "/="):
                self.regex()
                return OTHER
            if w == "@":
                self.decorators()
                self.need("class")
                self.class_(named=False)
                return OTHER
        raise self.bad("unexpected end of input" if k == END else "unexpected token")

    def regex(self) -> None:
        m = _REGEX.match(self.text, self.start)
        if not m:
            raise self.bad("invalid regular expression")
        flags = m["flags"]
        if len(set(flags)) != len(flags) or set(flags) - set("dgimsuvy"):
            raise self.bad("invalid regular expression flags")
        depth, in_class, i, body = 0, False, 1, m.group()
        while i < len(body) - 1 - len(flags):
            c = body[i]
            if c == "\\":
                i += 1
            elif in_class:
                in_class = c != "]"
            elif c == "[":
                in_class = True
            elif c in "()":
                depth += 1 if c == "(" else -1
                if depth < 0:
                    break
            i += 1
        if depth:
            raise self.bad("unbalanced group in a regular expression")
        self.end = m.end()
        self.next()

    def template(self) -> None:
        """After the opening backtick."""
        start, pos, n = self.start, self.end, len(self.text)
        while pos < n:
            c = self.text[pos]
            if c == "\\":
                pos += 2
            elif c == "`":
                self.end = pos + 1
                self.next()
                return
            elif self.text.startswith("${", pos):
                self.end = pos + 2
                self.next()
                self.expression()
                if not self.is_("}"):
                    raise self.bad("expected '}' in a template")
                pos = self.end
            else:
                pos += 1
        self.end = n
        self.kind, self.word = END, ""
        raise Bad(start, "unterminated template")

    def object_(self) -> None:
        self.need("{")
        while not self.is_("}"):
            if self.take("..."):
                self.assignment()
            else:
                self.property_()
            if not self.is_("}"):
                self.need(",")
        self.next()

    def property_(self) -> None:
        asynchronous = generator = accessor = False
        if self.is_("async"):
            k, w, newline = self.peek()
            if not newline and not (k == OP and w in (",", ":", "(", "}", "=")):
                self.next()
                asynchronous = True
        if self.take("*"):
            generator = True
        elif (self.is_("get") or self.is_("set")) and not asynchronous:
            k, w, _ = self.peek()
            if not (k == OP and w in (",", ":", "(", "}", "=")):
                self.next()
                accessor = True
        simple = self.property_name()
        if self.is_("("):
            self.signature(asynchronous, generator)
        elif asynchronous or generator or accessor:
            raise self.bad("expected '('")
        elif self.take(":"):
            self.assignment()
        elif not simple:
            raise self.bad("expected ':'")
        elif self.is_("="):
            at = self.start
            self.next()
            self.assignment()
            if self.cover is None:
                self.cover = at


_STATEMENTS = {
    "if": Parser.if_,
    "while": Parser.while_,
    "do": Parser.do_,
    "for": Parser.for_,
    "switch": Parser.switch_,
    "try": Parser.try_,
    "return": Parser.return_,
    "throw": Parser.throw_,
    "break": Parser.jump_,
    "continue": Parser.jump_,
    "var": Parser.var_,
    "debugger": Parser.debugger_,
    "with": Parser.while_,
}


@any_depth
def js_problems(text: str) -> list[Problem]:
    """All syntax errors in the order of the text."""
    try:
        return Parser(text).file()
    except Bad as e:
        return [Problem(e.pos, e.message)]
