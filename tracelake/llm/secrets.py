"""Credentials in source and configuration files: one automaton finds where one may begin, grammars tell whether it does.

Token formats, key armor, connection strings, URL parameters and authorisation schemes are one deterministic automaton. A
word automaton of their heads, and of names that hold credentials, runs over overlapping chunks of a text first; its hits
are merged by their absolute place, and the grammars are run on the whole text from there. What matches is a span, which
can be listed by line or replaced by a placeholder.
"""

from __future__ import annotations

import base64
import binascii
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.automaton import DIGITS, LETTERS, SPACES, UPPER, Automaton, Node, alt, any_case, any_of, none_of, rep, seq
from tracelake.llm.broken import one_per_file
from tracelake.llm.syntax.common import Lines

_ALNUM = LETTERS | DIGITS
_HEX = DIGITS | frozenset("abcdefABCDEF")
_B64 = _ALNUM | frozenset("_-")


def _token(head: str, chars: frozenset, least: int, most: int | None = None) -> Node:
    return seq(head, rep(any_of(chars), least, most))


#: Heads and bodies of public token formats.
TOKEN_FORMATS = {
    "ghp_": _token("ghp_", _ALNUM, 36),
    "gho_": _token("gho_", _ALNUM, 36),
    "ghu_": _token("ghu_", _ALNUM, 36),
    "ghs_": _token("ghs_", _ALNUM, 36),
    "ghr_": _token("ghr_", _ALNUM, 36),
    "github_pat_": _token("github_pat_", _ALNUM | {"_"}, 50),
    "glpat-": _token("glpat-", _B64, 20),
    "sk_live_": _token("sk_live_", _ALNUM, 16),
    "sk_test_": _token("sk_test_", _ALNUM, 16),
    "rk_live_": _token("rk_live_", _ALNUM, 16),
    "xoxb-": _token("xoxb-", _ALNUM | {"-"}, 20),
    "xoxp-": _token("xoxp-", _ALNUM | {"-"}, 20),
    "xoxa-": _token("xoxa-", _ALNUM | {"-"}, 20),
    "xoxr-": _token("xoxr-", _ALNUM | {"-"}, 20),
    "xoxs-": _token("xoxs-", _ALNUM | {"-"}, 20),
    "akia": _token("AKIA", UPPER | DIGITS, 16, 16),
    "asia": _token("ASIA", UPPER | DIGITS, 16, 16),
    "aiza": _token("AIza", _B64, 35),
    "sg.": seq("SG.", rep(any_of(_B64), 16), ".", rep(any_of(_B64), 16)),
    "npm_": _token("npm_", _ALNUM, 36),
    "pypi-": _token("pypi-", _B64, 50),
    "hf_": _token("hf_", _ALNUM, 30),
    "dop_v1_": _token("dop_v1_", DIGITS | frozenset("abcdef"), 64),
    "shpat_": _token("shpat_", _HEX, 32),
    "ya29.": _token("ya29.", _B64, 20),
    "eyj": seq("eyJ", rep(any_of(_B64), 8), ".eyJ", rep(any_of(_B64), 8), ".", rep(any_of(_B64), 16)),
}
ARMOR = "-----begin "
LINK = "://"
SCHEMES = ("bearer", "basic", "identified", "mysql ", "mysqldump ", "sshpass", "curl ", "machine", "default")
NAMES = ("passw", "passphrase", "pwd", "pass", "secret", "token", "key", "credential")

#: Names of URL parameters that hold credentials.
PARAMETERS = ("access_token", "api_key", "api-key", "apikey", "token", "key", "sig", "signature", "secret", "client_secret", "password", "passwd", "pwd", "auth", "x-amz-signature", "code")
_HIDDEN = seq("<", rep(none_of("<>", SPACES), 1), ">")
_GAP = rep(any_of(SPACES), 1)
_WORD = rep(none_of(SPACES, "\"'"), 1)
_QUOTED = alt(_WORD, seq("'", _WORD, "'"), seq('"', _WORD, '"'))
_COMMAND = rep(none_of("\n|;&"))
#: Everything with a form of its own, as one automaton.
GRAMMAR = Automaton(
    {
        "token": alt(*TOKEN_FORMATS.values()),
        "private-key": seq("-----BEGIN ", rep(seq(rep(any_of(UPPER, DIGITS), 1), " ")), "PRIVATE KEY", rep(" BLOCK", 0, 1), "-----"),
        "connection-string": seq("://", rep(none_of(SPACES, "/:@\"'<>\\")), ":", alt(rep(none_of(SPACES, "/\"'<>\\"), 1), _HIDDEN), "@"),
        "url-parameter": seq(any_of("?&"), alt(*map(any_case, PARAMETERS)), "=", alt(rep(none_of(SPACES, "&\"'<>#\\"), 1), _HIDDEN)),
        "bearer": seq(any_case("bearer"), rep(any_of(SPACES), 1), rep(any_of(_B64, ".~+/="), 12)),
        "basic": seq(any_case("basic"), rep(any_of(SPACES), 1), rep(any_of(_ALNUM, "+/"), 8), rep("=", 0, 2)),
        "identified-by": seq(
            any_case("identified"), _GAP, rep(seq(any_case("with"), _GAP, rep(none_of(SPACES), 1), _GAP), 0, 1), any_case("by"), _GAP, rep(seq(any_case("password"), _GAP), 0, 1),
            alt(seq("'", rep(none_of("'\"\n\\"), 1), "'"), seq('"', rep(none_of("'\"\n\\"), 1), '"'), seq("\\'", rep(none_of("'\"\n\\"), 1), "\\'"), seq('\\"', rep(none_of("'\"\n\\"), 1), '\\"')),
        ),
        "mysql": seq(any_case("mysql"), rep(any_case("dump"), 0, 1), any_of(" \t"), _COMMAND, any_of(" \t"), "-p", _QUOTED),
        "sshpass": seq(any_case("sshpass"), rep(any_of(" \t"), 1), "-p", rep(any_of(" \t")), _QUOTED),
        "curl": seq(any_case("curl"), any_of(" \t"), _COMMAND, any_of(" \t"), alt("-u", "--user"), rep(any_of(" ="), 0, 1), rep(any_of("'\""), 0, 1), rep(none_of(SPACES, ":'\""), 1), ":", _WORD),
        "netrc": seq(alt(seq(any_case("machine"), _GAP, rep(none_of(SPACES), 1)), any_case("default")), _GAP, any_case("login"), _GAP, rep(none_of(SPACES), 1), _GAP, any_case("password"), _GAP, _WORD),
    }
)
#: Where the value stands at the end of what these rules match.
_TAIL = {
    "identified-by": re.compile(r"(?P<value>[^'\"\\]+)\\?['\"]$"),
    "mysql": re.compile(r"(?P<value>[^\s'\"]+)['\"]?$"),
    "sshpass": re.compile(r"(?P<value>[^\s'\"]+)['\"]?$"),
    "curl": re.compile(r"(?P<value>[^\s:'\"]+)$"),
    "netrc": re.compile(r"(?P<value>\S+)$"),
}
#: What a key block holds inside a literal or a text, and what stands between the literals of one in pieces.
_KEY_TEXT = re.compile(
    r"(?P<foot>-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----)|(?P<head>[A-Za-z]+(?:-[A-Za-z]+)*:[ \t][^\r\n\"'`\\]*)"
    r"|(?P<body>[A-Za-z0-9+/]+={0,2})(?=[ \t]*(?:\\+[rn]|\\?\r?\n|\\*[\"'`]|-----END|$))|\\+[rn]|\\?\r?\n[ \t]*(?:#+|//+|\*|;)?[ \t]*|[ \t]+"
)
_KEY_JOIN = re.compile(r"[\s+,.&]+|\\\r?\n|[A-Za-z@$]{1,2}(?=\\?[\"'`])")
_KEY_QUOTE = re.compile(r"\\*[\"'`]")
_SPEECH = re.compile(r"(?:[ \t]+[\w()'-]+)*")
_SAID = re.compile(r"[ \t]*(?:[:=]|\bis\b)[ \t]+(?P<q>[\"'`]?)(?P<value>[^\s\"'`]+)(?P=q)[ \t.]*\r?$", re.M)
_MARKS = re.compile(r"\\.|[\"'`(#;]|//|/\*|<!--", re.S)

_IDENT = re.compile(r"[A-Za-z0-9_.-]*")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
_ONE = frozenset("password passwd passwort pwd pass passphrase passcode secret secrets token credential credentials apikey authtoken accesstoken accesskey secretkey privatekey authkey pgpassword userpass dbpass".split())
_KEYED = frozenset("api secret signing private access encryption encrypt master deploy auth account storage shared session service webhook ssh gpg license hmac jwt app client admin consumer crypt aes".split())
_CLOSE = re.compile(r"(?P<quote>\\?[\"'])?(?P<bracket>\])?[ \t]*")
_ANNOTATION = re.compile(r":[ \t]*[A-Za-z_][\w.\[\], |]*?[ \t]*(?==[^=])")
_SEPARATOR = re.compile(r"(?::=|=>|->|(?<![=!<>])=(?!=)|:(?!:))[ \t]*")
_LITERAL = re.compile(
    r"(?P<prefix>[A-Za-z]{0,2})(?:(?P<long>\"\"\"|\'\'\'|`)(?P<text>(?:(?!(?P=long))(?:\\.|[^\\]))*?)(?P=long)|(?P<short>\\\"|\"|\')(?P<line>(?:(?!(?P=short))(?:\\[^\n]|[^\\\n]))*?)(?P=short))", re.S
)
_DECODERS = re.compile(r"(?:[\w.]+\.)?(?P<how>b64decode|urlsafe_b64decode|standard_b64decode|atob|fromhex|unhexlify|b32decode|SecretStr|quote|encode|Buffer\.from|bytes|str)\(\s*", re.I)
_DEFAULT = re.compile(r"\s*,\s*(?:default\s*=\s*)?(?=[A-Za-z]{0,2}[\"'])|[^()\n]*?\bdefault\s*=\s*(?=[A-Za-z]{0,2}[\"'])")
_FALLBACK = re.compile(r"[^\n'\";{}]*?(?:\|\||\?\?|\bor\b)\s*(?=[\"'])")
_JOIN = re.compile(r"\s*(?:\+|\.|\\\r?\n)?\s*(?=[A-Za-z]{0,2}[\"'])")
_SHELL_DEFAULT = re.compile(r"\$\{[A-Za-z_]\w*:?[-=](?P<value>[^}]*)\}")
_BARE = re.compile(r"[^\s\"'`,;]\S*")
_BLOCK = re.compile(r"[|>][-+0-9]*[ \t]*(?:#[^\n]*)?\r?\n(?P<lead>\s+)(?P<value>\S+)")

#: Names whose values are passwords, which may be short or a plain word.
_PASSWORDS = frozenset("password passwd passwort pwd pass passphrase passcode pgpassword userpass dbpass".split())
_PLACEHOLDERS = frozenset(
    "changeme changeit change replaceme replace todo tbd fixme none null nil undefined true false yes no on off empty default test testing secret password passwd pwd pass token key apikey value string str int text example sample placeholder redacted masked hidden removed dummy fake foo bar foobar foobarbaz setme insert fillme fillin user username admin root guest anonymous optional required unknown notset unset missing xxx abc abcdef enter confirm confirmation invalid incorrect wrong mandatory forgotten forgot input field label visible plain plaintext encrypted hashed hash prompt stdin keyring vault environment variable literal object number boolean function return returns reset update create delete login signin signup submit username email word phrase qwerty letters placeholder credential credentials".split()
)
_REFERENCE = re.compile(
    r"\$\{|\$\(|^\$[A-Za-z_]\w*$|\{\{|^\{[^{}]*\}$|^%\(?\w*\)?[sd]?$|^<.*>$|^\[.*\]$|^%[A-Za-z_]\w*%$|^@\w+|^(?:env|vault|secret|secrets|ssm|arn|op|gcp|aws|azure|keyring|file|ref|kms|awssm|sops|https?)(?::|://)|^(?:process\.env|os\.environ|settings|config|env|secrets|vars)\.|^ENC\[|^!|^projects/\S+/secrets/",
    re.I,
)
_MOCK = re.compile(r"example|placeholder|redacted|change[-_ ]?me|replace[-_ ]?me|set[-_ ]?me|your[-_ ]|dummy|insert[-_ ]|<your|fill[-_ ]?(?:me|in)|not[-_ ]?a[-_ ]?real|xxxx|\*\*\*", re.I)
_DIGEST = re.compile(r"^(?:\$(?:2[abxy]|argon2\w*|pbkdf2\S*|scrypt|apr1|[156]|y|7)\$|\{(?:S?SHA\d*|CRYPT|MD5)\}|(?:sha\d+|md5|pbkdf2|scrypt|bcrypt|argon2\w*)[-:$_])", re.I)
_PATH = re.compile(r"^(?:\.{0,2}/|~/|[A-Za-z]:\\)(?:[a-z0-9_.-]+/)*[a-z0-9_.-]*$")
_CODE_FILES = frozenset(["py", "pyi", "pyw", "js", "jsx", "ts", "tsx", "mjs", "go", "java", "rb", "c", "h", "cpp", "rs", "cs", "php", "json"])


class Span(NamedTuple):
    start: int
    end: int
    rule: str
    #: Where the text of each literal stands, for a value in pieces.
    pieces: tuple[tuple[int, int], ...] = ()


@lru_cache(maxsize=1)
def heads_automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, heads in (("token", TOKEN_FORMATS), ("armor", (ARMOR,)), ("link", (LINK, "?", "&")), ("scheme", SCHEMES), ("name", NAMES)):
        for h in heads:
            a.add_word(h, (kind, h))
    a.make_automaton()
    return a


#: Characters of a chunk, and how far chunks reach into the next one (more than the longest head has).
CHUNK, OVERLAP = 1 << 16, 64


def _fold(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if c.isascii() else c for c in text)


def hits(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, str, str]]:
    """(start, kind, head) of every head, in the order of the text; the same whatever the chunks."""
    found = set()
    a = heads_automaton()
    low = _fold(text)
    for base in range(0, max(len(low), 1), chunk):
        for end, (kind, head) in a.iter(low[base : base + chunk + overlap]):
            found.add((base + end + 1 - len(head), kind, head))
    return sorted(found)


# What a value is


def words_of_name(name: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", _CAMEL.sub("_", name).lower()) if w]


def is_sensitive(name: str) -> bool:
    """Whether a name says that its value grants access; ``password_hash`` or ``api_key_header`` do not."""
    words = words_of_name(name)
    while words and words[-1].isdigit():
        words.pop()
    if not words:
        return False
    if words[-1] in _ONE or words[-1].rstrip("0123456789") in _ONE:
        return not (len(words) > 1 and words[-2] in ("no", "without", "forgot", "reset", "csrf", "public", "next", "page", "cancel", "continuation"))
    return words[-1] == "key" and len(words) > 1 and words[-2] in _KEYED


def grants_access(value: str, name: str = "", literal: bool = False) -> bool:
    """Whether a value is a credential and no placeholder, reference, digest, path or plain word.

    The literal of a password may be one plain word, and a password four characters long.
    """
    v = value.strip()
    password = bool(name) and not _PASSWORDS.isdisjoint(words_of_name(name)[-1:])
    short = password and len(v) >= 4 and not v.isalpha() and not v.replace(".", "").isdigit()
    if (len(v) < 6 and not short) or len(set(v)) <= 2 or any(c in v for c in "\n\r\0"):
        return False
    if _REFERENCE.search(v) or _MOCK.search(v) or _DIGEST.search(v) or _PATH.match(v):
        return False
    bare = re.sub(r"[^a-z0-9]", "", v.lower())
    if bare in _PLACEHOLDERS or not bare:
        return False
    if "-----BEGIN" in v or ("{" in v and "}" in v):
        return False
    if " " in v:
        return False
    if re.fullmatch(r"[a-z]+(?:[_-][a-z]+)*|[A-Z]+(?:[_-][A-Z]+)*|[A-Z][a-z]+(?:-[A-Z][a-z]+)*", v):
        if not (literal and password and v.isalpha() and v.islower()):
            return False  # plain words
    said = words_of_name(v)
    if name and said and set(said) <= set(words_of_name(name)):
        return False
    if re.fullmatch(r"[\d.]+", v):
        return bool(re.search("pass|pwd|pin", name, re.I)) and "." not in v
    return True


def _decoded(value: str, how: str) -> str | None:
    """The text inside an encoded literal, the literal itself where it is no text."""
    try:
        if "64" in how or how == "atob":
            raw = base64.b64decode(value + "=" * (-len(value) % 4), validate=True)
        elif how in ("fromhex", "unhexlify"):
            return value if len(bytes.fromhex(value)) >= 8 else None
        else:
            return value
        return raw.decode("utf-8") if raw else None
    except (ValueError, binascii.Error):
        return value


_KEY_NEXT = re.compile(r"\s*:")
_BLANK = re.compile(r"[ \t\r\f\v]*")


def _literal(text: str, at: int) -> dict | None:
    """The string literal at ``at``: prefix, quote, value, span of the value, end."""
    m = _LITERAL.match(text, at)
    if not m or m["prefix"].lower() not in ("", "r", "b", "f", "u", "br", "rb", "fr", "rf"):
        return None
    part = "text" if m["long"] else "line"
    return {"prefix": m["prefix"], "q": m["long"] or m["short"], "value": m[part], "span": m.span(part), "end": m.end()}


# Grammars


class _Scan:
    def __init__(self, text: str, path: str):
        self.text = text
        base = path.rsplit("/", 1)[-1]
        self.code = base.rsplit(".", 1)[-1].lower() in _CODE_FILES if "." in base else False
        self.script = base.rsplit(".", 1)[-1].lower() == "js"
        self.spans: dict[int, Span] = {}
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self.line = self.at = -1
        self.named_to = 0
        self.quote, self.said, self.paren = "", False, False

    def keep(self, start: int, end: int, rule: str, pieces: tuple[tuple[int, int], ...] = ()) -> None:
        old = self.spans.get(start)
        if old is None or old.end < end:
            self.spans[start] = Span(start, end, rule, pieces)

    def line_start(self, pos: int) -> int:
        n = bisect_left(self.breaks, pos)
        return self.breaks[n - 1] + 1 if n else 0

    def look(self, pos: int) -> None:
        """Brings ``quote`` (the quote open at ``pos`` on its line, or ''), ``said`` (whether ``pos`` lies in a comment) and
        ``paren`` (whether a parenthesis opened before it) up to ``pos``. Places mostly come in order, so that a line is read once."""
        start = self.line_start(pos)
        if start != self.line or pos < self.at:
            self.line = self.at = start
            self.quote, self.paren = "", False
            self.first = _BLANK.match(self.text, start).end()
            self.said = self.text.startswith(("*", "--"), self.first)
        text, at = self.text, self.at
        while not self.said:
            m = _MARKS.search(text, at, pos)
            if not m:
                break
            at, c, i = m.end(), m.group(), m.start()
            if c[0] == "\\":
                continue
            if self.quote:
                self.quote = "" if c == self.quote else self.quote
                at = i + 1
            elif c in "\"'`":
                self.quote = c
            elif c == "(":
                self.paren = True
            elif (c == "#" and not self.script) or (c == "//" and text[i - 1 : i] != ":") or c in ("/*", "<!--") or (c == ";" and not self.code and i == self.first):
                self.said = True
        held = pos - at - len(text[at:pos].rstrip("\\")) if pos > at else 0
        self.at = max(at, pos - held % 2)

    def run(self) -> list[Span]:
        for start, kind, _ in hits(self.text):
            if kind == "name":
                self.named(start)
            else:
                found = GRAMMAR.match(self.text, start)
                if found:
                    self.formal(start, *found)
        out: list[Span] = []
        for s in sorted(self.spans.values(), key=lambda s: (s.start, -s.end)):
            if out and s.start < out[-1].end:
                continue  # inside a span that begins before
            out.append(s)
        return out

    def formal(self, start: int, rule: str, end: int) -> None:
        """What the automaton matched: whether the value in it is a credential, and where that stands."""
        text = self.text
        body, following = text[start:end], text[end : end + 1]
        if rule == "token":
            before = text[start - 1 : start] if start else ""
            fixed = body[:4] in ("AKIA", "ASIA")
            if before.isalnum() or before == "_" or (fixed and following.isalnum()):
                return
            if not _MOCK.search(body) and len(set(body[4:])) > 4:
                self.keep(start, end, rule)
        elif rule == "private-key":
            self.key_block(start, end)
        elif rule == "connection-string":
            at = text.index(":", start + 3) + 1
            if (following.isalnum() or following in tuple("[$%{<_-")) and grants_access(text[at : end - 1]):
                self.keep(at, end - 1, rule)
        elif rule == "url-parameter":
            at = text.index("=", start) + 1
            if grants_access(text[at:end]):
                self.keep(at, end, rule)
        elif rule in _TAIL:
            m = _TAIL[rule].search(body[max(0, body.rfind(":" if rule == "curl" else " ")) :]) if rule in ("mysql", "sshpass", "curl") else _TAIL[rule].search(body)
            value = m["value"].removeprefix("-p") if rule in ("mysql", "sshpass") and m["value"].startswith("-p") else m["value"]
            at = end - (m.end() - m.start("value")) + len(m["value"]) - len(value)
            if grants_access(value, "password"):
                self.keep(at, at + len(value), rule)
        else:
            value = body.split(None, 1)[1]
            at = end - len(value)
            if following and (following.isalnum() or following in "{$<="):
                return
            if rule == "bearer" and not any(c.isdigit() for c in value):
                return
            if rule == "basic":
                try:
                    user, _, value = base64.b64decode(value, validate=True).decode("utf-8").partition(":")
                except (ValueError, binascii.Error):
                    return
                if not user or not value.isprintable():
                    return
            if grants_access(value):
                self.keep(at, end, rule)

    def key_block(self, start: int, at: int) -> None:
        """A key block as text, in a literal, or as several literals, joined or in an array; ``at`` is the end of its opening line.

        Its lines are what its pieces cover. Without a closing line it ends with its last long line and what pads that.
        """
        text = self.text
        pieces: list[list[int]] = []
        inside, merge, whole, long_ = True, False, False, 0
        while True:
            m = _KEY_QUOTE.match(text, at)
            if m:
                inside, merge = not inside, False
            else:
                m = (_KEY_TEXT if inside else _KEY_JOIN).match(text, at)
            if not m or m.end() == at:
                break
            at = m.end()
            if m.lastgroup == "foot":
                whole = True
                break
            if m.lastgroup == "head":
                merge = False
            elif m.lastgroup == "body":
                if merge:
                    pieces[-1][1] = at
                else:
                    pieces.append(list(m.span()))
                merge = True
                if at - m.start() >= 24 or (text[at - 1] == "=" and long_):
                    long_, kept = at, [list(p) for p in pieces]
        if not long_:
            return
        end = at if whole else long_
        pieces = pieces if whole else kept
        if not _MOCK.search("".join(text[a:b] for a, b in pieces)):
            self.keep(start, end, "private-key", tuple((a, b) for a, b in pieces))

    def named(self, start: int) -> None:
        text = self.text
        if start < self.named_to:
            return  # in a name that was seen
        left = start
        while left and (text[left - 1].isalnum() or text[left - 1] in "_.-"):
            left -= 1
        right = self.named_to = _IDENT.match(text, start).end()
        while right > start and text[right - 1] in ".-":
            right -= 1
        name = text[left:right].lstrip(".-")
        if not is_sensitive(name):
            return
        close = _CLOSE.match(text, right)
        at = close.end()
        if close["quote"]:
            default = _DEFAULT.match(text, close.end("quote"))
            self.look(left)
            if default and not close["bracket"] and self.paren:
                self.value(default.end(), name, literal_only=True)
                return
        annotation = _ANNOTATION.match(text, at)
        if annotation:
            at = annotation.end()
        separator = _SEPARATOR.match(text, at)
        self.look(left)
        in_comment = self.said
        inside = self.quote if not close["quote"] else ""
        if separator:
            tight = separator.group() in ("=", ":") and separator.start() == right
            if in_comment or not self.code or close["quote"] or not inside or tight:
                self.value(separator.end(), name, literal_only=self.code and not in_comment and not (inside and tight and separator.group() == "="))
            if in_comment:
                self.spoken(right, name)
        elif in_comment:
            self.spoken(right, name)
        elif text[left - 2 : left] == "--" or (left >= 2 and text[left : left + 2] == "--"):
            m = re.compile(r"[ \t]+(?P<q>['\"]?)(?P<value>[^\s'\"-][^\s'\"]*)(?P=q)").match(text, right)
            if m and grants_access(m["value"], name):
                self.keep(*m.span("value"), "argument")

    def spoken(self, at: int, name: str) -> None:
        m = _SAID.match(self.text, _SPEECH.match(self.text, at).end()) or _SAID.match(self.text, at)
        if not m:  # the verb is the last of the words
            words = _SPEECH.match(self.text, at)
            verb = words.group().rfind(" is")
            m = _SAID.match(self.text, at + verb) if verb >= 0 else None
        if m and grants_access(m["value"].rstrip(".,;"), name):
            self.keep(m.start("value"), m.start("value") + len(m["value"].rstrip(".,;")), "comment")

    def value(self, at: int, name: str, literal_only: bool) -> None:
        """The value that begins at ``at``: a literal, perhaps in pieces or encoded, or bare text in settings."""
        text = self.text
        how = ""
        while True:  # opening parentheses and decoders
            m = re.compile(r"[ \t]*\(\s*").match(text, at)
            if m:
                at = m.end()
                continue
            m = _DECODERS.match(text, at)
            if m:
                how, at = m["how"].lower(), m.end()
                continue
            break
        m = _literal(text, at)
        if m:
            pieces, end, inner = [m["value"]], m["end"], [m["span"]]
            formatted = "f" in m["prefix"].lower()
            while True:
                j = _JOIN.match(text, end)
                if not j or ("\n" in j.group() and not self.code):
                    break
                n = _literal(text, j.end())
                if not n or _KEY_NEXT.match(text, n["end"]):
                    break  # the next key of a mapping
                pieces.append(n["value"])
                inner.append(n["span"])
                end = n["end"]
            whole = "".join(pieces)
            if "-----BEGIN" in whole or (formatted and "{" in whole):
                return
            if "`" == m["q"] and "${" in whole:
                return
            shown = _decoded(whole, how)
            d = _SHELL_DEFAULT.fullmatch(whole)
            if d:
                shown = d["value"]
            if shown is not None and grants_access(shown.strip(), name, literal=True):
                lead = len(m["value"]) - len(m["value"].lstrip())
                inner[0] = (inner[0][0] + lead, inner[0][1])
                self.keep(inner[0][0], end - (len(m["q"]) if len(pieces) == 1 else 0), "assignment", tuple(inner) if len(pieces) > 1 else ())
            return
        if self.code:
            f = _FALLBACK.match(text, at)
            if f and literal_only and not text[at : at + 1] in "\"'":
                n = _literal(text, f.end())
                if n and grants_access(n["value"], name):
                    self.keep(*n["span"], "assignment")
                    return
        if literal_only:
            return
        b = _BLOCK.match(text, at)
        if b:
            if "-----BEGIN" not in b["value"] and grants_access(b["value"], name):
                self.keep(*b.span("value"), "assignment")
            return
        m = _BARE.match(text, at)
        if not m:
            return
        end = m.end()
        value = m.group().rstrip(",;\"'`)")
        if self.code:  # a pair inside a literal ends with a delimiter
            value = re.split(r"[;&\"'`]", value)[0]
        end = m.start() + len(value)
        d = _SHELL_DEFAULT.fullmatch(value)
        if grants_access(d["value"] if d else value, name) and "(" not in value:
            self.keep(m.start(), end, "assignment")


def find_spans(text: str | None, path: str) -> list[Span]:
    """Credentials of a text as disjoint spans in its order."""
    return _Scan(text, path).run() if text else []


def redact(text: str, spans: list[Span], mark: str = "REDACTED") -> str:
    """``text`` with a placeholder in place of each span; quotes, key names and line ends around it stay.

    The placeholder is a word, so it is valid in any literal; the lines of a key block become one, between its armor. In
    pieces, each has its own.
    """
    out, at = [], 0
    for s in spans:
        out.append(text[at : s.start])
        begun = s.start
        for a, b in s.pieces or ((s.start, s.end),):
            out.append(text[begun:a] + (mark if a < b else ""))
            begun = b
        out.append(text[begun : s.end])
        at = s.end
    out.append(text[at:])
    return "".join(out)


SPANS = "file_id bigint, repo string, rel_path string, line int, start int, length int, rule string"


def find_credentials(files: DataFrame) -> DataFrame:
    """``(file_id, repo, rel_path, line, start, length, rule)`` of each credential; ``start`` counts characters from 0.

    Whole texts are scanned, in chunks. Deliveries of a file that are the same are scanned once; null and empty texts
    have no credentials, a null path is that of a settings file. An empty input gives an empty result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, repo, path, text in zip(b["file_id"], b["repo"], b["rel_path"], b["content"], strict=True):
                spans = find_spans(text, path or "")
                if spans:
                    lines = Lines(text)
                    out.extend((i, repo, path, lines.of(s.start), s.start, s.end - s.start, s.rule) for s in spans)
            yield pd.DataFrame(out, columns=["file_id", "repo", "rel_path", "line", "start", "length", "rule"])

    return one_per_file(files).where(F.col("content") != "").mapInPandas(run, SPANS)


def redacted_files(files: DataFrame) -> DataFrame:
    """``(file_id, rel_path, n_redacted, content)`` of each file that holds credentials, with placeholders in their place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, path, text in zip(b["file_id"], b["rel_path"], b["content"], strict=True):
                spans = find_spans(text, path or "")
                if spans:
                    out.append((i, path, len(spans), redact(text, spans)))
            yield pd.DataFrame(out, columns=["file_id", "rel_path", "n_redacted", "content"])

    return one_per_file(files).where(F.col("content") != "").mapInPandas(run, "file_id bigint, rel_path string, n_redacted int, content string")


def reported_state(found: DataFrame, findings: DataFrame, reach: int = 3) -> DataFrame:
    """``found`` with ``reported``: whether a scanner's credential finding points within ``reach`` lines of it."""
    told = findings.where(F.lower(F.trim("source")) == "gitleaks").select("repo", "rel_path", F.explode(F.sequence(F.col("line") - reach, F.col("line") + reach)).alias("line"))
    told = told.dropna().distinct().withColumn("reported", F.lit(True))
    return found.join(told, ["repo", "rel_path", "line"], "left").withColumn("reported", F.coalesce("reported", F.lit(False)))
