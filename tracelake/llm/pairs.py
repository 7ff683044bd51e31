"""Functions paired with their documentation, delimited by windows over lexed tokens."""

from __future__ import annotations

import ast
import re
import unicodedata
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.broken import language_of, one_per_file
from tracelake.llm.syntax import pylexer as lex
from tracelake.llm.syntax.python import problems

TOKENS = "file_id bigint, repo string, rel_path string, i int, k tinyint, line int, w string"
#: Kinds of tokens. Names, numbers and operators that are none of the others are OTHER.
OTHER, STRING, NEWLINE, INDENT, DEDENT, END, COMMENT, DEF, CLASS, ASYNC, AT, OPEN, ROUND, CLOSE, COMMA, COLON, SEMICOLON, STAR, ROUND_CLOSE, LAMBDA, ARROW = range(21)
_KIND = np.array([{lex.STRING: STRING, lex.NEWLINE: NEWLINE, lex.INDENT: INDENT, lex.DEDENT: DEDENT, lex.END: END}.get(k, OTHER) for k in range(9)], np.int8)
_WORDS = {"def": DEF, "class": CLASS, "async": ASYNC, "@": AT, "(": ROUND, "[": OPEN, "{": OPEN, ")": ROUND_CLOSE, "]": CLOSE, "}": CLOSE, ",": COMMA, ":": COLON, ";": SEMICOLON, "*": STAR, "**": STAR, "lambda": LAMBDA, "->": ARROW}
#: What a bracket that is not round adds to the depth of brackets, where a round one adds 1; the language nests no more than 200.
NOT_ROUND = 1000
_LINE_END = re.compile(r"\r\n|\r|\n")


def _name(word: str) -> str:
    """A name as the language reads it."""
    return word if word.isascii() else unicodedata.normalize("NFKC", word)


def lexed(text: str) -> tuple[np.ndarray, np.ndarray, list[str | None]] | None:
    """Kinds, lines and texts of all tokens of a file in order, comments of their own line among them; null if it does not parse.

    Nothing is told of functions here. The text of a token is the literal of a string (of strings side by side as one), the
    name behind ``def`` or ``class``, a comment, or an OTHER as it stands.
    """
    text = text.removeprefix("\ufeff")
    tokens = lex.Tokens(text)
    if problems(text, tokens):
        return None
    words, starts = tokens.texts, np.array(tokens.starts, np.int64)
    kinds = _KIND[np.array(tokens.kinds, np.int8)]
    said = np.array([_WORDS.get(w, OTHER) for w in words], np.int8)
    kinds = np.where(said != OTHER, said, kinds)
    last, following = np.append(NEWLINE, kinds[:-1]), np.append(kinds[1:], END)
    kinds[(kinds == AT) & ~np.isin(last, (NEWLINE, INDENT, DEDENT, SEMICOLON))] = OTHER  # a product, no decorator
    kinds[(kinds == ASYNC) & (following != DEF)] = OTHER
    new = np.ones(len(kinds), bool)
    new[1:] = (kinds[1:] != STRING) | (kinds[:-1] != STRING)
    at = np.flatnonzero(new)
    ends = np.append(at[1:], len(kinds)) - 1
    kept = kinds[at]
    says = np.isin(kept, (OTHER, STRING)).tolist()
    out: list[str | None] = [words[j] if s else None for j, s in zip(at.tolist(), says, strict=True)]
    for n in np.flatnonzero((kept == DEF) | (kept == CLASS)).tolist():
        out[n] = _name(words[at[n] + 1])
    for n in np.flatnonzero(ends != at).tolist():
        out[n] = text[starts[at[n]] : starts[ends[n]] + len(words[ends[n]])]
    if not text.isascii():
        for n in np.flatnonzero(kept == OTHER).tolist():
            out[n] = _name(words[at[n]])
    places = starts[at]
    if tokens.comments:
        where = np.array([c for c, _ in tokens.comments], np.int64)
        order = np.argsort(np.concatenate([places, where]), kind="stable")
        kept = np.concatenate([kept, np.full(len(where), COMMENT, np.int8)])[order]
        places = np.concatenate([places, where])[order]
        out += [c for _, c in tokens.comments]
        out = [out[o] for o in order.tolist()]
    lines = np.searchsorted(np.array([0, *(m.end() for m in _LINE_END.finditer(text))], np.int64), places, "right").astype(np.int32)
    behind = np.flatnonzero((kept[1:] == DEF) & (kept[:-1] == ASYNC)) + 1
    lines[behind] = lines[behind - 1]  # a function begins with its async
    return kept, lines, out


# What says something

#: Texts that stand in for documentation, as words.
PLACEHOLDERS = frozenset(
    ["", "n a", "na", "none", "null", "nil", "tbd", "tba", "tbc", "todo", "fixme", "xxx", "wip", "hack", "stub", "docstring", "doc", "docs", "documentation", "description", "summary", "comment", "placeholder", "undocumented", "no docs", "no docs yet", "no doc", "no documentation", "no documentation yet", "no docstring", "no docstring yet", "no description", "not documented", "not documented yet", "not yet documented", "missing docstring", "empty docstring", "docstring here", "docstring goes here", "placeholder docstring", "docstring placeholder", "insert docstring here", "your docstring here", "description here", "write me", "fill me in", "fill in", "to be written", "to be done", "to be defined", "to be documented", "coming soon", "lorem ipsum", "see above", "same as above", "autogenerated", "auto generated", "generated"]
)
_NOTE = frozenset("todo fixme xxx tbd tba wip".split())
_ABOUT_DOCS = frozenset("document documented documentation documenting doc docs docstring docstrings describe description explain comment comments".split())
_NOTE_WORDS = _NOTE | _ABOUT_DOCS | frozenset(
    "a an the this that it its me my here there and or for of to in on be is are was need needs needed must should still yet later soon someone please add adding write written writing fill complete finish improve update provide put insert some proper properly missing function functions method methods class code what does".split()
)
_FILLER = frozenset("a an the this that is of for function functions method methods func procedure routine coroutine def async helper".split())
_WORD = re.compile(r"[^\W_]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_FIELD = re.compile(r"[:@]\s*(?:param|parameter|arg|argument|key|keyword|type|ivar|var|raises?|returns?|rtype|yields?)\b[^:\n]*:?", re.I)
_SECTION = re.compile(r"^\s*(?:args|arguments|parameters|params|keyword args|returns?|yields?|raises|inputs?|outputs?)\s*:?\s*$|^\s*-{3,}\s*$|^\s*(?:args|arguments|parameters|params|returns?)\s*:", re.I | re.M)


def _stem(w: str) -> str:
    return w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w


def is_trivial(doc: str, name: str, args) -> bool:
    """Blank, a placeholder, a note that documentation is to come, the function's name again, or its parameters' names."""
    found = [w.lower() for w in _WORD.findall(doc)]
    if " ".join(found) in PLACEHOLDERS:
        return True
    if set(found) <= _NOTE_WORDS and (set(found) & _ABOUT_DOCS or set(found) & _NOTE):
        return True
    own = {_stem(w.lower()) for w in _WORD.findall(_CAMEL.sub("_", name).replace("_", " "))}
    said = [w for w in (x.lower() for x in _WORD.findall(_CAMEL.sub(" ", doc).replace("_", " "))) if w not in _FILLER]
    if {_stem(w) for w in said} <= own:
        return True
    rest = _SECTION.sub(" ", _FIELD.sub(" ", doc))
    names = {w.lower() for a in args if a is not None for w in _WORD.findall(a)} | {"self", "cls"}
    types = frozenset("str int float bool list dict tuple set bytes object any none optional return returns".split())
    return {w.lower() for w in _WORD.findall(rest.replace("_", " "))} <= names | types


def _documentation(source: pd.Series, name: pd.Series, args: pd.Series) -> pd.Series:
    """The text of a documentation literal, null if it is none or trivial."""
    out = []
    for s, n, a in zip(source, name, args, strict=True):
        text = None
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                value = ast.literal_eval("(" + s + "\n)")
            if isinstance(value, str) and not is_trivial(value, n, [] if a is None else a):
                text = value.encode("utf-8", "replace").decode("utf-8")
        except (SyntaxError, ValueError, TypeError):
            pass
        out.append(text)
    return pd.Series(out, dtype=object)


def token_rows(files: DataFrame) -> DataFrame:
    """One row per token of each Python file that parses: its number in the file, kind, line and text; strings side by side are one."""
    known = one_per_file(files).where((language_of(F.col("rel_path")) == "python") & F.col("content").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, kinds, lines, words, numbers, rows = [], [], [], [], [], []
            for n, text in enumerate(b.column("content").to_pylist()):
                found = lexed(text)
                if found:
                    rows.append(n)
                    sizes.append(len(found[0]))
                    kinds.append(found[0])
                    lines.append(found[1])
                    words.extend(found[2])
                    numbers.append(np.arange(len(found[0]), dtype=np.int32))
            if not rows:
                continue
            take = pa.array(np.repeat(rows, sizes))
            head = [b.column(c).take(take) for c in ("file_id", "repo", "rel_path")]
            clean = pa.array((w if w is None or w.isascii() else w.encode("utf-8", "replace").decode("utf-8") for w in words), pa.string())
            flat = [pa.array(np.concatenate(x)) for x in (numbers, kinds, lines)]
            yield pa.RecordBatch.from_arrays([*head, *flat, clean], ["file_id", "repo", "rel_path", "i", "k", "line", "w"])

    return known.select("file_id", "repo", "rel_path", "content").mapInArrow(run, TOKENS)


def documented_functions(tokens: DataFrame) -> DataFrame:
    """``(file_id, qualified_name, start_line, name, doc)`` of each function whose documentation says something.

    ``tokens`` are those of ``token_rows``. One exchange hashes them by file and one sort puts them in order; cumulative block
    and bracket depths, islands of headers and looks around are one window over all tokens. What follows works on headers,
    their colons and parameters, the openings of blocks and the strings that are whole statements. A file's tokens come from
    one text, which bounds a window. Deliveries of a file that are the same count once; null, empty and invalid texts give
    no rows.
    """
    file = Window.partitionBy("file_id").orderBy("i")
    past = file.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = file.rowsBetween(Window.unboundedPreceding, -1)
    k = F.col("k")
    header = k.isin(DEF, CLASS)
    # Only what is asked of a token moves with it: lines of headers, words that may be names, strings.
    said = header | (k == STRING) | ((k == OTHER) & F.col("w").rlike(r"(?U)^[^\W\d]"))
    moved = tokens.where(k != COMMENT).select("file_id", "i", "k", F.when(header, F.col("line")).alias("line"), F.when(said, F.col("w")).alias("w"))
    rows = moved.select(
        "file_id", "i", "k", "line", "w",
        # Block and bracket depth behind each token; headers number the islands of tokens up to the next header.
        F.sum(F.when(k == INDENT, 1).when(k == DEDENT, -1).otherwise(0)).over(past).alias("block"),
        F.sum(F.when(k == ROUND, 1).when(k == ROUND_CLOSE, -1).when(k == OPEN, NOT_ROUND).when(k == CLOSE, -NOT_ROUND).otherwise(0)).over(past).alias("bracket"),
        F.count(F.when(header, 1)).over(past).alias("island"),
        *(F.lag("k", n).over(file).alias(f"b{n}") for n in (1, 2)),
        *(F.lead("k", n).over(file).alias(f"a{n}") for n in (1, 2)),
        # What stands before the round brackets that open, or close, right before a token.
        F.last(F.when(k != ROUND, k), ignorenulls=True).over(before).alias("opened"),
        F.last(F.when(k != ROUND_CLOSE, k), ignorenulls=True).over(before).alias("closed"),
    )
    outside, single = F.col("bracket") == 0, F.col("bracket") == 1
    colon = (k == COLON) & outside
    named = (k == OTHER) & single & (F.col("b1").isin(ROUND, COMMA) | ((F.col("b1") == STAR) & F.col("b2").isin(ROUND, COMMA)))
    begins = (k == STRING) & F.col("opened").isin(COLON, INDENT) & (F.col("bracket") < NOT_ROUND)
    ends = k.isin(NEWLINE, SEMICOLON, END) & (F.col("closed") == STRING)
    unnamed = k.isin(COLON, LAMBDA) & (outside | single)
    opens = (F.col("a1") == NEWLINE) & (F.col("a2") == INDENT)
    rows = rows.where(header | unnamed | (k == ARROW) | named | (k == INDENT) | begins | ends).select(
        "file_id", "i", "k", "line", "w", "block", "bracket", "island", opens.alias("opens"),
        # Parameters stand before the arrow and the colon of a header, and are no lambda's.
        F.last(F.when(header | colon | (k == ARROW), k), ignorenulls=True).over(before).alias("latest"),
        F.last(F.when(header | (k.isin(COLON, LAMBDA) & single), k), ignorenulls=True).over(before).alias("bound"),
        F.last(F.when(header, F.col("w")), ignorenulls=True).over(before).alias("within"),
        # Every lambda outside brackets has a colon of its own.
        F.sum(F.when(colon, 1).when((k == LAMBDA) & outside, -1).otherwise(0)).over(past).alias("colons"),
        # The brackets around a string close right behind it, and then its statement ends.
        (F.lead("k").over(file).isin(NEWLINE, SEMICOLON, END) & (F.lead("i").over(file) - F.col("i") - 1 == F.col("bracket"))).alias("whole"),
    )
    parameter = (k == OTHER) & (F.col("latest") == DEF) & (F.col("bound") != LAMBDA)
    rows = rows.where(header | colon | parameter | (k == INDENT) | ((k == STRING) & F.col("whole")))
    # A header ends at the first colon outside brackets that is no lambda's.
    rows = rows.withColumn("ahead", F.last(F.when(header, F.col("colons")), ignorenulls=True).over(past))
    rows = rows.where((k != COLON) | (F.col("colons") == F.col("ahead") + 1))
    kb, opened = [F.lag("k", n).over(file) for n in (1, 2)], [F.lag("opens", n).over(file) for n in (1, 2)]
    # The first string of a body stands below the header, or beside it, with nothing but its brackets before it.
    first = ((kb[0] == INDENT) & (kb[1] == COLON) & opened[1]) | ((kb[0] == COLON) & kb[1].isin(DEF, OTHER))
    rows = rows.select(
        "file_id", "i", "k", "line", "w", "block", "island",
        F.when((k == STRING) & first & (F.col("i") - F.lag("i").over(file) - 1 == F.col("bracket")), F.col("w")).alias("source"),
        # A block belongs to the header whose colon it follows, or to none.
        F.when((k == INDENT) & (kb[0] == COLON) & opened[0], F.col("within")).alias("owner"),
    ).where((k != STRING) | F.col("source").isNotNull())
    # Every header looks up, at each smaller depth, the block that was opened last there: those are the ones around it.
    depths = F.when(header & (F.col("block") > 0), F.sequence(F.lit(1), F.col("block").cast("int"))).when(k == INDENT, F.array(F.col("block").cast("int"))).otherwise(F.array(F.lit(0)))
    lookup = Window.partitionBy("file_id", "depth").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("*", F.explode(depths).alias("depth")).withColumn("around", F.last(F.when(k == INDENT, F.struct("owner")), ignorenulls=True).over(lookup))
    part = F.when(header & F.col("around.owner").isNotNull(), F.struct("depth", F.col("around.owner").alias("name")))
    found = rows.groupBy("file_id", "island").agg(
        F.max(F.when(header, F.struct("k", "line", "w"))).alias("h"),
        F.array_sort(F.collect_list(part)).alias("parts"),
        F.collect_list(F.when(k == OTHER, F.col("w"))).alias("args"),
        F.max("source").alias("source"),
    )
    return (
        found.where((F.col("h.k") == DEF) & F.col("source").isNotNull())
        .select("file_id", F.array_join(F.array_append(F.transform("parts", lambda p: p["name"]), F.col("h.w")), ".").alias("qualified_name"), F.col("h.line").alias("start_line"), F.col("h.w").alias("name"), "args", "source")
        .withColumn("doc", F.pandas_udf(_documentation, "string")("source", "name", "args"))
        .where(F.col("doc").isNotNull())
        .select("file_id", "qualified_name", "start_line", "name", "doc")
    )


def leading_comments(tokens: DataFrame) -> DataFrame:
    """``(file_id, name, start_line, comment)``: comment lines that stand right above a function or its decorators."""
    rows = tokens.where(F.col("k").isin(COMMENT, DEF, ASYNC, AT))
    file = Window.partitionBy("file_id").orderBy("i")
    past = file.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_comment = F.col("k") == COMMENT
    # Runs of comment lines: lines and their numbers among the comments grow together.
    run = F.when(is_comment, F.col("line") - F.sum(F.when(is_comment, 1).otherwise(0)).over(past))
    rows = rows.withColumn("run", run).withColumn("starts", F.when(F.col("k") == DEF, F.col("line")))
    runs = Window.partitionBy("file_id", "run").orderBy("i")
    rows = rows.withColumn("text", F.when(is_comment, F.array_join(F.collect_list("w").over(runs.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "\n")))
    # The first row of a header (decorator, async or def) sees the comment by a lag; later rows of the header pass it on.
    seen = F.when((F.lag("k").over(file) == COMMENT) & (F.lag("line").over(file) == F.col("line") - 1), F.lag("text").over(file))
    head_starts = F.when(~is_comment & F.lag("k", 1, DEF).over(file).isin(COMMENT, DEF), 1).otherwise(0)
    rows = rows.withColumn("seen", seen).withColumn("head", F.sum(head_starts).over(past))
    head = Window.partitionBy("file_id", "head").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.withColumn("comment", F.first("seen", ignorenulls=True).over(head))
        .where((F.col("k") == DEF) & F.col("comment").isNotNull())
        .select("file_id", F.col("w").alias("name"), F.col("line").alias("start_line"), "comment")
    )
