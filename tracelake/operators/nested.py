"""Nested JSON documents to flat node tables that are linked by interval labels.

Every node of a document gets a pre-order and a post-order number from one depth-first walk. A node lies under another
one exactly if its interval ``(pre, post)`` lies inside that one's, so each table can be joined to any level above it
without carrying the keys of all levels.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.core import ship

NODE_SCHEMA = "doc_id bigint, entity string, pre int, post int, pos int, value string"
_SPACE = " \t\r\n\ufeff"


class _Number(str):
    """A JSON number as it is written."""


def _reject(name: str):
    raise ValueError(name)


def parse_json(text: str | None):
    """The value of a whole, valid JSON text; ``ValueError`` otherwise. A byte order mark is not part of the text."""
    if text is None:
        raise ValueError("null")
    text = text.strip(_SPACE)
    try:
        return json.loads(text, parse_constant=_reject, parse_float=_Number, parse_int=_Number)
    except RecursionError:
        return _parse_deep(text)


_JSON_TOKEN = re.compile(r"[ \t\r\n]*(?:(?P<mark>[\[\]{},:])|(?P<number>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)|(?P<word>true|false|null)|(?P<quote>\"))")
_WORDS = {"true": True, "false": False, "null": None}


def _parse_deep(text: str):
    """``parse_json`` with a stack of its own, for texts that are nested beyond the reader's depth."""
    at, stack, key, done, value = 0, [], None, False, None
    expect = "value"  # value, first (value or end), key, first key, colon, next
    while True:
        m = _JSON_TOKEN.match(text, at)
        if not m:
            break
        at = m.end()
        mark = m["mark"]
        if m["quote"]:
            value, at = json.decoder.scanstring(text, at, True)
        elif m["number"]:
            value = _Number(m["number"])
        elif m["word"]:
            value = _WORDS[m["word"]]
        if mark == ":" and expect == "colon":
            expect = "value"
            continue
        if mark == "," and expect == "next" and stack:
            expect = "key" if isinstance(stack[-1][0], dict) else "value"
            continue
        if mark in ("[", "{") and expect in ("value", "first"):
            stack.append(([] if mark == "[" else {}, key))
            expect = "first" if mark == "[" else "first key"
            continue
        if mark in ("]", "}") and stack and isinstance(stack[-1][0], list) == (mark == "]") and expect in ("next", "first", "first key"):
            value, key = stack.pop()
        elif mark:
            raise ValueError(f"unexpected {mark}")
        elif expect in ("key", "first key"):
            if not m["quote"]:
                raise ValueError("expected a name")
            key, expect = value, "colon"
            continue
        elif expect not in ("value", "first"):
            raise ValueError("unexpected value")
        if not stack:
            done = True
            break
        if isinstance(stack[-1][0], dict):
            stack[-1][0][key] = value
        else:
            stack[-1][0].append(value)
        expect = "next"
    if not done or text[at:].strip(" \t\r\n"):
        raise ValueError("not one whole text")
    return value


def find_key(value, key: str):
    """The shallowest object that has ``key``, inside any objects, arrays and JSON-in-text; ``None`` without one."""
    level = [value]
    while level:
        deeper = []
        for x in level:
            if isinstance(x, str) and not isinstance(x, _Number) and x.strip(_SPACE)[:1] in ('"', "{", "["):
                try:
                    x = parse_json(x)
                except ValueError:
                    continue
                if isinstance(x, str):
                    deeper.append(x)
                    continue
            if isinstance(x, dict):
                if key in x:
                    return x
                deeper.extend(x.values())
            elif isinstance(x, list):
                deeper.extend(x)
        level = deeper
    return None


def as_text(value) -> str:
    """Text as written, numbers as written, anything else as JSON; '' for null. Lone surrogates become U+FFFD."""
    if value is None:
        return ""
    if isinstance(value, str):
        text = value
    else:
        try:
            text = json.dumps(value, ensure_ascii=False)
        except RecursionError:
            text = _write_deep(value)
    return text.encode("utf-8", "replace").decode("utf-8") if not text.isascii() else text


def _write_deep(value) -> str:
    """``json.dumps`` with a stack of its own."""
    out, todo = [], [value]
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):
            out.append(x[0])
        elif isinstance(x, dict | list):
            pairs = [[(json.dumps(k, ensure_ascii=False) + ": ",), v] for k, v in x.items()] if isinstance(x, dict) else [[v] for v in x]
            todo.append(("}" if isinstance(x, dict) else "]",))
            for n, p in enumerate(reversed(pairs)):
                todo.extend(reversed(p))
                if n + 1 < len(pairs):
                    todo.append((", ",))
            out.append("{" if isinstance(x, dict) else "[")
        else:
            out.append(json.dumps(x, ensure_ascii=False))
    return "".join(out)


def _many(value) -> list:
    return value if isinstance(value, list) else [value]


def _field(value, key: str):
    return value.get(key) if isinstance(value, dict) else None


def _package_name(value) -> str:
    if isinstance(value, str):
        return as_text(value)
    inner = _field(value, "package")
    return as_text(inner if isinstance(inner, str) else _field(inner, "name"))


#: Levels of a dependency report from the outside in: entity, field that holds it, text of an element.
REPORT_LEVELS = (
    ("result", "results", lambda v: ""),
    ("package", "packages", _package_name),
    ("group", "groups", lambda v: as_text(_field(v, "max_severity"))),
    ("alias", "aliases", as_text),
)


def label(root, levels=REPORT_LEVELS) -> Iterator[tuple[str, int, int, int, str]]:
    """(entity, pre, post, position, value) of every element, in post-order. Null elements use up a position only."""
    clock = 0

    def walk(parent, depth: int):
        nonlocal clock
        if depth == len(levels):
            return
        entity, field, value = levels[depth]
        for pos, x in enumerate(_many(_field(parent, field))):
            if x is None:
                continue
            pre = clock
            clock += 1
            yield from walk(x, depth + 1)
            yield entity, pre, clock, pos, value(x)
            clock += 1

    return walk(root, 0)


def label_documents(docs: DataFrame, levels=REPORT_LEVELS) -> DataFrame:
    """``docs(doc_id bigint, body string)`` to node rows of ``NODE_SCHEMA``; texts that are not whole JSON give none."""
    root_key = levels[0][1]

    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, body in zip(batch["doc_id"], batch["body"], strict=True):
                try:
                    root = find_key(parse_json(body), root_key)
                except ValueError:
                    continue
                if root is not None:
                    out.extend((doc_id, *row) for row in label(root, levels))
                if len(out) > 50_000:
                    yield pd.DataFrame(out, columns=["doc_id", "entity", "pre", "post", "pos", "value"])
                    out = []
            yield pd.DataFrame(out, columns=["doc_id", "entity", "pre", "post", "pos", "value"])

    return docs.select("doc_id", "body").mapInPandas(run, NODE_SCHEMA)


_LISTS = ("packages", "groups", "vulnerabilities", "ids", "aliases", "affected", "ranges", "events", "cwe_ids")


def _plain(value):
    """A report's part with arrays where arrays belong, without null elements, a package by its name as an object."""
    if isinstance(value, list):
        return [_plain(x) for x in value if x is not None]
    if not isinstance(value, dict):
        return value
    out = {}
    for k, x in value.items():
        if x is None:
            continue
        if k in _LISTS:
            x = _many(x)
        if k == "package" and isinstance(x, str):
            x = {"name": x}
        if k == "packages":
            x = [{"package": {"name": p}} if isinstance(p, str) else p for p in x]
        out[k] = _plain(x)
    return out


def plain_reports(docs: DataFrame, root_key: str = "results") -> DataFrame:
    """``(doc_id, body)``: each report as one object with its ``root_key`` on top, in the plain layout; others give no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, body in zip(batch["doc_id"], batch["body"], strict=True):
                try:
                    root = find_key(parse_json(body), root_key)
                    if root is not None:
                        out.append((doc_id, as_text({root_key: _plain(_many(root[root_key]))})))
                except (ValueError, RecursionError):  # deeper than any report's own levels
                    continue
            yield pd.DataFrame(out, columns=["doc_id", "body"])

    ship(docs.sparkSession)
    return docs.select("doc_id", "body").mapInPandas(run, "doc_id bigint, body string")


def node_table(nodes: DataFrame, entity: str) -> DataFrame:
    """The flat table of one entity."""
    return nodes.where(F.col("entity") == entity).drop("entity")


def contained_in(child: DataFrame, parent: DataFrame, prefix: str) -> DataFrame:
    """``child`` rows with ``pre``/``pos``/``value`` of the ``parent`` row whose interval holds theirs."""
    p = parent.select(*(F.col(c).alias(f"{prefix}_{c}") for c in ("doc_id", "pre", "post", "pos", "value")))
    hold = (
        (F.col("doc_id") == F.col(f"{prefix}_doc_id"))
        & (F.col(f"{prefix}_pre") < F.col("pre"))
        & (F.col("post") < F.col(f"{prefix}_post"))
    )
    return child.join(p, hold).drop(f"{prefix}_doc_id", f"{prefix}_post")


def with_enclosing(nodes: DataFrame, entities: tuple[str, ...], values: bool = False) -> DataFrame:
    """``nodes`` with the position of the enclosing (or own) node of each entity, -1 where no interval contains it; with
    ``values`` that node's value too.

    Intervals of one entity do not overlap, so the only candidate is the last one that opened before: one sort of each
    document in place of a range join per level. A document's nodes come from one text cell, which bounds the group.
    """
    so_far = Window.partitionBy("doc_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for e in entities:
        opened = F.last(F.when(F.col("entity") == e, F.struct("post", "pos", "value") if values else F.struct("post", "pos")), ignorenulls=True).over(so_far)
        nodes = nodes.withColumn(f"_{e}", opened)
    inside = {e: F.col(f"_{e}.post") >= F.col("post") for e in entities}
    return nodes.select(
        "*",
        *(F.when(inside[e], F.col(f"_{e}.pos")).otherwise(-1).alias(f"{e}_no") for e in entities),
        *(F.when(inside[e], F.col(f"_{e}.value")).alias(f"{e}_value") for e in entities if values),
    ).drop(*(f"_{e}" for e in entities))


def latest(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """One row per ``key`` (null keys left out): the ``value`` delivered last, the greatest one on a tie."""
    best = F.max(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("doc_id")).agg(best.alias("b")).select("doc_id", F.col("b.v").alias("body"))


def flatten_reports(reports: DataFrame) -> DataFrame:
    """``osv_reports`` rows to one row per package, group and alias (columns of ``p1_found``).

    Of several deliveries of a report the one with the latest ``loaded_at`` counts. Null, empty, damaged and non-JSON
    texts give no rows, nor do null elements (they keep their position); a missing or null name, severity or alias
    field gives ''. An empty input gives an empty result. Extra columns are ignored.
    """
    nodes = label_documents(latest(reports, "report_id", "loaded_at", "report"))
    levels = tuple(e for e, _, _ in REPORT_LEVELS)
    return (
        with_enclosing(nodes, levels)
        .where(F.col("entity") != "result")
        .select(
            F.col("doc_id").alias("report_id"),
            "entity",
            *(F.col(f"{e}_no") for e in levels),
            F.col("value").alias("entity_value"),
        )
    )
