"""Python source files to definitions, call sites, bases, imports and routes.

One Python stage parses each file once and emits everything it holds as tagged rows, with what each name refers to as far
as the file can tell; all that relates files to one another is joins over those rows, in ``resolve``.
"""

from __future__ import annotations

import ast
import hashlib
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.core import by_key, ship
from tracelake.functions import scalar as S
from tracelake.operators import scopes

FACTS = (
    "rel_path string, fact string, ordinal int, line int, end_line int, col int, kind string, name string, qualified_name string, "
    "scope string, text string, level int, alias string, source_hash string, refs array<struct<how:string,node:string,ord:int,path:string>>"
)
_COLUMNS = [x.split()[0] for x in FACTS.split(", ")]  # the struct has no blank behind its commas
#: Decorator methods that register a web route, and methods of class-based views.
ROUTE_VERBS = frozenset("route get post put delete patch head options trace websocket".split())
VIEW_METHODS = ("dispatch", "get", "post", "put", "patch", "delete", "head", "options", "trace")
_DOC = re.compile(r"^[rRuU]?(\"\"\"|'''|\"|')(.*)\1$", re.S)


class _Facts(ast.NodeVisitor):
    def __init__(self, path: str, text: str, tree: ast.Module):
        self.path, self.text, self.rows = path, text, []
        self.top = self.here = scopes.scopes_of(tree)
        self.imported: dict[ast.alias, int] = {}  # imports and the numbers of their rows

    def refs_of(self, e: ast.expr) -> list:
        return scopes.resolve(e, self.here, e.lineno)

    def finish(self) -> list[dict]:
        """The rows, references told by node ids and numbers of imports. Names of the module that lead elsewhere are rows too."""
        for name, bound in self.top.bound.items():
            line, kind, what = bound[-1]
            refs = [("import" if kind == "from" else "module", what, "")] if kind in ("import", "from") else scopes.resolve(what, self.top, line) if isinstance(what, (ast.Name, ast.Attribute)) else []
            if refs:
                self.add("export", name=name, refs=refs)
        for a in self.top.stars:
            self.add("export", name="*", refs=[("star", a, "")])
        for r in self.rows:
            if r["refs"] is not None:
                told = []
                for how, what, path in r["refs"]:
                    node = f"{self.path}::{what.path}::L{what.node.lineno}" if how == "local" else what if how == "builtin" else None
                    number = self.imported.get(what) if how in ("import", "module", "star") else None
                    told.append({"how": how, "node": node, "ord": number, "path": path})
                r["refs"] = told
        return self.rows

    def add(self, fact: str, node: ast.AST | None = None, **given) -> None:
        row = dict.fromkeys(_COLUMNS)
        row |= {"rel_path": self.path, "fact": fact, "ordinal": len(self.rows), "scope": self.here.path}
        if node is not None:
            row |= {"line": node.lineno, "end_line": node.end_lineno, "col": node.col_offset}
        self.rows.append(row | given)

    def define(self, node, kind: str) -> None:
        body = ast.get_source_segment(self.text, node) or ""
        doc = None
        first = node.body[0]
        if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
            m = _DOC.match((ast.get_source_segment(self.text, first.value) or "").strip())
            doc = ((m[2] if m else first.value.value).strip()) or None
        inner = self.here.inner[node]
        name = inner.path
        self.add("def", node, kind=kind, name=node.name, qualified_name=name, text=doc, source_hash=hashlib.sha256(body.encode("utf-8", "replace")).hexdigest())
        for d in node.decorator_list:
            call = d if isinstance(d, ast.Call) else None
            target = d.func if call else d
            if call and kind == "function" and isinstance(target, ast.Attribute) and target.attr in ROUTE_VERBS:
                arg = call.args[0].value if call.args and isinstance(call.args[0], ast.Constant) and isinstance(call.args[0].value, str) else None
                self.add("route", node, kind=target.attr, name=node.name, qualified_name=name, text=arg)
            if not call:
                self.site(target, "decorator")
            self.visit(d)
        if kind == "class":
            for b in node.bases:
                base = b.value if isinstance(b, ast.Subscript) else b
                self.add("base", base, name=scopes.dotted(base) or ast.unparse(base)[:60], qualified_name=name, refs=self.refs_of(base))
        for p in ast.iter_child_nodes(node):
            if p in node.body or p in node.decorator_list:
                continue
            self.visit(p)
        outer, self.here = self.here, inner
        for s in node.body:
            self.visit(s)
        self.here = outer

    def visit_FunctionDef(self, node) -> None:
        self.define(node, "function")

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node) -> None:
        self.define(node, "class")

    def site(self, target: ast.expr, kind: str) -> None:
        name = scopes.dotted(target)
        at = -1 if name is None and not isinstance(target, ast.Attribute) else target.end_col_offset - len(target.attr if isinstance(target, ast.Attribute) else target.id)
        shown = name or (target.attr if isinstance(target, ast.Attribute) else ast.unparse(target)[:60])
        self.add("call", target, kind=kind, name=shown, col=at, refs=self.refs_of(target))

    def visit_Call(self, node: ast.Call) -> None:
        self.site(node.func, "call")
        if scopes.dotted(node.func) in ("urlpatterns.append", "urlpatterns.extend"):
            for a in node.args:
                self.routes_of(a)
        self.generic_visit(node)

    def visit_Raise(self, node: ast.Raise) -> None:
        if isinstance(node.exc, (ast.Name, ast.Attribute)):
            self.site(node.exc, "raise")
        self.generic_visit(node)

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.imported[a] = len(self.rows)
            self.add("import", node, kind="import", text=a.name, level=0, alias=a.asname or a.name.split(".")[0])

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        for a in node.names:
            self.imported[a] = len(self.rows)
            self.add("import", node, kind="from", text=node.module or "", name=a.name, level=node.level, alias=a.asname or a.name)

    def routes_of(self, value: ast.expr) -> None:
        for call in ast.walk(value):
            if not (isinstance(call, ast.Call) and isinstance(call.func, ast.Name) and call.func.id in ("path", "re_path", "url") and len(call.args) >= 2):
                continue
            view = call.args[1]
            for _ in range(3):
                if isinstance(view, ast.Call):
                    if isinstance(view.func, ast.Attribute) and view.func.attr == "as_view":
                        view = view.func.value
                    elif view.args and scopes.dotted(view.func) != "include":
                        view = view.args[0]
            name = scopes.dotted(view)
            if name:
                arg = call.args[0].value if isinstance(call.args[0], ast.Constant) else None
                self.add("view", call, name=name, text=arg if isinstance(arg, str) else None, refs=self.refs_of(view))

    def visit_Assign(self, node: ast.Assign) -> None:
        if any(isinstance(t, ast.Name) and t.id == "urlpatterns" for t in node.targets):
            self.routes_of(node.value)
        self.generic_visit(node)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        if isinstance(node.target, ast.Name) and node.target.id == "urlpatterns" and node.value is not None:
            self.routes_of(node.value)
        self.generic_visit(node)

    def visit_AugAssign(self, node: ast.AugAssign) -> None:
        if isinstance(node.target, ast.Name) and node.target.id == "urlpatterns":
            self.routes_of(node.value)
        self.generic_visit(node)


def file_facts(path: str, text: str | None) -> list[dict]:
    if text is None:
        return []
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
        v = _Facts(path, text, tree)
        v.visit(tree)
        return v.finish()
    except (SyntaxError, ValueError, RecursionError):
        return []  # a file node only


def source_facts(files: DataFrame) -> DataFrame:
    """Everything the Python files of ``files(rel_path, content)`` hold; files that do not parse hold nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for p, t in zip(b["rel_path"], b["content"], strict=True) for r in file_facts(p, t)]
            out = pd.DataFrame(rows, columns=_COLUMNS)
            yield out.astype({c: "Int32" for c in ("ordinal", "line", "end_line", "col", "level")})

    ship(files.sparkSession)
    python = files.where(F.col("rel_path").rlike(r"\.pyi?w?$")).select("rel_path", "content")
    return by_key(python, "rel_path").mapInPandas(run, FACTS)


def file_nodes(files: DataFrame) -> DataFrame:
    """One node per Python file, over all its lines."""
    module = S.module_name("rel_path")
    return files.where(F.col("rel_path").rlike(r"\.pyi?w?$")).select(
        F.concat("rel_path", F.lit("::<file>")).alias("node_id"),
        F.lit("file").alias("kind"),
        F.when(module == "", F.col("rel_path")).otherwise(module).alias("qualified_name"),
        F.col("rel_path").alias("file_path"),
        F.lit(1).alias("start_line"),
        F.greatest(F.coalesce(F.size(F.split("content", "\n")), F.lit(1)), F.lit(1)).alias("end_line"),
        S.content_hash("content").alias("source_hash"),
        F.lit(None).cast("string").alias("docstring"),
        F.lit(0).alias("ordinal"),
    )


def def_nodes(facts: DataFrame) -> DataFrame:
    return facts.where("fact = 'def'").select(
        F.concat_ws("::", "rel_path", "qualified_name", F.concat(F.lit("L"), "line")).alias("node_id"),
        "kind",
        "qualified_name",
        F.col("rel_path").alias("file_path"),
        F.col("line").alias("start_line"),
        "end_line",
        "source_hash",
        F.col("text").alias("docstring"),
        (F.col("ordinal") + 1).alias("ordinal"),
    )


def first_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in ``order``."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
