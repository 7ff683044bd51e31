"""What the names of a Python file refer to, as far as the file alone can tell.

Scoping is the language's own: function scopes from the inside out, class scopes only for code that stands in them
directly, then the module, then builtins. A name leads to a definition of the file, to something imported, to a builtin,
or to a value whose origin is followed through assignments; parameters and anything computed stay unknown.
"""

from __future__ import annotations

import ast
import builtins

BUILTINS = frozenset(dir(builtins))
#: Builtins that are classes, so that raising their names is a call.
BUILTIN_CLASSES = frozenset(n for n in BUILTINS if isinstance(getattr(builtins, n), type))
#: Values are followed through this many names; what is longer is as good as circular.
_STEPS = 50


def dotted(e: ast.expr) -> str | None:
    parts = []
    while isinstance(e, ast.Attribute):
        parts.append(e.attr)
        e = e.value
    return ".".join([e.id, *reversed(parts)]) if isinstance(e, ast.Name) else None


class Scope:
    """The names that one module, class or function binds, each with its bindings in the order of the text."""

    def __init__(self, kind: str, name: str, parent: Scope | None, node: ast.AST | None):
        self.kind, self.name, self.parent, self.node = kind, name, parent, node
        self.bound: dict[str, list[tuple[int, str, object]]] = {}
        self.outer: set[str] = set()
        self.stars: list[ast.alias] = []
        self.inner: dict[ast.AST, Scope] = {}

    @property
    def path(self) -> str:
        return f"{self.parent.path}.{self.name}" if self.parent and self.parent.path else self.name

    def bind(self, name: str, line: int, kind: str, what: object = None) -> None:
        self.bound.setdefault(name, []).append((line, kind, what))

    def module(self) -> Scope:
        s = self
        while s.parent:
            s = s.parent
        return s


_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def scopes_of(tree: ast.Module) -> Scope:
    top = Scope("module", "", None, tree)
    _fill(top, tree.body)
    return top


def _fill(scope: Scope, body: list[ast.stmt]) -> None:
    todo: list[ast.AST] = list(reversed(body))
    while todo:
        n = todo.pop()
        if isinstance(n, (*_FUNCTIONS, ast.ClassDef)):
            kind = "class" if isinstance(n, ast.ClassDef) else "function"
            inner = scope.inner[n] = Scope(kind, n.name, scope, n)
            scope.bind(n.name, n.lineno, kind, inner)
            if kind == "function":
                a = n.args
                for p in (*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg))):
                    inner.bind(p.arg, n.lineno, "parameter", p)
            _fill(inner, n.body)
            todo.extend(n.decorator_list)
            continue
        if isinstance(n, ast.Import):
            for a in n.names:
                scope.bind(a.asname or a.name.split(".")[0], n.lineno, "import", a)
        elif isinstance(n, ast.ImportFrom):
            for a in n.names:
                if a.name == "*":
                    scope.stars.append(a)
                else:
                    scope.bind(a.asname or a.name, n.lineno, "from", a)
        elif isinstance(n, (ast.Global, ast.Nonlocal)):
            scope.outer.update(n.names)
        elif isinstance(n, ast.Assign):
            for t in n.targets:
                _targets(scope, t, n.value)
        elif isinstance(n, ast.AnnAssign):
            _targets(scope, n.target, n.value)
        elif isinstance(n, ast.NamedExpr):
            _targets(scope, n.target, n.value)
        elif isinstance(n, (ast.For, ast.AsyncFor)):
            _targets(scope, n.target, None)
        elif isinstance(n, ast.withitem) and n.optional_vars is not None:
            _targets(scope, n.optional_vars, None)
        elif isinstance(n, ast.ExceptHandler) and n.name:
            scope.bind(n.name, n.lineno, "value", None)
        elif isinstance(n, (ast.MatchAs, ast.MatchStar)) and n.name:
            scope.bind(n.name, n.lineno, "value", None)
        elif isinstance(n, ast.Lambda):
            continue
        todo.extend(reversed(list(ast.iter_child_nodes(n))))


def _targets(scope: Scope, t: ast.expr, value: ast.expr | None) -> None:
    if isinstance(t, ast.Name):
        scope.bind(t.id, t.lineno, "value", value)
    elif isinstance(t, (ast.Tuple, ast.List)):
        for x in t.elts:
            _targets(scope, x, None)
    elif isinstance(t, ast.Starred):
        _targets(scope, t.value, None)


def _home(scope: Scope, name: str) -> Scope | None:
    """The scope whose binding of ``name`` code in ``scope`` sees."""
    here: Scope | None = scope
    first = True
    while here:
        if name in here.outer:
            here, first = here.parent, False
            continue
        if name in here.bound and (first or here.kind != "class"):
            return here
        here, first = here.parent, False
    return None


#: A reference: how it is known (local, import, builtin, star, module, unknown), what it names, and the rest of the path.
Ref = tuple[str, object, str]
UNKNOWN: Ref = ("unknown", None, "")


def resolve(e: ast.expr, scope: Scope, line: int, steps: int = 0) -> list[Ref]:
    """What ``e`` refers to, first choice first; a local reference names a scope of the file."""
    if steps > _STEPS:
        return [UNKNOWN]
    if isinstance(e, ast.Name):
        home = _home(scope, e.id)
        if home is None:
            stars = [("star", a, e.id) for a in scope.module().stars]
            return [("builtin", e.id, "")] if e.id in BUILTINS and not stars else [*stars, ("builtin", e.id, "") if e.id in BUILTINS else UNKNOWN]
        before = [b for b in home.bound[e.id] if b[0] <= line]
        at, kind, what = (before or home.bound[e.id])[-1] if home is scope else home.bound[e.id][-1]
        if kind in ("class", "function"):
            return [("local", what, "")]
        if kind == "import":
            return [("module", what, "")]
        if kind == "from":
            return [("import", what, "")]
        if kind == "parameter":
            owner = home.parent
            args = [*home.node.args.posonlyargs, *home.node.args.args]
            static = any(isinstance(d, ast.Name) and d.id == "staticmethod" for d in home.node.decorator_list)
            return [("local", owner, "")] if owner and owner.kind == "class" and args and args[0] is what and not static else [UNKNOWN]
        if isinstance(what, (ast.Name, ast.Attribute)):
            return resolve(what, home, at - 1 if isinstance(what, ast.Name) and what.id == e.id else at, steps + 1)
        if isinstance(what, ast.Call):
            return [r if r[0] in ("import", "module", "star") or (r[0] == "local" and r[1].kind == "class") else UNKNOWN for r in resolve(what.func, home, at, steps + 1)]
        return [UNKNOWN]
    if isinstance(e, ast.Attribute):
        v = e.value
        if isinstance(v, ast.Call):
            if isinstance(v.func, ast.Name) and v.func.id == "super":
                owner: Scope | None = scope
                while owner and owner.kind != "class":
                    owner = owner.parent
                return _of_bases(owner, e.attr, steps + 1) if owner else [UNKNOWN]
            found = [r for r in resolve(v.func, scope, line, steps + 1) if r[0] != "local" or r[1].kind == "class"]
        else:
            found = resolve(v, scope, line, steps + 1)
        return [r for f in found for r in _attribute(f, e.attr, steps + 1)] or [UNKNOWN]
    return [UNKNOWN]


def _attribute(r: Ref, attr: str, steps: int) -> list[Ref]:
    how, what, path = r
    if how == "local":
        if what.kind != "class" or steps > _STEPS:
            return [UNKNOWN]
        own = what.bound.get(attr)
        if own:
            line, kind, value = own[-1]
            if kind in ("class", "function"):
                return [("local", value, "")]
            return resolve(value, what, line, steps + 1) if isinstance(value, (ast.Name, ast.Attribute)) else [UNKNOWN]
        return _of_bases(what, attr, steps + 1)
    if how == "builtin":
        return [("builtin", what, f"{path}.{attr}" if path else attr)]
    if how == "unknown":
        return [UNKNOWN]
    return [(how, what, f"{path}.{attr}" if path else attr)]


def _of_bases(owner: Scope, attr: str, steps: int) -> list[Ref]:
    out: list[Ref] = []
    if steps <= _STEPS:
        for b in owner.node.bases:
            base = b.value if isinstance(b, ast.Subscript) else b
            for r in resolve(base, owner.parent, owner.node.lineno, steps + 1):
                if not (r[0] == "local" and r[1] is owner):
                    out.extend(_attribute(r, attr, steps + 1))
    return [r for r in out if r[0] != "unknown"] or [UNKNOWN]
