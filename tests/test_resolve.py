"""Small programs and the calls, bases and entry points they have."""

import pytest

from tracelake.operators import extract, resolve

PROGRAMS = {
    "import binds its own module": (
        {"a.py": "def stay(): pass", "b.py": "def go(): pass", "m.py": "import a\nimport b\ndef f():\n    a.go()\n    b.go()\n"},
        {("m.f", None, "unknown"), ("m.f", "b.go", "internal")},
    ),
    "class scope is not seen from methods": ({"m.py": "def save(): pass\nclass C:\n    def save(self):\n        save()\n    x = save()\n"}, {("m.C.save", "m.save", "internal"), ("m", "m.C.save", "internal")}),
    "builtins are external": ({"m.py": "def f(p):\n    print(len(p))\n    eval(p)\n    getattr(p, 'x')\n    raise ValueError\n"}, {("m.f", None, "external"), ("m.f", "?eval", "unknown")}),
    "raise is a call of classes only": ({"m.py": "class E(Exception): pass\ndef make(): pass\ndef f(err):\n    raise err\ndef g():\n    raise E\ndef h():\n    raise make\n"}, {("m.g", "m.E", "internal")}),
    "values and parameters": (
        {"m.py": "def helper(): pass\ndef f(cb):\n    cb()\n    g = helper\n    g()\n    k = g\n    k()\n    cb.x()\n"},
        {("m.f", "?cb", "unknown"), ("m.f", "m.helper", "internal"), ("m.f", "?cb.x", "unknown")},
    ),
    "instances": (
        {"lib.py": "class A:\n    def run(self): pass\nclass B(A):\n    def own(self): pass\n", "m.py": "from lib import B\ndef f():\n    b = B()\n    b.run()\n    B().own()\n"},
        {("m.f", "lib.B", "internal"), ("m.f", "lib.A.run", "internal"), ("m.f", "lib.B.own", "internal")},
    ),
    "self, super and bases in other files": (
        {"base.py": "class Root:\n    def close(self): pass\n    def open(self): pass\n", "m.py": "import base\nclass C(base.Root):\n    def open(self):\n        super().open()\n        self.close()\n        self.gone()\n"},
        {("m.C.open", "base.Root.open", "internal"), ("m.C.open", None, "external"), ("m.C.open", "base.Root.close", "internal"), ("m.C.open", "?self.gone", "unknown")},
    ),
    "names handed on": (
        {"p/__init__.py": "from .core import work as job\nfrom .more import *\n", "p/core.py": "def work(): pass\n", "p/more.py": "def extra(): pass\n", "m.py": "import p\nfrom p import job\ndef f():\n    job()\n    p.extra()\n    p.core.work()\n"},
        {("m.f", "p.core.work", "internal"), ("m.f", "p.more.extra", "internal")},
    ),
    "dotted imports": ({"x/y/z.py": "def go(): pass\n", "m.py": "import x.y.z\nimport x.y.z as q\ndef f():\n    x.y.z.go()\n    q.go()\n"}, {("m.f", "x.y.z.go", "internal")}),
    "circles end": ({"a.py": "from b import t\n", "b.py": "from a import t\n", "m.py": "from a import t\ndef f():\n    t()\n"}, {("m.f", "?t", "unknown")}),
    "other packages": ({"m.py": "import requests\nfrom os import path\nimport nowhere.deep as d\ndef f():\n    requests.get('u')\n    path.join('a')\n    d.x()\n"}, {("m.f", None, "external")}),
    "functions inside": ({"m.py": "def outer():\n    def inner(): pass\n    inner()\n    def other():\n        inner()\n        outer()\n"}, {("m.outer", "m.outer.inner", "internal"), ("m.outer.other", "m.outer.inner", "internal"), ("m.outer.other", "m.outer", "internal")}),
    "computed": ({"m.py": "def f(d):\n    d['x']()\n    (lambda: 0)()\n    f(d)()\n"}, {("m.f", "?", "unknown"), ("m.f", "m.f", "internal")}),
}


def run(spark, files):
    src = spark.createDataFrame(list(files.items()), "rel_path string, content string")
    facts = extract.source_facts(src).cache()
    nodes = extract.file_nodes(src).unionByName(extract.def_nodes(facts)).cache()
    names = {r.node_id: r.file_path.removesuffix(".py").removesuffix("/__init__").replace("/", ".") + ("" if r.kind == "file" else "." + r.qualified_name) for r in nodes.collect()}
    return facts, nodes, resolve.resolve_sites(facts, src), names


@pytest.mark.parametrize("name", PROGRAMS)
def test_calls(spark, name):
    files, want = PROGRAMS[name]
    facts, nodes, sites, names = run(spark, files)
    got = set()
    for r in resolve.call_edges(sites, nodes).collect():
        told = names.get(r.dst_id) if r["class"] == "internal" else None if r["class"] == "external" else "?" + r.dst_id.removeprefix("unknown::")
        got.add((names[r.src_id], told, r["class"]))
    loose = {(s, "?" if d and d.startswith("?") and name == "computed" else None if d == "?a.go" else d, c) for s, d, c in got}
    assert loose == want


URLS = {
    "shop/views.py": "def index(request): pass\nclass Item:\n    def dispatch(self): pass\n    def get(self): pass\n    def other(self): pass\n",
    "other/tools.py": "def index(): pass\n",
    "shop/urls.py": "from . import views\nfrom shop.views import Item as Thing\nurlpatterns: list = [path('', views.index)]\nurlpatterns.append(path('i', Thing.as_view()))\nurlpatterns.extend([path('x', admin.site.urls)])\n",
}


def test_entry_points_are_the_views_that_names_lead_to(spark):
    facts, nodes, sites, names = run(spark, URLS)
    assert {names[r.node_id] for r in resolve.entry_points(facts, nodes, sites).collect()} == {"shop.views.index", "shop.views.Item", "shop.views.Item.dispatch", "shop.views.Item.get"}


def test_inherits_and_coverage(spark):
    files = {"a.py": "class Base: pass\nclass Late(Base): pass\n", "m.py": "from a import Late\nimport b\nclass C(Late, dict, b.X, Gone[int]): pass\ndef f():\n    C()\n    nope()\n"}
    facts, nodes, sites, names = run(spark, files)
    got = {(names[r.src_id], names.get(r.dst_id, r.dst_id)) for r in resolve.inherits_edges(sites, facts).collect()}
    assert got == {("a.Late", "a.Base"), ("m.C", "a.Late"), ("m.C", "unknown::Gone")}
    c = resolve.coverage(resolve.call_edges(sites, nodes)).first()
    assert (c.total, c.internal, c.unresolved, c.ratio) == (2, 1, 1, 0.5)


def test_root_package(spark):
    files = {"__init__.py": "", "core.py": "def go(): pass\n", "m.py": "from wares.core import go\ngo()\n"}
    src = spark.createDataFrame(list(files.items()), "rel_path string, content string")
    sites = resolve.resolve_sites(extract.source_facts(src), src, root="wares")
    assert [r.to for r in sites.rows.where("fact = 'call'").collect()] == ["core.py::go::L1"]
