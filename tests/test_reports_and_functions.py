import itertools
import json

import pytest
from pyspark.sql import functions as F

from tracelake.functions import scalar as S
from tracelake.operators import deps, evaluate, extract, incremental, locate, triage, resolve
from tracelake.sources import files, reports


def one(spark, column, **given):
    row = spark.createDataFrame([tuple(given.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in given.items()))
    return row.select(column.alias("x")).first()["x"]


def body(spark, report):
    return spark.createDataFrame([(json.dumps(report),)], "body string")


def test_version_keys_sort():
    order = ["1.0.dev1", "1.0a1", "1.0a2", "1.0b1", "1.0rc1", "1.0", "1.0.post1", "1.2", "1.10", "1.10.1", "2.0", "1!0.1"]
    keys = [S.version_sort_key(v) for v in order]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
    assert S.version_sort_key("1.0") == S.version_sort_key("1.0.0") == S.version_sort_key("v1")
    assert S.version_sort_key("unknown") is None and S.version_sort_key(None) is None


def test_version_keys_agree_with_packaging():
    version = pytest.importorskip("packaging.version")
    texts = [f"{a}{b}{c}{d}" for a, b, c, d in itertools.product(["1", "1.2", "1.10.3", "0.9"], ["", "a1", "b2", "rc1"], ["", ".post2"], ["", ".dev3"])]
    assert sorted(texts, key=lambda t: (version.Version(t), t)) == sorted(texts, key=lambda t: (S.version_sort_key(t), t))


@pytest.mark.parametrize(("text", "want"), [("78", "CWE-78"), ("CWE-78: x", "CWE-78"), ("cwe-079", "CWE-79"), ("0", None), ("n/a", None), ("", None)])
def test_cwe(spark, text, want):
    assert one(spark, S.cwe("c"), c=text) == want


def test_names_and_paths(spark):
    assert one(spark, S.canonical_name("c"), c="Foo_.Bar") == "foo-bar"
    assert one(spark, S.module_name("c"), c="src/a/__init__.py") == "src.a"
    assert one(spark, S.module_name("c"), c="a/b.pyi") == "a.b"
    assert one(spark, S.relative_path("c", "/r"), c="/r/a.py") == "a.py"
    assert one(spark, S.relative_path("c", "/r"), c="/other/a.py") is None
    assert one(spark, S.relative_path("c", "/r"), c="./a.py") == "a.py"
    df = spark.createDataFrame([("a.b", "c", 1), ("a.b", "c", 2), ("a", "c", 3), ("a", "c", 0), ("a.b", "", 1)], "p string, m string, l int")
    assert [r.x for r in df.select(S.absolute_module("p", "m", "l").alias("x")).collect()] == ["a.b.c", "a.c", None, "c", "a.b"]


def test_bandit(spark):
    r = {"results": [
        {"filename": "/r/a.py", "line_number": 3, "line_range": [3, 4, 5], "test_id": "B1", "issue_severity": "HIGH", "issue_confidence": "LOW", "issue_cwe": {"id": 78}, "issue_text": "t"},
        {"filename": "/elsewhere/a.py", "line_number": 1, "line_range": None, "test_id": "B2", "issue_severity": "?", "issue_text": "t"},
        {"filename": "b.py", "line_number": 7, "line_range": None, "test_id": "B3", "issue_severity": None, "issue_text": "t"}], "errors": []}
    got = [(x.rel_path, x.line, x.end_line, x.severity, x.confidence, x.cwe) for x in reports.bandit(body(spark, r), "/r").collect()]
    assert got == [("a.py", 3, 5, "high", "low", "CWE-78"), ("b.py", 7, 7, "low", None, None)]


def test_semgrep_and_gitleaks(spark):
    r = {"results": [
        {"check_id": "rules.web.x", "path": "a.py", "start": {"line": 1}, "end": {"line": 2}, "extra": {"severity": "ERROR", "message": "m", "metadata": {"cwe": ["CWE-89: SQL", "CWE-1"], "confidence": "HIGH"}}},
        {"check_id": "y", "path": "a.py", "start": {"line": 1}, "extra": {"severity": "INFO", "message": "m", "metadata": {"cwe": "CWE-22"}}}]}
    got = [(x.rule_id, x.end_line, x.severity, x.cwe, x.confidence) for x in reports.semgrep(body(spark, r), "/r", ["rules.", "rules.web."]).collect()]
    assert got == [("x", 2, "high", "CWE-89", "high"), ("y", 1, "low", "CWE-22", None)]
    g = [{"File": "a.env", "RuleID": "k", "StartLine": 2, "EndLine": 2, "Description": "d", "Secret": "s3cret"}, {"RuleID": "k"}, {"File": "venv/x.py", "RuleID": "k"}]
    df = reports.gitleaks(body(spark, g), "/r")
    assert [(x.rel_path, x.severity, x.cwe) for x in df.collect()] == [("a.env", "high", "CWE-798")]
    assert "s3cret" not in str(df.collect())


def test_osv(spark):
    def vuln(i, *fixes, kind="SEMVER", name="Pkg_A"):
        return {"id": i, "summary": "", "database_specific": {"cwe_ids": ["CWE-79"]}, "affected": [{"package": {"name": name}, "ranges": [{"type": kind, "events": [{"introduced": "0"}, *({"fixed": f} for f in fixes)]}]}]}

    package = {"package": {"name": "pkg-a", "version": "1.9"}, "groups": [{"ids": ["GHSA-1", "GHSA-2"], "aliases": ["CVE-1"], "max_severity": "9.8"}, {"ids": ["GHSA-3"], "max_severity": "n/a"}],
               "vulnerabilities": [vuln("GHSA-1", "1.8", "1.10", "2.0"), vuln("GHSA-2", "1.9.5"), vuln("GHSA-3", "3.0", kind="GIT")]}
    r = {"results": [{"source": {"path": "req.txt"}, "packages": [package]}, {"source": {"path": "other.txt"}, "packages": [package]}]}
    got = sorted((x.rule_id, x.rel_path, x.severity, x.fixed_in, x.cwe) for x in reports.osv(body(spark, r)).collect())
    assert got == [("CVE-1", "req.txt", "critical", "1.10", "CWE-79"), ("GHSA-3", "req.txt", "low", None, "CWE-79")]


def test_scan_status(spark):
    df = spark.createDataFrame([("a", '{"errors": [{"filename": "f", "reason": "r"}]}'), ("b", "oops")], "path string, body string")
    assert [(r.status, r.errors) for r in reports.scan_status(df, "bandit", reports.BANDIT).collect()] == [("ok", ["f: r"]), ("failed", [])]


def test_innermost_ties(spark):
    spans = spark.createDataFrame([("a", "f", 1, 9, 1), ("b", "f", 3, 6, 2), ("c", "f", 3, 8, 3)], "node_id string, file_path string, start_line int, end_line int, ordinal int")
    sites = spark.createDataFrame([("s1", "f", 4), ("s2", "f", 2), ("s3", "f", 99), ("s4", "g", 4)], "site_id string, file_path string, line int")
    first = {r.site_id: r.node_id for r in locate.innermost(sites, spans).collect()}
    last = {r.site_id: r.node_id for r in locate.innermost(sites, spans, last=True).collect()}
    assert first == {"s1": "b", "s2": "a", "s3": None, "s4": None} and last["s1"] == "c"


def test_finding_ids_survive_moves(spark):
    schema = "source string, rule_id string, rel_path string, source_hash string, line_text string, package string, package_version string, line int, scan_ordinal int"
    a = spark.createDataFrame([("b", "R", "x.py", "h", "t", None, None, 1, 1), ("b", "R", "x.py", "h", "t", None, None, 5, 2), ("o", "C", "m1", None, "", "P_a", "1", 0, 3), ("o", "C", "m2", None, "", "p-a", "1", 0, 4)], schema)
    b = spark.createDataFrame([("b", "R", "moved.py", "h", "t", None, None, 40, 9), ("b", "R", "moved.py", "h", "t", None, None, 50, 10)], schema)
    one_, two = ([r.finding_id for r in locate.finding_ids(x).orderBy("scan_ordinal").collect()] for x in (a, b))
    assert one_[:2] == two and one_[2] == one_[3] and len(set(one_)) == 3


def test_mapping_stats_of_nothing(spark):
    r = locate.mapping_stats(spark.createDataFrame([], "status string")).first()
    assert (r.total, r.mapped, r.ratio) == (0, 0, 1.0)


SAMPLE = {
    "app/__init__.py": "",
    "app/util.py": "def helper(x):\n    return eval(x)\n\nclass Base:\n    def run(self):\n        return helper(1)\n",
    "app/web.py": "import os\nfrom app.util import helper, Base\nfrom . import missing\nimport requests\n\n@app.get('/x')\ndef page():\n    '''Doc.'''\n    helper(2)\n    requests.get('u')\n    return os.getcwd()\n\nclass View(Base):\n    def get(self):\n        self.inner()\n        (lambda: 0)()\n    def inner(self):\n        pass\n",
    "urls.py": "from app.web import View\nurlpatterns = [path('v/', View.as_view()), path('i', include('x'))]\nurlpatterns += [path('w', login(page))]\n",
    "bad.py": "def (:\n",
}


def test_extraction(spark):
    src = spark.createDataFrame(list(SAMPLE.items()), "rel_path string, content string")
    facts = extract.source_facts(src).cache()
    nodes = extract.file_nodes(src).unionByName(extract.def_nodes(facts)).cache()
    ids = {r.node_id: r for r in nodes.collect()}
    assert "bad.py::<file>" in ids and "app/web.py::page::L7" in ids and ids["app/web.py::page::L7"].docstring == "Doc."
    assert ids["app/__init__.py::<file>"].qualified_name == "app"
    edges, refs = resolve.resolve_imports(facts, src)
    sites = resolve.resolve_sites(facts, src)
    got = {(r.src_id, r.dst_id, r.resolved) for r in edges.collect()}
    assert ("app/web.py::<file>", "app/util.py::<file>", True) in got
    assert any(s == "app/web.py::<file>" and "unknown::" not in d and not ok or d.startswith("unknown::app") or d == "app/__init__.py::<file>" for s, d, ok in got)
    assert {r.package for r in refs.collect()} == {"os", "requests"}
    calls = {(r.src_id, r.dst_id, r["class"]) for r in resolve.call_edges(sites, nodes).collect()}
    assert ("app/util.py::Base.run::L5", "app/util.py::helper::L1", "internal") in calls
    assert ("app/web.py::page::L7", "app/util.py::helper::L1", "internal") in calls
    assert ("app/web.py::page::L7", None, "external") in calls
    assert ("app/web.py::View.get::L14", "app/web.py::View.inner::L17", "internal") in calls
    assert ("app/util.py::helper::L1", "unknown::eval", "unknown") in calls
    entry = {r.node_id for r in resolve.entry_points(facts, nodes, sites).collect()}
    assert entry == {"app/web.py::page::L7", "app/web.py::View::L13", "app/web.py::View.get::L14"}
    up = {(r.src_id, r.dst_id) for r in resolve.inherits_edges(sites, facts).collect()}
    assert up == {("app/web.py::View::L13", "app/util.py::Base::L4")}
    parents = {r.child_id: r.parent_id for r in locate.parent_defs(nodes).collect()}
    assert parents["app/web.py::View.get::L14"] == "app/web.py::View::L13" and parents["app/util.py::helper::L1"] == "app/util.py::<file>"


def test_discover(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "venv").mkdir()
    (tmp_path / "pkg/a.py").write_text("x = 1\ny = 2\n")
    (tmp_path / "pkg/b.txt").write_text("no")
    (tmp_path / "venv/c.py").write_text("no")
    (tmp_path / "e.pyi").write_text("")
    got = {r.rel_path: r.lines for r in files.discover(spark, str(tmp_path)).collect()}
    assert got == {"pkg/a.py": 3, "e.pyi": 0}


def test_truth_and_graph_files(spark, tmp_path):
    p = tmp_path / "t.toml"
    p.write_text('[repo]\nlocal = "x"\n[[truth]]\nid = "1"\nfile = "a.py"\nfunction = "f"\ncwes = ["CWE-1"]\nclass = "k"\n')
    repo, truth = files.load_truth(spark, str(p))
    assert repo == {"local": "x"} and truth.first()["cwes"] == ["CWE-1"]
    p.write_text("[repo]\n")
    with pytest.raises(ValueError, match="needs"):
        files.load_truth(spark, str(p))
    (tmp_path / "g.json").write_text('{"a": ["b", "c"], "b": []}')
    assert {(r.src, r.dst) for r in files.load_call_graph(spark, str(tmp_path / "g.json")).collect()} == {("a", "b"), ("a", "c")}


def test_distributions(spark, tmp_path):
    for name, meta in (("Foo_Bar-1.2", {"METADATA": "Name: Foo\nRequires-Dist: base>=1\nRequires-Dist: opt; extra == 'x'\n", "top_level.txt": "foo\n"}), ("base-2.0", {"METADATA": "Name: base\n", "RECORD": "basemod/__init__.py,,\nbase-2.0.dist-info/METADATA,,\nsolo.py,,\n"})):
        d = tmp_path / f"{name}.dist-info"
        d.mkdir()
        for f, t in meta.items():
            (d / f).write_text(t)
    dists = files.distributions(spark, str(tmp_path)).cache()
    assert {(r.dist, r.import_name) for r in deps.import_names(dists).collect()} == {("foo-bar", "foo"), ("base", "basemod"), ("base", "solo")}
    req = deps.requirements(dists)
    assert {(r.parent, r.name) for r in req.collect()} == {("foo-bar", "base")}
    refs = spark.createDataFrame([("n1", "foo")], "node_id string, package string")
    f = spark.createDataFrame([("f1", "base"), ("f2", "foo.bar"), ("f3", "none")], "finding_id string, package string")
    above = spark.createDataFrame([("base", "foo-bar")], "name string, parent string")
    got = {r.finding_id: (r.anchors, r.via) for r in deps.package_anchors(f, deps.import_names(dists), refs, above).collect()}
    assert got == {"f1": (["n1"], ["foo-bar"]), "f2": (["n1"], []), "f3": ([], [])}


def test_deprecation_markers():
    src = "import warnings\n@deprecated('use y')\ndef x(): pass\ndef y():\n    if a:\n        warnings.warn('old', DeprecationWarning)\ndef z():\n    warnings.warn('note')\n"
    assert deps.deprecation_marker(src, 3)["kind"] == "decorator"
    assert deps.deprecation_marker(src, 4) == {"kind": "warning", "category": "DeprecationWarning", "message": "old", "conditional": True}
    assert deps.deprecation_marker(src, 7) is None
    assert deps.deprecation_marker("(", 1) is None


def test_dependency_report(spark):
    rows = [("Pk_a", "1", "A", "1.9", "reachable"), ("pk-a", "1", "B", "1.10", "unknown"), ("b", "1", "C", None, None), ("c", "1", "D", "2", "unreachable")]
    adv = spark.createDataFrame(rows, "package string, package_version string, rule_id string, fixed_in string, reachable string")
    dep = spark.createDataFrame([("d", "f"), ("d", "g")], "package string, symbol string")
    got = [(r.package, r.urgency, r.upgrade_to, r.unfixed) for r in deps.dependency_report(adv, dep).collect()]
    assert got == [("pk-a", "urgent", "1.10", 0), ("b", "check", None, 1), ("c", "routine", "2", 0), ("d", "migrate", None, None)]
    assert one(spark, deps.pin_is_stale(F.col("a"), F.col("b"), F.col("c")), a="1.10", b="1.9", c="1.2")


def test_scores_of_nothing(spark):
    f = spark.createDataFrame([], "finding_id string, file_path string, qualified_name string, cwe string, package string, reachable string, severity string, verdict string, repo string")
    t = spark.createDataFrame([], "repo string, case_id string, file string, function string, cwes array<string>")
    assert evaluate.scores(f, evaluate.hits(f, t), t).collect() == []
    assert evaluate.recall_of_traces(spark.createDataFrame([], "caller string, callee string"), spark.createDataFrame([], "src_id string, dst_id string, resolved boolean")).first()["recall"] == 1.0


def test_graph_cases(spark):
    cases = spark.createDataFrame([("edge", "a", "b"), ("no_edge", "a", "c"), ("unknown", "a", "d"), ("edge", "a", "z")], "expect string, src string, dst string")
    edges = spark.createDataFrame([("a", "b", True), ("a", "unknown::d", False)], "src_id string, dst_id string, resolved boolean")
    assert {(r.dst): r.passed for r in evaluate.graph_cases(cases, edges).collect()} == {"b": True, "c": True, "d": True, "z": False}


def greedy(gone, came):
    """Pairs by file, then name, then any, each in order of ids."""
    out, g, c = [], list(gone), list(came)
    for same in (lambda a, b: a[0] == b[0], lambda a, b: a[1] == b[1], lambda a, b: True):
        for a in sorted(g, key=lambda x: x[2]):
            b = min((x for x in c if same(a, x)), key=lambda x: x[2], default=None)
            if b:
                out.append((a[2], b[2]))
                g.remove(a)
                c.remove(b)
    return set(out)


def test_renames(spark):
    gone = [("f1", "a", "o1"), ("f1", "b", "o2"), ("f2", "a", "o3")]
    came = [("f1", "x", "n1"), ("f3", "b", "n2"), ("f3", "q", "n3"), ("f4", "r", "n4")]
    rows = [("h", f, q, i, None, "function", "deleted") for f, q, i in gone] + [("h", f, q, None, i, "function", "added") for f, q, i in came] + [(None, "f", "q", "o9", None, "function", "deleted"), (None, "f", "q", None, "n9", "function", "added")]
    diff = spark.createDataFrame(rows, "source_hash string, file_path string, qualified_name string, old_id string, new_id string, kind string, status string")
    assert {(r.old_id, r.new_id) for r in incremental.renames(diff).collect()} == greedy(gone, came)


def test_splice_equals_full(spark):
    e = "src_id string, src_file string, dst_id string, kind string, resolved boolean"
    old = spark.createDataFrame([("a1", "a", "b1", "calls", True), ("b1", "b", "a1", "calls", True), ("c1", "c", "b1", "calls", True)], e)
    full = {("a1", "a", "b2", "calls", True), ("b2", "b", "a1", "calls", True), ("c1", "c", "b2", "calls", True)}
    fresh = spark.createDataFrame([("b2", "b", "a1", "calls", True)], e)
    n = "file_path string, qualified_name string, node_id string, source_hash string, kind string"
    before = spark.createDataFrame([("a", "a", "a1", "h", "function"), ("b", "b", "b1", "h2", "function")], n)
    after = spark.createDataFrame([("a", "a", "a1", "h", "function"), ("b", "b", "b2", "h2", "function")], n)
    diff = incremental.node_diff(before, after)
    none = spark.createDataFrame([], "old_id string, new_id string")
    got = incremental.splice(old, fresh, diff, none, spark.createDataFrame([("b",)], "path string"))
    assert {tuple(r) for r in got.collect()} == full


def test_triage(spark):
    rows = [(1, "unreachable", "p", 1), (2, "reachable", "untrusted request here", 2), (3, "unknown", "value is escaped", 3), (4, "unknown", "long " * 50, 4)]
    f = spark.createDataFrame(rows, "finding_id int, reachable string, prompt string, ordinal int").withColumn("context_hash", F.sha2("prompt", 256))
    p = triage.KeywordProvider()
    got = {r.finding_id: (r.verdict, r.how) for r in triage.adjudicate(f, p).collect()}
    assert got == {1: ("unreachable", "skipped"), 2: ("real", "called"), 3: ("false_positive", "called"), 4: ("needs_review", "called")}
    tight = {r.finding_id: r.how for r in triage.adjudicate(f, p, limit=4).collect()}
    assert tight == {1: "skipped", 2: "called", 3: "called", 4: "budget"}
    cache = triage.cache_rows(triage.adjudicate(f, p), f, p)
    again = {r.finding_id: r.how for r in triage.adjudicate(f, p, cache).collect()}
    assert again == {1: "skipped", 2: "cached", 3: "cached", 4: "cached"}
    assert triage.triage_stats(triage.adjudicate(f, p)).first()["n_called"] == 3


def test_summaries_go_callee_first(spark):
    nodes = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "node_id string, code string").withColumn("qualified_name", F.col("code")).withColumn("source_hash", F.col("code"))
    calls = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b")], "src_id string, dst_id string")
    got = {r.node_id: (r.level, r.summary) for r in triage.summarise(nodes, calls, lambda c, t: f"{c}({','.join(t)})").collect()}
    assert got == {"b": (0, "B()"), "c": (0, "C()"), "a": (1, "A(B())")}


def test_unknown_mentions(spark):
    texts = spark.createDataFrame([(1, "uses `known` and `mod.known()` but `ghost`"), (2, None)], "id int, t string")
    names = spark.createDataFrame([("known",)], "name string")
    assert [(r.id, r.name) for r in triage.unknown_mentions(texts, names, "id", "t").collect()] == [(1, "ghost")]


def test_file_changes(spark):
    s = "rel_path string, content_hash string"
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("n", None), ("m", None)], s)
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "3"), ("e", "5"), ("n", None), ("m", "1")], s)
    assert {(r.path, r.kind, r.old_path) for r in incremental.file_changes(old, new).collect()} == {("b", "modified", None), ("d", "renamed", "c"), ("e", "added", None), ("m", "modified", None)}
