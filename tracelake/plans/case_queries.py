"""Operators over small cases with results worked out by hand, for what SQL can't compute from the tables.

Each case is a few rows or a small program; its SQL is the list of expected rows.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.core import ship
from tracelake.functions import scalar as S
from tracelake.operators import deps, evaluate, extract, incremental, locate, reach, report, resolve, triage
from tracelake.operators import graph as G
from tracelake.sources import files as source_files
from tracelake.sources import reports


def _value(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, float):
        return f"CAST({v} AS DOUBLE)"
    if isinstance(v, int):
        return f"CAST({v} AS BIGINT)"
    return "'" + v.replace("'", "''") + "'"


def rows(names: str, *values: tuple) -> str:
    """SQL of the expected rows."""
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_value, v)) + ")" for v in values) + ") AS t(" + ", ".join(f'"{n.strip()}"' for n in names.split(",")) + ")"


def _texts(spark: SparkSession, programs: dict[str, str]) -> DataFrame:
    ship(spark)
    return spark.createDataFrame(list(programs.items()), "rel_path string, content string")


def _body(spark: SparkSession, *bodies: object) -> DataFrame:
    return spark.createDataFrame([(b if isinstance(b, str) else json.dumps(b),) for b in bodies], "body string")


PROGRAM = {
    "app/__init__.py": "from .core import work as job\n",
    "app/core.py": "class Base:\n    def close(self):\n        pass\ndef work():\n    return Base()\n",
    "app/views.py": (
        "import os\nfrom app import job, core\nimport app.core as c\nclass Page(core.Base):\n    def get(self):\n        job()\n        self.close()\n        return helper(print)\n"
        "    def helper(self):\n        return os.getcwd()\ndef helper(f):\n    f()\n    b = c.Base()\n    b.close()\n    raise f\ndef index(request):\n    raise ValueError\n@app.get('/x')\ndef api():\n    return eval('1')\n"
    ),
    "urls.py": "from app import views\nfrom app.views import Page as P\nurlpatterns: list = [path('', views.index)]\nurlpatterns.append(path('p', P.as_view()))\n",
    "other/index.py": "def index(): pass\nimport requests.sessions\nimport app.gone\n",
    "broken.py": "def (:\n",
}


def _program(spark: SparkSession):
    src = _texts(spark, PROGRAM)
    facts = G.cut(extract.source_facts(src))
    return src, facts, extract.file_nodes(src).unionByName(extract.def_nodes(facts))


def case_nodes(spark, sf_dir) -> DataFrame:
    src, facts, nodes = _program(spark)
    return nodes.select("node_id", "kind", "qualified_name", F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line"))


def case_calls(spark, sf_dir) -> DataFrame:
    src, facts, nodes = _program(spark)
    return resolve.call_edges(resolve.resolve_sites(facts, src), nodes).select("src_id", "dst_id", "class")


def case_coverage(spark, sf_dir) -> DataFrame:
    src, facts, nodes = _program(spark)
    c = resolve.coverage(resolve.call_edges(resolve.resolve_sites(facts, src), nodes))
    return c.select("total", "internal", "external", "unresolved", F.round("ratio", 6).alias("ratio"))


def case_imports(spark, sf_dir) -> DataFrame:
    src, facts, nodes = _program(spark)
    edges, refs = resolve.resolve_imports(facts, src)
    return edges.select("src_id", "dst_id", "resolved").unionByName(refs.select(F.col("node_id").alias("src_id"), F.concat(F.lit("package "), "package").alias("dst_id"), F.lit(None).cast("boolean").alias("resolved")))


def case_inherits(spark, sf_dir) -> DataFrame:
    src, facts, nodes = _program(spark)
    return resolve.inherits_edges(resolve.resolve_sites(facts, src), facts).select("src_id", "dst_id", "resolved")


def case_entry_points(spark, sf_dir) -> DataFrame:
    src, facts, nodes = _program(spark)
    return resolve.entry_points(facts, nodes, resolve.resolve_sites(facts, src))


def case_defines(spark, sf_dir) -> DataFrame:
    return resolve.defines_edges(_program(spark)[2]).select("src_id", "dst_id")


_BANDIT = {"results": [
    {"filename": "/r/a.py", "line_number": 3, "line_range": [3, 4, 5], "test_id": "B602", "issue_severity": "HIGH", "issue_confidence": "LOW", "issue_cwe": {"id": 78}, "issue_text": "shell"},
    {"filename": "/elsewhere/a.py", "line_number": 1, "test_id": "B101", "issue_severity": "LOW", "issue_text": "outside"},
    {"filename": "b.py", "line_number": 7, "test_id": "B303", "issue_severity": "MEDIUM", "issue_text": "md5"},
]}


def case_bandit(spark, sf_dir) -> DataFrame:
    r = reports.bandit(_body(spark, _BANDIT), "/r")
    return r.select("source", "rule_id", "rel_path", F.col("line").cast("bigint").alias("line"), F.col("end_line").cast("bigint").alias("end_line"), "raw_severity", "severity", "confidence", "cwe", "message")


_SEMGREP = {"results": [
    {"check_id": "rules.web.sql", "path": "a.py", "start": {"line": 1}, "end": {"line": 2}, "extra": {"severity": "ERROR", "message": "m", "metadata": {"cwe": ["CWE-89: SQL", "CWE-1"], "confidence": "HIGH"}}},
    {"check_id": "path", "path": "/r/b.py", "start": {"line": 4}, "extra": {"severity": "INFO", "message": "n", "metadata": {"cwe": "CWE-22"}}},
    {"check_id": "gone", "path": "/x/b.py", "start": {"line": 4}, "extra": {"severity": "INFO", "message": "n", "metadata": {}}},
]}


def case_semgrep(spark, sf_dir) -> DataFrame:
    r = reports.semgrep(_body(spark, _SEMGREP), "/r", ["rules.", "rules.web."])
    return r.select("source", "rule_id", "rel_path", F.col("line").cast("bigint").alias("line"), F.col("end_line").cast("bigint").alias("end_line"), "severity", "confidence", "cwe")


def case_gitleaks(spark, sf_dir) -> DataFrame:
    g = [{"File": "a.env", "RuleID": "k", "StartLine": 2, "EndLine": 3, "Description": "d", "Secret": "never read"}, {"RuleID": "k"}, {"File": "venv/x.py", "RuleID": "k"}, {"File": "venv", "RuleID": "f", "StartLine": 1}]
    r = reports.gitleaks(_body(spark, g), "/r")
    return r.select("source", "rule_id", "rel_path", F.col("line").cast("bigint").alias("line"), F.col("end_line").cast("bigint").alias("end_line"), "raw_severity", "severity", "cwe", "message")


def _advisory(i: str, *fixes: str, kind: str = "SEMVER") -> dict:
    return {"id": i, "summary": f"about {i}", "database_specific": {"cwe_ids": ["CWE-79"]}, "affected": [{"package": {"name": "Pkg_A"}, "ranges": [{"type": kind, "events": [{"introduced": "0"}, *({"fixed": f} for f in fixes)]}]}]}


_OSV_PACKAGE = {
    "package": {"name": "pkg-a", "version": "1.9"},
    "groups": [{"ids": ["GHSA-1", "GHSA-2"], "aliases": ["CVE-1"], "max_severity": "9.8"}, {"ids": ["GHSA-3"], "max_severity": "n/a"}],
    "vulnerabilities": [_advisory("GHSA-1", "1.8", "1.10", "2.0"), _advisory("GHSA-2", "1.9.5"), _advisory("GHSA-3", "3.0", kind="GIT")],
}


def case_osv(spark, sf_dir) -> DataFrame:
    r = {"results": [{"source": {"path": "req.txt"}, "packages": [_OSV_PACKAGE]}, {"source": {"path": "again.txt"}, "packages": [_OSV_PACKAGE]}]}
    return reports.osv(_body(spark, r)).select("rule_id", "rel_path", "package", "package_version", "raw_severity", "severity", "fixed_in", "cwe", F.array_join("aliases", ",").alias("aliases"))


def case_scan_status(spark, sf_dir) -> DataFrame:
    df = spark.createDataFrame([("a", '{"results": [], "errors": [{"filename": "f", "reason": "r"}]}'), ("b", "oops"), ("c", '{"results": []}')], "path string, body string")
    return reports.scan_status(df, "bandit", reports.BANDIT).select("source", "path", "status", F.array_join("errors", ";").alias("errors"))


def case_names(spark, sf_dir) -> DataFrame:
    """Names, modules and paths."""
    df = spark.createDataFrame([(1, "Foo_.Bar", "src/a/__init__.py", "/r/x/a.py", "a.b", "c", 1), (2, "b--c", "a/b.pyi", "./q.py", "a.b", "c", 2), (3, "x", "__init__.py", "/other/a.py", "a", "c", 3), (4, "Y", "m.pyw", "../up.py", "a.b", "", 1)], "id bigint, p string, f string, q string, pkg string, m string, l int")
    return df.select("id", S.canonical_name("p").alias("canonical"), S.import_name("p").alias("import_name"), S.module_name("f").alias("module"), S.relative_path("q", "/r").alias("rel"), S.absolute_module("pkg", "m", "l").alias("absolute"), S.last_part("pkg").alias("last"), S.first_part("pkg").alias("first"))


def case_texts(spark, sf_dir) -> DataFrame:
    """Locations, shares, cleaned text, names in backticks, remote targets."""
    df = spark.createDataFrame([(1, "a.py", 3, 0.1234, "  two \n words ", "calls `a.b()` and `c`", "https://h/x", 2.0), (2, "b.py", 0, None, "", "none", "./local", -1.0), (3, "c.py", None, 1.0, "x", "`1no` `ok_2`", "github.com/a/b", 0.5)], "id bigint, p string, l int, share double, t string, b string, u string, c double")
    return df.select("id", S.location("p", "l").alias("location"), S.percent("share").alias("percent"), S.clean_text("t").alias("text"), F.array_join(S.backticked("b"), ",").alias("names"), S.is_remote("u").alias("remote"), S.clamp("c").alias("clamped"))


_VERSIONS = ["1.0.dev1", "1.0a1", "1.0a2", "1.0b1", "1.0rc1", "1.0", "1.0.post1", "1.2", "1.10", "1.10.1", "2.0", "1!0.1"]


def case_versions(spark, sf_dir) -> DataFrame:
    """Place of versions in their order; texts that are none have no place."""
    df = spark.createDataFrame([(v,) for v in [*reversed(_VERSIONS), "unknown", "v1.0.0"]], "v string").withColumn("k", S.version_key("v"))
    keys = df.where("k is not null").select("k").distinct().withColumn("i", F.lit(1))
    below = df.alias("a").join(keys.withColumnRenamed("k", "k2"), F.col("k2") < F.col("a.k"), "left").groupBy("v").agg(F.count("i").alias("place"), F.max(F.col("a.k").isNotNull()).alias("valid"))
    return below.select("v", F.when(F.col("valid"), F.col("place")).alias("place"))


def case_mro(spark, sf_dir) -> DataFrame:
    """Linearisation of a diamond, a chain, an inconsistent and a circular hierarchy."""
    links = [("D", "B", 1), ("D", "C", 2), ("B", "A", 1), ("C", "A", 1), ("X", "A", 1), ("X", "B", 2), ("P", "Q", 1), ("Q", "P", 1)]
    ship(spark)
    return G.method_orders(spark.createDataFrame(links, "cls string, base string, ordinal int")).select("cls", F.col("position").cast("bigint").alias("position"), "base")


def case_levels(spark, sf_dir) -> DataFrame:
    calls = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("a", "d"), ("e", "e")], "src_id string, dst_id string")
    defs = spark.createDataFrame([(x,) for x in "abcdef"], "node_id string")
    return G.callee_first(calls, defs).select("node", "component", F.col("level").cast("bigint").alias("level"))


def _pick(df: DataFrame, *names: str) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*(F.col(n).cast("bigint").alias(n) if kinds[n] == "int" else F.array_join(n, ",").alias(n) if kinds[n] == "array<string>" else F.col(n) for n in names))


def case_renames(spark, sf_dir) -> DataFrame:
    gone = [("f1", "a", "o1"), ("f1", "b", "o2"), ("f2", "a", "o3")]
    came = [("f1", "x", "n1"), ("f3", "b", "n2"), ("f3", "q", "n3"), ("f4", "r", "n4")]
    r = [("h", f, q, i, None, "function", "deleted") for f, q, i in gone] + [("h", f, q, None, i, "function", "added") for f, q, i in came] + [(None, "f", "q", "o9", None, "function", "deleted"), (None, "f", "q", None, "n9", "function", "added")]
    return incremental.renames(spark.createDataFrame(r, "source_hash string, file_path string, qualified_name string, old_id string, new_id string, kind string, status string"))


def case_splice(spark, sf_dir) -> DataFrame:
    """Edges after one file changed: its own are new, others follow the new id of what moved down in it."""
    e = "src_id string, src_file string, dst_id string, kind string, resolved boolean"
    n = "file_path string, qualified_name string, node_id string, source_hash string, kind string"
    old = spark.createDataFrame([("a1", "a", "b1", "calls", True), ("b1", "b", "a1", "calls", True), ("c1", "c", "b1", "calls", True), ("c1", "c", "g1", "calls", True)], e)
    before = spark.createDataFrame([("a", "a", "a1", "h", "function"), ("b", "b", "b1", "h2", "function"), ("b", "g", "g1", "h3", "function")], n)
    after = spark.createDataFrame([("a", "a", "a1", "h", "function"), ("b", "b", "b2", "h2", "function")], n)
    fresh = spark.createDataFrame([("b2", "b", "a1", "calls", True)], e)
    return incremental.splice(old, fresh, incremental.node_diff(before, after), spark.createDataFrame([], "old_id string, new_id string"), spark.createDataFrame([("b",)], "path string"))


def case_anchors(spark, sf_dir) -> DataFrame:
    """Files that use a dependency, directly or through what needs it."""
    d = [("foo-bar", "1", "top_level.txt", "foo\n"), ("foo-bar", "1", "METADATA", "Requires-Dist: Base>=1\nRequires-Dist: opt ; extra == 'x'\n"), ("base", "2", "RECORD", "basemod/__init__.py,,\nsolo.py,,\nbase-2.dist-info/METADATA,,\n"), ("own_name", "3", "METADATA", "")]
    dists = spark.createDataFrame(d, "dist string, version string, file string, body string")
    names = deps.import_names(dists)
    above = G.required_by(deps.requirements(dists).select("parent", "name"), deps.requirements(dists).select("name").distinct())
    refs = spark.createDataFrame([("n1", "foo"), ("n2", "foo"), ("n3", "own_name")], "node_id string, package string")
    f = spark.createDataFrame([("direct", "Foo.Bar"), ("through", "base"), ("own", "own-name"), ("none", "absent")], "finding_id string, package string")
    return _pick(deps.package_anchors(f, names, refs, above), "finding_id", "anchors", "via")


def case_installed(spark, sf_dir) -> DataFrame:
    d = [("foo-bar", "1", "top_level.txt", "foo\n"), ("base", "2", "RECORD", "basemod/__init__.py,,\nsolo.py,,\n"), ("own_name", "3", "METADATA", "")]
    return deps.installed_versions(spark.createDataFrame(d, "dist string, version string, file string, body string"))


_LIBRARY = "import warnings\n@deprecated('use y')\ndef x(): pass\ndef y():\n    if a:\n        warnings.warn('old', DeprecationWarning)\ndef z():\n    warnings.warn('note')\n"


def case_deprecated(spark, sf_dir) -> DataFrame:
    """Uses of what a library marks as deprecated."""
    ship(spark)
    sources = spark.createDataFrame([("lib.py", n, _LIBRARY) for n in (3, 4, 7)], "def_path string, def_line int, content string")
    uses = spark.createDataFrame([("n1", 5, "lib", "x", "lib.py", 3), ("n2", 6, "lib", "y", "lib.py", 4), ("n3", 7, "lib", "z", "lib.py", 7), ("n4", 8, "lib", "q", None, None)], "node_id string, line bigint, package string, symbol string, def_path string, def_line int")
    found, stats = deps.deprecated_uses(uses, deps.read_markers(sources))
    told = found.select("node_id", "symbol", "marker.kind", "marker.category", "marker.message", "marker.conditional")
    none = F.lit(None).cast("string")
    return told.unionByName(stats.select(none.alias("node_id"), F.concat_ws("/", "checked", "deprecated", "no_source").alias("symbol"), none.alias("kind"), none.alias("category"), none.alias("message"), F.lit(None).cast("boolean").alias("conditional")))


def _upgrades(spark: SparkSession) -> DataFrame:
    ship(spark)
    a = [("Flask", "2.2.2", "CVE-F1", "HIGH", "2.2.5", "reachable"), ("flask", "2.2.2", "CVE-F1", "HIGH", "2.2.5", "unknown"), ("Flask", "2.2.2", "CVE-F2", "low", "2.3.2", "reachable"), ("Werkzeug", "2.2.2", "CVE-W1", "medium", "2.2.3", "reachable"), ("Werkzeug", "2.2.2", "CVE-W2", "critical", None, "reachable"), ("Django", "3.2", "CVE-D", "high", "3.2.5", "unknown"), ("idle", "1", "CVE-I", "high", None, "unreachable")]
    adv = spark.createDataFrame(a, "package string, package_version string, rule_id string, severity string, fixed_in string, reachable string")
    refs = spark.createDataFrame([("n1", "a.py", "flask"), ("n1", "a.py", "flask"), ("n2", "b.py", "flask"), ("n3", "a.py", "tidy")], "node_id string, file_path string, package string")
    names = spark.createDataFrame([("flask", "flask"), ("werkzeug", "werkzeug")], "dist string, import_name string")
    above = spark.createDataFrame([("werkzeug", "flask")], "name string, parent string")
    have = spark.createDataFrame([("flask", "3.1.3"), ("werkzeug", "2.2.2")], "package string, version string")
    calls = spark.createDataFrame([("old", "old.f", "reachable"), ("old", "old.f", "unreachable"), ("old", "old.g", None)], "package string, symbol string, reachable string")
    return deps.upgrade_report(adv, refs, names, above, have, calls)


def case_upgrades(spark, sf_dir) -> DataFrame:
    r = _upgrades(spark)
    return _pick(r, "package", "version", "declared", "n_advisories", "worst_severity", "upgrade_to", "unfixed", "worst", "references", "files", "users", "via", "n_deprecated", "symbols", "pin_is_stale", "urgency")


def case_upgrade_summary(spark, sf_dir) -> DataFrame:
    return deps.upgrade_summary(_upgrades(spark))


def case_trace_recall(spark, sf_dir) -> DataFrame:
    seen = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "c"), ("b", "d")], "caller string, callee string")
    edges = spark.createDataFrame([("a", "b", True), ("a", "unknown::c", False)], "src_id string, dst_id string, resolved boolean")
    return evaluate.recall_of_traces(seen, edges)


def case_graph_checks(spark, sf_dir) -> DataFrame:
    cases = spark.createDataFrame([("edge", "a", "b"), ("no_edge", "a", "c"), ("unknown", "a", "d"), ("edge", "a", "z")], "expect string, src string, dst string")
    edges = spark.createDataFrame([("a", "b", True), ("a", "unknown::d", False)], "src_id string, dst_id string, resolved boolean")
    passed = evaluate.graph_cases(cases, edges)
    gate = evaluate.case_gate(passed, coverage=0.9)
    return passed.unionByName(gate.select(F.lit("gate").alias("expect"), F.col("cases").cast("string").alias("src"), F.col("passed").cast("string").alias("dst"), F.col("ok").alias("passed")))


def case_triage(spark, sf_dir) -> DataFrame:
    """Verdicts with a cache and a budget; what was never traced is asked too."""
    ship(spark)
    r = [(1, "unreachable", "p", 1), (2, "reachable", "untrusted request here", 2), (3, "unknown", "value is escaped", 3), (4, None, "remote", 4), (5, "unknown", "long " * 50, 5), (6, "reachable", "seen before", 6)]
    f = spark.createDataFrame(r, "finding_id bigint, reachable string, prompt string, ordinal int").withColumn("context_hash", F.sha2("prompt", 256))
    p = triage.KeywordProvider()
    cache = f.where("finding_id = 6").withColumn("cache_key", triage.cache_key("v1", p.model_name)).select("cache_key", F.lit("real").alias("verdict"), F.lit(0.7).alias("confidence"), F.lit("").alias("reasoning"))
    return triage.adjudicate(f, p, cache, limit=7).select("finding_id", "verdict", F.round("confidence", 6).alias("confidence"), "how")


def case_summaries(spark, sf_dir) -> DataFrame:
    ship(spark)
    nodes = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "node_id string, code string").withColumn("qualified_name", F.col("code")).withColumn("source_hash", F.col("code"))
    calls = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b")], "src_id string, dst_id string")
    return triage.summarise(nodes, calls, lambda c, t: f"{c}({','.join(t)})").select("node_id", F.col("level").cast("bigint").alias("level"), "summary")


def case_mentions(spark, sf_dir) -> DataFrame:
    texts = spark.createDataFrame([(1, "uses `known` and `mod.known()` but `ghost` and `pkg.sym`"), (2, None), (3, "`util` of `a.util`")], "id bigint, t string")
    nodes = spark.createDataFrame([("m.known", "a/util.py")], "qualified_name string, file_path string")
    refs = spark.createDataFrame([("pkg", "sym")], "package string, symbol string")
    return triage.unknown_mentions(texts, triage.known_names(nodes, refs), "id", "t")


def case_report(spark, sf_dir) -> DataFrame:
    """Ids that a report must describe."""
    n = spark.createDataFrame([("f::<file>", "file", "f", "f.py", 1, 9), ("f::a", "function", "a", "f.py", 1, 3), ("g::b", "function", "b", "g.py", 1, 3), ("g::z", "function", "z", "g.py", 5, 6)], "node_id string, kind string, qualified_name string, file_path string, start_line int, end_line int")
    e = spark.createDataFrame([("f::a", "g::b", "calls", True)], "src_id string, dst_id string, kind string, resolved boolean")
    f = spark.createDataFrame([("1", "g::b", "s", "r", None, "LOW", "reachable", ["f::a", "g::b"], 1)], "finding_id string, node_id string, source string, rule_id string, cwe string, raw_severity string, reachable string, path array<string>, blast_radius bigint")
    p = spark.createDataFrame([("f::a", "untrusted")], "node_id string, trust string")
    return report.build_report(f, n, e, p, spark.createDataFrame([(1,)], "n int"))["nodes"].select("node_id", "info.name", "info.file")


def case_file_fold(spark, sf_dir) -> DataFrame:
    n = spark.createDataFrame([("f::<file>", "file", "f.py"), ("f::a", "function", "f.py"), ("g::b", "function", "g.py"), ("g::c", "function", "g.py")], "node_id string, kind string, file_path string")
    e = spark.createDataFrame([("f::a", "g::b", "calls"), ("f::a", "g::b", "imports"), ("g::b", "g::c", "calls")], "src_id string, dst_id string, kind string")
    f = spark.createDataFrame([("1", "g::b", "unknown"), ("2", "g::c", "unreachable")], "finding_id string, node_id string, reachable string")
    shown, links = report.file_fold(n, e, f, spark.createDataFrame([("f::a",)], "node_id string"))
    return shown.select("file", "n_functions", "n_findings", "worst", "is_entry")


def case_inventory(spark, sf_dir) -> DataFrame:
    df = spark.createDataFrame([("a.py", "x\ny"), ("b.py", ""), ("c.py", "x\n"), ("d.py", None)], "rel_path string, content string")
    return _pick(source_files.inventory(df), "rel_path", "lines").join(df.select("rel_path", reports.skipped(F.concat(F.lit("src/.eggs/"), "rel_path")).alias("skipped")), "rel_path")


def case_code_of(spark, sf_dir) -> DataFrame:
    """Code shown for findings: their definition, or the lines around them in a file's own code."""
    text = "\n".join(f"l{i}" for i in range(1, 21))
    df = spark.createDataFrame([(1, "function", 3, 5, 4), (2, "file", 1, 20, 10), (3, "file", 1, 20, 2)], "id bigint, kind string, a int, b int, line int").withColumn("content", F.lit(text))
    return df.select("id", F.replace(locate.code_of(F.col("content"), F.col("kind"), F.col("a"), F.col("b"), F.col("line"), around=2), F.lit("\n"), F.lit(",")).alias("code"))


def case_severity_order(spark, sf_dir) -> DataFrame:
    """Findings in the order of urgency."""
    r = [("a", "unknown", None, None, 3, "CRITICAL", 1), ("b", "reachable", None, None, 1, "LOW", 2), ("c", "reachable", "real", 0.5, 1, "LOW", 3), ("d", "reachable", None, None, 1, "HIGH", 4), ("e", "unreachable", None, None, 9, "CRITICAL", 5), ("f", "reachable", None, None, 2, "LOW", 6)]
    df = spark.createDataFrame(r, "finding_id string, reachable string, verdict string, confidence double, blast_radius bigint, raw_severity string, ordinal int").withColumn("scope", F.lit(1))
    return _pick(reach.numbered(df, "scope"), "finding_id", "position")


_CASES = (
    (case_nodes, rows("node_id, kind, qualified_name, start_line, end_line",
        ("app/__init__.py::<file>", "file", "app", 1, 2), ("app/core.py::<file>", "file", "app.core", 1, 6), ("app/core.py::Base::L1", "class", "Base", 1, 3), ("app/core.py::Base.close::L2", "function", "Base.close", 2, 3), ("app/core.py::work::L4", "function", "work", 4, 5),
        ("app/views.py::<file>", "file", "app.views", 1, 21), ("app/views.py::Page::L4", "class", "Page", 4, 10), ("app/views.py::Page.get::L5", "function", "Page.get", 5, 8), ("app/views.py::Page.helper::L9", "function", "Page.helper", 9, 10),
        ("app/views.py::helper::L11", "function", "helper", 11, 15), ("app/views.py::index::L16", "function", "index", 16, 17), ("app/views.py::api::L19", "function", "api", 19, 20), ("urls.py::<file>", "file", "urls", 1, 5),
        ("other/index.py::<file>", "file", "other.index", 1, 4), ("other/index.py::index::L1", "function", "index", 1, 1), ("broken.py::<file>", "file", "broken", 1, 2))),
    (case_calls, rows("src_id, dst_id, class",
        ("app/core.py::work::L4", "app/core.py::Base::L1", "internal"), ("app/views.py::Page.get::L5", "app/core.py::work::L4", "internal"), ("app/views.py::Page.get::L5", "app/core.py::Base.close::L2", "internal"), ("app/views.py::Page.get::L5", "app/views.py::helper::L11", "internal"),
        ("app/views.py::Page.helper::L9", None, "external"), ("app/views.py::helper::L11", "unknown::f", "unknown"), ("app/views.py::helper::L11", "app/core.py::Base::L1", "internal"), ("app/views.py::helper::L11", "app/core.py::Base.close::L2", "internal"),
        ("app/views.py::index::L16", None, "external"), ("app/views.py::api::L19", "unknown::eval", "unknown"), ("app/views.py::<file>", "unknown::app.get", "unknown"),
        ("urls.py::<file>", "unknown::path", "unknown"), ("urls.py::<file>", "unknown::urlpatterns.append", "unknown"), ("urls.py::<file>", "unknown::path", "unknown"), ("urls.py::<file>", "unknown::P.as_view", "unknown"))),
    (case_coverage, rows("total, internal, external, unresolved, ratio", (15, 6, 2, 7, 0.533333))),
    (case_imports, rows("src_id, dst_id, resolved",
        ("app/__init__.py::<file>", "app/core.py::<file>", True), ("app/views.py::<file>", "app/__init__.py::<file>", True), ("app/views.py::<file>", "app/core.py::<file>", True), ("app/views.py::<file>", "package os", None), ("urls.py::<file>", "app/views.py::<file>", True),
        ("other/index.py::<file>", "package requests", None), ("other/index.py::<file>", "unknown::app.gone", False))),
    (case_inherits, rows("src_id, dst_id, resolved", ("app/views.py::Page::L4", "app/core.py::Base::L1", True))),
    (case_entry_points, rows("node_id, kind, trust", *((n, "http_route", "untrusted") for n in ("app/views.py::api::L19", "app/views.py::index::L16", "app/views.py::Page::L4", "app/views.py::Page.get::L5")))),
    (case_defines, rows("src_id, dst_id",
        ("app/core.py::<file>", "app/core.py::Base::L1"), ("app/core.py::Base::L1", "app/core.py::Base.close::L2"), ("app/core.py::<file>", "app/core.py::work::L4"), ("app/views.py::<file>", "app/views.py::Page::L4"), ("app/views.py::Page::L4", "app/views.py::Page.get::L5"),
        ("app/views.py::Page::L4", "app/views.py::Page.helper::L9"), ("app/views.py::<file>", "app/views.py::helper::L11"), ("app/views.py::<file>", "app/views.py::index::L16"), ("app/views.py::<file>", "app/views.py::api::L19"), ("other/index.py::<file>", "other/index.py::index::L1"))),
    (case_bandit, rows("source, rule_id, rel_path, line, end_line, raw_severity, severity, confidence, cwe, message", ("bandit", "B602", "a.py", 3, 5, "HIGH", "high", "low", "CWE-78", "shell"), ("bandit", "B303", "b.py", 7, 7, "MEDIUM", "medium", None, None, "md5"))),
    (case_semgrep, rows("source, rule_id, rel_path, line, end_line, severity, confidence, cwe", ("semgrep", "sql", "a.py", 1, 2, "high", "high", "CWE-89"), ("semgrep", "path", "b.py", 4, 4, "low", None, "CWE-22"))),
    (case_gitleaks, rows("source, rule_id, rel_path, line, end_line, raw_severity, severity, cwe, message", ("gitleaks", "k", "a.env", 2, 3, "HIGH", "high", "CWE-798", "d"), ("gitleaks", "f", "venv", 1, 1, "HIGH", "high", "CWE-798", None))),
    (case_osv, rows("rule_id, rel_path, package, package_version, raw_severity, severity, fixed_in, cwe, aliases", ("CVE-1", "req.txt", "pkg-a", "1.9", "9.8", "critical", "1.10", "CWE-79", "CVE-1,GHSA-1,GHSA-2"), ("GHSA-3", "req.txt", "pkg-a", "1.9", "n/a", "low", None, "CWE-79", "GHSA-3"))),
    (case_scan_status, rows("source, path, status, errors", ("bandit", "a", "ok", "f: r"), ("bandit", "b", "failed", ""), ("bandit", "c", "ok", ""))),
    (case_names, rows("id, canonical, import_name, module, rel, absolute, last, first",
        (1, "foo-bar", "foo_.bar", "src.a", "x/a.py", "a.b.c", "b", "a"), (2, "b-c", "b__c", "a.b", "q.py", "a.c", "b", "a"), (3, "x", "x", "", None, None, "a", "a"), (4, "y", "y", "m", None, "a.b", "b", "a"))),
    (case_texts, rows("id, location, percent, text, names, remote, clamped", (1, "a.py:3", "12.3%", "two words", "a.b,c", True, 1.0), (2, "b.py", "-", "", "", False, 0.0), (3, "c.py", "100.0%", "x", "ok_2", True, 0.5))),
    (case_versions, rows("v, place", *((v, i) for i, v in enumerate(_VERSIONS)), ("v1.0.0", 5), ("unknown", None))),
    (case_mro, rows("cls, position, base",
        ("A", 0, "A"), ("B", 0, "B"), ("B", 1, "A"), ("C", 0, "C"), ("C", 1, "A"), ("D", 0, "D"), ("D", 1, "B"), ("D", 2, "C"), ("D", 3, "A"), ("X", 0, "X"), ("P", 0, "P"), ("P", 1, "Q"), ("Q", 0, "Q"), ("Q", 1, "P"))),
    (case_levels, rows("node, component, level", ("a", "a", 2), ("b", "b", 1), ("c", "b", 1), ("d", "d", 0), ("e", "e", 0), ("f", "f", 0))),
    (case_renames, rows("old_id, new_id", ("o1", "n1"), ("o2", "n2"), ("o3", "n3"))),
    (case_splice, rows("src_id, src_file, dst_id, kind, resolved", ("a1", "a", "b2", "calls", True), ("c1", "c", "b2", "calls", True), ("b2", "b", "a1", "calls", True))),
    (case_anchors, rows("finding_id, anchors, via", ("direct", "n1,n2", ""), ("through", "n1,n2", "foo-bar"), ("own", "n3", ""), ("none", "", ""))),
    (case_installed, rows("package, version", ("foo", "1"), ("basemod", "2"), ("solo", "2"), ("own_name", "3"))),
    (case_deprecated, rows("node_id, symbol, kind, category, message, conditional", ("n1", "x", "decorator", "DeprecationWarning", "use y", False), ("n2", "y", "warning", "DeprecationWarning", "old", True), (None, "4/2/1", None, None, None, None))),
    (case_upgrades, rows("package, version, declared, n_advisories, worst_severity, upgrade_to, unfixed, worst, references, files, users, via, n_deprecated, symbols, pin_is_stale, urgency",
        ("flask", "3.1.3", "2.2.2", 2, "high", "2.3.2", 0, "reachable", 3, 2, 2, "", 0, "", True, "urgent"), ("werkzeug", "2.2.2", "2.2.2", 2, "critical", "2.2.3", 1, "reachable", 0, 2, 0, "flask", 0, "", False, "urgent"),
        ("django", "3.2", "3.2", 1, "high", "3.2.5", 0, "unknown", 0, 0, 0, "", 0, "", False, "check"), ("idle", "1", "1", 1, "high", None, 1, "unreachable", 0, 0, 0, "", 0, "", False, "routine"),
        ("old", None, None, 0, None, None, 0, None, 0, 0, 0, "", 3, "old.f,old.g", False, "migrate"), ("tidy", None, None, 0, None, None, 0, None, 1, 1, 1, "", 0, "", False, "ok"))),
    (case_upgrade_summary, rows("packages, urgent, check, routine, migrate, deprecated_reachable, deprecated_unknown, deprecated_unreachable", (6, 2, 1, 1, 1, 1, 1, 1))),
    (case_trace_recall, rows("observed, recovered, unknown, silent, recall", (3, 1, 1, 1, 0.333333))),
    (case_graph_checks, rows("expect, src, dst, passed", ("edge", "a", "b", True), ("no_edge", "a", "c", True), ("unknown", "a", "d", True), ("edge", "a", "z", False), ("gate", "4", "3", False))),
    (case_triage, rows("finding_id, verdict, confidence, how", (1, "unreachable", 1.0, "skipped"), (2, "real", 0.9, "called"), (3, "false_positive", 0.8, "called"), (4, "real", 0.9, "called"), (5, "needs_review", 0.5, "budget"), (6, "real", 0.7, "cached"))),
    (case_summaries, rows("node_id, level, summary", ("b", 0, "B()"), ("c", 0, "C()"), ("a", 1, "A(B())"))),
    (case_mentions, rows("id, name", (1, "ghost"))),
    (case_report, rows("node_id, name, file", ("f::a", "a", "f.py"), ("g::b", "b", "g.py"))),
    (case_file_fold, rows("file, n_functions, n_findings, worst, is_entry", ("f.py", 1, 0, None, True), ("g.py", 2, 2, "unknown", False))),
    (case_inventory, rows("rel_path, lines, skipped", ("a.py", 2, True), ("b.py", 0, True), ("c.py", 2, True), ("d.py", 0, True))),
    (case_code_of, rows("id, code", (1, "l3,l4,l5"), (2, "l8,l9,l10,l11,l12"), (3, "l1,l2,l3,l4"))),
    (case_severity_order, rows("finding_id, position", ("c", 1), ("f", 2), ("d", 3), ("b", 4), ("a", 5), ("e", 6))),
)

QUERIES = {f.__name__: f for f, _ in _CASES}
SQL = {f.__name__: sql for f, sql in _CASES}
