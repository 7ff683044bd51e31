import pytest
from pyspark.sql import functions as F

from tracelake import cli
from tracelake.functions import scalar as S
from tracelake.operators import deps, evaluate, incremental, locate, report
from tracelake.operators import graph as G
from tracelake.sources import reports
from tracelake.streaming import changes, index

BASE = {"a.py": "import b\ndef f():\n    b.g()\n", "b.py": "def g():\n    return h()\ndef h(): pass\n", "c.py": "class K:\n    pass\n"}


def frame(spark, rows):
    return spark.createDataFrame([*rows.items()], "rel_path string, content string")


def rows(t):
    return {k: sorted(map(str, map(tuple, d.collect()))) for k, d in t.items()}


def test_incremental_index_equals_full(spark):
    step = {"b.py": "def h(): pass\n\ndef g():\n    return h()\n", "c.py": None, "d.py": "from b import g\ng()\n"}
    after = {k: v for k, v in (BASE | step).items() if v is not None}
    got = index.Index.build(frame(spark, BASE)).apply(frame(spark, step))
    assert rows(got.tables()) == rows(index.Index.build(frame(spark, after)).tables())


def test_index_follows_a_stream(spark, tmp_path):
    folder = tmp_path / "in"
    first = spark.createDataFrame([("d.py", "def x(): pass\n", 1), ("d.py", "def y(): pass\n", 2), ("c.py", None, 2)], "rel_path string, content string, changed_at int")
    first.coalesce(1).write.parquet(str(folder))
    stream = spark.readStream.schema(first.schema).parquet(str(folder))
    stored = index.StoredIndex(spark, str(tmp_path / "index"))
    stored.write(-1, frame(spark, BASE))
    got = index.follow(stored, stream, str(tmp_path / "state"))
    want = {"a.py": BASE["a.py"], "b.py": BASE["b.py"], "d.py": "def y(): pass\n"}
    assert rows(got.tables()) == rows(index.Index.build(frame(spark, want)).tables())
    # After a restart the state comes from the folder, and the stream goes on behind what it has seen.
    spark.createDataFrame([("e.py", "import d\n", 3), ("d.py", None, 3)], "rel_path string, content string, changed_at int").coalesce(1).write.mode("append").parquet(str(folder))
    again = index.StoredIndex(spark, str(tmp_path / "index"))
    numbers = []
    stream = spark.readStream.schema(first.schema).parquet(str(folder))
    got = index.follow(again, stream, str(tmp_path / "state"), lambda n, s: numbers.append(n))
    want = {"a.py": BASE["a.py"], "b.py": BASE["b.py"], "e.py": "import d\n"}
    full = rows(index.Index.build(frame(spark, want)).tables())
    assert numbers == [1] and rows(got.tables()) == full
    again.write(1, spark.createDataFrame([("e.py", "import d\n"), ("d.py", None)], "rel_path string, content string"))  # a batch that runs twice
    assert rows(again.load().tables()) == full
    small = again.compact(str(tmp_path / "small"))
    assert rows(small.load().tables()) == full
    empty = index.StoredIndex(spark, str(tmp_path / "none"))
    assert empty.load().files.collect() == []


def test_tables_have_edges_of_all_kinds(spark):
    t = index.Index.build(frame(spark, BASE | {"c.py": "from b import h\nclass K: pass\nclass L(K): pass\n"})).tables()
    assert {r.kind for r in t["edges"].select("kind").distinct().collect()} == {"defines", "imports", "calls", "inherits"}


def test_findings_after_a_change(spark):
    F_ = "finding_id string, rel_path string, node_id string, reachable string, path array<string>, blast_radius bigint"
    old = [("1", "a.py", "ep", "reachable", ["ep"], 1), ("2", "b.py", "b1", "reachable", ["ep", "b1"], 1), ("3", "c.py", "c", "unreachable", [], 0), ("4", "d.py", "gone", "unreachable", [], 0), ("5", "e.py", "e", "reachable", ["ep", "b1", "e"], 1), ("6", "x.py", "x", None, None, None)]
    nodes = spark.createDataFrame([(n,) for n in ("ep", "b2", "c", "e", "x", "y")], "node_id string")
    renamed = spark.createDataFrame([("b1", "b2")], "old_id string, new_id string")
    rescanned = spark.createDataFrame([("a.py",)], "rel_path string")
    fresh = spark.createDataFrame([("9", "a.py", "y")], "finding_id string, rel_path string, node_id string")
    affected = spark.createDataFrame([("c",)], "node_id string")
    asked = []

    def recompute(targets):
        asked.extend(r.finding_id for r in targets.collect())
        return targets.select("finding_id", F.lit("unknown").alias("reachable"), F.array("node_id").alias("path"), F.lit(7).cast("bigint").alias("blast_radius"))

    got, counts = incremental.update_findings(spark.createDataFrame(old, F_), nodes, renamed, rescanned, fresh, affected, recompute)
    assert {r.finding_id: (r.node_id, r.reachable, tuple(r.path)) for r in got.collect()} == {
        "2": ("b2", "reachable", ("ep", "b2")), "3": ("c", "unknown", ("c",)), "5": ("e", "reachable", ("ep", "b2", "e")), "6": ("x", "unknown", ("x",)), "9": ("y", "unknown", ("y",)),
    }
    assert sorted(asked) == ["3", "6", "9"] and counts.first().asDict() == {"reused": 2, "invalidated": 2, "new": 1, "dropped": 2}


def test_windowed_stream(spark, tmp_path):
    ev = spark.sql("SELECT timestamp_ntz'2024-01-01 00:10:00' AS ts, 'a' AS event_type UNION ALL SELECT timestamp_ntz'2024-01-01 00:50:00', 'a' UNION ALL SELECT timestamp_ntz'2024-01-03 00:00:00', 'b'")
    ev.write.parquet(str(tmp_path / "e"))
    s = changes.windowed_counts(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "e")))
    q = s.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.event_type, r.n) for r in spark.table("w").collect()} == {("a", 2), ("b", 1)}
    assert changes.windowed_counts(ev).count() == 2


def test_apply_changes(spark):
    state = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    ch = spark.createDataFrame([("a", 2, "changed", 1), ("a", 3, "changed", 2), ("b", None, "removed", 1), ("c", 9, "added", 1)], "k string, v int, change_kind string, o int")
    assert {(r.k, r.v) for r in changes.apply_changes(state, ch, ["k"], "o").collect()} == {("a", 3), ("c", 9)}


def graph(spark):
    n = spark.createDataFrame([("f::<file>", "file", "f", "f.py", 1, 9), ("f::a", "function", "a", "f.py", 1, 3), ("g::b", "function", "b", "g.py", 1, 3)], "node_id string, kind string, qualified_name string, file_path string, start_line int, end_line int")
    e = spark.createDataFrame([("f::a", "g::b", "calls", True), ("f::a", "g::b", "imports", True), ("g::b", "unknown::x", "calls", False)], "src_id string, dst_id string, kind string, resolved boolean")
    f = spark.createDataFrame([("1", "g::b", "s", "r", "CWE-1", "LOW", "reachable", ["f::a", "g::b"], 1), ("2", "g::b", "s", "r", None, "LOW", "unreachable", [], 0)], "finding_id string, node_id string, source string, rule_id string, cwe string, raw_severity string, reachable string, path array<string>, blast_radius bigint")
    p = spark.createDataFrame([("f::a", "untrusted")], "node_id string, trust string")
    return n, e, f, p


def test_report_describes_all_it_mentions(spark):
    n, e, f, p = graph(spark)
    parts = report.build_report(f, n, e, p, spark.createDataFrame([(2,)], "n int"))
    assert {r.node_id for r in parts["nodes"].collect()} == {"f::a", "g::b"}
    assert '"callers":["f::a"]' in parts["findings"].where("finding_id = '1'").first()["entry"]
    shown, links = report.graph_view(n, e, f, p)
    got = {r.node_id: (r.kind, r.is_entry, r.worst, r.findings) for r in shown.collect()}
    assert got["unknown::x"] == ("unknown", False, None, None) and got["g::b"] == ("function", False, "reachable", ["1", "2"]) and got["f::a"][1]
    assert links.count() == 3
    files, between = report.file_fold(n, e, f, p)
    assert {r.file: (r.n_functions, r.n_findings, r.is_entry, r.worst) for r in files.collect()} == {"f.py": (1, 0, True, None), "g.py": (1, 2, False, "reachable")}
    assert [(r.src, r.dst, r.n, r.kind) for r in between.collect()] == [("f.py", "g.py", 2, "calls")]


def test_constructors_lead_to_init(spark):
    nodes = spark.createDataFrame([("B", "class", "B", "m"), ("B.i", "function", "B.__init__", "m"), ("D", "class", "D", "m")], "node_id string, kind string, qualified_name string, file_path string")
    orders = spark.createDataFrame([("D", 0, "D"), ("D", 1, "B"), ("B", 0, "B")], "cls string, position int, base string")
    calls = spark.createDataFrame([("x", "D"), ("x", "f")], "src_id string, dst_id string")
    assert {(r.src_id, r.dst_id) for r in G.constructor_targets(calls, orders, nodes).collect()} == {("x", "B.i"), ("x", "f")}


def test_deprecated_uses(spark):
    src = spark.createDataFrame([("lib.py", 2, "@deprecated('no')\ndef old(): pass\n"), ("lib.py", 9, None)], "def_path string, def_line int, content string")
    uses = spark.createDataFrame([("n", 3, "lib", "old", "lib.py", 2), ("n", 4, "lib", "new", "lib.py", 5), ("n", 5, "c", "x", None, None)], "node_id string, line int, package string, symbol string, def_path string, def_line int")
    found, stats = deps.deprecated_uses(uses, deps.read_markers(src))
    assert [(r.symbol, r.marker.kind) for r in found.collect()] == [("old", "decorator")]
    assert tuple(stats.first()) == (3, 1, 1)
    versions = spark.createDataFrame([("lib", "1")], "package string, version string")
    assert {(r.package, r.version) for r in deps.with_versions(uses, versions).collect()} == {("lib", "1"), ("c", None)}


def test_snippets(spark):
    df = spark.createDataFrame([("\n".join(f"l{i}" for i in range(1, 21)),)], "c string")
    x = df.select(
        locate.snippet(F.col("c"), F.lit(2), F.lit(9), 3, more=True).alias("a"), locate.code_of(F.col("c"), F.lit("file"), F.lit(1), F.lit(20), F.lit(3), 1).alias("b"),
        locate.line_text(F.col("c"), F.lit(99)).alias("d"), S.location(F.lit("p"), F.lit(0)).alias("e"), S.percent(F.lit(0.1234)).alias("f"),
    ).first()
    assert tuple(x) == ("l2\nl3\nl4\n# ... 5 more lines", "l2\nl3\nl4", "", "p", "12.3%")


def test_gates_and_registry(spark):
    ok = evaluate.case_gate(spark.createDataFrame([(True,), (True,)], "passed boolean"), 0.9).first()
    assert ok["ok"] and not evaluate.case_gate(spark.createDataFrame([(True,), (False,)], "passed boolean"), 0.9).first()["ok"]
    with pytest.raises(ValueError, match="local"):
        reports.check_rule_source("https://x")
    with pytest.raises(ValueError, match="parser"):
        reports.ingest({"other": spark.createDataFrame([("{}",)], "body string")}, "/")
    both = reports.ingest({"bandit": spark.createDataFrame([('{"results": []}',)], "body string"), "gitleaks": spark.createDataFrame([('[{"File": "a", "RuleID": "k", "StartLine": 1}]',)], "body string")}, "/")
    assert both.count() == 1


def test_command_line(capsys):
    assert cli.main(["list"]) == 0 and "finding_reachability" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["nothing", "x"])
