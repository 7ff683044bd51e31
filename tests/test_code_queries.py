"""The graph queries over all rows of a small code graph, worked out by hand."""

import datetime

import pytest

from tracelake.plans import registry

NODES = "repo string, node_id string, kind string, qualified_name string, file_path string, start_line int, end_line int, source_hash string, ordinal int"
EDGES = "repo string, src_id string, dst_id string, kind string, resolved boolean, ordinal bigint"
FINDINGS = "finding_id bigint, repo string, source string, rule_id string, rel_path string, line int, raw_severity string, severity string, cwe string, message string, package string, package_version string, fixed_in string, aliases array<string>, scan_ordinal bigint, reported_at timestamp"
FILES = "file_id bigint, repo string, rel_path string, content string, loaded_at timestamp"
APP = "import wares\n@app.route('/')\ndef home():\n    return work()\ndef work():\n    return sink()\ndef sink():\n    return 1\ndef idle():\n    return 2\n"
HOME, WORK, SINK, IDLE = (f"a.py::{n}::L{i}" for n, i in (("home", 3), ("work", 5), ("sink", 7), ("idle", 9)))


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Two repositories with the same names; only ``one`` has a route, and its calls are marked in several spellings."""
    at = tmp_path_factory.mktemp("code")
    spans = [("a.py::<file>", "file", "a", 1, 10), (HOME, "function", "home", 3, 4), (WORK, "function", "work", 5, 6), (SINK, "function", "sink", 7, 8), (IDLE, "function", "idle", 9, 10)]
    nodes = [(r, i, k, q, "a.py", a, b, "h", o) for r in ("one", "two") for o, (i, k, q, a, b) in enumerate(spans)]
    edges = [("one", HOME, WORK, "calls", True, 1), ("one", WORK, SINK, " CALLS", True, 2), ("one", HOME, "unknown::get", "calls", True, 3), ("two", HOME, WORK, "calls", True, 4), ("two", WORK, "unknown::get", "calls", False, 5), ("two", "unknown::get", SINK, "calls", True, 6)]
    finding = [(1, "one", 8, None), (2, "one", 10, None), (3, "two", 8, None), (4, "one", 4, None), (5, "one", None, "wares"), (6, "two", None, "absent")]
    findings = [(i, r, "bandit", "R", "a.py", n, "HIGH", "high", None, "m", p, None, None, None, i, None) for i, r, n, p in finding]
    day = datetime.datetime(2026, 1, 1)
    files = [(1, "one", "a.py", APP, day), (2, "two", "a.py", APP.replace("@app.route('/')\n", "\n").replace("import wares", ""), day)]
    for name, rows, schema in (("nodes", nodes, NODES), ("edges", edges, EDGES), ("raw_findings", findings, FINDINGS), ("source_files", files, FILES)):
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
    return str(at)


def run(spark, small, name):
    return registry.queries()[name](spark, small).collect()


def test_reachability_of_every_finding(spark, small):
    got = {r.finding_id: (r.reachable, r.path.replace("one/a.py::", ""), r.blast_radius) for r in run(spark, small, "code_reachability")}
    assert got == {
        "1": ("reachable", "home::L3 > work::L5 > sink::L7", 1),
        "2": ("unknown", "", 0),  # nothing in the graph names it
        "3": ("unreachable", "", 0),  # the route of the other repository does not count
        "4": ("reachable", "home::L3", 1),
        "5": ("unknown", "", 0),
        "6": ("unknown", "", 0),
    }


def test_graph_of_every_edge(spark, small):
    assert {(r.node_id, r.degree) for r in run(spark, small, "node_degree")} == {
        (f"one/{HOME}", 2), (f"one/{WORK}", 2), (f"one/{SINK}", 1), ("unknown::one/get", 1), (f"two/{HOME}", 1), (f"two/{WORK}", 2), ("unknown::two/get", 2), (f"two/{SINK}", 1)
    }
    assert {r.node: r.depth for r in run(spark, small, "code_resolved_depth")} == {f"one/{HOME}": 0, f"one/{WORK}": 1, f"one/{SINK}": 2}
    assert len(run(spark, small, "code_reach_pairs")) == 4
    assert len(run(spark, small, "strong_components")) == 8
    assert run(spark, small, "code_attack_surface")[0].asDict() == {"functions": 8, "exposed": 3, "ratio": 0.375}


def test_whole_tables(spark, sf_dir):
    """Every finding has a row, every call counts at both ends."""
    findings = spark.read.parquet(f"{sf_dir}/raw_findings.parquet").select("finding_id").distinct().count()
    assert registry.queries()["code_reachability"](spark, sf_dir).count() == findings
    e = spark.read.parquet(f"{sf_dir}/edges.parquet").where("lower(trim(kind)) = 'calls' and src_id is not null and dst_id is not null and repo is not null")
    assert registry.queries()["node_degree"](spark, sf_dir).agg({"degree": "sum"}).first()[0] == 2 * e.count()
