import random

from tracelake.operators import graph as G
from tracelake.operators import reach

E = "src_id string, dst_id string, kind string, resolved boolean"


def trace(spark, edges, entries, targets):
    e = spark.createDataFrame([(a, b, "calls", r) for a, b, r in edges], E)
    p = spark.createDataFrame(entries, "node_id string, trust string")
    t = spark.createDataFrame(targets, "finding_id string, node_id string")
    return {r.finding_id: (r.reachable, r.path, r.blast_radius) for r in reach.trace(t, e, p).collect()}


def test_no_entry_points_is_unknown(spark):
    assert trace(spark, [("h", "q", True)], [], [("f", "q")]) == {"f": ("unknown", [], 0)}


def test_only_internal_entry_points_is_unreachable(spark):
    assert trace(spark, [("h", "q", True)], [("h", "internal")], [("f", "q"), ("g", "nowhere"), ("e", None)]) == {"f": ("unreachable", [], 0), "g": ("unknown", [], 0), "e": ("unknown", [], 0)}


def test_several_targets_take_the_best(spark):
    got = trace(spark, [("ep", "a", True), ("a", "b", False), ("x", "y", True)], [("ep", "untrusted")], [("f", "b"), ("f", "a"), ("g", "b"), ("h", "y"), ("k", "ep"), ("k", "b")])
    assert got == {"f": ("reachable", ["ep", "a"], 1), "g": ("unknown", ["ep", "a", "b"], 1), "h": ("unreachable", [], 0), "k": ("reachable", ["ep"], 1)}


def test_random_cyclic_graphs_against_brute_force(spark):
    rng = random.Random(5)
    for _ in range(2):
        edges = [(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}", rng.random() < 0.6) for _ in range(26)]
        entries = [("n0", "untrusted"), ("n1", "untrusted"), ("n2", "internal")]
        nodes = {x for a, b, _ in edges for x in (a, b)}
        got = trace(spark, edges, entries, [(n, n) for n in sorted(nodes)])

        def bfs(ok):
            best = {s: (s,) for s in ("n0", "n1")}
            level = dict(best)
            while level:
                new = {}
                for n, p in level.items():
                    for a, b, r in edges:
                        if a == n and ok(a, b, r) and b not in best:
                            new[b] = min(new.get(b, (*p, b)), (*p, b))
                best |= new
                level = new
            return best

        solid = {(a, b) for a, b, r in edges if r}
        good, far = bfs(lambda a, b, r: (a, b) in solid), bfs(lambda a, b, r: True)
        for n in nodes:
            if n in ("n0", "n1"):
                want = ("reachable", [n], 1)
            else:
                path = good.get(n) or far.get(n)
                blast = 0
                for s in ("n0", "n1"):
                    seen, todo = {s}, [s]
                    while todo:
                        x = todo.pop()
                        for a, b, _ in edges:
                            if a == x and b not in seen:
                                seen.add(b)
                                todo.append(b)
                    blast += s in (nodes) and n in seen
                want = ("reachable" if n in good else "unknown" if n in far else "unreachable", list(path or ()), blast)
            assert got[n] == want, n


def test_components_and_levels(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "c"), ("x", "a"), ("x", "x")], "src_id string, dst_id string")
    assert {r.node: r.component for r in G.components(edges).collect()} == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "c", "x": "x"}
    defs = spark.createDataFrame([(n,) for n in "abcdexz"], "node_id string")
    got = {r.node: r.level for r in G.callee_first(edges, defs).collect()}
    assert got == {"c": 0, "d": 0, "e": 0, "a": 1, "b": 1, "x": 2, "z": 0}


def test_linearisation():
    parents = {"D": ["B", "C"], "B": ["A"], "C": ["A"]}
    assert G.linearise("D", parents) == ["D", "B", "C", "A"]
    assert G.linearise("X", {"X": ["Y"], "Y": ["X"]})[0] == "X"


def test_method_orders(spark):
    df = spark.createDataFrame([("D", "B", 1), ("D", "C", 2), ("B", "A", 3), ("C", "A", 4)], "cls string, base string, ordinal int")
    got = {}
    for r in sorted(G.method_orders(df).collect(), key=lambda r: r.position):
        got.setdefault(r.cls, []).append(r.base)
    assert got == {"D": ["D", "B", "C", "A"], "B": ["B", "A"], "C": ["C", "A"], "A": ["A"]}


def test_empty_graph(spark):
    edges = spark.createDataFrame([], E)
    assert G.components(edges).collect() == []
    assert trace(spark, [], [("a", "untrusted")], [("f", "a")]) == {"f": ("unknown", [], 0)}


def test_dependency_in_use(spark):
    edges = spark.createDataFrame([("ep", "m.f", "calls", True), ("m.f", "unknown::pkg.x", "calls", False), ("file", "m.f", "defines", True)], E)
    entries = spark.createDataFrame([("ep", "untrusted")], "node_id string, trust string")
    nodes = spark.createDataFrame([("file", "file", "m.py"), ("m.f", "function", "m.py"), ("ep", "function", "web.py")], "node_id string, kind string, file_path string")
    anchors = spark.createDataFrame([("p", "m.py"), ("q", "web.py")], "finding_id string, file_path string")
    first = reach.trace(spark.createDataFrame([("p", "file"), ("q", "file")], "finding_id string, node_id string"), edges, entries)
    got = {r.finding_id: (r.reachable, r.path, r.blast_radius) for r in reach.import_in_use(first, anchors, edges, nodes, entries).collect()}
    assert got == {"p": ("unknown", ["ep", "m.f"], 1), "q": ("unreachable", [], 0)}
