import random

import pytest

from tracelake.operators import hierarchy as H


def brute(links):
    down, up, nodes = {}, {}, set()
    for s, p, c in links:
        if None in (s, p, c):
            continue
        down.setdefault((s, p), set()).add((s, c))
        up.setdefault((s, c), set()).add((s, p))
        nodes |= {(s, p), (s, c)}

    def reach(v):
        seen, todo = set(), list(down.get(v, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += down.get(x, ())
        return seen

    r = {v: reach(v) for v in nodes}
    bad = {v for v in nodes if v in r[v]}
    bad |= {w for v in bad for w in r[v]}
    several = {v for v in nodes if len(up.get(v, ())) > 1}
    bad |= several | {w for v in several for w in r[v]}
    out = set()
    for v in nodes:
        n = len(r[v] - {v})
        if v in bad:
            out.add((*v, "", -1, n))
            continue
        x, d = v, 0
        while up.get(x):
            x, d = next(iter(up[x])), d + 1
        out.add((*v, x[1], d, n))
    return out


def run(spark, links):
    df = spark.createDataFrame([(*x, "clash") for x in links], "repo string, src_id string, dst_id string, scope string")
    rows = H.hierarchy(df, paths=True).collect()
    assert {(r.scope, r.node, r.root, r.depth, r.n_descendants) for r in H.hierarchy(df).collect()} == {(r.scope, r.node, r.root, r.depth, r.n_descendants) for r in rows}
    got = [(r.scope, r.node, r.root, r.depth, r.n_descendants) for r in rows]
    assert len(got) == len(set(got))
    for r in rows:
        if r.depth >= 0:
            assert len(r.path) == r.depth and (r.path or [r.node])[0] == r.root
    return set(got)


CASES = {
    "tree": [("r", "a", "b"), ("r", "b", "c"), ("r", "a", "d"), ("r", "b", "c"), ("q", "a", "b")],
    "self": [("r", "a", "a"), ("r", "a", "b"), ("r", "x", "y")],
    "two": [("r", "a", "b"), ("r", "b", "a"), ("r", "b", "c")],
    "back edge": [("r", "p", "a"), ("r", "a", "b"), ("r", "b", "c"), ("r", "c", "a"), ("r", "c", "d"), ("r", "p", "e")],
    "nested loops": [("r", "p", "a"), ("r", "a", "b"), ("r", "b", "a"), ("r", "b", "c"), ("r", "c", "d"), ("r", "d", "c")],
    "loops in a row": [("r", "a", "b"), ("r", "b", "a"), ("r", "a", "c"), ("r", "c", "d"), ("r", "d", "c"), ("r", "d", "e")],
    "nulls": [("r", None, "b"), ("r", "a", None), (None, "a", "b"), ("r", "x", "y")],
    "two diamonds": [("r", "a", "b"), ("r", "a", "c"), ("r", "b", "d"), ("r", "c", "d"), ("r", "d", "e"), ("r", "e", "f"), ("r", "e", "g"), ("r", "f", "h"), ("r", "g", "h"), ("r", "h", "d")],
    "diamond": [("r", "a", "b"), ("r", "a", "c"), ("r", "b", "d"), ("r", "c", "d"), ("r", "d", "e")],
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    assert run(spark, CASES[name]) == brute(CASES[name])


def test_empty(spark):
    assert run(spark, []) == set()


def test_long_chains_and_loops_across_partitions(spark, monkeypatch):
    monkeypatch.setattr(H, "LOCAL_ROWS", 20)
    order = [f"n{i:03d}" for i in range(120)]
    random.Random(3).shuffle(order)
    links = [("r", a, b) for a, b in zip(order, order[1:])]
    ring = [f"m{i:03d}" for i in range(60)]
    random.Random(4).shuffle(ring)
    links += [("r", a, b) for a, b in zip(ring, [*ring[1:], ring[0]])] + [("r", ring[5], "tail"), ("r", "tail", "end")]
    assert run(spark, links) == brute(links)


def test_random_forests_with_back_edges(spark, monkeypatch):
    monkeypatch.setattr(H, "LOCAL_ROWS", 10)
    rng = random.Random(11)
    links = []
    for repo in ("p", "q"):
        up = {}
        for i in range(1, 70):
            if rng.random() < 0.9:
                up[i] = rng.randrange(i)
                links.append((repo, f"x{up[i] * 37 % 71:02d}", f"x{i * 37 % 71:02d}"))
        for _ in range(5):  # back edges close loops
            v = rng.randrange(20, 70)
            x = v
            for _ in range(rng.randrange(1, 6)):
                x = up.get(x, x)
            links.append((repo, f"x{v * 37 % 71:02d}", f"x{x * 37 % 71:02d}"))
    assert run(spark, links) == brute(links)


def test_descendants_match_counts(spark):
    nodes = H.hierarchy(spark.createDataFrame(CASES["tree"], "repo string, src_id string, dst_id string"), paths=True)
    pairs = {(r.scope, r.node, r.descendant, r.distance) for r in H.descendants(nodes).collect()}
    assert pairs == {("r", "a", "b", 1), ("r", "a", "c", 2), ("r", "b", "c", 1), ("r", "a", "d", 1), ("q", "a", "b", 1)}


def test_a_chain_and_a_star_of_many_nodes(spark):
    """Linear in the links: a chain as deep as it is long, and a root with every node under it."""
    n = 200_000
    chain = spark.range(n).selectExpr("'chain' as repo", "lpad(cast((id * 7919) % 200003 as string), 9, '0') as src_id", "lpad(cast(((id + 1) * 7919) % 200003 as string), 9, '0') as dst_id")
    star = spark.range(n).selectExpr("'star' as repo", "'root' as src_id", "cast(id as string) as dst_id")
    got = H.hierarchy(chain.unionByName(star)).groupBy("scope").agg({"depth": "max", "n_descendants": "max", "*": "count"}).collect()
    assert {r["scope"]: (r["max(depth)"], r["max(n_descendants)"], r["count(1)"]) for r in got} == {"chain": (n, n, n + 1), "star": (1, n, n + 1)}
