"""Parent-child links to full hierarchies, loops included.

Links are turned into a forest first: every node with one parent keeps its link, the links into nodes with several
parents and one link of each loop are set aside as *cuts*. Weighted disjoint sets over range partitions give each node its
top within its partition and the distance to it. Tops alone are merged between partitions: pointers (root, offset) double
round by round, and the sums of what hangs below each top double with them. A second pass over the partitions adds what
came back. Nothing is joined on a root, and no path is built unless paths are asked for.

Cuts always lead to roots of the forest, so they form a small graph over trees. Its components tell which nodes lie on
loops and how much is behind them; both are added up through the same sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.core import cores, cut, ship
from tracelake.operators.graph import components, walked

#: Rows of one partition-local disjoint set.
LOCAL_ROWS = 200_000
_LOCAL = "part int, scope string, child string, parent string, top string, off bigint, cut boolean"
#: Rows of the second pass: links (kind 0), what partitions learn of their tops (1), amounts at single nodes (2).
_SECOND = "part int, kind int, scope string, node string, parent string, root string, off bigint, total bigint, extra bigint, loops bigint, reach bigint, tainted boolean, path array<string>"
_FOUND = "scope string, node string, root string, depth int, n_descendants int"
LINK, TOP, AMOUNT = 0, 1, 2


class WeightedForest:
    """Disjoint sets with an offset to the set's root; joining a set to itself reports a loop."""

    def __init__(self) -> None:
        self.up: dict = {}
        self.offset: dict = {}

    def find(self, x) -> tuple[object, int]:
        trail = []
        while x in self.up:
            trail.append(x)
            x = self.up[x]
        total = 0
        for y in reversed(trail):
            total += self.offset[y]
            self.up[y], self.offset[y] = x, total
        return x, total

    def link(self, child, parent, steps: int = 1) -> bool:
        """Hangs the root ``child`` under ``parent``, ``steps`` below it; false if that would close a loop."""
        if self.find(parent)[0] == child:
            return False
        self.up[child], self.offset[child] = parent, steps
        return True


def _local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Tops and offsets of a partition's links; a link that closes a loop in it is marked as cut."""
    here = TaskContext.get().partitionId()
    found: dict[tuple, dict[str, str]] = {}
    for b in batches:
        part = b["part"] if "part" in b else [here] * len(b)
        for p, scope, child, parent in zip(part, b["scope"], b["child"], b["parent"], strict=True):
            found.setdefault((p, scope), {})[child] = parent
    columns, out = ["part", "scope", "child", "parent", "top", "off", "cut"], []
    for (p, scope), links in found.items():
        forest = WeightedForest()
        kept = {c: forest.link(c, links[c]) for c in sorted(links)}
        for c, parent in links.items():
            top, off = forest.find(c) if kept[c] else (c, 0)
            out.append((p, scope, c, parent, top, off, not kept[c]))
            if len(out) >= 20_000:
                yield pd.DataFrame(out, columns=columns)
                out = []
    yield pd.DataFrame(out, columns=columns)


@dataclass
class Forest:
    """``local``: part, scope, child, parent, top, off. ``tops``: scope, node, part, top, off (null unless the node has a
    parent), root, to_root, total (nodes that hang below it in other pieces than its own). ``cuts``: scope, child, parent."""

    local: DataFrame
    tops: DataFrame
    cuts: DataFrame
    has_cuts: bool
    parts: int


def build_forest(links: DataFrame) -> Forest:
    """``links(scope, child, parent)`` without nulls; repeated ones count once."""
    spark = links.sparkSession
    ship(spark)
    per_child = cut(links.groupBy("scope", "child").agg(F.min("parent").alias("parent"), F.max("parent").alias("other")))
    single = per_child.where(F.col("parent") == F.col("other")).drop("other")
    several = per_child.where(F.col("parent") != F.col("other")).select("scope", "child")
    cuts = links.join(several, ["scope", "child"], "left_semi").select("scope", "child", "parent").distinct()
    cuts = cut(cuts)

    parts = max(cores(spark), int(spark.conf.get("spark.sql.shuffle.partitions")), per_child.count() // LOCAL_ROWS + 1)
    # Ranges are even whatever the scope or file, and keep a file's nodes together.
    local = cut(single.repartitionByRange(parts, "scope", "child").mapInPandas(_local, _LOCAL))
    while True:
        kept = local.where("not cut").drop("cut")
        closing = cut(local.where("cut").select("scope", "child", "parent"))
        all_cuts = cuts.unionByName(closing)
        ends = all_cuts.select("scope", F.explode(F.array("child", "parent")).alias("node")).distinct().withColumn("total", F.lit(0).cast("bigint"))
        tops = kept.groupBy("scope", F.col("top").alias("node")).agg(F.count("*").alias("total")).unionByName(ends).groupBy("scope", "node").agg(F.sum("total").alias("total"))
        tops = tops.join(kept.select("scope", F.col("child").alias("node"), "part", "top", "off"), ["scope", "node"], "left")
        tops = cut(tops)
        merged, loops = add_up(tops, ["total"])
        if loops is None:
            return Forest(kept, merged, all_cuts, not all_cuts.isEmpty(), parts)
        # One link of each loop across partitions becomes a cut; partitions that held one look again.
        hit = cut(loops.join(tops.select("scope", "node", "part"), ["scope", "node"]).select("part").distinct())
        again = local.join(hit, "part", "left_semi")
        rest = local.join(hit, "part", "left_anti")
        broken = again.join(loops.select("scope", F.col("node").alias("child")), ["scope", "child"], "left_semi").where("not cut")
        open_ = again.join(loops.select("scope", F.col("node").alias("child")), ["scope", "child"], "left_anti").where("not cut")
        cuts = cut(cuts.unionByName(broken.select("scope", "child", "parent")).unionByName(again.where("cut").select("scope", "child", "parent")))
        anew = open_.select("part", "scope", "child", "parent").repartitionById(parts, F.col("part")).mapInPandas(_local, _LOCAL)
        local = cut(rest.unionByName(anew))


def add_up(tops: DataFrame, amounts: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """``tops(scope, node, top, off, *amounts, ...)`` with ``root``, ``to_root`` and the amounts summed over all that hang below,
    or one node of each loop among them.

    Only tops that have a parent elsewhere take part; roots get their sums from those in the end. Up to ``LOCAL_ROWS`` of
    them go through one more disjoint set. More are doubled: in round k a pointer leads 2^k links up, and a node has the
    sums of the 2^k levels from itself on; what points to it brings the next 2^k. A node whose pointer ends knows its root.
    Rounds end when all do, or when a round finishes none: depths have no gaps, so what is left then never ends. Sums are
    partial aggregates, pointers a join of many to one.
    """
    inner = cut(tops.where("top is not null").select("scope", "node", "top", F.col("off").cast("bigint").alias("off"), *amounts))
    left = inner.count()
    if left <= LOCAL_ROWS:
        names = ", ".join(f"{a} bigint" for a in amounts)
        merged = cut(inner.coalesce(1).mapInPandas(_merge_local(amounts), f"scope string, node string, root string, to_root bigint, {names}"))
        loops = merged.where("root is null")
        if not loops.isEmpty():
            return tops, loops.select("scope", "node")
        return _with_roots(tops, merged, inner, amounts), None
    roots = tops.where("top is null").select("scope", "node")
    ends = inner.select("scope", F.col("top").alias("node")).distinct().join(roots, ["scope", "node"], "left_semi")
    state = inner.select(
        "scope", "node", *amounts, F.col("top").alias("jump"), F.col("off").alias("far"), F.lit(None).cast("string").alias("root"), F.lit(None).cast("bigint").alias("to_root"), F.col("node").alias("least")
    ).unionByName(
        ends.select(
            "scope", "node", *(F.lit(0).cast("bigint").alias(a) for a in amounts), F.lit(None).cast("string").alias("jump"), F.lit(None).cast("bigint").alias("far"),
            F.col("node").alias("root"), F.lit(0).cast("bigint").alias("to_root"), F.col("node").alias("least"),
        )
    )
    seen, rounds = -1, 0
    while left and left != seen:
        state = cut(_doubled(state, amounts))
        seen, left, rounds = left, state.where("jump is not null").count(), rounds + 1
    if not left:
        return _with_roots(tops, state, inner, amounts), None
    ring = state.where("jump is not null")
    while 2**rounds < left:  # until every pointer has gone round its loop
        ring, rounds = cut(_doubled(ring, [])), rounds + 1
    return tops, cut(ring.where(F.col("node") == F.col("least")).select("scope", "node"))


def _with_roots(tops: DataFrame, merged: DataFrame, inner: DataFrame, amounts: list[str]) -> DataFrame:
    """``tops`` with what was found for those with a parent, and with the sums of all that hang below the others."""
    found = merged.select("scope", "node", F.col("root").alias("_root"), F.col("to_root").alias("_to"), *(F.col(a).alias(f"_{a}") for a in amounts)).where("_to > 0")
    below = inner.select("scope", "node", *amounts).join(found.select("scope", "node", "_root"), ["scope", "node"]).groupBy("scope", F.col("_root").alias("node")).agg(*(F.sum(a).alias(f"_{a}") for a in amounts))
    more = found.unionByName(below.select("scope", "node", F.col("node").alias("_root"), F.lit(0).cast("bigint").alias("_to"), *(f"_{a}" for a in amounts)))
    rest = [c for c in tops.columns if c not in amounts]
    inside = F.col("top").isNotNull()
    sums = (F.when(inside, F.col(f"_{a}")).otherwise(F.col(a) + F.coalesce(f"_{a}", F.lit(0))).alias(a) for a in amounts)
    return tops.join(more, ["scope", "node"], "left").select(*rest, *sums, F.coalesce("_root", "node").alias("root"), F.coalesce("_to", F.lit(0)).alias("to_root"))


def _merge_local(amounts: list[str]):
    """One more disjoint set over the tops of all partitions; a row without a root closes a loop."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest, sums, up = WeightedForest(), {}, {}
        for b in batches:
            for scope, node, top, off, *of in zip(*(b[c] for c in ("scope", "node", "top", "off", *amounts)), strict=True):
                sums[scope, node] = [int(x) for x in of]
                up[scope, node] = (scope, top), int(off)
        out = []
        for c in sorted(up):
            if not forest.link(c, up[c][0], up[c][1]):
                out.append((*c, None, None, *sums[c]))
        place = {c: forest.find(c) for c in up}
        for c in sorted(up, key=lambda c: place[c][1], reverse=True):
            above = sums.get(up[c][0])
            if above is not None and not out:
                for i, x in enumerate(sums[c]):
                    above[i] += x
        if not out:
            out = [(*c, place[c][0][1], place[c][1], *sums[c]) for c in up]
        yield pd.DataFrame(out, columns=["scope", "node", "root", "to_root", *amounts]).astype({"to_root": "Int64"})

    return run


def _doubled(state: DataFrame, amounts: list[str]) -> DataFrame:
    at = F.coalesce("jump", "node")
    step = state.select("scope", F.col("node").alias("_at"), F.col("jump").alias("_jump"), F.col("far").alias("_far"), F.col("root").alias("_root"), F.col("to_root").alias("_to"), F.col("least").alias("_least"))
    s = state.withColumn("_at", at)
    if amounts:
        more = state.where("jump is not null").groupBy("scope", F.col("jump").alias("node")).agg(*(F.sum(a).alias(f"_{a}") for a in amounts))
        s = s.join(more, ["scope", "node"], "left")
    s = s.join(step, ["scope", "_at"], "left")
    open_ = F.col("jump").isNotNull()
    rest = [c for c in state.columns if c not in (*amounts, "jump", "far", "root", "to_root", "least")]
    return s.select(
        *rest,
        *((F.col(a) + F.coalesce(f"_{a}", F.lit(0))).alias(a) for a in amounts),
        F.when(open_, F.col("_jump")).alias("jump"),
        F.when(open_, F.col("far") + F.col("_far")).alias("far"),
        F.coalesce("root", "_root").alias("root"),
        F.coalesce("to_root", F.col("far") + F.col("_to")).alias("to_root"),
        F.least("least", F.coalesce("_least", "least")).alias("least"),
    )


# Loops


@dataclass
class Behind:
    """What cuts add. ``amounts``: scope, node, extra, loops at parent ends of cuts. ``trees``: scope, root, reach, for trees
    on a loop. ``tainted``: scope, root of the trees that a cut leads to."""

    amounts: DataFrame
    trees: DataFrame
    tainted: DataFrame
    overlap: bool  # whether trees may be reached in several ways


_KEY = "\x1f"


def _behind(f: Forest) -> Behind:
    def key(c: str):
        return F.concat_ws(_KEY, "scope", c)

    ends = f.cuts.select("scope", F.col("parent").alias("node")).distinct()
    ends = ends.join(f.local.select("scope", F.col("child").alias("node"), "top"), ["scope", "node"], "left").withColumn("top", F.coalesce("top", "node"))
    ends = ends.join(f.tops.select("scope", F.col("node").alias("top"), "root"), ["scope", "top"]).select("scope", F.col("node").alias("parent"), "root")
    links = cut(f.cuts.join(ends, ["scope", "parent"]).select("scope", "parent", "root", "child", key("root").alias("a"), key("child").alias("b")))
    tainted = f.cuts.select("scope", F.col("child").alias("root")).distinct()
    if links.count() <= LOCAL_ROWS:
        n = F.lit(0).cast("bigint")
        roots = links.select("scope", F.explode(F.array("root", "child")).alias("root")).distinct()
        sizes = f.tops.where("top is null").select("scope", F.col("node").alias("root"), (F.col("total") + 1).alias("n")).join(roots, ["scope", "root"], "left_semi")
        rows = links.select("scope", "parent", "root", "child", n.alias("n")).unionByName(sizes.select("scope", F.lit(None).cast("string").alias("parent"), "root", F.lit(None).cast("string").alias("child"), "n"))
        solved = cut(rows.coalesce(1).mapInPandas(_behind_local, "kind string, scope string, node string, extra bigint, loops bigint, reach bigint"))
        if solved.where("kind = 'overlap'").isEmpty():
            amounts = solved.where("kind = 'amount'").select("scope", "node", "extra", "loops")
            return Behind(amounts, solved.where("kind = 'tree'").select("scope", F.col("node").alias("root"), "reach"), tainted, False)
    size = f.tops.where("top is null").select(key("node").alias("node"), "scope", F.col("node").alias("root"), (F.col("total") + 1).alias("n"))
    member = components(links.select(F.col("a").alias("src_id"), F.col("b").alias("dst_id")))
    names = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    member = cut(names.join(member, "node", "left").select("node", F.coalesce("component", "node").alias("component")).join(size, "node"))
    links = links.join(member.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a").join(member.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b")
    links = cut(links.withColumn("inside", F.col("ca") == F.col("cb")))
    over = links.where("not inside").groupBy(F.col("cb").alias("node")).agg(F.min("ca").alias("top"), F.count("*").alias("ways"))
    parts = member.groupBy(F.col("component").alias("node")).agg(F.sum("n").alias("total"))
    over = cut(parts.join(over, "node", "left").select(F.lit("").alias("scope"), "node", "total", "top", F.lit(1).alias("off"), "ways"))
    if over.where("ways > 1").isEmpty():
        reach = add_up(over, ["total"])[0].select(F.col("node").alias("component"), F.col("total").alias("reach"))
    else:  # nodes with several parents that close no loop: what they reach overlaps
        pairs = _closure(links.where("not inside").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        own = parts.select(F.col("node").alias("a"), F.col("node").alias("b"))
        reach = own.unionByName(pairs).join(parts.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("component")).agg(F.sum("total").alias("reach"))
    links = links.join(reach.withColumnRenamed("component", "cb"), "cb")
    amounts = links.groupBy("scope", F.col("parent").alias("node")).agg(
        F.sum(F.when(F.col("inside"), 0).otherwise(F.col("reach"))).alias("extra"), F.count_if("inside").alias("loops")
    )
    trees = member.join(reach, "component").select("scope", "root", "reach")
    return Behind(cut(amounts), cut(trees), tainted, True)


def _behind_local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What ``_behind`` works out, for the cuts of one task: components of trees by one walk, sums up the trees between them.

    A component that two cuts lead into is told by a row of kind overlap alone.
    """
    cuts, size = [], {}
    for b in batches:
        for scope, parent, root, child, n in zip(*(b[c] for c in ("scope", "parent", "root", "child", "n")), strict=True):
            if child is None:
                size[scope, root] = int(n)
            else:
                cuts.append(((scope, parent), (scope, root), (scope, child)))
    down: dict = {}
    for _, a, b in cuts:
        down.setdefault(a, []).append(b)
    member = walked(down)
    whole: dict = {}
    for t, n in size.items():
        c = member.get(t, t)
        whole[c] = whole.get(c, 0) + n
    above: dict = {}
    columns = ["kind", "scope", "node", "extra", "loops", "reach"]
    for _, a, b in cuts:
        ca, cb = member.get(a, a), member.get(b, b)
        if ca != cb:
            if cb in above:
                yield pd.DataFrame([("overlap", None, None, 0, 0, 0)], columns=columns)
                return
            above[cb] = ca
    depth: dict = {}
    for c in whole:
        way = [c]
        while way[-1] in above and way[-1] not in depth:
            way.append(above[way[-1]])
        at = depth.setdefault(way[-1], 0)
        for x in reversed(way[:-1]):
            at = depth[x] = at + 1
    for c in sorted(above, key=lambda c: depth[c], reverse=True):
        whole[above[c]] += whole[c]
    amounts: dict = {}
    for p, a, b in cuts:
        ca, cb = member.get(a, a), member.get(b, b)
        m = amounts.setdefault(p, [0, 0])
        m[0] += 0 if ca == cb else whole[cb]
        m[1] += ca == cb
    out = [("amount", *p, e, n, 0) for p, (e, n) in amounts.items()] + [("tree", *t, 0, 0, whole[member.get(t, t)]) for t in size]
    yield pd.DataFrame(out, columns=columns)


def _closure(edges: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` with a way from a to b over ``edges(a, b)``; semi-naive."""
    edges = cut(edges.distinct())
    pairs = delta = edges
    while True:
        step = edges.select(F.col("a").alias("b"), F.col("b").alias("c"))
        delta = cut(delta.join(step, "b").select("a", F.col("c").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti"))
        if delta.isEmpty():
            return pairs
        pairs = cut(pairs.unionByName(delta))


def _overlapping(f: Forest, b: Behind) -> DataFrame | None:
    """``(scope, node, extra)`` of nodes off loops above links into nodes with several parents that close no loop.

    There the same nodes are reached in several ways, so they are counted apart: from each node above such a link to the
    trees behind it. Null where no node has two such parents, which is what a hierarchy with nothing but loops wrong has.
    """
    if not b.overlap:
        return None
    way = f.cuts.groupBy("scope", "child").agg(F.count("*").alias("n"))
    looped = b.amounts.where("loops > 0").select("scope", F.col("node").alias("parent"))
    free = f.cuts.join(looped, ["scope", "parent"], "left_anti").groupBy("scope", "child").agg(F.count("*").alias("n")).where("n > 1")
    if free.join(way.select("scope", "child"), ["scope", "child"], "left_semi").isEmpty():
        return None
    parents = f.cuts.select("scope", F.col("parent").alias("node")).distinct()
    above = _paths(f, parents).select("scope", "node", F.explode(F.concat("path", F.array("node"))).alias("x"), F.coalesce(F.get("path", F.lit(0)), F.col("node")).alias("root"))
    trees = _closure(
        f.cuts.join(above.select("scope", F.col("node").alias("parent"), "root").distinct(), ["scope", "parent"]).select(F.struct("scope", F.col("root").alias("node")).alias("a"), F.struct("scope", F.col("child").alias("node")).alias("b"))
    )
    direct = above.join(f.cuts.select("scope", F.col("parent").alias("node"), "child"), ["scope", "node"]).select("scope", "x", F.struct("scope", F.col("child").alias("node")).alias("b"))
    onward = direct.withColumnRenamed("b", "a").join(trees, "a").select("scope", "x", "b")
    size = f.tops.where("top is null").select(F.struct("scope", "node").alias("b"), (F.col("total") + 1).alias("n"))
    return direct.unionByName(onward).distinct().join(size, "b").groupBy("scope", F.col("x").alias("node")).agg(F.sum("n").alias("extra"))


# The second pass


def _second(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Root, depth and descendants of a partition's children, from what its tops and single nodes brought back."""
    links: dict[tuple, dict[str, str]] = {}
    tops: dict[tuple, tuple] = {}
    amounts: dict[tuple, list[int]] = {}
    for b in batches:
        for part, kind, scope, node, parent, root, off, total, extra, loops, reach, tainted in zip(
            *(b[c] for c in ("part", "kind", "scope", "node", "parent", "root", "off", "total", "extra", "loops", "reach", "tainted")), strict=True
        ):
            if kind == LINK:
                links.setdefault((part, scope), {})[node] = parent
            elif kind == TOP:
                tops[part, scope, node] = root, int(off), None if pd.isna(reach) else int(reach), bool(tainted)
            else:
                a = amounts.setdefault((part, scope, node), [0, 0, 0])
                for i, x in enumerate((total, extra, loops)):
                    a[i] += int(x)
    out, columns = [], ["scope", "node", "root", "depth", "n_descendants"]
    for (part, scope), of in links.items():
        forest = WeightedForest()
        for c in sorted(of):
            forest.link(c, of[c])
        place = {c: forest.find(c) for c in of}
        sums = {c: list(amounts.get((part, scope, c), (0, 0, 0))) for c in of}
        for c in sorted(of, key=lambda c: place[c][1], reverse=True):  # children before parents
            up = sums.get(of[c])
            if up is not None:
                mine = sums[c]
                up[0] += mine[0] + 1
                up[1] += mine[1]
                up[2] += mine[2]
        for c, (top, off) in place.items():
            root, to_root, reach, tainted = tops[part, scope, top]
            below, extra, loops = sums[c]
            n = reach - 1 if loops else below + extra
            out.append((scope, c, "" if tainted else root, -1 if tainted else off + to_root, n))
            if len(out) >= 20_000:
                yield pd.DataFrame(out, columns=columns)
                out = []
    yield pd.DataFrame(out, columns=columns)


def _rows(df: DataFrame, kind: int, **given) -> DataFrame:
    """``df`` in the shape of the second pass."""
    columns = []
    for c in _SECOND.split(", "):
        name, type_ = c.split(" ", 1)
        value = F.lit(kind) if name == "kind" else given.get(name, F.lit(None))
        columns.append(value.cast(type_).alias(name))
    return df.select(*columns)


def _link_rows(f: Forest) -> DataFrame:
    return _rows(f.local, LINK, part=F.col("part"), scope=F.col("scope"), node=F.col("child"), parent=F.col("parent"))


def hierarchy(links: DataFrame, scope: str = "repo", parent: str = "src_id", child: str = "dst_id", paths: bool = False) -> DataFrame:
    """``(scope, node, root, depth, n_descendants)`` of every id at an end of a link; with ``paths``, ``path`` too.

    A node without parent has depth 0 and an empty path. A node on a loop, or under one, has root '', depth -1 and a
    null path; a link from a node to itself is a loop. ``n_descendants`` counts the different other nodes that can be
    reached, loops included. Repeated links count once, links with a null end or scope do not count, an empty input
    gives an empty result, and other columns do not matter. A node with several parents none of which closes a loop has
    no single path; it and all under it get root '' and depth -1 too.

    Cost: the links move three times, whatever the depth; rounds are logarithmic in the number of partitions that a
    chain crosses. Only ``paths`` costs the sum of all path lengths, which is the size of what it returns.
    """
    named = links.select(F.col(scope).alias("scope"), F.col(child).alias("child"), F.col(parent).alias("parent")).dropna()
    f = build_forest(named)
    zero = F.lit(0).cast("bigint")
    tops = f.tops.withColumn("extra", zero).withColumn("loops", zero).withColumn("reach", F.lit(None).cast("bigint")).withColumn("tainted", F.lit(False))
    rows = _link_rows(f)
    apart = None
    if f.has_cuts:
        b = _behind(f)
        apart = _overlapping(f, b)
        at = b.amounts.join(f.local.select("scope", F.col("child").alias("node"), "part", "top"), ["scope", "node"], "left")
        at = cut(at)
        rows = rows.unionByName(_rows(at.where("part is not null"), AMOUNT, part=F.col("part"), scope=F.col("scope"), node=F.col("node"), total=zero, extra=F.col("extra"), loops=F.col("loops")))
        hung = at.groupBy("scope", F.coalesce("top", "node").alias("node")).agg(F.sum("extra").alias("extra"), F.sum("loops").alias("loops"))
        more = f.tops.select("scope", "node", "top", "off").join(hung, ["scope", "node"], "left").na.fill(0, ["extra", "loops"])
        more = add_up(cut(more), ["extra", "loops"])[0].select("scope", "node", "extra", "loops")
        tops = f.tops.join(more, ["scope", "node"]).join(b.trees, ["scope", "root"], "left").join(b.tainted.withColumn("tainted", F.lit(True)), ["scope", "root"], "left")
        tops = cut(tops.withColumn("tainted", F.coalesce("tainted", F.lit(False))))
    used = f.local.select("part", "scope", F.col("top").alias("node")).distinct()
    told = used.join(tops.select("scope", "node", "root", "to_root", "reach", "tainted"), ["scope", "node"])
    rows = rows.unionByName(_rows(told, TOP, **{c: F.col(c) for c in ("part", "scope", "node", "root", "reach", "tainted")}, off=F.col("to_root")))
    back = tops.where("top is not null")
    rows = rows.unionByName(_rows(back, AMOUNT, **{c: F.col(c) for c in ("part", "scope", "node", "total", "extra", "loops")}))
    below = rows.repartitionById(f.parts, F.col("part")).mapInPandas(_second, _FOUND)
    n = F.when(F.col("loops") > 0, F.col("reach") - 1).otherwise(F.col("total") + F.col("extra"))
    roots = tops.where("top is null").select(
        "scope", "node", F.when(F.col("tainted"), "").otherwise(F.col("node")).alias("root"), F.when(F.col("tainted"), -1).otherwise(0).alias("depth"), n.cast("int").alias("n_descendants")
    )
    out = below.unionByName(roots)
    if apart is not None:
        out = _count_apart(out, f, apart, b)
    if not paths:
        return out
    out = cut(out)
    way = _paths(f, out.where("depth > 0").select("scope", "node"))
    path = F.when(F.col("depth") == 0, F.array().cast("array<string>")).otherwise(F.col("path"))
    return out.join(way, ["scope", "node"], "left").select("scope", "node", "root", "depth", path.alias("path"), "n_descendants")


def _count_apart(out: DataFrame, f: Forest, apart: DataFrame, b: Behind) -> DataFrame:
    """``out`` with the descendants of nodes above overlapping links counted as different ones."""
    cutless = hierarchy_of_forest(f)
    own = cutless.join(apart, ["scope", "node"]).join(_on_loops(f, b), ["scope", "node"], "left_anti").select("scope", "node", (F.col("below") + F.col("extra")).cast("int").alias("exact"))
    return out.join(own, ["scope", "node"], "left").select("scope", "node", "root", "depth", F.coalesce("exact", "n_descendants").alias("n_descendants"))


def hierarchy_of_forest(f: Forest) -> DataFrame:
    """``(scope, node, below)``: descendants of every node over links that are no cuts."""
    zero = F.lit(0).cast("bigint")
    used = f.local.select("part", "scope", F.col("top").alias("node")).distinct().join(f.tops.select("scope", "node", "root", "to_root"), ["scope", "node"])
    rows = _link_rows(f).unionByName(_rows(used, TOP, **{c: F.col(c) for c in ("part", "scope", "node", "root")}, off=F.col("to_root"), tainted=F.lit(False)))
    rows = rows.unionByName(_rows(f.tops.where("top is not null"), AMOUNT, **{c: F.col(c) for c in ("part", "scope", "node", "total")}, extra=zero, loops=zero))
    below = rows.repartitionById(f.parts, F.col("part")).mapInPandas(_second, _FOUND).select("scope", "node", F.col("n_descendants").cast("bigint").alias("below"))
    return below.unionByName(f.tops.where("top is null").select("scope", "node", F.col("total").alias("below")))


def _on_loops(f: Forest, b: Behind) -> DataFrame:
    heads = b.amounts.where("loops > 0").select("scope", "node")
    return _paths(f, heads).select("scope", F.explode(F.concat("path", F.array("node"))).alias("node")).distinct()


# Paths


def _local_ways(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ancestors of asked nodes (kind 2) from their tops down, behind the ancestors of the tops where these are known."""
    links: dict[tuple, dict[str, str]] = {}
    tops: dict[tuple, list[str]] = {}
    asked: dict[tuple, set[str]] = {}
    for b in batches:
        for part, kind, scope, node, parent, path in zip(*(b[c] for c in ("part", "kind", "scope", "node", "parent", "path")), strict=True):
            if kind == LINK:
                links.setdefault((part, scope), {})[node] = parent
            elif kind == TOP:
                tops[part, scope, node] = list(path)
            else:
                asked.setdefault((part, scope), set()).add(node)
    out, columns, size = [], ["scope", "node", "path"], 0
    for (part, scope), nodes in asked.items():
        of = links.get((part, scope), {})
        for c in nodes:
            way = []
            x = c
            while x in of:
                x = of[x]
                way.append(x)
            way.reverse()
            if way:
                out.append((scope, c, [*tops.get((part, scope, way[0]), ()), *way]))
                size += len(out[-1][2])
            if size >= 200_000:
                yield pd.DataFrame(out, columns=columns)
                out, size = [], 0
    yield pd.DataFrame(out, columns=columns)


_WAYS = "scope string, node string, path array<string>"


def _paths(f: Forest, asked: DataFrame) -> DataFrame:
    """``(scope, node, path)``: forest ancestors of ``asked(scope, node)`` from the root down, by walks up indexed parents.

    The tops' own ways within their partitions are put together first, doubling like their pointers, then handed to the
    partitions of the asked nodes.
    """
    place = {c: F.col(c) for c in ("part", "scope", "node")}

    def walk(rows: DataFrame) -> DataFrame:
        return _link_rows(f).unionByName(rows).repartitionById(f.parts, F.col("part")).mapInPandas(_local_ways, _WAYS)

    inner = f.tops.where("top is not null")
    state = cut(inner.select("scope", "node", "top").join(walk(_rows(inner, AMOUNT, **place)), ["scope", "node"]))
    while not state.where("top is not null").isEmpty():
        step = state.select("scope", F.col("node").alias("_at"), F.col("top").alias("_top"), F.col("path").alias("above"))
        s = state.withColumn("_at", F.coalesce("top", F.lit(""))).join(step, ["scope", "_at"], "left")
        open_ = F.col("top").isNotNull() & F.col("above").isNotNull()
        state = cut(s.select("scope", "node", F.when(open_, F.col("_top")).alias("top"), F.when(open_, F.concat("above", "path")).otherwise(F.col("path")).alias("path")))
    used = f.local.select("part", "scope", F.col("top").alias("node")).distinct().join(state.select("scope", "node", "path"), ["scope", "node"])
    told = _rows(used, TOP, **place, path=F.col("path"))
    wanted = asked.distinct().join(f.local.select("scope", F.col("child").alias("node"), "part"), ["scope", "node"], "left")
    wanted = cut(wanted)
    found = walk(told.unionByName(_rows(wanted.where("part is not null"), AMOUNT, **place)))
    return found.unionByName(wanted.where("part is null").select("scope", "node", F.array().cast("array<string>").alias("path")))


def descendants(nodes: DataFrame) -> DataFrame:
    """``(scope, node, descendant, distance)`` of a ``hierarchy(..., paths=True)``; nodes on or under a loop are left out."""
    good = nodes.where(F.col("path").isNotNull())
    pairs = good.select("scope", F.col("node").alias("descendant"), F.size("path").alias("_d"), F.posexplode("path").alias("_p", "node"))
    return pairs.select("scope", "node", "descendant", (F.col("_d") - F.col("_p")).alias("distance"))


def define_links(edges: DataFrame) -> DataFrame:
    """Edges of kind defines (case and outer blanks do not matter)."""
    return edges.where(F.lower(F.trim("kind")) == "defines")


def deepest(nodes: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` deepest nodes of each scope, ties by id."""
    w = Window.partitionBy("scope").orderBy(F.desc("depth"), "node")
    return nodes.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
