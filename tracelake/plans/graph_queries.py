"""Queries over the code graph, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators import graph as G
from tracelake.operators import locate, reach, report
from tracelake.plans import code_graph as P


def _untrusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.entry_points(spark, sf_dir).where("trust = 'untrusted'")


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reach.trace(P.findings(spark, sf_dir), P.edges(spark, sf_dir), P.entry_points(spark, sf_dir))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None)
    return (
        P.findings(spark, sf_dir)
        .join(_evidence(spark, sf_dir), "finding_id")
        .withColumn("verdict", none.cast("string"))
        .withColumn("confidence", none.cast("double"))
        .withColumn("rank_id", F.col("finding_id"))
    )


def reach_pairs(spark, sf_dir) -> DataFrame:
    return G.reach_pairs(G.full_graph(P.edges(spark, sf_dir)), _untrusted(spark, sf_dir)).select("seed", "node")


def reach_resolved_depth(spark, sf_dir) -> DataFrame:
    return G.shortest_paths(G.resolved_graph(G.full_graph(P.edges(spark, sf_dir))), _untrusted(spark, sf_dir)).select("node", "depth")


def shortest_paths(spark, sf_dir) -> DataFrame:
    found = G.shortest_paths(G.full_graph(P.edges(spark, sf_dir)), _untrusted(spark, sf_dir))
    return found.select("node", "depth", F.array_join("path", G.ARROW).alias("path"))


def blast_radius(spark, sf_dir) -> DataFrame:
    return G.blast_radii(G.full_graph(P.edges(spark, sf_dir)), _untrusted(spark, sf_dir))


def finding_reachability(spark, sf_dir) -> DataFrame:
    """All findings with class, path and blast radius, most urgent first."""
    ranked = _judged(spark, sf_dir).orderBy(*reach.rank_keys(), "ordinal", "finding_id")
    return ranked.select("finding_id", "node_id", "source", "reachable", F.array_join("path", G.ARROW).alias("path"), "blast_radius")


def reachability_counts(spark, sf_dir) -> DataFrame:
    return _evidence(spark, sf_dir).groupBy("reachable").agg(F.count("*").alias("n"))


def ranked_topk(spark, sf_dir) -> DataFrame:
    """The twenty most urgent findings."""
    top = _judged(spark, sf_dir).orderBy(*reach.rank_keys(), "ordinal", "finding_id").limit(20)
    return top.select("finding_id", "reachable", "blast_radius", "raw_severity")


def attack_surface(spark, sf_dir) -> DataFrame:
    """Share of the functions that resolved edges reach from an untrusted entry point."""
    surface = G.attack_surface(G.full_graph(P.edges(spark, sf_dir)), _untrusted(spark, sf_dir)).withColumn("exposed", F.lit(True))
    functions = P.nodes(spark, sf_dir).where("kind = 'function'").select("node_id").distinct().join(surface, "node_id", "left")
    return functions.agg(
        F.count("*").alias("functions"), F.count_if(F.coalesce("exposed", F.lit(False))).alias("exposed"), F.round(F.count_if(F.coalesce("exposed", F.lit(False))) / F.count("*"), 6).alias("ratio")
    )


def worst_reach_by_file(spark, sf_dir) -> DataFrame:
    return reach.worst_by(_judged(spark, sf_dir), "file_path")


def file_link_fold(spark, sf_dir) -> DataFrame:
    """Calls between files, and whether any link is a call."""
    nodes = P.nodes(spark, sf_dir).groupBy("node_id").agg(F.min("kind").alias("kind"), F.min("file_path").alias("file_path"))
    return report.file_links(nodes, P.edges(spark, sf_dir))


def node_degree(spark, sf_dir) -> DataFrame:
    return G.degrees(P.calls(spark, sf_dir))


def edges_last_wins(spark, sf_dir) -> DataFrame:
    """One edge per (source, target, kind), the last by ordinal; a resolved one on a tie."""
    return G.unique_edges(P.edges(spark, sf_dir))


def callers_agg(spark, sf_dir) -> DataFrame:
    found = G.predecessors(P.calls(spark, sf_dir), P.nodes(spark, sf_dir))
    return found.select("node_id", F.array_join("callers", ",").alias("callers"))


def path_hops(spark, sf_dir) -> DataFrame:
    e = P.edges(spark, sf_dir)
    return G.path_hops(G.shortest_paths(G.full_graph(e), _untrusted(spark, sf_dir)), e)


def scc_levels(spark, sf_dir) -> DataFrame:
    """Components and callee-first levels of the call graph."""
    return G.callee_first(P.calls(spark, sf_dir), P.nodes(spark, sf_dir).where("kind <> 'file'"))


def strong_components(spark, sf_dir) -> DataFrame:
    return G.components(P.calls(spark, sf_dir))


def innermost_span_first(spark, sf_dir) -> DataFrame:
    return _innermost(spark, sf_dir, last=False)


def innermost_span_last(spark, sf_dir) -> DataFrame:
    return _innermost(spark, sf_dir, last=True)


def _innermost(spark, sf_dir, last: bool) -> DataFrame:
    """The innermost def span over each finding's line, the file where there is none."""
    sites = P.findings(spark, sf_dir).select(F.col("finding_id").alias("site_id"), "file_path", "line")
    spans = P.nodes(spark, sf_dir).where("kind <> 'file'")
    return locate.innermost(sites, spans, last=last).select("site_id", F.coalesce("node_id", "file_path").alias("node_id"))


def dedupe_groups(spark, sf_dir) -> DataFrame:
    return _groups(spark, sf_dir).select("anchor", "weakness", "line", F.array_join("members", ",").alias("members"), "n_sources")


def _groups(spark, sf_dir) -> DataFrame:
    return locate.duplicate_groups(P.findings(spark, sf_dir).withColumnRenamed("file_path", "rel_path"))


def cross_source_dupes(spark, sf_dir) -> DataFrame:
    return locate.cross_scanner_duplicates(_groups(spark, sf_dir))


def occurrence_ids(spark, sf_dir) -> DataFrame:
    none = F.lit(None).cast("string")
    rows = P.findings(spark, sf_dir).select(
        "source",
        "rule_id",
        F.col("file_path").alias("rel_path"),
        none.alias("source_hash"),
        F.coalesce("cwe", F.lit("")).alias("line_text"),
        none.alias("package"),
        none.alias("package_version"),
        "line",
        F.col("finding_id").alias("scan_ordinal"),
    )
    return locate.finding_ids(rows).select(F.col("scan_ordinal").alias("row_id"), "finding_id")


def unknown_targets(spark, sf_dir) -> DataFrame:
    """Call targets that no definition has, with the file of their first caller."""
    return G.unknown_targets(P.edges(spark, sf_dir), P.nodes(spark, sf_dir)).select("dst_id", "file_path")


def package_in_use(spark, sf_dir) -> DataFrame:
    """Dependency findings, anchored in the files of their repository that import from elsewhere, looked at again where those
    came out unreachable."""
    bad = P.findings(spark, sf_dir).where("package is not null").select("finding_id", "repo")
    users = P.edges(spark, sf_dir).where("kind = 'imports' and not resolved").select(F.col("src_id").alias("node_id")).distinct()
    files = P.nodes(spark, sf_dir).where("kind = 'file'").select("node_id", "file_path").distinct().join(users, "node_id", "left_semi")
    anchors = G.cut(bad.join(files.withColumn("repo", F.split_part("file_path", F.lit("/"), F.lit(1))), "repo").select("finding_id", "node_id", "file_path").distinct())
    e = G.cut(P.edges(spark, sf_dir))
    entries = P.entry_points(spark, sf_dir)
    first = reach.trace(anchors.select("finding_id", "node_id"), e, entries)
    second = reach.import_in_use(G.cut(first), anchors.select("finding_id", "file_path"), e, P.nodes(spark, sf_dir), entries)
    return second.select("finding_id", "reachable", F.array_join("path", G.ARROW).alias("path"), "blast_radius")


#: Rows for the decision rules: edges, entry points, and what each finding must come out as.
RULE_EDGES = [
    ("chain.ep", "chain.f", "calls", True), ("chain.f", "chain.sink", "calls", True),
    ("b1", "b.sink", "calls", True), ("b2", "b.sink", "calls", True), ("b3", "b.sink", "calls", True),
    ("u.ep", "unknown::x", "calls", False), ("unknown::x", "u.sink", "calls", True),
    ("m.ep", "m.a", "calls", True), ("m.a", "m.b", "calls", True), ("m.b", "m.sink", "calls", True), ("m.ep", "m.sink", "calls", None), ("m.ep", "m.x", "calls", False), ("m.x", "m.sink", "calls", False),
    ("i.a", "i.b", "calls", True),
    ("c.ep", "c.a", "calls", True), ("c.a", "c.b", "calls", True), ("c.b", "c.c", "calls", True), ("c.c", "c.a", "calls", True),
    ("p.ep", "p.sink", "calls", False), ("p.ep", "p.sink", "imports", True),
    ("t.ep", "t.b", "calls", True), ("t.ep", "t.a", "calls", True), ("t.a", "t.sink", "calls", True), ("t.b", "t.sink", "calls", True),
]
RULE_ENTRIES = ["chain.ep", "b1", "b2", "b3", "u.ep", "m.ep", "c.ep", "p.ep", "t.ep"]
RULE_EXPECT = [
    ("absent", "nowhere", "unknown", "", 0), ("entry", "chain.ep", "reachable", "chain.ep", 1), ("chain", "chain.sink", "reachable", "chain.ep > chain.f > chain.sink", 1),
    ("blast", "b.sink", "reachable", "b1 > b.sink", 3), ("unresolved", "u.sink", "unknown", "u.ep > unknown::x > u.sink", 1), ("mixed", "m.sink", "reachable", "m.ep > m.a > m.b > m.sink", 1),
    ("isolated", "i.b", "unreachable", "", 0), ("loop", "c.c", "reachable", "c.ep > c.a > c.b > c.c", 1), ("parallel", "p.sink", "reachable", "p.ep > p.sink", 1), ("tie", "t.sink", "reachable", "t.ep > t.a > t.sink", 1),
]


def rules_literal(spark, sf_dir) -> DataFrame:
    from tracelake.core import ship

    ship(spark)
    edges = spark.createDataFrame(RULE_EDGES, "src_id string, dst_id string, kind string, resolved boolean")
    entries = spark.createDataFrame([(e, "untrusted") for e in RULE_ENTRIES], "node_id string, trust string")
    targets = spark.createDataFrame([(f, n) for f, n, *_ in RULE_EXPECT], "finding_id string, node_id string")
    return reach.trace(targets, edges, entries).select("finding_id", "reachable", F.array_join("path", G.ARROW).alias("path"), "blast_radius")


QUERIES = {
    f.__name__: f
    for f in (
        finding_reachability, reach_pairs, reach_resolved_depth, shortest_paths, blast_radius, reachability_counts, ranked_topk, attack_surface, worst_reach_by_file, file_link_fold, node_degree, edges_last_wins,
        callers_agg, path_hops, scc_levels, strong_components, innermost_span_first, innermost_span_last, dedupe_groups, cross_source_dupes, occurrence_ids, unknown_targets, package_in_use, rules_literal,
    )
}

_RANK = "CASE reachable WHEN 'reachable' THEN 3 WHEN 'unknown' THEN 2 ELSE 1 END"
_SEVERITY = "CASE raw_severity WHEN 'CRITICAL' THEN 5 WHEN 'HIGH' THEN 4 WHEN 'MEDIUM' THEN 3 WHEN 'LOW' THEN 2 WHEN 'INFO' THEN 1 ELSE 0 END"
_EVIDENCE = (P.GOOD, P.FAR, P.PAIRS, P.EVIDENCE)


def _span(order: str) -> str:
    return P.sql(
        f"""SELECT site_id, coalesce(hit, file_path) AS node_id FROM (SELECT s.finding_id AS site_id, s.file_path, n.node_id AS hit,
    row_number() OVER (PARTITION BY s.finding_id ORDER BY n.start_line DESC NULLS LAST, n.ordinal {order}) AS rn
  FROM findings s LEFT JOIN (SELECT * FROM defs WHERE kind <> 'file') n ON n.file_path = s.file_path AND s.line BETWEEN n.start_line AND n.end_line) WHERE rn = 1"""
    )


_GROUPS = """groups AS (SELECT CASE WHEN package IS NOT NULL THEN 'pkg:' || package || '@' || coalesce(package_version, '') ELSE coalesce(node_id, file_path) END AS anchor,
    CASE WHEN package IS NOT NULL THEN rule_id ELSE coalesce(cwe, source || ':' || rule_id) END AS weakness, CAST(CASE WHEN package IS NOT NULL THEN 0 ELSE line END AS INTEGER) AS line,
    list_sort(list(finding_id)) AS members, count(DISTINCT source) AS n_sources FROM findings GROUP BY 1, 2, 3)"""


SQL = {
    "finding_reachability": P.sql("SELECT f.finding_id, f.node_id, f.source, e.reachable, e.path, e.blast_radius FROM findings f JOIN evidence e USING (finding_id)", *_EVIDENCE),
    "reach_pairs": P.sql("SELECT seed, node FROM pairs", P.PAIRS),
    "reach_resolved_depth": P.sql("SELECT node, depth FROM good_depth", P.GOOD),
    "shortest_paths": P.sql("SELECT node, depth, path FROM far", P.FAR),
    "blast_radius": P.sql("SELECT node, n AS blast FROM blast", P.PAIRS),
    "reachability_counts": P.sql("SELECT reachable, count(*) AS n FROM evidence GROUP BY 1", *_EVIDENCE),
    "ranked_topk": P.sql(
        f"SELECT finding_id, reachable, blast_radius, raw_severity FROM findings JOIN evidence USING (finding_id) ORDER BY {_RANK} DESC, blast_radius DESC, {_SEVERITY} DESC, ordinal, finding_id LIMIT 20", *_EVIDENCE
    ),
    "attack_surface": P.sql(
        """SELECT count(*) AS functions, count(*) FILTER (WHERE s.node IS NOT NULL) AS exposed, round(count(*) FILTER (WHERE s.node IS NOT NULL) / count(*), 6) AS ratio
FROM (SELECT DISTINCT node_id FROM defs WHERE kind = 'function') n LEFT JOIN (SELECT DISTINCT node FROM surface) s ON s.node = n.node_id""",
        "surface AS (SELECT node_id AS node FROM untrusted UNION SELECT g.dst_id FROM surface s JOIN graph g ON g.src_id = s.node WHERE g.resolved)",
    ),
    "worst_reach_by_file": P.sql(f"SELECT f.file_path, count(*) AS n_findings, arg_max(e.reachable, {_RANK}) AS worst FROM findings f JOIN evidence e USING (finding_id) GROUP BY 1", *_EVIDENCE),
    "file_link_fold": P.sql(
        """SELECT a.f AS src, b.f AS dst, count(*) AS n, CASE WHEN bool_or(c.kind = 'calls') THEN 'calls' ELSE min(c.kind) END AS kind
FROM (SELECT DISTINCT src_id, dst_id, kind FROM links WHERE kind IN ('calls', 'imports', 'inherits')) c
JOIN (SELECT node_id, min(file_path) AS f FROM defs GROUP BY 1) a ON a.node_id = c.src_id JOIN (SELECT node_id, min(file_path) AS f FROM defs GROUP BY 1) b ON b.node_id = c.dst_id WHERE a.f <> b.f GROUP BY 1, 2"""
    ),
    "node_degree": P.sql("SELECT node_id, count(*) AS degree FROM (SELECT src_id AS node_id FROM calls UNION ALL SELECT dst_id FROM calls) GROUP BY 1"),
    "edges_last_wins": P.sql("SELECT src_id, dst_id, kind, max(struct_pack(o := ordinal, r := resolved)).r AS resolved FROM links GROUP BY 1, 2, 3"),
    "callers_agg": P.sql(
        "SELECT dst_id AS node_id, array_to_string(list_sort(list(src_id)), ',') AS callers FROM (SELECT DISTINCT src_id, dst_id FROM calls WHERE src_id IN (SELECT node_id FROM defs)) GROUP BY 1"
    ),
    "path_hops": P.sql(
        """SELECT h.node, CAST(h.hop AS INTEGER) AS hop, h.src_id, h.dst_id, array_to_string(list_sort(list(DISTINCT e.kind)), '+') AS kinds, bool_or(e.resolved) AS resolved
FROM (SELECT node, unnest(range(0, len(p) - 1)) AS hop, unnest(p[:-2]) AS src_id, unnest(p[2:]) AS dst_id FROM (SELECT node, string_split(path, ' > ') AS p FROM far) WHERE len(p) > 1) h
JOIN links e ON e.src_id = h.src_id AND e.dst_id = h.dst_id GROUP BY 1, 2, 3, 4""",
        P.FAR,
    ),
    "strong_components": P.sql(
        """SELECT i.x AS node, coalesce(least(i.x, min(r.b)), i.x) AS component FROM (SELECT src_id AS x FROM calls UNION SELECT dst_id FROM calls) i
LEFT JOIN (SELECT r.a, r.b FROM reach r JOIN reach q ON q.a = r.b AND q.b = r.a) r ON r.a = i.x GROUP BY i.x""",
        "reach AS (SELECT src_id AS a, dst_id AS b FROM calls UNION SELECT r.a, c.dst_id FROM reach r JOIN calls c ON c.src_id = r.b)",
    ),
    "scc_levels": P.sql(
        "SELECT m.x AS node, m.c AS component, CAST(max(l.l) AS INTEGER) AS level FROM member m JOIN lv l ON l.c = m.c GROUP BY 1, 2",
        "own AS MATERIALIZED (SELECT DISTINCT node_id FROM defs WHERE kind <> 'file')",
        "inner_calls AS MATERIALIZED (SELECT DISTINCT src_id AS a, dst_id AS b FROM calls WHERE src_id <> dst_id AND src_id IN (SELECT node_id FROM own) AND dst_id IN (SELECT node_id FROM own))",
        "reach AS (SELECT a, b FROM inner_calls UNION SELECT r.a, c.b FROM reach r JOIN inner_calls c ON c.a = r.b)",
        "member AS MATERIALIZED (SELECT o.node_id AS x, coalesce(least(o.node_id, min(r.b)), o.node_id) AS c FROM own o LEFT JOIN (SELECT r.a, r.b FROM reach r JOIN reach q ON q.a = r.b AND q.b = r.a) r ON r.a = o.node_id GROUP BY o.node_id)",
        "between AS MATERIALIZED (SELECT DISTINCT p.c AS a, q.c AS b FROM inner_calls i JOIN member p ON p.x = i.a JOIN member q ON q.x = i.b WHERE p.c <> q.c)",
        "lv AS (SELECT DISTINCT c, 0 AS l FROM member UNION SELECT t.a, lv.l + 1 FROM lv JOIN between t ON t.b = lv.c)",
    ),
    "innermost_span_first": _span("ASC"),
    "innermost_span_last": _span("DESC"),
    "dedupe_groups": P.sql("SELECT anchor, weakness, line, array_to_string(members, ',') AS members, n_sources FROM groups", _GROUPS),
    "cross_source_dupes": P.sql("SELECT CAST(coalesce(sum(len(members) - 1), 0) AS BIGINT) AS duplicates FROM groups WHERE n_sources > 1", _GROUPS),
    "occurrence_ids": P.sql(
        """SELECT finding_id AS row_id, sha256(concat_ws(chr(31), source, rule_id, file_path, coalesce(cwe, ''),
  CAST(row_number() OVER (PARTITION BY source, rule_id, file_path, coalesce(cwe, '') ORDER BY file_path, line, source, rule_id, finding_id) - 1 AS VARCHAR))) AS finding_id FROM findings"""
    ),
    "unknown_targets": P.sql(
        """SELECT c.dst_id, min(struct_pack(o := c.ordinal, f := n.file_path)).f AS file_path FROM links c JOIN defs n ON n.node_id = c.src_id
WHERE c.kind = 'calls' AND c.dst_id NOT IN (SELECT node_id FROM defs) GROUP BY 1"""
    ),
    "package_in_use": P.sql(
        """SELECT finding_id, CASE WHEN c.f IS NOT NULL THEN 'unknown' ELSE first.reachable END AS reachable, coalesce(c.b.p, first.path) AS path, coalesce(c.b.r, first.radius) AS blast_radius
FROM first LEFT JOIN (SELECT a.finding_id AS f, min(struct_pack(n := len(string_split(t.path, ' > ')), q := string_split(t.path, ' > '), p := t.path, r := t.radius)) AS b
  FROM anchors a JOIN first USING (finding_id) JOIN defs n ON n.file_path = a.file_path AND n.kind <> 'file' JOIN blind d ON d.node_id = n.node_id JOIN traced t ON t.node_id = n.node_id
  WHERE first.reachable = 'unreachable' GROUP BY 1) c ON c.f = first.finding_id""",
        P.GOOD, P.FAR, P.PAIRS,
        "anchors AS (SELECT DISTINCT f.finding_id, n.node_id, n.file_path FROM findings f JOIN defs n ON f.package IS NOT NULL AND n.kind = 'file' AND split_part(n.file_path, '/', 1) = f.repo JOIN (SELECT DISTINCT src_id FROM links WHERE kind = 'imports' AND NOT resolved) i ON i.src_id = n.node_id)",
        "blind AS (SELECT DISTINCT src_id AS node_id FROM calls WHERE NOT resolved OR starts_with(dst_id, 'unknown::'))",
        """traced AS MATERIALIZED (SELECT x.node_id, CASE WHEN u.node_id IS NOT NULL OR g.node IS NOT NULL THEN 1 ELSE 2 END AS k, CASE WHEN u.node_id IS NOT NULL THEN x.node_id ELSE coalesce(g.path, r.path) END AS path, CASE WHEN u.node_id IS NOT NULL THEN 1 ELSE b.n END AS radius
    FROM ends x LEFT JOIN untrusted u ON u.node_id = x.node_id LEFT JOIN good g ON g.node = x.node_id JOIN far r ON r.node = x.node_id JOIN blast b ON b.node = x.node_id)""",
        """seen AS MATERIALIZED (SELECT a.finding_id, count(k.node_id) AS inside, min(CASE WHEN t.k = 1 THEN struct_pack(n := len(string_split(t.path, ' > ')), q := string_split(t.path, ' > '), p := t.path) END) AS good,
    min(struct_pack(n := len(string_split(t.path, ' > ')), q := string_split(t.path, ' > '), p := t.path)) AS far FROM anchors a LEFT JOIN ends k ON k.node_id = a.node_id LEFT JOIN traced t ON t.node_id = a.node_id GROUP BY 1)""",
        """radius AS MATERIALIZED (SELECT a.finding_id, count(DISTINCT p.seed) AS n FROM anchors a JOIN pairs p ON p.node = a.node_id GROUP BY 1)""",
        """first AS MATERIALIZED (SELECT s.finding_id, CASE WHEN inside = 0 THEN 'unknown' WHEN good IS NOT NULL THEN 'reachable' WHEN far.n IS NOT NULL THEN 'unknown' ELSE 'unreachable' END AS reachable,
    CASE WHEN inside = 0 THEN '' ELSE coalesce(good.p, far.p, '') END AS path, CASE WHEN inside = 0 OR far.n IS NULL THEN 0 ELSE coalesce(r.n, 0) END AS radius FROM seen s LEFT JOIN radius r USING (finding_id))""",
    ),
    "rules_literal": "SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{r}', '{p}', CAST({b} AS BIGINT))" for f, _, r, p, b in RULE_EXPECT) + ") AS t(finding_id, reachable, path, blast_radius)",
}
