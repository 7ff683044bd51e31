"""Which findings untrusted input can reach: class, shortest path and blast radius, and how findings rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import scalar as S
from tracelake.operators import graph as G

REACHABLE, UNREACHABLE, UNKNOWN = "reachable", "unreachable", "unknown"
_RANK = ((REACHABLE, 3), (UNKNOWN, 2), (UNREACHABLE, 1))


def reach_rank(c) -> F.Column:
    out = F.lit(0)
    for name, rank in _RANK:
        out = F.when(c == name, rank).otherwise(out)
    return out


def trace(targets: DataFrame, edges: DataFrame, entry_points: DataFrame) -> DataFrame:
    """``(finding_id, reachable, path, blast_radius)`` for ``targets(finding_id, node_id)``, one or more nodes a finding.

    One search from all untrusted entry points serves every finding: over resolved edges for the class and its path,
    over all edges for the rest, plus the pairs for blast radii. In this order a finding is

    * unknown if there are no entry points at all, or none of its nodes is in the graph;
    * unreachable if no entry point is untrusted;
    * reachable with itself as path and radius 1 if one of its nodes is an untrusted entry point;
    * reachable with the shortest resolved path, if there is one;
    * unknown with the shortest path over all edges, if there is one;
    * unreachable otherwise.

    Ties of length go to the least path in text order. Missing evidence is never "unreachable".
    """
    spark = edges.sparkSession
    graph = G.cut(G.full_graph(edges))
    targets = targets.select("finding_id", "node_id").distinct()
    entries = entry_points.select("node_id", "trust").dropna(subset=["node_id"]).distinct()
    untrusted = G.cut(entries.where("trust = 'untrusted'").select("node_id").distinct())
    any_entry = not entries.isEmpty()
    any_untrusted = any_entry and not untrusted.isEmpty()
    nodes = graph.select(F.explode(F.array("src_id", "dst_id")).alias("node_id")).distinct().withColumn("known", F.lit(True))
    t = targets.join(nodes, "node_id", "left").join(untrusted.withColumn("is_entry", F.lit(True)), "node_id", "left")
    if any_untrusted:
        ids = G.numbering(graph, untrusted)
        wanted = targets.select(F.col("node_id").alias("node")).distinct().join(ids, "node").select(F.col("id").alias("node"), F.col("node").alias("node_id"))
        found = G.cut(G.search(graph, untrusted, ids).join(wanted, "node"))
        good, far, pairs = (found.where(F.col("layer") == x) for x in (G.GOOD, G.FAR, G.PAIR))
        t = (
            t.join(good.select("node_id", F.struct(F.size("path").alias("n"), "path").alias("good")), "node_id", "left")
            .join(far.select("node_id", F.struct(F.size("path").alias("n"), "path").alias("far")), "node_id", "left")
        )
        seeds = targets.join(pairs.select("node_id", "seed"), "node_id").groupBy("finding_id").agg(F.countDistinct("seed").alias("blast"))
    else:
        ids = None
        void = F.lit(None).cast("struct<n:int,path:array<bigint>>")
        t = t.withColumn("good", void).withColumn("far", void)
        seeds = spark.createDataFrame([], "finding_id string, blast bigint")
    # A target that is not in the graph has no paths; nor has one that only an entry point names.
    inside = F.coalesce("known", F.lit(False))
    f = t.groupBy("finding_id").agg(
        F.max(inside).alias("inside"),
        F.min(F.when(inside & F.coalesce("is_entry", F.lit(False)), F.col("node_id"))).alias("entry"),
        F.min(F.when(inside, F.col("good"))).alias("good"),
        F.min(F.when(inside, F.col("far"))).alias("far"),
    )
    f = f.join(seeds, "finding_id", "left").withColumn("blast", F.coalesce("blast", F.lit(0)))
    # Paths are chosen by numbers, which compare as names do; the names of the chosen ones come last.
    none = F.array().cast("array<string>")
    if ids is not None:
        f = G.cut(f.withColumn("path", F.coalesce("good.path", "far.path")))
        f = f.drop("path").join(G.named_paths(f.where("path is not null").select("finding_id", "path"), ids, "finding_id"), "finding_id", "left")
    else:
        f = f.withColumn("path", none)
    rules = (
        (F.lit(not any_entry) | ~F.col("inside"), UNKNOWN, none, F.lit(0)),
        (F.lit(not any_untrusted), UNREACHABLE, none, F.lit(0)),
        (F.col("entry").isNotNull(), REACHABLE, F.array("entry"), F.lit(1)),
        (F.col("good").isNotNull(), REACHABLE, F.col("path"), F.col("blast")),
        (F.col("far").isNotNull(), UNKNOWN, F.col("path"), F.col("blast")),
        (F.lit(True), UNREACHABLE, none, F.lit(0)),
    )
    kind = path = radius = None
    for when, k, p, b in rules:
        kind = (F if kind is None else kind).when(when, F.lit(k))
        path = (F if path is None else path).when(when, p)
        radius = (F if radius is None else radius).when(when, b)
    return f.select("finding_id", kind.alias("reachable"), path.alias("path"), radius.cast("bigint").alias("blast_radius"))


def import_in_use(evidence: DataFrame, anchors: DataFrame, edges: DataFrame, nodes: DataFrame, entry_points: DataFrame) -> DataFrame:
    """Dependency findings whose files came out unreachable, looked at again.

    ``anchors(finding_id, file_path)``: files that import the package. If a def in one of them makes an unresolved call
    and is itself reached (or may be), the finding is unknown, with that def's path and radius: the call may be into the
    package. The least candidate path wins.
    """
    blind = edges.where(F.col("kind") == "calls").where(G.unknown("dst_id") | ~F.coalesce("resolved", F.lit(False))).select(F.col("src_id").alias("node_id")).distinct()
    defs = nodes.where("kind <> 'file'").join(blind, "node_id", "left_semi").select("node_id", "file_path")
    suspects = anchors.join(defs, "file_path").select("finding_id", "node_id").distinct()
    asked = suspects.join(evidence.where(F.col("reachable") == UNREACHABLE), "finding_id", "left_semi")
    traced = trace(asked.select(F.col("node_id").alias("finding_id"), "node_id").distinct(), edges, entry_points).where(F.col("reachable") != UNREACHABLE)
    best = (
        asked.join(traced.select(F.col("finding_id").alias("node_id"), "path", "blast_radius"), "node_id")
        .groupBy("finding_id")
        .agg(F.min(F.struct(F.size("path").alias("n"), "path", "blast_radius")).alias("b"))
    )
    return evidence.join(best, "finding_id", "left").select(
        "finding_id",
        F.when(F.col("b").isNotNull(), UNKNOWN).otherwise(F.col("reachable")).alias("reachable"),
        F.coalesce("b.path", "path").alias("path"),
        F.coalesce("b.blast_radius", "blast_radius").alias("blast_radius"),
    )


#: Worst first.
SEVERITIES = ("critical", "high", "medium", "low", "info")
VERDICTS = {"real": 3, "needs_review": 2, "unreachable": 1}


def rank_keys(severity_mode: str = "raw") -> list:
    """Sort keys of findings, best first. ``raw`` takes the scanner's own severity word, ``normalized`` the common one."""
    verdict = F.lit(0)
    for name, rank in VERDICTS.items():
        verdict = F.when(F.col("verdict") == name, rank).otherwise(verdict)
    severity = S.rank_of("raw_severity" if severity_mode == "raw" else "severity", SEVERITIES)
    return [
        F.desc(reach_rank(F.col("reachable"))),
        F.desc(verdict),
        F.desc(F.coalesce("confidence", F.lit(0.0))),
        F.desc(F.coalesce("blast_radius", F.lit(0))),
        F.desc(severity),
    ]


def rank_findings(findings: DataFrame, order: str = "ordinal", severity_mode: str = "raw", limit: int = 0) -> DataFrame:
    """Findings, most urgent first; equal ones in the order of ``order``. ``limit`` 0 keeps all. Nothing is filtered."""
    ranked = findings.orderBy(*rank_keys(severity_mode), F.asc(order))
    return ranked.limit(limit) if limit else ranked


def worst_by(rows: DataFrame, key: str) -> DataFrame:
    """``(key, n_findings, worst)``: how bad the worst finding of each key is."""
    return rows.groupBy(key).agg(F.count("*").alias("n_findings"), F.max_by("reachable", reach_rank(F.col("reachable"))).alias("worst"))


def numbered(findings: DataFrame, key: str, severity_mode: str = "raw") -> DataFrame:
    """``position`` of each finding within ``key``."""
    w = Window.partitionBy(key).orderBy(*rank_keys(severity_mode), F.asc("ordinal"))
    return findings.withColumn("position", F.row_number().over(w))
