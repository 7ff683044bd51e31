"""Report documents: findings with their nodes, paths and code, as nested rows and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.operators import graph as G
from tracelake.operators.reach import reach_rank


def node_info(nodes: DataFrame) -> DataFrame:
    """``(node_id, info)``: what a report says of a node."""
    return nodes.select("node_id", F.struct("node_id", "kind", F.col("qualified_name").alias("name"), F.col("file_path").alias("file"), "start_line", "end_line").alias("info"))


def referenced_nodes(findings: DataFrame, callers: DataFrame, entry_points: DataFrame) -> DataFrame:
    """``(node_id)``: all nodes that a report mentions, each of which it must describe."""
    parts = [
        findings.select("node_id"),
        findings.select(F.explode("path").alias("node_id")),
        callers.select(F.explode("callers").alias("node_id")),
        entry_points.select("node_id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("node_id is not null and node_id <> ''").distinct()


def finding_entries(findings: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(finding_id, entry)``: each finding as one JSON object with its node and its callers."""
    callers = G.predecessors(edges, nodes)
    j = findings.join(node_info(nodes), "node_id", "left").join(callers, "node_id", "left")
    body = F.struct("finding_id", "source", "rule_id", "cwe", "raw_severity", "reachable", "path", "blast_radius", F.col("info").alias("node"), F.coalesce("callers", F.array().cast("array<string>")).alias("callers"))
    return j.select("finding_id", F.to_json(body).alias("entry"))


def search(rows: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows where ``text`` stands in one of the columns, whatever its case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(text.lower()))
    return rows.where(hit)


def findings_by_node(findings: DataFrame) -> DataFrame:
    """``(node_id, findings, worst)``: ids of each node's findings and the worst class among them."""
    return findings.groupBy("node_id").agg(
        F.sort_array(F.collect_list("finding_id")).alias("findings"), F.max_by("reachable", reach_rank(F.col("reachable"))).alias("worst")
    )


def graph_view(nodes: DataFrame, edges: DataFrame, findings: DataFrame, entry_points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a drawing of the graph needs: nodes with their findings and entry flag, unknown targets included; edges once each."""
    entry = entry_points.select("node_id").distinct().withColumn("is_entry", F.lit(True))
    own = nodes.select("node_id", "kind", F.col("qualified_name").alias("name"), F.col("file_path").alias("file"))
    lost = edges.where(G.unknown("dst_id")).select(F.col("dst_id").alias("node_id")).distinct().join(nodes.select("node_id"), "node_id", "left_anti")
    lost = lost.select("node_id", F.lit("unknown").alias("kind"), F.regexp_replace("node_id", "^unknown::", "").alias("name"), F.lit(None).cast("string").alias("file"))
    shown = own.unionByName(lost).join(findings_by_node(findings), "node_id", "left").join(entry, "node_id", "left").withColumn("is_entry", F.coalesce("is_entry", F.lit(False)))
    return shown, edges.groupBy("src_id", "dst_id", "kind").agg(F.max(F.coalesce("resolved", F.lit(False))).alias("resolved"))


def file_fold(nodes: DataFrame, edges: DataFrame, findings: DataFrame, entry_points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph by file: functions, entry flag, findings and worst class of each; links between files, "calls" if any is."""
    where = nodes.select("node_id", F.col("file_path").alias("file"))
    entry = entry_points.select("node_id").distinct().join(where, "node_id").select("file").distinct().withColumn("is_entry", F.lit(True))
    bad = findings.join(where, "node_id").groupBy("file").agg(F.count("*").alias("n_findings"), F.max_by("reachable", reach_rank(F.col("reachable"))).alias("worst"))
    size = nodes.groupBy(F.col("file_path").alias("file")).agg(F.count_if(F.col("kind") == "function").alias("n_functions"))
    shown = size.join(bad, "file", "left").join(entry, "file", "left").na.fill(0, ["n_findings"]).withColumn("is_entry", F.coalesce("is_entry", F.lit(False)))
    return shown, file_links(nodes, edges)


def file_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(src, dst, n, kind)`` between different files; the kind is "calls" if any of the links is one."""
    where = nodes.select("node_id", F.col("file_path").alias("file"))
    e = edges.where(F.col("kind").isin("calls", "imports", "inherits")).select("src_id", "dst_id", "kind").distinct()
    e = e.join(where.select(F.col("node_id").alias("src_id"), F.col("file").alias("src")), "src_id").join(where.select(F.col("node_id").alias("dst_id"), F.col("file").alias("dst")), "dst_id")
    return e.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"), F.when(F.max(F.col("kind") == "calls"), "calls").otherwise(F.min("kind")).alias("kind"))


def build_report(findings: DataFrame, nodes: DataFrame, edges: DataFrame, entry_points: DataFrame, summary: DataFrame) -> dict[str, DataFrame]:
    """The parts of a report as tables, each written on its own, so that no task holds the whole document.

    Every node that a finding, a path, a caller list or an entry point mentions is described.
    """
    callers = G.predecessors(edges, nodes)
    mentioned = referenced_nodes(findings, callers.join(findings.select("node_id"), "node_id", "left_semi"), entry_points)
    return {
        "summary": summary,
        "findings": finding_entries(findings, nodes, edges),
        "nodes": node_info(nodes).join(mentioned, "node_id", "left_semi"),
        "entry_points": entry_points,
    }
