"""From a folder of source files and saved scanner reports to ranked findings: the operators put together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.core import cut
from tracelake.functions import scalar as S
from tracelake.operators import deps, extract, locate, reach, report, resolve
from tracelake.operators import graph as G
from tracelake.sources import files as source_files
from tracelake.sources import reports


def index(files: DataFrame, root: str | None = None) -> dict[str, DataFrame]:
    """Nodes, edges, references, entry points and a ``summary`` row of ``files(rel_path, content)``.

    The summary counts files, classes, functions, lines, entry points, imports that are resolved and unknown, and call sites
    by what they lead to, with the share of those that are known.
    """
    files = cut(files.select("rel_path", "content"))
    facts = cut(extract.source_facts(files))
    nodes = cut(extract.file_nodes(files).unionByName(extract.def_nodes(facts)))
    targets = cut(resolve.import_targets(facts, files, root))
    sites = resolve.resolve_sites(facts, files, root)
    calls = cut(resolve.call_edges(sites, nodes))
    edges = cut(
        resolve.defines_edges(nodes).unionByName(resolve.import_edges(targets)).unionByName(calls.where("dst_id is not null").drop("class")).unionByName(resolve.inherits_edges(sites, facts))
    )
    entries = cut(resolve.entry_points(facts, nodes, sites))
    kinds = nodes.agg(*(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("file", "class", "function")), F.coalesce(F.sum(F.when(F.col("kind") == "file", F.col("end_line"))), F.lit(0)).alias("loc"))
    imports = edges.where("kind = 'imports'").agg(F.count_if("resolved").alias("imports_resolved"), F.count_if(~F.col("resolved")).alias("imports_unknown"))
    one = kinds.withColumn("k", F.lit(1)).join(imports.withColumn("k", F.lit(1)), "k")  # one row each
    one = one.join(resolve.coverage(calls).withColumn("k", F.lit(1)), "k").join(entries.agg(F.count("*").alias("entry_points")).withColumn("k", F.lit(1)), "k").drop("k")
    return {"nodes": nodes, "edges": edges, "refs": resolve.external_refs(targets), "call_refs": resolve.site_refs(sites, nodes), "entry_points": entries, "summary": one, "files": files}


def findings(raw: DataFrame, graph: dict[str, DataFrame], dists: DataFrame | None = None) -> dict[str, DataFrame]:
    """Raw findings (``reports.ingest``) at their places in an ``index``: ``findings`` with identity, node, class, path and radius,
    most urgent first; ``groups`` of duplicates; ``mapping`` counters. ``dists`` as from ``sources.files.distributions``."""
    nodes, edges, entries = graph["nodes"], graph["edges"], graph["entry_points"]
    rows = cut(raw.withColumn("scan_ordinal", F.monotonically_increasing_id()))
    sites = rows.where("package is null").select(F.col("scan_ordinal").alias("site_id"), F.col("rel_path").alias("file_path"), "line")
    at = locate.innermost(sites, nodes.where("kind <> 'file'"), last=True)
    file_node = nodes.where("kind = 'file'").select("file_path", F.col("node_id").alias("file_node"))
    at = at.join(file_node, "file_path", "left").select(F.col("site_id").alias("scan_ordinal"), F.coalesce("node_id", "file_node").alias("node_id"))
    found = rows.join(at, "scan_ordinal", "left").join(nodes.select("node_id", F.col("kind").alias("node_kind"), F.col("source_hash")), "node_id", "left")
    text = graph["files"].select("rel_path", "content")
    found = found.join(text, "rel_path", "left").withColumn("line_text", locate.line_text(F.coalesce("content", F.lit("")), F.col("line"))).drop("content")
    found = cut(locate.finding_ids(found))
    spark = raw.sparkSession
    names = deps.import_names(dists) if dists is not None else spark.createDataFrame([], "dist string, import_name string")
    above = G.required_by(deps.requirements(dists), rows.where("package is not null").select(S.canonical_name("package").alias("name")).distinct()) if dists is not None else None
    packages = found.where("package is not null").select("finding_id", "package").distinct()
    users = graph["refs"].select("node_id", "package").unionByName(graph["call_refs"].select("node_id", "package")).distinct()
    anchors = cut(deps.package_anchors(packages, names, users, above))
    where = anchors.select("finding_id", F.explode_outer("anchors").alias("node_id"))
    targets = found.where("package is null").select("finding_id", "node_id").unionByName(where).distinct()
    first = cut(reach.trace(targets, edges, entries))
    used = where.where("node_id is not null").select("finding_id", F.substring_index("node_id", "::", 1).alias("file_path")).distinct()
    evidence = reach.import_in_use(first, used, edges, nodes, entries)
    judged = found.join(evidence, "finding_id").join(anchors, "finding_id", "left").withColumn("verdict", F.lit(None).cast("string"))
    judged = judged.withColumn("confidence", F.lit(None).cast("double")).withColumnRenamed("scan_ordinal", "ordinal")
    ranked = reach.rank_findings(judged, "ordinal")
    python = F.col("rel_path").rlike(r"(?i)\.py[wi]?$")
    n = F.coalesce(F.size("anchors"), F.lit(0))
    status = locate.mapping_status(F.col("package"), n, F.coalesce(F.size("via"), F.lit(0)), F.col("node_kind"), python, F.lit(dists is not None))
    return {"findings": ranked, "groups": locate.duplicate_groups(found), "mapping": locate.mapping_stats(judged.select(status.alias("status"))), "evidence": evidence}


def scan(spark: SparkSession, root: str, saved: dict[str, str], site_packages: str | None = None) -> dict[str, DataFrame]:
    """Tables of a folder and its saved reports (``{"bandit": path, ...}``), ready to be written one by one."""
    graph = index(source_files.discover(spark, root))
    raw = reports.ingest({s: reports.read_reports(spark, p) for s, p in saved.items()}, root)
    dists = source_files.distributions(spark, site_packages) if site_packages else None
    out = findings(raw, graph, dists)
    parts = report.build_report(out["findings"], graph["nodes"], graph["edges"], graph["entry_points"], graph["summary"])
    return {**out, "nodes": graph["nodes"], "edges": graph["edges"], "entry_points": graph["entry_points"], "refs": graph["refs"], "summary": graph["summary"], "report_findings": parts["findings"], "report_nodes": parts["nodes"]}
