"""The code graph of the whole ``nodes``, ``edges`` and ``raw_findings`` tables, and the same in SQL.

Ids are scoped by repository, as names repeat between repositories. Entry points are what SQL can tell from these tables:
functions that no resolved call leads to, so that only the outside can call them; those at the top of a module take
untrusted input. Each function here has its twin in ``CTE``, so that queries over the graph can be checked against SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.core import table
from tracelake.functions import scalar as S
from tracelake.operators import graph as G
from tracelake.operators import locate


def raw_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["repo", "node_id", "kind", "qualified_name", "file_path", "start_line", "end_line", "source_hash", "ordinal"]
    return table(spark, sf_dir, "nodes").select(*cols).distinct()


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "edges")
    return e.select("repo", "src_id", "dst_id", F.lower(F.trim("kind")).alias("kind"), "resolved", "ordinal")


def raw_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each finding once, as it was delivered last, spelling put in order."""
    rows = table(spark, sf_dir, "raw_findings")
    rest = [c for c in rows.columns if c not in ("finding_id", "reported_at")]
    f = rows.where("finding_id is not null").groupBy("finding_id").agg(F.max(F.struct("reported_at", *rest)).alias("f")).select("finding_id", "f.*")
    return f.select(
        "finding_id", "repo", F.coalesce(F.lower(F.trim("source")), F.lit("unknown")).alias("source"), "rule_id", "rel_path", "line", "raw_severity", "severity", S.cwe("cwe").alias("cwe"), "message",
        "package", "package_version", "fixed_in", "aliases", "scan_ordinal",
    )


def scoped(c: str) -> F.Column:
    """An id within its repository; what is unknown stays marked as such."""
    return F.when(G.unknown(c), F.concat(F.lit(G.UNKNOWN), "repo", F.lit("/"), F.substr(c, F.lit(len(G.UNKNOWN) + 1)))).otherwise(F.concat("repo", F.lit("/"), c))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = raw_nodes(spark, sf_dir).where("repo is not null and node_id is not null")
    return n.select(scoped("node_id").alias("node_id"), "kind", "qualified_name", F.concat_ws("/", "repo", "file_path").alias("file_path"), "start_line", "end_line", "ordinal").distinct()


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bag of edges ``(src_id, dst_id, kind, resolved, ordinal)`` with both ends."""
    e = raw_edges(spark, sf_dir).select("repo", scoped("src_id").alias("src_id"), scoped("dst_id").alias("dst_id"), "kind", F.coalesce("resolved", F.lit(False)).alias("resolved"), "ordinal")
    return e.dropna(subset=["src_id", "dst_id"]).drop("repo")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).where("kind = 'calls'")


def entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(node_id, kind, trust)`` of the functions that no resolved call leads to."""
    functions = nodes(spark, sf_dir).where("kind = 'function'").groupBy("node_id").agg(F.min("qualified_name").alias("q"))
    called = calls(spark, sf_dir).where("resolved").select(F.col("dst_id").alias("node_id")).distinct()
    roots = functions.join(called, "node_id", "left_anti")
    return roots.select("node_id", F.lit("uncalled").alias("kind"), F.when(F.instr("q", ".") > 0, "internal").otherwise("untrusted").alias("trust"))


def finding_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings at the innermost definition of their file; the file's node where none holds the line."""
    n = raw_nodes(spark, sf_dir).withColumn("file_path", F.concat_ws("/", "repo", "file_path"))
    sites = raw_findings(spark, sf_dir).where("package is null").select(F.col("finding_id").alias("site_id"), F.concat_ws("/", "repo", "rel_path").alias("file_path"), "line")
    found = locate.innermost(sites, n.where("kind <> 'file'"), last=True)
    files = n.where("kind = 'file'").groupBy("file_path").agg(F.min("node_id").alias("file_node"))
    return found.join(files, "file_path", "left").select(F.col("site_id").alias("finding_id"), F.coalesce("node_id", "file_node").alias("node_id"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding with the node it is at, null where the code has no place for it."""
    f = raw_findings(spark, sf_dir).join(finding_nodes(spark, sf_dir), "finding_id", "left")
    return f.select(
        F.col("finding_id").cast("string").alias("finding_id"), "repo", scoped("node_id").alias("node_id"), F.concat_ws("/", "repo", "rel_path").alias("file_path"), "source", "rule_id", "cwe", "line",
        "package", "package_version", F.upper(F.trim("raw_severity")).alias("raw_severity"), "severity", F.col("scan_ordinal").alias("ordinal"),
    )


#: The same in DuckDB.
RAW_FINDINGS = """f AS (SELECT DISTINCT ON (finding_id) finding_id, repo, coalesce(lower(trim(source)), 'unknown') AS source, rule_id, rel_path, line, raw_severity, severity,
  CASE WHEN try_cast(regexp_extract(trim(cwe), '^(?:CWE-)?0*([0-9]+)', 1, 'i') AS BIGINT) > 0 THEN 'CWE-' || regexp_extract(trim(cwe), '^(?:CWE-)?0*([0-9]+)', 1, 'i') END AS cwe,
  message, package, package_version, fixed_in, aliases, scan_ordinal FROM raw_findings ORDER BY finding_id, reported_at DESC NULLS LAST)"""
RAW_NODES = "n AS (SELECT DISTINCT repo, node_id, kind, qualified_name, file_path, start_line, end_line, source_hash, ordinal FROM nodes)"
LOCATED = """located AS MATERIALIZED (SELECT f.finding_id, f.rel_path, coalesce(
    (SELECT arg_max(n.node_id, struct_pack(s := n.start_line, o := n.ordinal)) FROM n WHERE n.kind <> 'file' AND n.repo = f.repo AND n.file_path = f.rel_path AND f.line BETWEEN n.start_line AND n.end_line),
    (SELECT min(n.node_id) FROM n WHERE n.kind = 'file' AND n.repo = f.repo AND n.file_path = f.rel_path)) AS node_id FROM f WHERE package IS NULL)"""


def _scoped(c: str) -> str:
    return f"CASE WHEN starts_with({c}, 'unknown::') THEN 'unknown::' || repo || '/' || substr({c}, 10) ELSE repo || '/' || {c} END"


CTE = f"""
{RAW_NODES}, {RAW_FINDINGS}, {LOCATED},
defs AS MATERIALIZED (SELECT DISTINCT {_scoped("node_id")} AS node_id, kind, qualified_name, repo || '/' || file_path AS file_path, start_line, end_line, ordinal FROM n WHERE repo IS NOT NULL AND node_id IS NOT NULL),
links AS MATERIALIZED (SELECT {_scoped("src_id")} AS src_id, {_scoped("dst_id")} AS dst_id, lower(trim(kind)) AS kind, coalesce(resolved, FALSE) AS resolved, ordinal FROM edges
  WHERE repo IS NOT NULL AND src_id IS NOT NULL AND dst_id IS NOT NULL),
calls AS MATERIALIZED (SELECT * FROM links WHERE kind = 'calls'),
graph AS MATERIALIZED (SELECT src_id, dst_id, bool_or(resolved AND NOT starts_with(src_id, 'unknown::') AND NOT starts_with(dst_id, 'unknown::')) AS resolved FROM links GROUP BY 1, 2),
ends AS MATERIALIZED (SELECT src_id AS node_id FROM graph UNION SELECT dst_id FROM graph),
entry_points AS MATERIALIZED (SELECT node_id, 'uncalled' AS kind, CASE WHEN contains(min(qualified_name), '.') THEN 'internal' ELSE 'untrusted' END AS trust FROM defs
  WHERE kind = 'function' AND node_id NOT IN (SELECT dst_id FROM calls WHERE resolved) GROUP BY 1),
untrusted AS MATERIALIZED (SELECT node_id FROM entry_points WHERE trust = 'untrusted'),
findings AS MATERIALIZED (SELECT CAST(f.finding_id AS VARCHAR) AS finding_id, repo, {_scoped("l.node_id")} AS node_id, concat_ws('/', repo, f.rel_path) AS file_path, source, rule_id, cwe, line, package, package_version,
    upper(trim(raw_severity)) AS raw_severity, severity, scan_ordinal AS ordinal FROM f LEFT JOIN located l ON l.finding_id = f.finding_id)"""


def _search(name: str, where: str) -> str:
    """Recursive CTEs ``<name>_depth(node, depth)`` and ``<name>(node, depth, path)`` of least shortest paths.

    A walk that is longer than there are nodes has gone in circles.
    """
    return f"""
{name}_walk AS (SELECT node_id AS node, 0 AS depth FROM untrusted
  UNION SELECT g.dst_id, w.depth + 1 FROM {name}_walk w JOIN graph g ON g.src_id = w.node WHERE {where} AND w.depth < (SELECT count(*) FROM ends)),
{name}_depth AS MATERIALIZED (SELECT node, min(depth) AS depth FROM {name}_walk GROUP BY 1),
{name}_step AS MATERIALIZED (SELECT a.node AS src, b.node AS dst, b.depth FROM graph g JOIN {name}_depth a ON a.node = g.src_id JOIN {name}_depth b ON b.node = g.dst_id AND b.depth = a.depth + 1 WHERE {where}),
{name} AS (SELECT node, 0 AS depth, node AS path FROM {name}_depth WHERE depth = 0
  UNION ALL SELECT s.dst, s.depth, min(p.path || ' > ' || s.dst) FROM {name} p JOIN {name}_step s ON s.src = p.node AND s.depth = p.depth + 1 GROUP BY 1, 2)"""


GOOD = _search("good", "g.resolved")
FAR = _search("far", "TRUE")
PAIRS = """
pairs AS (SELECT node_id AS seed, node_id AS node FROM untrusted UNION SELECT p.seed, g.dst_id FROM pairs p JOIN graph g ON g.src_id = p.node),
blast AS MATERIALIZED (SELECT node, count(*) AS n FROM pairs GROUP BY 1)"""
EVIDENCE = """
evidence AS MATERIALIZED (SELECT f.finding_id,
    CASE WHEN k.node_id IS NULL THEN 'unknown' WHEN u.node_id IS NOT NULL THEN 'reachable' WHEN g.node IS NOT NULL THEN 'reachable' WHEN r.node IS NOT NULL THEN 'unknown' ELSE 'unreachable' END AS reachable,
    CASE WHEN k.node_id IS NULL THEN '' WHEN u.node_id IS NOT NULL THEN f.node_id ELSE coalesce(g.path, r.path, '') END AS path,
    CASE WHEN k.node_id IS NULL THEN 0 WHEN u.node_id IS NOT NULL THEN 1 ELSE coalesce(b.n, 0) END AS blast_radius
  FROM findings f LEFT JOIN ends k ON k.node_id = f.node_id LEFT JOIN untrusted u ON u.node_id = f.node_id LEFT JOIN good g ON g.node = f.node_id LEFT JOIN far r ON r.node = f.node_id LEFT JOIN blast b ON b.node = f.node_id)"""


def sql(select: str, *more: str) -> str:
    return "WITH RECURSIVE " + ",".join([CTE, *more]) + "\n" + select
