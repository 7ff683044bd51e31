"""Queries over nested records, snapshots and hierarchies, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.core import table
from tracelake.operators import hierarchy as hier
from tracelake.operators import nested, snapshots


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.flatten_reports(table(spark, sf_dir, "osv_reports"))


def p1_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups with their package by interval containment."""
    reports = nested.latest(table(spark, sf_dir, "osv_reports"), "report_id", "loaded_at", "report")
    nodes = nested.label_documents(reports)
    linked = nested.with_enclosing(nodes, ("package",), values=True).where("entity = 'group' and package_no >= 0")
    return linked.select(F.col("doc_id").alias("report_id"), "pre", "post", F.col("value").alias("max_severity"), F.col("package_value").alias("package"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.snapshot_changes(table(spark, sf_dir, "node_snapshots")).select("repo", "snapshot_no", "file_path", "qualified_name", "change_kind")


def _defines(spark: SparkSession, sf_dir: str, paths: bool = False) -> DataFrame:
    return hier.hierarchy(hier.define_links(table(spark, sf_dir, "edges")), paths=paths)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _defines(spark, sf_dir).select(
        F.col("scope").alias("repo"), F.col("node").alias("node_id"), F.col("root").alias("root_id"), "depth", "n_descendants"
    )


def p7_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full paths of all ids that lie neither on a loop nor under one."""
    nodes = _defines(spark, sf_dir, paths=True).where(F.col("path").isNotNull())
    path = F.array_join(F.concat("path", F.array("node")), " > ")
    return nodes.select(F.col("scope").alias("repo"), F.col("node").alias("node_id"), path.alias("path"))


def p7_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hier.descendants(_defines(spark, sf_dir, paths=True)).select(
        F.col("scope").alias("repo"), F.col("node").alias("node_id"), F.col("descendant").alias("descendant_id"), "distance"
    )


QUERIES = {f.__name__: f for f in (p1_found, p1_linked, p5_found, p7_found, p7_paths, p7_descendants)}

_LINKS = """links AS MATERIALIZED (SELECT DISTINCT repo, src_id AS p, dst_id AS c FROM edges
  WHERE lower(trim(kind)) = 'defines' AND repo IS NOT NULL AND src_id IS NOT NULL AND dst_id IS NOT NULL),
reach AS (SELECT repo, p AS a, c AS b FROM links UNION SELECT r.repo, r.a, l.c FROM reach r JOIN links l ON l.repo = r.repo AND l.p = r.b),
ids AS (SELECT repo, p AS x FROM links UNION SELECT repo, c FROM links),
looped AS (SELECT DISTINCT repo, a AS x FROM reach WHERE a = b),
bad AS (SELECT repo, x FROM looped UNION SELECT r.repo, r.b FROM reach r JOIN looped l ON l.repo = r.repo AND l.x = r.a)"""

SQL = {
    "p5_found": """
WITH s AS (SELECT repo, snapshot_no, file_path, qualified_name,
    max(struct_pack(v := coalesce(loaded_at, TIMESTAMP '0001-01-01'), h := coalesce(regexp_replace(lower(trim(source_hash)), '^(?:sha-?\\d+\\s*[:=\\-]|0x)\\s*', ''), ''))).h AS h
  FROM node_snapshots WHERE repo IS NOT NULL AND snapshot_no IS NOT NULL GROUP BY ALL),
d AS (SELECT repo, snapshot_no, lead(snapshot_no) OVER (PARTITION BY repo ORDER BY snapshot_no) AS nxt
  FROM (SELECT DISTINCT repo, snapshot_no FROM s)),
pairs AS (SELECT * FROM d WHERE nxt IS NOT NULL),
old AS (SELECT p.repo, p.nxt AS snapshot_no, s.file_path, s.qualified_name, s.h FROM s JOIN pairs p ON p.repo = s.repo AND p.snapshot_no = s.snapshot_no),
new AS (SELECT s.* FROM s JOIN pairs p ON p.repo = s.repo AND p.nxt = s.snapshot_no)
SELECT coalesce(n.repo, o.repo) AS repo, coalesce(n.snapshot_no, o.snapshot_no) AS snapshot_no,
  coalesce(n.file_path, o.file_path) AS file_path, coalesce(n.qualified_name, o.qualified_name) AS qualified_name,
  CASE WHEN o.repo IS NULL THEN 'added' WHEN n.repo IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM new n FULL JOIN old o ON o.repo = n.repo AND o.snapshot_no = n.snapshot_no
  AND o.file_path IS NOT DISTINCT FROM n.file_path AND o.qualified_name IS NOT DISTINCT FROM n.qualified_name
WHERE o.repo IS NULL OR n.repo IS NULL OR o.h <> n.h""",
    "p7_found": f"""
WITH RECURSIVE {_LINKS},
n AS (SELECT repo, a AS x, count(DISTINCT b) FILTER (WHERE b <> a) AS n FROM reach GROUP BY 1, 2),
up AS (SELECT repo, b AS x, count(DISTINCT a) AS depth, min(a) FILTER (WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.repo = reach.repo AND l.c = reach.a)) AS root
  FROM reach GROUP BY 1, 2)
SELECT i.repo, i.x AS node_id,
  CASE WHEN b.x IS NOT NULL THEN '' ELSE coalesce(u.root, i.x) END AS root_id,
  CAST(CASE WHEN b.x IS NOT NULL THEN -1 ELSE coalesce(u.depth, 0) END AS INTEGER) AS depth,
  CAST(coalesce(n.n, 0) AS INTEGER) AS n_descendants
FROM ids i LEFT JOIN bad b ON b.repo = i.repo AND b.x = i.x LEFT JOIN n ON n.repo = i.repo AND n.x = i.x
LEFT JOIN up u ON u.repo = i.repo AND u.x = i.x""",
    "p7_paths": f"""
WITH RECURSIVE {_LINKS},
walk AS (SELECT i.repo, i.x, i.x AS path FROM ids i WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.repo = i.repo AND l.c = i.x)
  UNION ALL SELECT w.repo, l.c, w.path || ' > ' || l.c FROM walk w JOIN links l ON l.repo = w.repo AND l.p = w.x
  WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.repo = l.repo AND b.x = l.c))
SELECT repo, x AS node_id, path FROM walk""",
    "p7_descendants": f"""
WITH RECURSIVE {_LINKS},
ok AS (SELECT l.* FROM links l WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.repo = l.repo AND b.x = l.c)),
walk AS (SELECT repo, p AS node_id, c AS descendant_id, 1 AS distance FROM ok
  UNION ALL SELECT w.repo, w.node_id, o.c, w.distance + 1 FROM walk w JOIN ok o ON o.repo = w.repo AND o.p = w.descendant_id)
SELECT * FROM walk""",
}
