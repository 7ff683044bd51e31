"""Registered queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.core import cut, table
from tracelake.llm import broken, encode, leaks, pairs, secrets, spam, survivors


def _three(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(table(spark, sf_dir, t) for t in ("duplicate_groups", "raw_findings", "scanner_trust"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_credentials(table(spark, sf_dir, "source_files")).select("file_id", "line").distinct()


def p2_reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credentials by rule, with whether a scanner reported them."""
    found = secrets.find_credentials(table(spark, sf_dir, "source_files"))
    told = secrets.reported_state(found, table(spark, sf_dir, "raw_findings"))
    return told.select("file_id", "line", "rule", "reported").distinct()


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.redacted_files(table(spark, sf_dir, "source_files"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.survivors(*_three(spark, sf_dir))


def p3_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by truth discovery with freely estimated reliabilities."""
    said = survivors.claims(survivors.group_members(*_three(spark, sf_dir)))
    return survivors.discover_truth(said).values.select("group_id", "field", "value", F.round("support", 6).alias("support"))


def p3_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = survivors.claims(survivors.group_members(*_three(spark, sf_dir)))
    return survivors.discover_truth(said).weights.select(F.col("voter").alias("source"), F.round("reliability", 6).alias("reliability"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broken.invalid_files(table(spark, sf_dir, "source_files"))


def p4_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All errors of each invalid file, first cause included."""
    return broken.parse_files(table(spark, sf_dir, "source_files")).where("n_errors > 0").select("file_id", "language", "n_errors", "first_line", "first_error")


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broken.acceptance(table(spark, sf_dir, "source_files"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.documented_functions(pairs.token_rows(table(spark, sf_dir, "source_files"))).select("file_id", "qualified_name", "start_line").distinct()


def p6_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Function, documentation, and the comment right above it, if there is one."""
    tokens = cut(pairs.token_rows(table(spark, sf_dir, "source_files")))
    return pairs.documented_functions(tokens).join(pairs.leading_comments(tokens), ["file_id", "name", "start_line"], "left")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode_documents(table(spark, sf_dir, "documents"), encode.tokenizer_body())


def p8_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.round_trips(table(spark, sf_dir, "documents"), encode.tokenizer_body())


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p9_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks with their longest verbatim match and longest passage in words."""
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the documents that remain when those with a leak are removed."""
    return table(spark, sf_dir, "documents").select("doc_id").join(p9_found(spark, sf_dir), "doc_id", "left_anti")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.find_spam(table(spark, sf_dir, "documents")).select("doc_id").distinct()


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and robust distance of every document that is not blank, and the spam share of candidates."""
    return spam.score(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_reported, p2_redacted, p3_found, p3_truth, p3_reliability, p4_found, p4_errors, p4_rates, p6_found, p6_pairs, p8_ids, p8_round_trip, p9_found, p9_matches, p9_clean, p10_found, p10_scores)}

_MEMBERS = """f AS (SELECT DISTINCT ON (finding_id) finding_id, lower(trim(source)) AS source, reported_at, severity, confidence, cwe, fixed_in FROM raw_findings ORDER BY finding_id, reported_at DESC NULLS LAST),
m AS (SELECT DISTINCT group_id, unnest(members) AS finding_id FROM duplicate_groups),
v AS (SELECT m.group_id, f.finding_id, coalesce(f.source, '') AS source, coalesce(t.trust, 0) AS trust, coalesce(f.reported_at, TIMESTAMP '0001-01-01') AS reported_at,
    CASE WHEN lower(trim(f.severity)) IN ('low', 'medium', 'high', 'critical') THEN lower(trim(f.severity)) END AS severity,
    CASE WHEN lower(trim(f.confidence)) IN ('low', 'medium', 'high') THEN lower(trim(f.confidence)) END AS confidence,
    CASE WHEN try_cast(regexp_extract(trim(f.cwe), '^(?:cwe-)?([0-9]+)', 1, 'i') AS BIGINT) > 0
      THEN 'CWE-' || try_cast(regexp_extract(trim(f.cwe), '^(?:cwe-)?([0-9]+)', 1, 'i') AS BIGINT) END AS cwe,
    CASE WHEN regexp_matches(trim(f.fixed_in), '^[0-9]') THEN trim(f.fixed_in) END AS fixed_in
  FROM m JOIN f USING (finding_id) LEFT JOIN scanner_trust t ON t.source = f.source)"""
_TRUTH = f"""WITH RECURSIVE {_MEMBERS},
votes AS MATERIALIZED (SELECT group_id, field, value, source, count(*) AS n FROM (SELECT group_id, source, unnest(['severity', 'confidence', 'cwe', 'fixed_in']) AS field, unnest([severity, confidence, cwe, fixed_in]) AS value FROM v)
  WHERE value IS NOT NULL GROUP BY ALL),
w AS (SELECT 0 AS k, source, CAST(0.8 AS DOUBLE) AS rel, CAST(1 AS DOUBLE) AS moved FROM (SELECT DISTINCT source FROM votes)
  UNION ALL SELECT k, source, r, max(abs(r - old)) OVER () FROM (SELECT k + 1 AS k, source, sum(n * sup) / sum(n) AS r, any_value(rel) AS old
    FROM (SELECT w.k, w.source, w.rel, v.n, sum(v.n * w.rel) OVER (PARTITION BY v.group_id, v.field, v.value) / sum(v.n * w.rel) OVER (PARTITION BY v.group_id, v.field) AS sup
      FROM votes v JOIN w ON w.source = v.source WHERE w.moved > 0.001 AND w.k < 100) GROUP BY 1, 2)),
final AS MATERIALIZED (SELECT source, rel FROM w WHERE k = (SELECT max(k) FROM w))"""

SQL = {
    "p3_found": f"""WITH {_MEMBERS}
SELECT group_id,
  coalesce(max(struct_pack(t := trust, r := reported_at, i := finding_id, x := severity)) FILTER (WHERE severity IS NOT NULL).x, '') AS severity,
  coalesce(max(struct_pack(t := trust, r := reported_at, i := finding_id, x := confidence)) FILTER (WHERE confidence IS NOT NULL).x, '') AS confidence,
  coalesce(max(struct_pack(t := trust, r := reported_at, i := finding_id, x := cwe)) FILTER (WHERE cwe IS NOT NULL).x, '') AS cwe,
  coalesce(max(struct_pack(t := trust, r := reported_at, i := finding_id, x := fixed_in)) FILTER (WHERE fixed_in IS NOT NULL).x, '') AS fixed_in
FROM v GROUP BY group_id HAVING count(*) >= 2""",
    "p3_truth": _TRUTH + """
SELECT group_id, field, max(struct_pack(s := round(support, 9), v := value)).v AS value, round(max(struct_pack(s := round(support, 9), v := value)).s, 6) AS support
FROM (SELECT DISTINCT v.group_id, v.field, v.value, sum(v.n * w.rel) OVER (PARTITION BY v.group_id, v.field, v.value) / sum(v.n * w.rel) OVER (PARTITION BY v.group_id, v.field) AS support FROM votes v JOIN final w USING (source)) GROUP BY 1, 2""",
    "p3_reliability": _TRUTH + " SELECT source, round(rel, 6) AS reliability FROM final",
}
