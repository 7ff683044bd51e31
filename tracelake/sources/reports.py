"""Scanner reports to ``raw_findings`` rows. Schemas are given, never inferred: empty arrays would break inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import scalar as S

#: Columns of a raw finding.
RAW = (
    "source string, rule_id string, rel_path string, line int, end_line int, raw_severity string, severity string, confidence string, "
    "cwe string, message string, package string, package_version string, fixed_in string, aliases array<string>"
)
BANDIT = (
    "results array<struct<filename:string,line_number:int,line_range:array<int>,test_id:string,issue_severity:string,"
    "issue_confidence:string,issue_cwe:struct<id:string>,issue_text:string>>, errors array<struct<filename:string,reason:string>>"
)
SEMGREP = (
    "results array<struct<check_id:string,path:string,start:struct<line:int>,end:struct<line:int>,extra:struct<severity:string,"
    "message:string,metadata:struct<cwe:variant,confidence:string>>>>, errors array<struct<path:string,type:string,message:string>>"
)
GITLEAKS = "array<struct<File:string,RuleID:string,StartLine:int,EndLine:int,Description:string>>"
OSV = (
    "results array<struct<source:struct<path:string>,packages:array<struct<package:struct<name:string,version:string>,"
    "groups:array<struct<ids:array<string>,aliases:array<string>,max_severity:string>>,vulnerabilities:array<struct<id:string,summary:string,"
    "database_specific:struct<cwe_ids:array<string>>,affected:array<struct<package:struct<name:string>,ranges:array<struct<type:string,"
    "events:array<struct<introduced:string,fixed:string>>>>>>>>>>>>"
)
#: Folders that are never looked into.
SKIPPED = (".git", "__pycache__", "node_modules", ".venv", "venv", "env", "dist", "build", ".mypy_cache", ".ruff_cache", ".pytest_cache", ".tox", "site-packages", ".idea", ".vscode", ".eggs")


#: Parsers by source: reports and root folder to raw findings. Others can be added.
PARSERS: dict = {}


def register(source: str, parse) -> None:
    """Adds a scanner: ``parse(reports(path, body), root)`` gives rows with the columns of ``RAW``."""
    PARSERS[source] = parse


def ingest(found: dict[str, DataFrame], root: str) -> DataFrame:
    """Raw findings of several scanners' reports, in one table; a source without a parser is an error."""
    out = None
    for source in sorted(found):
        if source not in PARSERS:
            raise ValueError(f"no parser for {source!r}")
        rows = PARSERS[source](found[source], root)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no reports")
    return out


def check_rule_source(config: str) -> str:
    """Rules must be local files: registry names and addresses would be fetched at scan time."""
    if config == "auto" or config.startswith(("p/", "r/", "s/", "http://", "https://")):
        raise ValueError(f"rules must be local: {config}")
    return config


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """``(path, body)`` of report files, one text each."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def _row(df: DataFrame, **given: Column) -> DataFrame:
    kinds = dict(x.strip().split(" ", 1) for x in RAW.split(", "))
    return df.select(*(given.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()))


def skipped(path: Column | str) -> Column:
    """Whether a folder of the path is one that is never looked into; a file may have such a name."""
    folders = F.split(F.regexp_replace(F.col(path) if isinstance(path, str) else path, "/?[^/]*$", ""), "/")
    return F.arrays_overlap(folders, F.array(*(F.lit(x) for x in SKIPPED)))


def bandit(reports: DataFrame, root: str) -> DataFrame:
    """Findings of ``reports(body)``; those outside ``root`` are dropped, the end is the last line of the range."""
    r = reports.select(F.inline(F.from_json("body", BANDIT)["results"]))
    r = r.withColumn("rel", S.relative_path("filename", root)).where(F.col("rel").isNotNull())
    ends = F.coalesce(F.array_max("line_range"), F.col("line_number"))
    return _row(
        r,
        source=F.lit("bandit"),
        rule_id=F.col("test_id"),
        rel_path=F.col("rel"),
        line=F.col("line_number"),
        end_line=ends,
        raw_severity=F.col("issue_severity"),
        severity=S.severity_of_word("issue_severity"),
        confidence=F.lower("issue_confidence"),
        cwe=S.cwe("issue_cwe.id"),
        message=F.col("issue_text"),
        aliases=F.array().cast("array<string>"),
    )


def strip_prefix(rule: Column, prefixes: list[str]) -> Column:
    """``rule`` without the longest of ``prefixes`` that it begins with."""
    out = rule
    for p in sorted(prefixes, key=len):
        out = F.when(F.startswith(rule, F.lit(p)), F.substr(rule, F.lit(len(p) + 1))).otherwise(out)
    return out


def semgrep(reports: DataFrame, root: str, prefixes: list[str] | None = None) -> DataFrame:
    """As ``bandit``; a CWE may be a text or a list, of which the first counts."""
    r = reports.select(F.inline(F.from_json("body", SEMGREP)["results"]))
    r = r.withColumn("rel", S.relative_path("path", root)).where(F.col("rel").isNotNull())
    weakness = F.coalesce(F.try_variant_get("extra.metadata.cwe", "$[0]", "string"), F.try_variant_get("extra.metadata.cwe", "$", "string"))
    return _row(
        r,
        source=F.lit("semgrep"),
        rule_id=strip_prefix(F.col("check_id"), prefixes or []),
        rel_path=F.col("rel"),
        line=F.col("start.line"),
        end_line=F.coalesce("end.line", "start.line"),
        raw_severity=F.col("extra.severity"),
        severity=S.severity_of_word("extra.severity"),
        confidence=F.lower("extra.metadata.confidence"),
        cwe=S.cwe(weakness),
        message=F.col("extra.message"),
        aliases=F.array().cast("array<string>"),
    )


def gitleaks(reports: DataFrame, root: str) -> DataFrame:
    """Credential findings; the fields that hold the secret itself are never read."""
    r = reports.select(F.explode(F.from_json("body", GITLEAKS)).alias("r")).select("r.*")
    r = r.withColumn("rel", S.relative_path("File", root)).where(F.col("rel").isNotNull() & (F.col("rel") != "") & ~skipped("rel"))
    return _row(
        r,
        source=F.lit("gitleaks"),
        rule_id=F.col("RuleID"),
        rel_path=F.col("rel"),
        line=F.col("StartLine"),
        end_line=F.coalesce("EndLine", "StartLine"),
        raw_severity=F.lit("HIGH"),
        severity=F.lit("high"),
        cwe=F.lit("CWE-798"),
        message=F.col("Description"),
        aliases=F.array().cast("array<string>"),
    )


def primary_id(ids: Column, aliases: Column) -> Column:
    """The first CVE of the sorted names, else the first GHSA, else the first name."""
    names = F.sort_array(F.array_union(F.coalesce(ids, F.array().cast("array<string>")), F.coalesce(aliases, F.array().cast("array<string>"))))
    names = F.filter(names, lambda x: x.isNotNull())
    cve = F.filter(names, lambda x: F.startswith(x, F.lit("CVE-")))
    ghsa = F.filter(names, lambda x: F.startswith(x, F.lit("GHSA-")))
    return F.coalesce(F.get(cve, F.lit(0)), F.get(ghsa, F.lit(0)), F.get(names, F.lit(0)), F.lit("OSV-UNKNOWN"))


def osv(reports: DataFrame) -> DataFrame:
    """Dependency findings: results, packages and groups flattened; of one advisory for a package version, the first.

    The fix is the greatest over the group's advisories of each one's least fixed version above the installed one.
    """
    r = reports.withColumn("report_no", F.monotonically_increasing_id()).select("report_no", F.posexplode(F.from_json("body", OSV)["results"]).alias("a", "result"))
    r = r.select("report_no", "a", F.col("result.source.path").alias("manifest"), F.posexplode("result.packages").alias("b", "p"))
    r = r.select("report_no", "a", "b", "manifest", "p", F.posexplode("p.groups").alias("c", "g"))
    names = F.array_union(F.coalesce("g.ids", F.array().cast("array<string>")), F.coalesce("g.aliases", F.array().cast("array<string>")))
    vulns = F.filter("p.vulnerabilities", lambda v: F.array_contains(F.coalesce("g.ids", F.array().cast("array<string>")), v["id"]))
    r = r.select(
        "report_no",
        "a",
        "b",
        "c",
        "manifest",
        F.col("p.package.name").alias("package"),
        F.col("p.package.version").alias("version"),
        F.col("g.max_severity").alias("score"),
        primary_id(F.col("g.ids"), F.col("g.aliases")).alias("primary"),
        F.sort_array(names).alias("aliases"),
        vulns.alias("vulns"),
    )
    first = r.groupBy(S.canonical_name("package").alias("_p"), "version", "primary").agg(
        F.min_by(F.struct("report_no", "a", "b", "c", "manifest", "package", "score", "aliases", "vulns"), F.struct("report_no", "a", "b", "c")).alias("f")
    )
    first = first.select("version", "primary", "f.*")
    events = F.expr(
        "flatten(flatten(transform(vulns, v -> transform(filter(v.affected, x -> lower(regexp_replace(x.package.name, '[-_.]+', '-')) = lower(regexp_replace(package, '[-_.]+', '-'))),"
        " x -> flatten(transform(filter(x.ranges, y -> y.type in ('ECOSYSTEM', 'SEMVER')), y -> transform(filter(y.events, e -> e.fixed is not null), e -> struct(v.id as id, e.fixed as fixed))))))))"
    )
    key = ["report_no", "a", "b", "c"]
    fixes = first.select(*key, "version", F.explode(events).alias("e")).select(*key, "version", "e.id", "e.fixed")
    fixes = fixes.withColumn("k", S.version_key("fixed")).withColumn("installed", S.version_key("version"))
    above = fixes.where(F.col("k").isNotNull() & (F.col("installed").isNull() | (F.col("k") > F.col("installed"))))
    least = above.groupBy(*key, "id").agg(F.min_by("fixed", "k").alias("fixed"), F.min("k").alias("k"))
    best = least.groupBy(*key).agg(F.max_by("fixed", "k").alias("fixed"))
    weak = F.get(F.filter("vulns", lambda v: F.size(v["database_specific"]["cwe_ids"]) > 0), F.lit(0))["database_specific"]["cwe_ids"]
    summary = F.get(F.filter(F.transform("vulns", lambda v: v["summary"]), lambda s: F.length(s) > 0), F.lit(0))
    out = first.join(best, key, "left")
    return _row(
        out,
        source=F.lit("osv"),
        rule_id=F.col("primary"),
        rel_path=F.col("manifest"),
        line=F.lit(0),
        end_line=F.lit(0),
        raw_severity=F.coalesce("score", F.lit("")),
        severity=S.severity_of_score("score"),
        cwe=S.cwe(F.get(weak, F.lit(0))),
        message=F.concat_ws(": ", F.concat_ws(" ", "package", "version"), summary),
        package=F.col("package"),
        package_version=F.col("version"),
        fixed_in=F.col("fixed"),
        aliases=F.col("aliases"),
    )


def scan_status(reports: DataFrame, source: str, schema: str, kind: str = "struct") -> DataFrame:
    """``(source, path, status, errors)``: a report that does not parse failed; nothing raises."""
    parsed = F.from_json("body", schema)
    empty = F.array().cast("array<string>")
    listed = {"bandit": ("filename", "reason"), "semgrep": ("path", "message")}.get(source)
    errors = F.transform(F.coalesce(parsed["errors"], F.array()), lambda e: F.concat_ws(": ", e[listed[0]], e[listed[1]])) if listed else empty
    good = F.try_parse_json("body").isNotNull()
    return reports.select(F.lit(source).alias("source"), "path", F.when(good, "ok").otherwise("failed").alias("status"), F.when(good, errors).otherwise(empty).alias("errors"))


_VERDICTS = ("real", "false_positive", "needs_review")


def parse_verdicts(replies: DataFrame, text: str = "reply") -> DataFrame:
    """``verdict``, ``confidence`` (0 to 1) and ``reasoning`` out of a model's free text, fenced or not, JSON or not."""
    raw = F.regexp_replace(F.trim(F.col(text)), r"(?s)^```(?:json)?\s*|\s*```$", "")
    j = F.try_parse_json(raw)
    found = F.coalesce(F.lower(F.try_variant_get(j, "$.verdict", "string")), F.lower(F.nullif(F.regexp_extract(raw, r'(?i)"?verdict"?\s*[:=]\s*"?([a-z_]+)', 1), F.lit(""))))
    sure = F.coalesce(F.try_variant_get(j, "$.confidence", "double"), F.regexp_extract(raw, r'(?i)"?confidence"?\s*[:=]\s*"?([0-9.]+)', 1).try_cast("double"), F.lit(0.5))
    why = F.coalesce(F.try_variant_get(j, "$.reasoning", "string"), F.lit(""))
    return replies.withColumn("verdict", F.when(found.isin(*_VERDICTS), found).otherwise("needs_review")).withColumn("confidence", S.clamp(sure)).withColumn("reasoning", why)


register("bandit", bandit)
register("semgrep", semgrep)
register("gitleaks", gitleaks)
register("osv", lambda reports, root: osv(reports))
