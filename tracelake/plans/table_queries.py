"""Queries over the scanner, source and graph tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.core import table
from tracelake.functions import scalar as S
from tracelake.operators import deps, evaluate, extract, incremental, locate, nested, reach, report, resolve, triage
from tracelake.operators import graph as G
from tracelake.plans import graph_queries as GQ
from tracelake.plans import code_graph as P
from tracelake.sources import files as source_files
from tracelake.sources import reports
from tracelake.streaming import changes


def _files(spark, sf_dir) -> DataFrame:
    """Each file once: the delivery loaded last."""
    rows = table(spark, sf_dir, "source_files")
    best = F.max(F.struct("loaded_at", "content")).alias("b")
    return rows.groupBy("file_id", "repo", "rel_path").agg(best).select("file_id", "repo", "rel_path", F.col("b.content").alias("content"))


_nodes, _edges, _findings = P.raw_nodes, P.raw_edges, P.raw_findings
finding_nodes = P.finding_nodes


def source_inventory(spark, sf_dir) -> DataFrame:
    """Python files with hash and lines, as discovery gives them."""
    python = _files(spark, sf_dir).where(F.col("rel_path").rlike(r"\.pyi?w?$") & F.col("content").isNotNull())
    return source_files.inventory(python).select("file_id", "content_hash", "lines")


def copied_files(spark, sf_dir) -> DataFrame:
    """Files with one content under several names."""
    h = _files(spark, sf_dir).where(F.length("content") > 0).groupBy(S.content_hash("content").alias("h"))
    return h.agg(F.count("*").alias("n"), F.min("file_id").alias("first_id")).where("n > 1").select("h", "n", "first_id")


def severity_bands(spark, sf_dir) -> DataFrame:
    return _findings(spark, sf_dir).select("finding_id", S.severity_of_score("raw_severity").alias("band"), S.severity_of_word("raw_severity").alias("word"), S.cwe("cwe").alias("cwe"))


def primary_ids(spark, sf_dir) -> DataFrame:
    f = _findings(spark, sf_dir).where("aliases is not null")
    return f.select("finding_id", reports.primary_id(F.array("rule_id"), F.col("aliases")).alias("primary_id"), S.canonical_name("package").alias("package"))


def upgrade_to(spark, sf_dir) -> DataFrame:
    """Greatest fix by version order of each package."""
    f = _findings(spark, sf_dir).where(F.trim("fixed_in").rlike(r"^\d+(\.\d+)*$") & F.col("package").isNotNull())
    f = f.withColumn("fix", F.trim("fixed_in"))
    return f.groupBy("package").agg(F.max_by("fix", S.version_key("fix")).alias("upgrade_to"), F.count("*").alias("n"))


def finding_line_text(spark, sf_dir) -> DataFrame:
    f = _findings(spark, sf_dir).where("line > 0").select("finding_id", "repo", "rel_path", "line")
    src = _files(spark, sf_dir).select("repo", "rel_path", "content")
    return f.join(src, ["repo", "rel_path"]).select("finding_id", locate.line_text(F.col("content"), F.col("line")).alias("text"))


def node_snippets(spark, sf_dir) -> DataFrame:
    """Hash and size of the first sixty lines of each definition."""
    n = _nodes(spark, sf_dir).where("kind <> 'file'").select("repo", "node_id", F.col("file_path").alias("rel_path"), "start_line", "end_line").distinct()
    j = n.join(_files(spark, sf_dir).select("repo", "rel_path", "content"), ["repo", "rel_path"])
    text = locate.snippet(F.col("content"), F.col("start_line"), F.col("end_line"))
    return j.select("repo", "node_id", F.sha2(text, 256).alias("snippet_hash"), F.length(text).alias("n_chars"))


def mapping_stats(spark, sf_dir) -> DataFrame:
    """Findings by how they are placed; a dependency is anchored in files of its repository with an import from elsewhere."""
    kinds = _nodes(spark, sf_dir).select("repo", "node_id", "kind").distinct()
    users = _edges(spark, sf_dir).where("kind = 'imports' and not resolved and src_id is not null").groupBy("repo").agg(F.countDistinct("src_id").alias("anchors"))
    f = _findings(spark, sf_dir).join(finding_nodes(spark, sf_dir), "finding_id", "left").join(kinds, ["repo", "node_id"], "left").join(users, "repo", "left")
    status = locate.mapping_status(F.col("package"), F.coalesce("anchors", F.lit(0)), F.lit(0), F.col("kind"), F.col("rel_path").rlike(r"\.pyi?w?$"), F.lit(False))
    return locate.mapping_stats(f.select(status.alias("status")))


def scanner_groups(spark, sf_dir) -> DataFrame:
    """Findings about the same thing, per repository."""
    f = _findings(spark, sf_dir).withColumn("node_id", F.lit(None).cast("string")).withColumn("rel_path", F.concat_ws("/", "repo", "rel_path"))
    f = f.withColumn("package", F.concat_ws("/", F.when(F.col("package").isNotNull(), F.col("repo")), "package")).withColumn("package", F.nullif("package", F.lit("")))
    g = locate.duplicate_groups(f)
    return g.select("anchor", "weakness", "line", F.size("members").cast("bigint").alias("n"), F.col("members")[0].alias("first_id"))


def finding_identities(spark, sf_dir) -> DataFrame:
    f = _findings(spark, sf_dir).withColumn("source_hash", F.lit(None).cast("string")).withColumn("line_text", F.coalesce("message", F.lit(""))).withColumn("row_id", F.col("finding_id"))
    f = f.withColumn("rel_path", F.concat_ws("/", "repo", "rel_path"))
    return locate.finding_ids(f.withColumn("scan_ordinal", F.col("row_id"))).select("row_id", F.col("finding_id").alias("identity"))


def first_wins_dedupe(spark, sf_dir) -> DataFrame:
    """The first delivery of each dependency finding by package and rule."""
    f = _findings(spark, sf_dir).where("package is not null")
    return extract.first_wins(f, ["package", "rule_id"], ["scan_ordinal", "finding_id"]).select("package", "rule_id", "finding_id")


def finding_search(spark, sf_dir) -> DataFrame:
    return report.search(_findings(spark, sf_dir), "Session", ["rule_id", "rel_path", "cwe", "message", "package"]).select("finding_id")


def node_search(spark, sf_dir) -> DataFrame:
    """First eight nodes by name."""
    n = report.search(_nodes(spark, sf_dir), "session", ["qualified_name"])
    return n.select("repo", "node_id").distinct().orderBy("repo", "node_id").limit(8)


def index_summary(spark, sf_dir) -> DataFrame:
    n = _nodes(spark, sf_dir).select("repo", "node_id", "kind", "file_path", "start_line", "end_line").distinct()
    return n.groupBy("repo").agg(
        *(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("file", "class", "function")),
        F.sum(F.when(F.col("kind") == "file", F.col("end_line")).otherwise(0)).alias("loc"),
    )


def coverage_rates(spark, sf_dir) -> DataFrame:
    """Call edges per repository, how many are resolved, and their share (1.0 if there are none)."""
    e = _edges(spark, sf_dir).where("kind = 'calls'")
    good = F.count_if(F.coalesce("resolved", F.lit(False)))
    return e.groupBy("repo").agg(F.count("*").alias("total"), good.alias("resolved"), F.when(F.count("*") == 0, 1.0).otherwise(F.round(good / F.count("*"), 6)).alias("ratio"))


def unknown_hubs(spark, sf_dir) -> DataFrame:
    """Targets that no node has, with their callers; counted before any join, as a few hubs hold most edges."""
    e = _edges(spark, sf_dir).where("src_id is not null and dst_id is not null").groupBy("repo", "dst_id").agg(F.countDistinct("src_id").alias("callers"), F.count("*").alias("edges"))
    n = _nodes(spark, sf_dir).select("repo", F.col("node_id").alias("dst_id")).distinct()
    return e.join(n, ["repo", "dst_id"], "left_anti")


def repo_callers(spark, sf_dir) -> DataFrame:
    e = _edges(spark, sf_dir).where("kind = 'calls'").select("repo", "src_id", "dst_id").dropna().distinct()
    n = _nodes(spark, sf_dir).select("repo", "node_id").distinct()
    known = e.join(n.withColumnRenamed("node_id", "src_id"), ["repo", "src_id"], "left_semi")
    return known.groupBy("repo", F.col("dst_id").alias("node_id")).agg(F.count("*").alias("n"), F.min("src_id").alias("first_caller"))


def defines_parent(spark, sf_dir) -> DataFrame:
    """Parents of definitions by name prefix and span; the file's node where no definition encloses."""
    n = _nodes(spark, sf_dir)
    scoped = n.select(F.concat_ws("/", "repo", "file_path").alias("file_path"), "kind", "qualified_name", "start_line", "end_line", F.concat_ws("/", "repo", "node_id").alias("node_id"), "ordinal").distinct()
    return locate.parent_defs(scoped)


def token_budget_running(spark, sf_dir) -> DataFrame:
    """Documents of each repository in order of id, until the characters before one reach the limit."""
    d = table(spark, sf_dir, "documents").select("repo", "doc_id", F.coalesce("n_chars", F.lit(0)).alias("cost"))
    return evaluate.within_budget(d, "repo", "doc_id", "cost", 5000).select("doc_id", "spent", "runs")


def identifier_extract(spark, sf_dir) -> DataFrame:
    """Names in backticks in documents that no node has."""
    names = _nodes(spark, sf_dir).select(S.last_part("qualified_name").alias("name")).distinct()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return triage.unknown_mentions(docs, names, "doc_id", "text")


def content_hash_docs(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null").groupBy(S.content_hash("text").alias("h"))
    return d.agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


def doc_search(spark, sf_dir) -> DataFrame:
    return report.search(table(spark, sf_dir, "documents"), "reachable", ["text", "source", "path"]).select("doc_id")


def json_props(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.from_json("props", "struct<k:int>")["k"]
    return e.groupBy("event_type").agg(F.sum(k).alias("sum_k"), F.min(k).alias("min_k"), F.max(k).alias("max_k"))


def extracted_nodes(spark, sf_dir) -> DataFrame:
    """Definitions of the Python files, parsed anew."""
    f = _files(spark, sf_dir)
    facts = extract.source_facts(f.select(F.col("file_id").cast("string").alias("_id"), F.concat_ws("\x1f", F.col("file_id").cast("string"), "rel_path").alias("rel_path"), "content"))
    d = extract.def_nodes(facts).withColumn("file_id", F.split("file_path", "\x1f")[0].cast("bigint"))
    j = d.join(f.select("file_id", "repo", "rel_path"), "file_id")
    return j.select("repo", F.col("rel_path").alias("file_path"), "kind", "qualified_name", "start_line", "end_line")


def _facts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    f = _files(spark, sf_dir).select(F.concat_ws("/", "repo", "rel_path").alias("rel_path"), "content")
    return f, G.cut(extract.source_facts(f))


def extracted_imports(spark, sf_dir) -> DataFrame:
    f, facts = _facts(spark, sf_dir)
    edges, refs = resolve.resolve_imports(facts, f)
    return edges.select("src_id", "dst_id", "resolved").unionByName(refs.select(F.col("node_id").alias("src_id"), F.col("package").alias("dst_id"), F.lit(None).cast("boolean").alias("resolved")).distinct())


def extracted_coverage(spark, sf_dir) -> DataFrame:
    f, facts = _facts(spark, sf_dir)
    nodes = extract.file_nodes(f).unionByName(extract.def_nodes(facts))
    return resolve.coverage(resolve.call_edges(resolve.resolve_sites(facts, f), nodes))


def extracted_entry_points(spark, sf_dir) -> DataFrame:
    f, facts = _facts(spark, sf_dir)
    return resolve.entry_points(facts, extract.def_nodes(facts), resolve.resolve_sites(facts, f))


def extracted_inherits(spark, sf_dir) -> DataFrame:
    f, facts = _facts(spark, sf_dir)
    return resolve.inherits_edges(resolve.resolve_sites(facts, f), facts)


def mro_order(spark, sf_dir) -> DataFrame:
    """Method resolution orders over resolved base classes."""
    e = _edges(spark, sf_dir).where("kind = 'inherits' and src_id is not null and dst_id is not null")
    return G.method_orders(e.groupBy(F.concat_ws("/", "repo", "src_id").alias("cls"), F.concat_ws("/", "repo", "dst_id").alias("base")).agg(F.min("ordinal").alias("ordinal")))


def _ends(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """First and last delivery of each repository."""
    s = table(spark, sf_dir, "node_snapshots")
    span = s.groupBy("repo").agg(F.min("snapshot_no").alias("a"), F.max("snapshot_no").alias("b")).where("a < b")
    one = F.max(F.struct("loaded_at", F.lower(F.regexp_replace("source_hash", "^sha256:", "")).alias("source_hash"), "node_id", "kind")).alias("r")
    j = s.join(span, "repo").select(F.concat_ws("/", "repo", "file_path").alias("file_path"), "qualified_name", "loaded_at", "source_hash", F.concat_ws("/", "repo", "node_id").alias("node_id"), "kind", (F.col("snapshot_no") == F.col("a")).alias("old"), (F.col("snapshot_no") == F.col("b")).alias("new"))

    def state(which: str) -> DataFrame:
        return j.where(which).groupBy("file_path", "qualified_name").agg(one).select("file_path", "qualified_name", "r.source_hash", "r.node_id", "r.kind")

    return state("old"), state("new")


def node_diff_counts(spark, sf_dir) -> DataFrame:
    return incremental.node_diff(*_ends(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"))


def rename_pairs(spark, sf_dir) -> DataFrame:
    return incremental.renames(G.cut(incremental.node_diff(*_ends(spark, sf_dir))))


def file_change_kinds(spark, sf_dir) -> DataFrame:
    old, new = _ends(spark, sf_dir)
    file = F.col("kind") == "file"
    o, n = (x.where(file).select(F.col("file_path").alias("rel_path"), F.col("source_hash").alias("content_hash")) for x in (old, new))
    return incremental.file_changes(o, n).groupBy("kind").agg(F.count("*").alias("n"))


def path_invalidation(spark, sf_dir) -> DataFrame:
    """Findings whose paths hold a node of thirteen lines, have an unresolved call into them, or are empty."""
    ev = G.cut(GQ._evidence(spark, sf_dir))
    dirty = P.nodes(spark, sf_dir).where("end_line - start_line = 12").select("node_id")
    new = P.calls(spark, sf_dir).where("not resolved").select("src_id", "dst_id").distinct()
    return incremental.invalid_paths(ev, dirty, new)


def incremental_equals_full(spark, sf_dir) -> DataFrame:
    """Evidence of the graph without imports and unresolved edges, brought up to date for all edges step by step."""
    e, entries, t = G.cut(P.edges(spark, sf_dir)), P.entry_points(spark, sf_dir), G.cut(P.findings(spark, sf_dir).select("finding_id", "node_id"))
    before = e.where("kind <> 'imports' and resolved")
    old = G.cut(reach.trace(t, before, entries))
    touched = incremental.affected_targets(t, G.full_graph(before), G.full_graph(e))
    fresh = incremental.update_evidence(old, t, G.cut(touched), lambda some: reach.trace(some, e, entries))
    return fresh.select("finding_id", "reachable", F.array_join("path", G.ARROW).alias("path"), "blast_radius")


def stream_incremental_counts(spark, sf_dir) -> DataFrame:
    return changes.incremental_counts(spark, sf_dir, "events.parquet", "event_type", "value")


def windowed_events(spark, sf_dir) -> DataFrame:
    w = changes.windowed_counts(table(spark, sf_dir, "events"), length="1 day")
    return w.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def stream_snapshot_state(spark, sf_dir) -> DataFrame:
    """The last delivery of each repository, rebuilt from the first one by applying all changes in order."""
    from tracelake.operators.snapshots import snapshot_changes

    s = table(spark, sf_dir, "node_snapshots")
    first = s.groupBy("repo").agg(F.min("snapshot_no").alias("snapshot_no"))
    state = s.join(first, ["repo", "snapshot_no"]).select("repo", "file_path", "qualified_name").distinct()
    ch = snapshot_changes(s)
    out = changes.apply_changes(state.withColumn("present", F.lit(True)), ch.withColumn("present", F.lit(True)), ["repo", "file_path", "qualified_name"], "snapshot_no")
    return out.groupBy("repo").agg(F.count("*").alias("n"))


def _eval_case(spark, sf_dir):
    """Findings with evidence; what two or more scanner findings agree on counts as a true case."""
    f = P.findings(spark, sf_dir).join(GQ._evidence(spark, sf_dir), "finding_id")
    f = f.select("finding_id", "file_path", F.lit(None).cast("string").alias("qualified_name"), "cwe", "package", "reachable", F.lower(F.trim("severity")).alias("severity"), F.lit(None).cast("string").alias("verdict"), "repo")
    g = table(spark, sf_dir, "duplicate_groups").where(F.size(F.array_distinct("members")) > 1).where(~F.contains("anchor", F.lit("@")))
    truth = g.select("repo", F.col("group_id").cast("string").alias("case_id"), F.concat_ws("/", "repo", "anchor").alias("file"), F.lit(None).cast("string").alias("function"), F.array("weakness").alias("cwes")).distinct()
    f = G.cut(f)
    return f, G.cut(evaluate.hits(f, truth)), truth


def prec_recall_by_method(spark, sf_dir) -> DataFrame:
    return evaluate.scores(*_eval_case(spark, sf_dir))


def pooled_gate(spark, sf_dir) -> DataFrame:
    return evaluate.gate(G.cut(evaluate.pooled(evaluate.scores(*_eval_case(spark, sf_dir)))))


def random_baseline(spark, sf_dir) -> DataFrame:
    f, h, _ = _eval_case(spark, sf_dir)
    return evaluate.random_baseline(f, h, n=50)


def random_expectation(spark, sf_dir) -> DataFrame:
    f, h, _ = _eval_case(spark, sf_dir)
    return evaluate.random_expectation(f, h, n=50)


def _edge_case(spark, sf_dir):
    """Calls as emitted; true are those that are resolved, and those of a name that one definition of the repository has."""
    repo = F.split_part(F.regexp_replace("src_id", "^unknown::", ""), F.lit("/"), F.lit(1))
    emitted = P.calls(spark, sf_dir).select(repo.alias("category"), F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), (F.col("resolved") & ~G.unknown("dst_id")).alias("resolved"))
    known = P.nodes(spark, sf_dir).where("kind = 'function'").select("node_id", F.split_part("node_id", F.lit("/"), F.lit(1)).alias("category"), S.last_part("qualified_name").alias("name")).distinct()
    by_name = known.groupBy("category", "name").agg(F.min("node_id").alias("dst"), F.countDistinct("node_id").alias("n")).where("n = 1").drop("n")
    lost = emitted.where("not resolved").select("category", "src", S.last_part(F.element_at(F.split("dst", "/"), -1)).alias("name"))
    truth = emitted.where("resolved").select("category", "src", "dst").unionByName(lost.join(by_name, ["category", "name"]).select("category", "src", "dst"))
    return emitted, truth, P.nodes(spark, sf_dir).select("node_id").distinct()


def miss_classification(spark, sf_dir) -> DataFrame:
    """True, false and missed edges per category with a total row, and why edges are missed."""
    return evaluate.edge_scores(*_edge_case(spark, sf_dir))


def requires_closure(spark, sf_dir) -> DataFrame:
    """What needs each nation or region, over supplier - nation - region."""
    n = table(spark, sf_dir, "nation")
    req = n.select(F.concat(F.lit("n"), "n_nationkey").alias("parent"), F.concat(F.lit("r"), "n_regionkey").alias("name")).unionByName(
        table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("parent"), F.concat(F.lit("n"), "s_nationkey").alias("name"))
    )
    return G.required_by(req, req.select("name").distinct())


def deps_urgency(spark, sf_dir) -> DataFrame:
    """Packages of the findings by urgency; a finding is reachable where its severity says critical, unknown where it is filler."""
    f = _findings(spark, sf_dir).where("package is not null")
    sev = F.lower(F.trim("severity"))
    reach = F.when(sev == "critical", "reachable").when(sev.isin("low", "medium", "high"), "unreachable").otherwise("unknown")
    rows = f.select("package", "package_version", "rule_id", F.trim("fixed_in").alias("fixed_in"), reach.alias("reachable"))
    r = deps.dependency_report(rows)
    return r.select("package", "package_version", "n_advisories", "unfixed", "worst", "urgency")


def verdict_cache_join(spark, sf_dir) -> DataFrame:
    """Verdicts of the keyword provider over all findings; every second rule is in the cache already."""
    f = _findings(spark, sf_dir)
    ctx = triage.contexts(f.withColumn("path", F.array().cast("array<string>")).withColumn("code", F.lit("")))
    ctx = G.cut(ctx.select("finding_id", F.lit("unknown").alias("reachable"), "prompt", "context_hash", F.col("finding_id").alias("ordinal"), "message"))
    p = triage.KeywordProvider()
    seen = ctx.where(F.col("message").contains("session")).withColumn("cache_key", triage.cache_key("v1", p.model_name))
    cache = seen.select("cache_key", F.lit("real").alias("verdict"), F.lit(0.7).alias("confidence"), F.lit("").alias("reasoning"))
    return triage.adjudicate(ctx, p, cache).select("finding_id", "verdict", F.round("confidence", 6).alias("confidence"), "how")


_REPLIES = [
    (1, '{"verdict": "real", "confidence": 0.9, "reasoning": "x"}'), (2, '```json\n{"verdict": "false_positive", "confidence": 1.7}\n```'), (3, "verdict: needs_review, confidence: 0.25"),
    (4, '{"verdict": "maybe", "confidence": -2}'), (5, ""), (6, "no idea"), (7, 'Sure! "verdict": "REAL", "confidence": 0.5'),
]


def verdict_parse(spark, sf_dir) -> DataFrame:
    rows = spark.createDataFrame(_REPLIES, "id int, reply string")
    return reports.parse_verdicts(rows).select("id", "verdict", "confidence")


def osv_raw_findings(spark, sf_dir) -> DataFrame:
    """Dependency findings of all reports, in whatever wrapping they hold their results."""
    r = nested.latest(table(spark, sf_dir, "osv_reports"), "report_id", "loaded_at", "report")
    return reports.osv(nested.plain_reports(r).select("body")).select("rule_id", "package", "package_version", "severity", "cwe", "fixed_in", "rel_path")


def report_json(spark, sf_dir) -> DataFrame:
    f = P.findings(spark, sf_dir).join(GQ._evidence(spark, sf_dir), "finding_id")
    return report.finding_entries(f, P.nodes(spark, sf_dir), P.edges(spark, sf_dir))


def summary_levels(spark, sf_dir) -> DataFrame:
    """Summaries of the inheritance graph's classes, bases first, by a rule that needs no model."""
    n = _nodes(spark, sf_dir).where("kind = 'class'").select(F.concat_ws("/", "repo", "node_id").alias("node_id"), "qualified_name", "source_hash", F.col("qualified_name").alias("code")).dropDuplicates(["node_id"])
    e = _edges(spark, sf_dir).where("kind = 'inherits'").dropna(subset=["repo", "src_id", "dst_id"]).select(F.concat_ws("/", "repo", "src_id").alias("src_id"), F.concat_ws("/", "repo", "dst_id").alias("dst_id"))

    def write(code: str, below: list[str]) -> str:
        return f"{code} uses {len(below)}"

    return triage.summarise(n, e, write).select("node_id", "level", "summary")


QUERIES = {
    f.__name__: f
    for f in (
        source_inventory, copied_files, severity_bands, primary_ids, upgrade_to, finding_line_text, node_snippets, finding_nodes, mapping_stats, scanner_groups, finding_identities, first_wins_dedupe, finding_search,
        node_search, index_summary, coverage_rates, unknown_hubs, repo_callers, defines_parent, token_budget_running, identifier_extract, content_hash_docs, doc_search, json_props, extracted_nodes, extracted_imports,
        extracted_coverage, extracted_entry_points, extracted_inherits, mro_order, node_diff_counts, rename_pairs, file_change_kinds, path_invalidation, incremental_equals_full,
        stream_incremental_counts, windowed_events, stream_snapshot_state, prec_recall_by_method, pooled_gate, random_baseline, random_expectation, miss_classification, requires_closure, deps_urgency, verdict_cache_join, verdict_parse,
        osv_raw_findings, report_json, summary_levels,
    )
}

_F = P.RAW_FINDINGS
_SRC = """src AS (SELECT file_id, repo, rel_path, max(struct_pack(l := loaded_at, c := content)).c AS content FROM source_files GROUP BY 1, 2, 3)"""
_N = P.RAW_NODES
_E = "e AS (SELECT repo, src_id, dst_id, lower(trim(kind)) AS kind, resolved, ordinal FROM edges)"
_AT = f"{_F}, {_N}, {P.LOCATED}"
_STATE = """span AS (SELECT repo, min(snapshot_no) AS a, max(snapshot_no) AS b FROM node_snapshots GROUP BY 1 HAVING a < b),
st AS (SELECT s.repo || '/' || s.file_path AS file_path, s.qualified_name, s.snapshot_no = x.a AS is_old, s.snapshot_no = x.b AS is_new,
    max(struct_pack(l := s.loaded_at, h := coalesce(lower(regexp_replace(s.source_hash, '^sha256:', '')), ''), n := s.repo || '/' || s.node_id, k := s.kind)) AS r
  FROM node_snapshots s JOIN span x USING (repo) WHERE s.snapshot_no IN (x.a, x.b) GROUP BY ALL),
o AS (SELECT file_path, qualified_name, r.h AS h, r.n AS id, r.k AS k FROM st WHERE is_old), w AS (SELECT file_path, qualified_name, r.h AS h, r.n AS id, r.k AS k FROM st WHERE is_new),
d AS (SELECT file_path, qualified_name, o.id AS old_id, w.id AS new_id, o.h AS h1, w.h AS h2, coalesce(w.k, o.k) AS kind,
    CASE WHEN o.id IS NULL THEN 'added' WHEN w.id IS NULL THEN 'deleted' WHEN o.h = w.h THEN 'unchanged' ELSE 'modified' END AS status FROM o FULL JOIN w USING (file_path, qualified_name))"""
_EVAL = """ev AS MATERIALIZED (SELECT f.finding_id, f.file_path, f.cwe, f.package, e.reachable, lower(trim(f.severity)) AS severity, f.repo FROM findings f JOIN evidence e USING (finding_id)),
truth AS (SELECT DISTINCT repo, CAST(group_id AS VARCHAR) AS case_id, repo || '/' || anchor AS file, weakness AS cwe FROM duplicate_groups WHERE len(list_distinct(members)) > 1 AND NOT contains(anchor, '@')),
hit AS MATERIALIZED (SELECT DISTINCT ev.finding_id, t.case_id FROM ev JOIN truth t ON t.file = ev.file_path AND t.cwe = ev.cwe WHERE ev.package IS NULL),
kept AS MATERIALIZED (SELECT repo, finding_id, unnest(list_filter(['keep_all', CASE WHEN severity IN ('critical', 'high', 'medium') THEN 'severity' END, CASE WHEN reachable <> 'unreachable' THEN 'reachability' END, CASE WHEN reachable <> 'unreachable' THEN 'triage' END], lambda x: x IS NOT NULL)) AS method FROM ev),
sc AS MATERIALIZED (SELECT k.repo, k.method, count(DISTINCT k.finding_id) AS kept, count(DISTINCT h.finding_id) AS true_pos, count(DISTINCT h.case_id) AS cases_hit FROM kept k LEFT JOIN hit h USING (finding_id) GROUP BY 1, 2),
scores AS MATERIALIZED (SELECT s.*, coalesce(d.cases_hit, 0) AS detected, coalesce(t.n, 0) AS truth FROM sc s LEFT JOIN (SELECT repo, cases_hit FROM sc WHERE method = 'keep_all') d USING (repo) LEFT JOIN (SELECT repo, count(DISTINCT case_id) AS n FROM truth GROUP BY 1) t USING (repo))"""
_EV = (P.GOOD, P.FAR, P.PAIRS, P.EVIDENCE)

SQL = {
    "source_inventory": f"WITH {_SRC} SELECT file_id, sha256(content) AS content_hash, CAST(CASE WHEN content = '' THEN 0 ELSE length(content) - length(replace(content, chr(10), '')) + 1 END AS INTEGER) AS lines FROM src WHERE regexp_matches(rel_path, '\\.pyi?w?$') AND content IS NOT NULL",
    "copied_files": f"WITH {_SRC} SELECT sha256(content) AS h, count(*) AS n, min(file_id) AS first_id FROM src WHERE length(content) > 0 GROUP BY 1 HAVING count(*) > 1",
    "severity_bands": """SELECT DISTINCT finding_id, CASE WHEN try_cast(raw_severity AS DOUBLE) >= 9 THEN 'critical' WHEN try_cast(raw_severity AS DOUBLE) >= 7 THEN 'high' WHEN try_cast(raw_severity AS DOUBLE) >= 4 THEN 'medium' ELSE 'low' END AS band,
  CASE lower(trim(raw_severity)) WHEN 'critical' THEN 'critical' WHEN 'high' THEN 'high' WHEN 'error' THEN 'high' WHEN 'medium' THEN 'medium' WHEN 'warning' THEN 'medium' ELSE 'low' END AS word,
  CASE WHEN try_cast(regexp_extract(trim(cwe), '^(?:CWE-)?0*([0-9]+)', 1, 'i') AS BIGINT) > 0 THEN 'CWE-' || regexp_extract(trim(cwe), '^(?:CWE-)?0*([0-9]+)', 1, 'i') END AS cwe FROM raw_findings""",
    "primary_ids": f"""WITH {_F}, a AS (SELECT finding_id, package, list_sort(list_distinct(list_append(list_filter(aliases, lambda x: x IS NOT NULL), rule_id))) AS ids FROM f WHERE aliases IS NOT NULL)
SELECT finding_id, coalesce(list_filter(ids, lambda x: starts_with(x, 'CVE-'))[1], list_filter(ids, lambda x: starts_with(x, 'GHSA-'))[1], ids[1], 'OSV-UNKNOWN') AS primary_id, lower(regexp_replace(package, '[-_.]+', '-', 'g')) AS package FROM a""",
    "upgrade_to": f"""WITH {_F} SELECT package, arg_max(trim(fixed_in), list_transform(string_split(trim(fixed_in), '.'), lambda x: CAST(x AS BIGINT))) AS upgrade_to, count(*) AS n FROM f
WHERE package IS NOT NULL AND regexp_matches(trim(fixed_in), '^[0-9]+(\\.[0-9]+)*$') GROUP BY 1""",
    "finding_line_text": f"WITH {_F}, {_SRC} SELECT f.finding_id, coalesce(trim(string_split_regex(s.content, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\x{{2028}}\\x{{2029}}]')[f.line], ' '), '') AS text FROM f JOIN src s ON s.repo = f.repo AND s.rel_path = f.rel_path WHERE f.line > 0",
    "node_snippets": f"""WITH {_SRC}, {_N}, x AS (SELECT DISTINCT n.repo, n.node_id, array_to_string(string_split(s.content, chr(10))[n.start_line:least(n.end_line, n.start_line + 59)], chr(10)) AS t
  FROM n JOIN src s ON s.repo = n.repo AND s.rel_path = n.file_path WHERE n.kind <> 'file' AND s.content IS NOT NULL) SELECT repo, node_id, sha256(t) AS snippet_hash, CAST(length(t) AS INTEGER) AS n_chars FROM x""",
    "finding_nodes": f"WITH {_AT} SELECT finding_id, node_id FROM located",
    "mapping_stats": f"""WITH {_AT}, u AS (SELECT DISTINCT repo FROM edges WHERE lower(trim(kind)) = 'imports' AND NOT resolved AND src_id IS NOT NULL),
s AS (SELECT CASE WHEN f.package IS NOT NULL AND u.repo IS NOT NULL THEN 'to_package' WHEN f.package IS NOT NULL THEN 'dependency_unknown' WHEN NOT regexp_matches(f.rel_path, '\\.pyi?w?$') THEN 'non_python'
    WHEN k.kind = 'file' THEN 'to_file' WHEN k.kind IS NOT NULL THEN 'to_def' ELSE 'unmapped' END AS st
  FROM f LEFT JOIN located l USING (finding_id) LEFT JOIN (SELECT DISTINCT repo, node_id, kind FROM n) k ON k.repo = f.repo AND k.node_id = l.node_id LEFT JOIN u ON u.repo = f.repo)
SELECT count(*) AS total, {", ".join(f"count(*) FILTER (WHERE st = '{x}') AS {x}" for x in locate.STATUSES)},
  count(*) FILTER (WHERE st IN ('to_def', 'to_file', 'to_package', 'via_dependency')) AS mapped, count(*) FILTER (WHERE st NOT IN ('non_python', 'unused_dependency', 'dependency_unknown')) AS mappable,
  CASE WHEN mappable = 0 THEN 1.0 ELSE mapped / mappable END AS ratio FROM s""",
    "scanner_groups": f"""WITH {_F} SELECT CASE WHEN package IS NOT NULL THEN 'pkg:' || repo || '/' || package || '@' || coalesce(package_version, '') ELSE repo || '/' || rel_path END AS anchor,
  CASE WHEN package IS NOT NULL THEN rule_id ELSE coalesce(cwe, source || ':' || rule_id) END AS weakness, CAST(CASE WHEN package IS NOT NULL THEN 0 ELSE line END AS INTEGER) AS line, count(*) AS n, min(finding_id) AS first_id FROM f GROUP BY 1, 2, 3""",
    "finding_identities": f"""WITH {_F} SELECT finding_id AS row_id, CASE WHEN package IS NOT NULL THEN sha256(concat_ws(chr(31), source, rule_id, lower(regexp_replace(package, '[-_.]+', '-', 'g')), coalesce(package_version, '')))
  ELSE sha256(concat_ws(chr(31), source, rule_id, repo || '/' || rel_path, coalesce(message, ''), CAST(row_number() OVER (PARTITION BY source, rule_id, repo || '/' || rel_path, coalesce(message, '') ORDER BY line, finding_id) - 1 AS VARCHAR))) END AS identity FROM f""",
    "first_wins_dedupe": f"WITH {_F} SELECT package, rule_id, min(struct_pack(o := scan_ordinal, i := finding_id)).i AS finding_id FROM f WHERE package IS NOT NULL GROUP BY 1, 2",
    "finding_search": f"WITH {_F} SELECT finding_id FROM f WHERE " + " OR ".join(f"contains(lower(coalesce({c}, '')), 'session')" for c in ("rule_id", "rel_path", "cwe", "message", "package")),
    "node_search": f"WITH {_N} SELECT DISTINCT repo, node_id FROM n WHERE contains(lower(qualified_name), 'session') ORDER BY repo, node_id LIMIT 8",
    "index_summary": """SELECT repo, count(*) FILTER (WHERE kind = 'file') AS n_file, count(*) FILTER (WHERE kind = 'class') AS n_class, count(*) FILTER (WHERE kind = 'function') AS n_function,
  CAST(sum(CASE WHEN kind = 'file' THEN end_line ELSE 0 END) AS BIGINT) AS loc FROM (SELECT DISTINCT repo, node_id, kind, file_path, start_line, end_line FROM nodes) GROUP BY 1""",
    "coverage_rates": f"WITH {_E} SELECT repo, count(*) AS total, count(*) FILTER (WHERE resolved) AS resolved, round(count(*) FILTER (WHERE resolved) / count(*), 6) AS ratio FROM e WHERE kind = 'calls' GROUP BY 1",
    "unknown_hubs": "SELECT repo, dst_id, count(DISTINCT src_id) AS callers, count(*) AS edges FROM edges e WHERE src_id IS NOT NULL AND dst_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM nodes n WHERE n.repo = e.repo AND n.node_id = e.dst_id) GROUP BY 1, 2",
    "repo_callers": f"""WITH {_E} SELECT repo, dst_id AS node_id, count(DISTINCT src_id) AS n, min(src_id) AS first_caller FROM e WHERE kind = 'calls' AND dst_id IS NOT NULL
  AND EXISTS (SELECT 1 FROM nodes n WHERE n.repo = e.repo AND n.node_id = e.src_id) GROUP BY 1, 2""",
    "defines_parent": f"""WITH {_N}, s AS (SELECT DISTINCT repo || '/' || file_path AS fp, kind, qualified_name AS q, start_line AS a, end_line AS b, repo || '/' || node_id AS id, ordinal FROM n),
c AS (SELECT id, fp, a, b, regexp_extract(q, '^(.*)\\.[^.]*$', 1) AS prefix FROM s WHERE kind <> 'file')
SELECT DISTINCT coalesce((SELECT arg_min(p.id, p.ordinal) FROM s p WHERE p.kind <> 'file' AND p.fp = c.fp AND p.q = c.prefix AND p.a <= c.a AND p.b >= c.b AND p.id <> c.id),
  (SELECT min(p.id) FROM s p WHERE p.kind = 'file' AND p.fp = c.fp)) AS parent_id, c.id AS child_id FROM c""",
    "token_budget_running": "SELECT doc_id, spent, spent < 5000 AS runs FROM (SELECT doc_id, CAST(coalesce(sum(coalesce(n_chars, 0)) OVER (PARTITION BY repo ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS spent FROM documents)",
    "identifier_extract": """WITH said AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '`([A-Za-z_][A-Za-z0-9_.]*)(?:\\(\\))?`', 1)) AS name FROM documents),
names AS (SELECT DISTINCT regexp_extract(qualified_name, '([^.]*)$', 1) AS name FROM nodes)
SELECT doc_id, name FROM said WHERE name NOT IN (SELECT name FROM names) AND regexp_extract(name, '([^.]*)$', 1) NOT IN (SELECT name FROM names)""",
    "content_hash_docs": "SELECT sha256(text) AS h, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "doc_search": "SELECT doc_id FROM documents WHERE contains(lower(coalesce(text, '')), 'reachable') OR contains(lower(coalesce(source, '')), 'reachable') OR contains(lower(coalesce(path, '')), 'reachable')",
    "json_props": "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS INTEGER)) AS BIGINT) AS sum_k, min(CAST(json_extract(props, '$.k') AS INTEGER)) AS min_k, max(CAST(json_extract(props, '$.k') AS INTEGER)) AS max_k FROM events GROUP BY 1",
    "extracted_nodes": "SELECT DISTINCT repo, file_path, kind, qualified_name, start_line, end_line FROM nodes WHERE kind <> 'file'",
    "node_diff_counts": f"WITH {_STATE} SELECT status, count(*) AS n FROM d GROUP BY 1",
    "file_change_kinds": f"""WITH {_STATE}, o0 AS (SELECT * FROM o WHERE k = 'file'), w0 AS (SELECT * FROM w WHERE k = 'file'),
d0 AS (SELECT o0.h AS h1, w0.h AS h2, file_path, CASE WHEN o0.id IS NULL THEN 'added' WHEN w0.id IS NULL THEN 'deleted' WHEN o0.h = w0.h THEN 'unchanged' ELSE 'modified' END AS status FROM o0 FULL JOIN w0 USING (file_path)), c AS (SELECT file_path, status, h1, h2 FROM d0 WHERE status <> 'unchanged'),
m AS (SELECT 1 FROM (SELECT h1 AS h FROM c WHERE status = 'deleted' AND h1 <> '' GROUP BY 1 HAVING count(*) = 1) a JOIN (SELECT h2 AS h FROM c WHERE status = 'added' AND h2 <> '' GROUP BY 1 HAVING count(*) = 1) b USING (h)),
r AS (SELECT count(*) AS k FROM m)
SELECT * FROM (SELECT status AS kind, count(*) - CASE WHEN status IN ('added', 'deleted') THEN (SELECT k FROM r) ELSE 0 END AS n FROM c GROUP BY 1 UNION ALL SELECT 'renamed', k FROM r) WHERE n > 0""",
    "rename_pairs": f"""WITH {_STATE}, g0 AS (SELECT h1 AS h, file_path AS f, qualified_name AS q, old_id AS id FROM d WHERE status = 'deleted' AND kind <> 'file' AND h1 <> ''),
c0 AS (SELECT h2 AS h, file_path AS f, qualified_name AS q, new_id AS id FROM d WHERE status = 'added' AND kind <> 'file' AND h2 <> ''),
p1 AS (SELECT a.id AS old_id, b.id AS new_id FROM (SELECT *, row_number() OVER (PARTITION BY h, f ORDER BY id) AS rn FROM g0) a JOIN (SELECT *, row_number() OVER (PARTITION BY h, f ORDER BY id) AS rn FROM c0) b USING (h, f, rn)),
g1 AS (SELECT * FROM g0 WHERE id NOT IN (SELECT old_id FROM p1)), c1 AS (SELECT * FROM c0 WHERE id NOT IN (SELECT new_id FROM p1)),
p2 AS (SELECT a.id AS old_id, b.id AS new_id FROM (SELECT *, row_number() OVER (PARTITION BY h, q ORDER BY id) AS rn FROM g1) a JOIN (SELECT *, row_number() OVER (PARTITION BY h, q ORDER BY id) AS rn FROM c1) b USING (h, q, rn)),
g2 AS (SELECT * FROM g1 WHERE id NOT IN (SELECT old_id FROM p2)), c2 AS (SELECT * FROM c1 WHERE id NOT IN (SELECT new_id FROM p2)),
p3 AS (SELECT a.id AS old_id, b.id AS new_id FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY id) AS rn FROM g2) a JOIN (SELECT *, row_number() OVER (PARTITION BY h ORDER BY id) AS rn FROM c2) b USING (h, rn))
SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3""",
    "path_invalidation": P.sql(
        """SELECT finding_id FROM evidence WHERE path = '' UNION SELECT s.finding_id FROM s JOIN defs p ON p.node_id = s.node_id AND p.end_line - p.start_line = 12
UNION SELECT s.finding_id FROM s JOIN (SELECT DISTINCT src_id, dst_id FROM calls WHERE NOT resolved) c ON c.dst_id = s.node_id WHERE NOT list_contains(s.p, c.src_id)""",
        *_EV, "s AS MATERIALIZED (SELECT finding_id, string_split(path, ' > ') AS p, unnest(string_split(path, ' > ')) AS node_id FROM evidence WHERE path <> '')",
    ),
    "incremental_equals_full": P.sql("SELECT finding_id, reachable, path, blast_radius FROM evidence", *_EV),
    "stream_incremental_counts": "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1",
    "windowed_events": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_snapshot_state": "SELECT s.repo, count(DISTINCT (s.file_path, s.qualified_name)) AS n FROM node_snapshots s JOIN (SELECT repo, max(snapshot_no) AS b FROM node_snapshots GROUP BY 1) x ON x.repo = s.repo AND x.b = s.snapshot_no GROUP BY 1",
    "prec_recall_by_method": P.sql("SELECT *, round(true_pos / nullif(kept, 0), 6) AS precision, round(cases_hit / nullif(detected, 0), 6) AS recall_retained, round(cases_hit / nullif(truth, 0), 6) AS recall_end_to_end FROM scores", *_EV, _EVAL),
    "pooled_gate": P.sql(
        """SELECT round(o.precision / nullif(b.precision, 0), 6) AS gain, o.recall_retained, o.precision / nullif(b.precision, 0) >= 3 AND o.recall_retained >= 0.85 AS passed
FROM (SELECT * FROM pool WHERE method = 'reachability') o, (SELECT * FROM pool WHERE method = 'keep_all') b""",
        *_EV, _EVAL, "pool AS (SELECT method, round(sum(true_pos) / nullif(sum(kept), 0), 6) AS precision, round(sum(cases_hit) / nullif(sum(detected), 0), 6) AS recall_retained FROM scores GROUP BY 1)",
    ),
    "random_expectation": P.sql(
        """SELECT round((SELECT count(DISTINCT finding_id) FROM hit) * 50 / t.n, 6) AS expected_true_pos,
  round((SELECT sum(1 - p) FROM (SELECT list_aggregate(list_transform(range(0, m), lambda i: greatest(t.n - 50 - i, 0) / (t.n - i)), 'product') AS p FROM (SELECT case_id, count(DISTINCT finding_id) AS m FROM hit GROUP BY 1))), 6) AS expected_cases_hit
FROM (SELECT count(*) AS n FROM ev) t""",
        *_EV, _EVAL,
    ),
    "mro_order": """WITH l AS (SELECT concat_ws('/', repo, src_id) AS cls, concat_ws('/', repo, dst_id) AS base, min(ordinal) AS o FROM edges WHERE lower(trim(kind)) = 'inherits' AND src_id IS NOT NULL AND dst_id IS NOT NULL GROUP BY 1, 2)
SELECT cls, CAST(row_number() OVER (PARTITION BY cls ORDER BY o, base) AS INTEGER) AS position, base FROM l UNION ALL SELECT DISTINCT cls, 0, cls FROM l
UNION ALL SELECT DISTINCT base, 0, base FROM l WHERE base NOT IN (SELECT cls FROM l)""",  # as no base in the tables has bases of its own
    "summary_levels": f"""WITH RECURSIVE {_N}, {_E}, own AS MATERIALIZED (SELECT DISTINCT concat_ws('/', repo, node_id) AS x, qualified_name AS q FROM n WHERE kind = 'class'),
i AS MATERIALIZED (SELECT DISTINCT concat_ws('/', repo, src_id) AS a, concat_ws('/', repo, dst_id) AS b FROM e WHERE kind = 'inherits' AND repo IS NOT NULL AND src_id <> dst_id),
k AS MATERIALIZED (SELECT a, b FROM i WHERE a IN (SELECT x FROM own) AND b IN (SELECT x FROM own)),
lv AS (SELECT x, 0 AS l FROM own UNION SELECT k.a, lv.l + 1 FROM lv JOIN k ON k.b = lv.x)
SELECT o.x AS node_id, CAST(max(lv.l) AS INTEGER) AS level, o.q || ' uses ' || CAST((SELECT count(*) FROM k WHERE k.a = o.x) AS VARCHAR) AS summary FROM own o JOIN lv ON lv.x = o.x GROUP BY o.x, o.q""",
    "miss_classification": P.sql(
        """SELECT coalesce(category, 'TOTAL') AS category, count(*) FILTER (WHERE t AND e) AS tp, count(*) FILTER (WHERE e) AS emitted, count(*) FILTER (WHERE t) AS truth, count(*) FILTER (WHERE t AND NOT e AND NOT nd) AS no_node,
  count(*) FILTER (WHERE t AND NOT e AND nd AND bl) AS unknown, count(*) FILTER (WHERE t AND NOT e AND nd AND NOT bl) AS silent
FROM (SELECT x.category, x.src, x.dst, bool_or(x.e) AS e, bool_or(x.t) AS t, x.dst IN (SELECT node_id FROM defs) AS nd,
    EXISTS (SELECT 1 FROM emitted y WHERE y.src = x.src AND y.category = x.category AND NOT y.ok) AS bl
  FROM (SELECT category, src, dst, TRUE AS e, TRUE AS t FROM emitted WHERE ok UNION ALL SELECT category, src, dst, FALSE, TRUE FROM guessed) x GROUP BY 1, 2, 3) GROUP BY ROLLUP (category)""",
        "emitted AS MATERIALIZED (SELECT split_part(regexp_replace(src_id, '^unknown::', ''), '/', 1) AS category, src_id AS src, dst_id AS dst, resolved AND NOT starts_with(dst_id, 'unknown::') AS ok FROM calls)",
        """guessed AS MATERIALIZED (SELECT x.category, x.src, d.dst FROM emitted x JOIN (SELECT split_part(node_id, '/', 1) AS category, regexp_extract(qualified_name, '([^.]*)$', 1) AS name, min(node_id) AS dst
    FROM defs WHERE kind = 'function' GROUP BY 1, 2 HAVING count(DISTINCT node_id) = 1) d ON d.category = x.category AND d.name = regexp_extract(string_split(x.dst, '/')[-1], '([^.]*)$', 1) WHERE NOT x.ok)""",
    ),
    "requires_closure": """WITH RECURSIVE req AS (SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS parent, 'r' || CAST(n_regionkey AS VARCHAR) AS name FROM nation UNION ALL SELECT 's' || CAST(s_suppkey AS VARCHAR), 'n' || CAST(s_nationkey AS VARCHAR) FROM supplier),
c AS (SELECT name, parent FROM req UNION SELECT c.name, r.parent FROM c JOIN req r ON r.name = c.parent) SELECT name, parent FROM c""",
    "deps_urgency": f"""WITH {_F}, r AS (SELECT lower(regexp_replace(package, '[-_.]+', '-', 'g')) AS package, package_version, rule_id, CASE lower(trim(severity)) WHEN 'critical' THEN 3 WHEN 'low' THEN 1 WHEN 'medium' THEN 1 WHEN 'high' THEN 1 ELSE 2 END AS k,
  coalesce(regexp_matches(trim(fixed_in), '^[0-9]'), FALSE) AS fixed FROM f WHERE package IS NOT NULL)
SELECT package, package_version, count(DISTINCT rule_id) AS n_advisories, count(DISTINCT rule_id) - count(DISTINCT rule_id) FILTER (WHERE fixed) AS unfixed, CASE max(k) WHEN 3 THEN 'reachable' WHEN 2 THEN 'unknown' ELSE 'unreachable' END AS worst,
  CASE max(k) WHEN 3 THEN 'urgent' WHEN 2 THEN 'check' ELSE 'routine' END AS urgency FROM r GROUP BY 1, 2""",
    "verdict_cache_join": f"""WITH {_F}, p AS (SELECT finding_id, coalesce(contains(message, 'session'), FALSE) AS seen, concat_ws(chr(10), 'finding: ' || concat_ws(' | ', source, rule_id, coalesce(cwe, 'no weakness')),
    'severity: ' || coalesce(raw_severity, ''), 'message: ' || coalesce(message, ''), 'target: ', 'code: ', 'path: ', 'callers: ', 'module: ',
    'question: ' || CASE cwe {" ".join(f"WHEN '{w}' THEN '{t}'" for w, t in triage.FOCUS.items() if w)} ELSE '{triage.FOCUS[""]}' END) AS prompt FROM f),
k AS (SELECT finding_id, prompt IN (SELECT prompt FROM p WHERE seen) AS cached, regexp_matches(lower(prompt), 'sanitize|escaped|parameterized|constant') AS safe, regexp_matches(lower(prompt), 'request|user input|untrusted|remote') AS open FROM p)
SELECT finding_id, CASE WHEN cached THEN 'real' WHEN safe THEN 'false_positive' WHEN open THEN 'real' ELSE 'needs_review' END AS verdict,
  CAST(CASE WHEN cached THEN 0.7 WHEN safe THEN 0.8 WHEN open THEN 0.9 ELSE 0.5 END AS DOUBLE) AS confidence, CASE WHEN cached THEN 'cached' ELSE 'called' END AS how FROM k""",
    "verdict_parse": "SELECT * FROM (VALUES (1, 'real', 0.9::DOUBLE), (2, 'false_positive', 1.0), (3, 'needs_review', 0.25), (4, 'needs_review', 0.0), (5, 'needs_review', 0.5), (6, 'needs_review', 0.5), (7, 'real', 0.5)) AS t(id, verdict, confidence)",
}
