"""The graph queries with the entry points that the source files declare.

There is no SQL of these, as SQL can't parse the files; tests hold them against small graphs worked out by hand. The same
operators over entry points that SQL can tell are in ``graph_queries``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import scalar as S
from tracelake.operators import evaluate, extract, reach, resolve
from tracelake.operators import graph as G
from tracelake.plans import code_graph as P
from tracelake.plans import table_queries as T


nodes, edges, calls = P.nodes, P.edges, P.calls


def _source(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Entry points, and the packages that files import, as the source files say."""
    files, facts = T._facts(spark, sf_dir)
    return G.cut(resolve.entry_points(facts, extract.def_nodes(facts), resolve.resolve_sites(facts, files))), resolve.resolve_imports(facts, files)[1]


def entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _source(spark, sf_dir)[0]


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = T._findings(spark, sf_dir)
    return f.withColumn("finding_id", F.col("finding_id").cast("string")).withColumn("ordinal", F.col("scan_ordinal"))


def _anchors(spark: SparkSession, sf_dir: str, refs: DataFrame) -> DataFrame:
    """``(finding_id, node_id, file_path)``: files of the repository that import a dependency finding's package."""
    f = findings(spark, sf_dir).where("package is not null").select("finding_id", "repo", S.import_name(S.canonical_name("package")).alias("package"))
    users = refs.select(F.split_part("node_id", F.lit("/"), F.lit(1)).alias("repo"), "package", "node_id").distinct()
    return f.join(users, ["repo", "package"]).select("finding_id", "node_id", F.regexp_replace("node_id", "::<file>$", "").alias("file_path")).distinct()


def targets(spark: SparkSession, sf_dir: str, anchors: DataFrame) -> DataFrame:
    """``(finding_id, node_id)`` of every finding; a null node where the code has no place for it."""
    repo = findings(spark, sf_dir).select("finding_id", "repo")
    at = T.finding_nodes(spark, sf_dir).withColumn("finding_id", F.col("finding_id").cast("string")).join(repo, "finding_id").select("finding_id", P.scoped("node_id").alias("node_id"))
    known = at.unionByName(anchors.select("finding_id", "node_id")).dropna()
    return repo.select("finding_id").join(known, "finding_id", "left")


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, refs = _source(spark, sf_dir)
    anchors = G.cut(_anchors(spark, sf_dir, refs))
    e = G.cut(edges(spark, sf_dir))
    first = G.cut(reach.trace(targets(spark, sf_dir, anchors), e, entries))
    return reach.import_in_use(first, anchors.select("finding_id", "file_path"), e, nodes(spark, sf_dir), entries)


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None)
    f = findings(spark, sf_dir).join(_evidence(spark, sf_dir), "finding_id")
    return f.withColumn("verdict", none.cast("string")).withColumn("confidence", none.cast("double"))


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.full_graph(edges(spark, sf_dir))


def code_reachability(spark, sf_dir) -> DataFrame:
    """All findings with class, path and blast radius, most urgent first."""
    ranked = _judged(spark, sf_dir).orderBy(*reach.rank_keys(), "ordinal", "finding_id")
    return ranked.select("finding_id", "source", "reachable", F.array_join("path", G.ARROW).alias("path"), "blast_radius")


def code_reachability_counts(spark, sf_dir) -> DataFrame:
    return _evidence(spark, sf_dir).groupBy("reachable").agg(F.count("*").alias("n"))


def code_ranked_topk(spark, sf_dir) -> DataFrame:
    """The twenty most urgent findings."""
    top = _judged(spark, sf_dir).orderBy(*reach.rank_keys(), "ordinal", "finding_id").limit(20)
    return top.select("finding_id", "reachable", "blast_radius", "raw_severity")


def code_worst_by_file(spark, sf_dir) -> DataFrame:
    return reach.worst_by(_judged(spark, sf_dir).withColumn("file_path", F.concat_ws("/", "repo", "rel_path")), "file_path")


def code_reach_pairs(spark, sf_dir) -> DataFrame:
    return G.reach_pairs(_graph(spark, sf_dir), entry_points(spark, sf_dir)).select("seed", "node")


def code_resolved_depth(spark, sf_dir) -> DataFrame:
    return G.shortest_paths(G.resolved_graph(_graph(spark, sf_dir)), entry_points(spark, sf_dir)).select("node", "depth")


def code_shortest_paths(spark, sf_dir) -> DataFrame:
    found = G.shortest_paths(_graph(spark, sf_dir), entry_points(spark, sf_dir))
    return found.select("node", "depth", F.array_join("path", G.ARROW).alias("path"))


def code_blast_radius(spark, sf_dir) -> DataFrame:
    return G.blast_radii(_graph(spark, sf_dir), entry_points(spark, sf_dir))


def code_attack_surface(spark, sf_dir) -> DataFrame:
    """Share of the functions that resolved edges reach from any entry point."""
    surface = G.attack_surface(_graph(spark, sf_dir), entry_points(spark, sf_dir)).withColumn("exposed", F.lit(True))
    functions = nodes(spark, sf_dir).where("kind = 'function'").select("node_id").distinct().join(surface, "node_id", "left")
    exposed = F.count_if(F.coalesce("exposed", F.lit(False)))
    return functions.agg(F.count("*").alias("functions"), exposed.alias("exposed"), F.round(exposed / F.count("*"), 6).alias("ratio"))


def code_path_hops(spark, sf_dir) -> DataFrame:
    e = edges(spark, sf_dir)
    return G.path_hops(G.shortest_paths(G.full_graph(e), entry_points(spark, sf_dir)), e)


def code_package_in_use(spark, sf_dir) -> DataFrame:
    """The dependency findings alone: class, path and blast radius."""
    f = findings(spark, sf_dir).where("package is not null").select("finding_id")
    return _evidence(spark, sf_dir).join(f, "finding_id").select("finding_id", "reachable", F.array_join("path", G.ARROW).alias("path"), "blast_radius")


def code_miss_classification(spark, sf_dir) -> DataFrame:
    """Calls found in the source files against those of the table, per repository, and why calls are missed."""
    files, facts = T._facts(spark, sf_dir)
    known = extract.file_nodes(files).unionByName(extract.def_nodes(facts))
    found = resolve.call_edges(resolve.resolve_sites(facts, files), known).where("dst_id is not null")
    category = F.split_part(F.regexp_replace("src", f"^{G.UNKNOWN}", ""), F.lit("/"), F.lit(1)).alias("category")
    emitted = found.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "resolved").select(category, "src", "dst", "resolved")
    truth = calls(spark, sf_dir).where("resolved").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst")).select(category, "src", "dst")
    return evaluate.edge_scores(emitted, truth, nodes(spark, sf_dir).select("node_id").distinct())


QUERIES = {
    f.__name__: f
    for f in (
        code_reachability, code_reachability_counts, code_ranked_topk, code_worst_by_file, code_reach_pairs, code_resolved_depth, code_shortest_paths, code_blast_radius, code_attack_surface, code_path_hops,
        code_package_in_use, code_miss_classification,
    )
}

SQL: dict[str, str] = {}
