"""What an incremental change touches: node differences, renames, invalid paths and recomputed findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators import graph as G


def file_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(path, kind, old_path)`` between two states ``(rel_path, content_hash)``: added, modified, deleted, renamed.

    A deleted and an added file of one hash are a rename, if the hash is unique among both. A null hash equals only null.
    """
    o = old.select("rel_path", F.col("content_hash").alias("before"), F.lit(True).alias("was"))
    n = new.select("rel_path", F.col("content_hash").alias("after"), F.lit(True).alias("now"))
    both = o.join(n, "rel_path", "full")
    kind = (
        F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(~F.col("before").eqNullSafe(F.col("after")), "modified")
    )
    changed = both.withColumn("kind", kind).where(F.col("kind").isNotNull())
    gone = changed.where("kind = 'deleted'").groupBy(F.col("before").alias("h")).agg(F.min("rel_path").alias("old_path"), F.count("*").alias("n1"))
    came = changed.where("kind = 'added'").groupBy(F.col("after").alias("h")).agg(F.min("rel_path").alias("path"), F.count("*").alias("n2"))
    moved = gone.join(came, "h").where("n1 = 1 and n2 = 1").select("path", F.lit("renamed").alias("kind"), "old_path")
    rest = (
        changed.join(moved.select(F.col("path").alias("rel_path")), "rel_path", "left_anti")
        .join(moved.select(F.col("old_path").alias("rel_path")), "rel_path", "left_anti")
        .select(F.col("rel_path").alias("path"), "kind", F.lit(None).cast("string").alias("old_path"))
    )
    return rest.unionByName(moved)


def node_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(file_path, qualified_name, old_id, new_id, source_hash, status)``: unchanged, modified, added or deleted by the
    stable key (file, qualified name); a def that merely moved down its file is unchanged."""
    o = old.select("file_path", "qualified_name", F.col("node_id").alias("old_id"), F.col("source_hash").alias("h1"), F.col("kind").alias("k1"))
    n = new.select("file_path", "qualified_name", F.col("node_id").alias("new_id"), F.col("source_hash").alias("h2"), F.col("kind").alias("k2"))
    status = (
        F.when(F.col("old_id").isNull(), "added").when(F.col("new_id").isNull(), "deleted").when(F.col("h1").eqNullSafe(F.col("h2")), "unchanged").otherwise("modified")
    )
    return o.join(n, ["file_path", "qualified_name"], "full").select(
        "file_path", "qualified_name", "old_id", "new_id", F.coalesce("h2", "h1").alias("source_hash"), F.coalesce("k2", "k1").alias("kind"), status.alias("status")
    )


def renames(diff: DataFrame) -> DataFrame:
    """``(old_id, new_id)``: deleted and added defs with the same source.

    Groups share a source hash. Pairs in the same file, then of the same name, are taken by rank joins, which any size
    of group stands; what is left of a group is paired in order of the ids, by rank as well.
    """
    gone = diff.where("status = 'deleted' and kind <> 'file'").select("source_hash", "file_path", "qualified_name", F.col("old_id").alias("id"))
    came = diff.where("status = 'added' and kind <> 'file'").select("source_hash", "file_path", "qualified_name", F.col("new_id").alias("id"))
    pairs = None
    for key in (["source_hash", "file_path"], ["source_hash", "qualified_name"], ["source_hash"]):
        w = Window.partitionBy(*key).orderBy("id")
        a = gone.withColumn("rn", F.row_number().over(w)).select(*key, "rn", F.col("id").alias("old_id"))
        b = came.withColumn("rn", F.row_number().over(w)).select(*key, "rn", F.col("id").alias("new_id"))
        found = a.join(b, [*key, "rn"]).select("old_id", "new_id")
        pairs = found if pairs is None else pairs.unionByName(found)
        gone = gone.join(found.select(F.col("old_id").alias("id")), "id", "left_anti")
        came = came.join(found.select(F.col("new_id").alias("id")), "id", "left_anti")
    return pairs


def splice(edges: DataFrame, fresh: DataFrame, diff: DataFrame, renamed: DataFrame, dirty_files: DataFrame) -> DataFrame:
    """Edges after a change: those that start in untouched files, with renamed ends, and ``fresh`` ones of dirty files.

    ``edges(src_id, src_file, dst_id, kind, resolved)``. All kinds of edges of a dirty file are rebuilt, so the result is
    that of a full index.
    """
    kept = edges.join(dirty_files.select(F.col("path").alias("src_file")), "src_file", "left_anti")
    moved = diff.where("old_id is not null and new_id is not null and old_id <> new_id").select("old_id", "new_id").unionByName(renamed)
    deleted = diff.where("status = 'deleted'").select(F.col("old_id").alias("dst_id")).join(moved.select(F.col("old_id").alias("dst_id")), "dst_id", "left_anti")
    ends = kept.join(moved.select(F.col("old_id").alias("dst_id"), "new_id"), "dst_id", "left")
    kept = ends.withColumn("dst_id", F.coalesce("new_id", "dst_id")).drop("new_id").join(deleted, "dst_id", "left_anti")
    return kept.select("src_id", "src_file", "dst_id", "kind", "resolved").unionByName(fresh.select("src_id", "src_file", "dst_id", "kind", "resolved"))


def invalid_paths(evidence: DataFrame, dirty: DataFrame, new_edges: DataFrame) -> DataFrame:
    """``(finding_id)`` of evidence that a change may overturn: its path is empty, holds a dirty node, or has a new edge
    into it from outside. Paths are exploded and matched by joins; no list of dirty nodes is broadcast."""
    empty = evidence.where(F.size("path") == 0).select("finding_id")
    steps = evidence.select("finding_id", "path", F.explode("path").alias("node_id"))
    touched = steps.join(dirty.select("node_id").distinct(), "node_id", "left_semi").select("finding_id")
    into = steps.join(new_edges.select("src_id", F.col("dst_id").alias("node_id")), "node_id").where(~F.array_contains("path", F.col("src_id"))).select("finding_id")
    return empty.unionByName(touched).unionByName(into).distinct()


def affected_targets(targets: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """``(finding_id)`` of targets that a change of edges can touch at all."""
    return targets.join(affected_nodes(old, new), "node_id", "left_semi").select("finding_id").distinct()


def affected_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(node_id)`` of nodes behind an end of a changed edge.

    ``old`` and ``new`` are graphs ``(src_id, dst_id, resolved)``. No way to any other node leads over a changed edge, so its
    class, path and radius stay. Exact, where ``invalid_paths`` looks at the known paths only.
    """
    both = old.withColumn("side", F.lit(1)).unionByName(new.withColumn("side", F.lit(2))).groupBy("src_id", "dst_id").agg(F.count("*").alias("n"), F.min("resolved").alias("a"), F.max("resolved").alias("b"))
    both = G.cut(both)
    changed = both.where((F.col("n") < 2) | (F.col("a") != F.col("b")))
    ends = changed.select(F.explode(F.array("src_id", "dst_id")).alias("node_id")).distinct()
    return G.reached(both, ends)


def update_findings(previous: DataFrame, nodes: DataFrame, renamed: DataFrame, rescanned: DataFrame, fresh: DataFrame, affected: DataFrame, recompute) -> tuple[DataFrame, DataFrame]:
    """Findings after a change, and how many were ``reused``, ``invalidated``, ``new`` and ``dropped``.

    ``previous(finding_id, rel_path, node_id, reachable, path, blast_radius)``; ``nodes(node_id)`` of now;
    ``renamed(old_id, new_id)``; ``rescanned(rel_path)``: files whose findings ``fresh(finding_id, rel_path, node_id)``
    replaces; ``affected(node_id)``: nodes behind an end of a changed edge. Ids in nodes and paths follow renames; a finding
    whose node is gone is dropped; one without evidence, or at an affected node, is computed anew by
    ``recompute(targets)``, which gives (finding_id, reachable, path, blast_radius); the others keep their evidence.
    """
    r = renamed.select("old_id", "new_id").distinct()
    kept = previous.join(rescanned.select("rel_path").distinct(), "rel_path", "left_anti")
    moved = kept.join(r.withColumnRenamed("old_id", "node_id"), "node_id", "left").withColumn("node_id", F.coalesce("new_id", "node_id")).drop("new_id")
    alive = G.cut(moved.join(nodes.select("node_id").distinct().withColumn("_there", F.lit(True)), "node_id", "left").where(F.col("node_id").isNull() | F.col("_there")).drop("_there"))
    hit = affected.select("node_id").distinct().withColumn("_hit", F.lit(True))
    marked = alive.join(hit, "node_id", "left").withColumn("_again", F.coalesce("_hit", F.lit(False)) | F.col("node_id").isNull() | F.col("reachable").isNull()).drop("_hit")
    steps = marked.where(~F.col("_again")).select("finding_id", F.posexplode("path").alias("at", "old_id")).join(r, "old_id", "left")
    paths = steps.groupBy("finding_id").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("new_id", "old_id").alias("id")))).alias("p"))
    columns = ["finding_id", "rel_path", "node_id", "reachable", "path", "blast_radius"]
    path = F.coalesce(F.transform("p", lambda x: x["id"]), F.array().cast("array<string>"))
    reused = marked.where(~F.col("_again")).drop("path").join(paths, "finding_id", "left").withColumn("path", path).select(*columns)
    again = marked.where("_again").select("finding_id", "rel_path", "node_id", F.lit("invalidated").alias("_state")).unionByName(fresh.select("finding_id", "rel_path", "node_id", F.lit("new").alias("_state")))
    again = G.cut(again)
    computed = again.join(recompute(again.select("finding_id", "node_id")), "finding_id").select(*columns)
    counts = (
        previous.agg(F.count("*").alias("all")).select(F.lit("all").alias("state"), F.col("all").alias("n"))
        .unionByName(reused.agg(F.count("*").alias("n")).select(F.lit("reused").alias("state"), "n"))
        .unionByName(again.groupBy(F.col("_state").alias("state")).agg(F.count("*").alias("n")))
    )
    total = F.sum(F.when(F.col("state") == "all", F.col("n")).otherwise(0))
    one = {s: F.sum(F.when(F.col("state") == s, F.col("n")).otherwise(0)) for s in ("reused", "invalidated", "new")}
    counts = counts.agg(*(v.alias(k) for k, v in one.items()), (total - one["reused"] - one["invalidated"]).alias("dropped"))
    return reused.unionByName(computed), counts


def update_evidence(evidence: DataFrame, targets: DataFrame, invalid: DataFrame, recompute) -> DataFrame:
    """``evidence`` with the findings of ``invalid`` (and those without evidence) computed anew by ``recompute(targets)``."""
    kept = evidence.join(invalid, "finding_id", "left_anti")
    missing = targets.join(kept.select("finding_id"), "finding_id", "left_anti")
    return kept.unionByName(recompute(missing).select(kept.columns))
