"""Findings and call sites to graph nodes: interval joins, identifiers, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import scalar as S


def innermost(sites: DataFrame, spans: DataFrame, site_key: str = "site_id", last: bool = False) -> DataFrame:
    """Each site with the innermost span of its file that holds its line, or none: left outer interval join.

    ``sites(site_key, file_path, line, ...)``, ``spans(node_id, file_path, start_line, end_line, ordinal)``. Of the spans
    with the greatest start, the one with the least ordinal counts (``last``: the greatest). The file is the equi key, so
    this is a hash join with a residual; one partial aggregate picks the span, no sort of all pairs.
    """
    s = spans.select(F.col("file_path").alias("_f"), F.col("start_line").alias("_a"), F.col("end_line").alias("_b"), F.col("node_id").alias("_n"), F.col("ordinal").alias("_o"))
    pairs = sites.select(site_key, "file_path", "line").join(s, (F.col("file_path") == F.col("_f")) & F.col("line").between(F.col("_a"), F.col("_b")))
    order = F.struct("_a", F.col("_o") if last else -F.col("_o"))
    best = pairs.groupBy(site_key).agg(F.max_by("_n", order).alias("node_id"))
    return sites.join(best, site_key, "left")


def parent_defs(nodes: DataFrame) -> DataFrame:
    """``(parent_id, child_id)``: the def whose qualified name is the child's prefix and whose span holds it, else the file."""
    defs = nodes.where("kind <> 'file'")
    prefix = F.regexp_extract("qualified_name", r"^(.*)\.[^.]*$", 1)
    child = defs.select(F.col("node_id").alias("child_id"), "file_path", prefix.alias("prefix"), F.col("start_line").alias("a"), F.col("end_line").alias("b"))
    parent = defs.select(F.col("file_path").alias("_f"), F.col("qualified_name").alias("_q"), F.col("start_line").alias("_a"), F.col("end_line").alias("_b"), F.col("node_id").alias("_n"), F.col("ordinal").alias("_o"))
    hold = (F.col("file_path") == F.col("_f")) & (F.col("prefix") == F.col("_q")) & (F.col("_a") <= F.col("a")) & (F.col("_b") >= F.col("b")) & (F.col("_n") != F.col("child_id"))
    first = child.join(parent, hold, "left").groupBy("child_id", "file_path").agg(F.min_by("_n", "_o").alias("parent"))
    files = nodes.where("kind = 'file'").groupBy(F.col("file_path").alias("file_path")).agg(F.min("node_id").alias("file_node"))
    return first.join(files, "file_path", "left").select(F.coalesce("parent", "file_node").alias("parent_id"), "child_id")


def with_occurrence(rows: DataFrame, basis: list[str], order: list[str]) -> DataFrame:
    """``occurrence``: which one of the rows with this basis a row is, in ``order``, from 0."""
    w = Window.partitionBy(*basis).orderBy(*order)
    return rows.withColumn("occurrence", F.row_number().over(w) - 1)


def finding_ids(rows: DataFrame) -> DataFrame:
    """``finding_id`` of located findings, by content: never a path or line where the code itself is known.

    ``rows`` has source, rule_id, rel_path, source_hash (null outside Python), line_text, package, package_version,
    line and scan_ordinal. Dependency findings have no occurrence number: one advisory in two manifests is one id.
    """
    basis = F.coalesce("source_hash", "rel_path")
    numbered = with_occurrence(
        rows.withColumn("_basis", basis), ["source", "rule_id", "_basis", "line_text"], ["rel_path", "line", "source", "rule_id", "scan_ordinal"]
    )
    code = S.joined_hash("source", "rule_id", "_basis", "line_text", F.col("occurrence").cast("string"))
    package = S.joined_hash("source", "rule_id", S.canonical_name("package"), "package_version")
    return numbered.withColumn("finding_id", F.when(F.col("package").isNotNull(), package).otherwise(code)).drop("_basis")


STATUSES = ("to_def", "to_file", "to_package", "via_dependency", "unmapped", "non_python", "unused_dependency", "dependency_unknown")


def mapping_status(package: Column, anchors: Column, via: Column, node_kind: Column, python: Column, environment: Column) -> Column:
    """One class per finding, so that the counters of a scan are disjoint.

    ``anchors`` and ``via`` count the files that use a dependency and the packages it is needed by; ``environment`` says
    whether the installed distributions are known, without which a dependency that nothing imports may still be used.
    """
    return (
        F.when(package.isNotNull() & (anchors > 0) & (via > 0), "via_dependency")
        .when(package.isNotNull() & (anchors > 0), "to_package")
        .when(package.isNotNull() & environment, "unused_dependency")
        .when(package.isNotNull(), "dependency_unknown")
        .when(~python, "non_python")
        .when(node_kind == "file", "to_file")
        .when(node_kind.isNotNull(), "to_def")
        .otherwise("unmapped")
    )


def mapping_stats(rows: DataFrame) -> DataFrame:
    """Counters over ``rows(status)``: each status, mapped, mappable, their ratio (1.0 if nothing is mappable)."""
    mapped = F.count_if(F.col("status").isin("to_def", "to_file", "to_package", "via_dependency"))
    mappable = F.count_if(~F.col("status").isin("non_python", "unused_dependency", "dependency_unknown"))
    return rows.agg(
        F.count("*").alias("total"),
        *(F.count_if(F.col("status") == s).alias(s) for s in STATUSES),
        mapped.alias("mapped"),
        mappable.alias("mappable"),
        F.when(mappable == 0, 1.0).otherwise(mapped / mappable).alias("ratio"),
    )


def duplicate_groups(rows: DataFrame) -> DataFrame:
    """``(anchor, weakness, line, members)``: findings about the same thing; nothing is deleted.

    Findings of a package version group by rule; others by node (or path), CWE (or source and rule) and line.
    """
    package = F.concat(F.lit("pkg:"), "package", F.lit("@"), F.coalesce("package_version", F.lit("")))
    anchor = F.when(F.col("package").isNotNull(), package).otherwise(F.coalesce("node_id", "rel_path"))
    weakness = F.when(F.col("package").isNotNull(), F.col("rule_id")).otherwise(F.coalesce("cwe", F.concat_ws(":", "source", "rule_id")))
    line = F.when(F.col("package").isNotNull(), 0).otherwise(F.col("line"))
    return rows.groupBy(anchor.alias("anchor"), weakness.alias("weakness"), line.alias("line")).agg(
        F.sort_array(F.collect_list("finding_id")).alias("members"), F.countDistinct("source").alias("n_sources")
    )


def cross_scanner_duplicates(groups: DataFrame) -> DataFrame:
    """How many findings repeat what another scanner said."""
    return groups.where("n_sources > 1").agg(F.coalesce(F.sum(F.size("members") - 1), F.lit(0)).alias("duplicates"))


def line_text(content: Column, line: Column) -> Column:
    """Line ``line`` (from 1) without outer blanks, '' if the text has no such line."""
    lines = F.split(content, r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]")
    return F.coalesce(F.trim(F.get(lines, line - 1)), F.lit(""))


def snippet(content: Column, start: Column, end: Column, cap: int = 60, more: bool = False) -> Column:
    """Lines ``start`` to ``end`` joined, ``cap`` at most; with ``more`` a last line says how many were left out."""
    lines = F.split(content, "\n")
    n = F.least(end, start + F.lit(cap - 1)) - start + 1
    text = F.array_join(F.slice(lines, F.greatest(start, F.lit(1)), F.greatest(n, F.lit(0))), "\n")
    left = end - start + 1 - cap
    return F.when(left > 0, F.concat(text, F.lit("\n# ... "), left.cast("string"), F.lit(" more lines"))).otherwise(text) if more else text


def code_of(content: Column, kind: Column, start: Column, end: Column, line: Column, around: int = 5) -> Column:
    """Code to show for a finding: its definition, or the lines around it where it stands in a file's own code."""
    inner = snippet(content, start, end)
    outer = snippet(content, F.greatest(line - around, F.lit(1)), line + around)
    return F.when(kind != "file", inner).otherwise(outer)
