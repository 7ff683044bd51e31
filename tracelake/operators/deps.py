"""Dependencies: what is installed, who needs it, what is deprecated or vulnerable, and how urgent an upgrade is."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import scalar as S
from tracelake.operators.reach import reach_rank

URGENCIES = ("urgent", "check", "routine", "migrate", "ok")


def import_names(dists: DataFrame) -> DataFrame:
    """``(dist, import_name)``: of ``top_level.txt``, else of the files in ``RECORD``, else the distribution's name."""
    lines = dists.select("dist", "file", F.explode(F.split("body", r"\r?\n")).alias("line")).withColumn("line", F.trim("line"))
    top = lines.where("file = 'top_level.txt' and line <> ''").select("dist", F.col("line").alias("import_name"), F.lit(1).alias("r"))
    path = F.split(F.split("line", ",")[0], "/")
    first = F.when(F.size(path) > 1, path[0]).when(path[0].endswith(".py"), F.regexp_replace(path[0], r"\.py$", ""))
    record = lines.where("file = 'RECORD'").select("dist", first.alias("import_name"), F.lit(2).alias("r"))
    record = record.where(F.col("import_name").rlike(r"^[A-Za-z_]\w*$"))
    own = dists.select("dist", S.import_name("dist").alias("import_name"), F.lit(3).alias("r"))
    every = top.unionByName(record).unionByName(own).distinct()
    best = every.groupBy("dist").agg(F.min("r").alias("r"))
    return every.join(best, ["dist", "r"]).select("dist", "import_name")


def installed_versions(dists: DataFrame) -> DataFrame:
    """``(package, version)`` by import name; the least version if distributions share a name."""
    versions = dists.select("dist", "version").distinct()
    return import_names(dists).join(versions, "dist").groupBy(F.col("import_name").alias("package")).agg(F.min("version").alias("version"))


def requirements(dists: DataFrame) -> DataFrame:
    """``(parent, name)`` of ``Requires-Dist`` lines without an extra marker."""
    lines = dists.where("file = 'METADATA'").select("dist", F.explode(F.split("body", r"\r?\n")).alias("line"))
    need = lines.where(F.col("line").rlike("^Requires-Dist:") & ~F.col("line").rlike(r"\bextra\s*=="))
    return need.select(F.col("dist").alias("parent"), S.canonical_name(F.regexp_extract("line", r"^Requires-Dist:\s*([A-Za-z0-9._-]+)", 1)).alias("name")).distinct()


def package_anchors(findings: DataFrame, names: DataFrame, refs: DataFrame, above: DataFrame | None = None) -> DataFrame:
    """``(finding_id, anchors, via)``: file nodes that import a finding's package, sorted; else those of what needs it.

    ``names(dist, import_name)``, ``refs(node_id, package)``, ``above(name, parent)`` the closure of requirements.
    """
    f = findings.select("finding_id", S.canonical_name("package").alias("dist"))
    users = names.join(refs.select(F.col("package").alias("import_name"), "node_id"), "import_name").select("dist", "node_id").distinct()
    fallback = f.select("dist").distinct().join(names.select("dist").distinct(), "dist", "left_anti").select("dist", S.import_name("dist").alias("package"))
    users = users.unionByName(fallback.join(refs.select("package", "node_id"), "package").select("dist", "node_id")).distinct()
    direct = f.join(users, "dist").groupBy("finding_id").agg(F.sort_array(F.collect_set("node_id")).alias("anchors"))
    empty = F.array().cast("array<string>")
    out = f.join(direct, "finding_id", "left")
    if above is not None:
        up = above.select(F.col("name").alias("dist"), F.col("parent")).join(users.select(F.col("dist").alias("parent"), "node_id"), "parent")
        indirect = f.join(up, "dist").groupBy("finding_id").agg(F.sort_array(F.collect_set("node_id")).alias("a2"), F.sort_array(F.collect_set("parent")).alias("v2"))
        out = out.join(indirect, "finding_id", "left")
        return out.select("finding_id", F.coalesce("anchors", "a2", empty).alias("anchors"), F.when(F.col("anchors").isNull(), F.coalesce("v2", empty)).otherwise(empty).alias("via"))
    return out.select("finding_id", F.coalesce("anchors", empty).alias("anchors"), empty.alias("via"))


def urgency(advisories: Column, worst: Column, deprecated: Column) -> Column:
    """An advisory that is reachable is urgent, one that may be is to be checked, one that is not is routine."""
    return (
        F.when((advisories > 0) & (worst == "reachable"), "urgent")
        .when((advisories > 0) & ((worst == "unknown") | worst.isNull()), "check")
        .when(advisories > 0, "routine")
        .when(deprecated > 0, "migrate")
        .otherwise("ok")
    )


def urgency_rank(c: Column) -> Column:
    return F.array_position(F.array(*(F.lit(u) for u in URGENCIES)), c)


def dependency_report(advisories: DataFrame, deprecated: DataFrame | None = None) -> DataFrame:
    """One row per package and installed version, most urgent first.

    ``advisories(package, package_version, rule_id, fixed_in, reachable)``: ``upgrade_to`` is the greatest of the fixes,
    ``unfixed`` counts advisories without one. ``deprecated(package, symbol)`` adds uses of deprecated names.
    """
    rows = advisories.withColumn("k", S.version_key("fixed_in"))
    per = rows.groupBy(S.canonical_name("package").alias("package"), "package_version").agg(
        F.countDistinct("rule_id").alias("n_advisories"),
        F.max_by("fixed_in", "k").alias("upgrade_to"),
        (F.countDistinct("rule_id") - F.countDistinct(F.when(F.col("k").isNotNull(), F.col("rule_id")))).alias("unfixed"),
        F.max_by("reachable", reach_rank(F.col("reachable"))).alias("worst"),
    )
    if deprecated is not None:
        uses = deprecated.groupBy(S.canonical_name("package").alias("package")).agg(F.count("*").alias("n_deprecated"), F.sort_array(F.collect_set("symbol")).alias("symbols"))
        per = per.join(uses, "package", "full")
    else:
        per = per.withColumn("n_deprecated", F.lit(0))
    n = F.coalesce("n_advisories", F.lit(0))
    out = per.withColumn("n_advisories", n).withColumn("n_deprecated", F.coalesce("n_deprecated", F.lit(0)))
    out = out.withColumn("urgency", urgency(F.col("n_advisories"), F.col("worst"), F.col("n_deprecated")))
    return out.orderBy(urgency_rank(F.col("urgency")), "package", "package_version")


def upgrade_report(advisories: DataFrame, refs: DataFrame, names: DataFrame, above: DataFrame, installed: DataFrame, deprecated: DataFrame) -> DataFrame:
    """What upgrading would cost, a row for each third-party package that is used, vulnerable or deprecated.

    ``advisories(package, package_version, rule_id, severity, fixed_in, reachable)``, ``refs(node_id, file_path, package)``
    by import name, ``names(dist, import_name)``, ``above(name, parent)`` the closure of requirements, ``installed(package,
    version)`` by distribution, ``deprecated(package, symbol, reachable)``: one row a call, package by distribution.

    ``version`` is the installed one, ``declared`` the advisories'; ``unfixed`` counts advisories without a fix,
    ``references`` imports and calls, ``files`` and ``users`` where they stand. A package that nothing imports runs ``via``
    those that need it and are imported, and has their files. ``pin_is_stale``: what is installed has the fix, what is
    declared has not. Advisories count once per rule, with the greatest fix and the worst class of their rows.
    """
    words = ("critical", "high", "medium", "low")
    rows = advisories.withColumn("name", S.canonical_name("package")).withColumn("k", S.version_key("fixed_in"))
    per_rule = rows.groupBy("name", "rule_id").agg(
        F.max_by("fixed_in", "k").alias("fixed_in"), F.max("k").alias("k"), F.max_by("reachable", reach_rank(F.col("reachable"))).alias("reachable"),
        F.max(F.struct(S.rank_of("severity", words).alias("r"), F.lower("severity").alias("s"))).alias("severity"), F.min("package_version").alias("declared"),
    )
    per = per_rule.groupBy("name").agg(
        F.count("*").alias("n_advisories"), F.max_by("fixed_in", "k").alias("upgrade_to"), F.count_if(F.col("k").isNull()).alias("unfixed"),
        F.max_by("reachable", reach_rank(F.col("reachable"))).alias("worst"), F.max("severity").alias("sev"), F.min("declared").alias("declared"),
    )
    dist_of = names.select(F.col("import_name").alias("package"), S.canonical_name("dist").alias("dist"))
    used = refs.select("node_id", "file_path", "package").join(dist_of, "package", "left").withColumn("name", F.coalesce("dist", S.canonical_name("package")))
    direct = used.groupBy("name").agg(F.count("*").alias("references"), F.countDistinct("file_path").alias("files"), F.countDistinct("node_id").alias("users"))
    up = above.select(S.canonical_name("name").alias("name"), S.canonical_name("parent").alias("parent"))
    through = up.join(used.select(F.col("name").alias("parent"), "file_path").distinct(), "parent").groupBy("name").agg(F.sort_array(F.collect_set("parent")).alias("via"), F.countDistinct("file_path").alias("via_files"))
    calls = deprecated.withColumn("name", S.canonical_name("package")).groupBy("name").agg(
        F.count("*").alias("n_deprecated"), F.sort_array(F.collect_set("symbol")).alias("symbols"),
        *(F.count_if(F.coalesce("reachable", F.lit("unknown")) == r).alias(f"deprecated_{r}") for r in ("reachable", "unknown", "unreachable")),
    )
    have = installed.groupBy(S.canonical_name("package").alias("name")).agg(F.min("version").alias("version"))
    out = per.join(direct, "name", "full").join(calls, "name", "full").join(through, "name", "left").join(have, "name", "left")
    counts = ["n_advisories", "unfixed", "references", "files", "users", "n_deprecated", "deprecated_reachable", "deprecated_unknown", "deprecated_unreachable"]
    out = out.na.fill(0, counts)
    alone = F.col("users") == 0
    empty = F.array().cast("array<string>")
    return out.select(
        F.col("name").alias("package"), F.coalesce("version", "declared").alias("version"), "declared", "n_advisories", F.col("sev.s").alias("worst_severity"), "upgrade_to", "unfixed", "worst",
        "references", F.when(alone, F.coalesce("via_files", F.lit(0))).otherwise(F.col("files")).alias("files"), "users", F.when(alone, F.coalesce("via", empty)).otherwise(empty).alias("via"),
        *counts[5:], F.coalesce("symbols", empty).alias("symbols"), F.coalesce(pin_is_stale(F.col("version"), F.col("upgrade_to"), F.col("declared")), F.lit(False)).alias("pin_is_stale"),
        urgency(F.col("n_advisories"), F.col("worst"), F.col("n_deprecated")).alias("urgency"),
    )


def upgrade_summary(report: DataFrame) -> DataFrame:
    """One row over ``upgrade_report``: packages, how many of each urgency, deprecated calls by class."""
    return report.agg(
        F.count("*").alias("packages"), *(F.count_if(F.col("urgency") == u).alias(u) for u in URGENCIES[:-1]),
        *(F.coalesce(F.sum(f"deprecated_{r}"), F.lit(0)).alias(f"deprecated_{r}") for r in ("reachable", "unknown", "unreachable")),
    )


#: What every report of upgrades says of itself.
UPGRADE_NOTE = "upgrade_to is the least version with the listed fixes, not the latest release"


def upgrade_payload(report: DataFrame, scan: DataFrame, checked: DataFrame, unresolved: int) -> DataFrame:
    """One JSON document, as rows ``(part, no, body)`` in order, so that no task holds all packages: summary, scan status
    (``scan(status, detail)``, none if it did not run), ``checked(checked, deprecated, no_source)``, note, then packages."""
    status = F.struct("status", "detail")
    check = F.to_json(F.struct("checked", "deprecated", "no_source", F.lit(unresolved).alias("unresolved_calls")))
    head = (
        upgrade_summary(report).select(F.lit("summary").alias("part"), F.lit(0).cast("bigint").alias("no"), F.to_json(F.struct("*")).alias("body"))
        .unionByName(scan.select(F.lit("osv").alias("part"), F.lit(0).cast("bigint").alias("no"), F.to_json(status).alias("body")))
        .unionByName(checked.select(F.lit("deprecation_check").alias("part"), F.lit(0).cast("bigint").alias("no"), check.alias("body")))
        .unionByName(report.sparkSession.range(1).select(F.lit("upgrade_note").alias("part"), F.lit(0).cast("bigint").alias("no"), F.to_json(F.struct(F.lit(UPGRADE_NOTE).alias("text"))).alias("body")))
    )
    order = F.concat_ws(" ", urgency_rank(F.col("urgency")).cast("string"), "package")
    packages = report.select(F.lit("package").alias("part"), F.xxhash64("package").alias("no"), F.to_json(F.struct(order.alias("order"), *report.columns)).alias("body"))
    return head.unionByName(packages)


def pin_is_stale(installed: Column, upgrade_to: Column, pin: Column) -> Column:
    """Whether the environment has the fix already while the declared pin is below it."""
    return (S.version_key(installed) >= S.version_key(upgrade_to)) & (S.version_key(pin) < S.version_key(upgrade_to))


_WARNS = re.compile(r"(?:Pending)?DeprecationWarning|FutureWarning|RemovedIn\w+Warning")
_HELPERS = frozenset(["deprecate", "_deprecated", "warn_deprecated"])


def deprecation_marker(source: str, line: int) -> dict | None:
    """What the library itself says of the def at ``line``: ``kind``, ``category``, ``message``, ``conditional``; or null.

    A marking decorator, a deprecation warning or helper call in the body, or an unconditional warning of the module. A
    warning below ``if`` or ``except`` is conditional. The text is parsed, never run.
    """
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return None
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and node.lineno == line:
            for d in node.decorator_list:
                call = d.func if isinstance(d, ast.Call) else d
                name = call.attr if isinstance(call, ast.Attribute) else getattr(call, "id", "")
                if name == "deprecated":
                    text = d.args[0].value if isinstance(d, ast.Call) and d.args and isinstance(d.args[0], ast.Constant) else None
                    return {"kind": "decorator", "category": "DeprecationWarning", "message": text, "conditional": False}
            return _warning(node.body, False, "warning")
    return _warning([s for s in tree.body if not isinstance(s, (ast.FunctionDef, ast.ClassDef, ast.AsyncFunctionDef))], False, "module", module=True)


def _warning(body: list, conditional: bool, kind: str, module: bool = False) -> dict | None:
    for s in body:
        if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            continue
        if isinstance(s, ast.Expr) and isinstance(s.value, ast.Call):
            call = s.value
            name = call.func.attr if isinstance(call.func, ast.Attribute) else getattr(call.func, "id", "")
            category = next((ast.unparse(a) for a in [*call.args[1:], *(k.value for k in call.keywords)] if _WARNS.search(ast.unparse(a))), None)
            if (name == "warn" and category) or name in _HELPERS:
                text = call.args[0].value if call.args and isinstance(call.args[0], ast.Constant) else None
                return {"kind": kind, "category": category, "message": text, "conditional": conditional}
        inner = [getattr(s, f, []) for f in ("body", "orelse", "finalbody")] + [h.body for h in getattr(s, "handlers", [])]
        for block in inner:
            if block and not module:
                found = _warning(block, conditional or isinstance(s, (ast.If, ast.Try)), kind)
                if found:
                    return found
    return None


def with_versions(refs: DataFrame, versions: DataFrame) -> DataFrame:
    """``refs`` with the installed version of their package; null for the standard library or without an environment."""
    return refs.join(versions.select("package", "version"), "package", "left")


def deprecated_uses(uses: DataFrame, markers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Uses of external definitions that their library marks, and how many were checked.

    ``uses(node_id, line, package, symbol, def_path, def_line)`` (a null path: no source at hand), ``markers(def_path,
    def_line, kind, category, message, conditional)``.
    """
    j = uses.join(markers, ["def_path", "def_line"], "left")
    found = j.where(F.col("kind").isNotNull()).select("node_id", "line", "package", "symbol", F.struct("kind", "category", "message", "conditional").alias("marker"))
    stats = j.agg(F.count("*").alias("checked"), F.count_if(F.col("kind").isNotNull()).alias("deprecated"), F.count_if(F.col("def_path").isNull()).alias("no_source"))
    return found, stats


def read_markers(sources: DataFrame) -> DataFrame:
    """Deprecation markers of ``sources(def_path, def_line, content)``; the texts are parsed, never run."""

    def run(batches):
        for b in batches:
            rows = []
            for path, line, text in zip(b["def_path"], b["def_line"], b["content"], strict=True):
                m = deprecation_marker(text, line) if text is not None else None
                if m:
                    rows.append((path, line, m["kind"], m["category"], m["message"] if isinstance(m["message"], str) else None, m["conditional"]))
            yield pd.DataFrame(rows, columns=["def_path", "def_line", "kind", "category", "message", "conditional"])

    return sources.select("def_path", "def_line", "content").mapInPandas(run, "def_path string, def_line int, kind string, category string, message string, conditional boolean")


def payload(report: DataFrame) -> DataFrame:
    """The dependency report as JSON, one object a package, with its place in the order."""
    return report.select("package", F.to_json(F.struct("*")).alias("entry"))
