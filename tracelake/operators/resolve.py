"""What names of Python files refer to in other files: imports to modules, sites to definitions, by joins over facts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.core import cut
from tracelake.functions import scalar as S
from tracelake.operators import extract
from tracelake.operators.locate import innermost
from tracelake.operators.scopes import BUILTIN_CLASSES

#: Builtins whose call runs code that can't be known from the text.
DYNAMIC = ("eval", "exec")
KEY = ["rel_path", "ordinal"]


def module_index(files: DataFrame, root: str | None = None) -> DataFrame:
    """``(alias, rel_path)``: names under which a file can be imported, one file a name: source before stub, then path.

    With ``root``, the name of a package that the files lie in, modules can be imported under it too.
    """
    python = files.where(F.col("rel_path").rlike(r"\.pyi?w?$")).select("rel_path", S.module_name("rel_path").alias("m"))
    below = F.when(F.col("m") == "", F.lit(root)).otherwise(F.concat(F.lit(root), F.lit("."), F.col("m"))) if root else F.lit(None).cast("string")
    names = F.array_distinct(F.array_compact(F.array(F.nullif("m", F.lit("")), F.nullif(F.regexp_replace("m", r"^src\.", ""), F.lit("")), below)))
    rows = python.select("rel_path", F.posexplode(names).alias("n", "alias"))
    order = F.struct("n", (~F.col("rel_path").endswith(".py")).alias("stub"), "rel_path")
    return rows.groupBy("alias").agg(F.min_by("rel_path", order).alias("rel_path"))


def import_targets(facts: DataFrame, files: DataFrame, root: str | None = None) -> DataFrame:
    """``(rel_path, ordinal, kind, name, text, base, target, submodule, lost, alias)`` of each imported name.

    A sibling of the importing file comes first, then an exact module; ``from`` imports try the name as a submodule, which
    ``submodule`` tells. What is relative, or has a top-level name of the repository, is ``lost`` without a target.
    """
    index = module_index(files, root)
    tops = index.select(S.first_part("alias").alias("top")).distinct().withColumn("own", F.lit(True))
    i = facts.where("fact = 'import'").select(*KEY, "kind", "name", "text", "level", "alias").withColumn("folder", S.folder_of("rel_path"))
    package = F.translate("folder", "/", ".")
    i = i.withColumn("base", S.absolute_module(package, "text", "level"))
    sibling = F.when((F.col("level") == 0) & (F.col("folder") != ""), F.concat_ws(".", package, F.nullif("base", F.lit(""))))
    named = F.col("kind") == "from"
    tries = F.array(
        F.struct(F.lit(0).alias("r"), F.when(named, F.concat_ws(".", sibling, "name")).alias("alias")),
        F.struct(F.lit(1).alias("r"), sibling.alias("alias")),
        F.struct(F.lit(2).alias("r"), F.when(named, F.concat_ws(".", F.nullif("base", F.lit("")), "name")).alias("alias")),
        F.struct(F.lit(3).alias("r"), F.nullif("base", F.lit("")).alias("alias")),
    )
    found = (
        i.select(*KEY, F.explode(tries).alias("t"))
        .select(*KEY, F.col("t.r").alias("r"), F.col("t.alias").alias("alias"))
        .join(index.withColumnRenamed("rel_path", "target"), "alias")
        .groupBy(*KEY)
        .agg(F.min(F.struct("r", "target")).alias("f"))
        .select(*KEY, F.col("f.target").alias("target"), F.col("f.r").isin(0, 2).alias("submodule"))
    )
    joined = i.join(found, KEY, "left").join(tops, S.first_part("base") == F.col("top"), "left")
    lost = F.col("target").isNull() & ((F.col("level") > 0) | F.coalesce("own", F.lit(False)) | F.col("base").isNull())
    return joined.select(*KEY, "kind", "name", "text", "base", "target", F.coalesce("submodule", F.lit(False)).alias("submodule"), lost.alias("lost"), "alias")


def import_edges(targets: DataFrame) -> DataFrame:
    """``(src_id, dst_id, kind, resolved)`` between files; a lost module becomes an unknown target."""
    inside = F.col("target").isNotNull()
    return targets.where((inside & (F.col("target") != F.col("rel_path"))) | F.col("lost")).select(
        F.concat("rel_path", F.lit("::<file>")).alias("src_id"),
        F.when(inside, F.concat("target", F.lit("::<file>"))).otherwise(F.concat(F.lit("unknown::"), F.coalesce("base", "text", F.lit("")))).alias("dst_id"),
        F.lit("imports").alias("kind"),
        inside.alias("resolved"),
    ).distinct()


def external_refs(targets: DataFrame) -> DataFrame:
    """``(node_id, package, symbol, alias)``: what files import from elsewhere."""
    outside = targets.where(F.col("target").isNull() & ~F.col("lost") & (S.first_part("base") != "__future__"))
    return outside.select(
        F.concat("rel_path", F.lit("::<file>")).alias("node_id"), S.first_part("base").alias("package"), F.when((F.col("kind") == "from") & (F.col("name") != "*"), F.col("name")).alias("symbol"), "alias"
    ).distinct()


def resolve_imports(facts: DataFrame, files: DataFrame, root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Import edges and references to other code."""
    t = import_targets(facts, files, root)
    return import_edges(t), external_refs(t)


@dataclass
class Sites:
    """``rows``: rel_path, ordinal, fact, to (a node's id where the site leads to one), how (internal, external or unknown),
    package and symbol (of external code), is_class."""

    rows: DataFrame


def resolve_sites(facts: DataFrame, files: DataFrame, root: str | None = None) -> Sites:
    """Calls, bases and views to what they lead to.

    A reference that leaves its file goes to the module that its own import names. There it is a definition, or a name that
    leads on: to another module, to another name, or, for a method that a class lacks, to the class's bases. Every round
    follows all references by one such step; a reference that comes back to where it was is dropped, so rounds end.
    """
    targets = cut(import_targets(facts, files, root))
    defs = cut(extract.def_nodes(facts).select(F.col("file_path").alias("module"), F.col("qualified_name").alias("symbol"), "node_id", "kind", "ordinal"))
    last = defs.groupBy("module", "symbol").agg(F.max_by(F.struct("node_id", "kind"), "ordinal").alias("d")).select("module", "symbol", "d.node_id", "d.kind")
    asked = facts.where(F.col("fact").isin("call", "base", "view")).select(*KEY, "fact", F.posexplode_outer("refs").alias("rank", "ref"))
    asked = cut(asked.select(*KEY, "fact", F.coalesce("rank", F.lit(0)).alias("rank"), "ref.*"))
    here = asked.where("how = 'local'").select(*KEY, "rank", F.col("node").alias("to")).join(defs.select(F.col("node_id").alias("to"), "kind").distinct(), "to")
    begun = asked.where(F.col("ord").isNotNull()).select(*KEY, "rank", "how", "ord", "path")
    onward, outside = _through_imports(begun, targets, KEY)
    state = cut(onward.select(*KEY, "rank", "module", "symbol", F.array(F.concat_ws("#", "module", "symbol")).alias("seen")))
    links = cut(_links(facts, targets, module_index(files, root)))
    found = here
    while not state.isEmpty():
        hit = state.join(last, ["module", "symbol"])
        found = found.unionByName(hit.select(*KEY, "rank", F.col("node_id").alias("to"), "kind"))
        open_ = state.join(last.select("module", "symbol"), ["module", "symbol"], "left_anti")
        # A name of the module, or the class before the last dot: what stands for them there.
        heads = F.array(
            F.struct(S.first_part("symbol").alias("of"), F.lit("export").alias("fact"), F.regexp_extract("symbol", r"^[^.]+\.(.+)$", 1).alias("rest")),
            F.struct(F.lit("*").alias("of"), F.lit("export").alias("fact"), F.col("symbol").alias("rest")),
            F.struct(F.regexp_extract("symbol", r"^(.+)\.[^.]+$", 1).alias("of"), F.lit("base").alias("fact"), S.last_part("symbol").alias("rest")),
        )
        step = open_.select(*KEY, "rank", "seen", "module", F.explode(heads).alias("h")).select(*KEY, "rank", "seen", "module", "h.*")
        new = step.join(links, ["module", "of", "fact"]).select(
            *KEY, "rank", "seen", F.col("to_module").alias("module"), F.concat_ws(".", F.nullif("to_symbol", F.lit("")), F.nullif("rest", F.lit(""))).alias("symbol"), "package"
        )
        outside = outside.unionByName(new.where("package is not null").select(*KEY, "rank", "package", "symbol"))
        place = F.concat_ws("#", "module", "symbol")
        new = new.where("module is not null and symbol <> ''").where(~F.array_contains("seen", place))
        state = cut(new.select(*KEY, "rank", "module", "symbol", F.array_append("seen", place).alias("seen")).distinct())
    inner = found.groupBy(*KEY).agg(F.min(F.struct("rank", "to", "kind")).alias("i"))
    outer = outside.groupBy(*KEY).agg(F.min(F.struct("rank", "package", "symbol")).alias("o"))
    own = asked.where("how = 'builtin'").groupBy(*KEY).agg(F.min("node").alias("builtin"))
    one = facts.where(F.col("fact").isin("call", "base", "view")).select(*KEY, "fact", F.col("kind").alias("site"), "line", "name", "col")
    j = one.join(inner, KEY, "left").join(outer, KEY, "left").join(own, KEY, "left")
    known, package = F.col("i").isNotNull(), F.col("o").isNotNull()
    how = F.when(known, "internal").when(package, "external").when(F.col("builtin").isNotNull() & ~F.col("builtin").isin(*DYNAMIC), "external").otherwise("unknown")
    title = S.last_part("o.symbol").rlike("^_*[A-Z]")
    is_class = F.when(known, F.col("i.kind") == "class").when(package, F.coalesce(title, F.lit(False))).otherwise(F.coalesce(F.col("builtin").isin(*BUILTIN_CLASSES), F.lit(False)))
    rows = j.select(*KEY, "fact", "site", "line", "name", "col", F.col("i.to").alias("to"), how.alias("how"), F.when(~known, F.col("o.package")).alias("package"), F.when(~known, F.col("o.symbol")).alias("symbol"), is_class.alias("is_class"))
    return Sites(cut(rows))


def _through_imports(refs: DataFrame, targets: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(*keep, rank, module, symbol)`` of references into files of the repository, ``(*keep, rank, package, symbol)`` of others."""
    t = targets.select("rel_path", F.col("ordinal").alias("ord"), "kind", F.col("name").alias("imported"), F.col("text").alias("module_text"), "base", "target", "submodule", "lost", "alias")
    j = refs.join(t, ["rel_path", "ord"])
    dots = F.substring_index("module_text", ".", 1) == F.col("alias")  # import a.b binds a; the path then repeats b
    tail = F.regexp_extract("module_text", r"^[^.]+\.(.+)$", 1)
    path = F.when(dots & (tail != "") & F.startswith(F.concat("path", F.lit(".")), F.concat(tail, F.lit("."))), F.substring(F.col("path"), F.length(tail) + 2, 1_000_000)).otherwise(F.col("path"))
    symbol = (
        F.when(F.col("how") == "module", path)
        .when(F.col("how") == "star", F.col("path"))
        .when(F.col("submodule"), F.col("path"))
        .otherwise(F.concat_ws(".", "imported", F.nullif("path", F.lit(""))))
    )
    j = j.withColumn("symbol", symbol)
    inside = j.where("target is not null and symbol <> ''").select(*keep, "rank", F.col("target").alias("module"), "symbol")
    outside = j.where("target is null and not lost and how <> 'star'").select(*keep, "rank", S.first_part("base").alias("package"), "symbol")
    return inside, outside


def _links(facts: DataFrame, targets: DataFrame, index: DataFrame) -> DataFrame:
    """``(module, of, fact, to_module, to_symbol, package)``: where the exported names of modules, their submodules and the
    bases of classes lead."""
    above = index.select(F.col("alias").alias("parent"), F.col("rel_path").alias("module"))
    parts = index.withColumn("parent", F.regexp_extract("alias", r"^(.+)\.[^.]+$", 1)).join(above, "parent")
    parts = parts.select("module", S.last_part("alias").alias("of"), F.lit("export").alias("fact"), F.col("rel_path").alias("to_module"), F.lit("").alias("to_symbol"), F.lit(None).cast("string").alias("package"))
    rows = facts.where(F.col("fact").isin("export", "base")).select("rel_path", "fact", F.when(F.col("fact") == "base", F.col("qualified_name")).otherwise(F.col("name")).alias("of"), F.explode("refs").alias("ref"))
    rows = rows.select("rel_path", "fact", "of", "ref.*").withColumn("rank", F.lit(0))
    near = rows.where("how = 'local'").select(F.col("rel_path").alias("module"), "of", "fact", F.col("rel_path").alias("to_module"), F.regexp_extract("node", r"::(.+)::L\d+$", 1).alias("to_symbol"), F.lit(None).cast("string").alias("package"))
    keep = ["rel_path", "of", "fact"]
    inside, outside = _through_imports(rows.where("ord is not null"), targets, keep)
    # A star or a submodule stands for the module itself.
    whole = rows.where("ord is not null").join(targets.select("rel_path", F.col("ordinal").alias("ord"), "target", "submodule", "kind"), ["rel_path", "ord"]).where("target is not null and path = '' and (submodule or how in ('star', 'module'))")
    return (
        near.unionByName(parts)
        .unionByName(inside.select(F.col("rel_path").alias("module"), "of", "fact", F.col("module").alias("to_module"), F.col("symbol").alias("to_symbol"), F.lit(None).cast("string").alias("package")))
        .unionByName(whole.select(F.col("rel_path").alias("module"), "of", "fact", F.col("target").alias("to_module"), F.lit("").alias("to_symbol"), F.lit(None).cast("string").alias("package")))
        .unionByName(outside.select(F.col("rel_path").alias("module"), "of", "fact", F.lit(None).cast("string").alias("to_module"), F.col("symbol").alias("to_symbol"), "package"))
        .distinct()
    )


def call_edges(sites: Sites, nodes: DataFrame) -> DataFrame:
    """``(src_id, dst_id, kind, resolved, class)`` of each call site, from the innermost function around it or its file.

    ``class`` is internal, external (other packages and builtins, which make no edge: ``dst_id`` is null) or unknown, kept as
    ``unknown::<name>``. A raised name is a call only if it is a class.
    """
    calls = sites.rows.where("fact = 'call'").where((F.col("site") != "raise") | F.col("is_class"))
    at = calls.select(*KEY, F.col("rel_path").alias("file_path"), "line", "to", "how", "name").withColumn("site_id", F.concat_ws("#", *KEY))
    placed = innermost(at, nodes.where("kind = 'function'"))
    return placed.select(
        F.coalesce("node_id", F.concat("file_path", F.lit("::<file>"))).alias("src_id"),
        F.when(F.col("how") == "internal", F.col("to")).when(F.col("how") == "unknown", F.concat(F.lit("unknown::"), "name")).alias("dst_id"),
        F.lit("calls").alias("kind"),
        (F.col("how") == "internal").alias("resolved"),
        F.col("how").alias("class"),
    )


def site_refs(sites: Sites, nodes: DataFrame) -> DataFrame:
    """``(node_id, package, symbol)``: calls into other packages by the function that makes them, and bases by their class."""
    out = sites.rows.where("how = 'external' and package is not null").where((F.col("site") != "raise") | (F.col("fact") != "call") | F.col("is_class"))
    at = out.select(*KEY, F.col("rel_path").alias("file_path"), "line", "fact", "package", "name").withColumn("site_id", F.concat_ws("#", *KEY))
    placed = innermost(at, nodes.where("kind = 'function'"))
    return placed.where("fact <> 'view'").select(F.coalesce("node_id", F.concat("file_path", F.lit("::<file>"))).alias("node_id"), "package", F.col("name").alias("symbol")).distinct()


def coverage(calls: DataFrame) -> DataFrame:
    """Share of call sites whose target is known; 1.0 if there are none."""
    total = F.count("*")
    good = F.count_if(F.col("class") != "unknown")
    return calls.agg(
        total.alias("total"),
        F.count_if(F.col("class") == "internal").alias("internal"),
        F.count_if(F.col("class") == "external").alias("external"),
        F.count_if(F.col("class") == "unknown").alias("unresolved"),
        F.when(total == 0, 1.0).otherwise(good / total).alias("ratio"),
    )


def inherits_edges(sites: Sites, facts: DataFrame) -> DataFrame:
    """``(src_id, dst_id, kind, resolved)``: bases that are classes of the repository, else unknown; external ones have none."""
    owner = facts.where("fact = 'base'").select(*KEY, "qualified_name")
    classes = extract.def_nodes(facts).where("kind = 'class'").select(F.col("file_path").alias("rel_path"), "qualified_name", "node_id", F.col("start_line").alias("a"), "end_line")
    base = sites.rows.where("fact = 'base'").join(owner, KEY)
    src = base.join(classes, ["rel_path", "qualified_name"]).where(F.col("line").between(F.col("a"), F.col("end_line"))).groupBy(*KEY).agg(F.max_by("node_id", "a").alias("src_id"))
    found = base.join(src, KEY).where((F.col("how") == "unknown") | ((F.col("how") == "internal") & F.col("is_class")))
    return found.select("src_id", F.coalesce("to", F.concat(F.lit("unknown::"), "name")).alias("dst_id"), F.lit("inherits").alias("kind"), F.col("to").isNotNull().alias("resolved"))


def entry_points(facts: DataFrame, nodes: DataFrame, sites: Sites) -> DataFrame:
    """``(node_id, kind, trust)``: functions behind route decorators, and the views that URL tables lead to.

    A view is what its name refers to where the table stands; a class brings the methods that answer requests.
    """
    routes = facts.where("fact = 'route'").select(F.col("rel_path").alias("file_path"), F.col("line").alias("start_line"))
    direct = nodes.where("kind = 'function'").join(routes, ["file_path", "start_line"]).select("node_id")
    views = sites.rows.where("fact = 'view' and to is not null").select(F.col("to").alias("node_id")).distinct()
    hit = nodes.where("kind <> 'file'").join(views, "node_id")
    verbs = hit.where("kind = 'class'").select("file_path", F.explode(F.array(*(F.concat_ws(".", "qualified_name", F.lit(v)) for v in extract.VIEW_METHODS))).alias("qualified_name"))
    methods = nodes.where("kind = 'function'").join(verbs, ["file_path", "qualified_name"]).select("node_id")
    return direct.unionByName(hit.select("node_id")).unionByName(methods).distinct().select("node_id", F.lit("http_route").alias("kind"), F.lit("untrusted").alias("trust"))


def defines_edges(nodes: DataFrame) -> DataFrame:
    """``(src_id, dst_id, kind, resolved)`` from definitions and files to what they enclose."""
    from tracelake.operators.locate import parent_defs

    return parent_defs(nodes).select(F.col("parent_id").alias("src_id"), F.col("child_id").alias("dst_id"), F.lit("defines").alias("kind"), F.lit(True).alias("resolved"))


def code_graph(facts: DataFrame, files: DataFrame, root: str | None = None) -> dict[str, DataFrame]:
    """Nodes, edges of all kinds, references to other packages and entry points of ``files`` with their ``facts``."""
    nodes = cut(extract.file_nodes(files).unionByName(extract.def_nodes(facts)))
    targets = import_targets(facts, files, root)
    sites = resolve_sites(facts, files, root)
    calls = call_edges(sites, nodes).where("dst_id is not null").drop("class")
    edges = defines_edges(nodes).unionByName(import_edges(targets)).unionByName(calls).unionByName(inherits_edges(sites, facts))
    return {"nodes": nodes, "edges": edges, "refs": external_refs(targets), "call_refs": site_refs(sites, nodes), "entry_points": entry_points(facts, nodes, sites)}
