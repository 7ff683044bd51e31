"""Optional model-backed steps behind a provider: verdicts and summaries, cached by content and kept in a budget."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.core import cut, ship
from tracelake.functions import scalar as S
from tracelake.operators import graph as G
from tracelake.operators.scopes import BUILTINS
from tracelake.sources.reports import parse_verdicts


@dataclass
class Reply:
    text: str
    prompt_tokens: int
    completion_tokens: int


class Provider(Protocol):
    """A language model. It must be deterministic to be cached, and able to be sent to the executors."""

    model_name: str

    def generate(self, prompt: str, system: str) -> Reply: ...


def count_tokens(text: str) -> int:
    return max(1, len(text.split()))


@dataclass
class KeywordProvider:
    """Answers from keywords alone; stands in for a model offline."""

    model_name: str = "keywords"

    def generate(self, prompt: str, system: str) -> Reply:
        low = prompt.lower()
        if any(w in low for w in ("sanitize", "escaped", "parameterized", "constant")):
            verdict, sure = "false_positive", 0.8
        elif any(w in low for w in ("request", "user input", "untrusted", "remote")):
            verdict, sure = "real", 0.9
        else:
            verdict, sure = "needs_review", 0.5
        text = f'{{"verdict": "{verdict}", "confidence": {sure}, "reasoning": "keywords"}}'
        return Reply(text, count_tokens(prompt + " " + system), count_tokens(text))


#: What to look for, by weakness; the last entry holds for all others.
FOCUS = {
    "CWE-89": "Does untrusted text reach the statement, or is it bound as a parameter?",
    "CWE-78": "Does untrusted text reach a shell, or a fixed list of arguments?",
    "CWE-79": "Is the value escaped where the page is written?",
    "CWE-22": "Can the path leave its folder?",
    "CWE-798": "Is the literal a live credential, or a sample?",
    "": "Can untrusted input make this harmful?",
}


def place_names(nodes: DataFrame) -> DataFrame:
    """``(node_id, place)``: how a node is called in a context."""
    return nodes.select("node_id", F.concat(F.col("qualified_name"), F.lit(" ("), S.location("file_path", "start_line"), F.lit(")")).alias("place"))


def gather(findings: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``findings(finding_id, node_id, path, package, ...)`` with what a context says beside its own columns: ``target``,
    ``steps`` of the path and ``callers`` by their places, ``module_doc`` of the target's file."""
    place = cut(place_names(nodes).distinct())
    steps = findings.select("finding_id", F.posexplode("path").alias("at", "node_id")).join(place, "node_id", "left")
    steps = steps.groupBy("finding_id").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("place", "node_id").alias("p")))).alias("s")).select("finding_id", F.transform("s", lambda x: x["p"]).alias("steps"))
    calls = edges.where("kind = 'calls'").select("src_id", F.col("dst_id").alias("node_id")).distinct().join(findings.select("node_id").distinct(), "node_id", "left_semi")
    callers = calls.join(place.select(F.col("node_id").alias("src_id"), "place"), "src_id").groupBy("node_id").agg(F.sort_array(F.collect_set("place")).alias("callers"))
    own = nodes.select("node_id", F.col("qualified_name").alias("_name"), F.col("file_path").alias("_file"))
    docs = nodes.where("kind = 'file'").select(F.col("file_path").alias("_file"), F.col("docstring").alias("module_doc"))
    j = findings.join(steps, "finding_id", "left").join(callers, "node_id", "left").join(own, "node_id", "left").join(docs, "_file", "left")
    target = F.when(F.col("_name").isNotNull(), F.col("_name")).when(F.col("package").isNotNull(), F.concat(F.lit("package "), "package")).otherwise("the module")
    return j.withColumn("target", target).drop("_name", "_file")


def contexts(findings: DataFrame) -> DataFrame:
    """``prompt`` and ``context_hash`` for findings with rule_id, cwe, message, path, code; nulls count as ''.

    Eight sections: the finding, its severity and message, the target, its code, the path to it, its callers, what its
    module says of itself. Columns that are not there (``source``, ``raw_severity``, ``target``, ``steps``, ``callers``,
    ``module_doc``) leave their section empty. The question follows the weakness.
    """
    focus = F.lit(FOCUS[""])
    for weakness, text in FOCUS.items():
        if weakness:
            focus = F.when(F.col("cwe") == weakness, text).otherwise(focus)

    def have(c: str, kind: str = "string"):
        return F.col(c) if c in findings.columns else F.lit(None).cast(kind)

    lines = "array<string>"
    parts = (
        ("finding", F.concat_ws(" | ", have("source"), "rule_id", F.coalesce("cwe", F.lit("no weakness")))),
        ("severity", have("raw_severity")),
        ("message", F.col("message")),
        ("target", have("target")),
        ("code", F.col("code")),
        ("path", F.array_join(F.coalesce(have("steps", lines), "path"), G.ARROW)),
        ("callers", F.array_join(have("callers", lines), ", ")),
        ("module", have("module_doc")),
    )
    prompt = F.concat_ws("\n", *(F.concat(F.lit(f"{name}: "), F.coalesce(c, F.lit(""))) for name, c in parts), F.concat(F.lit("question: "), focus))
    return findings.withColumn("prompt", prompt).withColumn("context_hash", S.content_hash(prompt))


def cache_key(template: str, model: str):
    return S.joined_hash("context_hash", F.lit(template), F.lit(model))


def adjudicate(findings: DataFrame, provider: Provider, cache: DataFrame | None = None, limit: int | None = None, template: str = "v1") -> DataFrame:
    """Verdicts for ``findings(finding_id, reachable, prompt, context_hash, ordinal)``.

    Unreachable findings get the verdict "unreachable" without a call; cached contexts are reused. With a token limit,
    calls go in order until it is spent (prompt tokens are known before a call, so a running sum decides, without a loop
    over the driver); those beyond it need review. Equal contexts are asked once.
    """
    f = findings.withColumn("cache_key", cache_key(template, provider.model_name))
    skip = f.where("reachable = 'unreachable'").select("finding_id", F.lit("unreachable").alias("verdict"), F.lit(1.0).alias("confidence"), F.lit("").alias("reasoning"), F.lit("skipped").alias("how"))
    open_ = f.where(~F.col("reachable").eqNullSafe("unreachable"))  # what was never traced is asked too
    out = skip
    if cache is not None:
        known = cache.select("cache_key", "verdict", "confidence", "reasoning").dropDuplicates(["cache_key"])
        out = out.unionByName(open_.join(known, "cache_key").select("finding_id", "verdict", "confidence", "reasoning", F.lit("cached").alias("how")))
        open_ = open_.join(known, "cache_key", "left_anti")
    asked = open_.groupBy("cache_key").agg(F.min(F.struct("ordinal", "prompt")).alias("p")).select("cache_key", F.col("p.ordinal").alias("ordinal"), F.col("p.prompt").alias("prompt"))
    if limit is not None:
        asked = _budget(asked, limit)
    answered = ask(asked, provider)
    told = open_.join(parse_verdicts(answered).select("cache_key", "verdict", "confidence", "reasoning"), "cache_key", "left")
    return out.unionByName(
        told.select(
            "finding_id", F.coalesce("verdict", F.lit("needs_review")).alias("verdict"), F.coalesce("confidence", F.lit(0.5)).alias("confidence"), F.coalesce("reasoning", F.lit("")).alias("reasoning"),
            F.when(F.col("verdict").isNull(), "budget").otherwise("called").alias("how"),
        )
    )


def _budget(asked: DataFrame, limit: int) -> DataFrame:
    """Prompts that are called before ``limit`` tokens are spent, in order.

    Costs are summed per range of the order first, so no task sees more than one range: the running sum before a row is
    that of the ranges before its own plus that within it.
    """
    from pyspark.sql import Window

    cost = F.greatest(F.lit(1), F.size(F.split(F.trim("prompt"), r"\s+")))
    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(asked.withColumn("cost", cost).repartitionByRange(parts, "ordinal", "cache_key").withColumn("part", F.spark_partition_id()))
    totals = rows.groupBy("part").agg(F.sum("cost").alias("total"))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    before = totals.withColumn("before", F.coalesce(F.sum("total").over(w), F.lit(0))).select("part", "before")
    inner = Window.partitionBy("part").orderBy("ordinal", "cache_key").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum("cost").over(inner), F.lit(0)) + F.col("before")
    return rows.join(before, "part").withColumn("spent", spent).where(F.col("spent") < limit).select("cache_key", "ordinal", "prompt")


def ask(rows: DataFrame, provider: Provider, system: str = "You judge findings.") -> DataFrame:
    """``(cache_key, reply)``: the provider runs on the executors, a batch of prompts at a time; an error gives no reply."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, p in zip(b["cache_key"], b["prompt"], strict=True):
                try:
                    out.append((k, provider.generate(p, system).text))
                except Exception:  # noqa: BLE001 - a failed call needs review, it does not end the job
                    out.append((k, ""))
            yield pd.DataFrame(out, columns=["cache_key", "reply"])

    return rows.select("cache_key", "prompt").mapInPandas(run, "cache_key string, reply string")


def cache_rows(judged: DataFrame, findings: DataFrame, provider: Provider, template: str = "v1") -> DataFrame:
    """Rows to append to the cache: verdicts of successful calls, one for each key."""
    keyed = findings.withColumn("cache_key", cache_key(template, provider.model_name)).select("finding_id", "cache_key")
    return judged.where("how = 'called'").join(keyed, "finding_id").select("cache_key", "verdict", "confidence", "reasoning", F.lit(template).alias("template_id"), F.lit(provider.model_name).alias("model")).dropDuplicates(["cache_key"])


def merge_cache(cache: DataFrame, rows: DataFrame) -> DataFrame:
    """``cache`` with ``rows`` put in: of one key the newer verdict counts, each row says when it was made."""
    stamped = rows.withColumn("made_at", F.current_timestamp()) if "made_at" not in rows.columns else rows
    old = cache if "made_at" in cache.columns else cache.withColumn("made_at", F.lit(None).cast("timestamp"))
    columns = [c for c in stamped.columns if c != "cache_key"]
    every = old.select("cache_key", *columns).withColumn("_new", F.lit(0)).unionByName(stamped.select("cache_key", *columns).withColumn("_new", F.lit(1)))
    best = every.groupBy("cache_key").agg(F.max_by(F.struct(*columns), F.struct("_new", "made_at")).alias("r"))
    return best.select("cache_key", "r.*")


def save_cache(cache: DataFrame, folder: str) -> None:
    """Writes a cache into a new version below ``folder`` and names it last, so that readers never see half of one."""
    spark = cache.sparkSession
    version = f"{folder}/v={uuid.uuid4().hex}"
    cache.write.parquet(version)
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").text(f"{folder}/latest")


def load_cache(spark, folder: str) -> DataFrame | None:
    """The cache that was saved last; none if there is none yet."""
    try:
        return spark.read.parquet(spark.read.text(f"{folder}/latest").first()[0])
    except AnalysisException:
        return None


def triage_stats(judged: DataFrame) -> DataFrame:
    return judged.agg(*(F.count_if(F.col("verdict") == v).alias(v) for v in ("real", "false_positive", "needs_review", "unreachable")), *(F.count_if(F.col("how") == h).alias(f"n_{h}") for h in ("called", "cached", "skipped", "budget")))


def known_names(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """``(name)``: everything a summary may mention: qualified and simple names, file stems, packages, their symbols."""
    parts = [
        nodes.select(F.col("qualified_name").alias("name")),
        nodes.select(S.last_part("qualified_name").alias("name")),
        nodes.select(F.regexp_extract("file_path", r"([^/]+?)(?:\.[^./]+)?$", 1).alias("name")),
        refs.select(F.col("package").alias("name")),
        refs.select(F.col("symbol").alias("name")),
        refs.select(F.concat_ws(".", "package", "symbol").alias("name")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    own = nodes.sparkSession.createDataFrame([(b,) for b in sorted(BUILTINS)], "name string")
    return out.unionByName(own).where("name is not null and name <> ''").distinct()


def unknown_mentions(texts: DataFrame, names: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, name)``: names in backticks that nothing defines, neither in full nor by their last part."""
    said = texts.select(key, F.explode(S.backticked(text)).alias("name")).distinct()
    left = said.join(names, "name", "left_anti")
    return left.join(names.select(F.col("name").alias("_last")), S.last_part("name") == F.col("_last"), "left_anti")


_MADE = "node_id string, level int, key string, summary string, flagged boolean, how string, calls int, tokens bigint"


def summaries(nodes: DataFrame, calls: DataFrame, names: DataFrame, provider: Provider, cache: DataFrame | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Summaries of definitions, callees first, then of files from what they define; and one row of counters.

    ``nodes(node_id, kind, qualified_name, source_hash, file_path, code, docstring)``, ``names(name)`` all that a summary may
    mention (``known_names``), ``cache(key, summary, flagged)``. A text that mentions a name that nothing has is asked for
    once more with a word about it, and ``flagged`` if it still does. Nodes of one level are written in parallel. With a
    ``limit`` of tokens, nodes go in order until it is spent; those beyond it have no summary and count as
    ``skipped_budget``. A key is made of the node's own content and the keys below it, so a change is seen above.
    """
    spark = nodes.sparkSession
    ship(spark)
    names = cut(names.select("name").distinct())
    defs = nodes.where("kind <> 'file'")
    order = cut(G.callee_first(calls, defs))
    deepest = order.agg(F.max("level").alias("m")).first()["m"]
    files_at = (deepest if deepest is not None else -1) + 1
    links = calls.select("src_id", "dst_id").where("src_id <> dst_id").distinct()
    parts = defs.join(nodes.where("kind = 'file'").select(F.col("node_id").alias("src_id"), "file_path"), "file_path").select("src_id", F.col("node_id").alias("dst_id"))
    shown = nodes.select(F.col("node_id").alias("dst_id"), F.col("qualified_name").alias("dst_name")).distinct()
    done = spark.createDataFrame([], _MADE)
    spent = 0
    for level in range(files_at + 1):
        module = level == files_at
        here = nodes.where("kind = 'file'").withColumn("level", F.lit(level)) if module else order.where(F.col("level") == level).select(F.col("node").alias("node_id"), "level").join(defs, "node_id")
        below = (parts if module else links).join(done.where("summary is not null").select(F.col("node_id").alias("dst_id"), "key", "summary"), "dst_id").join(shown, "dst_id")
        below = below.groupBy(F.col("src_id").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct("dst_id", "key", "dst_name", "summary"))).alias("c"))
        here = here.join(below, "node_id", "left")
        told = F.array_join(F.transform("c", lambda c: F.concat(F.lit("- `"), c["dst_name"], F.lit("`: "), c["summary"])), "\n")
        keys = F.coalesce(F.array_join(F.transform("c", lambda c: c["key"]), S.UNIT), F.lit(""))
        head = (F.lit("module"),) if module else ()
        body = F.coalesce("docstring", F.lit("")) if module else F.coalesce("code", F.lit(""))
        prompt = F.concat_ws("\n", F.concat(F.lit("Summarise `"), "qualified_name", F.lit("` of "), "file_path"), body, F.coalesce(told, F.lit("")))
        here = cut(here.select("node_id", "level", S.joined_hash(*head, "qualified_name", "source_hash", F.lit(provider.model_name), keys).alias("key"), prompt.alias("prompt")))
        new, used = _written(here, names, provider, cache, None if limit is None else max(limit - spent, 0))
        spent += used
        done = cut(done.unionByName(new))
    counts = [F.count("*").alias("total"), *(F.count_if(F.col("how") == h).alias(n) for h, n in (("generated", "generated"), ("cached", "cached"), ("budget", "skipped_budget")))]
    stats = done.agg(*counts, F.count_if(F.col("flagged") & (F.col("how") == "generated")).alias("flagged"), F.coalesce(F.sum("calls"), F.lit(0)).alias("llm_calls"))
    return done.where("summary is not null").select("node_id", "level", "key", "summary", "flagged", "how"), stats


def _written(here: DataFrame, names: DataFrame, provider: Provider, cache: DataFrame | None, left: int | None) -> tuple[DataFrame, int]:
    """The nodes of one level with their summaries, and the tokens of the prompts that were sent."""
    base = here.select("node_id", "level", "key")
    out = None
    open_ = here
    if cache is not None:
        known = cache.groupBy("key").agg(F.max(F.struct("summary", "flagged")).alias("k"))
        hit = open_.join(known, "key").select("node_id", "level", "key", "k.summary", "k.flagged", F.lit("cached").alias("how"), F.lit(0).alias("calls"), F.lit(0).cast("bigint").alias("tokens"))
        out, open_ = hit, open_.join(known.select("key"), "key", "left_anti")
    asked = open_.select(F.col("node_id").alias("cache_key"), F.col("node_id").alias("ordinal"), "prompt")
    asked = cut(_budget(asked, left).select("cache_key", "prompt") if left is not None else asked.select("cache_key", "prompt"))

    def answers(rows: DataFrame) -> DataFrame:
        return cut(ask(rows, provider, "You summarise code.").select("cache_key", S.clean_text("reply").alias("text")))

    def strange(texts: DataFrame) -> DataFrame:
        return unknown_mentions(texts, names, "cache_key", "text").groupBy("cache_key").agg(F.array_join(F.sort_array(F.collect_set("name")), ", ").alias("bad"))

    first = answers(asked)
    bad = cut(strange(first))
    second_prompts = asked.join(bad, "cache_key").select("cache_key", F.concat("prompt", F.lit("\n\nDo not mention "), "bad", F.lit(": they are not in the code.")).alias("prompt"))
    second = answers(second_prompts)
    still = strange(second).select("cache_key", F.lit(True).alias("still"))
    size = F.greatest(F.lit(1), F.size(F.split(F.trim("prompt"), r"\s+"))).cast("bigint")
    cost = asked.select("cache_key", size.alias("n")).unionByName(second_prompts.select("cache_key", size.alias("n"))).groupBy("cache_key").agg(F.sum("n").alias("tokens"), F.count("*").cast("int").alias("calls"))
    made = first.join(second.withColumnRenamed("text", "again"), "cache_key", "left").join(still, "cache_key", "left").join(cost, "cache_key")
    made = made.select(F.col("cache_key").alias("node_id"), F.coalesce("again", "text").alias("summary"), F.coalesce("still", F.lit(False)).alias("flagged"), F.lit("generated").alias("how"), "calls", "tokens")
    rest = base.join(open_.select("node_id"), "node_id", "left_semi").join(made, "node_id", "left")
    rest = rest.select("node_id", "level", "key", "summary", F.coalesce("flagged", F.lit(False)).alias("flagged"), F.coalesce("how", F.lit("budget")).alias("how"), F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"))
    out = cut(rest if out is None else out.unionByName(rest))
    return out, int(out.agg(F.sum("tokens").alias("t")).first()["t"] or 0)


def summarise(nodes: DataFrame, calls: DataFrame, write: Callable[[str, list[str]], str], model: str = "none") -> DataFrame:
    """``(node_id, level, key, summary)``: callees first, level by level; each text may draw on those of its callees.

    ``nodes(node_id, qualified_name, source_hash, code)``. A key is made of the node's own content and its callees' keys,
    so a change is seen by all callers. Nodes of one level are written in parallel on the executors.
    """
    order = cut(G.callee_first(calls, nodes))
    deepest = order.agg(F.max("level").alias("m")).first()["m"]
    done = None
    links = calls.select("src_id", "dst_id").where("src_id <> dst_id").distinct()
    for level in range((deepest if deepest is not None else -1) + 1):
        here = order.where(F.col("level") == level).select(F.col("node").alias("node_id"), "level").join(nodes, "node_id")
        if done is not None:
            below = links.join(done.select(F.col("node_id").alias("dst_id"), "key", "summary"), "dst_id").groupBy(F.col("src_id").alias("node_id"))
            below = below.agg(F.array_sort(F.collect_list(F.struct("dst_id", "key", "summary"))).alias("callees"))
            here = here.join(below, "node_id", "left")
        else:
            here = here.withColumn("callees", F.lit(None).cast("array<struct<dst_id:string,key:string,summary:string>>"))
        keys = F.array_join(F.transform(F.coalesce("callees", F.array().cast("array<struct<dst_id:string,key:string,summary:string>>")), lambda c: c["key"]), S.UNIT)
        here = here.withColumn("key", S.joined_hash("qualified_name", "source_hash", F.lit(model), keys))
        texts = F.transform("callees", lambda c: c["summary"])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                b["summary"] = [write(c, [] if t is None else list(t)) for c, t in zip(b["code"], b["texts"], strict=True)]
                yield b[["node_id", "level", "key", "summary"]]

        new = cut(here.select("node_id", "level", "key", "code", texts.alias("texts")).mapInPandas(run, "node_id string, level int, key string, summary string"))
        done = new if done is None else cut(done.unionByName(new))
    return done if done is not None else nodes.sparkSession.createDataFrame([], "node_id string, level int, key string, summary string")
