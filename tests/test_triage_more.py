"""Contexts, caches and summaries behind a provider."""

from pyspark.sql import functions as F

from tracelake.operators import triage

N = "node_id string, kind string, qualified_name string, source_hash string, file_path string, start_line int, code string, docstring string"
NODES = [("f", "file", "m", "hf", "m.py", 1, "", "The module."), ("a", "function", "a", "ha", "m.py", 3, "b()", None), ("b", "function", "b", "hb", "m.py", 7, "1", None)]


def parrot():
    """A provider made here, so that it goes to the workers by value."""

    class Parrot:
        """Mentions a name that nothing has, until told not to; of ``b`` even then."""

        model_name = "parrot"

        def generate(self, prompt: str, system: str) -> triage.Reply:
            name = prompt.split("`")[1]
            text = f"`{name}` does it" if "Do not mention" in prompt and name != "b" else f"`{name}` uses `ghost`" if name in ("a", "b") else f"`{name}` and `len()` ({prompt.count('- `')})"
            return triage.Reply(text, 1, 1)

    return Parrot()


def test_guard_retry_flag_files_last_and_counts(spark):
    nodes = spark.createDataFrame(NODES, N)
    calls = spark.createDataFrame([("a", "b")], "src_id string, dst_id string")
    names = triage.known_names(nodes, spark.createDataFrame([], "package string, symbol string"))
    got, stats = triage.summaries(nodes, calls, names, parrot())
    rows = {r.node_id: r for r in got.collect()}
    assert {k: (r.level, r.summary, r.flagged) for k, r in rows.items()} == {"b": (0, "`b` uses `ghost`", True), "a": (1, "`a` does it", False), "f": (2, "`m` and `len()` (2)", False)}
    assert stats.first().asDict() == {"total": 3, "generated": 3, "cached": 0, "skipped_budget": 0, "flagged": 1, "llm_calls": 5}
    cache = got.select("key", "summary", "flagged")
    again, stats = triage.summaries(nodes, calls, names, parrot(), cache)
    assert {(r.node_id, r.summary) for r in again.collect()} == {(r.node_id, r.summary) for r in rows.values()}
    assert stats.first().asDict() == {"total": 3, "generated": 0, "cached": 3, "skipped_budget": 0, "flagged": 0, "llm_calls": 0}
    changed = nodes.withColumn("source_hash", F.when(F.col("node_id") == "b", "new").otherwise(F.col("source_hash")))
    assert triage.summaries(changed, calls, names, parrot(), cache)[1].first()["generated"] == 3  # b, its caller and its file
    few, stats = triage.summaries(nodes, calls, names, parrot(), limit=1)
    assert [r.node_id for r in few.collect()] == ["b"] and stats.first()["skipped_budget"] == 2


def test_contexts_have_eight_sections(spark):
    nodes = spark.createDataFrame(NODES, N)
    edges = spark.createDataFrame([("a", "b", "calls"), ("f", "b", "defines")], "src_id string, dst_id string, kind string")
    f = spark.createDataFrame([("1", "b", ["a", "b"], None, "s", "R", "CWE-78", "HIGH", "msg", "code()"), ("2", None, [], "wares", "s", "R", None, "LOW", None, None)], "finding_id string, node_id string, path array<string>, package string, source string, rule_id string, cwe string, raw_severity string, message string, code string")
    got = {r.finding_id: r.prompt.split("\n") for r in triage.contexts(triage.gather(f, nodes, edges)).collect()}
    assert got["1"][:8] == ["finding: s | R | CWE-78", "severity: HIGH", "message: msg", "target: b", "code: code()", "path: a (m.py:3) > b (m.py:7)", "callers: a (m.py:3)", "module: The module."]
    assert got["2"][3] == "target: package wares" and len(got["2"]) == 9


def test_cache_is_put_in_and_saved(spark, tmp_path):
    s = "cache_key string, verdict string, confidence double, reasoning string, template_id string, model string"
    old = spark.createDataFrame([("k1", "real", 0.5, "", "v1", "m"), ("k2", "real", 0.5, "", "v1", "m")], s)
    new = spark.createDataFrame([("k2", "false_positive", 0.9, "", "v1", "m"), ("k3", "real", 0.9, "", "v1", "m")], s)
    assert triage.load_cache(spark, str(tmp_path / "c")) is None
    triage.save_cache(triage.merge_cache(old, new), str(tmp_path / "c"))
    assert {(r.cache_key, r.verdict) for r in triage.load_cache(spark, str(tmp_path / "c")).collect()} == {("k1", "real"), ("k2", "false_positive"), ("k3", "real")}
    triage.save_cache(triage.merge_cache(triage.load_cache(spark, str(tmp_path / "c")), old), str(tmp_path / "c"))
    assert {(r.cache_key, r.verdict) for r in triage.load_cache(spark, str(tmp_path / "c")).collect()} == {("k1", "real"), ("k2", "real"), ("k3", "real")}
