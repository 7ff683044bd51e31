"""How well filters, call graphs and traces do against labelled truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.core import cut

COVERAGE_FLOOR = 0.60
GAIN, RECALL = 3.0, 0.85


def hits(findings: DataFrame, truth: DataFrame) -> DataFrame:
    """``(finding_id, case_id)``: same file, same function where the case names one, a CWE of the case; not packages."""
    t = truth.select("case_id", F.col("file").alias("file_path"), F.col("function").alias("_fn"), F.explode("cwes").alias("cwe"))
    f = findings.where(F.col("package").isNull()).select("finding_id", "file_path", "qualified_name", "cwe")
    return f.join(t, ["file_path", "cwe"]).where((F.coalesce("_fn", F.lit("")) == "") | (F.col("_fn") == F.col("qualified_name"))).select("finding_id", "case_id").distinct()


def keeps() -> dict[str, Column]:
    """What each filter keeps of a finding."""
    reach = F.col("reachable") != "unreachable"
    return {
        "keep_all": F.lit(True),
        "severity": F.col("severity").isin("critical", "high", "medium"),
        "reachability": reach,
        "triage": reach & (F.coalesce("verdict", F.lit("")) != "false_positive"),
    }


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def scores(findings: DataFrame, hit: DataFrame, truth: DataFrame, scope: str = "repo") -> DataFrame:
    """Per scope and filter: kept findings, true ones among them, cases hit; cases detected at all; cases there are.

    Findings are counted for all filters in one pass, cases by a distinct count over the hits.
    """
    methods = keeps()
    kept = F.array(*(F.when(c, F.lit(m)) for m, c in methods.items()))
    true = hit.select("finding_id").distinct().withColumn("is_true", F.lit(1))
    rows = findings.join(true, "finding_id", "left").select(scope, "finding_id", "is_true", F.explode(F.array_compact(kept)).alias("method"))
    count = rows.groupBy(scope, "method").agg(F.count("*").alias("kept"), F.count("is_true").alias("true_pos"))
    cases = rows.where("is_true = 1").join(hit, "finding_id").groupBy(scope, "method").agg(F.countDistinct("case_id").alias("cases_hit"))
    detected = cases.where("method = 'keep_all'").select(scope, F.col("cases_hit").alias("detected"))
    total = truth.groupBy(scope).agg(F.countDistinct("case_id").alias("truth"))
    out = count.join(cases, [scope, "method"], "left").join(detected, scope, "left").join(total, scope, "left").na.fill(0, ["cases_hit", "detected", "truth"])
    return with_rates(out)


def with_rates(s: DataFrame) -> DataFrame:
    return (
        s.withColumn("precision", F.round(ratio(F.col("true_pos"), F.col("kept")), 6))
        .withColumn("recall_retained", F.round(ratio(F.col("cases_hit"), F.col("detected")), 6))
        .withColumn("recall_end_to_end", F.round(ratio(F.col("cases_hit"), F.col("truth")), 6))
    )


def pooled(s: DataFrame, coverage: DataFrame | None = None, scope: str = "repo") -> DataFrame:
    """Sums per filter over the scopes whose coverage is high enough to count."""
    if coverage is not None:
        s = s.join(coverage.where(F.col("ratio") >= COVERAGE_FLOOR).select(scope), scope, "left_semi")
    total = s.groupBy("method").agg(*(F.sum(c).alias(c) for c in ("kept", "true_pos", "cases_hit", "detected", "truth")))
    return with_rates(total)


def gate(p: DataFrame) -> DataFrame:
    """One row: gain of precision over keeping all, recall retained, and whether both suffice."""
    base = p.where("method = 'keep_all'").select(F.col("precision").alias("base"))
    ours = p.where("method = 'reachability'").select("precision", "recall_retained")
    row = ours.agg(F.max("precision").alias("precision"), F.max("recall_retained").alias("recall_retained"))
    gain = base.agg(F.max("base").alias("base"))
    both = row.withColumn("k", F.lit(1)).join(gain.withColumn("k", F.lit(1)), "k").drop("k")
    g = ratio(F.col("precision"), F.col("base"))
    return both.select(F.round(g, 6).alias("gain"), "recall_retained", ((g >= GAIN) & (F.col("recall_retained") >= RECALL)).alias("passed"))


def triage_gate(p: DataFrame) -> DataFrame:
    """One row: whether the verdicts raise precision over reachability alone and lose no recall; null without them."""
    ours = {m: p.where(F.col("method") == m).agg(F.max("precision").alias(f"p_{m}"), F.max("recall_retained").alias(f"r_{m}"), F.count("*").alias(f"n_{m}")).withColumn("k", F.lit(1)) for m in ("reachability", "triage")}
    j = ours["reachability"].join(ours["triage"], "k")
    zero = F.lit(0.0)
    gained = F.coalesce("p_triage", zero) > F.coalesce("p_reachability", zero)
    kept = F.coalesce("r_triage", zero) >= F.coalesce("r_reachability", zero)
    return j.select(F.when(F.col("n_triage") > 0, gained & kept).alias("passed"))


def random_expectation(findings: DataFrame, hit: DataFrame, n: int) -> DataFrame:
    """What ``n`` findings drawn at random hold on average: true findings, and cases with one of theirs among them.

    A case with m findings is missed if all m are among those left behind, which is a product of m quotients.
    """
    total = findings.count()
    n = min(n, total)
    k = F.lit(n / total if total else 0.0)
    missed = F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1), F.lit(1.0), lambda p, i: p * F.greatest(F.lit(total - n) - i, F.lit(0)) / (F.lit(total) - i))
    cases = hit.groupBy("case_id").agg(F.countDistinct("finding_id").alias("m")).agg(F.round(F.coalesce(F.sum(1 - missed), F.lit(0.0)), 6).alias("expected_cases_hit"))
    true = hit.select("finding_id").distinct().agg(F.round(F.count("*") * k, 6).alias("expected_true_pos"))
    return true.withColumn("k", F.lit(1)).join(cases.withColumn("k", F.lit(1)), "k").drop("k")  # one row each


def random_baseline(findings: DataFrame, hit: DataFrame, n: int, draws: int = 1000, seed: int = 7) -> DataFrame:
    """Mean true findings and mean cases hit among ``n`` findings drawn at random, and the expected true findings.

    How many true findings a draw has is simulated from the numbers alone; which ones they are is an order of the true
    findings by the draw. So a draw costs as many rows as there are true findings, not all findings.
    """
    total = findings.count()
    true = hit.select("finding_id").distinct()
    k = true.count()
    spark = findings.sparkSession
    # Successive draws without replacement: the number of true ones is hypergeometric; its steps are simulated per draw.
    d = spark.range(draws)
    steps = F.aggregate(
        F.sequence(F.lit(0), F.lit(max(min(n, total) - 1, 0))),
        F.struct(F.lit(0).alias("got"), F.col("id").alias("x")),
        lambda acc, i: F.struct(
            (acc["got"] + F.when((F.pmod(F.xxhash64(F.lit(seed), acc["x"], i), F.lit(1_000_000)) / 1e6) * (F.lit(total) - i) < (F.lit(k) - acc["got"]), 1).otherwise(0)).alias("got"), acc["x"].alias("x")
        ),
    )["got"]
    got = d.select("id", steps.alias("got")) if min(n, total) > 0 else d.select("id", F.lit(0).alias("got"))
    # Which of the true findings those are: the first ones in an order of the draw's own.
    every = true.select("finding_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(draws - 1).cast("bigint"))).alias("id"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64(F.lit(seed), "id", "finding_id"), "finding_id"))
    drawn = every.withColumn("place", place).join(got, "id").where(F.col("place") <= F.col("got"))
    cases = drawn.join(hit, "finding_id").groupBy("id").agg(F.countDistinct("case_id").alias("cases"))
    per = got.join(cases, "id", "left").select("got", F.coalesce("cases", F.lit(0)).alias("cases"))
    return per.agg(F.round(F.avg("got"), 6).alias("mean_true_pos"), F.round(F.avg("cases"), 6).alias("mean_cases_hit")).withColumn("expected", F.round(F.lit(n * k / total if total else 0.0), 6))


def edge_scores(emitted: DataFrame, truth: DataFrame, nodes: DataFrame, category: str = "category") -> DataFrame:
    """Per category and in total: true, false and missed edges, the latter by why they are missed.

    ``emitted(category, src, dst, resolved)``, ``truth(category, src, dst)``. A missed edge has no node for its target, or
    leaves an unknown edge of its source behind, or leaves nothing (silent).
    """
    key = [category, "src", "dst"]
    good = emitted.where("resolved").select(*key).distinct()
    t = truth.select(*key).distinct()
    known = nodes.select(F.col("node_id").alias("dst")).distinct().withColumn("has_node", F.lit(True))
    blind = emitted.where("not resolved").select(category, "src").distinct().withColumn("blind", F.lit(True))
    both = t.withColumn("t", F.lit(1)).join(good.withColumn("e", F.lit(1)), key, "full")
    both = both.join(known, "dst", "left").join(blind, [category, "src"], "left")
    missed = F.col("t").isNotNull() & F.col("e").isNull()
    node, dark = F.coalesce("has_node", F.lit(False)), F.coalesce("blind", F.lit(False))
    rolled = both.rollup(category).agg(
        F.count_if(F.col("t").isNotNull() & F.col("e").isNotNull()).alias("tp"),
        F.count_if(F.col("e").isNotNull()).alias("emitted"),
        F.count_if(F.col("t").isNotNull()).alias("truth"),
        F.count_if(missed & ~node).alias("no_node"),
        F.count_if(missed & node & dark).alias("unknown"),
        F.count_if(missed & node & ~dark).alias("silent"),
    )
    return rolled.withColumn(category, F.coalesce(category, F.lit("TOTAL")))


def graph_cases(cases: DataFrame, edges: DataFrame) -> DataFrame:
    """``cases(expect, src, dst)`` with ``passed``: an edge is there, a non-edge is not, an unknown one is kept as unknown."""
    good = edges.where("resolved").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst")).distinct().withColumn("there", F.lit(True))
    lost = edges.where("not resolved").select(F.col("src_id").alias("src"), F.regexp_replace("dst_id", "^unknown::", "").alias("dst")).distinct().withColumn("kept", F.lit(True))
    j = cases.join(good, ["src", "dst"], "left").join(lost, ["src", "dst"], "left")
    there, kept = F.coalesce("there", F.lit(False)), F.coalesce("kept", F.lit(False))
    return j.select("expect", "src", "dst", F.when(F.col("expect") == "edge", there).when(F.col("expect") == "no_edge", ~there).otherwise(kept).alias("passed"))


def recall_of_traces(observed: DataFrame, edges: DataFrame) -> DataFrame:
    """Observed calls that the graph has, and why it lacks the others; recall 1.0 if nothing was observed."""
    good = edges.where("resolved").select(F.col("src_id").alias("caller"), F.col("dst_id").alias("callee")).distinct().withColumn("g", F.lit(True))
    blind = edges.where("not resolved").select(F.col("src_id").alias("caller")).distinct().withColumn("b", F.lit(True))
    j = observed.distinct().join(good, ["caller", "callee"], "left").join(blind, "caller", "left")
    n, r = F.count("*"), F.count("g")
    return j.agg(
        n.alias("observed"),
        r.alias("recovered"),
        F.count_if(F.col("g").isNull() & F.col("b").isNotNull()).alias("unknown"),
        F.count_if(F.col("g").isNull() & F.col("b").isNull()).alias("silent"),
        F.when(n == 0, 1.0).otherwise(F.round(r / n, 6)).alias("recall"),
    )


def within_budget(rows: DataFrame, scope: str, order: str, cost: str, limit: int) -> DataFrame:
    """``rows`` with ``spent`` before each and whether it still runs: once the limit is reached, nothing more does.

    ``order`` tells the rows of a scope apart. Rows are cut into even ranges of (scope, order), whatever the scope, so that a
    scope with most rows is no single task: the sum before a row is that of its scope's ranges before and of what
    precedes it in its own.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    here = cut(rows.repartitionByRange(parts, scope, order).withColumn("_part", F.spark_partition_id()))
    own = Window.partitionBy(scope, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    totals = here.groupBy(scope, "_part").agg(F.sum(cost).alias("_total"))
    earlier = Window.partitionBy(scope).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    before = totals.select(F.col(scope).alias("_scope"), F.col("_part").alias("_p"), F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    j = here.join(before, here[scope].eqNullSafe(before["_scope"]) & (here["_part"] == before["_p"]))
    spent = F.coalesce(F.sum(cost).over(own), F.lit(0)) + F.col("_before")
    return j.withColumn("spent", spent).withColumn("runs", F.col("spent") < limit).drop("_part", "_scope", "_p", "_before")


def case_gate(passed: DataFrame, coverage: float, floor: float = 0.80) -> DataFrame:
    """One row over ``graph_cases``: how many pass, and whether all do with enough coverage."""
    n, k = F.count("*"), F.count_if("passed")
    return passed.agg(n.alias("cases"), k.alias("passed"), ((n == k) & F.lit(coverage >= floor)).alias("ok"))
