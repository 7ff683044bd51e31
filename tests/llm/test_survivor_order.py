import datetime as dt

from tracelake.llm import survivors

F = "finding_id bigint, source string, severity string, confidence string, cwe string, fixed_in string, reported_at timestamp_ntz"


def tables(spark):
    day = dt.datetime(2031, 1, 1)
    # "low" loses nothing in groups of its own, "high" loses all to "top"; where the two meet the higher trust counts.
    rows, groups = [(1, "high", "critical"), (2, "low", "low")], [(0, [1, 2])]
    for i in range(10, 50, 10):
        rows += [(i, "top", "low"), (i + 1, "high", "high"), (i + 2, "low", "medium"), (i + 3, "low", "medium")]
        groups += [(i, [i, i + 1]), (i + 1, [i + 2, i + 3])]
    f = spark.createDataFrame([(i, s, v, None, None, None, day) for i, s, v in rows], F)
    g = spark.createDataFrame(groups, "group_id bigint, members array<bigint>")
    return g, f, spark.createDataFrame([("top", 5.0), ("high", 1.0), ("low", 0.9)], "source string, trust double")


def test_no_estimate_passes_a_declared_trust(spark):
    got = {r.group_id: r.severity for r in survivors.survivors(*tables(spark)).collect()}
    assert got == {0: "critical"} | {i + j: v for i in range(10, 50, 10) for j, v in enumerate(("low", "medium"))}


def test_nothing_is_estimated_that_no_result_needs(spark, monkeypatch):
    def unused(*args, **kwargs):
        raise AssertionError("an estimate that changes no survivor")

    monkeypatch.setattr(survivors, "discover_truth", unused)
    assert survivors.survivors(*tables(spark)).count() == 9


def test_claims_are_those_of_fields(spark):
    said = survivors.claims(survivors.group_members(*tables(spark)))
    assert {r.field for r in said.collect()} == {"severity"}
