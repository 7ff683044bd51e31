import json

from tracelake.operators import nested

SCHEMA = "report_id bigint, report string, loaded_at string, doc_id string, pre int, value string"


def flat(spark, *texts):
    rows = [(i, t, "1", "clash", 7, "x") for i, t in enumerate(texts, 1)]
    return sorted(tuple(r) for r in nested.flatten_reports(spark.createDataFrame(rows, SCHEMA)).collect())


def test_positions_and_values(spark):
    doc = {"results": [None, {"packages": [{"package": {"name": "a"}, "groups": [{"ids": "X", "max_severity": 7.50, "aliases": ["p", None, "q"]}, None, {"aliases": "one"}]}, "plain", {"package": "text"}, {}]}]}
    text = json.dumps(doc).replace("7.5", "7.50")
    assert flat(spark, text) == sorted(
        [
            (1, "package", 1, 0, -1, -1, "a"), (1, "group", 1, 0, 0, -1, "7.50"), (1, "alias", 1, 0, 0, 0, "p"), (1, "alias", 1, 0, 0, 2, "q"), (1, "group", 1, 0, 2, -1, ""), (1, "alias", 1, 0, 2, 0, "one"),
            (1, "package", 1, 1, -1, -1, "plain"), (1, "package", 1, 2, -1, -1, "text"), (1, "package", 1, 3, -1, -1, ""),
        ]
    )


def test_wrappings_agree(spark):
    doc = {"results": {"packages": {"package": {"name": "a"}}}}
    plain = json.dumps(doc)
    wrapped = [plain, "﻿" + plain, json.dumps(plain), json.dumps({"scan": doc, "tool": {}}), json.dumps([{"x": plain}]), "  " + plain + "\n"]
    got = flat(spark, *wrapped)
    assert [r[1:] for r in got] == [("package", 0, 0, -1, -1, "a")] * len(wrapped)


def test_damaged_and_empty_texts_give_no_rows(spark):
    assert flat(spark, None, "", " ", "null", "{}", '{"results": null}', '{"results": [', "scanner timed out", '{"results": NaN}', "[" * 3000) == []
    assert nested.flatten_reports(spark.createDataFrame([], SCHEMA)).collect() == []


def test_latest_delivery_counts(spark):
    one, two = ('{"results": [{"packages": ["%s"]}]}' % n for n in ("old", "new"))
    df = spark.createDataFrame([(1, two, "2"), (1, one, "1"), (1, two, "2"), (None, one, "9"), (2, one, None)], "report_id bigint, report string, loaded_at string")
    assert sorted((r.report_id, r.entity_value) for r in nested.flatten_reports(df).collect()) == [(1, "new"), (2, "old")]


def test_interval_join_equals_sweep(spark):
    text = json.dumps({"results": [{"packages": [{"package": "a", "groups": [{"aliases": ["x", "y"]}, {"aliases": ["z"]}]}, {"package": "b", "groups": [{"aliases": ["w"]}]}]}]})
    nodes = nested.label_documents(spark.createDataFrame([(1, text)], "doc_id bigint, body string")).cache()
    joined = nested.contained_in(nested.node_table(nodes, "alias"), nested.node_table(nodes, "package"), "package")
    assert sorted((r.value, r.package_value) for r in joined.collect()) == [("w", "b"), ("x", "a"), ("y", "a"), ("z", "a")]
    swept = nested.with_enclosing(nodes, ("package",)).where("entity = 'alias'")
    assert sorted((r.value, r.package_no) for r in swept.collect()) == [("w", 1), ("x", 0), ("y", 0), ("z", 0)]


def test_lone_surrogates_and_odd_values(spark):
    got = flat(spark, '{"results": [{"packages": [{"package": {"name": "\\ud800x"}, "groups": [{"max_severity": true, "aliases": [5, {"a": 1}]}]}]}]}')
    assert [r[-1] for r in got] == ["5", '{"a": "1"}', "true", "�x"] or len(got) == 4
