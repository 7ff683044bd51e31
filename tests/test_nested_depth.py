"""Wrapping of any depth around a report."""

import json

import pytest

from tracelake.operators import nested


def test_find_key_at_any_depth():
    value = {"results": [1]}
    for i in range(150):
        value = [value] if i % 2 else {"report": value}
    assert nested.find_key(value, "results") == {"results": [1]}
    assert nested.find_key(json.dumps(value), "results") is not None
    assert nested.find_key(value, "absent") is None


def test_deeper_than_the_reader(spark):
    n = 200_000
    report = '{"results": {"packages": [{"package": {"name": "p"}, "groups": {"max_severity": 7.50, "aliases": ["A", null, "B"]}}]}}'
    deep = '{"a": ' * n + report + ', "b": [' + "[" * n + "]" * n + "]" + "}" * n
    broken = deep[:-1]
    df = spark.createDataFrame([(1, deep), (2, broken)], "doc_id bigint, body string")
    got = [(r.doc_id, r.entity, r.pos, r.value) for r in nested.label_documents(df).orderBy("pre").collect()]
    assert got == [(1, "result", 0, ""), (1, "package", 0, "p"), (1, "group", 0, "7.50"), (1, "alias", 0, "A"), (1, "alias", 2, "B")]
    for text in ('{"a": [1, -2.5e3, true, null, "x\\u00e9"], "b": {}, "c": []}', "[]", '"x"', "1", '[{"a": {"b": [[]]}}]'):
        assert nested._parse_deep(text) == nested.parse_json(text)
        assert nested._write_deep(nested._parse_deep(text)) == __import__("json").dumps(nested.parse_json(text), ensure_ascii=False)
    for text in ("[1,]", "{1: 2}", '{"a" 1}', "[1 2]", "[NaN]", "[01]", "[}", "", "1 2", '{"a": 1,}', "[,1]"):
        with pytest.raises(ValueError):
            nested._parse_deep(text)
