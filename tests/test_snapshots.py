from tracelake.operators.snapshots import snapshot_changes

SCHEMA = "repo string, snapshot_no int, file_path string, qualified_name string, source_hash string, loaded_at string, idx int, h string, change_kind string"
H = "ab" * 32


def changes(spark, *rows):
    df = spark.createDataFrame([(*r, 1, "clash", "clash") for r in rows], SCHEMA)
    return sorted(tuple("" if x is None else x for x in r) for r in snapshot_changes(df).select("repo", "snapshot_no", "file_path", "qualified_name", "change_kind").collect())


def test_added_removed_changed_over_gaps(spark):
    got = changes(
        spark,
        ("r", 1, "f", "keep", H, "1"), ("r", 1, "f", "gone", H, "1"), ("r", 1, "f", "edit", H, "1"),
        ("r", 4, "f", "keep", "sha256:" + H.upper(), "1"), ("r", 4, "f", "edit", "cd", "1"), ("r", 4, "f", "new", H, "1"),
        ("r", 6, "f", "keep", H, "1"), ("r", 6, "f", "gone", H, "1"), ("r", 6, "f", "edit", "cd", "1"),
    )
    assert got == sorted([("r", 4, "f", "gone", "removed"), ("r", 4, "f", "edit", "changed"), ("r", 4, "f", "new", "added"), ("r", 6, "f", "new", "removed"), ("r", 6, "f", "gone", "added")])


def test_null_hash_equals_only_null(spark):
    got = changes(spark, ("r", 1, "f", "a", None, "1"), ("r", 2, "f", "a", None, "1"), ("r", 3, "f", "a", H, "1"), ("r", 4, "f", "a", None, "1"))
    assert got == [("r", 3, "f", "a", "changed"), ("r", 4, "f", "a", "changed")]


def test_latest_row_counts_and_repeats_do_not(spark):
    got = changes(spark, ("r", 1, "f", "a", "11", "1"), ("r", 2, "f", "a", "22", "1"), ("r", 2, "f", "a", "11", "2"), ("r", 2, "f", "a", "11", "2"), ("r", 2, "f", "a", "33", None))
    assert got == []


def test_null_scope_and_null_key_parts(spark):
    got = changes(spark, (None, 1, "f", "a", H, "1"), ("r", None, "f", "a", H, "1"), ("r", 1, None, "a", H, "1"), ("r", 2, None, "a", H, "1"), ("r", 2, None, None, H, "1"))
    assert got == [("r", 2, "", "", "added")]


def test_empty_and_single_delivery(spark):
    assert changes(spark) == []
    assert changes(spark, ("r", 1, "f", "a", H, "1")) == []


def test_a_whole_delivery_may_vanish_for_a_key(spark):
    got = changes(spark, ("r", 1, "f", "a", H, "1"), ("r", 2, "g", "b", H, "1"), ("r", 3, "f", "a", H, "1"))
    assert got == sorted([("r", 2, "f", "a", "removed"), ("r", 2, "g", "b", "added"), ("r", 3, "f", "a", "added"), ("r", 3, "g", "b", "removed")])
