import random

import pytest

from tracelake.llm import encode, leaks, survivors


@pytest.fixture(scope="module")
def body():
    try:
        return encode.tokenizer_body()
    except OSError:
        pytest.skip("no tokenizer files")


TEXTS = ["", None, " ", "plain words", "don't we'll I'D", "naïve café 漢字 ひらがな", "😀😀 é", "a" * 5000, "=" * 3000, "\n\n\t  x", "<|endoftext|>", "x y​", "0123456789" * 50, "\x00\x01"]


def test_ids_equal_the_library(body):
    tiktoken = pytest.importorskip("tiktoken")
    enc = encode.Encoder(body)
    own = tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=encode.read_ranks(body), special_tokens={})
    rng = random.Random(1)
    pool = ["a", "th", "ing", " ", "\n", "é", "漢", "==", "--", "0", "\t", "_", "😀", "tion", "'s", "ab", "zz"]
    for t in [*TEXTS, *("".join(rng.choice(pool) for _ in range(rng.randrange(1, 80))) for _ in range(300))]:
        ids = enc.encode(t)
        assert ids == (own.encode_ordinary(t) if t else [])
        assert encode.decode(ids, enc.transducer.bytes_of) == (t or "")


def test_long_pieces_are_emitted_early(body):
    enc = encode.Encoder(body)
    piece = bytes(random.Random(2).choice(b"abcdefg") for _ in range(20_000))
    out = enc.transducer.encode_piece(piece)
    assert b"".join(enc.transducer.bytes_of[i] for i in out) == piece


def test_states_may_be_dropped(body, monkeypatch):
    monkeypatch.setattr(encode, "STATES", 50)
    monkeypatch.setattr(encode, "MEMO", 5)
    a, b = encode.Encoder(body), encode.Encoder(body)
    texts = ["several different words in a row", "another line of text", "several different words"]
    assert [a.encode(t) for t in texts] == [b.encode(t) for t in texts]
    assert len(a.transducer.states) < 200


def test_utf8_stream_over_any_cut():
    text = "aé漢😀߿￿\U0010ffffz"
    raw = text.encode()
    for n in range(1, 6):
        s = encode.Utf8Stream()
        assert "".join(s.feed(raw[i : i + n]) for i in range(0, len(raw), n)) + s.close() == text
    for bad in (b"\x80", b"\xc0\x80", b"\xe2\x82", b"\xf5a", b"\xed\xa0\x80", b"a\xf0\x9f\x98"):
        s = encode.Utf8Stream()
        assert s.feed(bad) + s.close() == bad.decode("utf-8", "replace")


def test_documents(spark, body):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)] + [(0, "", "clash")], "doc_id bigint, text string, ids string")
    rows = encode.encode_documents(df, body).collect()
    assert len(rows) == len(TEXTS) + 1
    assert all(r.ids == [] for r in rows if r.doc_id in (0, 1)) and all(r.ids for r in rows if r.doc_id > 1)
    assert encode.encode_documents(spark.createDataFrame([], "doc_id bigint, text string"), body).collect() == []
    assert all(r.exact for r in encode.round_trips(df, body).collect())


# Leaks

VOCAB = [f"w{i}" for i in range(400)]
ITEM = " ".join(VOCAB[:60])
INTRO = "Read the text and answer in one short line."


def items(spark):
    rows = [(1, "s", f"{INTRO} {ITEM}."), (2, "s", f"{INTRO} {' '.join(VOCAB[100:150])}"), (3, "s", f"{INTRO} {' '.join(VOCAB[200:250])}"), (4, "s", None), (5, "s", "too short"), (1, "s", f"{INTRO} {ITEM}.")]
    return spark.createDataFrame(rows, "item_id bigint, suite string, text string")


def found(spark, *texts):
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id bigint, text string, item_id int")
    return {(r.doc_id, r.item_id) for r in leaks.find_leaks(docs, items(spark)).collect()}


def noise(n, seed):
    rng = random.Random(seed)
    return " ".join(f"z{rng.randrange(900)}" for _ in range(n))


def test_spans_edits_and_markup(spark):
    span = VOCAB[10:30]
    replaced = [*span]
    replaced[7], replaced[14] = "other", "else"
    inserted = [*span[:6], "very", *span[6:13], "really", *span[13:]]
    three = [*span]
    three[5], three[10], three[15] = "q", "q", "q"
    texts = [
        f"{noise(30, 1)} {' '.join(span)} {noise(30, 2)}",
        " ".join(VOCAB[10:29]),
        " ".join(replaced),
        " ".join(inserted),
        " ".join(three),
        "> " + "\n> ".join(" ".join(span[i : i + 4]).upper() for i in range(0, 20, 4)),
        "".join(f"<b>{w}</b>, " if i % 2 else f"**{w}**​ " for i, w in enumerate(span)),
        f"{INTRO} {INTRO} {INTRO} {noise(20, 3)}",
        None,
        "",
        " ".join([*VOCAB[0:25], *VOCAB[100:130]]),
        " ".join(w for w in span if w != span[9]),
    ]
    assert found(spark, *texts) == {(0, 1), (2, 1), (3, 1), (5, 1), (6, 1), (10, 1), (10, 2)}


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(leaks, "SHARD_WORDS", 300)
    rng = random.Random(9)
    small = [f"v{i}" for i in range(6)]
    bodies = {1: [rng.choice(small) for _ in range(40)], 2: [rng.choice(small) for _ in range(30)]}
    docs = []
    for _ in range(25):
        src = bodies[rng.choice((1, 2))]
        a = rng.randrange(len(src) - 10)
        w = list(src[a : a + rng.randrange(10, 26)])
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(w))
            if rng.random() < 0.5:
                w[i] = "x"
            else:
                w.insert(i, "y")
        docs.append(w)
    rule = leaks.Rule(span=12, edits=2)

    def holds(v, w):
        def go(j, k, left, n):
            if n >= rule.span:
                return True
            if j >= len(v) or k >= len(w):
                return False
            if v[j] == w[k] and go(j + 1, k + 1, left, n + 1):
                return True
            return left > 0 and (go(j + 1, k + 1, left - 1, n + 1) or go(j, k + 1, left - 1, n))

        return any(v[j] == w[k] and ends(v, w, j, k) for j in range(len(v)) for k in range(len(w)))

    def ends(v, w, j, k):
        best = 0

        def go(j, k, left, n):
            nonlocal best
            if j < len(v) and k < len(w):
                if v[j] == w[k]:
                    best = max(best, n + 1)
                    go(j + 1, k + 1, left, n + 1)
                elif left:
                    go(j + 1, k + 1, left - 1, n + 1)
                    go(j, k + 1, left - 1, n)

        go(j, k, rule.edits, 0)
        return best >= rule.span

    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id bigint, text string")
    it = spark.createDataFrame([(i, "s", " ".join(b)) for i, b in bodies.items()], "item_id bigint, suite string, text string")
    got = {(r.doc_id, r.item_id) for r in leaks.find_leaks(df, it, rule).collect()}
    assert got == {(d, i) for d, w in enumerate(docs) for i, v in bodies.items() if holds(v, w)}


def test_empty_sides(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert leaks.find_leaks(none, items(spark)).collect() == []
    assert leaks.find_leaks(spark.createDataFrame([(1, ITEM)], "doc_id bigint, text string"), items(spark).limit(0)).collect() == []


# Survivors

F = "finding_id bigint, source string, severity string, confidence string, cwe string, fixed_in string, reported_at timestamp_ntz, group_id int"
T = "source string, trust int"


def survive(spark, groups, rows):
    import datetime as dt

    day = {None: None} | {i: dt.datetime(2031, 1, i) for i in range(1, 9)}
    f = spark.createDataFrame([(a, b, c, d, e, g, day[h], 5) for a, b, c, d, e, g, h in rows], F)
    g = spark.createDataFrame(groups, "group_id bigint, members array<bigint>")
    t = spark.createDataFrame([("osv", 40), ("bandit", 10)], T)
    return {r.group_id: (r.severity, r.confidence, r.cwe, r.fixed_in) for r in survivors.survivors(g, f, t).collect()}


def test_fields_are_chosen_one_by_one(spark):
    rows = [
        (1, " OSV ", "N/A", "High ", "CWE-0", " 1.2 ", 1),
        (2, "bandit", "LOW", "low", "cwe-079: x", "2.0", 2),
        (3, None, "critical", "medium", "22", "3.0", 8),
        (4, "bandit", "high", None, "0", "-", 2),
        (5, "bandit", "medium", "", "n/a", "x1", None),
    ]
    got = survive(spark, [(1, [1, 2, 2, 3]), (1, [1, 2, 2, 3]), (2, [2, 4]), (3, [5, 99]), (4, [5, 4]), (5, None), (6, [None, 5, 4]), (7, [2, 2])], rows + rows[:1])
    assert got == {1: ("low", "high", "CWE-79", "1.2"), 2: ("high", "low", "CWE-79", "2.0"), 4: ("high", "", "", ""), 6: ("high", "", "", "")}


def test_declared_trust_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["osv", "bandit", "other", None]), rng.choice(["low", "high", "-"]), rng.choice(["low", ""]), rng.choice(["1", "CWE-2", "0"]), rng.choice(["1.0", "", "2"]), rng.choice([None, 1, 2])) for i in range(60)]
    groups = [(g, [rng.randrange(65) for _ in range(6)]) for g in range(25)] + [(99, list(range(60)))]
    keep = ({"low", "high"}, {"low"}, {"1", "CWE-2"}, {"1.0", "2"})
    want = {}
    for g, ids in groups:
        best = sorted((rows[i] for i in set(ids) if i < 60), key=lambda r: ({"osv": 40, "bandit": 10}.get(r[1], 0), r[6] or 0, r[0]), reverse=True)
        if len(best) > 1:
            values = [next((r[2 + k] for r in best if r[2 + k] in keep[k]), "") for k in range(4)]
            want[g] = (*values[:2], values[2] and "CWE-" + values[2].removeprefix("CWE-"), values[3])
    assert survive(spark, groups, rows) == want


def test_estimates_stay_within_declared_ranks(spark):
    rows = [(g, "cwe", v, s, t, None, 1) for g in range(20) for v, s, t in ((f"a{g}", "x", 2), (f"b{g}", "y", 1), (f"b{g}", "z", 1))]
    said = spark.createDataFrame(rows, "group_id int, field string, value string, source string, trust int, reported_at string, finding_id int")
    truth = survivors.discover_truth(said, declared=True)
    assert truth.converged and truth.rounds == 2
    assert {r.voter: r.reliability for r in truth.weights.collect()} == {"2": 2.5, "1": 1.0}
    assert all(r.value.startswith("a") for r in truth.values.collect())


def test_truth_discovery_finds_the_liar(spark):
    rows = []
    for g in range(30):
        rows += [(g, "cwe", f"v{g}", s, 0, None, 1) for s in ("a", "b", "c")]
        rows.append((g, "cwe", f"bad{g}", "liar", 0, None, 2))
    rows += [(99, "cwe", "x", "a", 0, None, 1), (99, "cwe", "y", "liar", 0, None, 2)]
    said = spark.createDataFrame(rows, "group_id int, field string, value string, source string, trust int, reported_at string, finding_id int")
    truth = survivors.discover_truth(said)
    assert truth.converged and not survivors.discover_truth(said, rounds=1).converged
    assert {r.group_id: r.value for r in truth.values.collect()} == {g: f"v{g}" for g in range(30)} | {99: "x"}
    w = {r.voter: r.reliability for r in truth.weights.collect()}
    assert w["liar"] < 0.2 < 0.6 < w["a"]
    empty = survivors.discover_truth(said.limit(0))
    assert empty.values.collect() == [] and empty.weights.collect() == []


def test_suffix_array_equals_sorting():
    import numpy as np

    rng = random.Random(5)
    for n in (0, 1, 7, 60, 400):
        texts = [[rng.randrange(1, 4) for _ in range(rng.randrange(1, 30))] for _ in range(n // 10 + 1)] * 2
        flat = np.array([x for t in texts for x in (*t, 0)], np.uint64)
        ends = [i for i, x in enumerate(flat) if x == 0]
        suffix = [tuple(int(x) for x in flat[i : next(e for e in ends if e >= i) + 1]) for i in range(len(flat))]
        order = leaks.suffix_array(flat)
        assert sorted(order.tolist()) == list(range(len(flat)))
        assert [suffix[i] for i in order] == sorted(suffix)


def test_places_and_stored_arrays(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one two " + ITEM), (2, ITEM), (3, "none of it")], "doc_id bigint, text string")
    found_ = {(r.doc_id, r.item_id): r for r in leaks.find_leaks(docs, items(spark)).collect()}
    assert found_[1, 1].doc_word - found_[1, 1].item_word == 2 + found_[2, 1].doc_word - found_[2, 1].item_word
    whole = sorted(tuple(r) for r in found_.values())
    assert sorted(tuple(r) for r in leaks.search_arrays(leaks.training_arrays(docs), items(spark)).collect()) == whole
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 1)
    monkeypatch.setattr(leaks, "PAIRS", 3)
    assert sorted(tuple(r) for r in leaks.find_leaks(docs, items(spark)).collect()) == whole
    two = items(spark).unionByName(spark.createDataFrame([(1, "s", "another text of the item that is short")], "item_id bigint, suite string, text string"))
    assert {(r.doc_id, r.item_id) for r in leaks.find_leaks(docs, two).collect()} == set(found_)
