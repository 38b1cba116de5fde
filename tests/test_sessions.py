"""Sessions: candidates, failures, and a stream against a replay."""

import math
import random
import time

import pytest

from textloom.streaming import sessions as Z


# What a chunk makes to be scored, whole and in order.
@pytest.mark.parametrize(
    ("args", "want"),
    [
        ((0, 3, 2, 12), ["0-0", "0-1", "1-1", "1-2", "2-2"]),
        ((5, 2, 3, 1), ["3-5", "4-5", "4-6", "5-5", "5-6", "6-6"]),
        ((10, 1, 2, 12), [f"{s}-{e}" for s in range(11) for e in (s, s + 1) if e < 11]),
        ((4, 0, 12, 12), []),
    ],
)
def test_candidates(args, want):
    assert [f"{s}-{e}" for s, e in Z.candidate_spans(*args)] == want


def test_number_of_candidates():
    assert len(Z.candidate_spans(10, 1, 2, 12)) == 21


def test_overflow_leaves_the_session_usable():
    """Nine tokens of which the prompt takes five: a chunk of three words goes in, two more don't, one does."""
    s = Z.Session(("ship", "port"), 2, capacity=9)
    two = lambda label, text: 0.9 if (label, text) in {("ship", "Vega"), ("port", "Oslo")} else 0.2
    assert [x[:2] for x in s.append("Vega left Oslo", 0.6, two)] == [("ship", "Vega"), ("port", "Oslo")]
    before = (s.text, s.tokens, dict(s.scores), list(s.ends))
    with pytest.raises(Z.Overflow, match="8 \\+ 2"):
        s.append(" for good", 0.6, two)
    assert (s.text, s.tokens, dict(s.scores), list(s.ends)) == before
    assert [x[0] for x in s.append(" today", 0.6, two)] == ["ship", "port"] and s.tokens == 9
    assert s.append("  ", 0.6, two) == s.snapshot(0.6) and s.text == "Vega left Oslo today  "


def test_failure_closes_and_threshold_is_strict():
    s = Z.Session(("person",), 1)
    assert s.append("alice", 0.5, lambda *a: 0.5) == []
    with pytest.raises(ZeroDivisionError):
        s.append(" bob", 0.5, lambda *a: 1 / 0)
    with pytest.raises(Z.Closed):
        s.append(" carol", 0.5, lambda *a: 1.0)
    with pytest.raises(ValueError):
        Z.Session(())


def test_chunks_equal_one_text():
    whole, parts = Z.Session(("a", "b"), 3), Z.Session(("a", "b"), 3)
    text = "one two three four five six seven eight nine ten"
    for w in text.split(" "):
        last = parts.append(("" if not parts.text else " ") + w, 0.8)
    assert last == whole.append(text, 0.8)
    assert parts.append(None, 0.8) == last


def test_stream_equals_replay(spark, tmp_path):
    rows = [(f"s{k % 3}", k // 3, f"word{k} alpha beta{k} ") for k in range(12)]
    kind = "session_id string, seq long, chunk string"
    want = {(r.session_id, r.seq): r.entities for r in Z.replay(spark.createDataFrame(rows, kind), ("x", "y"), 0.7, 2).collect()}
    for half in (rows[:6], rows[6:]):
        spark.createDataFrame(half, kind).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    source = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = Z.stream(source, ("x", "y"), 0.7, 2).writeStream.format("memory").queryName("sessions_out").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    got = spark.table("sessions_out").collect()
    late = [r for r in got if r.error]
    assert {(r.session_id, r.seq): r.entities for r in got if not r.error} == {k: v for k, v in want.items() if k not in {(r.session_id, r.seq) for r in late}}


def test_only_new_parts_are_written():
    s = Z.Session(("a",), 2, right=1)
    s.append("one two three", 0.5)
    chunks, words, spans = s.written()
    assert chunks == ["one two three"] and words == [(0, 3), (4, 7), (8, 13)] and spans == sorted(s.scores)
    s.append(" four", 0.5)
    s.append(" ", 0.5)
    chunks, words, spans = s.written()
    assert chunks == [" four", " "] and words == [(14, 18)]
    assert spans == [(1, 2), (2, 2), (2, 3), (3, 3)]  # what ends in the last two words
    assert s.written() == ([], [], [])


def test_class_sessions():
    s = Z.ClassSession(capacity=4)
    sizes = lambda label, text: len(text) / 10 - int(label)
    s.append("ab cd")
    assert s.classify(["0", "1"], 0.5, score=sizes) == [("0", pytest.approx(1 / (1 + math.exp(-2.0))))]
    assert [x[0] for x in s.classify(["2", "0", "1"], 0.9, True, sizes)] == ["0", "1", "2"]
    assert sum(x[1] for x in s.classify(["2", "0", "1"], 0.9, True, sizes)) == pytest.approx(1)
    assert s.classify([], 0.0) == [] == s.classify([], 0.0, True)
    s.append(None)
    s.append("")
    s.append(" \n")
    assert (s.text, s.tokens) == ("ab cd \n", 2)
    with pytest.raises(Z.Overflow):
        s.append("x y z")
    s.append("ef gh")
    assert s.tokens == 4
    with pytest.raises(ZeroDivisionError):
        s.classify(["a"], 0.5, score=lambda *a: 1 / 0)
    with pytest.raises(Z.Closed, match="ZeroDivision"):
        s.append("x")
    t = Z.ClassSession()
    t.close()
    with pytest.raises(Z.Closed):
        t.classify(["a"], 0.5)


def run(spark, tmp_path, kind, batches, start, name):
    """Rows of a stream whose input comes in ``batches``, each by itself; every row of them gives one."""
    total = 0
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(kind).json(str(tmp_path / "in"))
    query = start(source).writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        for k, rows in enumerate(batches):
            if callable(rows):
                rows()
            else:
                spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
                total += sum(x[1] is not None for x in rows)
            # with timers there is always another batch to come, so that "all available" has no end
            until = time.monotonic() + 60
            while spark.table(name).count() < total and time.monotonic() < until and query.isActive:
                time.sleep(0.2)
    finally:
        query.stop()
    return spark.table(name).collect()


def test_close_and_late_chunks(spark, tmp_path):
    kind = "session_id string, seq long, chunk string"
    batches = [[("s", 1, "alpha beta"), ("s", 0, "gamma ")], [("s", 1, "again"), ("s", 4, " delta")], [("s", None, None), ("t", 7, "other")], [("s", 0, "new text")]]
    got = run(spark, tmp_path, kind, batches, lambda x: Z.stream(x, ("x", "y"), 0.4, 2), "closed_out")
    errors = {(r.session_id, r.seq): r.error for r in got if r.error}
    assert errors == {("s", 1): Z.LATE}
    tokens = [(r.session_id, r.seq, r.input_tokens) for r in got if not r.error]
    assert sorted(tokens) == [("s", 0, 6), ("s", 0, 7), ("s", 1, 8), ("s", 4, 9), ("t", 7, 6)]
    whole = Z.Session(("x", "y"), 2)
    whole.append("gamma ", 0.4)
    whole.append("alpha beta", 0.4)
    want = [(t, w, a, z) for t, w, _, a, z in whole.append(" delta", 0.4)]
    assert [(e.type, e.text, e.start, e.end) for r in got if r.seq == 4 for e in r.entities] == want and want
    fresh = Z.Session(("x", "y"), 2).append("new text", 0.4)
    assert [x[1] for x in fresh] in [[e.text for e in r.entities] for r in got if r.session_id == "s" and r.seq == 0]


def test_a_time_without_chunks_frees_the_session(spark, tmp_path):
    kind = "session_id string, seq long, chunk string"
    batches = [[("s", 5, "alpha beta")], lambda: time.sleep(3), [("t", 0, "wakes the timers")], [("s", 0, "gamma")]]
    got = run(spark, tmp_path, kind, batches, lambda x: Z.stream(x, ("x",), 0.4, 2, idle_ms=1000), "idle_out")
    # seq 0 isn't late any more, and the count of tokens begins anew
    assert {(r.session_id, r.seq, r.input_tokens, r.error) for r in got} >= {("s", 5, 5, None), ("s", 0, 4, None)}


def test_class_stream_equals_replay(spark, tmp_path):
    kind = "session_id string, seq long, chunk string, labels array<string>"
    r = random.Random(4)
    rows = [(f"s{k % 3}", k // 3, r.choice(["alpha ", "beta gamma ", "", None]), r.choice([None, [], ["x"], ["x", "y", "z"], ["q", "r"]])) for k in range(30)]
    want = {(x.session_id, x.seq): (x.classes, x.tokens, x.error) for x in Z.replay_classes(spark.createDataFrame(rows, kind), 0.6).collect()}
    got = run(spark, tmp_path, kind, [rows[:9], rows[9:15], rows[15:]], lambda x: Z.stream_classes(x, 0.6), "classes_out")
    assert {(x.session_id, x.seq): (x.classes, x.tokens, x.error) for x in got} == want
    assert sum(len(v[0] or ()) for v in want.values()) > 10
    assert {v[0] is None for k, v in want.items() if [x[3] for x in rows if (x[0], x[1]) == k] == [None]} == {True}
