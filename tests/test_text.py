"""Word splitting goldens and text functions."""

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T

GOLDENS = [
    ("Über b_c.d+e@mail-7.io: www.x.org/?q=1 (HTTPS://Y.z)", [("über", 0, 4), ("b_c.d+e@mail-7.io", 5, 22), (":", 22, 23), ("www.x.org/?q=1", 24, 38), ("(", 39, 40), ("https://y.z)", 40, 52)]),
    ("one-two_three- four--five _x_", [("one-two_three", 0, 13), ("-", 13, 14), ("four", 15, 19), ("-", 19, 20), ("-", 20, 21), ("five", 21, 25), ("_x_", 26, 29)]),
    ("Ænima\t北京…šaľ? №5", [("ænima", 0, 5), ("北京", 6, 8), ("…", 8, 9), ("šaľ", 9, 12), ("?", 12, 13), ("№", 14, 15), ("5", 15, 16)]),
    ("@a_9, @ž @", [("@a_9", 0, 4), (",", 4, 5), ("@", 6, 7), ("ž", 7, 8), ("@", 9, 10)]),
]


def test_web_goldens(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(GOLDENS)], "id int, text string")
    got = {r.id: [(w.w, w.s, w.e) for w in r.words] for r in T.with_words(rows, T.Preset(T.WEB, lower=True)).collect()}
    for i, (_, want) in enumerate(GOLDENS):
        assert got[i] == want


def test_period_nulls_and_blanks(spark):
    rows = spark.createDataFrame([(0, "See http://a.b/c"), (1, "Off!"), (2, None), (3, "  \n"), (4, "")], "id int, text string")
    got = {r.id: [(w.w, w.s, w.e) for w in r.words] for r in T.with_words(rows, T.WEB_WORDS).collect()}
    assert got[0] == [("see", 0, 3), ("http://a.b/c", 4, 16), (".", 16, 16)]
    assert got[1] == [("off", 0, 3), ("!", 3, 4)]
    assert got[2] == got[3] == got[4] == []


def test_ascii_splits_accents(spark):
    rows = spark.createDataFrame([("naïf",)], "text string")
    assert [w.w for w in T.with_words(rows).first().words] == ["na", "ï", "f"]
    assert [w.w for w in T.with_words(rows, T.Preset(T.UNICODE)).first().words] == ["naïf"]


def test_offsets_cut_the_text(spark):
    text = "a  b\tc-d 😀 e_f\n" * 40
    rows = T.with_words(spark.createDataFrame([(text,), ("x",)], "text string"), T.Preset(T.UNICODE)).collect()
    for r in rows:
        assert all(r.text[w.s : w.e] == w.w for w in r.words)


def test_numbers(spark):
    row = spark.range(1).select(
        T.softmax(F.array(F.lit(1000.0), F.lit(1000.0), F.lit(999.0))).alias("p"),
        T.argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0))).alias("a"),
        T.dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0))).alias("d"),
        T.semantic(F.lit(" A  b\n")).alias("s"),
        T.stripped(F.lit(" x y ")).alias("t"),
        T.strict_subset(T.token_set(F.lit("a b")), T.token_set(F.lit("b c A"))).alias("sub"),
        T.utf16_offset(F.lit("a😀b"), F.lit(2)).alias("u"),
    ).first()
    assert sum(row.p) == pytest.approx(1) and row.p[0] == row.p[1]
    assert (row.a, row.d, row.s, row.t, row["sub"], row.u) == (1, 11.0, "a b", "x y", True, 3)


def test_running_sums_some_lists_at_a_time():
    import pyarrow as pa

    lists = [[3, 1], [], [2] * 9, [5], [1, 1, 1], []]
    want = [[3, 4], [], [2 * (i + 1) for i in range(9)], [5], [1, 2, 3], []]
    for size in (1, 4, 100):
        assert T.summed_lists(pa.array(lists, pa.list_(pa.int32())), size).to_pylist() == want
    assert T.summed_lists(pa.array(lists, pa.list_(pa.int32())).slice(2, 2), 4).to_pylist() == want[2:4]
