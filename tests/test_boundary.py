"""Boundary evidence, pools, arguments and label embeddings against plain restatements."""

import math
import random

import pytest
from pyspark.sql import functions as F

from textloom.functions.text import prefix_sums, with_words
from textloom.operators import boundary as B
from textloom.operators import spans as S
from textloom.operators.scorer import HashScorer
from test_extraction import WORD, score

NAMES = ("x", "y", "z")


def logits(text):
    words = [m.group() for m in WORD.finditer(text)]
    part = lambda label, what: [4 * score(f"{label}:{what}:{i}", w) - 2 for i, w in enumerate(words)]
    return {y: {what: part(y, what) for what in ("start", "inside", "end")} for y in NAMES}


def plain_pool(marks, n, k, quota, size):
    top = lambda v, at: sorted(range(len(v)), key=lambda i: (-v[i], at + i))[:k]
    a = [max(marks[y]["start"][i] for y in NAMES) for i in range(n)]
    z = [max(marks[y]["end"][i] for y in NAMES) for i in range(n)]
    pairs = [(a[s] + z[e], x * k + y, s, e + 1) for x, s in enumerate(top(a, 0)) for y, e in enumerate(top(z, 1)) if e + 1 > s]
    every = [(v, i, s, e) for v, i, s, e in pairs]
    for place, y in enumerate(NAMES):
        own = sorted(pairs, key=lambda p: (-(marks[y]["start"][p[2]] + marks[y]["end"][p[3] - 1]), p[1]))[:quota]
        every += [(5000 + quota - r, place * quota + r - (1 << 40), p[2], p[3]) for r, p in enumerate(own)]
    out = []
    for _, _, s, e in sorted(every, key=lambda p: (-p[0], p[1])):
        if (s, e) not in out:
            out.append((s, e))
    return out[:size]


@pytest.mark.parametrize(("k", "quota", "size"), [(8, 2, 24), (3, 1, 5), (2, 5, 50)])
def test_pools_and_probabilities(spark, k, quota, size):
    r = random.Random(k)
    texts = [" ".join(r.choice(["ab", "cd", "e-f", "!", "gh"]) for _ in range(n)) for n in (1, 2, 5, 17, 40)] + ["", None, "  "]
    rows = with_words(spark.createDataFrame(list(enumerate(texts)), "id int, text string"))
    rows = B.with_pool(B.with_evidence(B.marks(rows, NAMES, HashScorer())), k, quota, size)
    got = {x.id: x for x in B.candidates(rows, 0.6, 1.5, size).collect()}
    found = 0
    for i, text in enumerate(texts):
        marks = logits(text or "")
        n = len(marks["x"]["start"])
        pool = plain_pool(marks, n, k, quota, size)
        assert [(p.s, p.e) for p in got[i].pool] == pool
        want = []
        for y in NAMES:
            for s, e in pool:
                m = marks[y]
                p = 1 / (1 + math.exp(-(m["start"][s] + m["end"][e - 1] + sum(m["inside"][s:e]) / math.sqrt(e - s)) / 1.5))
                if p >= 0.6:
                    want.append((y, s, e - 1, pytest.approx(p)))
        assert [(c.label, c.first, c.last, c.p) for c in got[i].cands] == want
        found += len(want)
    assert found > 10


def test_prefixes_are_centred(spark):
    lists = [[[1.0, 2.0, 6.0], [], [5.0]], [], [[-1.0, 1.0]]]
    rows = spark.createDataFrame([(i, [{"label": "l", "a": m, "m": m, "z": m} for m in x]) for i, x in enumerate(lists)], "id int, marks array<struct<label string, a array<double>, m array<double>, z array<double>>>").coalesce(1)
    out = {r.id: r for r in B.with_evidence(rows).collect()}
    assert out[0].prefix == [[0.0, -2.0, -3.0, 0.0], [0.0], [0.0, 0.0]] and out[0]["mean"] == [3.0, 0.0, 5.0]
    assert out[1].prefix == [] and out[2].prefix == [[0.0, -1.0, 0.0]]
    for n in (0, 1, 2, 3, 4, 5, 16, 17, 1000):
        got = spark.createDataFrame([([float(i) for i in range(n)],)], "v array<double>").select(prefix_sums(F.col("v")).alias("p")).first().p
        assert got == [i * (i - 1) / 2 for i in range(n + 1)]
    one = B.with_evidence(rows).where("id = 0").select(B.evidence(F.get("prefix", F.lit(0)), F.get("mean", F.lit(0)), F.lit(1), F.lit(3)).alias("v")).first().v
    assert one == pytest.approx(8 / math.sqrt(2))


def test_temperature_and_compatibility(spark):
    rows = spark.createDataFrame([([1.0, 2.0, 2.0, 0.0], [3.0, 0.5, 1.0, 9.0])], "a array<double>, b array<double>")
    got = rows.select(B.compatible(F.col("a"), F.col("b")).alias("c"), B.probability(F.lit(3.0), 2.0).alias("p")).first()
    assert got.c == 3.0 and got.p == pytest.approx(1 / (1 + math.exp(-1.5)))
    with pytest.raises(ValueError):
        B.probability(F.lit(1.0), 0.0)


def test_arguments(spark):
    """No pair of a span with itself, ties in the order met, and never more than asked for."""
    span = lambda i, label, a, p: {"ord": i, "label": label, "first": a, "last": a, "start": a, "end": a + 1, "text": f"w{a}", "p": p}
    cands = [span(0, "h", 0, 0.9), span(1, "h", 1, 0.9), span(2, "h", 2, 0.4), span(3, "t", 0, 0.8), span(4, "t", 3, 0.8), span(5, "t", 4, 0.7), span(6, "t", 5, 0.6)]
    rows = spark.createDataFrame([(1, cands), (2, []), (3, cands[:3])], f"id int, cands array<{S.SPAN}>")
    role = lambda label: B.arguments(F.filter("cands", lambda c: c["label"] == label), 0.5, 3)
    got = {r.id: [(p.head.first, p.tail.first, round(-p.k, 4)) for p in r.p] for r in rows.select("id", B.argument_pairs(role("h"), role("t"), 3, 4).alias("p")).collect()}
    assert got == {1: [(0, 3, 0.72), (1, 0, 0.72), (1, 3, 0.72), (0, 4, 0.63)], 2: [], 3: []}


def test_mean_vectors(spark):
    rows = [("a", [1.0, 2.0]), ("a", [3.0, None]), ("a", None), ("b", [5.0, 5.0, 5.0]), (None, [1.0]), ("c", [])]
    got = {r.k: r.v for r in B.mean_vectors(spark.createDataFrame(rows, "k string, v array<float>"), "k", "v").collect()}
    assert got == {"a": [2.0, 2.0], "b": [5.0, 5.0, 5.0]}
