"""Model outputs as columns: padded, short and missing tensors."""

import random

from pyspark.sql import functions as F

from textloom.functions.text import with_words
from textloom.operators import spans as S
from textloom.operators import tensors as T
from textloom.operators.schema import Field


def texts(spark, rows, kind):
    return with_words(spark.createDataFrame(rows, f"id int, text string, x {kind}")).orderBy("id")


def test_span_tensors(spark):
    one = [[[0.1, 0.9], [0.8, 0.2], [0.3, 0.95], [0.99, 0.99]], [[0.72, 0.1], [0.2, 0.2], [0.75, 0.1], [0.9, 0.9]]]
    rows = [(0, "Ada met Bo", [one, [[[1.0]]]]), (1, "Ada", [one]), (2, "Ada met", None), (3, "", [one]), (4, None, [one]), (5, "a b c", []), (6, "a b", [[[[0.9]]]])]
    out = T.spans_of(texts(spark, rows, "array<array<array<array<float>>>>"), "x", ["p", "q"], 0.7, 2).collect()
    got = [[(c.label, c.text, c.first, c.last) for c in r.cands] for r in out]
    # behind the end of a text nothing counts: not a fourth word, nor two words from the third on
    assert got[0] == [("p", "Ada met", 0, 1), ("p", "met", 1, 1), ("q", "Ada", 0, 0), ("q", "Bo", 2, 2)]
    assert got[1] == [("q", "Ada", 0, 0)] and got[2] == got[3] == got[4] == got[5] == [] and got[6] == [("p", "a", 0, 0)]
    assert all([c.ord for c in r.cands] == sorted(c.ord for c in r.cands) for r in out)


def test_instances(spark):
    best = lambda i, p=0.9: [[p if k == i else 0.1] for k in range(3)]
    tensor = [[best(0), best(2)], [best(1), best(1, 0.3)], [best(0), best(2, 0.8)]]
    rows = [(n, "x y z", tensor) for n in range(6)] + [(6, "x y z", None), (7, "", tensor)]
    table = texts(spark, rows, "array<array<array<array<double>>>>")
    both = T.structures_of(T.relations_of(table, "x", F.col("id"), ["h", "t"], 0.5, 1), "x", F.col("id"), (Field("h"), Field("t", "LIST", None, ("zed",))), 0.5, 1).orderBy("id").collect()
    # equal offsets: the first instance stays; an instance that lacks a field is no relation, but a structure
    assert [[[s.text for s in x.fields] for x in r.relations] for r in both] == [[], [["x", "z"]], [["x", "z"]], [["x", "z"]], [["x", "z"]], [["x", "z"]], [], []]
    assert [len(r.structures) for r in both] == [0, 1, 2, 3, 3, 3, 0, 3]
    assert [{k: [s.text for s in v] for k, v in x.items()} for x in both[3].structures] == [{"h": ["x"], "t": ["zed"]}, {"h": ["y"]}, {"h": ["x"], "t": ["zed"]}]
    assert both[7].structures == [{}, {}, {}]


def test_token_tensors_against_loops(spark):
    r = random.Random(6)
    data = []
    for k in range(40):
        n = r.randrange(0, 9)
        data.append((k, " ".join(f"w{i}" for i in range(n)), [[[r.choice([-2.0, 0.5, 1.0, 2.0]) for _ in range(3)] for _ in range(2)] for _ in range(r.choice([n, 9, max(n - 1, 0)]))]))
    out = T.tokens_of(texts(spark, data, "array<array<array<double>>>"), "x", ["a", "b", "c"], 0.6).collect()
    sure = {-2.0: 0.1192, 0.5: 0.6225, 1.0: 0.7311, 2.0: 0.8808}
    total = 0
    for row, (_, text, x) in zip(out, data, strict=True):
        n, want = len(text.split()), []
        p = [[[sure[v] for v in c] for c in w] for w in x[:n]] + [[[0.0] * 3] * 2] * (n - len(x))
        for i in range(n):
            for c in range(2):
                for j in range(i, n):
                    if min(p[m][c][T.INSIDE] for m in range(i, j + 1)) < 0.6:
                        break
                    if p[i][c][T.START] >= 0.6 and p[j][c][T.END] >= 0.6:
                        want.append(("ab"[c], i, j, round(min(p[i][c][T.START], p[j][c][T.END], *(p[m][c][T.INSIDE] for m in range(i, j + 1))), 4)))
        assert sorted((c.label, c.first, c.last, round(c.p, 4)) for c in row.cands) == sorted(want)
        total += len(want)
    assert total > 50


def test_greedy_over_tensors(spark):
    rows = texts(spark, [(0, "a b c", [[[[0.9, 0.95, 0.1], [0.8, 0.1, 0.1], [0.7, 0.1, 0.1]]]])], "array<array<array<array<double>>>>")
    out = T.spans_of(rows, "x", ["p"], 0.5, 3).select(S.greedy(F.col("cands")).alias("c")).first().c
    assert [x.text for x in out] == ["a b", "c"]
