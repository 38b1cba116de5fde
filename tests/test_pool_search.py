"""Searches over every vector, against brute force."""

import random

import pytest

from textloom.operators import pool as P
from textloom.plans import tasks


@pytest.fixture
def table(spark, tmp_path):
    """60 vectors whose ids start at 1000, with copies, so that scores tie."""
    r = random.Random(3)
    vectors = [[r.randint(-8, 8) / 8 for _ in range(4)] for _ in range(40)]
    rows = [(1000 + k, vectors[k % 40], k % 3) for k in range(60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    return str(tmp_path), rows


def _tied(v):
    return (int(abs(v) * 1e5 + 0.5) / 1e5) * (1 if v >= 0 else -1)


def _scores(rows):
    return {(q, at): _tied(sum(x * y for x, y in zip(a, e, strict=True))) for q, a, _ in rows for at, e, _ in rows}


@pytest.mark.parametrize("block", [P.BLOCK, (16, 25)])
def test_every_vector_is_a_query(spark, table, monkeypatch, block):
    monkeypatch.setattr(P.nearest, "__defaults__", (block,))
    path, rows = table
    v = _scores(rows)
    want = {(q, at, n) for q, *_ in rows for n, at in enumerate(sorted((r[0] for r in rows), key=lambda at: (-v[q, at], at))[:10])}
    got = tasks.queries()["pool_topk_all"](spark, path).collect()
    assert {(r.q, r.vec, r["rank"]) for r in got} == want and len(got) == 600
    assert all(abs(r.v - v[r.q, r.vec]) < 1e-4 for r in got)


def test_quota_pools_of_every_vector(spark, table, monkeypatch):
    monkeypatch.setattr(P.nearest, "__defaults__", ((16, 25),))
    path, rows = table
    v, want = _scores(rows), set()
    for label in range(3):
        own = [r[0] for r in rows if r[2] == label]

        def pairs(score, own=own):
            best = sorted(own, key=lambda at: (-score(at), at))[:8]
            return [(score(s) + score(e), x * 8 + y, s, e) for x, s in enumerate(best) for y, e in enumerate(best) if e > s]

        pool = pairs(lambda at: max(v[q[0], at] for q in rows))
        for q, *_ in rows:
            top = sorted(pairs(lambda at, q=q: v[q, at]), key=lambda p: (-p[0], p[1]))[:3]
            pool += [(5003.0 - n, q * 3 + n - (1 << 40), s, e) for n, (_, _, s, e) in enumerate(top)]
        once = {}
        for p in sorted(pool, key=lambda p: (-p[0], p[1])):
            once.setdefault(p[2:], p)
        want |= {(label, p[2], p[3], n) for n, p in enumerate(list(once.values())[:12])}
    got = tasks.queries()["pool_quota_all"](spark, path).collect()
    assert {(r.label, r.s, r.e, r["rank"]) for r in got} == want


def test_null_vectors_score_null(spark):
    rows = spark.createDataFrame([(1, [1.0]), (2, None)], "at long, e array<float>")
    got = P.nearest(rows.selectExpr("at AS q", "e AS qe"), rows, None, 2).collect()
    assert {(r.q, r.at): r.v for r in got} == {(1, 1): 1.0, (1, 2): None, (2, 1): None, (2, 2): None}
