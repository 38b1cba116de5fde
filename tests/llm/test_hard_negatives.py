"""Hard negatives against brute force, with ties, repeats and odd rows, in blocks of any size."""

import math
import random

import numpy as np
import pytest

from textloom.llm import hard_negatives as H

KIND = "vec_id long, embedding array<float>, label int, row string, v string, norm string, pack int, wants string"


def brute(rows):
    """All (anchor, positive, rank, negative, scores), by all pairs."""
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in e], y) for i, e, y in rows if i is not None and y is not None and e is not None and all(x is not None and math.isfinite(x) and abs(x) < H.LARGEST for x in e)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for k, (i, q, y) in enumerate(ok):
        if i % 100:
            continue
        scored = [(-dot(q, e), j, n, z) for n, (j, e, z) in enumerate(ok) if n != k]
        for p, pid, _, _ in sorted(x for x in scored if x[3] == y)[:5]:
            found = [x for x in sorted(scored) if x[3] != y and 30 * -p <= 100 * -x[0] <= 90 * -p][:10]
            out += [(i, pid, r + 1, x[1], -p, -x[0]) for r, x in enumerate(found)]
    return sorted(out)


def got(spark, rows):
    table = spark.createDataFrame([(*r, "", "", "", 0, "") for r in rows], KIND)
    return sorted(tuple(r) for r in H.mined(table).collect())


def vectors(r, n, dim=6, labels=3):
    centres = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(8)]
    return [(k, [c + r.gauss(0, 0.6) for c in r.choice(centres)], r.randrange(labels)) for k in range(n)]


@pytest.mark.parametrize(("block", "page", "shelf", "first"), [(2048, 256, 4096, 2), (7, 2, 3, 1)])
def test_equals_brute_force(spark, monkeypatch, block, page, shelf, first):
    for name, value in (("BLOCK", block), ("PAGE", page), ("SHELF", shelf), ("FIRST", first)):
        monkeypatch.setattr(H, name, value)
    r = random.Random(block)
    rows = vectors(r, 450)
    same = rows[3][1]
    rows += [(1000 + k, same, k % 2) for k in range(60)]  # one vector many times
    rows += [(2000, rows[9][1], rows[9][2]), (2100, [0.0] * 6, 1), (2200, [-x for x in same], 0)]
    want = brute(rows)
    assert got(spark, rows) == want and len(want) > 100


def test_odd_rows(spark):
    r = random.Random(1)
    rows = vectors(r, 40, 4, 2)
    rows += [(None, [1.0] * 4, 0), (200, None, 1), (300, [1.0, None, 1.0, 1.0], 0), (400, [1.0, math.nan, 0.0, 0.0], 0), (500, [math.inf] * 4, 1), (600, [1.0] * 4, None), (700, [1e9] * 4, 0)]
    rows += [(100, [], 0), (800, [2.0], 1), (900, [0.5, 0.5, 0.25, 1.0, 3.0], 0), (1000, [1.0] * 4, 9)]
    rows += [(0, rows[0][1], rows[0][2]), (7, rows[7][1], 1)]  # ids that come twice
    assert got(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert got(spark, []) == []
    assert got(spark, [(0, None, 1)]) == []


def test_brackets_hold():
    r = np.random.default_rng(3)
    v = r.integers(-300, 300, (200, 9))
    most = float((v**2).sum(1).max())
    pivots = np.column_stack([v[:5].astype(float), np.sqrt(most - (v[:5] ** 2).sum(1))])
    d, dq = (H.to_pivots(x, pivots, most, a).astype(np.float32) for x, a in ((v, False), (v[:20], True)))
    page = H.Pack({"pack": 0, "label": 0, "n": 20, "width": 9, "rows": np.arange(20).tobytes(), "ids": np.arange(20).tobytes(), "kind": "<i8", "v": v[:20].astype("<i8").tobytes(), "d": dq.tobytes(), "wants": b""})
    low, high = H.brackets(page, d.astype(float), d.astype(float), most)
    scores = v[:20] @ v.T
    assert (low <= scores).all() and (scores <= high).all()
    assert (high - low).mean() < 2 * most


def test_products_are_exact():
    a, b = np.array([[131071 * 256, 1]]), np.array([[131071 * 256, 3], [-5, 2]])
    assert H.products(a, b).tolist() == [[(131071 * 256) ** 2 + 3, -5 * 131071 * 256 + 2]]
