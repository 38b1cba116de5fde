"""Importance resampling against a plain restatement, and odd tables."""

import hashlib
import math
import random
import re
import zlib

import pytest

from textloom.llm import importance as I

KIND = "doc_id long, text string, words string, buckets string, score string, rank int"


def features(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if x]
    return len(w), [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]


def plain(rows, target, percent=25):
    s, t = [0] * 10_000, [0] * 10_000
    place = lambda f: zlib.crc32(f.encode()) % 10_000
    for counts, texts in ((s, [x for _, x in rows]), (t, target)):
        for text in texts:
            for f in features(text)[1]:
                counts[place(f)] += 1
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((b + 1) * (S + 10_000) / ((a + 1) * (T + 10_000)))) for a, b in zip(s, t, strict=True)]
    out = []
    for doc_id, text in rows:
        n, fs = features(text)
        weight = sum(gain[place(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    ranks = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return sorted(((*r[:4], ranks.get(id(r))) for r in out), key=str)


def got(spark, rows, target):
    docs = spark.createDataFrame([(*r, "x", "y", "z", 0) for r in rows], KIND)
    out = I.ranked(I.scored(docs, spark.createDataFrame([(t,) for t in target], "text string")))
    return sorted((tuple(r) for r in out.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def prose(r, n):
    return " ".join(r.choice(["Alpha", "beta", "ÉCOLE", "école", "x1", "O'Neil", "foo-bar", "naïve", "Zed", "die", "Straße"]) for _ in range(n))


def test_equals_a_plain_restatement(spark):
    r = random.Random(5)
    rows = [(k, prose(r, r.choice([0, 1, 5, 19, 20, 21, 60]))) for k in range(120)]
    rows += [(None, prose(r, 40)), (200, None), (201, ""), (202, " .,\n"), (203, "ÀÉ" * 30), (204, prose(r, 20_000))]
    rows += [(205, rows[30][1]), (206, rows[30][1])]
    target = [prose(r, 15), None, "", "beta Zed beta"]
    assert got(spark, rows, target) == plain(rows, target)


def test_empty_tables_and_target(spark):
    r = random.Random(6)
    rows = [(k, prose(r, 30)) for k in range(9)]
    assert got(spark, rows, []) == plain(rows, [])
    assert got(spark, [], ["beta"]) == []


def test_ties_and_repeated_rows(spark):
    """Rows of one id and text share a score and take ranks one after another."""
    scores = [(k % 3, 30, 59, 5, s) for s in (7, 8, 900, -3) for k in range(6)]
    scores += [(9, 10, 19, 5, 10_000), (None, 25, 49, 5, 900)]
    kind = "doc_id long, n_words int, n_features long, weight long, score long"
    out = I.ranked(spark.createDataFrame(scores, kind), 50).collect()
    able = sorted((s for s in scores if s[1] >= 20), key=lambda s: (-s[4], s[0] is None, s[0] or 0))
    drawn = sorted((r for r in out if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, len(able) // 2 + 1))
    assert [(r.doc_id, r.score) for r in drawn] == [(s[0], s[4]) for s in able[: len(able) // 2]]
    assert len(out) == len(scores)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_runs_of_words(spark, n):
    text = "a b b c"
    w = text.split()
    want = sorted(zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in range(1, n + 1) for i in range(len(w) - k + 1))
    row = spark.createDataFrame([(text,)], "text string").select(I.words(I.F.col("text")).alias("w")).select(I.buckets(I.F.col("w"), n).alias("b")).first()
    assert sorted(row.b) == want
