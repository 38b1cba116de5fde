"""Windows that repeat: they are one, and what they cost grows with the text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from textloom.llm import decontaminate as D


def plain(docs, items, n=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for i, text in docs:
        w, hit, found = cut(text), set(), set()
        for item, body in items:
            b = cut(body)
            size = min(n, len(b))
            wins = {tuple(b[k : k + size]) for k in range(len(b) - size + 1)} if b else set()
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in wins:
                    hit.update(range(k, k + size))
                    found.add(str(item))
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out)


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_repeated_words_and_lines(spark):
    r = random.Random(2)
    line = "terms of use apply to this page and to all of its parts "
    items = [(k, "the of " * 20) for k in range(6)] + [(10, line * 3), (11, "x " + line * 2), (12, "a a a"), (13, "a a"), (14, "b"), (15, None), (15, "b"), (16, "the " * 30)]
    words = ["the", "of", "a", "b", "c"]
    docs = [(0, "of the " * 60), (1, line * 12), (2, "c " * 9 + "the of " * 30), (3, "the " * 200), (4, None), (5, "b")]
    docs += [(10 + k, " ".join(r.choice(words) for _ in range(40)) + " " + line * r.randrange(3)) for k in range(20)]
    got = sorted((x.doc_id, x.n_words, x.n_hit, x["items"]) for x in D.contamination(*frames(spark, docs, items)).collect())
    assert got == plain(docs, items)


@pytest.mark.parametrize("copies", [1, 40])
def test_equal_windows_are_one(spark, copies):
    """Items that repeat two words have two windows in all, and a text of n words proposes two places a word at most."""
    docs, items = frames(spark, [(1, "the of " * 1500)], [(k, "the of " * 20) for k in range(copies)])
    holders = D.windows(items)
    wins = D.sequences(holders).cache()
    assert (holders.count(), wins.count()) == (2 * copies, 20)
    index = D.build_index(docs, D.vocabulary(wins), 20)
    found = D.matches(index, wins, 20)
    assert found.count() == 3000 - 9
    assert [(x.n_hit) for x in D.covered(found).collect()] == [3000]


def test_ranges_are_put_together(spark):
    rows = [("a", 0, 4), ("a", 2, 4), ("a", 2, 1), ("a", 6, 2), ("a", 20, 10), ("a", 22, 3), ("b", 5, 1)]
    found = spark.createDataFrame(rows, "key string, start int, n_win int")
    assert {r.key: r.n_hit for r in D.covered(found).collect()} == {"a": 18, "b": 1}
    assert D.covered(found.where(F.lit(False))).collect() == []
