"""Rows as models read them, usage with a cold cache, and borders of buckets."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.functions.text import with_words
from textloom.operators import layout as L
from textloom.operators import pool as P
from textloom.operators.schema import Label, Relation
from textloom.plans import prompt as Q

TEXTS = ["Reading aloud, again", "", None, "  ", "a", "(a [E] reading", "naïveté — ok"]


@pytest.fixture(scope="module")
def rows(spark):
    return L.cut(with_words(spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")))


def test_numbers_and_places(spark, rows):
    prefix, markers = Q.assemble([Q.entity_unit((Label("a"),)), Q.relation_unit(Relation("reading"))])
    vocab = L.vocabulary(rows, list(dict.fromkeys(prefix))).cache()
    ids = [r.id for r in vocab.collect()]
    assert sorted(ids) == list(range(1, len(ids) + 1))
    own = [r.piece for r in vocab.where("NOT marker").orderBy("id").collect()]
    assert own == sorted(own, key=str.encode) and "(" in own and "a" in own  # beside the markers of the same looks
    names = {r.id: r.piece for r in vocab.collect()}
    for share in (None, 10):
        got = {r.id: r for r in L.numbered(rows, vocab, ["id"], prefix, markers, share).collect()}
        for i, text in enumerate(TEXTS):
            words = [w.w for w in rows.where(F.col("id") == i).first().words]
            pieces = [w[k : k + 4] for w in words for k in range(0, len(w), 4)]
            assert [names[x] for x in got[i].ids] == [*prefix, *pieces]
            assert got[i].n_words == len(words)
            assert ["".join(names[x] for x in got[i].ids[a:z]) for a, z in zip(got[i].first, [*got[i].first[1:], len(got[i].ids)], strict=False)] == words


def test_markers_are_counted(rows):
    prefix, markers = Q.assemble([Q.entity_unit((Label("[E]"),))])
    with pytest.raises(ValueError, match="marker"):
        L.numbered(rows, L.vocabulary(rows, prefix), ["id"], prefix, markers)
    prefix, markers = Q.assemble([Q.entity_unit((Label("x"),))])
    with pytest.raises(ValueError, match="lacks"):
        L.numbered(rows, L.vocabulary(rows, prefix[:2]), ["id"], prefix, markers)


def test_padding(spark):
    data = [(1, [5], [0], 1), (2, [5, 6, 7], [0, 2], 2), (3, [9] * 9, [1, 2, 3], 3), (4, [8, 8], [], 0)]
    out = {r.id: r for r in L.padded(spark.createDataFrame(data, "id int, ids array<long>, first array<int>, n_words int"), [1, 9]).collect()}
    assert (out[1].ids, out[1].first) == ([5, 0, 0], [0, -1]) and out[2].ids == [5, 6, 7] and (out[4].ids, out[4].first) == ([8, 8, 0], [-1, -1])
    assert out[3].bucket == 1 and out[3].first == [1, 2, 3]


def test_first_of_each_label_list(spark):
    data = [(3, ["a"], "x"), (1, ["a"], " "), (2, ["a"], "y z"), (5, ["b"], None), (4, None, "u"), (6, None, "v"), (7, ["a", "b"], "w")]
    rows = Q.first_runs(with_words(spark.createDataFrame(data, "k int, labels array<string>, text string")), "labels", ["k"])
    got = {r.k: (r.first, r.n) for r in rows.select("k", "first", Q.usage_cached(F.col("text"), F.col("words"), F.col("first"), 10).alias("n")).collect()}
    assert got == {1: (False, 0), 2: (True, 14), 3: (False, 3), 4: (True, 13), 5: (False, 0), 6: (False, 3), 7: (True, 13)}


def test_borders_in_one_job_or_many(spark, monkeypatch):
    r = random.Random(1)
    lengths = spark.createDataFrame([(r.randrange(2000),) for _ in range(300)] + [(None,), (0,)], "n int")
    one = P.length_buckets(lengths, "n", 1.3)
    monkeypatch.setattr(P, "LENGTHS", 10)
    assert one == P.length_buckets(lengths, "n", 1.3) and one[0] == 0 and len(one) > 10
    assert P.length_buckets(lengths.where("n < 0"), "n", 1.3) == []
