"""The near-duplicate stage where ids repeat or are null."""

import corpus_pipeline as cp

WORDS = [f"word{k}" for k in range(200)]
A, B, C, D = (" ".join(WORDS[k : k + 40]) for k in (0, 50, 100, 150))


def stage(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    return sorted(((r.doc_id, r.text) for r in cp.near_duplicates(spark, docs, "").collect()), key=str)


def test_rows_of_one_id_are_told_apart(spark):
    # id 5 has a copy of document 1 and a text of its own, whose group also has id 7
    assert stage(spark, [(1, A, 0), (5, A, 1), (5, B, 2), (7, B, 3), (9, C, 4)]) == sorted([(1, A), (5, B), (9, C)], key=str)


def test_rows_without_an_id(spark):
    rows = [(None, A, 0), (None, A, 1), (2, B, 2), (None, B, 3), (None, D, 4), (None, D + " more", 5), (3, "", 6), (4, None, 7)]
    got = stage(spark, rows)
    assert [r for r in got if r[1] and r[1].startswith(D)] in ([(None, D)], [(None, D + " more")])
    assert sorted((r for r in got if not (r[1] or "").startswith(D)), key=str) == sorted([(None, A), (2, B), (3, ""), (4, None)], key=str)


def test_repeated_rows(spark):
    assert stage(spark, [(1, A, 0), (1, A, 1), (2, A, 2), (3, C, 3)]) == [(1, A), (3, C)]
