"""Steps whose work or memory must not grow faster than the input."""

from pyspark.sql import functions as F

from textloom.operators import pool as P
from textloom.operators.scorer import HashScorer
from textloom.plans import ner
from textloom.plans.prompt import first_runs


def test_rows_of_one_label_list_are_dealt_over_tasks(spark):
    rows = spark.range(2000).select(F.col("id"), F.array(F.lit("a")).alias("labels"), F.lit("word").alias("text"), F.array(F.lit("word")).alias("words"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = first_runs(rows, "labels", ["id"]).withColumn("_task", F.spark_partition_id()).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert [x.id for x in got if x["first"]] == [0] and len(got) == 2000
    tasks = [x["_task"] for x in got]
    assert max(tasks.count(t) for t in set(tasks)) < 1000


def test_a_hash_reaches_what_its_score_reaches(spark):
    rows = spark.range(3000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("w"))
    score = HashScorer().score(F.lit("a"), F.col("w"))
    some = [r.p for r in rows.select(score.alias("p")).limit(3).collect()]
    for at in (-1.0, 0.0, 0.9, 0.97, 1.0, 1.5, *some):
        assert rows.where(HashScorer().reaches(F.lit("a"), F.col("w"), at) != (score >= at)).count() == 0


def test_few_files_are_spread_over_tasks(spark):
    for query in (ner.ner_documents, ner.ner_overrides):
        text = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Repartition" in text


def test_blocks_of_a_search_hold_few_rows():
    queries, rows = P.BLOCK
    assert queries + rows <= 50_000


def test_a_session_goes_over_scores_once():
    import random

    from textloom.streaming.sessions import Session

    class Watched(dict):
        read = 0

        def items(self):
            Watched.read += len(self)
            return super().items()

    r = random.Random(2)
    session = Session(("a", "b"), 4)
    session.scores = Watched()
    for n in range(30):
        got = session.append(" ".join(str(r.randrange(99)) for _ in range(5)) + " ", 0.8)
        again = Session(("a", "b"), 4, text=session.text, starts=session.starts, ends=session.ends, scores=dict(session.scores))
        assert got == again.snapshot(0.8) and session.snapshot(0.3) == again.snapshot(0.3) and got == session.snapshot(0.8)
    assert Watched.read == 0


def test_spans_scored_many_at_once_are_those_of_expressions(spark):
    from textloom.functions import text as T
    from textloom.operators import spans as S

    texts = ["A b-c_d e. Ünïcode 日本語 x\u00a0y\u0085z \U0001f600 done\x0b\x1cend", None, "", "  \n", "w" * 300 + " " + "v" * 53, "don't -- stop-_go __ a-", "\u2003 é-è", "b " * 400]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    for names, at, width in ((("person", "location"), 0.5, 3), (("a",), 0.0, 1), (("é", "b", "c"), 0.9, 12)):
        want = {r.id: r.cands for r in S.candidates(T.with_words(rows), names, HashScorer(), at, width).select("id", "cands").collect()}
        got = {r.id: r.cands for r in S.candidates_many(rows, names, HashScorer(), at, width).select("id", "cands").collect()}
        assert got == want and sum(map(len, want.values())) > 50


def test_documents_are_not_scored_in_interpreted_expressions(spark):
    text = ner.ner_documents(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "md5(" not in text


def test_texts_are_scored_some_at_a_time(monkeypatch):
    import pyarrow as pa

    from textloom.operators import spans as S

    texts = pa.array([f"some words {i} é of {i}" * (i % 7) for i in range(50)])
    whole = S.found_spans(texts, ("a", "b"), HashScorer(), 0.8, 4)
    monkeypatch.setattr(S, "TEXT_BYTES", 100)
    assert S.found_spans(texts, ("a", "b"), HashScorer(), 0.8, 4).to_pylist() == whole.to_pylist()
    assert S.found_spans(texts.slice(7, 9), ("a", "b"), HashScorer(), 0.8, 4).to_pylist() == whole.to_pylist()[7:16]
    assert S.found_spans(texts.slice(0, 0), ("a", "b"), HashScorer(), 0.8, 4).to_pylist() == []
