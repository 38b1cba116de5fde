"""Prompts, usage, configuration, profiles, results, generated text."""

import json
import time

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.schema import Label, Relation, Schema
from textloom.plans import prompt as Q
from textloom.sources import files as S


def test_schema_prompt():
    unit = Q.entity_unit((Label("person"), Label("place", "where")))
    assert unit.tokens() == ["(", "[P]", "entities", "[DESCRIPTION]", "place:", "where", "(", "[E]", "person", "[E]", "place", ")", ")"]
    tokens, places = Q.assemble([Q.entity_unit((Label("a"), Label("b"))), Q.relation_unit(Relation("r", "d"))])
    assert [[tokens[i] for i in p] for p in places] == [["[E]", "[E]"], ["[R]", "[R]"]]
    assert tokens[-1] == "[SEP_TEXT]" and tokens.count("[SEP_STRUCT]") == 1
    assert len(Q.assemble([Q.entity_unit((Label("a"), Label("b")))])[0]) == 11
    with pytest.raises(ValueError):
        Q.assemble([])
    with pytest.raises(ValueError):
        Q.Unit("p", "[E]", ("a",), ("x", "y")).tokens()
    with pytest.raises(NotImplementedError):
        Q.units(Schema(classifications=(Label("a"),)))
    with pytest.raises(ValueError):
        Q.relation_labels([Relation("r", "", ("a", "b"))])
    assert Q.label_section(["x"]) == ["<<SEP>>", "x", "<<LABEL>>", "<<SEP>>"]
    assert Q.entity_prompt(["x"]) == ["[CLS]", "<<ENT>>", "x", "<<SEP>>"]


def test_usage(spark):
    rows = T.with_words(spark.createDataFrame([(0, "a b c d"), (1, ""), (2, None), (3, "Paris.")], "id int, text string")).orderBy("id")
    assert [r[0] for r in rows.select(Q.usage(F.col("text"), F.col("words"), 11)).collect()] == [15, 0, 0, 13]


def test_config_profile_results(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"architecture": "gliner2dot5", "max_width": 8, "threshold": 0.9}))
    config = S.load_config(str(tmp_path / "c.json"))
    assert (config["max_width"], config["right_context_width"], config["threshold"]) == (8, 8, 0.5)
    (tmp_path / "p.json").write_text(json.dumps({"entities": ["a", {"name": "b", "description": None}], "structures": [{"name": "s", "fields": [{"name": "f", "choices": ["x"]}]}], "decisions": {"questions": [{"type": "noul", "id": "q"}]}, "router": {"families": [{"name": "m", "labels": ["u", "v"], "singleLabel": True}]}}))
    profile = S.load_profile(str(tmp_path / "p.json"))
    assert profile["entities"][1] == Label("b") and profile["structures"][0].fields[0].kind == "STRING" and profile["families"][0].single
    (tmp_path / "r.json").write_text(json.dumps([{"benchmark": "x", "mode": "avgt", "params": {"profile": "base", "textLength": "mixed", "batchSize": "4", "entityCount": "8"}, "primaryMetric": {"score": 20.0, "scoreError": "NaN"}}]))
    row = S.read_results(spark, [str(tmp_path / "r.json")], 4).withColumn("rank", S.length_rank(F.col("textLength"))).first()
    assert (row.per_text_ms, row.throughput_tps, row["rank"]) == (5.0, 200.0, None)


def test_generated_text_is_seeded(spark):
    texts = ["One two. Three four five! Six?", "no end", None, "", "x" * 500 + ". y.", "A. " * 90]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    one, two, other = ([r.text for r in S.generate_corpus(rows, 16, seed).orderBy("doc_id").collect()] for seed in (1, 1, 2))
    assert one == two and one != other
    assert all(len(t) <= 64 for t in one) and len(one[0]) > 40 and one[0][-1] in ".!?"
    assert set(one[0].replace("!", ".").replace("?", ".").rstrip(".").split(". ")) == {"One two", "Three four five", "Six"}
    assert one[2] == one[3] == "" and one[4] in ("x" * 64, "y.") and one[1].startswith("no end no end")


def test_observed_counts(spark):
    rows, watch = S.observed(spark.createDataFrame([([1, 2],), ([],), (None,)], "xs array<int>"), "extract", "xs")
    rows.collect()
    assert watch.get == {"text_count": 3, "result_count": 2}


def test_histogram_borders(spark):
    ms = [("a", x) for x in (0.0, 5.0, 5.1, 10.0, 999.0, 1e9, None)] + [("b", 7.0)]
    got = sorted(tuple(r) for r in S.histogram(spark.createDataFrame(ms, "op string, ms double"), ["op"], "ms").collect())
    assert got == [("a", 0, 5.0, 2), ("a", 1, 10.0, 2), ("a", 9, 1000.0, 1), ("a", len(S.DURATIONS), None, 1), ("b", 1, 10.0, 1)]


def test_metrics_of_calls_and_streams(spark, tmp_path):
    metrics = S.Metrics()
    rows = spark.createDataFrame([([1, 2],), ([],)], "xs array<int>")
    assert len(metrics.call(rows, "extract", "xs", lambda x: x.collect())) == 2
    metrics.call(rows.where("size(xs) > 9"), "extract", "xs", lambda x: x.collect())
    metrics.call(rows, "classify", "xs", lambda x: x.count())
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    listener = metrics.watch_streams(spark)
    stream = metrics.observed_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "streamed", "xs")
    query = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    until = time.monotonic() + 20
    while not any(c[0] == "streamed" for c in metrics.calls) and time.monotonic() < until:
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    totals = {r.operation: (r.calls, r.text_count, r.result_count) for r in metrics.totals(spark).collect()}
    assert totals == {"extract": (2, 2, 2), "classify": (1, 2, 2), "streamed": (1, 2, 2)}
    assert S.histogram(metrics.table(spark), ["operation"], "duration_ms").agg(F.sum("n")).first()[0] == 4
