"""Readers and writers: bundles, profiles, benchmark results, generated text, metrics."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators.schema import Family, Field, Label, Question, Relation, Structure

#: Keys of a bundle's configuration and what stands for them. Fixed values. The threshold is never read from a file.
DEFAULTS = {
    "max_width": 12, "max_count": 20, "span_mode": "markerV0", "lowercase_words": True, "append_period": True, "pair_temperature": 1.0,
    "enable_abstention": True, "abstention_threshold": 0.5, "relation_temperature": 1.0, "prompt_first": True, "label_token": "<<LABEL>>",
    "sep_token": "<<SEP>>", "n_ctx": 4096, "n_batch": 512, "n_seq_max": 8,
}
THRESHOLD = 0.5
#: Text lengths in their order; others have no rank. Fixed values.
LENGTHS = ("tiny", "short", "medium", "long")


def load_config(path: str) -> dict:
    """A bundle's configuration over the defaults; ``right_context_width`` is the width unless given."""
    given = json.loads(Path(path).read_text())
    out = DEFAULTS | given | {"threshold": THRESHOLD}
    return out | {"right_context_width": given.get("right_context_width", out["max_width"])}


def load_profile(path: str) -> dict:
    """A profile's labels, relations, structures, questions and router families, checked."""
    raw = json.loads(Path(path).read_text())
    label = lambda x: Label(x) if isinstance(x, str) else Label(x["name"], x.get("description") or "")
    fields = lambda xs: tuple(Field(x["name"], x.get("type") or "STRING", x.get("description"), tuple(x.get("choices") or ())) for x in xs)
    questions = []
    for q in (raw.get("decisions") or {}).get("questions", []):
        if q["type"] not in ("choice", "score", "noul"):
            raise ValueError(f"unknown question type {q['type']}")
        options = tuple(map(label, q.get("options") or q.get("levels") or ()))
        questions.append(Question(q["id"], q["type"], q.get("instructions") or "", options))
    return {
        "entities": tuple(map(label, raw.get("entities") or ())),
        "labels": tuple(map(label, raw.get("labels") or ())),
        "relations": tuple(Relation(x["name"], x.get("description") or "", tuple(x.get("fields") or ("head", "tail"))) for x in raw.get("relations") or ()),
        "structures": tuple(Structure(x["name"], fields(x["fields"])) for x in raw.get("structures") or ()),
        "families": tuple(Family(x["name"], tuple(x["labels"]), bool(x.get("singleLabel"))) for x in (raw.get("router") or {}).get("families", ())),
        "questions": tuple(questions),
        "samples": tuple(raw.get("samples") or ()),
    }


JMH = "benchmark string, mode string, params struct<profile:string,textLength:string,batchSize:string,entityCount:string>, primaryMetric struct<score:double,scoreError:string>"


def read_results(spark: SparkSession, paths: list[str], cpus: Column | int) -> DataFrame:
    """Rows of benchmark-result files (a JSON array each), with time per text and texts per second; null where unknown."""
    raw = spark.read.schema(JMH).json(paths, multiLine=True)
    batch, score = F.col("params.batchSize").try_cast("int"), F.col("primaryMetric.score")
    return raw.select(
        (F.lit(cpus) if isinstance(cpus, int) else cpus).alias("cpus"),
        F.col("params.profile").alias("profile"),
        F.col("params.textLength").alias("textLength"),
        batch.alias("batchSize"),
        F.col("params.entityCount").try_cast("int").alias("entityCount"),
        score.alias("score_ms"),
        F.col("primaryMetric.scoreError").try_cast("double").alias("score_err_ms"),
        F.try_divide(score, batch).alias("per_text_ms"),
        F.try_divide(batch * 1000.0, score).alias("throughput_tps"),
        F.input_file_name().alias("source"),
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def length_rank(column: Column) -> Column:
    """tiny < short < medium < long; anything else is null."""
    at = F.array_position(F.array(*map(F.lit, LENGTHS)), column)
    return F.when(at > 0, at)


#: Where a text is cut into sentences.
SENTENCE_END = r"(?<=[.!?])\s+"


def generate_corpus(rows: DataFrame, tokens: int, seed: int = 0xC0FFEE) -> DataFrame:
    """``doc_id, text``: for each row of ``rows`` (doc_id, text) its own sentences, in a seeded order and as often as needed, up to about ``tokens`` tokens of four characters.

    The last sentence that fits whole ends the text; a first one that doesn't is cut. Texts without words give empty ones.
    """
    size = tokens * 4
    found = F.filter(F.split(F.coalesce("text", F.lit("")), SENTENCE_END), lambda x: F.trim(x) != "")
    rows = rows.select("doc_id", found.alias("_s"))
    keyed = F.transform("_s", lambda x, i: F.struct(F.xxhash64("doc_id", i, F.lit(seed)).alias("k"), x.alias("x")))
    once = F.array_join(F.transform(F.sort_array(keyed), lambda x: x["x"]), " ")
    rows = rows.select("doc_id", once.alias("_t"))
    times = F.ceil(F.lit(size) / F.greatest(F.length("_t"), F.lit(1))).cast("int")
    long = F.array_join(F.array_repeat(F.col("_t"), F.greatest(times, F.lit(1)) + 1), " ")
    cut = F.substring(long, 1, size)
    whole = F.regexp_extract(F.substring(long, 1, size + 1), r"(?s)\A(.*[.!?])(?:\s|\z)", 1)
    return rows.select("doc_id", F.when(F.length("_t") == 0, "").when((F.length(whole) > 0) & (F.length(whole) <= size), whole).otherwise(cut).alias("text"))


#: Upper ends of the buckets of a duration histogram, in milliseconds; what is longer comes last.
DURATIONS = (5, 10, 25, 50, 75, 100, 250, 500, 750, 1000, 2500, 5000, 7500, 10000)


def observed(results: DataFrame, operation: str, spans: str) -> tuple[DataFrame, Observation]:
    """Counts texts and results as a query runs; read ``Observation.get`` after an action."""
    watch = Observation(operation)
    return results.observe(watch, *counts_of(spans)), watch


def counts_of(spans: str) -> list[Column]:
    """Metrics of a table of results: rows, and what their array or map column ``spans`` holds."""
    return [F.count("*").alias("text_count"), F.coalesce(F.sum(F.when(F.col(spans).isNotNull(), F.size(spans))), F.lit(0)).alias("result_count")]


def histogram(durations: DataFrame, by: Sequence[str], ms: str) -> DataFrame:
    """``by..., bucket, upto_ms, n``: how many durations lie in each bucket; those of several tasks or runs add up.

    A bucket holds what is above the border before it and at its own at most; null durations don't count.
    """
    borders = F.array(*(F.lit(float(x)) for x in DURATIONS))
    bucket = F.size(F.filter(borders, lambda x: x < F.col(ms)))
    rows = durations.where(F.col(ms).isNotNull()).select(*by, bucket.cast("long").alias("bucket"))
    return rows.groupBy(*by, "bucket").agg(F.count("*").alias("n")).select(*by, "bucket", F.get(borders, F.col("bucket").cast("int")).alias("upto_ms"), "n")


class Metrics:
    """Calls, durations, texts and results of each operation, over batches and streams of a session.

    A batch is measured by ``call``; a stream by ``watch_streams``, to which each finished
    micro-batch of a stream that carries ``observed_stream`` counts as a call.
    """

    def __init__(self) -> None:
        self.calls: list[tuple[str, float, int, int]] = []

    def record(self, operation: str, ms: float, texts: int, results: int) -> None:
        self.calls.append((operation, float(ms), int(texts), int(results)))

    def call(self, results: DataFrame, operation: str, spans: str, action: Callable[[DataFrame], object]) -> object:
        """What ``action`` makes of ``results``; its time and counts are kept, in the one run that it is."""
        rows, watch = observed(results, operation, spans)
        start = time.perf_counter()
        out = action(rows)
        counts = watch.get
        self.record(operation, (time.perf_counter() - start) * 1000, counts["text_count"], counts["result_count"])
        return out

    def observed_stream(self, results: DataFrame, operation: str, spans: str) -> DataFrame:
        return results.observe(operation, *counts_of(spans))

    def watch_streams(self, spark: SparkSession) -> StreamingQueryListener:
        """A listener that records every micro-batch with rows; remove it by ``spark.streams.removeListener``."""
        metrics = self

        class Listener(StreamingQueryListener):
            def onQueryStarted(self, event) -> None:
                pass

            def onQueryProgress(self, event) -> None:
                ms = event.progress.durationMs.get("triggerExecution", event.progress.batchDuration)
                for operation, row in event.progress.observedMetrics.items():
                    if row["text_count"]:
                        metrics.record(operation, ms, row["text_count"], row["result_count"])

            def onQueryIdle(self, event) -> None:
                pass

            def onQueryTerminated(self, event) -> None:
                pass

        out = Listener()
        spark.streams.addListener(out)
        return out

    def totals(self, spark: SparkSession) -> DataFrame:
        """``operation, calls, text_count, result_count, duration_ms``."""
        calls = self.table(spark)
        return calls.groupBy("operation").agg(F.count("*").alias("calls"), F.sum("text_count").alias("text_count"), F.sum("result_count").alias("result_count"), F.sum("duration_ms").alias("duration_ms"))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.calls, "operation string, duration_ms double, text_count long, result_count long")


def batches_of(frames: Iterator[pd.DataFrame], by: str, ratio: float = 1.3, cap: int | None = None) -> Iterator[pd.DataFrame]:
    """Arrow batches cut into buckets of like length, for scorers that pad."""
    from ..operators.pool import in_buckets

    for frame in frames:
        for rows in in_buckets([len(x) for x in frame[by]], ratio, cap):
            yield frame.iloc[rows]
