"""Classification, routing and typed decisions over scores per label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, softmax
from .schema import Family, Question
from .scorer import Scorer
from .spans import labels_of


def ranked(results: Column) -> Column:
    """array<struct<label, p>>, most probable first; ties in the given order."""
    keyed = F.transform(results, lambda x, i: F.struct((-x["p"]).alias("k"), i.alias("i"), x.alias("x")))
    return F.transform(F.sort_array(keyed), lambda y: y["x"])


def logits(text: Column, names, scorer: Scorer, scale: float = 4.0) -> Column:
    """array<struct<label, p>> of raw scores."""
    return F.transform(labels_of(names), lambda x: F.struct(x.alias("label"), (scale * scorer.score(x, text)).alias("p")))


def multi_label(raw: Column, threshold: float = 0.5) -> Column:
    """Every label with sigmoid >= threshold."""
    scored = F.transform(raw, lambda x: F.struct(x["label"], (1 / (1 + F.exp(-x["p"]))).alias("p")))
    return ranked(F.filter(scored, lambda x: x["p"] >= threshold))


def single_label(raw: Column) -> Column:
    """All labels with their softmax."""
    p = softmax(F.transform(raw, lambda x: x["p"]))
    return ranked(F.zip_with(raw, p, lambda x, y: F.struct(x["label"], y.alias("p"))))


def route(rows: DataFrame, families: list[Family], scorer: Scorer, text: str = "text") -> DataFrame:
    """Adds ``routes``: per family its best label, or all labels in order if it isn't single-label; nothing for blank texts."""
    parts = []
    for f in families:
        raw = logits(F.col(text), f.labels, scorer)
        found = F.slice(single_label(raw), 1, 1) if f.single else multi_label(raw, 0.0)
        parts.append(_named(found, f.name))
    empty = F.slice(parts[0], 1, 0)
    return rows.withColumn("routes", F.when(is_blank(F.col(text)), empty).otherwise(F.concat(*parts)))


def _named(found: Column, family: str) -> Column:
    return F.transform(found, lambda x: F.struct(F.lit(family).alias("family"), x["label"].alias("label"), x["p"].alias("p")))


def decide(rows: DataFrame, questions: list[Question], scorer: Scorer, text: str = "text") -> DataFrame:
    """Adds ``decisions``: array<struct<id, kind, probabilities array<struct<label, p>>>>; empty for blank texts.

    Questions are few and known on the driver, so they are columns of one projection.
    """
    parts = []
    for q in questions:
        names = [o.name for o in q.options]
        raw = logits(F.concat(F.lit(q.prompt + "\n"), F.col(text)), names, scorer)
        p = softmax(F.transform(raw, lambda x: x["p"]))
        parts.append(F.struct(F.lit(q.id).alias("id"), F.lit(q.kind).alias("kind"), F.zip_with(raw, p, lambda x, y: F.struct(x["label"], y.alias("p"))).alias("probabilities")))
    every = F.array(*parts)
    return rows.withColumn("decisions", F.when(is_blank(F.col(text)), F.slice(every, 1, 0)).otherwise(every))


def choice(probabilities: Column) -> Column:
    """The first most probable option; null without options."""
    return F.get(ranked(probabilities), 0)["label"]


def confidence(probabilities: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(probabilities, lambda x: x["p"])), F.lit(0.0))


def expected(probabilities: Column) -> Column:
    """Expected level: places weighed by probability."""
    return F.aggregate(F.transform(probabilities, lambda x, i: x["p"] * i), F.lit(0.0), lambda s, x: s + x)


def probability_true(probabilities: Column) -> Column:
    return F.coalesce(F.get(F.filter(probabilities, lambda x: x["label"] == "yes"), 0)["p"], F.lit(0.0))
