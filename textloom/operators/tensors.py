"""Decoding what a model returns: score tensors as nested array columns, beside the texts they belong to.

Any model's output that reaches Spark as arrays (a file of predictions, a UDF's result) is
decoded here by the same candidates, choices and instances as scored texts. Tensors may be
padded: words behind a text's end, and spans that pass it, count for nothing; a tensor that is
null or has fewer fields, words or widths than others gives what it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, sigmoid
from . import relations as R
from . import spans as S
from .schema import Field

#: Places of a token head's channels. Fixed values.
START, END, INSIDE = 0, 1, 2


def _fields(scores: Column, names: Column, place, threshold: float, width: int) -> Column:
    """Spans of one instance's scores [field][word][width] with p >= threshold; ``place`` numbers a field's label."""
    words, n = F.col("words"), F.size("words")

    def of_word(f: Column, i: Column, ps: Column) -> Column:
        inside = F.filter(F.transform(F.slice(ps, 1, F.least(F.lit(width), n - i)), lambda p, j: F.struct(p.cast("double").alias("p"), j.alias("j"))), lambda x: x["p"] >= threshold)

        def span(x: Column) -> Column:
            a, z = F.get(words, i), F.get(words, i + x["j"])
            at = ((place(f) * n + i) * width + x["j"]).cast("bigint")
            text = F.array_join(F.slice("pieces", a["p"] + 1, z["p"] - a["p"] + 1), "")
            return F.struct(at.alias("ord"), F.get(names, f).alias("label"), i.alias("first"), (i + x["j"]).alias("last"), a["s"].alias("start"), z["e"].alias("end"), text.alias("text"), x["p"].alias("p"))

        return F.transform(inside, span)

    of_field = lambda words_, f: F.flatten(F.transform(F.slice(words_, 1, n), lambda ps, i: of_word(f, i, ps)))
    return F.flatten(F.transform(F.slice(scores, 1, F.size(names)), of_field))


def _or_none(spans: Column) -> Column:
    return F.coalesce(spans, F.array().cast(f"array<{S.SPAN}>"))


def spans_of(rows: DataFrame, scores: str, names, threshold: float, width: int) -> DataFrame:
    """Adds ``cands`` from probabilities [count][field][word][width], of which the first count instance has the entities.

    Field f is the label ``names[f]``; ``width`` is the widest span of the tensor. In the order of field, word, width.
    """
    labels = S.labels_of(names)
    first = F.get(scores, F.lit(0))
    return rows.withColumn("cands", _or_none(let(labels, lambda ls: _fields(first, ls, lambda f: f, threshold, width))))


def instances_of(rows: DataFrame, scores: str, fields: list[str], threshold: float, width: int) -> DataFrame:
    """Adds ``_cands``: spans of every field of every count instance of [count][field][word][width], as ``relations.best_fields`` and ``structures`` read them."""
    names, m = F.array(*map(F.lit, fields)), len(fields)
    every = F.transform(scores, lambda own, inst: _fields(own, names, lambda f: inst * m + f, threshold, width))
    return rows.withColumn("_cands", _or_none(F.flatten(every)))


def relations_of(rows: DataFrame, scores: str, counts: Column, fields: list[str], threshold: float, width: int) -> DataFrame:
    """Adds ``relations``: complete instances, of as many as ``counts`` says and the tensor has."""
    rows = instances_of(rows, scores, fields, threshold, width)
    best = R.best_fields(F.col("_cands"), fields, _available(counts, scores), 0, width)
    return rows.withColumn("relations", let(best, R.relations)).drop("_cands")


def structures_of(rows: DataFrame, scores: str, counts: Column, fields: tuple[Field, ...], threshold: float, width: int) -> DataFrame:
    """Adds ``structures``: an instance for each that ``counts`` says and the tensor has, be it empty."""
    rows = instances_of(rows, scores, [f.name for f in fields], threshold, width)
    return rows.withColumn("structures", R.structures(F.col("_cands"), fields, _available(counts, scores), 0, width)).drop("_cands")


def _available(counts: Column, scores: str) -> Column:
    return F.least(F.coalesce(counts, F.lit(0)), F.coalesce(F.size(scores), F.lit(0)))


def tokens_of(rows: DataFrame, logits: str, names, threshold: float) -> DataFrame:
    """Adds ``cands`` from logits [word][class][start, end, inside] of a token head; a class or word that is missing scores nothing."""
    labels = S.labels_of(names)
    channel = lambda k, i, c: F.coalesce(sigmoid(F.get(F.get(F.get(logits, i), k), F.lit(c)).cast("double")), F.lit(0.0))
    marks = F.transform(labels, lambda x, k: F.transform("words", lambda w, i: F.struct(channel(k, i, START).alias("a"), channel(k, i, INSIDE).alias("m"), channel(k, i, END).alias("z"))))
    return S.runs(rows.withColumn("_marks", marks), names, threshold, "_marks").drop("_marks")
