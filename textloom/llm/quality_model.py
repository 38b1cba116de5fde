"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed by Spark expressions over whole texts; only these numbers reach
Python. Trees are complete and of one depth, so a forest is three arrays (feature,
threshold, leaf value) that numpy walks for all rows and trees at once.

The trees are fitted on the driver on at most ``TRAIN_ROWS`` labelled ids, those with the
smallest hash of doc_id, with one text each. Labels, lang, source and doc_id are never features.

Defined cases: null, empty and blank texts have statistics of 0 and are scored like any
other; labels that are null are left out, and repeated labels of an id are averaged
(label 1 from a half); without labels, or with one kind of label, the score is the
smoothed share of label 1; a null doc_id isn't held out and has no label; repeated rows
are scored alike, and of equal gains of a split the first feature and threshold is taken; very
long texts are counted whole; empty tables give no rows; extra columns are carried along, except
that columns named as a result are replaced (``into`` names the results otherwise).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let, spaced_pieces
from .quality_rules import SYMBOLS

TRAIN_ROWS = 8000
TREES, DEPTH, RATE, BINS, MIN_ROWS, RIDGE = 60, 4, 0.15, 64, 8, 1.0
#: Score from which label 1 is predicted.
CUT = 0.3


def features(text: Column, pieces: str, words: str) -> dict[str, Column]:
    """Name -> expression over the text and the columns of its pieces and words; shares are of words, characters or lines."""
    count = F.size(words)
    n, chars = F.greatest(count, F.lit(1)), F.greatest(F.length(text), F.lit(1))
    lines = F.size(F.split(text, "\n", -1))

    def absent(*what: str) -> Column:
        rest = text
        for s in what:
            rest = F.replace(rest, F.lit(s), F.lit(""))
        return F.length(text) - F.length(rest)

    again = F.size(F.filter(F.arrays_zip(F.col(words).alias("a"), F.slice(words, 2, F.greatest(count, F.lit(0))).alias("b")), lambda p: p["a"] == p["b"]))
    return {
        "words": F.log1p(count),
        "word_chars": (F.length(text) - F.size(pieces) + 1) / n,
        "symbols": absent(*SYMBOLS) / n,
        "bars": absent("|") / n,
        "bangs": absent("!") / n,
        "stops": absent(".", ",") / n,
        "digits": absent(*"0123456789") / chars,
        "capitals": F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")) / chars,
        "lines": lines / n,
        "same_lines": let(F.split(text, "\n", -1), lambda x: F.size(x) - F.size(F.array_distinct(x))) / lines,
        "distinct": F.size(F.array_distinct(words)) / n,
        "again": again / n,
    }


def with_features(docs: DataFrame, text: str = "text") -> tuple[DataFrame, list[str]]:
    """``docs`` with the statistics as further columns, and their names; no column of ``docs`` is touched."""
    own = F.coalesce(F.col(text), F.lit(""))
    pieces, words = fresh(docs.columns, "_pieces", "_words")
    rows = docs.withColumn(pieces, spaced_pieces(own)).withColumn(words, F.array_remove(pieces, ""))
    found = features(own, pieces, words)
    names = fresh(rows.columns, *(f"_f_{k}" for k in found))
    return rows.withColumns({n: v.cast("double") for n, v in zip(names, found.values(), strict=True)}).drop(pieces, words), names


@dataclass
class Forest:
    base: float
    feature: np.ndarray  # trees x inner nodes, in level order
    threshold: np.ndarray  # rows with a value above go right
    leaf: np.ndarray  # trees x leaves

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of statistics."""
        margin = np.full(len(x), self.base)
        if self.feature.size:
            trees, rows = np.arange(len(self.feature)), np.arange(len(x))[:, None]
            at = np.zeros((len(x), len(trees)), np.int32)
            for _ in range(int(np.log2(self.leaf.shape[1]))):
                above = x[rows, self.feature[trees, at]] > self.threshold[trees, at]
                at = 2 * at + 1 + above
            margin = margin + self.leaf[trees, at - self.feature.shape[1]].sum(1)
        return 1 / (1 + np.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Forest:
    """Boosted trees for log loss; splits are sought over histograms of at most ``BINS`` quantile bins."""
    share = (y.sum() + 1) / (len(y) + 2)
    base, inner = float(np.log(share / (1 - share))), 2**depth - 1
    if len(set(y.tolist())) < 2:
        return Forest(base, np.zeros((0, inner), np.int32), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
    feature, threshold = np.zeros((trees, inner), np.int32), np.full((trees, inner), np.inf)
    leaf, margin = np.zeros((trees, inner + 1)), np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            cut = np.full(width, BINS + 1)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                cell = (at - first) * BINS + binned[:, f]
                g, h, n = (np.bincount(cell, w, width * BINS).reshape(width, BINS).cumsum(1) for w in (grad, hess, None))
                left = g[:, :-1] ** 2 / (h[:, :-1] + RIDGE)
                right = (g[:, -1:] - g[:, :-1]) ** 2 / (h[:, -1:] - h[:, :-1] + RIDGE)
                gain = left + right - g[:, -1:] ** 2 / (h[:, -1:] + RIDGE)
                gain[(n[:, :-1] < MIN_ROWS) | (n[:, -1:] - n[:, :-1] < MIN_ROWS)] = 0
                gain = gain[:, : len(e)]
                k = gain.argmax(1)
                better = gain[np.arange(width), k] > best
                best = np.where(better, gain.max(1), best)
                cut = np.where(better, k, cut)
                nodes = first + np.flatnonzero(better)
                feature[t, nodes], threshold[t, nodes] = f, e[k[better]]
            at = 2 * at + 1 + (binned[np.arange(len(y)), feature[t, at]] > cut[at - first])
        place = at - inner
        leaf[t] = -rate * np.bincount(place, grad, inner + 1) / (np.bincount(place, hess, inner + 1) + RIDGE)
        margin = margin + leaf[t, place]
    return Forest(base, feature, threshold, leaf)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Forest:
    """Fit on the labelled rows that aren't held out; ``docs`` has doc_id and text, ``labels`` doc_id and quality."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("_y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    # train_rows at most; of rows that repeat an id the one whose text has the least hash
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    rows = rows.groupBy("doc_id", "_y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows, names = with_features(rows)
    got = np.array([tuple(r) for r in rows.select("doc_id", "_y", *names).collect()], float).reshape(-1, 2 + len(names))
    got = got[np.argsort(got[:, 0], kind="stable")]
    return fit(got[:, 2:], got[:, 1])


def score(docs: DataFrame, forest: Forest, into: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``, or what ``into`` calls them."""
    rows, names = with_features(docs)

    @F.pandas_udf("double")
    def walk(*columns: pd.Series) -> pd.Series:
        return pd.Series(forest.scores(np.stack([c.to_numpy() for c in columns], 1)))

    # not deterministic for the optimizer: else it may run the trees twice
    out = rows.withColumn(into[0], walk.asNondeterministic()(*names)).drop(*names)
    return out.withColumn(into[1], (F.col(into[0]) >= CUT).cast("int"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    out = score(docs, train(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
