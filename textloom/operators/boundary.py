"""Spans from boundaries: evidence by prefix sums, pools of boundary pairs, arguments of relations.

A text of n words has n + 1 boundaries; a span is a pair of them, start before end. Each
label scores every word as a start, as inside and as an end. What a label says for the
inside of a span is a difference of two centred prefix sums, so that any span costs the same.
Everything of a text stays in its row: a pool has a bounded number of pairs, and a label
looks at these only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import dot, let, prefix_sums, sigmoid
from . import spans as S
from .scorer import Scorer

#: What stands above all scores of pairs, as a label's own best pairs do.
BAND = 5000.0
PAIR = "struct<k:double,i:bigint,s:int,e:int>"


def marks(rows: DataFrame, names, scorer: Scorer, scale: float = 4.0) -> DataFrame:
    """Adds ``marks``: per label (label, a, m, z), the logits of every word as a start, as inside and as an end.

    Start i stands at boundary i, end i at boundary i + 1.
    """
    labels, words = S.labels_of(names), F.col("words")
    part = lambda label, what: F.transform(words, lambda w, i: scale * scorer.score(F.concat(label, F.lit(what), i.cast("string")), w["w"]) - scale / 2)
    return rows.withColumn("marks", F.transform(labels, lambda x: F.struct(x.alias("label"), part(x, ":start:").alias("a"), part(x, ":inside:").alias("m"), part(x, ":end:").alias("z"))))


def with_evidence(rows: DataFrame) -> DataFrame:
    """Adds ``prefix`` (prefix sums of the values less their mean) and ``mean`` of each label's inside logits, from ``marks``."""
    mean = lambda m: F.when(F.size(m) > 0, F.aggregate(m, F.lit(0.0), lambda s, x: s + x) / F.size(m)).otherwise(0.0)
    rows = rows.withColumn("mean", F.transform("marks", lambda x: mean(x["m"])))
    return rows.withColumn("prefix", F.zip_with("marks", "mean", lambda x, y: prefix_sums(F.transform(x["m"], lambda v: v - y))))


def evidence(prefix: Column, mean: Column, s: Column, e: Column) -> Column:
    """What a label's inside logits say for the span from boundary ``s`` to ``e``: their sum over the root of their number."""
    interval = F.get(prefix, e) - F.get(prefix, s) + mean * (e - s)
    return interval / F.sqrt(F.greatest(e - s, F.lit(1)).cast("double"))


def compatible(a: Column, b: Column) -> Column:
    """Dot product of two vectors over the root of their dimension."""
    return dot(a, b) / F.sqrt(F.greatest(F.size(a), F.lit(1)).cast("double"))


def probability(logit: Column, temperature: float = 1.0) -> Column:
    if temperature <= 0:
        raise ValueError("a temperature above 0 is needed")
    return sigmoid(logit / temperature)


def _best(scores: Column, k: int) -> Column:
    """The ``k`` largest of structs (k, i, ...), ``k`` being the negated score: lowest first, lower ``i`` on ties."""
    return F.slice(F.sort_array(scores), 1, k)


def with_pool(rows: DataFrame, k: int = 8, quota: int = 2, size: int = 24) -> DataFrame:
    """Adds ``pool``: up to ``size`` pairs (s, e) of boundaries, best first.

    The ``k`` best starts and ends over all labels make pairs; each label's ``quota`` best of
    these stand above all others. A pair counts once, where it stands first.
    """
    n = F.size("words")
    union = lambda part: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_max(F.transform("marks", lambda x: F.get(x[part], i))))
    edge = lambda part, by: F.when(n > 0, _best(F.transform(union(part), lambda v, i: F.struct((-v).alias("k"), (i + by).alias("i"))), k))
    pair = lambda s, x, ends: F.transform(ends, lambda e, y: F.struct((s["k"] + e["k"]).alias("k"), (x * k + y).cast("bigint").alias("i"), s["i"].alias("s"), e["i"].alias("e")))
    # bound: what is used within a lambda would be made anew for each of its elements
    made = let(edge("z", 1), lambda ends: F.flatten(F.transform(edge("a", 0), lambda s, x: pair(s, x, ends))))
    rows = rows.withColumn("_pairs", F.filter(made, lambda p: p["e"] > p["s"]))
    low = 1 << 40  # before the places of all pairs

    def own(x: Column, label: Column) -> Column:
        scored = F.transform("_pairs", lambda p: F.struct((-(F.get(x["a"], p["s"]) + F.get(x["z"], p["e"] - 1))).alias("k"), p["i"].alias("i"), p["s"].alias("s"), p["e"].alias("e")))
        return F.transform(_best(scored, quota), lambda p, r: F.struct((-(BAND + quota - r)).cast("double").alias("k"), (label * quota + r - low).cast("bigint").alias("i"), p["s"].alias("s"), p["e"].alias("e")))

    both = F.sort_array(F.concat(F.flatten(F.transform("marks", own)), F.col("_pairs")))
    once = let(both, lambda ps: F.filter(ps, lambda p, j: ~F.exists(F.slice(ps, 1, j), lambda q: (q["s"] == p["s"]) & (q["e"] == p["e"]))))
    pool = F.transform(F.slice(once, 1, size), lambda p: F.struct(p["s"].alias("s"), p["e"].alias("e")))
    return rows.withColumn("pool", F.coalesce(pool, F.array().cast("array<struct<s:int,e:int>>"))).drop("_pairs")


def candidates(rows: DataFrame, threshold: float, temperature: float = 1.0, size: int = 24) -> DataFrame:
    """Adds ``cands``: every pair of the pool for every label with p >= threshold, in the order of label and pool.

    Needs ``marks``, ``prefix``, ``mean``, ``pool``, ``words`` and ``pieces``. A pair's logit is its start's, its
    end's and the evidence of its inside; it is divided by the temperature.
    """
    words = F.col("words")

    def of_label(own: Column, x: Column, k: Column) -> Column:
        def span(p: Column, j: Column) -> Column:
            a, z = F.get(words, p["s"]), F.get(words, p["e"] - 1)
            logit = F.get(x["a"], p["s"]) + F.get(x["z"], p["e"] - 1) + evidence(F.get(own["prefix"], k), F.get(own["mean"], k), p["s"], p["e"])
            text = F.array_join(F.slice("pieces", a["p"] + 1, z["p"] - a["p"] + 1), "")
            return F.struct((k * size + j).cast("bigint").alias("ord"), x["label"].alias("label"), p["s"].alias("first"), (p["e"] - 1).alias("last"), a["s"].alias("start"), z["e"].alias("end"), text.alias("text"), probability(logit, temperature).alias("p"))

        return F.filter(F.transform(own["pool"], span), lambda c: c["p"] >= threshold)

    # bound: what is used within a lambda would be made anew for each of its elements
    return rows.withColumn("cands", let(F.struct("pool", "prefix", "mean"), lambda own: F.flatten(F.transform("marks", lambda x, k: of_label(own, x, k)))))


def arguments(spans: Column, threshold: float, k: int) -> Column:
    """The ``k`` most probable spans that reach the threshold, ties in the order in which they were met."""
    return F.slice(S.by_confidence(F.filter(spans, lambda c: c["p"] >= threshold)), 1, k)


def argument_pairs(heads: Column, tails: Column, tail_count: int, most: int) -> Column:
    """Up to ``most`` pairs (k, i, head, tail) of different arguments, the largest products of probabilities first.

    ``k`` is the negated product and ``i`` numbers the pair. As many pairs are looked at as both
    sides have places.
    """
    pair = lambda h, x, ts: F.transform(ts, lambda t, y: F.struct((-(h["p"] * t["p"])).alias("k"), (x * tail_count + y).cast("bigint").alias("i"), h.alias("head"), t.alias("tail")))
    made = let(tails, lambda ts: F.flatten(F.transform(heads, lambda h, x: pair(h, x, ts))))
    return F.slice(F.sort_array(F.filter(made, lambda p: (p["head"]["first"] != p["tail"]["first"]) | (p["head"]["last"] != p["tail"]["last"]))), 1, most)


def mean_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``key, vector``: the element-wise mean of each key's vectors.

    Summed by place, so that a task sends one row for each key and place it has seen, however
    many vectors a key has. Rows without key or vector don't count; a place that only some
    vectors have is the mean of these.
    """
    each = rows.where(F.col(key).isNotNull()).select(key, F.posexplode_outer(vector).alias("_at", "_x")).where("_x IS NOT NULL")
    means = each.groupBy(key, "_at").agg(F.avg(F.col("_x").cast("double")).alias("_x"))
    return means.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_x"))), lambda p: p["_x"]).alias(vector))
