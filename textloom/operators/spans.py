"""Span candidates and the decoders that choose among them.

Candidates of a text are one array of structs ``(ord, label, first, last, start, end, text,
p)``: built, scored, cut by threshold and decoded inside the row, so that a batch job has no
shuffle between a text and its entities. ``ord`` is the order in which a decoder meets
candidates, and breaks every tie.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions.text import let, prefix_sums, with_words
from .scorer import Scorer, reaches

SPAN = "struct<ord:bigint,label:string,first:int,last:int,start:int,end:int,text:string,p:double>"


def labels_of(names: list[str] | tuple[str, ...] | Column) -> Column:
    """Labels are query data: a list for all rows, or a column of arrays."""
    return names if isinstance(names, Column) else F.array(*map(F.lit, names))


def candidates(rows: DataFrame, names, scorer: Scorer, threshold: float, max_width: int = 12, into: str = "cands") -> DataFrame:
    """Adds ``cands``: every span of 1 to ``max_width`` words for every label with p >= threshold, in the order of label, start, width.

    Needs ``pieces`` and ``words`` (functions.text.with_words). A span's text is made once for
    all labels, and the threshold is applied where it is scored, so that the full grid never
    exists; scores are made into numbers only for what reaches the threshold.
    """
    words, n = F.col("words"), F.size("words").cast("long")

    def of_word(labels: Column, w: Column, i: Column) -> Column:
        def of_span(v: Column, j: Column) -> Column:
            def scored(text: Column) -> Column:
                at = lambda k: ((k * n + i) * max_width + j).cast("long")
                made = F.filter(labels, lambda x: reaches(scorer, x["label"], text, threshold))
                return F.transform(made, lambda x: F.struct(at(x["k"]).alias("ord"), x["label"].alias("label"), i.alias("first"), (i + j).alias("last"), w["s"].alias("start"), v["e"].alias("end"), text.alias("text"), scorer.score(x["label"], text).alias("p")))

            return let(F.array_join(F.slice("pieces", w["p"] + 1, v["p"] - w["p"] + 1), ""), scored)

        return F.flatten(F.transform(F.slice(words, i + 1, max_width), of_span))

    # labels are bound: the optimizer moves what makes them to where they are used, which is in every span
    numbered = F.transform(labels_of(names), lambda label, k: F.struct(label.alias("label"), k.alias("k")))
    every = let(numbered, lambda labels: F.flatten(F.transform(words, lambda w, i: of_word(labels, w, i))))
    # ``ord`` comes first in the struct, and no two are equal
    return rows.withColumn(into, F.sort_array(every))


#: ``text.ASCII`` over UTF-8: a word, or a character that is neither white space nor part of one.
_WORDS = re.compile(rb"\w+(?:[-_]\w+)*|[^\s\x80-\xff]|[\xc0-\xff][\x80-\xbf]*")
#: Bytes of text whose spans are scored at once; a longer text is alone.
TEXT_BYTES = 1 << 20


def candidates_many(rows: DataFrame, names: tuple[str, ...], scorer: Scorer, threshold: float, max_width: int = 12, text: str = "text", into: str = "cands") -> DataFrame:
    """``candidates`` of ASCII words for a list of labels and a scorer that scores many pieces at once (``many``), from the texts alone.

    Expressions within lambdas are interpreted, which costs several times a score; here a batch's spans are
    scored together, and only those that reach the threshold are put together.
    """
    if not hasattr(scorer, "many"):
        return candidates(with_words(rows, text=text), names, scorer, threshold, max_width, into)

    @F.arrow_udf(f"array<{SPAN}>")
    def made(texts: pa.Array) -> pa.Array:
        return found_spans(texts, names, scorer, threshold, max_width)

    return rows.withColumn(into, made.asNondeterministic()(F.coalesce(text, F.lit(""))))


def found_spans(texts: pa.Array, names: tuple[str, ...], scorer: Scorer, threshold: float, max_width: int) -> pa.Array:
    """The spans of each text that reach the threshold, in the order of label, start, width."""
    texts = (texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts).cast(pa.large_binary())
    sizes = np.array([len(x.as_buffer()) for x in texts], np.int64)
    ends, first, parts = np.cumsum(sizes), 0, []
    while first < len(sizes):
        last = max(int(np.searchsorted(ends, (ends[first - 1] if first else 0) + TEXT_BYTES, "right")), first + 1)
        parts.append(_found(texts.slice(first, last - first).to_pylist(), names, scorer, threshold, max_width))
        first = last
    return pa.concat_arrays(parts) if parts else _found([], names, scorer, threshold, max_width)


def _found(texts: list[bytes], names: tuple[str, ...], scorer: Scorer, threshold: float, max_width: int) -> pa.Array:
    data = np.frombuffer(b"".join(texts), np.uint8)
    at = np.cumsum([0, *map(len, texts)])
    words = [np.array([m.span() for m in _WORDS.finditer(x)], np.int64).reshape(-1, 2) for x in texts]
    counts = np.array([len(x) for x in words], np.int64)
    of, n = np.repeat(np.arange(len(texts)), counts), np.repeat(counts, counts)
    i = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    bounds = (np.concatenate(words) if words else np.zeros((0, 2), np.int64)) + at[of][:, None]
    # places in bytes to places in characters: bytes that go on with one don't count
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    found = []
    for j in range(max_width):
        left = np.flatnonzero(i + j < n)
        starts, ends = bounds[left, 0], bounds[left + j, 1]
        for k, name in enumerate(names):
            p = scorer.many(name, data, starts, ends)
            hit = np.flatnonzero(p >= threshold)
            w = left[hit]
            found.append((of[w], (k * n[w] + i[w]) * max_width + j, np.full(len(w), k), i[w], i[w] + j, starts[hit], ends[hit], p[hit]))
    of, order, k, i, last, starts, ends, p = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 8
    by = np.lexsort((order, of))
    of, order, k, i, last, starts, ends, p = (x[by] for x in (of, order, k, i, last, starts, ends, p))
    places = lambda x: pa.array((before[x] - before[at[of]]).astype(np.int32))
    raw = data.tobytes()
    fields = {
        "ord": pa.array(order.astype(np.int64)),
        "label": pa.array([names[x] for x in k], pa.string()),
        "first": pa.array(i.astype(np.int32)),
        "last": pa.array(last.astype(np.int32)),
        "start": places(starts),
        "end": places(ends),
        "text": pa.array([raw[a:z].decode() for a, z in zip(starts, ends, strict=True)], pa.string()),
        "p": pa.array(p.astype(np.float64)),
    }
    offsets = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(texts)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(list(fields.values()), list(fields)))


def of_labels(spans: Column, first: Column | int, end: Column | int, max_width: int) -> Column:
    """The candidates of labels ``first`` to ``end`` (exclusive), by their places among those asked for."""
    each = F.size("words").cast("long") * max_width
    low, high = ((x if isinstance(x, Column) else F.lit(x)) * each for x in (first, end))
    return F.filter(spans, lambda c: (c["ord"] >= low) & (c["ord"] < high))


def by_confidence(spans: Column) -> Column:
    """Most probable first; ties in the order in which they were met."""
    keyed = F.transform(spans, lambda c: F.struct((-c["p"]).alias("k"), c["ord"].alias("o"), c.alias("c")))
    return F.transform(F.sort_array(keyed), lambda x: x["c"])


def greedy(spans: Column, lower: str = "start", upper: str = "end", inclusive: bool = False) -> Column:
    """Non-overlapping spans, the most probable first choice; sorted by start. All labels compete.

    For texts with few candidates. Every choice is held against all earlier ones; use
    ``greedy_many`` for long texts.
    """
    if inclusive:
        overlaps = lambda a, b: (a[lower] <= b[upper]) & (b[lower] <= a[upper])
    else:
        overlaps = lambda a, b: (a[lower] < b[upper]) & (b[lower] < a[upper])
    kept = let(by_confidence(spans), lambda order: F.aggregate(order, F.slice(order, 1, 0), lambda acc, x: F.when(F.exists(acc, lambda a: overlaps(a, x)), acc).otherwise(F.array_append(acc, x))))
    keyed = F.transform(kept, lambda c: F.struct(c[lower].alias("k"), (-c["p"]).alias("q"), c["ord"].alias("o"), c.alias("c")))
    return F.transform(F.sort_array(keyed), lambda x: x["c"])


@F.pandas_udf(ArrayType(IntegerType()))
def _chosen(starts: pd.Series, ends: pd.Series, ps: pd.Series) -> pd.Series:
    """Places of the spans that a greedy choice keeps, by start; linear in the spans' widths."""
    out = []
    for s, e, p in zip(starts, ends, ps, strict=True):
        order = sorted(range(len(s)), key=lambda i: (-p[i], i))
        taken, kept = bytearray(int(max(e)) if len(e) else 0), []
        for i in order:
            a, z = int(s[i]), int(e[i])
            if taken.find(1, a, z) < 0:  # an empty span overlaps nothing
                taken[a:z] = b"\1" * (z - a)
                kept.append(i)
        out.append(sorted(kept, key=lambda i: (s[i], -p[i], i)))
    return pd.Series(out)


def greedy_many(rows: DataFrame, column: str = "cands") -> DataFrame:
    """``greedy`` over character ranges for any number of candidates; only offsets and probabilities go to Python.

    ``cands`` must be in the order of ``ord``.
    """
    parts = [F.col(f"{column}.{f}") for f in ("start", "end", "p")]
    return rows.withColumn("_kept", _chosen.asNondeterministic()(*parts)).withColumn(column, F.transform("_kept", lambda i: F.get(column, i))).drop("_kept")


def gated(spans: Column, counts: Column) -> Column:
    """No spans if the count head's first largest logit is at 0."""
    return F.when(F.array_position(counts, F.array_max(counts)) > 1, spans).otherwise(F.slice(spans, 1, 0))


def not_abstained(spans: Column, nulls: Column, threshold: float = 0.5) -> Column:
    """Without the spans of labels whose null probability (array<struct<label, p>>) is above the threshold."""
    return F.filter(spans, lambda c: ~F.exists(nulls, lambda x: (x["label"] == c["label"]) & (x["p"] > threshold)))


def exploded(rows: DataFrame, keys: list[str], column: str = "cands") -> DataFrame:
    """One row per span: ``keys..., type, text, confidence, start, end``; confidence is a float at the edge only."""
    # the outer form keeps the optimizer from computing the array twice for a filter on its size
    flat = rows.select(*keys, F.explode_outer(column).alias("_c")).where(F.col("_c").isNotNull())
    return flat.select(*keys, F.col("_c.label").alias("type"), F.col("_c.text").alias("text"), F.col("_c.p").alias("confidence"), F.col("_c.start").alias("start"), F.col("_c.end").alias("end"))


def by_type(spans: Column) -> Column:
    """map label -> spans, labels in the order of their first span; labels without spans are absent."""
    order = F.array_distinct(F.transform(spans, lambda c: c["label"]))
    return F.map_from_entries(F.transform(order, lambda k: F.struct(k, F.filter(spans, lambda c: c["label"] == k))))


def all_types(spans: Column, names) -> Column:
    """map label -> spans with every label that was asked for, be it without spans."""
    order = F.array_distinct(labels_of(names))
    return F.map_from_entries(F.transform(order, lambda k: F.struct(k, F.filter(spans, lambda c: c["label"] == k))))


def schedule(spans: list[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
    """Of (p, start, end) half-open, the non-overlapping set with the largest sum.

    The best of equal ranges counts. Of equal sums the larger set wins, then the one whose
    ranks (places in the order by p descending, start, end) come first.
    """
    best: dict[tuple[int, int], float] = {}
    for p, s, e in spans:
        best[s, e] = max(best.get((s, e), -1.0), p)
    ranked = sorted(((p, s, e) for (s, e), p in best.items()), key=lambda x: (-x[0], x[1], x[2]))
    rank = {x: i for i, x in enumerate(ranked)}
    order = sorted(ranked, key=lambda x: (x[2], x[1], rank[x]))
    ends = [x[2] for x in order]
    sums: list[tuple[float, list[int]]] = [(0.0, [])]
    for i, x in enumerate(order):
        lo, hi = 0, i  # how many of the earlier ones end by this one's start
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if ends[mid] <= x[1] else (lo, mid)
        total, ranks = sums[lo][0] + x[0], sorted([*sums[lo][1], rank[x]])
        old = sums[i]
        better = total > old[0] or total == old[0] and (len(ranks) > len(old[1]) or len(ranks) == len(old[1]) and ranks < old[1])
        sums.append((total, ranks) if better else old)
    return [ranked[i] for i in sums[-1][1]]


def scheduled(rows: DataFrame, column: str = "cands", by_words: bool = True) -> DataFrame:
    """Per label, the spans of the largest sum; labels may overlap each other. Sorted by label, p descending, start, end."""
    first, last = ("first", "last") if by_words else ("start", "end")

    @F.pandas_udf("array<int>")
    def chosen(labels: pd.Series, starts: pd.Series, ends: pd.Series, ps: pd.Series) -> pd.Series:
        out = []
        for ls, s, e, p in zip(labels, starts, ends, ps, strict=True):
            kept: list[int] = []
            for name in dict.fromkeys(ls):
                own = [i for i in range(len(ls)) if ls[i] == name]
                place: dict[tuple, int] = {}
                for i in own:
                    place.setdefault((float(p[i]), int(s[i]), int(e[i]) + by_words), i)
                kept += [place[x] for x in schedule(list(place))]
            out.append(kept)
        return pd.Series(out)

    parts = [F.col(f"{column}.{f}") for f in ("label", first, last, "p")]
    return rows.withColumn("_kept", chosen.asNondeterministic()(*parts)).withColumn(column, F.transform("_kept", lambda i: F.get(column, i))).drop("_kept")


def bio(rows: DataFrame, names, threshold: float, scorer: Scorer) -> DataFrame:
    """Adds ``cands`` from start, inside and end scores per word (token-level heads).

    A span opens where start >= threshold, runs while inside >= threshold at each of its
    words and closes where end >= threshold; p is the least of the scores on its way.
    Met in the order of start, label, end. Every start goes over its own run once, and carries the least score along.
    """
    labels, words = labels_of(names), F.col("words")
    part = lambda label, what, w, i: scorer.score(F.concat(label, F.lit(what), i.cast("string")), w["w"])
    scored = F.transform(labels, lambda label: F.transform(words, lambda w, i: F.struct(part(label, ":start:", w, i).alias("a"), part(label, ":inside:", w, i).alias("m"), part(label, ":end:", w, i).alias("z"))))
    return runs(rows.withColumn("_scores", scored), names, threshold).drop("_scores")


def runs(rows: DataFrame, names, threshold: float, scores: str = "_scores") -> DataFrame:
    """``bio`` over given scores: per label an array of structs (a: start, m: inside, z: end) for the words."""
    labels, words = labels_of(names), F.col("words")
    n, kinds = F.size("words").cast("long"), F.size(labels).cast("long")

    def of_label(label: Column, k: Column) -> Column:
        outside = lambda x: x["m"] < threshold
        own = F.get(scores, k)
        # the words where a run ends, and how many of them stand before each word: the next one is where its run ends
        ends = F.filter(F.transform(own, lambda x, i: F.when(outside(x), i)), lambda i: i.isNotNull())
        passed = prefix_sums(F.transform(own, lambda x: F.when(outside(x), 1.0).otherwise(0.0)))
        return let(F.struct(own.alias("own"), ends.alias("ends"), passed.alias("passed")), lambda of: F.flatten(F.transform(of["own"], lambda x, i: of_start(of, label, k, x, i))))

    def of_start(of: Column, label: Column, k: Column, x: Column, i: Column) -> Column:
        stop = F.coalesce(F.get(of["ends"], F.get(of["passed"], i).cast("int")), n.cast("int"))
        none = F.struct(F.lit(2.0).alias("least"), F.lit(0).alias("j"), F.array().cast("array<struct<j:int,p:double>>").alias("out"))

        def step(acc: Column, y: Column) -> Column:
            least = F.least(acc["least"], y["m"])
            met = F.struct(acc["j"].alias("j"), F.least(x["a"], least, y["z"]).alias("p"))
            return F.struct(least.alias("least"), (acc["j"] + 1).alias("j"), F.when(y["z"] >= threshold, F.array_append(acc["out"], met)).otherwise(acc["out"]).alias("out"))

        def span(e: Column) -> Column:
            a, z = F.get(words, i), F.get(words, i + e["j"])
            text = F.array_join(F.slice("pieces", a["p"] + 1, z["p"] - a["p"] + 1), "")
            at = ((i * kinds + k) * n + i + e["j"]).cast("long")
            return F.struct(at.alias("ord"), label.alias("label"), i.alias("first"), (i + e["j"]).alias("last"), a["s"].alias("start"), z["e"].alias("end"), text.alias("text"), e["p"].alias("p"))

        found = F.transform(F.aggregate(F.slice(of["own"], i + 1, stop - i), none, step)["out"], span)
        return F.when(x["a"] >= threshold, found).otherwise(F.array().cast(f"array<{SPAN}>"))

    return rows.withColumn("cands", F.flatten(F.transform(labels, of_label)))
