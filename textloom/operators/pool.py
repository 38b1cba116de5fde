"""Candidate pools over boundary scores: top-k, quotas, pairs, caps."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Queries and rows in a block of a search, and queries whose products are held at once.
BLOCK, SLICE = (16384, 32768), 64


def top_k(rows: DataFrame, keys: list[str], score: str, index: str, k: int) -> DataFrame:
    """The ``k`` highest scores of each key, lower index first on ties; adds ``rank`` from 0.

    The planner keeps only k rows per key and task before the shuffle (a window group limit).
    """
    order = W.partitionBy(*keys).orderBy(F.desc(score), index)
    return rows.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """float64 matrix of vectors of one length; a null vector is a row of NaN."""
    vectors = column.combine_chunks()
    there = pc.is_valid(vectors).to_numpy(zero_copy_only=False)
    widths = pc.unique(pc.list_value_length(vectors.drop_null())).to_pylist()
    if len(widths) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(widths)}")
    out = np.full((len(vectors), widths[0] if widths else 0), np.nan)
    if there.any():
        out[there] = vectors.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(there.sum(), -1)
    return out


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the ``k`` highest scores of each row, rounded to 5 places first; the first column on ties."""
    if scores.shape[1] > k:  # rounding moves a score by half a unit of the fifth place at most
        least = np.partition(scores, -k, axis=1)[:, -k] - 2e-5
        row, column = np.nonzero(scores >= least[:, None])
    else:
        row, column = (x.ravel() for x in np.indices(scores.shape))
    v = scores[row, column]
    v = np.sign(v) * np.floor(np.abs(v) * 1e5 + 0.5) / 1e5
    order = np.lexsort((column, -v, row))
    row, column, v = row[order], column[order], v[order]
    begin = np.searchsorted(row, row)  # ``row`` is sorted now
    keep = np.arange(len(row)) - begin < k
    return row[keep], column[keep], v[keep]


def nearest(asked: DataFrame, rows: DataFrame, by: str | None, k: int, block: tuple[int, int] = BLOCK) -> DataFrame:
    """``q, by, at, v, rank``: of each query of ``asked`` (q, qe) the ``k`` rows of each ``by`` of ``rows`` (by, at, e) with the highest dot product.

    Every query meets every row: both sides are dealt into blocks by hash, and each pair of
    blocks is one matrix product, of which k rows a query and key are left. Scores are
    rounded to 5 places, the lower ``at`` goes first on ties; a null vector scores null.
    """
    m, n = (max(1, math.ceil(side.count() / most)) for side, most in zip((asked, rows), block, strict=True))
    keys = [by] if by else []
    place = lambda side, count: F.pmod(F.xxhash64(*side.columns), F.lit(count)).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = asked.select("q", "qe", place(asked, m).alias("_i")).withColumn("_j", each(n))
    rows = rows.select(*keys, "at", "e")
    right = rows.select("*", place(rows, n).alias("_j")).withColumn("_i", each(m))
    kinds = dict(asked.dtypes) | dict(rows.dtypes)
    names = ["q", *keys, "at", "v"]

    def run(queries: pa.Table, table: pa.Table) -> pa.Table:
        found: list[tuple] = []
        table = table.sort_by([(x, "ascending") for x in (*keys, "at")])
        a, b = _matrix(queries["qe"]), _matrix(table["e"])
        if len(a) and len(b) and a.shape[1] and b.shape[1]:
            code = table[by].combine_chunks().dictionary_encode("encode").indices.to_numpy() if by else np.zeros(len(b), int)
            first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            for start, end in zip(first.tolist(), [*first[1:].tolist(), len(b)], strict=True):
                part = b[start:end].T
                for at in range(0, len(a), SLICE):
                    s = a[at : at + SLICE] @ part
                    s[np.isnan(s)] = -np.inf
                    row, column, v = _best(s, k)
                    found.append((row + at, column + start, v))
        row, column, v = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        kept = table.take(pa.array(column))
        return pa.table([queries["q"].take(pa.array(row)), *(kept[x] for x in keys), kept["at"], pa.array(v, mask=np.isneginf(v))], names=names)

    schema = ", ".join(f"{x} {kinds[x]}" for x in names[:-1]) + ", v double"
    best = left.groupBy("_i", "_j").cogroup(right.groupBy("_i", "_j")).applyInArrow(run, schema)
    return top_k(best, ["q", *keys], "v", "at", k)


def unioned(scores: DataFrame, keys: list[str], index: str, score: str) -> DataFrame:
    """The largest score over labels per place."""
    return scores.groupBy(*keys, index).agg(F.max(score).alias(score))


def pairs(starts: DataFrame, ends: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Starts and ends of a key with end > start; ``i`` numbers the pair. Both sides have at most ``k`` rows a key."""
    left = starts.select(*keys, F.col("at").alias("s"), F.col("v").alias("sv"), F.col("rank").alias("x"))
    right = ends.select(*keys, F.col("at").alias("e"), F.col("v").alias("ev"), F.col("rank").alias("y"))
    joined = left.join(right, keys).where("e > s")
    return joined.select(*keys, "s", "e", (F.col("sv") + F.col("ev")).alias("v"), (F.col("x") * k + F.col("y")).alias("i"))


def pooled(wide: DataFrame, by_label: DataFrame, keys: list[str], label: str, quota: int, size: int) -> DataFrame:
    """Pairs of all labels and each label's best ``quota``, which stand in a band of scores above; once per (s, e).

    ``label`` is the label's number; in the band ties go by label, then rank, elsewhere by pair.
    """
    own = top_k(by_label, [*keys, label], "v", "i", quota)
    band = own.select(*keys, "s", "e", (F.lit(5000.0) + quota - F.col("rank")).alias("v"), (F.col(label) * quota + F.col("rank") - (1 << 40)).alias("i"))
    both = wide.select(*keys, "s", "e", "v", "i").unionByName(band)
    order = W.partitionBy(*keys, "s", "e").orderBy(F.desc("v"), "i")
    once = both.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
    return top_k(once, keys, "v", "i", size)


def capped(heads: DataFrame, tails: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Pairs of different arguments, the ``most`` with the largest product of probabilities."""
    left = heads.select(*keys, F.col("s").alias("hs"), F.col("e").alias("he"), F.col("p").alias("hp"), F.col("rank").alias("x"))
    right = tails.select(*keys, F.col("s").alias("ts"), F.col("e").alias("te"), F.col("p").alias("tp"), F.col("rank").alias("y"))
    joined = left.join(right, keys).where("NOT (hs = ts AND he = te)")
    made = joined.withColumns({"v": F.col("hp") * F.col("tp"), "i": F.col("x") * 100_000 + F.col("y")})
    return top_k(made, keys, "v", "i", most)


#: Different lengths that the driver takes at once to find the borders of buckets.
LENGTHS = 1 << 20


def length_buckets(lengths: DataFrame, column: str, ratio: float) -> list[int]:
    """Where buckets begin if texts are cut greedily by length: a bucket ends before lengths above ``ratio`` times its first.

    There are at most log(longest) / log(ratio) buckets. All are found from the distinct
    lengths, in one job; only if these are more than ``LENGTHS`` is each border a query of its own.
    """
    if ratio <= 1:
        raise ValueError("a ratio above 1 is needed")
    distinct = lengths.select(F.col(column).alias("n")).where("n IS NOT NULL").distinct()
    some = [r["n"] for r in distinct.limit(LENGTHS + 1).collect()]
    if len(some) <= LENGTHS:
        borders = []
        for n in sorted(some):
            if not borders or n > max(borders[-1], 1) * ratio:
                borders.append(n)
        return borders
    borders, at = [], distinct.agg(F.min("n")).first()[0]
    while at is not None:
        borders.append(at)
        at = distinct.where(F.col("n") > F.lit(max(at, 1) * ratio)).agg(F.min("n")).first()[0]
    return borders


def in_buckets(lengths: list[int], ratio: float, cap: int | None = None) -> list[list[int]]:
    """Buckets of one batch: places by length, cut where a length is above ``ratio`` times the bucket's first, or at ``cap``.

    A ratio up to 1 cuts by the cap alone, and a cap that holds all then leaves one bucket in
    the given order.
    """
    n = len(lengths)
    if not n:
        return []
    if ratio <= 1 and (cap is None or cap >= n):
        return [list(range(n))]
    out: list[list[int]] = []
    for i in sorted(range(n), key=lambda i: lengths[i]):
        wide = ratio > 1 and out and lengths[i] > lengths[out[-1][0]] * ratio
        if not out or wide or cap is not None and len(out[-1]) >= cap:
            out.append([])
        out[-1].append(i)
    return out
