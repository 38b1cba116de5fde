"""Expressions and helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of the contracts: \x20 and \x09-\x0D. Fixed values.
BLANKS = ("\t", "\n", "\v", "\f", "\r")


def spaced_pieces(text: Column) -> Column:
    """The text split at every white-space character, empty pieces included.

    Plain replacements and a one-character split stay on the byte-level fast paths;
    a regular expression costs several times as much.
    """
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return F.split(text, " ", -1)


def spaced_words(text: Column) -> Column:
    """Maximal runs of characters other than \\x20 and \\x09-\\x0D; null gives an empty array."""
    return F.array_remove(spaced_pieces(F.coalesce(text, F.lit(""))), "")


def let(value: Column, body) -> Column:
    """Bind ``value`` once inside an expression: ``body`` gets it as a column."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hinted(small: DataFrame, rows: int, limit: int) -> DataFrame:
    """Broadcast only a side whose counted rows stay under ``limit``; else leave the join to the planner."""
    return F.broadcast(small) if rows <= limit else small


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names``, each with underscores before it until no column has it (case apart)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def text_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """128 bits that tell rows apart when doc_id repeats or is null; equal rows share them."""
    return F.struct(F.xxhash64(F.col(doc_id), F.col(text)).alias("a"), F.xxhash64(F.lit(1), F.col(doc_id), F.col(text)).alias("b"))


def without(rows: DataFrame, gone: DataFrame, key: Column, buckets: int = 1 << 18) -> DataFrame:
    """``rows`` without those whose ``key`` is among the values of ``gone`` (one column).

    Only rows that share one of at most ``buckets`` hash buckets with ``gone`` are shuffled.
    A null key is never gone.
    """
    own, b, lost = fresh(rows.columns, "_key", "_b", "_gone")
    gone = gone.toDF(lost).where(F.col(lost).isNotNull()).distinct()
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets))
    near = F.broadcast(gone.select(bucket(lost).alias(b)).distinct())
    keyed = rows.withColumn(own, key).withColumn(b, bucket(own))
    names = [F.col(f"`{c}`") for c in rows.columns]
    far = keyed.join(near, b, "left_anti").select(*names)
    rest = keyed.join(near, b, "left_semi").join(gone, F.col(own) == F.col(lost), "left_anti").select(*names)
    return far.unionByName(rest)
