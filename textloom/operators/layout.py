"""Rows as a model reads them: numbers of pieces, places of markers and words, padded by length.

A prompt (plans.prompt.assemble) comes before the words of a text; words are cut into pieces,
and pieces have numbers. The vocabulary is built from the texts themselves: no tokenizer is
read or trained. Texts of like length are padded together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import let, prefix_sums

#: Characters of a piece, the number that pads, the place that stands for no word.
PIECE, PAD, NOWHERE = 4, 0, -1
#: Pieces up to which the vocabulary is sent to all executors.
BROADCAST = 200_000


def pieces_of(word: Column, size: int = PIECE) -> Column:
    """A word cut every ``size`` characters."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(word) / size).cast("int") - 1, F.lit(0))), lambda i: F.substring(word, i * size + 1, F.lit(size)))


def cut(rows: DataFrame, size: int = PIECE) -> DataFrame:
    """Adds ``parts``: per word its pieces. Needs ``words`` (functions.text.with_words)."""
    return rows.withColumn("parts", F.transform("words", lambda w: pieces_of(w["w"], size)))


def vocabulary(rows: DataFrame, markers: list[str], size: int = PIECE) -> DataFrame:
    """``piece, id, marker``: the markers in their order after the padding, then all pieces of ``parts`` in the order of their bytes.

    A piece of a text that reads like a marker is a piece with a number of its own.

    Pieces that begin alike are numbered together, after the numbers of those that begin before
    them, so that the order of all is never made in one task.
    """
    found = rows.select(F.explode_outer(F.flatten("parts")).alias("piece")).where("piece IS NOT NULL").distinct()
    found = found.withColumn("head", F.substring("piece", 1, 2))
    # a row for each beginning of two characters
    sizes = found.groupBy("head").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("head").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("head", before.alias("before"))
    own = found.join(starts, "head").withColumn("id", F.col("before") + F.row_number().over(W.partitionBy("head").orderBy("piece")) + len(markers) + PAD)
    fixed = rows.sparkSession.createDataFrame([(m, k + PAD + 1, True) for k, m in enumerate(markers)], "piece string, id long, marker boolean")
    return fixed.unionByName(own.select("piece", F.col("id").cast("long").alias("id"), F.lit(False).alias("marker")))


def numbered(rows: DataFrame, vocab: DataFrame, keys: list[str], prefix: list[str], markers: list[list[int]], broadcast_rows: int | None = None) -> DataFrame:
    """``keys..., ids, first, n_words``: the prompt's and the text's numbers, and where each word's first piece stands.

    ``prefix`` are the prompt's tokens, each one number, and ``markers`` the places of each
    unit's markers; these must be as many as the prompt has. ``keys`` tell rows apart. A text's
    numbers are gathered from a row for each of its pieces.
    """
    wanted = sorted(x for unit in markers for x in unit)
    kinds = {prefix[x] for x in wanted}
    if wanted != [i for i, token in enumerate(prefix) if token in kinds]:
        raise ValueError("a label holds a marker, or markers are missing")
    side = lambda marker: vocab.where(F.col("marker") == marker).select(F.col("piece").alias("_piece"), F.col("id").alias("_id"))
    table = side(False)
    if broadcast_rows is not None and broadcast_rows <= BROADCAST:
        table = F.broadcast(table)
    each = rows.select(*keys, F.posexplode_outer(F.flatten("parts")).alias("_at", "_piece")).where("_piece IS NOT NULL")
    ids = each.join(table, "_piece").groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_id"))), lambda x: x["_id"]).alias("_ids"))
    head = rows.sparkSession.createDataFrame([(i, t) for i, t in enumerate(prefix)], "at int, _piece string").join(side(True), "_piece")
    known = {r["at"]: r["_id"] for r in head.collect()}  # a row for each token of the prompt
    if len(known) < len(prefix):
        raise ValueError("the vocabulary lacks tokens of the prompt")
    lead = F.array(*(F.lit(known[i]).cast("long") for i in range(len(prefix))))
    sums = lambda parts: prefix_sums(F.transform(parts, lambda p: F.size(p).cast("double")))
    first = let(sums(F.col("parts")), lambda s: F.transform(F.slice(s, 1, F.size(s) - 1), lambda x: x.cast("int") + len(prefix)))
    out = rows.select(*keys, first.alias("first"), F.size("parts").alias("n_words"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    joined = out.join(ids.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)}), same, "left")
    none = F.array().cast("array<bigint>")
    return joined.select(*keys, F.concat(lead, F.coalesce("_ids", none)).alias("ids"), "first", "n_words")


def padded(rows: DataFrame, borders: list[int]) -> DataFrame:
    """Adds ``bucket`` by the number of ``ids``, and pads ``ids`` and ``first`` to the longest of the bucket.

    ``borders`` are the lengths at which buckets begin (operators.pool.length_buckets).
    """
    bucket = F.size(F.filter(F.array(*map(F.lit, borders)), lambda b: b <= F.size("ids"))) - 1 if borders else F.lit(0)
    rows = rows.withColumn("bucket", bucket)
    # a row for each bucket
    most = F.broadcast(rows.groupBy("bucket").agg(F.max(F.size("ids")).alias("_ids"), F.max("n_words").alias("_words")))
    rows = rows.join(most, "bucket")
    fill = lambda column, n, value, kind: F.concat(column, F.array_repeat(F.lit(value).cast(kind), F.col(n) - F.size(column)))
    return rows.withColumns({"ids": fill("ids", "_ids", PAD, "bigint"), "first": fill("first", "_words", NOWHERE, "int")}).drop("_ids", "_words")
