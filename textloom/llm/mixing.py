"""Mixing sources to target weights by a low-discrepancy schedule.

Every source's rows are shuffled (by a hash of doc_id) onto a line of tokens that is cut
into equal blocks. Slot i of the schedule takes the golden-ratio point frac((i+1)*phi);
cumulative target weights map it to a source; the slot's rank within its source names the
block, counted round the line again and again. Slots and blocks are joined on
(source, block). A source's last slot ends at its target, so it takes just that many tokens.

Defined cases: a null text has size 0 and is never taken; a null source is a source of its
own, the last; repeated rows are rows of their own; rows that tie on the hash (equal ids)
are ordered by id, then size, and rows that tie on all of these are interchangeable; a very
long text is as many blocks as it has; an empty table gives an empty result; extra columns are
not used.

Sizes in memory: line positions and slot ranks come from prefix sums over bounded runs of
rows, so that no task ever holds a source; only one row per source and run is gathered. Rows
of equal id and size are one row with a count until they have their places, so that a run of
many null ids is no longer than there are sizes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stored
from .common import hinted, spaced_pieces

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Tokens in a block.
BLOCK = 128
#: Rows of a source, and slots, that are numbered together.
RUN_ROWS, RUN_SLOTS = 2_000, 1 << 12
#: Sources up to which their table is broadcast.
BROADCAST_ROWS = 200_000
#: Fractional part of the golden ratio.
GOLDEN = (math.sqrt(5) - 1) / 2


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size``: size counts runs of characters other than white space."""
    words = F.size(F.array_remove(spaced_pieces(F.coalesce("text", F.lit(""))), ""))
    return docs.select("doc_id", "source", words.cast("long").alias("size"))


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``sid, source, source_size, n_rows, target``: one row per source.

    ``share`` times all sizes are shared by weight; a target stops at ``most`` times its
    source's size and what is above is shared anew among the rest. The end of that is
    min(most * size, level * weight) for one level, which sorting by size per weight finds.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    rank = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1).cast("int")
    weight = F.element_at(F.array(*map(F.lit, weights)), F.col("sid") % len(weights) + 1)
    per = per.withColumn("sid", rank).withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    # in order of cap per weight, a source is capped if its fair share of what earlier ones leave is above its cap
    order = W.orderBy(F.col("cap") / F.col("weight"), "sid")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    total = share * F.sum("source_size").over(W.partitionBy())
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rest = F.sum("weight").over(W.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumns({"level": left / rest, "capped": left / rest * F.col("weight") >= F.col("cap")})
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(W.partitionBy())
    return per.select("sid", "source", "source_size", "n_rows", F.when(F.col("capped"), F.col("cap")).otherwise(level * F.col("weight")).alias("target"))


def _numbered(rows: DataFrame, key: str, run: str, order: list, size: Column, name: str) -> DataFrame:
    """Adds the sum of ``size`` over earlier rows of ``key``: within runs, plus a prefix sum over runs."""
    runs = rows.groupBy(key, run).agg(F.sum(size).alias("_n"))
    runs = runs.select(key, run, F.coalesce(F.sum("_n").over(W.partitionBy(key).orderBy(run).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.sum(size).over(W.partitionBy(key, run).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)) - size
    return rows.withColumn(name, within).join(runs, [key, run]).withColumn(name, F.col(name) + F.col("_before")).drop("_before")


def lines(sizes: DataFrame, goals: DataFrame, n_goals: int) -> DataFrame:
    """Rows with their place ``at`` on the shuffled line of their source."""
    known = goals.select("sid", F.col("source").alias("_source"), "source_size", "n_rows", "target")
    same = sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("_same"))
    rows = same.join(hinted(known, n_goals, BROADCAST_ROWS), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    # md5 as text puts rows in an order that SQL engines share; its leading digits cut a source into even runs
    rows = rows.withColumn("_order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    part = F.conv(F.substring("_order", 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    rows = rows.withColumn("_run", F.floor(part * F.ceil(F.col("n_rows") / RUN_ROWS)).cast("long"))
    rows = _numbered(rows, "sid", "_run", ["_order", "doc_id", "size"], F.col("size") * F.col("_same"), "at")
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_same") - 1))
    return rows.withColumn("_copy", copy).withColumn("at", F.col("at") + F.col("_copy") * F.col("size")).drop("_order", "_run", "_same", "_copy")


def segments(line: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows cut at block borders: ``block, start, end`` (places within the block). Rows of size 0 have one segment of nulls."""
    first, last = F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block)
    cut = line.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
    at = F.col("block") * block
    return cut.withColumns({"start": F.greatest(F.col("at") - at, F.lit(0)), "end": F.least(F.col("at") + F.col("size") - at, F.lit(block))})


def schedule(goals: DataFrame, block: int = BLOCK) -> DataFrame:
    """``slot, sid, rank, block, take``: which block each slot takes, and how many of its tokens.

    ``goals`` has sid, source_size and target. There are as many golden-ratio slots as blocks
    are wanted. A source whose share of these points falls short of its blocks (by a few, as
    the points leave no gaps) gets the missing slots at the end, and one that has too many
    leaves its last ones, so all in all there are fewer than three slots a block, however
    different sources are.
    """
    spark = goals.sparkSession
    whole = F.round("target").cast("long")
    # a line of S tokens has ceil(S/block) blocks; the last is short, so rounds are counted in blocks and words apart
    turns = F.floor(whole / F.col("source_size"))
    wanted = turns * F.ceil(F.col("source_size") / block) + F.ceil((whole - turns * F.col("source_size")) / block)
    known = goals.where("source_size > 0 AND target >= 0.5").select("sid", "source_size", "target", wanted.alias("wanted"))
    n, total, blocks = known.agg(F.count("*"), F.sum("target"), F.sum("wanted")).first()
    if not n:
        return spark.range(0).select(F.col("id").alias("slot"), F.lit(0).alias("sid"), *(F.lit(0).cast("long").alias(c) for c in ("rank", "block", "take")))
    # one row per source: a stretch of [0, 1) each, listed under each of the cells that it meets
    upto = F.sum(F.col("target") / F.lit(total)).over(W.orderBy("sid").rowsBetween(W.unboundedPreceding, W.currentRow))
    cells = 1 << max(10, (2 * n).bit_length())
    stretch = known.withColumn("_hi", upto).withColumn("_lo", F.col("_hi") - F.col("target") / F.lit(total))
    stretch = stretch.withColumns({"_lo": F.when(F.col("_lo") < 1e-12, F.lit(0.0)).otherwise(F.lag("_hi").over(W.orderBy("sid"))), "_hi": F.when(F.lead("_hi").over(W.orderBy("sid")).isNull(), F.lit(1.0)).otherwise(F.col("_hi"))})
    cell = lambda at: F.least(F.floor(at * cells), F.lit(cells - 1))
    stretch = stretch.where("_lo < _hi").select("sid", "_lo", "_hi", F.explode(F.sequence(cell(F.col("_lo")), cell(F.col("_hi")))).alias("_cell"))
    point = (F.col("slot") + 1) * F.lit(GOLDEN) % 1.0
    slots = spark.range(blocks).select(F.col("id").alias("slot"), point.alias("_at")).withColumn("_cell", cell(F.col("_at")))
    slots = slots.join(hinted(stretch, cells + 2 * n, BROADCAST_ROWS), "_cell").where("_at >= _lo AND _at < _hi")
    slots = _numbered(slots.select("slot", "sid", F.floor(F.col("slot") / RUN_SLOTS).alias("_run")), "sid", "_run", ["slot"], F.lit(1), "rank").select("slot", "sid", "rank")
    has = slots.groupBy("sid").agg(F.count("*").alias("_has"))
    short = known.join(hinted(has, n, BROADCAST_ROWS), "sid", "left").withColumn("_has", F.coalesce("_has", F.lit(0))).where("_has < wanted")
    more = short.select("sid", "_has", F.explode(F.sequence(F.col("_has"), F.col("wanted") - 1)).alias("rank"))
    more = more.select((blocks + (F.col("rank") - F.col("_has")) * (n + 1) + F.col("sid")).alias("slot"), "sid", "rank")
    every = slots.unionByName(more).join(hinted(known, n, BROADCAST_ROWS), "sid").where("rank < wanted")
    per_round = F.ceil(F.col("source_size") / block)
    turn, number = F.floor(F.col("rank") / per_round), F.col("rank") % per_round
    before = turn * F.col("source_size") + number * block
    room = F.least(F.lit(block), F.col("source_size") - number * block)
    every = every.withColumns({"block": number, "take": F.least(room, whole - before)})
    return every.select("slot", "sid", "rank", "block", "take")


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(rows with at, target and source_size; the mix: ``slot, sid, rank, block, doc_id, at, start, words``)."""
    sizes = stored(sized(docs), "sizes")
    goals = stored(targets(sizes, share, most).coalesce(1), "targets")
    line = lines(sizes, goals, goals.count())
    slots = schedule(goals, block)
    cut = segments(line, block)
    words = F.least(F.col("end"), F.coalesce("take", F.lit(0))) - F.col("start")
    mixed = cut.join(slots, ["sid", "block"], "left").withColumn("words", F.coalesce(F.greatest(words, F.lit(0)), F.lit(0)))
    return line, mixed


def taken(docs: DataFrame, share: float = 1.5, most: float = 2.0, block: int = BLOCK) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken``: how many words of each row the mix takes, repeats counted."""
    _, mixed = mix(docs, share, most, block)
    # rows of a source differ in their place; rows of size 0 are counted, as they may tie in everything
    per = mixed.groupBy("doc_id", "source", "sid", "size", "source_size", "target", "at").agg(F.sum("words").alias("taken"), F.count("*").alias("_n"))
    rows = per.withColumn("_n", F.when(F.col("size") == 0, F.col("_n")).otherwise(F.lit(1)))
    rows = rows.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    return rows.select("doc_id", "source", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return taken(docs).select("doc_id", "size", "source_size", "target", "taken")


def sql(docs: str = "documents") -> str:
    """The same rows from a closed form: what a row at place ``at`` shares with [0, T) on its line laid end to end."""
    return rf"""
WITH d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size FROM {docs}),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM d GROUP BY source),
w AS (SELECT *, list_extract([5.0, 2.0, 1.0]::DOUBLE[], CAST(sid % 3 + 1 AS BIGINT)) AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
o AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS weights
  FROM w WINDOW b AS (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, rest / weights * weight >= cap AS capped FROM o),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE max(CASE WHEN NOT capped THEN rest / weights END) OVER () * weight END AS target FROM c),
l AS (SELECT d.doc_id, d.size, t.source_size, t.target, sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), d.doc_id NULLS FIRST, d.size
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS place, CAST(round(t.target) AS BIGINT) AS goal FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(greatest(0, least(place + size, goal) - place) + greatest(0, least(place + size + source_size, goal) - place - source_size) AS BIGINT) AS taken
FROM l
"""
