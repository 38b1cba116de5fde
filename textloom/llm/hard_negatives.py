"""Hard negatives of anchors by a table of distances to pivots.

Scores are inner products of vectors scaled to whole numbers. One more component,
sqrt(M^2 - |x|^2) with M the largest norm, puts all rows on a sphere, while anchors get 0
there: the inner product is then (|q|^2 + M^2 - d^2) / 2 of the Euclidean distance d. The
table holds each row's distances to ``PIVOTS`` rows; by the triangle inequality the
distances of an anchor and of a row to each pivot bracket theirs, and so the score.

Rows are stored in blocks of one label, sorted by their nearest pivot and their distance to
it, with the range of each pivot's distances in the block; anchors in pages likewise. A page
meets only the blocks whose ranges leave open that an anchor finds something there; in
a block, only rows whose own brackets leave that open are scored. A first round over the
most promising blocks gives each anchor a score that its last result reaches at least; with
this bound a second round goes over all blocks. Nothing but the search for brackets decides
what is left out, so the result is exact.

Scale: every page meets the ranges of all blocks (a hundredth of the rows against one row
of ranges in ``BLOCK``), in shelves of bounded size; blocks that brackets rule out are
never sent. Blocks, pages and shelves are single rows of bounded size, so that a label or a
vector that a third of the rows share is dealt over tasks.

Defined cases: rows without vec_id, label or vector, or with a component that is null, not
finite or not under ``LARGEST`` (its scores would not fit 64 bits) take no part; vectors of
different lengths are compared over the places that both have; an empty vector scores 0;
rows that repeat an id are rows of their own: each is found, and each that is an anchor asks
and doesn't find itself; ties go to the smaller id, then to the row read first; anchors of a
label that no other row has get nothing; bands of negative scores are empty; empty tables
give no rows; extra columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import discard, stored

#: Pivots, and rows from which they are chosen (a bounded sample: it decides on speed, not on results).
PIVOTS, SAMPLE = 16, 1024
#: Rows of a block, anchors of a page, blocks of a shelf; blocks of the first round for each page.
BLOCK, PAGE, SHELF, FIRST = 2048, 256, 4096, 2
#: What components must stay below.
LARGEST = 131_072.0
#: Positives of an anchor, negatives of a positive; percent of a positive's score where negatives begin and end.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
SCALE = 256

#: A stretch of rows of one label: ids, components (``kind`` is numpy's), distances, their ranges, and what each row wants.
PACK = "pack long, label int, n int, width int, kind string, rows binary, ids binary, v binary, d binary, low array<double>, high array<double>, wants binary"
FOUND = "anchor long, slot int, row long, vec_id long, score long"
#: What a row wants: its place in the pack, slot, least and largest score.
WANT = np.dtype([("at", "<i4"), ("slot", "<i4"), ("lo", "<i8"), ("hi", "<i8")])
ANY = (-(1 << 62), 1 << 62)


def scaled(table: DataFrame) -> DataFrame:
    """Stored ``row, vec_id, label, v, norm`` of the rows of ``table`` (vec_id, embedding, label) that take part."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST)
    rows = table.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull())
    rows = rows.where(F.coalesce(F.forall("embedding", fine), F.lit(False)))
    v = F.transform("embedding", lambda x: F.floor(SCALE * x.cast("double")).cast("int"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), v.alias("v"))
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda acc, x: acc + x.cast("long") * x)
    return stored(rows.withColumn("norm", norm).withColumn("row", F.monotonically_increasing_id()), "vectors")


def padded(lists: pa.Array, width: int) -> np.ndarray:
    """Lists of whole numbers as a matrix; 0 behind their ends, and nothing beyond ``width``."""
    sizes = np.minimum(lists.value_lengths().to_numpy(zero_copy_only=False), width)
    out = np.zeros((len(lists), width), np.int64)
    values, starts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()[:-1]
    row = np.repeat(np.arange(len(lists)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, place] = values[starts[row] + place]
    return out


def pivots_of(rows: DataFrame, most: float, count: int = PIVOTS) -> np.ndarray:
    """``count`` rows with the added component, each as far as can be from those before it, of one row for each of ``SAMPLE`` hashes."""
    part = rows.groupBy(F.pmod(F.xxhash64("row"), F.lit(SAMPLE)).alias("part")).agg(F.min_by("v", F.struct(F.xxhash64(F.lit(1), "row"), "row")).alias("v"))
    sample = sorted(r["v"] for r in part.select("v").collect())
    width = max(map(len, sample), default=0)
    x = np.array([[*v, *[0] * (width - len(v))] for v in sample], float).reshape(len(sample), width)
    x = np.column_stack([x, np.sqrt(np.maximum(most - (x**2).sum(1), 0))])
    chosen, far = [0][: len(x)], np.full(len(x), np.inf)
    while len(chosen) < min(count, len(x)):
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
        chosen.append(int(far.argmax()))
    return x[chosen]


def to_pivots(v: np.ndarray, pivots: np.ndarray, most: float, anchors: bool) -> np.ndarray:
    """Distances of rows of ``v`` to the pivots; the added component of anchors is 0."""
    width = max(v.shape[1], pivots.shape[1] - 1)
    wide = lambda m: np.pad(m.astype(float), ((0, 0), (0, width - m.shape[1])))
    x, p = wide(v), wide(pivots[:, :-1])
    own = np.zeros(len(x)) if anchors else np.sqrt(np.maximum(most - (x**2).sum(1), 0))
    squares = (x**2).sum(1)[:, None] + (p**2).sum(1) - 2 * x @ p.T + (own[:, None] - pivots[:, -1]) ** 2
    return np.sqrt(np.maximum(squares, 0))


def measured(rows: DataFrame, pivots: np.ndarray, most: float, anchors: bool) -> DataFrame:
    """The pivot table: ``rows`` with ``near`` (the nearest pivot), ``dist`` (to it) and ``d`` (to all)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("v"))
            width = int(lists.value_lengths().to_numpy(zero_copy_only=False).max(initial=0))
            d = to_pivots(padded(lists, width), pivots, most, anchors).astype(np.float32)
            near = d.argmin(1) if d.shape[1] else np.zeros(len(d), int)
            sizes = pa.array(np.arange(len(d) + 1, dtype=np.int32) * d.shape[1])
            added = [pa.array(near.astype(np.int32)), pa.array(d.min(1) if d.shape[1] else np.zeros(len(d), np.float32)), pa.ListArray.from_arrays(sizes, pa.array(d.ravel()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "near", "dist", "d"])

    kinds = ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes)
    return rows.mapInArrow(run, f"{kinds}, near int, dist float, d array<float>")


def _pack(rows: pa.Table) -> dict:
    """One row of ``PACK`` from rows of one label."""
    lists = rows["v"].combine_chunks()
    width = int(lists.value_lengths().to_numpy(zero_copy_only=False).max(initial=0))
    v = padded(lists, width)
    top = int(np.abs(v).max(initial=0))
    v = v.astype("<i2" if top < 1 << 15 else "<i4")
    d = rows["d"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1).astype(np.float32)
    wants = [(at, w["slot"], w["lo"], w["hi"]) for at, ws in enumerate(rows["wants"].to_pylist()) for w in ws or ()] if "wants" in rows.column_names else []
    return {
        "pack": rows["row"][0].as_py(), "label": rows["label"][0].as_py(), "n": len(rows), "width": width, "kind": v.dtype.str,
        "rows": rows["row"].to_numpy().astype("<i8").tobytes(), "ids": rows["vec_id"].to_numpy().astype("<i8").tobytes(), "v": v.tobytes(), "d": d.tobytes(),
        "low": d.min(0).astype(float).tolist(), "high": d.max(0).astype(float).tolist(), "wants": np.array(wants, WANT).tobytes(),
    }


def packs(rows: DataFrame, most: int) -> DataFrame:
    """Stored rows of ``PACK``: up to ``most`` rows of one label each, neighbours by pivot and distance together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, schema = None, pa.schema([("pack", pa.int64()), ("label", pa.int32()), ("n", pa.int32()), ("width", pa.int32()), ("kind", pa.string()), *((x, pa.binary()) for x in ("rows", "ids", "v", "d")), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("wants", pa.binary())])
        out = lambda parts: pa.RecordBatch.from_pylist([_pack(p) for p in parts], schema=schema)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            kept = table if kept is None else pa.concat_tables([kept, table]).combine_chunks()
            label = kept["label"].to_numpy()
            place = np.arange(len(label)) - np.searchsorted(label, label)  # sorted by label
            first = np.flatnonzero(place % most == 0)
            for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                yield out([kept.slice(a, z - a)])
            kept = kept.slice(int(first[-1])) if len(first) else kept
        if kept is not None and len(kept):
            yield out([kept])

    order = ["label", "near", "dist", "row"]
    columns = [*order, "vec_id", "v", "d", *(["wants"] if "wants" in rows.columns else [])]
    # ``row`` tells all rows apart, so that equal vectors are dealt over tasks too
    return stored(rows.select(*columns).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, PACK), "packs")


class Pack:
    """A row of ``PACK`` as matrices."""

    def __init__(self, row: dict):
        self.id, self.label, self.n, self.width = row["pack"], row["label"], row["n"], row["width"]
        self.rows, self.ids = np.frombuffer(row["rows"], "<i8"), np.frombuffer(row["ids"], "<i8")
        self.v = np.frombuffer(row["v"], row["kind"]).reshape(self.n, self.width)
        self.d = np.frombuffer(row["d"], np.float32).reshape(self.n, -1).astype(float)
        self.wants = np.frombuffer(row["wants"], WANT)
        self.norm = (self.v.astype(float) ** 2).sum(1)


def brackets(page: Pack, low: np.ndarray, high: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest scores of the page's anchors with rows whose distances to the pivots lie between ``low`` and ``high`` (rows x pivots)."""
    least, largest = np.zeros((page.n, len(low))), np.full((page.n, len(low)), np.inf)
    for j in range(low.shape[1]):
        q = page.d[:, j, None]
        np.maximum(least, np.maximum(low[:, j] - q, q - high[:, j]), out=least)
        np.minimum(largest, q + high[:, j], out=largest)
    whole = (page.norm + most)[:, None]
    slack = 1 + 4e-6 * whole  # distances are kept in single precision
    return (whole - largest**2) / 2 - slack, (whole - least**2) / 2 + slack


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products over the places that both have."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    top = [int(np.abs(x.astype(np.int64)).max(initial=0)) for x in (a, b)]
    kind = np.float64 if top[0] * top[1] * width < 1 << 53 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


def _meetings(pages: DataFrame, blocks: DataFrame, same: bool, most: float) -> DataFrame:
    """Stored ``page, block, reach``: pages and the blocks where brackets leave open that an anchor finds something."""
    ranges = blocks.select("pack", "label", "low", "high")
    shelves = max(1, -(-ranges.count() // SHELF))
    shelf = ranges.groupBy(F.pmod(F.xxhash64("pack"), F.lit(shelves)).alias("shelf")).agg(F.collect_list(F.struct("pack", "label", "low", "high")).alias("blocks"))
    asked = pages.withColumn("shelf", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shelves - 1).cast("long"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                page = Pack(row)
                found = [b for b in row["blocks"] if (b["label"] == page.label) == same]
                if not found or not len(page.wants):
                    continue
                low, high = brackets(page, *(np.array([b[x] for b in found], float).reshape(len(found), -1) for x in ("low", "high")), most)
                w = page.wants
                open_ = (high[w["at"]] >= w["lo"][:, None]) & (low[w["at"]] <= w["hi"][:, None])
                # how near the band's upper end a block can come
                reach = np.where(open_, np.minimum(high[w["at"]] - w["hi"][:, None], 0.0), -np.inf).max(0)
                k = np.flatnonzero(open_.any(0))
                yield pa.record_batch([pa.array([page.id] * len(k), pa.int64()), pa.array([found[x]["pack"] for x in k], pa.int64()), pa.array(reach[k])], names=["page", "block", "reach"])

    return stored(asked.join(shelf, "shelf").drop("shelf").mapInArrow(run, "page long, block long, reach double"), "meetings")


def _round(pages: DataFrame, blocks: DataFrame, met: DataFrame, k: int, most: float) -> DataFrame:
    """Stored rows of ``FOUND``: of each page and block that meet the ``k`` best rows for each want."""
    names = [x.split()[0] for x in PACK.split(", ")]
    side = lambda packs, x: packs.select(F.col("pack").alias(x), F.struct(*names).alias(f"_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, b in zip(batch.column(0), batch.column(1), strict=True):
                page, block = Pack(p.as_py()), Pack(b.as_py())
                low, high = brackets(page, block.d, block.d, most)
                out = []
                w = page.wants
                left = (high[w["at"]] >= w["lo"][:, None]) & (low[w["at"]] <= w["hi"][:, None]) & (page.rows[w["at"]][:, None] != block.rows)
                some = np.flatnonzero(left.any(0))
                scores = products(page.v, block.v[some])
                for want, open_ in zip(w, left[:, some], strict=True):
                    own = scores[want["at"]]
                    x = np.flatnonzero(open_ & (own >= want["lo"]) & (own <= want["hi"]))
                    if len(x) > k:
                        x = x[own[x] >= np.partition(own[x], -k)[-k]]
                    x = x[np.lexsort((block.rows[some[x]], block.ids[some[x]], -own[x]))][:k]
                    out += [(page.rows[want["at"]], want["slot"], block.rows[some[y]], block.ids[some[y]], own[y]) for y in x]
                if out:
                    yield pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), *[pa.int64()] * 3), strict=True)], names=["anchor", "slot", "row", "vec_id", "score"])

    both = met.select("page", "block").join(side(pages, "page"), "page").join(side(blocks, "block"), "block")
    return stored(both.select("_page", "_block").mapInArrow(run, FOUND), "found")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(anchors: DataFrame, blocks: DataFrame, k: int, same: bool, most: float) -> DataFrame:
    """Rows of ``FOUND`` with ``rank`` from 1: for each anchor and want the ``k`` best rows of its label (``same``) or of other labels.

    ``anchors`` have a pivot table's columns and ``wants``, an array of (slot, lo, hi).
    """
    pages = packs(anchors, PAGE)
    met = _meetings(pages, blocks, same, most)
    rank = F.row_number().over(W.partitionBy("page").orderBy(F.desc("reach"), "block"))
    found = _round(pages, blocks, met.withColumn("_r", rank).where(F.col("_r") <= FIRST), k, most)
    # a score that the last of k results reaches at least
    least = _best(found, k).where(F.col("rank") == k).select("anchor", "slot", F.col("score").alias("least"))
    wants = anchors.select("row", F.explode_outer("wants").alias("w")).where("w IS NOT NULL").select(F.col("row").alias("anchor"), "w.slot", "w.lo", "w.hi").join(least, ["anchor", "slot"], "left")
    wants = wants.groupBy("anchor").agg(F.collect_list(F.struct("slot", F.coalesce("least", "lo").alias("lo"), "hi")).alias("wants"))
    discard(pages, met)
    again = packs(anchors.drop("wants").join(wants.withColumnRenamed("anchor", "row"), "row"), PAGE)
    met = _meetings(again, blocks, same, most)
    whole = _round(again, blocks, met, k, most)
    discard(found, again, met)
    out = stored(_best(whole, k), "best")
    discard(whole)
    return out


def mined(table: DataFrame, every: int = 100) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``; anchors are rows whose vec_id is divisible by ``every``."""
    rows = scaled(table)
    most = float(rows.agg(F.max("norm")).first()[0] or 0)
    pivots = pivots_of(rows, most)
    pivot_table = measured(rows.select("row", "vec_id", "label", "v"), pivots, most, False)
    blocks = packs(pivot_table, BLOCK)
    anchors = stored(measured(rows.where(F.col("vec_id") % every == 0).select("row", "vec_id", "label", "v"), pivots, most, True), "anchors")
    discard(rows)
    want = lambda slot, lo, hi: F.struct(slot.cast("int").alias("slot"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))
    positives = search(anchors.withColumn("wants", F.array(want(F.lit(0), *map(F.lit, ANY)))), blocks, POSITIVES, True, most)
    p = F.col("score")
    # floors and ceilings of whole numbers; a band of a negative score is empty
    lo, hi = F.expr(f"-((-{LOW} * score - pmod(-{LOW} * score, 100)) div 100)"), F.expr(f"({HIGH} * score - pmod({HIGH} * score, 100)) div 100")
    bands = positives.where(p >= 0).select(F.col("anchor").alias("row"), want(F.col("rank"), lo, hi).alias("w")).groupBy("row").agg(F.collect_list("w").alias("wants"))
    negatives = search(anchors.join(bands, "row"), blocks, NEGATIVES, False, most)
    of = positives.select("anchor", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = negatives.select("anchor", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(of, ["anchor", "slot"])
    names = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return found.join(names, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def query(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(table.withColumn("label", label))


SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
