"""Near-duplicate groups by SimHash fingerprints, searched in a Gray-order hierarchical index.

A document's fingerprint has a bit set where over half of its shingles' hashes have it.
Equal fingerprints are one entry from there on, so that copies cost nothing further. Two
entries link if they differ in ``DISTANCE`` bits at most. The index has four levels:

* upper nodes are masked bit patterns. Cut into one block more than bits may differ, two
  linked fingerprints agree on a block, and on a part of what is left cut likewise; each
  (block, part) is a mask, and the entries that agree under it stand below one node;
* below a node entries stand in Gray order, where neighbours share most bits. Runs of up to
  ``CHUNK`` entries, cut by a range partitioning that splits nodes of any size, are its children;
* a run consists of leaves of ``LEAF`` entries. Each run and leaf keeps the bits that all
  of its entries share;
* two nodes differ in at least the shared bits in which they disagree. That number grows
  from level to level; once it is above ``DISTANCE``, the two are left with all below them.
  Nodes whose entries are all connected already are left as well.

Leaves that remain are compared entry by entry. A run gives links that connect what it
found, never its pairs: fewer than its entries. Runs of one upper node meet by a join on that
node, after the links inside runs are known.

Defined cases: null, empty and blank texts have fingerprint zero and are linked like any
other; with fewer words than a shingle the whole sequence is one; repeated shingles count
as often as they occur; very long texts are read whole, in pieces of ``PIECE`` hashes;
repeated rows are linked; a null doc_id never names a component that has another id; rows
of equal ids are looked at each by itself; empty tables give no rows; extra columns are
not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..session import discard, stored
from .common import spaced_words
from .decontaminate import lowered
from .near_dup import components

#: Words of a shingle, and bits in which linked fingerprints may differ.
SHINGLE, DISTANCE = 3, 3
#: Entries of a run and of a leaf, pairs of leaves compared at once, and hashes counted at once.
CHUNK, LEAF, AT_ONCE, PIECE = 1024, 8, 1 << 14, 1 << 16

RUN = "m int, key long, first long, u long, v long, same long, pattern long, members array<long>"


def hashes(text: Column, k: int = SHINGLE) -> Column:
    """XXH64 (seed 42) of every run of ``k`` words, repeats included; of all words if they are fewer."""
    found = spaced_words(lowered(F.coalesce(text, F.lit(""))))

    def runs(w: Column) -> Column:
        left = F.greatest(F.size(w) - (k - 1), F.lit(0))
        joined = reduce(lambda a, j: F.zip_with(a, F.slice(w, j + 1, left), lambda x, y: F.concat(x, F.lit(" "), y)), range(1, k), F.slice(w, 1, left))
        return F.transform(F.when((F.size(w) > 0) & (F.size(w) < k), F.array(F.array_join(w, " "))).otherwise(joined), lambda x: F.xxhash64(x))

    return F.element_at(F.transform(F.array(found), runs), 1)


def majority(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each list of ``sizes`` 64-bit values, those bits that over half of them have; 0 for none."""
    counts = np.zeros((len(sizes), 64), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    for at in range(0, len(values), PIECE):
        part, of = values[at : at + PIECE], row[at : at + PIECE]
        bits = np.unpackbits(part.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        counts[of[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    return np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little").reshape(-1, 8).copy().view("<i8").ravel()


@F.arrow_udf(LongType())
def fingerprint(lists: pa.Array) -> pa.Array:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    offsets = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    return pa.array(majority(values, np.diff(offsets)))


def masks(distance: int = DISTANCE, bits: int = 64) -> list[int]:
    """Masks of which two fingerprints that differ in ``distance`` bits at most agree under one, as signed numbers."""
    n = distance + 1
    cut = lambda places: [places[len(places) * i // n : len(places) * (i + 1) // n] for i in range(n)]
    out = []
    for block in cut(range(bits)):
        for part in cut([i for i in range(bits) if i not in block]):
            mask = sum(1 << i for i in (*block, *part))
            out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def gray_rank(x: Column) -> Column:
    """The place of a fingerprint among all in Gray order, as a number whose signed order is that of places."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, s))
    return x.bitwiseXOR(F.lit(-(1 << 63)))


def at_rank(rank: np.ndarray) -> np.ndarray:
    """The fingerprint of each ``gray_rank``."""
    r = rank.view(np.uint64) ^ np.uint64(1 << 63)
    return (r ^ (r >> np.uint64(1))).view(np.int64)


def _united(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` (the least connected place of each place) after places ``a`` and ``b`` are connected."""
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (further := root[root]).tobytes() != root.tobytes():
            root = further
    return root


def _shared(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each stretch of ``values`` the mask of bits that all share, and these bits."""
    every, some = np.bitwise_and.reduceat(values, first), np.bitwise_or.reduceat(values, first)
    same = ~(every ^ some)
    return same, every & same


def connected(values: np.ndarray, run: np.ndarray, side: np.ndarray | None = None, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Values and the values that they are connected to, from those of a run that differ in ``distance`` bits at most.

    ``values`` stand in order of ``run``, and of ``side`` within it; with sides only values of
    different sides are compared.
    """
    n = len(values)
    if not n:
        return values, values
    side = np.zeros(n, np.int8) if side is None else side
    begins = np.append(True, (run[1:] != run[:-1]) | (side[1:] != side[:-1]))
    stretch = np.cumsum(begins) - 1
    place = np.arange(n) - np.flatnonzero(begins)[stretch]
    first = np.flatnonzero(place % LEAF == 0)
    size = np.diff(np.append(first, n))
    bits = values.view(np.uint64)  # numpy counts the bits of a signed number's absolute value
    same, pattern = _shared(bits, first)
    leaf_run, leaf_side = run[first], side[first]
    begin = np.flatnonzero(np.append(True, leaf_run[1:] != leaf_run[:-1]))
    root, two_sides = np.arange(n), bool(side.any())
    steps = np.arange(LEAF)
    for d in range(int(np.diff(np.append(begin, len(first))).max())):
        i = np.arange(len(first) - d)
        here = leaf_run[i] == leaf_run[i + d]
        if two_sides:
            here &= leaf_side[i] != leaf_side[i + d]
        i = i[here]
        j = i + d
        i = i[np.bitwise_count((pattern[i] ^ pattern[j]) & same[i] & same[j]) <= distance]
        low, high = np.minimum.reduceat(root, first), np.maximum.reduceat(root, first)
        joined = (low == high)[i] & (low == high)[i + d] & (low[i] == low[i + d])
        i = i[~joined]
        for at in range(0, len(i), AT_ONCE):
            x = i[at : at + AT_ONCE]
            y = x + d
            a = np.broadcast_to((first[x][:, None] + steps)[:, :, None], (len(x), LEAF, LEAF))
            b = np.broadcast_to((first[y][:, None] + steps)[:, None, :], (len(x), LEAF, LEAF))
            there = (steps[:, None] < size[x][:, None, None]) & (steps < size[y][:, None, None]) & (a < b)
            a, b = a[there], b[there]
            near = np.bitwise_count(bits[a] ^ bits[b]) <= distance
            root = _united(root, a[near], b[near])
    moved = np.flatnonzero(root != np.arange(n))
    return values[moved], values[root[moved]]


def _table(m: np.ndarray, key: np.ndarray, first: np.ndarray, members: list, links: tuple[np.ndarray, np.ndarray], shared: tuple) -> pa.Table:
    """Rows of runs, and rows of links, in the columns of ``RUN``."""
    n, k, kinds = len(m), len(links[0]), (pa.int32(), *[pa.int64()] * 6, pa.list_(pa.int64()))
    blank = lambda count, kind: pa.nulls(count, kind)
    runs = [pa.array(m, kinds[0]), pa.array(key), pa.array(first), blank(n, kinds[3]), blank(n, kinds[4]), pa.array(shared[0]), pa.array(shared[1]), pa.array(members, kinds[7])]
    found = [blank(k, kinds[0]), blank(k, kinds[1]), blank(k, kinds[2]), pa.array(links[0]), pa.array(links[1]), blank(k, kinds[5]), blank(k, kinds[6]), blank(k, kinds[7])]
    names = [x.split()[0] for x in RUN.split(", ")]
    return pa.table([pa.chunked_array([a, b], kind) for a, b, kind in zip(runs, found, kinds, strict=True)], names=names)


def cut_runs(batches: Iterator[pa.RecordBatch], chunk: int, distance: int) -> Iterator[pa.RecordBatch]:
    """Links inside the runs of sorted entries (m, key, g), and the runs whose upper node may have others.

    These are the runs of nodes that are longer than a run, and of the first and the last
    node of the partition. At most a batch and a run are held.
    """
    kept = tuple(np.zeros(0, kind) for kind in (np.int32, np.int64, np.int64, np.bool_))
    begun = False

    def runs(m: np.ndarray, key: np.ndarray, g: np.ndarray, part: np.ndarray, last: bool) -> pa.Table:
        """``part``: the entry's node has entries before these, or is the partition's first; ``last``: no more comes."""
        begins = np.append(True, (m[1:] != m[:-1]) | (key[1:] != key[:-1]))
        node = np.cumsum(begins) - 1
        starts = np.flatnonzero(begins)
        place = np.arange(len(m)) - starts[node]
        first = np.flatnonzero(place % chunk == 0)
        run = np.cumsum(place % chunk == 0) - 1
        size = np.diff(np.append(first, len(m)))
        long = np.diff(np.append(starts, len(m))) > chunk
        open_node = long | part[starts]
        if last:
            open_node[-1] = True
        is_open = open_node[node[first]]
        values = at_rank(g)
        several = (size > 1)[run]
        links = connected(values[several], run[several], None, distance)
        same, pattern = _shared(values, first)
        members = np.split(values, first[1:])
        o = np.flatnonzero(is_open)
        return _table(m[first[o]], key[first[o]], g[first[o]], [members[x] for x in o], links, (same[o], pattern[o]))

    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        part = np.zeros(len(now[0]), np.bool_)
        m, key, g, part = (np.concatenate(x) for x in zip(kept, (*now, part), strict=True))
        if not begun:
            part[(m == m[0]) & (key == key[0])] = True
            begun = True
        # the last node may go on: its whole runs are given out, the rest is kept
        start = int(np.flatnonzero(np.append(True, (m[1:] != m[:-1]) | (key[1:] != key[:-1])))[-1])
        whole = start + (len(m) - start - 1) // chunk * chunk
        if whole > start:
            part[start:] = True
        if part[start]:
            part[start:] = True
        kept = (m[whole:], key[whole:], g[whole:], part[whole:])
        if whole:
            yield from runs(m[:whole], key[:whole], g[:whole], part[:whole], False).to_batches()
    if len(kept[0]):
        yield from runs(*kept, True).to_batches()


def _meet(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links between the entries of two runs in each row."""
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1), strict=True):
                x, y = (np.asarray(s.values.to_numpy(zero_copy_only=False)) for s in (a, b))
                side = np.repeat(np.array([0, 1], np.int8), (len(x), len(y)))
                u, v = connected(np.concatenate([x, y]), np.zeros(len(side), np.int8), side, distance)
                if len(u):
                    yield pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])

    return run


def linked(codes: DataFrame, distance: int = DISTANCE, chunk: int = CHUNK) -> DataFrame:
    """Stored ``node, comp`` for every value of ``codes`` (fp, distinct) but the least of its component, which is ``comp``."""
    cuts = masks(distance)
    entries = codes.select("fp", F.posexplode(F.array(*map(F.lit, cuts))).alias("m", "_mask")).select(F.col("m").cast("int").alias("m"), F.col("fp").bitwiseAND(F.col("_mask")).alias("key"), gray_rank(F.col("fp")).alias("g"))
    # entries of one node differ in rank, so that a node of any size is dealt over tasks
    entries = entries.repartitionByRange("m", "key", "g").sortWithinPartitions("m", "key", "g")
    found = stored(entries.mapInArrow(lambda batches: cut_runs(batches, chunk, distance), RUN), "runs")
    inside = found.where("u IS NOT NULL").select("u", "v")
    comps = components(inside)
    runs = found.where("u IS NULL")
    several = runs.groupBy("m", "key").agg(F.count("*").alias("_n")).where("_n > 1").select("m", "key")
    runs = stored(runs.select("m", "key", "first", "same", "pattern", "members").join(several, ["m", "key"]), "several")
    discard(found)
    if not runs.isEmpty():
        each = runs.select("m", "key", "first", F.explode_outer("members").alias("node")).join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        bounds = each.groupBy("m", "key", "first").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        placed = stored(runs.join(bounds, ["m", "key", "first"]), "placed")
        a, b = (placed.select("m", "key", *(F.col(c).alias(x + c) for c in ("first", "same", "pattern", "members", "lo", "hi"))) for x in "ab")
        joined = (F.col("alo") == F.col("ahi")) & (F.col("blo") == F.col("bhi")) & (F.col("alo") == F.col("blo"))
        differ = F.bit_count(F.col("apattern").bitwiseXOR(F.col("bpattern")).bitwiseAND(F.col("asame")).bitwiseAND(F.col("bsame")))
        pairs = a.join(b, ["m", "key"]).where((F.col("afirst") < F.col("bfirst")) & ~joined & (differ <= distance)).select("amembers", "bmembers")
        across = stored(pairs.mapInArrow(_meet(distance), "u long, v long"), "across")
        if not across.isEmpty():
            before, comps = comps, components(comps.select(F.col("node").alias("u"), F.col("comp").alias("v")).unionByName(across))
            discard(before)
        discard(placed, across)
    discard(runs)
    return comps


def groups(docs: DataFrame, k: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``doc_id, fp, component_id`` per row of ``docs`` (doc_id, text); ``fp`` is the fingerprint as a signed number."""
    rows = docs.select("doc_id", hashes(F.col("text"), k).alias("_h")).select("doc_id", fingerprint("_h").alias("fp"))
    rows = stored(rows, "fingerprints")
    codes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "codes")
    comps = linked(codes.select("fp"), distance)
    named = codes.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    least = named.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    names = stored(named.select("fp", "comp").join(least, "comp").select("fp", "component_id"), "names")
    discard(codes, comps)
    return rows.join(names, "fp").select("doc_id", "fp", "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    rows = groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
