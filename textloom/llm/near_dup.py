"""Near-duplicate groups from bottom-k sketches of one hash function.

A document is the set of its word shingles' 64-bit hashes; its sketch is the K smallest.
Texts with equal sets fall into one class first (told apart by 128 bits), so that a large group
of copies is one row from there on. Inverted lists of keys then propose pairs. A single value is
no key: word pairs are so few that in a large corpus most stand in many unrelated texts.

* a set of up to ``SMALL`` shingles, or one that may be similar to such a set, has as keys all
  twos of its lowest hashes, so many that a similar pair has two of them in common for certain;
* larger sets have bands: their hashes are dealt over bins, some two a bin, by as many hash functions
  as the number of bands asks for, and the minima of ``_band_sizes`` bins together are a key. A bin's minimum
  is the same with the sets' similarity as chance, so that no band is met by one in a million of the
  pairs that are just similar enough, and by fewer of closer ones. Sizes have levels, each with its
  own number of bins; a set that may be similar to one of a lower level has that level's keys too;
* each class is tested against the first class of one of its lists; then all pairs that are
  still apart meet on lists of up to ``SHORT`` classes, while those on longer lists are
  tested against further leaders for as long as that joins many of them. What is left apart
  on long lists meets in blocks, and the full sets decide there. Pairs already connected
  are never formed, so a long list of copies costs its length, not its square.

A union sketch estimates each pair's similarity; those that could pass are verified on the
full sets. Links are joined into components by alternating large and small stars.

Defined cases: texts that are null, empty or blank have no shingles and stand alone; with
fewer words than a shingle the whole sequence is one; very long texts are read whole, their
set being one array; repeated rows are links of each other; a null doc_id never names a
component that has another id; equal ids count as one id; of equally good leaders the one
with the greatest name is tested; empty tables give no rows; extra columns are not used.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..session import discard, stored
from .common import let, spaced_words, text_key
from .decontaminate import lowered

#: Retained values, words of a shingle, and percent of similarity.
K, SHINGLE, PERCENT = 32, 5, 80
#: Share of the pairs that are just similar enough that a bound from sketches may lose.
LOST = 1e-6
#: Shingles of the smaller of two sets up to which they meet for certain; sizes double from level to level above it.
SMALL, LEVELS = 32, 5
#: Hashes that are dealt over bins at once.
AT_ONCE = 1 << 18
#: Members up to which all pairs of a list that are apart are tested at once.
SHORT = 64
#: Leaders that a class on long lists is tested against in a round.
LEADERS = 3
#: Further rounds of leaders while one in so many tests finds a link.
WORTH = 20
#: Classes, and shingles, that meet a member of a large group at once; members that share a task.
BLOCK, BLOCK_SHINGLES, FACED = 48, 1 << 18, 200
#: Rows of the tables that cut down what is joined, and further readings of the texts; a row stands for 64 hash buckets.
MASKS = 1 << 18


def shingle_set(docs: DataFrame, k: int = SHINGLE, text: str = "text") -> DataFrame:
    """Adds ``set``: sorted distinct hashes of the shingles of ``text``."""
    rows = docs.withColumn("_w", F.transform(spaced_words(F.col(text)), lambda w: F.xxhash64(lowered(w)))).withColumn("_s", F.col("_w"))
    for j in range(1, k):
        later = F.slice("_w", j + 1, F.greatest(F.size("_w"), F.lit(0)))
        rows = rows.withColumn("_s", F.zip_with("_s", later, lambda a, b: F.xxhash64(a, b)))
    whole = F.when(F.size("_w") > 0, F.array(F.xxhash64("_w"))).otherwise(F.slice("_w", 1, 0))
    found = F.when(F.size("_w") >= k, F.array_distinct(F.slice("_s", 1, F.size("_w") - (k - 1)))).otherwise(whole)
    return rows.withColumn("set", F.sort_array(found)).drop("_w", "_s")


@functools.cache
def lowest(k: int, percent: int) -> int:
    """What a binomial count of ``k`` at ``percent`` falls short of with a chance of ``LOST`` at most."""
    p, below, c = percent / 100, 0.0, 0
    while c < k and (below := below + math.comb(k, c) * p**c * (1 - p) ** (k - c)) <= LOST:
        c += 1
    return c


@functools.cache
def _band_sizes(percent: int) -> tuple[int, int, int]:
    """Bins of a band, how many of them must not be empty, and how many bands miss a pair that is just similar enough with a chance of ``LOST`` at most."""
    p = min(percent, 99) / 100
    bins = min(max(round(math.log(0.33) / math.log(p)), 1), 8)
    filled, empty = (bins + 1) // 2, math.exp(-2)  # two hashes a bin at least
    enough = sum(math.comb(bins, c) * (1 - empty) ** c * empty ** (bins - c) for c in range(filled, bins + 1))
    return bins, filled, math.ceil(math.log(LOST) / math.log(1 - p**bins * enough))


def _mixed(x: np.ndarray) -> np.ndarray:
    """The last steps of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _level_bands(hashes: np.ndarray, sizes: np.ndarray, level: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the bands of some sets at a level, a row a set, and which of them have too many empty bins."""
    bins, filled, bands = _band_sizes(percent)
    turns = -(-bands // min(bands, (SMALL << level) // (2 * bins)))
    each = -(-bands // turns)
    of, none, keys, weak = np.repeat(np.arange(len(sizes)), sizes), np.uint64(2**64 - 1), [], []
    for turn in range(turns):
        h = _mixed(hashes ^ _mixed(np.array([turn + 1], np.uint64)))
        least = np.full(len(sizes) * each * bins, none)
        np.minimum.at(least, of * (each * bins) + ((h >> np.uint64(32)) * np.uint64(each * bins) >> np.uint64(32)).astype(np.int64), h)
        least = least.reshape(len(sizes), each, bins)
        key = np.full((len(sizes), each), level, np.uint64)
        for b in range(bins):
            key = _mixed(key * np.uint64(31) ^ least[:, :, b])
        keys.append(key)
        weak.append((least != none).sum(axis=2) < filled)
    return (np.concatenate(keys, 1)[:, :bands] >> np.uint64(32)).astype(np.uint32).view(np.int32), np.concatenate(weak, 1)[:, :bands]


def band_lists(sets: pa.Array, percent: int) -> pa.Array:
    """Keys of the bands of each set, level by level; null where too many bins are empty. A set of up to ``SMALL`` has none."""
    sets = sets.combine_chunks() if isinstance(sets, pa.ChunkedArray) else sets
    bands, offsets = _band_sizes(percent)[2], sets.offsets.to_numpy().astype(np.int64)
    values = sets.values.to_numpy(zero_copy_only=False).view(np.uint64)
    sizes = np.diff(offsets)
    own = np.minimum(np.floor(np.log2(np.maximum(sizes, 1) / SMALL)).astype(np.int64), LEVELS - 1)
    asked = [(sizes > SMALL) & ((own == k) | (own > k) & (sizes * percent < 100 * (SMALL << k + 1))) for k in range(LEVELS)]
    at = np.concatenate([[0], np.cumsum(sum(x.astype(np.int64) for x in asked) * bands)])
    keys, weak, place = np.zeros(at[-1], np.int32), np.zeros(at[-1], bool), at[:-1].copy()
    for level, which in enumerate(asked):
        rows = np.flatnonzero(which)
        ends, first = np.cumsum(sizes[rows]), 0
        while first < len(rows):
            last = max(int(np.searchsorted(ends, (ends[first - 1] if first else 0) + AT_ONCE, "right")), first + 1)
            some = rows[first:last]
            hashes = np.concatenate([values[offsets[i] : offsets[i + 1]] for i in some])
            where = place[some][:, None] + np.arange(bands)
            keys[where], weak[where] = _level_bands(hashes, sizes[some], level, percent)
            place[some] += bands
            first = last
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(keys, mask=weak))


def _bands(sets: Column, percent: int) -> Column:
    @F.arrow_udf(ArrayType(IntegerType()))
    def made(own: pa.Array) -> pa.Array:
        return band_lists(own, percent)

    return made(sets)


def _keys(n: Column, sketch: Column, bands: Column, percent: int) -> Column:
    """What a class is looked up by: twos of the lowest hashes of a small set, and bands, with their places, of a large one."""
    # similar sets share so many shingles that two of them are among the lowest of both
    lowest_of = F.slice(sketch, 1, F.least(n, n - F.ceil(n * percent / 100) + 2).cast("int"))
    twos = let(lowest_of, lambda low: F.flatten(F.transform(low, lambda x, i: F.transform(F.slice(low, i + 2, F.size(low)), lambda y: F.xxhash64(x, y)))))
    small = F.when(n * percent <= 100 * SMALL, twos).otherwise(F.array().cast("array<bigint>"))
    placed = F.transform(bands, lambda x, i: F.pmod(i, F.lit(_band_sizes(percent)[2])).cast("bigint") * (1 << 32) + x)
    return F.filter(F.concat(small, placed), lambda x: x.isNotNull())


def similar_sizes(a: Column, b: Column, percent: int = PERCENT) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Stored ``node, comp`` for every node of ``edges`` (u, v) but the least of its component, which is ``comp``."""
    ordered = lambda e: e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, before = stored(ordered(edges), "edges"), None
    for _ in range(rounds):
        both = now.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(now.select(F.col("v").alias("a"), F.col("u").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = stored(ordered(both.where("b > a").join(least, "a").select(F.col("b").alias("u"), F.col("m").alias("v"))), "edges")
        discard(now)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = stored(ordered(small), "edges")
        discard(large)
        seen = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if seen == before:
            out = now.select(F.col("u").alias("node"), F.col("v").alias("comp"))
            out.stored_at = now.stored_at
            return out
        before = seen
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _near(a: Column, b: Column, percent: int) -> Column:
    """Whether the sketch of the union leaves open that two sketched sets are similar enough."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, K)
    least = F.element_at(F.array(*(F.lit(lowest(n, percent)) for n in range(K + 1))), F.size(union) + 1)
    return F.size(F.array_intersect(F.array_intersect(a, b), union)) >= least


def _among(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """``rows`` that share one of 64 * MASKS hash buckets with ``ids`` (one column): a superset, from a table of at most MASKS rows.

    A row of the table is a word of 64 bits, one a bucket: with a bucket a row, the millions of ids of a
    large corpus would be in every bucket, and all texts be taken for theirs.
    """
    word = lambda c: F.pmod(F.xxhash64(c), F.lit(MASKS)).alias("_b")
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(F.lit(2), c), F.lit(64)).cast("int")).alias("_bit")
    near = F.broadcast(ids.toDF("_id").select(word(F.col("_id")), bit(F.col("_id"))).groupBy("_b").agg(F.bit_or("_bit").alias("_bits")))
    own = rows.select("*", word(F.col(column)), bit(F.col(column)))
    return own.join(near, "_b").where(F.col("_bits").bitwiseAND(F.col("_bit")) != 0).drop("_b", "_bit", "_bits")


def _shared(a: str, b: str, percent: int) -> Column:
    """Whether two full sets, given by expressions, are similar enough, from one intersection."""
    return F.expr(f"{100 + percent} * size(array_intersect({a}, {b})) >= {percent} * (size({a}) + size({b}))")


def _sets(wanted: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """``name, set`` of the classes in ``wanted`` (name, first_id) and of some others, from another reading of the texts."""
    again = shingle_set(_among(texts, wanted.select("first_id"), "doc_id"), k).select(_name(F.col("set")).alias("name"), "set")
    # no filter by name before the shuffle: the optimizer would make all sets of the corpus anew for it
    return again.groupBy("name").agg(F.first("set").alias("set"))


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough, as stored edges (u, v).

    Union sketches decide first; only classes of pairs that pass have their full sets made,
    from another reading of the texts.
    """
    pairs = stored(pairs, "pairs")
    either = lambda p: p.select("a").unionByName(p.select(F.col("b").alias("a"))).distinct()
    sketches = _among(classes, either(pairs), "node").select("node", "name", "sketch")
    sides = [sketches.select(F.col("node").alias(x), F.col("name").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab"]
    close = stored(pairs.join(sides[0], "a").join(sides[1], "b").where(_near(F.col("sa"), F.col("sb"), percent)).select("a", "b", "na", "nb"), "close")
    wanted = stored(classes.select("node", "name", "first_id").join(either(close).withColumnRenamed("a", "node"), "node", "left_semi"), "wanted")
    sets = _sets(wanted, texts, k)
    full = [sets.select(F.col("name").alias(f"n{x}"), F.col("set").alias(f"f{x}")) for x in "ab"]
    out = close.join(full[0], "na").join(full[1], "nb").where(_shared("fa", "fb", percent)).select(F.col("a").alias("u"), F.col("b").alias("v"))
    out = stored(out, "links")
    discard(pairs, close, wanted)
    return out


def _name(s: Column) -> Column:
    """128 bits that stand for a set."""
    return F.struct(F.xxhash64(s).alias("a"), F.xxhash64(F.lit(1), s).alias("b"))


def _lists(classes: DataFrame, percent: int) -> DataFrame:
    """Stored ``value, node, n``: inverted lists of keys that several classes have."""
    keys = _keys(F.col("n"), F.col("sketch"), F.col("bands"), percent)
    # the outer form keeps the optimizer from computing the array twice for a filter on its size
    looked = classes.select(F.explode_outer(keys).alias("value"), "node", "n").where("value IS NOT NULL")
    # one shuffle; the rows of a long list can be spilled
    counted = looked.withColumn("_c", F.count("*").over(W.partitionBy("value")))
    return stored(counted.where("_c > 1").select("value", "node", "n"), "lists")


def _led(at: DataFrame, order: Column, most: int, percent: int) -> DataFrame:
    """Each class and up to ``most`` leaders of its lists, those met on most of them, that it is apart from."""
    lead = at.groupBy("value").agg(F.min_by(F.struct("node", "n", "comp"), order).alias("b"), F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo <> _hi")
    met = at.join(lead.select("value", "b"), "value").where((F.col("comp") != F.col("b.comp")) & similar_sizes(F.col("n"), F.col("b.n"), percent))
    met = met.groupBy(F.col("node").alias("a"), F.col("b.node").alias("b")).agg(F.count("*").alias("c"))
    best = met.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct("c", "b")), asc=False), 1, most).alias("best"))
    return best.select("a", F.explode("best.b").alias("b"))


def _apart(short: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of lists that are apart."""
    left, right = (short.select("value", *(F.col(c).alias(x + c) for c in ("node", "n", "comp"))) for x in "ab")
    new = (F.col("anode") < F.col("bnode")) & (F.col("acomp") != F.col("bcomp")) & similar_sizes(F.col("an"), F.col("bn"), percent)
    return left.join(right, "value").where(new).select(F.col("anode").alias("a"), F.col("bnode").alias("b")).distinct()


def _rest(at: DataFrame, long: DataFrame, classes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Stored links (u, v) that join what is apart on long lists, and is linked, into the components that all links make.

    Lists are put together by their largest component. Classes outside it are asked: in
    blocks they meet all classes of those lists, and full sets decide within the row. A large
    group is dealt over tasks as a grid of salts and shares of the blocks, so that a copy is made for the side of the
    grid and not for each task. Of the links of a class with a block's members the first
    is kept, and each member it has is linked with the next; such neighbours are few for a block,
    so that what comes out grows with the group, not with its links.
    """
    most = at.join(long, "value").groupBy("value", "comp").agg(F.count("*").alias("_c"))
    most = most.groupBy("value").agg(F.max_by("comp", F.struct("_c", "comp")).alias("most"))
    there = stored(at.join(most, "value").groupBy("most", "node").agg(F.first("n").alias("n"), F.first("comp").alias("comp")), "there")
    wanted = stored(classes.select("node", "name", "first_id").join(there.select("node").distinct(), "node", "left_semi"), "wanted")
    sets = stored(_sets(wanted, texts, k).join(wanted.select("name", "node"), "name").select("node", "set"), "sets")
    asked = F.col("comp") != F.col("most")
    # a stated number: by their bytes, which are few, salts would be put together in one task
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = F.least(F.ceil(F.count("*") / FACED), F.lit(parts))
    size = there.groupBy("most").agg(
        F.ceil(F.greatest(F.count_if(asked) / BLOCK, F.sum(F.when(asked, F.col("n"))) / BLOCK_SHINGLES)).alias("blocks"),
        F.ceil(F.sqrt(tasks)).cast("int").alias("salts"),
    )
    dealt = lambda parts: F.pmod(F.xxhash64("node"), F.col(parts))
    full = there.join(size, "most").join(sets, "node")
    blocks = full.where(asked).groupBy("most", dealt("blocks").alias("_k"), "salts").agg(F.sort_array(F.collect_list(F.struct("node", "n", "comp", "set"))).alias("block"))
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias(name)
    blocks = blocks.select("most", F.pmod("_k", "salts").cast("int").alias("_share"), "block", every("_salt"))
    faced = full.select("most", "node", "n", "comp", "set", dealt("salts").cast("int").alias("_salt"), every("_share"))
    # of two asked classes the first by name is the one in the block
    hit = f"q.comp <> comp AND 100 * least(q.n, n) >= {percent} * greatest(q.n, n) AND (comp = most OR q.node < node)"
    same = f"{100 + percent} * size(array_intersect(q.set, set)) >= {percent} * (q.n + n)"
    hits = F.expr(f"transform(filter(block, q -> {hit} AND {same}), q -> q.node)")
    faced, blocks = (x.repartition(parts, "most", "_salt", "_share") for x in (faced, blocks))
    # stored before it is cut down: a filter on the number of hits would go into the join, and all pairs be tested twice
    met = stored(faced.join(blocks, ["most", "_salt", "_share"]).select(F.col("node").alias("u"), hits.alias("hits")), "hits")
    found = met.where(F.size("hits") > 0)
    next_of = F.transform(F.slice("hits", F.lit(2), F.size("hits")), lambda v, i: F.struct(F.get("hits", i).alias("u"), v.alias("v")))
    chains = found.select(F.explode_outer(next_of).alias("x")).where("x IS NOT NULL").select("x.u", "x.v").distinct()
    out = stored(found.select("u", F.col("hits")[0].alias("v")).unionByName(chains), "links")
    discard(there, wanted, sets, met)
    return out


def groups(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, key, n_shingles, component_id, component_key`` per row of ``docs`` (doc_id, text).

    ``key`` is the row's ``text_key``, ``component_key`` that of the component's first row by
    (doc_id, key), null doc_ids last: it tells rows apart where ids repeat or are null.
    """
    texts = docs.select("doc_id", "text")
    rows = shingle_set(texts, k).withColumn("n", F.size("set"))
    rows = stored(rows.select("doc_id", text_key().alias("key"), "n", F.when(F.col("n") > 0, _name(F.col("set"))).alias("name"), F.slice("set", 1, K).alias("sketch"), _bands(F.col("set"), percent).alias("bands")), "sketches")
    first_row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    classes = rows.where("n > 0").groupBy("name").agg(F.first("n").alias("n"), F.min("doc_id").alias("first_id"), first_row.alias("first_row"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
    # numbers are short and differ; once written, they stay
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    lists = _lists(classes, percent)

    verified = lambda pairs: _verified(pairs, classes, texts, k, percent)
    as_edges = lambda comps: comps.select(F.col("node").alias("u"), F.col("comp").alias("v"))

    def placed(comps: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Lists with components, and the sizes of those on which several stand."""
        at = stored(lists.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "placed")
        sizes = at.groupBy("value").agg(F.count("*").alias("size"), F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo <> _hi")
        return at, stored(sizes.select("value", "size"), "sizes")

    # each class and one leader
    links = verified(_led(lists.withColumn("comp", F.col("node")), F.col("node"), 1, percent))
    comps = components(links)
    # all pairs of short lists, and leaders of long ones
    at, sizes = placed(comps)
    short = at.join(sizes.where(F.col("size") <= SHORT).select("value"), "value")
    turn = 0
    tests = _apart(short, percent)
    while True:
        long = sizes.where(F.col("size") > SHORT).select("value")
        led = stored(_led(at.join(long, "value"), F.xxhash64("node", F.lit(turn)), LEADERS, percent), "led")
        links = verified((led if tests is None else tests.unionByName(led)).distinct())
        found = links.join(led.select(F.col("a").alias("u"), F.col("b").alias("v")), ["u", "v"], "left_semi").count()
        asked = led.count()
        if not links.isEmpty():
            comps = components(as_edges(comps).unionByName(links))
            discard(at, sizes)
            at, sizes = placed(comps)
        discard(led, links)
        if found * WORTH <= asked:
            break
        tests, turn = None, turn + 1
    # what is still apart on long lists
    long = sizes.where(F.col("size") > SHORT).select("value")
    if not long.isEmpty():
        links = _rest(at, long, classes, texts, k, percent)
        if not links.isEmpty():
            comps = components(as_edges(comps).unionByName(links))
    discard(at, sizes, lists)

    # names: the smallest doc_id of each component
    named_classes = classes.join(comps, "node", "left").select("name", "first_id", "first_row", F.coalesce("comp", "node").alias("comp"))
    least = named_classes.groupBy("comp").agg(F.min("first_id").alias("component_id"), F.min("first_row")["key"].alias("component_key"))
    ids = stored(named_classes.select("name", "comp").join(least, "comp").select("name", "component_id", "component_key"), "names")
    discard(classes)
    out = rows.join(ids, "name", "left")
    named = lambda c, own: F.when(F.col("n") > 0, F.col(c)).otherwise(F.col(own)).alias(c)
    return out.select("doc_id", "key", F.col("n").cast("long").alias("n_shingles"), named("component_id", "doc_id"), named("component_key", "key"))


def kept(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: one id of each component is kept."""
    rows = groups(docs, k, percent).select("doc_id", "n_shingles", "component_id")
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def query(spark, sf_dir: str) -> DataFrame:
    return kept(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), k=2)


def sql(docs: str = "documents", k: int = 2) -> str:
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM {docs}),
l AS (SELECT doc_id, CASE WHEN len(words) >= {k} THEN list_distinct(list_transform(range(1, len(words) - {k} + 2), lambda i: array_to_string(words[i:i + {k} - 1], ' ')))
  WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE []::VARCHAR[] END AS s FROM d),
s AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM l),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
e AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (na + nb - c)),
g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, g.b FROM r JOIN g ON r.b = g.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM l JOIN c USING (doc_id)
"""
