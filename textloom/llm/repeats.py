"""Exact repeated passages: bytes covered by a LENGTH-byte string that also starts earlier.

Sorting every suffix of a corpus against every other is cut down without losing a match:

1. ``anchors``: in each window of LENGTH bytes the smallest hash of a GRAM-byte gram is its
   anchor. Equal windows have equal anchors at equal places, so only windows whose anchor's
   hash occurs twice can repeat. About one byte in 35 is an anchor; hashes that repeat
   within a batch leave it once, so that a frequent passage isn't a frequent key.
2. For shared anchors, the bytes around (all windows of that anchor) are cut from the texts;
   equal pieces leave a batch once, the others are repeats.
3. Pieces with equal grams meet, and their windows are sorted by deep-shallow sorting:
   vectorised lexsort passes down to ``SHALLOW`` bytes (eight bytes at a time, over all
   windows at once) in place of the multikey quicksort, then a blind trie per remaining group, which looks at one byte
   per branch and compares a string once. Equal windows end in one leaf; all but the first
   in the order of the corpus are repeats.
4. Ranges of repeats meet their text again and are removed.

Texts travel only for rows that a table of at most ``BUCKETS`` hash buckets can't rule out.

Defined cases: a null text is empty; rows are ordered by doc_id (null first), then by a
hash of the text; rows equal in both are one document (each gets its result); texts under
LENGTH bytes have no repeats; empty tables give no rows; extra columns are not used.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

LENGTH, GRAM, SHALLOW = 100, 32, 24
#: Bytes that are hashed at a time, and pieces that are sorted at a time.
UNIT, PIECES = 1 << 20, 20_000
BUCKETS = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and of its inverse, modulo 2**64."""
    size = 1 << max(n, 1024).bit_length()
    if size not in _POWERS:
        _POWERS.clear()
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            both.append(np.cumprod(x, dtype=np.uint64))
        _POWERS[size] = (both[0], both[1])
    return _POWERS[size]


def gram_hashes(data: np.ndarray, k: int = GRAM) -> np.ndarray:
    """Hash of the ``k`` bytes from each place on."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    h = (sums[k:] - sums[:-k]) * down[: len(data) - k + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, k: int = GRAM) -> tuple[np.ndarray, ...]:
    """(hash, place, first window, last window) of every anchor of texts that stand one after another in ``data``."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.view(np.uint64), none, none, none
    h = gram_hashes(data, k)
    value, at, wide = h, np.arange(len(h), dtype=np.int32), 1
    width = length - k + 1
    while wide < width:  # of equal hashes the leftmost
        step = min(wide, width - wide)
        less = value[step:] < value[:-step]
        value, at = np.where(less, value[step:], value[:-step]), np.where(less, at[step:], at[:-step])
        wide += step
    end = np.repeat(ends, np.diff(ends, prepend=0))[: len(at)]
    windows = np.flatnonzero(np.arange(len(at)) + length <= end)
    if not len(windows):
        return none.view(np.uint64), none, none, none
    at = at[windows]
    new = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.append(new[1:], len(at)) - 1
    place = at[new].astype(np.int64)
    return h[place], place, windows[new], windows[last]


class BlindTrie:
    """A trie that keeps only branching bytes; strings of one length. Equal strings share a leaf."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, s: bytes, what: int) -> None:
        if self.root is None:
            self.root = [-1, s, [what]]
            return
        node = self.root
        while node[0] >= 0:  # blindly by branching bytes, to any leaf
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        if node[1] == s:
            node[2].append(what)
            return
        differ = int.from_bytes(node[1], "big") ^ int.from_bytes(s, "big")
        depth = len(s) - (differ.bit_length() + 7) // 8
        above, node = None, self.root
        while 0 <= node[0] < depth:
            above, node = node, node[1][s[node[0]]]
        leaf, other = [-1, s, [what]], node
        if node[0] == depth:
            node[1][s[depth]] = leaf
            return
        while other[0] >= 0:
            other = next(iter(other[1].values()))
        branch = [depth, {other[1][depth]: node, s[depth]: leaf}, None]
        if above is None:
            self.root = branch
        else:
            above[1][s[above[0]]] = branch

    def leaves(self) -> list[list[int]]:
        """What was added, equal strings together, in the order of the strings."""
        out, rest = [], [self.root] if self.root else []
        while rest:
            node = rest.pop()
            if node[0] < 0:
                out.append(node[2])
            else:
                rest += [node[1][b] for b in sorted(node[1], reverse=True)]
        return out


def sorted_windows(data: bytes, at: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW) -> list[np.ndarray | list[int]]:
    """Indices into ``at``, equal windows together, in the order of the windows' bytes."""
    b = np.frombuffer(data, np.uint8)
    order, group = np.arange(len(at)), np.zeros(len(at), np.int64)
    open_ = np.ones(len(at), bool)
    for depth in range(0, shallow, 8):  # each pass splits the groups that are still open
        word = np.zeros(len(at), np.uint64)
        for j in range(8):
            word = (word << np.uint64(8)) | b[at[order] + depth + j].astype(np.uint64) if depth + j < length else word << np.uint64(8)
        again = np.lexsort((word, group))
        order, group, word = order[again], group[again], word[again]
        new = np.append(True, (group[1:] != group[:-1]) | (word[1:] != word[:-1]))
        group = np.cumsum(new)
        open_ = np.append(~new[1:], False) | ~new
        if not open_.any():
            break
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(first, len(order)))
    out: list = []
    for a, n in zip(first.tolist(), size.tolist(), strict=True):
        if n == 1:
            out.append(order[a : a + 1])
            continue
        trie = BlindTrie()
        for i in np.sort(order[a : a + n]).tolist():  # in the order of ``at``
            place = int(at[i])
            trie.add(data[place : place + length], i)
        out += trie.leaves()
    return out


def _packed(start: np.ndarray, back: np.ndarray, more: np.ndarray) -> np.ndarray:
    return (start << 14) | (back << 7) | more


def _units(ends: np.ndarray) -> Iterator[list[tuple[int, int, int]]]:
    """(text, from, to) pieces of at most UNIT bytes together; a longer text is cut, its pieces overlapping by LENGTH - 1."""
    unit, size, begin = [], 0, 0
    for k, end in enumerate(ends.tolist()):
        n, a = end - begin, 0
        while n - a >= LENGTH:
            z = min(n, a + UNIT)
            if unit and size + z - a > UNIT:
                yield unit
                unit, size = [], 0
            unit.append((k, a, z))
            size += z - a
            if z == n:
                break
            a = z - (LENGTH - 1)
        begin = end
    if unit:
        yield unit


FOUND = "kind int, part long, h long, doc_id long, key long, asked array<long>"
_FOUND_NAMES = [c.split()[0] for c in FOUND.split(", ")]


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(values))


def find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: one row for each hash in a batch; 1: one row for each text with those anchors whose hash the batch holds twice."""
    for batch in batches:
        ids, keys = batch.column("doc_id"), batch.column("key").to_numpy(zero_copy_only=False)
        texts = batch.column("bytes")
        ends = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_binary(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        got = []
        for unit in _units(ends[1:] - ends[0]):
            parts = [data[ends[k] + a : ends[k] + z] for k, a, z in unit]
            stops = np.cumsum([len(p) for p in parts])
            h, place, lo, hi = anchors(np.concatenate(parts), stops)
            which = np.searchsorted(stops, lo, "right")
            text = np.array([k for k, _, _ in unit])[which]
            offset = np.array([a for _, a, _ in unit])[which] - np.append(0, stops)[which]
            got.append((h.view(np.int64), text, _packed(lo + offset, place - lo, hi - lo)))
        if not got:
            continue
        h, text, packed = (np.concatenate(x) for x in zip(*got, strict=True))
        _, first, back, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        one = [np.zeros(len(first), np.int32), h[first], h[first]]
        yield pa.RecordBatch.from_arrays([*map(pa.array, one), ids.take(pa.array(text[first])), pa.array(keys[text[first]]), _lists(packed[first], np.ones(len(first), np.int64))], _FOUND_NAMES)
        twice = np.flatnonzero(count[back] > 1)
        if len(twice):
            twice = twice[np.argsort(text[twice], kind="stable")]
            own, sizes = np.unique(text[twice], return_counts=True)
            one = [np.ones(len(own), np.int32), keys[own], np.zeros(len(own), np.int64)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, one), ids.take(pa.array(own)), pa.array(keys[own]), _lists(packed[twice], sizes)], _FOUND_NAMES)


def only_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by kind and h: those of kind 1, and those whose h comes twice. Holds one row back, never a run."""
    names = ["doc_id", "key", "asked"]
    held, held_shared = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        table = table.combine_chunks()
        kind, h = table["kind"].to_numpy(), table["h"].to_numpy()
        same = (h[1:] == h[:-1]) & (kind[1:] == kind[:-1])
        shared = np.append(same, False) | np.append(held_shared, same) | (kind == 1)
        held, held_shared = table.slice(len(h) - 1), bool(shared[-1])
        out = table.select(names).slice(0, len(h) - 1).filter(pa.array(shared[:-1]))
        yield from out.to_batches()
    if held is not None and held_shared:
        yield from held.select(names).to_batches()


CUT = "kind int, part long, g long, doc_id long, key long, start long, end long, bytes binary"
_CUT_NAMES = [c.split()[0] for c in CUT.split(", ")]


def _order(doc_id: int | None, key: int, start: int) -> tuple:
    return (doc_id is not None, doc_id or 0, key, start)


def cut_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: a piece of text around a shared anchor, once per batch; 1: ranges of further equal pieces, which are repeats."""
    for batch in batches:
        best: dict[bytes, tuple] = {}
        ranges: dict[tuple, list] = {}
        for doc_id, key, data, asked in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "bytes", "asked")), strict=True):
            for packed in asked:
                start, back, more = packed >> 14, packed >> 7 & 127, packed & 127
                piece = data[start : start + more + LENGTH]
                mine = (_order(doc_id, key, start), back)
                other = best.setdefault(piece, mine)
                if other is not mine:
                    if mine[0] < other[0]:
                        best[piece], mine = mine, other
                    if mine[0] != best[piece][0]:
                        ranges.setdefault(mine[0][:3], []).append((mine[0][3], mine[0][3] + len(piece)))
        rows = [(0, g := zlib.crc32(p[back : back + GRAM]), g, d if has else None, k, s, s + len(p), p) for p, ((has, d, k, s), back) in best.items()]
        rows += [(1, k ^ s, 0, d if has else None, k, s, z, None) for (has, d, k), own in ranges.items() for s, z in _merged(own)]
        if rows:
            kinds = [pa.int32(), *[pa.int64()] * 6, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], _CUT_NAMES)


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges that touch or overlap, as one."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


RANGES = "doc_id long, key long, start long, end long"


def _repeats(rows: list[tuple]) -> list[tuple]:
    """Ranges of ``rows`` (doc_id, key, start, bytes, gram) whose windows also start earlier in the corpus."""
    rows.sort(key=lambda r: _order(*r[:3]))
    out, seen, pieces = [], {}, []
    for r in rows:
        first = seen.setdefault(r[3], r)
        if first is r:
            pieces.append(r)
        elif first[:3] != r[:3]:
            out.append((*r[:3], r[2] + len(r[3])))
    # equal windows have equal grams, and no two windows of one piece are equal at one anchor
    grams = Counter(r[4] for r in pieces)
    pieces = [r for r in pieces if grams[r[4]] > 1]
    if not pieces:
        return out
    data = b"".join(r[3] for r in pieces)
    n = np.array([len(r[3]) - LENGTH + 1 for r in pieces])
    begin = np.cumsum([0] + [len(r[3]) for r in pieces[:-1]])
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    which = np.repeat(np.arange(len(pieces)), n)
    starts = np.array([r[2] for r in pieces])[which] + inside
    doc = np.cumsum([False] + [a[:2] != b[:2] for a, b in zip(pieces, pieces[1:], strict=False)])[which]
    # windows in the order of the corpus
    order = np.lexsort((starts, doc))
    at = (begin[which] + inside)[order]
    again = np.zeros(len(at), bool)
    for same in sorted_windows(data, at):
        if len(same) > 1:
            own = order[same]
            later = (doc[own] != doc[own[0]]) | (starts[own] != starts[own[0]])
            again[own[later]] = True
    hit = np.flatnonzero(again)
    if len(hit):
        run = np.flatnonzero(np.append(True, (which[hit][1:] != which[hit][:-1]) | (inside[hit][1:] != inside[hit][:-1] + 1)))
        last = np.append(run[1:], len(hit)) - 1
        for a, z in zip(hit[run].tolist(), hit[last].tolist(), strict=True):
            r = pieces[which[a]]
            out.append((r[0], r[1], int(starts[a]), int(starts[z]) + LENGTH))
    return out


def find_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by kind and g: ranges of repeats. Grams that only one piece has were of colliding or overlapping batches."""
    kinds = [pa.int64()] * 4
    names = ["doc_id", "key", "start", "end"]
    rows: list[tuple] = []
    run = None

    def done(found: list[tuple]) -> Iterator[pa.RecordBatch]:
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names)

    for batch in batches:
        kind = batch.column("kind").to_numpy()
        known = batch.filter(pa.array(kind == 1))
        if known.num_rows:
            yield known.select(names)
        for r in zip(*(batch.filter(pa.array(kind == 0)).column(c).to_pylist() for c in ("doc_id", "key", "start", "bytes", "g")), strict=True):
            if r[4] != run and len(rows) >= PIECES:  # a gram's pieces stay together
                yield from done(_repeats(rows))
                rows = []
            run = r[4]
            rows.append(r)
    if rows:
        yield from done(_repeats(rows))


def _bucket() -> Column:
    return F.pmod(F.xxhash64("doc_id", "key"), F.lit(BUCKETS))


def repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, key, start, end``: byte ranges of repeats; they may overlap. ``docs`` has doc_id, key and bytes."""
    found = docs.where(F.length("bytes") >= LENGTH).mapInArrow(find_anchors, FOUND)
    shared = stored(found.repartition("part").sortWithinPartitions("kind", "h").mapInArrow(only_shared, "doc_id long, key long, asked array<long>"), "shared")
    asked = shared.groupBy("doc_id", "key").agg(F.array_distinct(F.flatten(F.collect_list("asked"))).alias("asked"))
    near = F.broadcast(shared.select(_bucket().alias("_b")).distinct())  # BUCKETS rows at most
    pieces = _with(docs.withColumn("_b", _bucket()).join(near, "_b", "left_semi"), asked, "asked", "inner").select("doc_id", "key", "bytes", "asked").mapInArrow(cut_pieces, CUT)
    return pieces.repartition("part").sortWithinPartitions("kind", "g").mapInArrow(find_repeats, RANGES)


def _with(docs: DataFrame, side: DataFrame, column: str, how: str) -> DataFrame:
    """``docs`` joined with ``side`` by document."""
    other = side.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), column)
    return docs.join(other, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), how).drop("_id", "_key")


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _removed(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, data, ranges in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "bytes", "ranges")), strict=True):
                kept, end, spans, gone = [], 0, 0, 0
                for r in sorted((r["start"], r["end"]) for r in ranges):
                    if r[0] > end or not spans:
                        kept.append(data[end : r[0]])
                        spans += 1
                        end = r[0]
                    gone += max(r[1] - end, 0)
                    end = max(end, r[1])
                rest = b"".join([*kept, data[end:]])
                rows.append((doc_id, len(data), gone, spans, hashlib.sha256(rest).hexdigest(), rest if keep_text else None))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in OUT.split(", ")])

    return run


def without_repeats(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` (remaining bytes)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("bytes"))
    rows = rows.withColumn("key", F.xxhash64("bytes"))
    ranges = stored(repeats(rows), "ranges")
    ranges = ranges.groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))
    there = F.broadcast(ranges.select(_bucket().alias("_b")).distinct())  # BUCKETS rows at most
    rows = rows.withColumn("_b", _bucket())
    plain = lambda x: x.select("doc_id", F.length("bytes").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("bytes", 256).alias("kept_sha256"), (F.col("bytes") if keep_text else F.lit(None).cast("binary")).alias("kept"))
    some = _with(rows.join(there, "_b", "left_semi"), ranges, "ranges", "left")
    touched = some.where(F.col("ranges").isNotNull()).select("doc_id", "bytes", "ranges").mapInArrow(_removed(keep_text), OUT)
    return plain(rows.join(there, "_b", "left_anti")).unionByName(plain(some.where(F.col("ranges").isNull()))).unionByName(touched)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return without_repeats(docs, keep_text=False).drop("kept")
