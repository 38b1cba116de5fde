"""Language identification by string kernels.

A text is the set of its blended-spectrum n-grams (1 to 3 bytes of UTF-8, A-Z
lower-cased, hashed into ``CELLS``); the kernel of two texts is the size of the common set
over the geometric mean of the sizes. ``LANDMARKS`` training texts span a Nystroem map,
on which one-versus-rest kernel ridge regression is solved. A batch of texts is scored by
two matrix products: with the landmarks, then with the solved weights.

Every lang value with text to learn from is a class. Fitted on the driver on about
``PER_LANG`` rows of each language, fewer where ``ROWS`` would be passed, one at least; what
is gathered of a row are ``CELLS`` bits, however long its text. Beyond ``LANDMARKS``
languages there are as many landmarks as languages, up to ``MOST_LANDMARKS``.

Defined cases: a text that is null or has no letter is ``und`` with score 0; rows with a
null lang are scored, not learned from; without anything to learn from all is ``und``;
repeated rows are scored alike; of equally likely languages the first by name is given; very
long texts are read whole, in pieces; a null doc_id isn't held out; empty tables give no rows;
extra columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import hinted

CELLS, LANDMARKS, MOST_LANDMARKS, PER_LANG, ROWS = 1 << 14, 256, 1024, 400, 80_000
RIDGE = 1e-2
#: Regression outputs are divided by this before the softmax.
HEAT = 0.15
#: Texts in a matrix, and bytes that are cut into n-grams at a time.
BATCH, PIECE = 128, 1 << 20
#: Rows that are unpacked at a time in the fit.
BLOCK = 1024
UNKNOWN = "und"


def presence(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """float32 matrix texts x CELLS of n-gram presence; ``data`` holds the texts' bytes one after another."""
    out = np.zeros((len(ends), CELLS), np.float32)
    begin = 0
    for row, end in enumerate(ends):
        # a long text in pieces that overlap by two bytes
        for at in range(begin, end, PIECE):
            b = data[at : min(end, at + PIECE + 2)].astype(np.uint32)
            b += 32 * ((b >= 65) & (b <= 90)).astype(np.uint32)
            g = b + 1
            out[row, (g * np.uint32(2654435761)) >> np.uint32(18)] = 1
            for _ in range(2):
                if len(g) < 2:
                    break
                g = g[:-1] * np.uint32(257) + b[len(b) - len(g) + 1 :] + 1
                out[row, (g * np.uint32(2654435761)) >> np.uint32(18)] = 1
        begin = end
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows over the roots of their sizes, so that products are kernels."""
    return rows / np.sqrt(np.maximum(rows.sum(1, keepdims=True), 1))


@dataclass
class Model:
    langs: list[str]
    landmarks: np.ndarray  # CELLS x landmarks
    weights: np.ndarray  # landmarks x languages

    def scores(self, rows: np.ndarray) -> np.ndarray:
        z = (unit(rows) @ self.landmarks) @ self.weights / HEAT
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def _unpacked(bits: np.ndarray) -> np.ndarray:
    return unit(np.unpackbits(bits, axis=1)[:, :CELLS].astype(np.float32))


def fit(rows: np.ndarray, langs: list[str], landmarks: int = LANDMARKS) -> Model | None:
    """``rows`` are packed bits (texts x CELLS / 8); of them only ``BLOCK`` are unpacked at a time, and the landmarks."""
    if not len(rows):
        return None
    names = sorted(set(langs))
    place = {name: c for c, name in enumerate(names)}
    of = np.array([place[x] for x in langs])
    size = np.bincount(of)
    # landmarks take languages in turn
    by_lang = np.argsort(of, kind="stable")
    turn = np.zeros(len(rows), np.int64)
    turn[by_lang] = np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size)
    chosen = np.argsort(turn, kind="stable")[: max(landmarks, min(len(names), MOST_LANDMARKS))]
    base = _unpacked(rows[chosen])
    value, vector = np.linalg.eigh((base @ base.T).astype(np.float64))
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    z = np.concatenate([(_unpacked(rows[a : a + BLOCK]) @ base.T) @ root for a in range(0, len(rows), BLOCK)])
    # every language weighs the same
    w = 1 / size[of]
    zw = z * w[:, None]
    # targets are 1 for the own language and -1 for others: twice a language's sum less the sum of all
    sums = np.add.reduceat(zw[by_lang], np.cumsum(size) - size, axis=0)
    solved = np.linalg.solve(zw.T @ z + RIDGE * np.eye(z.shape[1]) * w.sum() / len(z), (2 * sums - zw.sum(0)).T)
    return Model(names, np.ascontiguousarray(base.T, np.float32), (root @ solved).astype(np.float32))


def _texts(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, ends) for runs of BATCH texts; the buffers are read without decoding."""
    texts = batch.column(column)
    wide = pa.types.is_large_string(texts.type)
    ends = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    for a in range(0, len(texts), BATCH):
        z = min(a + BATCH, len(texts))
        yield a, z, data[ends[a] : ends[z]], ends[a + 1 : z + 1] - ends[a]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame) -> Model | None:
    """Learn from text and non-null lang of rows that aren't held out."""
    h = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    known = docs.where(F.col("lang").isNotNull() & ~held_out() & F.col("text").rlike(r"\p{L}")).select("lang", "text", h.alias("h"))
    counts = stored(known.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least")), "langs")
    langs = counts.count()
    per_lang = min(float(PER_LANG), ROWS / max(langs, 1))
    # the row with the least hash is in, so that no language is without one
    rows = known.join(hinted(counts, langs, 100_000), "lang").where((F.col("h") < F.lit(per_lang) / F.col("n")) | (F.col("h") == F.col("least")))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z, data, ends in _texts(batch, "text"):
                packed = [r.tobytes() for r in np.packbits(presence(data, ends) > 0, axis=1)]
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(a, z - a), pa.array(packed, pa.binary())], ["lang", "bits"])

    got = rows.select("lang", "text").mapInArrow(bits, "lang string, bits binary").dropDuplicates().collect()
    got.sort(key=lambda r: (r["lang"], r["bits"]))
    # sorted bits are no random order: landmarks are the first of each language
    order = np.random.default_rng(0).permutation(len(got))
    packed = np.frombuffer(b"".join(bytes(got[i]["bits"]) for i in order), np.uint8).reshape(len(got), CELLS // 8)
    return fit(packed, [got[i]["lang"] for i in order])


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` per row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z, data, ends in _texts(batch, "_text"):
                letters = batch.column("_letters").slice(a, z - a).to_numpy(zero_copy_only=False)
                names, score = np.full(z - a, UNKNOWN, object), np.zeros(z - a)
                if model is not None and letters.any():
                    p = model.scores(presence(data, ends))
                    names[letters] = np.array(model.langs, object)[p.argmax(1)][letters]
                    score[letters] = p.max(1)[letters]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, z - a), batch.column("held_out").slice(a, z - a), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", held_out().alias("held_out"), text.alias("_text"), text.rlike(r"\p{L}").alias("_letters"))
    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    return identify(docs, train(docs))
