"""Word splitting with character offsets, and other text functions.

Splitting stays in the JVM: a pattern whose first alternative is white space cuts a text
into pieces that cover it, so that offsets are running sums of piece lengths. Only these
lengths go through Arrow, and are summed for a whole batch at once. No shuffle.

Offsets are code points; ``utf16_offset`` gives the same place in UTF-16 units.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType


@dataclass(frozen=True)
class Splitter:
    """``pattern`` matches a word; ``flags`` are Java's."""

    name: str
    pattern: str
    flags: str = ""

    @property
    def pieces(self) -> str:
        return f"{self.flags}\\s+|{self.pattern}"

    @property
    def blank(self) -> str:
        return f"{self.flags}^\\s"


#: Word patterns.
_WORD = r"\w+(?:[-_]\w+)*|\S"
_WEB = r"(?:https?://\S+|www\.\S+)|[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}|@[a-z0-9_]+|\w+(?:[-_]\w+)*|\S"
ASCII = Splitter("ascii", _WORD)
UNICODE = Splitter("unicode", _WORD, "(?U)")
WEB = Splitter("web", _WEB, "(?iU)")


@dataclass(frozen=True)
class Preset:
    """How texts of a model family are prepared."""

    splitter: Splitter = ASCII
    lower: bool = False
    period: bool = False


DEFAULT = Preset()
WEB_WORDS = Preset(WEB, lower=True, period=True)


def preset(config: dict, task: str) -> Preset:
    """The preset that a bundle's configuration asks for."""
    if config.get("architecture") == "gliner2dot5":
        return Preset(WEB, config.get("lowercase_words", True), config.get("append_period", True))
    if task == "classification" and config.get("word_splitter") == "whitespace":
        return WEB_WORDS
    return Preset(UNICODE) if str(config.get("architecture", "")).startswith("gliner-") else DEFAULT


#: Lengths that are summed at once: what a batch of texts needs beside itself and its result.
AT_ONCE = 1 << 18


@F.arrow_udf(ArrayType(IntegerType()))
def running_sums(lengths: pa.Array) -> pa.Array:
    """Inclusive running sums within each list."""
    return summed_lists(lengths)


def summed_lists(lengths: pa.Array, at_once: int = AT_ONCE) -> pa.Array:
    """``running_sums``, some lists at a time; a list longer than ``at_once`` is summed alone."""
    lengths = lengths.combine_chunks() if isinstance(lengths, pa.ChunkedArray) else lengths
    offsets = lengths.offsets.to_numpy()
    values = lengths.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    at, first = offsets - offsets[0], 0
    out = np.empty(len(values), np.int32)
    while first < len(at) - 1:
        last = max(int(np.searchsorted(at, at[first] + at_once, "right")) - 1, first + 1)
        a, z, own = at[first], at[last], at[first : last + 1] - at[first]
        sums = np.concatenate([[0], np.cumsum(values[a:z], dtype=np.int64)])
        out[a:z] = sums[1:] - np.repeat(sums[own[:-1]], np.diff(own))
        first = last
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(out))


def let(value: Column, body) -> Column:
    """Bind ``value`` once inside an expression: ``body`` gets it as a column."""
    return F.element_at(F.transform(F.array(value), body), 1)


def prefix_sums(values: Column) -> Column:
    """Sums of the first 0, 1, ... of an array's values.

    Summed in blocks of about the root of their number: an array grows by copying, so that one
    run over a long array would cost its square.
    """
    step = lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x)
    zero = F.array(F.lit(0.0))

    def summed(vs: Column) -> Column:
        n = F.size(vs)
        block = F.ceil(F.sqrt(n)).cast("int")
        numbers = F.sequence(F.lit(0), F.ceil(n / block).cast("int") - 1)
        blocks = F.transform(numbers, lambda b: F.aggregate(F.slice(vs, b * block + 1, block), zero, step))

        def joined(bs: Column) -> Column:
            firsts = F.aggregate(bs, zero, lambda acc, b: F.array_append(acc, F.element_at(acc, -1) + F.element_at(b, -1)))
            whole = lambda fs: F.concat(F.flatten(F.transform(bs, lambda b, k: F.transform(F.slice(b, 1, F.size(b) - 1), lambda x: x + F.get(fs, k)))), F.slice(fs, -1, 1))
            return let(firsts, whole)

        return F.when(n > 0, let(blocks, joined)).otherwise(zero)

    return let(values, summed)


def is_blank(text: Column) -> Column:
    return text.isNull() | text.rlike(r"\A\s*\z")


def with_words(rows: DataFrame, how: Preset = DEFAULT, text: str = "text") -> DataFrame:
    """Adds ``pieces`` (array of strings that make up the text) and ``words``.

    ``words`` is array<struct<w, s, e, p>>: word, character range (end exclusive) and its
    piece's place. A null or blank text has no words.
    """
    own = F.coalesce(F.col(text), F.lit(""))
    rows = rows.withColumn("pieces", F.regexp_extract_all(own, F.lit(how.splitter.pieces), F.lit(0)))
    rows = rows.withColumn("_e", running_sums(F.transform("pieces", lambda x: F.length(x))))
    word = F.lower if how.lower else (lambda x: x)
    made = F.transform("pieces", lambda x, i: F.struct(word(x).alias("w"), (F.get("_e", i) - F.length(x)).alias("s"), F.get("_e", i).alias("e"), i.alias("p"), x.rlike(how.splitter.blank).alias("b")))
    words = F.transform(F.filter(made, lambda x: ~x["b"]), lambda x: F.struct(x["w"], x["s"], x["e"], x["p"]))
    if how.period:
        n = F.length(own)
        ends = F.endswith(own, F.lit(".")) | F.endswith(own, F.lit("!")) | F.endswith(own, F.lit("?"))
        dot = F.array(F.struct(F.lit(".").alias("w"), n.alias("s"), n.alias("e"), F.size("pieces").alias("p")))
        words = F.when((F.size(words) > 0) & ~ends, F.concat(words, dot)).otherwise(words)
    return rows.withColumn("words", words).drop("_e")


def surface(pieces: Column, first: Column, last: Column) -> Column:
    """The text from word ``first`` to word ``last`` (structs of ``words``), without scanning the text."""
    return F.array_join(F.slice(pieces, first["p"] + 1, last["p"] - first["p"] + 1), "")


def stripped(text: Column) -> Column:
    """Without white space at either end, in Unicode's sense."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def semantic(text: Column) -> Column:
    """Lower case, trimmed, white space collapsed."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"\A[\x00-\x20]+|[\x00-\x20]+\z", ""), r"\s+", " ")


def token_set(text: Column) -> Column:
    return F.sort_array(F.array_distinct(F.split(semantic(text), " ")))


def strict_subset(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(a) < F.size(b))


def utf16_offset(text: Column, offset: Column) -> Column:
    """UTF-16 units before a code point offset."""
    before = F.substring(text, F.lit(1), offset)
    return offset + F.length(F.regexp_replace(before, r"[\x{0}-\x{FFFF}]+", ""))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def argmax(values: Column) -> Column:
    """Place of the first largest element; null for an empty array."""
    return F.array_position(values, F.array_max(values)).cast("int") - 1


def softmax(values: Column) -> Column:
    """Softmax of an array, shifted by its largest element."""
    powers = F.transform(values, lambda x: F.exp(x - F.array_max(values)))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda s, y: s + y))
