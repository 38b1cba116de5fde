"""Scorers: the stage that a model fills.

A scorer says how likely a piece of text is of a label. ``HashScorer`` is an expression,
needs no model and gives every engine the same numbers, which is what tests need;
``RuleScorer`` scores by patterns. Scorers of families and engines are registered by whoever
has them; asking for a task that a family lacks, or for a family that nobody registered, raises
on the driver, before anything is planned.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class Scorer(Protocol):
    def score(self, label: Column, surface: Column) -> Column:
        """Probability as a double."""


def reaches(scorer: Scorer, label: Column, surface: Column, threshold) -> Column:
    """Whether a score is ``threshold`` at least; a scorer with a cheaper way to tell has a method ``reaches``."""
    own = getattr(scorer, "reaches", None)
    return own(label, surface, threshold) if own else scorer.score(label, surface) >= threshold


@dataclass(frozen=True)
class HashScorer:
    """The leading 24 bits of md5(label|surface) as a share of 1."""

    def score(self, label: Column, surface: Column) -> Column:
        head = F.substring(F.md5(F.concat(label, F.lit("|"), surface)), 1, 6)
        return F.conv(head, 16, 10).cast("long") / F.lit(16777215.0)

    def reaches(self, label: Column, surface: Column, threshold) -> Column:
        """By the order of hexadecimal digits: the number is made only of what reaches the threshold."""
        if isinstance(threshold, Column):
            return self.score(label, surface) >= threshold
        least = min(max(math.floor(threshold * 16777215) - 1, 0), 1 << 24)
        while least <= 16777215 and least / 16777215.0 < threshold:
            least += 1
        digest = F.md5(F.concat(label, F.lit("|"), surface))
        return digest >= F.lit(f"{least:06x}" if least <= 16777215 else "g")


    def many(self, label: str, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Scores of the pieces ``starts`` to ``ends`` of ``data`` (UTF-8 bytes)."""
        head, out = f"{label}|".encode(), np.empty(len(starts), np.int64)
        data = np.concatenate([data, np.zeros(64, np.uint8)])
        short = ends - starts + len(head) <= 55  # one block
        at = np.flatnonzero(short)
        for i in range(0, len(at), BLOCKS):
            some = at[i : i + BLOCKS]
            out[some] = _leading_bits(head, data, starts[some], ends[some])
        for i in np.flatnonzero(~short):
            out[i] = int.from_bytes(hashlib.md5(head + data[starts[i] : ends[i]].tobytes(), usedforsecurity=False).digest()[:3], "big")
        return out / 16777215.0


#: Pieces that are hashed at once: their numbers stay in a core's cache.
BLOCKS = 1 << 13
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_PLACES = [[i for i in range(16)], [(5 * i + 1) % 16 for i in range(16)], [(3 * i + 5) % 16 for i in range(16)], [(7 * i) % 16 for i in range(16)]]


def _leading_bits(head: bytes, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first 24 bits of md5(head + piece), for pieces that fit one block with it."""
    sizes = (ends - starts).astype(np.uint8)
    most, block = int(sizes.max()) if len(sizes) else 0, np.zeros((len(starts), 64), np.uint8)
    block[:, : len(head)] = np.frombuffer(head, np.uint8)
    # ``data`` goes on for a block after its last piece
    rows = np.lib.stride_tricks.sliding_window_view(data, max(most, 1))[starts][:, :most]
    np.multiply(rows, np.arange(most, dtype=np.uint8) < sizes[:, None], out=block[:, len(head) : len(head) + most])
    block[np.arange(len(starts)), len(head) + sizes.astype(np.int64)] = 0x80
    words = np.ascontiguousarray(block.view("<u4").T)
    words[14] = 8 * (len(head) + sizes.astype(np.uint32))
    a, b, c, d = (np.full(len(starts), x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    f, g = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        turn = i // 16
        if turn == 0:  # d ^ (b & (c ^ d))
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif turn == 1:  # c ^ (d & (b ^ c))
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif turn == 2:  # b ^ c ^ d
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:  # c ^ (b | ~d)
            np.bitwise_not(d, out=f)
            f |= b
            f ^= c
        f += a
        f += words[_PLACES[turn][i % 16]]
        f += np.uint32(_SINES[i])
        by = _TURNS[turn][i % 4]
        np.right_shift(f, np.uint32(32 - by), out=g)
        f <<= np.uint32(by)
        f |= g
        f += b
        a, b, c, d, f = d, f, b, c, a
    first = (a + np.uint32(0x67452301)).astype(np.int64)
    return (first & 255) << 16 | (first >> 8 & 255) << 8 | first >> 16 & 255


@dataclass(frozen=True)
class RuleScorer:
    """label -> pattern; 1 where the whole surface matches, else 0."""

    rules: tuple[tuple[str, str], ...]

    def score(self, label: Column, surface: Column) -> Column:
        out = F.lit(0.0)
        for name, pattern in self.rules:
            out = F.when((label == name) & surface.rlike(rf"\A(?:{pattern})\z"), 1.0).otherwise(out)
        return out


#: family -> tasks. Fixed values.
SUPPORTS = {
    "gliner2": {"ner", "classification", "relation", "structure", "decide"},
    "gliner2dot5": {"ner", "classification", "relation", "decide"},
    "gliclass": {"classification"},
    "gliner-uni": {"ner"},
    "gliner-bi": {"ner"},
    "gliclass-decoder-kv": {"classification", "streaming"},
    "gliner-streaming-span": {"ner", "streaming"},
    "gliner-decoder": set(),
}
#: family -> engine used unless a bundle names one.
ENGINES = {f: "onnx" for f in SUPPORTS} | {"gliclass-decoder-kv": "llamacpp", "gliner-streaming-span": "llamacpp"}
KNOWN_ENGINES = ("onnx", "llamacpp")

_registry: dict[tuple[str, str], Callable[..., Scorer]] = {}


def register(family: str, engine: str, make: Callable[..., Scorer]) -> None:
    """A later registration replaces an earlier one."""
    _registry[family, engine] = make


def family_of(config: dict) -> str:
    """An absent or unknown architecture is the first family."""
    name = str(config.get("architecture", "")).lower()
    return name if name in SUPPORTS else "gliner2"


def engine_of(config: dict) -> str:
    name = config.get("engine")
    if name is None:
        return ENGINES[family_of(config)]
    if str(name).lower() not in KNOWN_ENGINES:
        raise ValueError(f"unknown engine {name!r}; known: {', '.join(KNOWN_ENGINES)}")
    return str(name).lower()


def scorer_for(config: dict, task: str) -> Scorer:
    family, engine = family_of(config), engine_of(config)
    if task not in SUPPORTS[family]:
        raise NotImplementedError(f"{family} has no task {task}")
    if (family, engine) not in _registry:
        raise LookupError(f"no scorer is registered for {family} on {engine}")
    return _registry[family, engine](config)
