"""What a user calls: a table of texts and a question go in, the table with answers comes out.

Every function keeps the columns of its input and adds its own. Nothing is run until the
result is read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.text import DEFAULT, Preset, is_blank, with_words
from .operators import decide as D
from .operators import extraction as E
from .operators.schema import Family, Label, Question, Relation, Schema, Structure
from .operators.scorer import HashScorer, Scorer
from .streaming import sessions as Z

#: Used where no other is given.
THRESHOLD, WIDTH = 0.5, 12


def extract(rows: DataFrame, schema: Schema, scorer: Scorer | None = None, threshold: float = THRESHOLD, width: int = WIDTH, how: Preset = DEFAULT, text: str = "text") -> DataFrame:
    """Adds ``entities``, ``relations`` and ``structures``: all that ``schema`` asks for, in one pass over each text's spans."""
    worded = with_words(rows, how, text)
    return E.extracted(worded, schema, scorer or HashScorer(), threshold, width, text).drop("pieces", "words")


def extract_entities(rows: DataFrame, labels: Sequence[str | Label], scorer: Scorer | None = None, **more) -> DataFrame:
    """Adds ``entities``: map label -> spans (text, offsets, probability), of labels that were found."""
    return extract(rows, Schema(entities=_labels(labels)), scorer, **more).drop("relations", "structures")


def extract_relations(rows: DataFrame, relations: Sequence[str | Relation], scorer: Scorer | None = None, **more) -> DataFrame:
    """Adds ``relations``: map name -> complete instances with their least probability."""
    asked = tuple(Relation(r) if isinstance(r, str) else r for r in relations)
    return extract(rows, Schema(relations=asked), scorer, **more).drop("entities", "structures")


def extract_structures(rows: DataFrame, structures: Sequence[Structure], scorer: Scorer | None = None, **more) -> DataFrame:
    """Adds ``structures``: map name -> instances, each a map field -> spans."""
    return extract(rows, Schema(structures=tuple(structures)), scorer, **more).drop("entities", "relations")


def classify(rows: DataFrame, labels: Sequence[str | Label], scorer: Scorer | None = None, threshold: float = THRESHOLD, single: bool = False, text: str = "text") -> DataFrame:
    """Adds ``classes``: array of (label, p), most probable first. Every label whose probability reaches the
    threshold, or with ``single`` all labels with shares of 1; empty for blank texts and without labels."""
    raw = D.logits(F.col(text), [x.name for x in _labels(labels)], scorer or HashScorer())
    found = D.single_label(raw) if single else D.multi_label(raw, threshold)
    return rows.withColumn("classes", F.when(is_blank(F.col(text)), F.slice(found, 1, 0)).otherwise(found))


def route(rows: DataFrame, families: Sequence[Family], scorer: Scorer | None = None, text: str = "text") -> DataFrame:
    """Adds ``routes``: per family its best label, or all of them."""
    return D.route(rows, list(families), scorer or HashScorer(), text)


def decide(rows: DataFrame, questions: Sequence[Question], scorer: Scorer | None = None, text: str = "text") -> DataFrame:
    """Adds ``decisions``: the options of every question with their probabilities; empty for blank texts."""
    if len({q.id for q in questions}) < len(questions):
        raise ValueError("two questions have the same id")
    return D.decide(rows, list(questions), scorer or HashScorer(), text)


def sessions(chunks: DataFrame, labels: Sequence[str], threshold: float = THRESHOLD, **more) -> DataFrame:
    """The entities of each session after each of its chunks (session_id, seq, chunk), for a stream or a table."""
    return (Z.stream if chunks.isStreaming else Z.replay)(chunks, tuple(labels), threshold, **more)


def _labels(labels: Sequence[str | Label]) -> tuple[Label, ...]:
    return tuple(Label(x) if isinstance(x, str) else x for x in labels)
