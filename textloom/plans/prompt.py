"""Prompts as token lists, built once on the driver; what a text costs in tokens."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..operators.schema import Label, Relation, Schema, Structure

#: Markers of schema prompts. Fixed values.
ENTITY, CLASS, RELATION, STRUCTURE = "[E]", "[L]", "[R]", "[C]"
PROMPT, DESCRIPTION, SEP_STRUCT, SEP_TEXT = "[P]", "[DESCRIPTION]", "[SEP_STRUCT]", "[SEP_TEXT]"


@dataclass(frozen=True)
class Unit:
    """One question to a model: a parent word, a marker and its children with descriptions."""

    parent: str
    marker: str
    children: tuple[str, ...]
    descriptions: tuple[str | None, ...] = field(default=())

    def tokens(self) -> list[str]:
        given = self.descriptions or (None,) * len(self.children)
        if len(given) != len(self.children):
            raise ValueError(f"{len(self.children)} names but {len(given)} descriptions")
        told = [t for n, d in zip(self.children, given, strict=True) if d and d.strip() for t in (DESCRIPTION, f"{n}:", d)]
        marked = [t for n in self.children for t in (self.marker, n)]
        return ["(", PROMPT, self.parent, *told, "(", *marked, ")", ")"]


def entity_unit(labels: tuple[Label, ...]) -> Unit:
    return Unit("entities", ENTITY, tuple(x.name for x in labels), tuple(x.description for x in labels))


def class_unit(task: str, labels: tuple[Label, ...]) -> Unit:
    return Unit(task, CLASS, tuple(x.name for x in labels), tuple(x.description for x in labels))


def relation_unit(relation: Relation) -> Unit:
    """The relation's description goes with its first field."""
    return Unit(relation.name, RELATION, relation.fields, (relation.description, *[None] * (len(relation.fields) - 1)))


def structure_unit(structure: Structure) -> Unit:
    return Unit(structure.name, STRUCTURE, tuple(f.name for f in structure.fields), tuple(f.description for f in structure.fields))


def units(schema: Schema) -> list[Unit]:
    """Entities first, then relations; classifications have no place beside these."""
    if schema.classifications:
        raise NotImplementedError("classifications aren't extracted together with spans")
    out = [entity_unit(schema.entities)] if schema.entities else []
    return out + [relation_unit(r) for r in schema.relations] + [structure_unit(s) for s in schema.structures]


def assemble(parts: list[Unit]) -> tuple[list[str], list[list[int]]]:
    """(prefix tokens up to the text, places of each unit's markers)."""
    if not parts:
        raise ValueError("a prompt needs a unit")
    tokens: list[str] = []
    places = []
    for n, unit in enumerate(parts):
        if n:
            tokens.append(SEP_STRUCT)
        own = unit.tokens()
        start = len(own) - 2 - 2 * len(unit.children)
        places.append([len(tokens) + start + 2 * i for i in range(len(unit.children))])
        tokens += own
    return [*tokens, SEP_TEXT], places


def entity_prompt(labels: list[str]) -> list[str]:
    """Uni-encoder prompt up to the words; ``[SEP]`` follows them."""
    return ["[CLS]", *[t for x in labels for t in ("<<ENT>>", x)], "<<SEP>>"]


def label_rows(labels: list[str]) -> list[list[str]]:
    """Bi-encoder rows of labels."""
    return [["[CLS]", x, "[SEP]"] for x in labels]


def class_prompt(text: Column, labels: list[str], first: bool = True, label: str = "<<LABEL>>", sep: str = "<<SEP>>") -> Column:
    head = "".join(label + x for x in labels)
    return F.concat(F.lit(head + sep), text) if first else F.concat(text, F.lit(head + sep))


def label_section(labels: list[str]) -> list[str]:
    """Follows the text of a decoder-kv session."""
    return ["<<SEP>>", *[t for x in labels for t in (x, "<<LABEL>>")], "<<SEP>>"]


def streaming_prompt(labels: list[str]) -> list[str]:
    if not labels:
        raise ValueError("a session needs labels")
    return [*[t for x in labels for t in (x, "<<LABEL>>")], "<<SEP>>"]


def relation_labels(relations: list[Relation]) -> list[str]:
    """Boundary models know relations of a head and a tail only."""
    for r in relations:
        if r.fields != ("head", "tail"):
            raise ValueError(f"relation {r.name} has fields other than head and tail")
    return [f"{r.name}: {r.description}" if r.description.strip() else r.name for r in relations]


def usage(text: Column, words: Column, prefix: int, labels_each: int = 0) -> Column:
    """Input tokens of a text: none if it isn't run, else the unpadded row and what labels add."""
    return F.when(is_blank(text) | (F.size(words) == 0), 0).otherwise(F.size(words) + prefix + labels_each).cast("int")


def usage_cached(text: Column, words: Column, first: Column, labels: Column | int) -> Column:
    """With a label cache only the first text that is run pays for the labels; ``first`` marks it."""
    own = usage(text, words, 2)
    return F.when(first & (own > 0), own + labels).otherwise(own)


def first_runs(rows: DataFrame, labels: str, order: list[str], text: str = "text") -> DataFrame:
    """Adds ``first``: whether a row (with words) is the first by ``order`` that is run with its label list.

    The first of each list is an ordered minimum, which a task takes of what it has seen, and
    goes back by a join on list and place: no rows of a list have to meet, however many it has,
    since rows are dealt by their place too. A null list is a list like others. Rows that tie in
    ``order`` are all first.
    """
    place = F.struct(*order)
    run = ~(is_blank(F.col(text)) | (F.size("words") == 0))
    firsts = rows.where(run).groupBy(F.col(labels).alias("_labels")).agg(F.min(place).alias("_first"))
    here = F.col(labels).eqNullSafe(F.col("_labels")) & place.eqNullSafe(F.col("_first"))
    joined = rows.join(firsts.withColumn("_found", F.lit(True)), here, "left")
    return joined.withColumn("first", F.coalesce(run & F.col("_found"), F.lit(False))).drop("_labels", "_first", "_found")
