"""One plan for all that a schema asks of a text.

Entities, relations and structures are units whose labels are asked for together: the spans
of a text are built and scored in one pass, and each unit decodes the stretch of candidates
that belongs to its labels, in the order of the schema. How many instances a unit has is
chosen first, since it decides which labels are asked for. All of it is one projection: a
text and its results never meet a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import argmax, is_blank
from . import relations as R
from . import spans as S
from .schema import Relation, Schema, Structure
from .scorer import Scorer

#: Numbers of instances that are told apart, and the most that are decoded.
COUNTS, MOST = 4, 20

RELATION = "struct<fields:array<struct<k:double,i:int,j:int,name:string,text:string,start:int,end:int>>,confidence:double>"


def counted(unit: str, scorer: Scorer, text: Column, counts: int = COUNTS, most: int = MOST) -> Column:
    """How many instances of a unit a text has: the first most probable count, ``most`` at the most."""
    scores = F.transform(F.sequence(F.lit(0), F.lit(counts - 1)), lambda k: scorer.score(F.concat(F.lit(f"{unit}:count:"), k.cast("string")), text))
    return F.least(F.coalesce(argmax(scores), F.lit(0)), F.lit(most))


def fields_of(unit: Relation | Structure) -> list[str]:
    return list(unit.fields) if isinstance(unit, Relation) else [f.name for f in unit.fields]


def extracted(rows: DataFrame, schema: Schema, scorer: Scorer, threshold: float = 0.5, width: int = 12, text: str = "text") -> DataFrame:
    """Adds ``entities``, ``relations`` and ``structures`` to ``rows`` with words (functions.text.with_words).

    ``entities``: map type -> spans, by the greedy choice among all types. ``relations``: map
    name -> complete instances, once per offsets. ``structures``: map name -> instances, each a
    map field -> spans, be it empty. Every relation and structure asked for is there, in the
    order of the schema. A blank or null text has no entities and no instances.
    """
    if schema.classifications:
        raise NotImplementedError("classifications aren't part of extraction; use classify")
    units = [*schema.relations, *schema.structures]
    blank = is_blank(F.col(text))
    n = [f"_n{u}" for u in range(len(units))]
    rows = rows.withColumns({c: F.when(blank, 0).otherwise(counted(unit.name, scorer, F.col(text))) for c, unit in zip(n, units, strict=True)})
    entities = [label.name for label in schema.entities]
    labels = [F.array(*map(F.lit, entities))] if entities else []
    labels += [R.asked(unit.name, fields_of(unit), F.col(c)) for c, unit in zip(n, units, strict=True)]
    rows = S.candidates(rows.withColumn("_asked", F.concat(*labels)), F.col("_asked"), scorer, threshold, width, "_cands")
    spans, first, related, structured = F.col("_cands"), F.lit(len(entities)), [], []
    found = S.by_type(S.greedy(S.of_labels(spans, 0, len(entities), width)))
    for c, unit in zip(n, units, strict=True):
        if isinstance(unit, Relation):
            best = R.best_fields(spans, fields_of(unit), F.col(c), first, width)
            related.append(F.struct(F.lit(unit.name).alias("key"), R.relations(best).alias("value")))
        else:
            structured.append(F.struct(F.lit(unit.name).alias("key"), R.structures(spans, unit.fields, F.col(c), first, width).alias("value")))
        first = first + F.col(c) * len(fields_of(unit))
    none = lambda kind: F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{kind}>"))
    out = rows.withColumns({
        "entities": found if entities else none(f"array<{S.SPAN}>"),
        "relations": F.map_from_entries(F.array(*related)) if related else none(f"array<{RELATION}>"),
        "structures": F.map_from_entries(F.array(*structured)) if structured else none(f"array<map<string,array<{S.SPAN}>>>"),
    })
    return out.drop("_asked", "_cands", *n)
