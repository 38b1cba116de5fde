"""Relations and structures: instances whose fields are the best spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import let, semantic, token_set
from . import spans as S
from .schema import Field
from .scorer import Scorer


def asked(unit: str, fields: list[str], instances: Column) -> Column:
    """Labels of every field of every instance of a unit, in that order."""
    names = F.array(*map(F.lit, fields))
    return F.flatten(F.transform(places(instances), lambda inst: F.transform(names, lambda f: F.concat(F.lit(f"{unit}:"), inst.cast("string"), F.lit(":"), f))))


def places(instances: Column) -> Column:
    """0 to ``instances`` - 1."""
    return F.when(instances > 0, F.sequence(F.lit(0), instances.cast("int") - 1)).otherwise(F.slice(F.array(F.lit(0)), 1, 0))


def best_of(spans: Column, name: str) -> Column:
    """The most probable candidate as struct(k, i, j, name, text, start, end), ``k`` being -p; null without any.

    Ties go to the earlier start, then the narrower span.
    """
    made = F.transform(spans, lambda c: F.struct((-c["p"]).alias("k"), c["first"].alias("i"), (c["last"] - c["first"]).alias("j"), F.lit(name).alias("name"), c["text"].alias("text"), c["start"].alias("start"), c["end"].alias("end")))
    return F.array_min(made)


def best_fields(spans: Column, fields: list[str], instances: Column, first: Column | int, width: int) -> Column:
    """Array over instances of arrays over fields of the best span; ``first`` is the place of the unit's first label."""
    m, base = len(fields), first if isinstance(first, Column) else F.lit(first)
    own = lambda inst, f: S.of_labels(spans, base + inst * m + f, base + inst * m + f + 1, width)
    return F.transform(places(instances), lambda inst: F.array(*(best_of(own(inst, f), name) for f, name in enumerate(fields))))


def best_spans(rows: DataFrame, unit: str, fields: list[str], scorer: Scorer, threshold: float, instances: Column, width: int) -> DataFrame:
    """Adds ``best``: array over instances of arrays over fields of the most probable span (null if none reaches the threshold).

    Scores are of (unit, instance, field); all of them share one pass over the spans.
    """
    rows = rows.withColumn("_n", instances).withColumn("_asked", asked(unit, fields, F.col("_n")))
    rows = S.candidates(rows, F.col("_asked"), scorer, threshold, width, "_cands")
    return rows.withColumn("best", best_fields(F.col("_cands"), fields, F.col("_n"), 0, width)).drop("_n", "_asked", "_cands")


def structures(spans: Column, fields: tuple[Field, ...], instances: Column, first: Column | int, width: int) -> Column:
    """Array over instances of maps field -> spans: the best one of a STRING field, the greedy choice of a LIST field.

    Fields without a span are absent; an instance without fields stays, as an empty map.
    Choices are snapped to before anything is chosen.
    """
    m, base = len(fields), first if isinstance(first, Column) else F.lit(first)

    def value(inst: Column, f: int, field: Field) -> Column:
        own = snapped(S.of_labels(spans, base + inst * m + f, base + inst * m + f + 1, width), field)
        return F.slice(S.by_confidence(own), 1, 1) if field.kind == "STRING" else S.greedy(own)

    def instance(inst: Column) -> Column:
        values = F.array(*(F.struct(F.lit(field.name).alias("name"), value(inst, f, field).alias("spans")) for f, field in enumerate(fields)))
        return F.map_from_entries(F.filter(values, lambda x: F.size(x["spans"]) > 0))

    return F.transform(places(instances), instance)


def relations(best: Column) -> Column:
    """Complete instances as structs(fields, confidence), once per offsets: the first instance stays, not the surest."""
    whole = F.filter(best, lambda x: ~F.exists(x, lambda s: s.isNull()))
    made = F.transform(whole, lambda x: F.struct(x.alias("fields"), F.array_min(F.transform(x, lambda s: -s["k"])).alias("confidence"), F.transform(x, lambda s: F.struct(s["start"], s["end"])).alias("at")))
    fresh = let(made, lambda m: F.filter(m, lambda x, i: ~F.exists(F.slice(m, 1, i), lambda y: y["at"] == x["at"])))
    return F.transform(fresh, lambda x: F.struct(x["fields"], x["confidence"]))


def snapped(spans: Column, field: Field) -> Column:
    """Spans take the text of the longest choice that equals, holds or lies in theirs, ignoring case; without one they go. Offsets stay."""
    if not field.choices:
        return spans
    choices = F.array(*(F.struct(F.lit(c).alias("choice"), F.lit(c.lower()).alias("low"), F.lit(len(c)).alias("n")) for c in field.choices))

    def snap(c: Column) -> Column:
        low = F.lower(c["text"])
        fits = F.filter(choices, lambda x: F.contains(low, x["low"]) | F.contains(x["low"], low))
        order = F.sort_array(F.transform(fits, lambda x, i: F.struct((-x["n"]).alias("n"), i.alias("i"), x["choice"].alias("choice"))))
        return c.withField("text", F.get(order, 0)["choice"])

    return F.filter(F.transform(spans, snap), lambda c: c["text"].isNotNull())


def deduplicated(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Edges (keys, k, p, head, hs, he, tail, ts, te) of a relation, without repeats and parts.

    Mentions grow to the longest that holds them; equal coordinates keep the best edge, equal
    texts the closest one; an edge goes if another has one argument with strictly more tokens
    and the other with equal tokens. A single edge stays as it is. Adds ``ord``.
    """
    size = F.count("*").over(W.partitionBy(*keys))
    alone = edges.withColumn("_n", size)

    def grown(rows: DataFrame, x: str, other: str) -> DataFrame:
        s, e = f"{x[0]}s", f"{x[0]}e"
        mention = edges.select(*keys, F.col(s).alias("_s"), F.col(e).alias("_e"), F.col(x).alias("_t")).distinct()
        outer = mention.select(*keys, F.col("_s").alias("_s2"), F.col("_e").alias("_e2"), F.col("_t").alias("_t2"))
        pick = F.min(F.struct((F.col("_s2") - F.col("_e2")).alias("n"), F.col("_s2").alias("s"), F.col("_e2").alias("e"), F.col("_t2").alias("t")))
        best = mention.join(outer, keys).where("_s2 <= _s AND _e2 >= _e").groupBy(*keys, "_s", "_e").agg(pick.alias("_b"))
        out = rows.join(best.withColumnsRenamed({"_s": s, "_e": e}), [*keys, s, e])
        return out.withColumns({x: F.col("_b.t"), s: F.col("_b.s"), e: F.col("_b.e")}).drop("_b")

    many = grown(grown(alone.where("_n > 1").drop("_n"), "head", "tail"), "tail", "head")
    here = W.partitionBy(*keys, "hs", "he", "ts", "te")
    many = many.withColumn("ord", F.min("k").over(here)).withColumn("_r", F.row_number().over(here.orderBy(F.desc("p"), "k"))).where("_r = 1")
    gap = F.greatest(F.col("hs") - F.col("te"), F.col("ts") - F.col("he"), F.lit(0))
    texts = W.partitionBy(*keys, "_h", "_t").orderBy(gap, F.desc("p"), "hs", "ts", "ord")
    many = many.withColumns({"_h": semantic(F.col("head")), "_t": semantic(F.col("tail"))}).withColumn("_r", F.row_number().over(texts)).where("_r = 1")
    many = many.withColumns({"_h": token_set(F.col("head")), "_t": token_set(F.col("tail"))})
    other = many.select(*keys, F.col("_h").alias("_h2"), F.col("_t").alias("_t2"))
    within = lambda a, b: (F.size(F.array_except(a, b)) == 0) & (F.size(a) < F.size(b))
    covers = (within("_h", "_h2") & (F.col("_t") == F.col("_t2"))) | (within("_t", "_t2") & (F.col("_h") == F.col("_h2")))
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    many = many.alias("a").join(other.alias("b"), [*same, covers], "left_anti")
    cols = [*keys, "k", "p", "head", "hs", "he", "tail", "ts", "te", "ord"]
    return many.select(*cols).unionByName(alone.where("_n = 1").withColumn("ord", F.col("k")).select(*cols))
