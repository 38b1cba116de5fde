"""Decoders against literal goldens and plain restatements."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import pool as P
from textloom.operators import relations as R
from textloom.operators import spans as S
from textloom.operators.schema import Field, Label, Question, Relation, Schema, Structure
from textloom.operators.scorer import HashScorer, RuleScorer, engine_of, family_of, register, scorer_for


def greedy_plain(spans):
    kept = []
    for s in sorted(spans, key=lambda s: (-s["p"], s["ord"])):
        if all(s["start"] >= k["end"] or k["start"] >= s["end"] for k in kept):
            kept.append(s)
    return sorted(s["ord"] for s in kept)


def random_spans(r, n):
    out = []
    for i in range(n):
        a = r.randrange(40)
        out.append({"ord": i, "label": r.choice("ab"), "first": a, "last": a, "start": a, "end": a + r.randrange(1, 6), "text": "x", "p": r.choice([0.5, 0.6, 0.7, 0.9])})
    return out


def test_greedy_forms_agree(spark):
    r = random.Random(42)
    data = [(i, random_spans(r, r.randrange(0, 25))) for i in range(60)]
    rows = spark.createDataFrame(data, f"id int, cands array<{S.SPAN}>")
    one = {x.id: sorted(c.ord for c in x.cands) for x in rows.withColumn("cands", S.greedy(F.col("cands"))).collect()}
    many = {x.id: sorted(c.ord for c in x.cands) for x in S.greedy_many(rows).collect()}
    for i, spans in data:
        assert one[i] == many[i] == greedy_plain(spans)


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ([(0.6, 0, 4), (0.5, 0, 2), (0.5, 2, 4)], [(0.5, 0, 2), (0.5, 2, 4)]),
        ([(0.9, 0, 3), (0.8, 3, 5)], [(0.9, 0, 3), (0.8, 3, 5)]),
        ([(0.7, 1, 2), (0.9, 1, 2)], [(0.9, 1, 2)]),
        ([(0.6, 5, 6), (0.95, 0, 1), (0.6, 2, 3)], [(0.95, 0, 1), (0.6, 2, 3), (0.6, 5, 6)]),
    ],
)
def test_schedule_goldens(given, want):
    assert S.schedule(given) == want


def test_schedule_against_all_subsets():
    r = random.Random(7)
    for _ in range(60):
        given = [(r.choice([0.25, 0.5, 0.75]), a := r.randrange(8), a + r.randrange(1, 4)) for _ in range(7)]
        best = max(sum(x[0] for x in c) for n in range(8) for c in itertools.combinations(given, n) if all(a[2] <= b[1] or b[2] <= a[1] for a, b in itertools.combinations(c, 2)))
        got = S.schedule(given)
        assert sum(x[0] for x in got) == best
        assert all(a[2] <= b[1] or b[2] <= a[1] for a, b in itertools.combinations(got, 2))


EDGES = "doc int, k long, p double, head string, hs long, he long, tail string, ts long, te long"


def test_relation_edges(spark):
    """1: a part of a name grows to the name. 2: of equal texts the closer ones stay. 3: fewer tokens in the same place go. 4: alone. 5: parts elsewhere go too. 6: all differ, all stay."""
    rows = [
        (1, 1, 0.6, "Lena", 3, 7, "Orion", 30, 35), (1, 2, 0.65, "Lena Vogt", 3, 12, "Orion", 30, 35),
        (2, 1, 0.55, "river", 90, 95, "delta", 100, 105), (2, 2, 0.99, "river", 10, 15, "delta", 100, 105), (2, 3, 0.7, "River ", 10, 16, "delta", 140, 145),
        (3, 1, 0.51, "new harbour bridge", 20, 38, "Aker", 60, 64), (3, 2, 0.98, "harbour", 24, 31, "Aker", 60, 64),
        (4, 1, 0.5, "solo", 1, 5, "solo", 1, 5),
        (5, 1, 0.9, "green", 200, 205, "lamp", 210, 214), (5, 2, 0.6, "green glass", 0, 11, "lamp", 50, 54),
        (6, 1, 0.6, "ink", 0, 3, "pen", 9, 12), (6, 2, 0.6, "pen", 9, 12, "ink", 0, 3), (6, 3, 0.6, "pad", 20, 23, "pen", 9, 12),
    ]
    got = {(r.doc, r["head"], r.hs, r.tail, r.p) for r in R.deduplicated(spark.createDataFrame(rows, EDGES), ["doc"]).collect()}
    assert got == {
        (1, "Lena Vogt", 3, "Orion", 0.65), (2, "river", 90, "delta", 0.55), (3, "new harbour bridge", 20, "Aker", 0.98), (4, "solo", 1, "solo", 0.5),
        (5, "green glass", 0, "lamp", 0.6), (6, "ink", 0, "pen", 0.6), (6, "pen", 9, "ink", 0.6), (6, "pad", 20, "pen", 0.6),
    }


def test_first_instance_of_equal_offsets_stays(spark):
    span = lambda k, a, z: {"k": -k, "i": a, "j": 0, "name": "f", "text": "t", "start": a, "end": z}
    best = [[span(0.6, 0, 1), span(0.7, 2, 3)], [span(0.9, 0, 1), span(0.9, 2, 3)], [span(0.9, 0, 1), None]]
    kind = "array<array<struct<k:double,i:int,j:int,name:string,text:string,start:int,end:int>>>"
    out = spark.createDataFrame([(best,)], f"best {kind}").select(R.relations(F.col("best")).alias("r")).first().r
    assert [x.confidence for x in out] == [0.6]


def test_snapping(spark):
    """A choice may hold the span or lie in it, the longest that does counts, and case doesn't; what fits none goes."""
    cand = [(0, "k", 0, 0, 0, 3, "OAK", 0.4), (1, "k", 1, 2, 4, 17, "old oak wood x", 0.6), (2, "k", 3, 3, 18, 23, "maple", 0.9), (3, "k", 4, 4, 24, 27, "iro", 0.5)]
    rows = spark.createDataFrame([(cand,)], f"c array<{S.SPAN}>")
    out = rows.select(S.by_confidence(R.snapped(F.col("c"), Field("stuff", choices=("oak", "Oak wood", "iron")))).alias("c")).first().c
    assert [(x.text, x.start, x.p) for x in out] == [("Oak wood", 4, 0.6), ("iron", 24, 0.5), ("Oak wood", 0, 0.4)]


def test_buckets():
    assert P.in_buckets([], 1.3) == []
    assert P.in_buckets([3, 1, 2], 1.0) == [[0, 1, 2]]
    assert P.in_buckets([50, 500, 60, 55, 480], 1.3) == [[0, 3, 2], [4, 1]]
    assert [len(b) for b in P.in_buckets([10] * 5, 1.0, 2)] == [2, 2, 1]


def test_top_k_ties_and_caps(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate([0.5, 0.9, 0.9, 0.1])], "q int, at int, v double")
    assert [(r.at, r["rank"]) for r in P.top_k(rows, ["q"], "v", "at", 3).orderBy("rank").collect()] == [(1, 0), (2, 1), (0, 2)]


def test_questions_are_checked():
    two = (Label("a"), Label("b"))
    for bad in ({"id": " ", "options": two}, {"id": "x", "options": two[:1]}, {"id": "x", "options": (Label("a"), Label("a"))}, {"id": "x", "options": (Label("a"), Label(" "))}):
        with pytest.raises(ValueError):
            Question(**bad)
    assert [o.name for o in Question("x", "noul").options] == ["yes", "no"]
    assert Question("x", "choice", "why", two).prompt == "x: why"
    for bad in (lambda: Relation("r", "", ()), lambda: Structure("s", ()), Schema):
        with pytest.raises(ValueError):
            bad()


def test_registry():
    assert family_of({}) == family_of({"architecture": "new"}) == "gliner2"
    assert engine_of({"architecture": "gliclass-decoder-kv"}) == "llamacpp"
    with pytest.raises(ValueError):
        engine_of({"engine": "other"})
    with pytest.raises(NotImplementedError):
        scorer_for({"architecture": "gliclass"}, "ner")
    with pytest.raises(LookupError):
        scorer_for({"architecture": "gliner-bi"}, "ner")
    register("gliner-bi", "onnx", lambda config: HashScorer())
    assert isinstance(scorer_for({"architecture": "gliner-bi"}, "ner"), HashScorer)


def test_rules_find_entities_and_widths(spark):
    rules = RuleScorer((("email", r"\S+@\S+"), ("year", r"\d{4}")))
    rows = T.with_words(spark.createDataFrame([(1, "mail a@b.de in 2024"), (2, None)], "doc_id int, text string"), T.Preset(T.WEB))
    out = S.candidates(rows, ["email", "year"], rules, 0.5, 2).withColumn("cands", S.greedy(F.col("cands")))
    assert sorted((r.doc_id, r.type, r.text, r.start) for r in S.exploded(out, ["doc_id"]).collect()) == [(1, "email", "a@b.de", 5), (1, "year", "2024", 15)]
    kinds = out.select("doc_id", S.by_type(F.col("cands")).alias("m"), F.map_keys(S.by_type(F.col("cands"))).alias("keys"), S.all_types(F.col("cands"), ["email", "year", "x"]).alias("a")).orderBy("doc_id").collect()
    assert kinds[0]["keys"] == ["email", "year"] and kinds[1].m == {} and set(kinds[1].a) == {"email", "year", "x"}
