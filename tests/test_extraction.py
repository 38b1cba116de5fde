"""Structures, combined extraction and the public functions, against plain restatements."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

import textloom.api as api
from textloom.operators import relations as R
from textloom.operators import spans as S
from textloom.operators.schema import Field, Label, Question, Relation, Schema, Structure
from textloom.operators.scorer import HashScorer, RuleScorer

WORD = re.compile(r"\w+(?:[-_]\w+)*|\S", re.ASCII)


def score(label, text):
    return int(hashlib.md5(f"{label}|{text}".encode()).hexdigest()[:6], 16) / 16777215.0


def spans(text, label, at, width):
    """(p, first, last, start, end, text) in the order of start and width."""
    words = [m.span() for m in WORD.finditer(text)]
    made = [(i, j, words[i][0], words[j][1]) for i in range(len(words)) for j in range(i, min(len(words), i + width))]
    return [(p, i, j, a, z, text[a:z]) for i, j, a, z in made if (p := score(label, text[a:z])) >= at]


def greedy(found):
    kept = []
    for s in sorted(found, key=lambda s: -s[0]):
        if all(s[3] >= k[4] or k[3] >= s[4] for k in kept):
            kept.append(s)
    return sorted(kept, key=lambda s: s[3])


def count(unit, text):
    if not text or not text.strip():
        return 0
    v = [score(f"{unit}:count:{k}", text) for k in range(4)]
    return v.index(max(v))


def snap(found, choices):
    out = []
    for s in found:
        fits = [c for c in sorted(choices, key=len, reverse=True) if c.lower() in s[5].lower() or s[5].lower() in c.lower()]
        out += [(*s[:5], c) for c in fits[:1]]
    return out


def plain_structures(text, unit, at, width):
    out = []
    for inst in range(count(unit.name, text)):
        fields = {}
        for f in unit.fields:
            found = spans(text, f"{unit.name}:{inst}:{f.name}", at, width)
            found = snap(found, f.choices) if f.choices else found
            if found:
                fields[f.name] = [max(found, key=lambda s: s[0])] if f.kind == "STRING" else greedy(found)
        out.append({k: [(s[5], s[3], s[4]) for s in v] for k, v in fields.items()})
    return out


def plain_relations(text, unit, at, width):
    out, seen = [], set()
    for inst in range(count(unit.name, text)):
        best = [max(spans(text, f"{unit.name}:{inst}:{f}", at, width), key=lambda s: s[0], default=None) for f in unit.fields]
        offsets = tuple(b and b[3:5] for b in best)
        if all(best) and offsets not in seen:
            seen.add(offsets)
            out.append([(b[5], b[3], b[4]) for b in best])
    return out


UNIT = Structure("offer", (Field("title"), Field("perks", "LIST"), Field("grade", "STRING", None, ("gold", "silver plate", "tin"))))
SCHEMA = Schema((Label("city"), Label("name")), (), (Relation("owns"), Relation("near", fields=("a", "b", "c"))), (UNIT, Structure("empty", (Field("x"),))))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(11)
    vocab = ["Gold", "tin", "silver", "plate", "mill", "river", "x-ray", "a_b", "!", "Zoë", "42", "of"]
    out = [" ".join(r.choice(vocab) for _ in range(r.randrange(1, 25))) for _ in range(40)]
    return [*out, None, "", " \n ", "gold"]


def test_combined_extraction_equals_a_plain_restatement(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r for r in api.extract(rows, SCHEMA, threshold=0.8, width=3).collect()}
    filled = 0
    for i, text in enumerate(texts):
        text, r = text or "", got[i]
        assert list(r.structures) == ["offer", "empty"] and list(r.relations) == ["owns", "near"]
        mine = [{k: [(s.text, s.start, s.end) for s in v] for k, v in inst.items()} for inst in r.structures["offer"]]
        assert mine == plain_structures(text, UNIT, 0.8, 3)
        filled += sum(map(len, mine))
        for unit in SCHEMA.relations:
            assert [[(s.text, s.start, s.end) for s in x.fields] for x in r.relations[unit.name]] == plain_relations(text, unit, 0.8, 3)
        own = greedy([(*s, y) for y in ("city", "name") for s in spans(text, y, 0.8, 3)])
        assert sorted((y, s.text, s.start) for y, v in r.entities.items() for s in v) == sorted((s[6], s[5], s[3]) for s in own)
    assert filled > 30


def test_instances_without_fields_stay(spark):
    """Two instances of which the second finds nothing; choices decide before the best is chosen."""

    class Table:
        rules = {"deal:0:item": "green tea|tea", "deal:0:sort": "green|leaf", "deal:0:tags": "green|tea|of"}

        def score(self, label, surface):
            out = F.lit(0.1)
            for name, words in self.rules.items():
                for k, w in enumerate(words.split("|")):
                    out = F.when((label == name) & (surface == w), 0.9 - k / 10).otherwise(out)
            return F.when(label == "deal:count:2", 0.8).otherwise(out)

    deal = Structure("deal", (Field("item"), Field("sort", "STRING", None, ("leafy",)), Field("tags", "LIST")))
    rows = spark.createDataFrame([("a cup of green tea",)], "text string")
    out = api.extract_structures(rows, [deal], Table(), threshold=0.5, width=2).first().structures["deal"]
    assert len(out) == 2 and out[1] == {}
    assert [(s.text, s.start) for s in out[0]["item"]] == [("green tea", 9)]
    assert "sort" not in out[0]
    assert [s.text for s in out[0]["tags"]] == ["of", "green", "tea"]


def test_candidates_of_a_stretch_of_labels(spark):
    rows = api.with_words(spark.createDataFrame([("one two three",)], "text string"))
    rows = S.candidates(rows, ["a", "b", "c"], HashScorer(), 0.0, 2)
    got = rows.select(S.of_labels(F.col("cands"), 1, 3, 2).alias("x"), F.col("cands.ord").alias("o")).first()
    assert [c.label for c in got.x] == ["b"] * 5 + ["c"] * 5
    assert got.o == sorted(got.o)
    assert rows.select(F.size(R.places(F.lit(0)))).first()[0] == 0


def test_public_functions(spark):
    rows = spark.createDataFrame([(0, "cheap flights"), (1, " "), (2, None)], "id int, text string").coalesce(1)
    rules = RuleScorer((("travel", ".*flights.*"), ("word", "[a-z]+")))
    got = api.classify(rows, ["travel", "sport"], rules, threshold=0.6).orderBy("id").collect()
    assert [[c.label for c in r.classes] for r in got] == [["travel"], [], []]
    assert [c.label for c in api.classify(rows, ["sport", "travel"], rules, single=True).first().classes] == ["travel", "sport"]
    found = api.extract_entities(rows, [Label("word")], rules, threshold=0.5).orderBy("id").collect()
    assert [s.text for s in found[0].entities["word"]] == ["cheap", "flights"] and found[1].entities == {} == found[2].entities
    assert api.extract_relations(rows, ["r"], rules).columns == ["id", "text", "relations"]
    asked = [Question("q", options=(Label("travel"), Label("x")))]
    assert [len(r.decisions) for r in api.decide(rows, asked, rules).orderBy("id").collect()] == [1, 0, 0]
    with pytest.raises(ValueError, match="same id"):
        api.decide(rows, asked * 2, rules)
    with pytest.raises(NotImplementedError):
        api.extract(rows, Schema((Label("a"),), (Label("b"),)), rules)
