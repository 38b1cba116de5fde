"""More languages than were classes once."""

import random

from textloom.llm import language_id


def test_every_language_is_a_class(spark, monkeypatch):
    r = random.Random(5)
    rows = []
    for k in range(230):  # each language has words of its own
        words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)]
        rows += [(len(rows) + j, f"l{k:03d}", " ".join(r.sample(words, 8))) for j in range(12 if k < 210 else 8)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = language_id.train(docs)
    assert len(model.langs) == 230
    lang = {d: x for d, x, _ in rows}
    rare = [x for x in language_id.identify(docs, model).collect() if x.held_out and lang[x.doc_id] >= "l210"]
    assert len(rare) > 20 and sum(x.lang_pred == lang[x.doc_id] for x in rare) > 0.95 * len(rare)
    monkeypatch.setattr(language_id, "ROWS", 100)  # less than a row a language: each still has one
    assert len(language_id.train(docs).langs) == 230
