"""Every stage of the pipeline on awkward and empty tables, and what it leaves in the shared folder."""

import random

import pytest

import corpus_pipeline as cp
from textloom import session

WORDS = [f"word{k}" for k in range(400)]
KIND = "doc_id long, text string, lang string, source string, n_chars long, _words string, _n int, _pieces string, score double, predicted int, _key long, _b long, _masked string, key string, component_key string, _own int"
EXTRA = ("w", 3, "p", 0.25, 7, 8, 9, "m", "k", "c", 1)
NAMES = [name for name, _ in cp.STAGES]


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, prose(random.Random(9), 30)), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def table(spark):
    r = random.Random(2)
    base = prose(r, 60)
    passage = prose(random.Random(9), 30)
    texts = [None, "", " \n", base, base, base + " end", prose(r, 40) + " " + passage, prose(r, 9000), prose(r, 30) + " me@home.org", base, base]
    ids = [0, 1, 2, 3, 4, 5, 6, 7, 8, None, 3]
    return spark.createDataFrame([(i, t, "en", None if k % 3 else "s", len(t or ""), *EXTRA) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], KIND)


@pytest.mark.parametrize("k", range(len(cp.STAGES)), ids=NAMES)
def test_empty_tables(spark, folder, k):
    empty = spark.createDataFrame([], KIND)
    out = cp.STAGES[k][1](spark, empty, folder)
    assert out.collect() == [] and (k == len(cp.STAGES) - 1 or out.columns == empty.columns)


def test_stages_keep_what_they_should(spark, folder):
    docs = table(spark)
    rows = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    every = rows(docs)
    kept = cp.quality(spark, docs, folder)
    assert kept.dtypes == docs.dtypes and rows(kept) == every  # one kind of label only
    once = cp.near_duplicates(spark, docs, folder)
    assert once.dtypes == docs.dtypes
    left = [x for x in every if x[0] in (0, 1, 2, 6, 7, 8)] + [(3, next(t for i, t in every if i == 3))]
    assert rows(once) == sorted(left, key=str)
    clean = cp.benchmark(spark, docs, folder)
    assert clean.dtypes == docs.dtypes and rows(clean) == [x for x in every if x[0] != 6]
    safe = cp.personal_data(spark, docs, folder)
    assert safe.dtypes == docs.dtypes
    by = {x.doc_id: x for x in safe.collect()}
    assert by[8].text.endswith(" [EMAIL]") and by[8].n_chars == len(by[8].text) and by[0].text is None and by[0].n_chars == 0
    assert by[7].text == dict(every)[7]
    for df in (kept, once, clean, safe):
        assert all(tuple(r)[5:] == EXTRA for r in df.collect())
    mixed = cp.mix(spark, docs, folder).collect()
    assert len(mixed) == len(every) and all(x.taken <= 2 * x.size for x in mixed)


def test_a_stage_removes_what_earlier_ones_left(spark, folder, tmp_path):
    out, docs, before = None, table(spark), set(session.left(spark)) - set(cp._DONE)
    for k, (_, stage) in enumerate(cp.STAGES):
        out = str(tmp_path / str(k))
        stage(spark, docs, folder).write.parquet(out)
        docs = spark.read.parquet(out)
    there = set(session.left(spark)) - before
    assert there == set(cp._DONE) and all("/sizes-" in p or "/targets-" in p for p in there)
