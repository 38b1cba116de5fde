"""What near-duplicate detection reads again and sends on stays small."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from textloom.llm import near_dup


def test_prefilter_lets_few_others_pass(spark):
    rows, ids = spark.range(200_000).withColumnRenamed("id", "doc_id"), spark.range(100_000)
    got = near_dup._among(rows, ids, "doc_id")
    assert got.columns == ["doc_id"]
    wanted, all_rows = got.agg(F.count_if(F.col("doc_id") < 100_000), F.count("*")).first()
    assert wanted == 100_000 and all_rows < 102_000


def test_links_of_a_dense_group_are_as_many_as_its_members(spark):
    r = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base[:i] + [f"x{i}"] + base[i + 1 :]) for i in r.sample(range(200), 60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = near_dup.shingle_set(docs, 2).select("doc_id", F.size("set").alias("n"), near_dup._name(F.col("set")).alias("name"))
    classes = sets.select(F.col("doc_id").alias("node"), "name", F.col("doc_id").alias("first_id"), "n")
    at = classes.select(F.lit(1).cast("long").alias("value"), "node", "n", F.col("node").alias("comp"))
    links = near_dup._rest(at, at.select("value").distinct(), classes, docs, 2, 80)
    assert links.count() < 300  # all pairs are 1770 links
    assert {x.comp for x in near_dup.components(links).collect()} == {0} and near_dup.components(links).count() == 59


def _classes(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    rows = near_dup.shingle_set(docs, 2).withColumn("n", F.size("set"))
    return rows.select("node", "n", F.slice("set", 1, near_dup.K).alias("sketch"), near_dup._bands(F.col("set"), 80).alias("bands"))


def test_unrelated_texts_of_few_words_share_few_keys(spark):
    r = random.Random(6)
    # 400 word pairs in all: each stands in many texts
    texts = [" ".join(f"w{r.randrange(20)}" for _ in range(n)) for n in (30, 80, 200) for _ in range(60)]
    lists = near_dup._lists(_classes(spark, texts), 80)
    met = lists.toDF("value", "a", "n").join(lists.toDF("value", "b", "m"), "value").where("a < b").select("a", "b").distinct()
    assert near_dup._apart(lists.withColumn("comp", F.col("node")), 80).count() <= met.count() < 1500  # of 16110 pairs


def test_similar_sets_meet_on_a_key(spark):
    r = random.Random(7)
    texts = []
    for i, n in enumerate([4, 5, 9, 12, 24, 27, 31, 32, 36, 40, 41, 50, 63, 66, 90, 128, 140, 256, 300, 520, 700] * 4):
        words = [f"t{i}w{j}" for j in range(n + 1)]
        cut, changed = words[: len(words) - r.randrange(n // 9 + 1)], list(words)
        for j in r.sample(range(n), n // 18):
            changed[j] = "x"
        texts += [" ".join(words), " ".join(cut), " ".join(changed)]
    classes = _classes(spark, texts)
    lists = near_dup._lists(classes, 80)
    met = {(x.a, x.b) for x in lists.toDF("value", "a", "n").join(lists.toDF("value", "b", "m"), "value").where("a < b").select("a", "b").distinct().collect()}
    sets = [{tuple(t.split()[j : j + 2]) for j in range(len(t.split()) - 1)} for t in texts]
    similar = [(a, b) for a in range(len(sets)) for b in range(a + 1, min(a + 3, len(sets))) if sets[a] != sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert len(similar) > 100 and set(similar) <= met


def test_bands_are_the_same_however_sets_are_batched():
    r = random.Random(8)
    lists = [sorted(r.randrange(-(2**63), 2**63) for _ in range(n)) for n in (0, 1, 32, 33, 40, 64, 100, 600, 3000)]
    whole = near_dup.band_lists(pa.array(lists, pa.list_(pa.int64())), 80)
    parts = [near_dup.band_lists(pa.array([x], pa.list_(pa.int64())), 80).to_pylist()[0] for x in lists]
    assert whole.to_pylist() == parts and near_dup.band_lists(pa.array([[1], *lists], pa.list_(pa.int64())).slice(1), 80).to_pylist() == parts
    bands = near_dup._band_sizes(80)[2]
    assert [len(x) for x in parts] == [0, 0, 0, bands, bands, 2 * bands, bands, 2 * bands, bands]


def test_one_in_a_million_is_missed_at_most():
    for percent in (50, 70, 80, 90, 95):
        bins, filled, bands = near_dup._band_sizes(percent)
        assert (1 - (percent / 100) ** bins) ** bands <= near_dup.LOST and 1 <= filled <= bins
