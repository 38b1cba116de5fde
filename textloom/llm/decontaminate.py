"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` stores a posting (row, position, term) for every token of the training
texts whose term occurs in the benchmark, and one posting per row that holds its length.
``matches`` looks the benchmark's windows up: the postings of each window's rarest term
propose places, the offset-adjusted postings of its second rarest term must agree, and
then those of all others; with ``slack`` terms may be that many places off (proximity).
Windows of the same words are one, however often items have them; a term that a window has
at several places proposes from each, so that a place is proposed once for a window of one
word over and over. Which items have a window is looked up after it was found, and ranges of
words that windows cover are put together before they are counted.

Defined cases: a null or empty text has no words and no hits; an item without words has
no windows, and one with fewer words than a window is one window; repeated rows are
judged each by themselves and alike; rows with equal or null ids are told apart by their
text; very long texts are read whole, a posting a word; of equally rare terms of a window the
first proposes; empty tables give rows without hits, or no rows; extra columns are not used.

Scale: the index is written once and read by column. Terms, windows and rare terms are
broadcast only while their counted rows stay under ``BROADCAST_ROWS``. Before the last,
widest join, postings are cut down to rows with candidates by a table of at most
``FILTER_BUCKETS`` hash buckets (a superset, so nothing is lost).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import discard, stored
from .common import hinted, text_key

#: Words of a window.
WINDOW = 10
#: Characters that end a word; A-Z count as word characters, as words are lower-cased afterwards. Fixed values.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_ROWS = 200_000
FILTER_BUCKETS = 1 << 18
#: Stands for the end of a text in the index; no word has a blank.
END = " "


def words(text: Column) -> Column:
    """Words before lower-casing; see ``lowered``."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN, -1), "")


def lowered(word: Column) -> Column:
    """A-Z to lower case, nothing else: full lower-casing agrees on words of ASCII letters only."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def windows(items: DataFrame, n: int = WINDOW) -> DataFrame:
    """``item_id, win, n_win, terms``: one row per window of each item; ``win`` stands for its words, ``terms`` are these."""
    rows = items.select("item_id", text_key("item_id").alias("_key"), F.transform(words(F.col("text")), lowered).alias("_words"))
    rows = rows.where(F.size("_words") > 0).dropDuplicates(["item_id", "_key"]).withColumn("n_win", F.least(F.size("_words"), F.lit(n)))
    rows = rows.withColumn("_at", F.explode(F.sequence(F.lit(0), F.size("_words") - F.col("n_win"))))
    cut = rows.select("item_id", "n_win", F.slice("_words", F.col("_at") + 1, F.col("n_win")).alias("terms"))
    return cut.select("item_id", F.xxhash64("terms").alias("win"), "n_win", "terms").dropDuplicates(["item_id", "win"])


def sequences(wins: DataFrame) -> DataFrame:
    """``win, n_win, idx, word``: one row per word of each different window."""
    return wins.dropDuplicates(["win"]).select("win", "n_win", F.posexplode("terms").alias("idx", "word"))


def vocabulary(wins: DataFrame) -> DataFrame:
    """``word, term``: a number for each word of ``sequences`` (its hash, so that it depends on nothing else)."""
    return wins.select("word").distinct().withColumn("term", F.xxhash64("word"))


def build_index(docs: DataFrame, vocab: DataFrame, n_vocab: int) -> DataFrame:
    """Stored postings ``doc_id, key, pos, term``; the posting of term null is at the length of its row's text."""
    texts = docs.select("doc_id", text_key().alias("key"), F.array_append(words(F.col("text")), END).alias("_words"))
    # never empty; the outer form keeps the optimizer from splitting texts twice for a filter on the size
    tokens = texts.select("doc_id", "key", F.posexplode_outer("_words").alias("pos", "_word")).withColumn("word", lowered(F.col("_word")))
    known = vocab.unionByName(docs.sparkSession.range(1).select(F.lit(END).alias("word"), F.lit(None).cast("long").alias("term")))
    return stored(tokens.join(hinted(known, n_vocab, BROADCAST_ROWS), "word").select("doc_id", "key", "pos", "term"), "postings")


def matches(index: DataFrame, wins: DataFrame, n_wins: int, slack: int = 0) -> DataFrame:
    """Stored ``key, win, start, n_win``: every place where all words of a window of ``sequences`` stand (within ``slack``).

    ``n_wins`` is the counted number of rows of ``wins``.
    """
    postings = index.where(F.col("term").isNotNull()).select("key", "pos", "term")
    terms = wins.withColumn("term", F.xxhash64("word"))
    count = postings.groupBy("term").agg(F.count("*").alias("n"))
    # words that occur nowhere come first: their windows have no place to propose
    order = W.partitionBy("win").orderBy(F.coalesce("n", F.lit(0)), "idx")
    ranked = stored(terms.join(count, "term", "left").withColumn("rank", F.row_number().over(order)).select("win", "n_win", "idx", "term", "rank"), "windows")
    rarest = hinted(ranked.where("rank = 1"), n_wins, BROADCAST_ROWS)
    places = postings.join(rarest, "term").select("key", "win", "n_win", (F.col("pos") - F.col("idx")).alias("start")).where("start >= 0")
    second = ranked.where("rank = 2").select("win", F.col("idx").alias("_idx"), F.col("term").alias("_term"))
    near = lambda at: F.explode(F.sequence(at - slack, at + slack)) if slack else at
    asked = places.where("n_win > 1").join(hinted(second, n_wins, BROADCAST_ROWS), "win")
    asked = asked.withColumn("pos", near(F.col("start") + F.col("_idx")))
    second_terms = hinted(second.select(F.col("_term").alias("term")).distinct(), n_wins, BROADCAST_ROWS)
    lists = postings.join(second_terms, "term", "left_semi").select("key", "pos", F.col("term").alias("_term"))
    agreed = asked.join(lists, ["key", "pos", "_term"], "left_semi").select("key", "win", "n_win", "start").distinct()
    agreed = stored(agreed, "candidates")
    # all other terms of the window
    rest = ranked.where("rank > 2").select("win", "idx", "term")
    asked = agreed.where("n_win > 2").join(hinted(rest, n_wins, BROADCAST_ROWS), "win").withColumn("pos", near(F.col("start") + F.col("idx")))
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BUCKETS))
    with_candidates = F.broadcast(agreed.select(bucket("key").alias("_b")).distinct())  # FILTER_BUCKETS rows at most
    there = postings.join(hinted(rest.select("term").distinct(), n_wins, BROADCAST_ROWS), "term", "left_semi").withColumn("_b", bucket("key")).join(with_candidates, "_b", "left_semi")
    stands = asked.join(there.select("key", "pos", "term"), ["key", "pos", "term"], "left_semi").select("key", "win", "n_win", "start", "idx").distinct()
    full = stands.groupBy("key", "win", "n_win", "start").agg(F.count("*").alias("n")).where("n = n_win - 2").drop("n")
    found = stored(places.where("n_win = 1").unionByName(agreed.where("n_win = 2")).unionByName(full), "matches")
    discard(ranked, agreed)
    return found


def covered(found: DataFrame) -> DataFrame:
    """``key, n_hit``: how many words of each row lie in the ranges of ``found`` (key, start, n_win)."""
    ranges = found.groupBy("key", "start").agg(F.max("n_win").alias("n_win")).withColumn("end", F.col("start") + F.col("n_win"))
    before = W.partitionBy("key").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    own = F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.col("start")))
    return ranges.withColumn("own", F.greatest(own, F.lit(0))).groupBy("key").agg(F.sum("own").alias("n_hit"))


def contamination(docs: DataFrame, items: DataFrame, n: int = WINDOW, slack: int = 0) -> DataFrame:
    """``doc_id, key, n_words, n_hit, items, contaminated`` per row of ``docs``; items: sorted ids as strings."""
    holders = stored(windows(items, n), "holders")
    wins = stored(sequences(holders), "items")
    n_wins, n_holders = wins.count(), holders.count()
    index = build_index(docs, vocabulary(wins), n_wins)
    found = matches(index, wins, n_wins, slack)
    lengths = stored(index.where(F.col("term").isNull()).select("doc_id", "key", F.col("pos").alias("n_words")), "lengths")
    discard(index, wins)
    hits = covered(found)
    of = hinted(holders.select("win", F.col("item_id").cast("string").alias("item")), n_holders, BROADCAST_ROWS)
    # a row meets an item once however many windows agree; the list is no longer than the benchmark
    ids = found.select("key", "win").distinct().join(of, "win").select("key", "item").distinct().groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("items"))
    out = lengths.join(hits.join(ids, "key"), "key", "left")
    empty = F.array().cast("array<string>")
    return out.select(
        "doc_id",
        "key",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", empty).alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    out = contamination(docs, items)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents),
i AS (SELECT item_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM benchmark),
iw AS (SELECT item_id, least(len(words), 10) AS n, unnest(list_transform(range(1, len(words) - least(len(words), 10) + 2), lambda a: array_to_string(words[a:a + least(len(words), 10) - 1], ' '))) AS win FROM i WHERE len(words) > 0),
dw AS (SELECT r, n, unnest(range(1, len(words) - n + 2)) AS pos, unnest(list_transform(range(1, len(words) - n + 2), lambda a: array_to_string(words[a:a + n - 1], ' '))) AS win
  FROM d, (SELECT DISTINCT n FROM iw) WHERE len(words) >= n),
m AS (SELECT DISTINCT r, item_id, pos, n FROM dw JOIN iw USING (n, win)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(pos, pos + n)) AS p FROM m) GROUP BY r),
s AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN s USING (r)
"""
