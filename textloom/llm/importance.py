"""Resampling towards a target distribution by importance weights of hashed word n-grams.

Both corpora are counted in ``BUCKETS`` buckets of features; each bucket's gain is the
scaled log of its share in the target over that in the source. A document's weight is the
mean gain of its features, and Gumbel noise that depends on its id alone turns the highest
scores into a draw without replacement.

A document's buckets are one array made by higher-order functions, and its weight an
aggregate over a literal array of all gains: no row per feature is made to score. Counting
takes stored buckets apart within a task, where partial sums leave at most ``BUCKETS`` rows, so that
only totals are shuffled. The totals are the only thing that the driver holds.

Ranks come from the number of rows above each score: scores are integers in a range that the
gains bound, so that there are few of them however many rows there are, and only rows that
share a score are sorted together.

Defined cases: null, empty and wordless texts have no features, weight 0 and stay undrawn;
very long texts are read whole, a bucket a feature; a null doc_id draws its noise from the
empty id and comes last among ties; repeated rows are scored alike and ranked one after
another; rows that tie in score and id are ordered by weight, features and words; an empty
target has no features, so that every gain compares with even shares; an empty table gives
no rows; extra columns are not used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import discard, stored
from .common import let
from .decontaminate import LOWER, UPPER

#: Characters that end a word of a lower-cased text. Fixed values.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
#: Words of the longest feature; words that a document needs to be drawn; percent drawn; seed of the noise.
NGRAM, LEAST_WORDS, PERCENT, SEED = 2, 20, 25, 7
#: Scores that are counted together before their order is summed up.
COARSE = 64


def words(text: Column) -> Column:
    """Words after lower-casing A-Z; null has none."""
    text = F.coalesce(text, F.lit(""))
    # full lower-casing agrees with that of A-Z where a character is a byte
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, BETWEEN, -1), "")


def buckets(found: Column, n: int = NGRAM, count: int = BUCKETS) -> Column:
    """The bucket of every run of 1 to ``n`` words of ``found``, repeats included."""
    place = lambda feature: F.pmod(F.crc32(feature), F.lit(count)).cast("int")
    runs, out = found, [F.transform(found, place)]
    for k in range(1, n):
        left = F.greatest(F.size(found) - k, F.lit(0))
        runs = F.zip_with(F.slice(runs, 1, left), F.slice(found, k + 1, left), lambda a, b: F.concat(a, F.lit(" "), b))
        out.append(F.transform(runs, place))
    return F.concat(*out)


def totals(rows: DataFrame, count: int = BUCKETS) -> list[int]:
    """How many features of all ``rows`` (buckets) lie in each bucket; at most ``count`` rows come from any task."""
    # the outer form keeps the optimizer from making the array twice for a filter on its size
    found = rows.select(F.explode_outer("buckets").alias("b")).where("b IS NOT NULL").groupBy("b").agg(F.count("*").alias("n"))
    out = [0] * count
    for r in found.collect():
        out[r["b"]] = r["n"]
    return out


def gains(target: list[int], source: list[int]) -> list[int]:
    """floor(1000 ln of the smoothed share in the target over that in the source) of each bucket."""
    k, wide, narrow = float(len(target)), float(sum(source)), float(sum(target))
    return [math.floor(1000 * math.log((t + 1.0) * (wide + k) / ((s + 1.0) * (narrow + k)))) for t, s in zip(target, source, strict=True)]


def weight(found: Column, gain: list[int]) -> Column:
    """Floored mean gain of the buckets in ``found``; 0 without any."""
    # folded into one literal array when the plan is made
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")
    total = F.aggregate(found, F.lit(0).cast("bigint"), lambda acc, b: acc + F.element_at(table, b + 1))
    n = F.size(found).cast("bigint")
    return F.when(n > 0, let(total, lambda t: (t - F.pmod(t, n)) / n)).otherwise(0).cast("bigint")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 times standard Gumbel noise) of an id."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    h = F.conv(head, 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def scored(docs: DataFrame, target: DataFrame, n: int = NGRAM, seed: int = SEED) -> DataFrame:
    """Stored ``doc_id, n_words, n_features, weight, score`` per row of ``docs`` (doc_id, text), towards the texts of ``target``.

    The arrays of buckets are written once, two bytes a feature or so, and read to count and to score.
    """
    cut = lambda rows: rows.withColumn("words", words(F.col("text"))).withColumn("buckets", buckets(F.col("words"), n))
    rows = stored(cut(docs.select("doc_id", "text")).select("doc_id", F.size("words").alias("n_words"), "buckets"), "buckets")
    gain = gains(totals(cut(target.select("text"))), totals(rows))
    out = rows.select("doc_id", "n_words", F.size("buckets").cast("bigint").alias("n_features"), weight(F.col("buckets"), gain).alias("weight"))
    out = stored(out.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    discard(rows)
    return out


def ranked(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``rows`` (doc_id, n_words, n_features, weight, score), stored ones, with ``rank``: 1, 2, ... of those drawn, else null.

    ``percent`` of the rows with at least ``least_words`` words are drawn, highest scores first.
    """
    able = rows.where(F.col("n_words") >= least_words)
    sizes = able.groupBy("score").agg(F.count("*").alias("n")).withColumn("coarse", F.floor(F.col("score") / COARSE))
    # one row for each COARSE scores; their range is bounded by the gains and the noise
    groups = sizes.groupBy("coarse").agg(F.sum("n").alias("size"))
    above = W.orderBy(F.desc("coarse")).rowsBetween(W.unboundedPreceding, -1)
    groups = groups.select("coarse", F.coalesce(F.sum("size").over(above), F.lit(0)).alias("before"), F.sum("size").over(W.partitionBy()).alias("all"))
    within = W.partitionBy("coarse").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.withColumn("inside", F.coalesce(F.sum("n").over(within), F.lit(0))).join(groups, "coarse")
    starts = starts.select("score", (F.col("before") + F.col("inside")).alias("before"), F.expr(f"({percent} * all) DIV 100").alias("drawn"))
    starts = stored(starts.where("before < drawn"), "starts")
    # as few rows as there are scores
    some = able.join(F.broadcast(starts), "score")
    order = W.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), F.desc("weight"), "n_features", "n_words")
    rank = F.col("before") + F.row_number().over(order)
    out = some.withColumn("rank", F.when(rank <= F.col("drawn"), rank).cast("bigint")).select(*rows.columns, "rank")
    able_and_high = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    low = rows.where(able_and_high).join(F.broadcast(starts.select("score")), "score", "left_anti")
    few = rows.where(~able_and_high)
    return out.unionByName(low.unionByName(few).select(*rows.columns).withColumn("rank", F.lit(None).cast("bigint")))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    return ranked(scored(docs, target)).select("doc_id", "n_features", "weight", "score", "rank")


SQL = r"""
WITH RECURSIVE
bits(i, k, x) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT i, k + 1, xor(x >> 1, (x & 1) * 3988292384) FROM bits WHERE k < 8),
crc AS (SELECT list(x ORDER BY i) AS tab FROM bits WHERE k = 8),
t AS (SELECT 'd' AS kind, doc_id, text FROM documents UNION ALL SELECT 'b', NULL, text FROM benchmark),
w AS (SELECT kind, row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM t),
f AS (SELECT r, kind, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM w),
g AS (SELECT kind, r, f, count(*) AS n FROM f GROUP BY ALL),
u AS (SELECT DISTINCT f FROM g),
c AS (SELECT f, xor(list_reduce(list_transform(range(length(hex(encode(f))) // 2), lambda i: CAST('0x' || substr(hex(encode(f)), 2 * i + 1, 2) AS BIGINT)),
    lambda acc, y: xor(acc >> 8, tab[1 + (xor(acc, y) & 255)]), 4294967295::BIGINT), 4294967295) % 10000 AS b FROM u, crc),
p AS (SELECT kind, r, b, n FROM g JOIN c USING (f)),
s AS (SELECT b, sum(n) FILTER (kind = 'd') AS s, sum(n) FILTER (kind = 'b') AS t FROM p GROUP BY b),
z AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s, coalesce(sum(t), 0)::DOUBLE AS t FROM s),
a AS (SELECT b, CAST(floor(1000 * ln((coalesce(s.t, 0) + 1)::DOUBLE * (z.s + 10000) / ((coalesce(s.s, 0) + 1)::DOUBLE * (z.t + 10000)))) AS BIGINT) AS gain FROM s, z),
m AS (SELECT r, sum(n) AS n_features, CAST(floor(sum(n * gain) / sum(n)) AS BIGINT) AS weight FROM p JOIN a USING (b) WHERE kind = 'd' GROUP BY r),
e AS (SELECT doc_id, len(ws) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) + 0.5)::DOUBLE / 4294967296))) AS BIGINT) AS score FROM w LEFT JOIN m USING (r) WHERE kind = 'd'),
o AS (SELECT *, n_words >= 20 AS able, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS k, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND k <= 25 * n // 100 THEN k END AS rank FROM o
"""
