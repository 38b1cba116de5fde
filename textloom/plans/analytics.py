"""Queries: sessions, benchmark-result analytics, and relational coverage, with SQL counterparts."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.files import DURATIONS, counts_of, generate_corpus, histogram, length_rank
from ..streaming import sessions
from .ner import _greedy_sql, _p, _table

SESSION_LABELS, SESSION_AT, SESSION_WIDTH = ("person", "location"), 0.93, 3


def stream_sessions(spark, sf_dir):
    """Snapshots after every turn, each turn a chunk of its conversation's session; an error of a chunk fails the query."""
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("seq"), F.col("text").alias("chunk"))
    out = sessions.replay(rows, SESSION_LABELS, SESSION_AT, SESSION_WIDTH, math.inf)
    # the SQL has no column for an error, and a row without entities must not stand for one
    out = out.withColumn("entities", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast(out.schema["entities"].dataType)).otherwise(F.col("entities")))
    text = F.array_join(F.transform("entities", lambda e: F.concat_ws(":", e["type"], e["start"].cast("string"), e["end"].cast("string"))), ",")
    return out.select("session_id", "seq", F.size("entities").cast("long").alias("n"), F.col("input_tokens").cast("long").alias("input_tokens"), F.md5(text.cast("binary")).alias("spans_md5"))


STREAM_SESSIONS = rf"""WITH tx AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations),
cm AS (SELECT *, string_agg(text, '') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS whole,
  coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM tx),
px AS (SELECT conv_id, turn, whole, base, unnest(ps) AS piece, generate_subscripts(ps, 1) AS k FROM (SELECT *, regexp_extract_all(text, '[\s\x0B]+|\w+(?:[-_]\w+)*|[^\s\x0B]') AS ps FROM cm)),
pc AS (SELECT *, base + sum(length(piece)) OVER (PARTITION BY conv_id, turn ORDER BY k) AS e FROM px),
wd AS (SELECT conv_id, turn, whole, e - length(piece) AS s, e, row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) - 1 AS i FROM pc WHERE NOT regexp_matches(piece, '^[\s\x0B]')),
sp AS (SELECT a.conv_id, a.i AS first, b.i AS last, a.s AS start_, b.e AS end_, substr(a.whole, (a.s + 1)::BIGINT, (b.e - a.s)::BIGINT) AS surface FROM wd a JOIN wd b ON a.conv_id = b.conv_id AND b.i BETWEEN a.i AND a.i + {SESSION_WIDTH - 1}),
sc AS (SELECT *, {_p("l.name", "surface")} AS p FROM sp, (VALUES (0, 'person'), (1, 'location')) l(k, name)),
tn AS (SELECT conv_id, turn, (SELECT count(*) FROM wd w WHERE w.conv_id = t.conv_id AND w.turn <= t.turn) AS total FROM tx t),
ca AS (SELECT t.conv_id, t.turn, (first * 100000 + last) * 10 + k AS ord, name AS label, first, last, start_, end_, p FROM tn t JOIN sc ON sc.conv_id = t.conv_id AND sc.last < t.total WHERE p > {SESSION_AT}),{_greedy_sql(lo="first", hi="last", cmp="<=")},
ag AS (SELECT conv_id, turn, count(*) AS n, string_agg(label || ':' || start_::BIGINT || ':' || end_::BIGINT, ',' ORDER BY first) AS t FROM gr GROUP BY ALL)
SELECT CAST(n2.conv_id AS VARCHAR) AS session_id, n2.turn AS seq, coalesce(n, 0) AS n, CASE WHEN total > 0 THEN total + 5 ELSE 0 END AS input_tokens, md5(coalesce(t, '')) AS spans_md5 FROM tn n2 LEFT JOIN ag USING (conv_id, turn)"""


#: Labels that turns of a role ask for, and the threshold.
ASKS, CLASS_AT = {"user": ("refund", "question", "praise"), "assistant": ("polite", "short")}, 0.7


def session_classes(spark, sf_dir):
    """Each turn is a chunk of its conversation's session and asks for the labels of its role, of all text so far."""
    labels = F.lit(None).cast("array<string>")
    for role, names in ASKS.items():
        labels = F.when(F.col("role") == role, F.array(*map(F.lit, names))).otherwise(labels)
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("seq"), F.col("text").alias("chunk"), labels.alias("labels"))
    out = sessions.replay_classes(rows, CLASS_AT)
    found = F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast(out.schema["classes"].dataType)).otherwise(F.col("classes"))
    out = out.withColumn("classes", found)
    return out.select("session_id", "seq", F.size("classes").cast("long").alias("n"), F.col("tokens").cast("long").alias("tokens"), F.array_join(F.col("classes.label"), ",").alias("labels"), F.round(F.get("classes", F.lit(0))["p"], 6).alias("best_p"))


_ASKS = ", ".join(f"('{role}', {k}, '{name}')" for role, names in ASKS.items() for k, name in enumerate(names))
SESSION_CLASSES = rf"""WITH tx AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
cm AS (SELECT *, string_agg(text, '') OVER w AS so_far, sum(len(regexp_extract_all(text, '\w+(?:[-_]\w+)*|[^\s]'))) OVER w AS tokens FROM tx WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT conv_id, turn, l.k, l.name, 1 / (1 + exp(-4.0::DOUBLE * {_p("l.name", "so_far")})) AS p FROM cm JOIN (VALUES {_ASKS}) l(role, k, name) USING (role)),
a AS (SELECT conv_id, turn, count(*) AS n, string_agg(name, ',' ORDER BY p DESC, k) AS labels, max(p) AS best FROM p WHERE p >= {CLASS_AT} GROUP BY ALL)
SELECT conv_id::VARCHAR AS session_id, turn AS seq, CASE WHEN role IN ({", ".join(f"'{r}'" for r in ASKS)}) THEN coalesce(n, 0) END AS n, tokens::BIGINT AS tokens,
  CASE WHEN role IN ({", ".join(f"'{r}'" for r in ASKS)}) THEN coalesce(labels, '') END AS labels, round(best, 6) AS best_p FROM cm LEFT JOIN a USING (conv_id, turn)"""


def _results(spark, sf_dir):
    """Line items read as benchmark rows: price is a time, line number a batch, and so on."""
    rows = _table(spark, sf_dir, "lineitem")
    lengths = F.array(*map(F.lit, ("tiny", "short", "medium", "long", "mixed")))
    return rows.select(
        F.pow(F.lit(2), F.col("l_orderkey") % 4).cast("int").alias("cpus"),
        F.col("l_returnflag").alias("profile"),
        F.element_at(lengths, (F.col("l_partkey") % 5 + 1).cast("int")).alias("textLength"),
        F.col("l_linenumber").cast("int").alias("batchSize"),
        F.col("l_linestatus").alias("run"),
        F.col("l_extendedprice").cast("double").alias("score_ms"),
    )


_JMH = """b AS (SELECT (2 ** (l_orderkey % 4))::INT AS cpus, l_returnflag AS profile, ['tiny', 'short', 'medium', 'long', 'mixed'][(l_partkey % 5 + 1)::INT] AS textLength, l_linenumber::INT AS batchSize, l_linestatus AS run, l_extendedprice::DOUBLE AS score_ms FROM lineitem)"""


def bench_summary(spark, sf_dir):
    rows = _results(spark, sf_dir).withColumn("per_text_ms", F.try_divide(F.col("score_ms"), F.col("batchSize")))
    stats = [F.min, F.median, F.avg, F.max]
    return rows.groupBy("profile", "textLength").agg(F.min(length_rank(F.col("textLength"))).cast("long").alias("rank"), *(F.round(f("per_text_ms"), 4).alias(n) for f, n in zip(stats, ("least", "median", "mean", "most"), strict=True)))


BENCH_SUMMARY = f"""WITH {_JMH} SELECT profile, textLength, CAST(nullif(list_position(['tiny', 'short', 'medium', 'long'], textLength), 0) AS BIGINT) AS rank, round(min(score_ms / batchSize), 4) AS least, round(median(score_ms / batchSize), 4) AS median, round(avg(score_ms / batchSize), 4) AS mean, round(max(score_ms / batchSize), 4) AS most FROM b GROUP BY ALL"""


def bench_pivot(spark, sf_dir):
    """CPU scaling: mean times by CPUs, and how much faster than with one."""
    wide = _results(spark, sf_dir).groupBy("profile", "textLength").pivot("cpus", [1, 2, 4, 8]).agg(F.avg("score_ms"))
    return wide.select("profile", "textLength", *(F.round(F.try_divide(F.col("1"), F.col(str(c))), 6).alias(f"speedup_{c}") for c in (2, 4, 8)))


BENCH_PIVOT = f"""WITH {_JMH}, w AS (SELECT profile, textLength, avg(score_ms) FILTER (WHERE cpus = 1) AS c1, avg(score_ms) FILTER (WHERE cpus = 2) AS c2, avg(score_ms) FILTER (WHERE cpus = 4) AS c4, avg(score_ms) FILTER (WHERE cpus = 8) AS c8 FROM b GROUP BY ALL)
SELECT profile, textLength, round(c1 / c2, 6) AS speedup_2, round(c1 / c4, 6) AS speedup_4, round(c1 / c8, 6) AS speedup_8 FROM w"""


def bench_delta(spark, sf_dir):
    """Two runs side by side on their common keys, and the mean change per profile."""
    keys = ["profile", "textLength", "batchSize", "cpus"]
    wide = _results(spark, sf_dir).groupBy(*keys).pivot("run", ["F", "O"]).agg(F.avg("score_ms"))
    delta = wide.where("F IS NOT NULL AND O IS NOT NULL").withColumn("delta_pct", 100 * (F.col("O") - F.col("F")) / F.col("F"))
    return delta.groupBy("profile").agg(F.count("*").alias("n"), F.round(F.avg("delta_pct"), 6).alias("mean_delta_pct"))


BENCH_DELTA = f"""WITH {_JMH}, w AS (SELECT profile, textLength, batchSize, cpus, avg(score_ms) FILTER (WHERE run = 'F') AS f, avg(score_ms) FILTER (WHERE run = 'O') AS o FROM b GROUP BY ALL)
SELECT profile, count(*) AS n, round(avg(100 * (o - f) / f), 6) AS mean_delta_pct FROM w WHERE f IS NOT NULL AND o IS NOT NULL GROUP BY profile"""


def bench_extremes(spark, sf_dir):
    """The five fastest and the five slowest settings, by mean time a text."""
    per = _results(spark, sf_dir).groupBy("profile", "textLength", "batchSize", "cpus").agg(F.avg(F.col("score_ms") / F.col("batchSize")).alias("v"))
    order = ["profile", "textLength", "batchSize", "cpus"]
    fast, slow = per.orderBy("v", *order).limit(5), per.orderBy(F.desc("v"), *order).limit(5)
    out = fast.withColumn("side", F.lit("fastest")).unionByName(slow.withColumn("side", F.lit("slowest")))
    return out.select("side", "profile", "textLength", "batchSize", "cpus", F.round("v", 4).alias("v"))


BENCH_EXTREMES = f"""WITH {_JMH}, p AS (SELECT profile, textLength, batchSize, cpus, avg(score_ms / batchSize) AS v FROM b GROUP BY ALL)
(SELECT 'fastest' AS side, profile, textLength, batchSize, cpus, round(v, 4) AS v FROM p ORDER BY p.v, profile, textLength, batchSize, cpus LIMIT 5) UNION ALL (SELECT 'slowest', profile, textLength, batchSize, cpus, round(v, 4) FROM p ORDER BY p.v DESC, profile, textLength, batchSize, cpus LIMIT 5)"""


def corpus_generated(spark, sf_dir):
    return generate_corpus(_table(spark, sf_dir, "documents").select("doc_id", "text"), 64)


def metrics_by_operation(spark, sf_dir):
    """Turns as calls of an operation each: their words' number stands for a time, and what they find are words of capitals."""
    rows = _table(spark, sf_dir, "conversations").select(F.col("role").alias("operation"), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\b[A-Z]\w*"), F.lit(0)).alias("found"), F.length("text").cast("double").alias("ms"))
    spread = histogram(rows, ["operation"], "ms")
    totals = rows.groupBy("operation").agg(*counts_of("found"))
    return spread.join(totals, "operation").withColumn("text_count", F.col("text_count").cast("long")).withColumn("result_count", F.col("result_count").cast("long"))


METRICS = rf"""WITH r AS (SELECT role AS operation, len(regexp_extract_all(coalesce(text, ''), '\b[A-Z]\w*')) AS found, length(text)::DOUBLE AS ms FROM conversations),
b AS (SELECT operation, len(list_filter({[float(x) for x in DURATIONS]}, lambda x: x < ms)) AS bucket FROM r WHERE ms IS NOT NULL),
h AS (SELECT operation, bucket, count(*) AS n FROM b GROUP BY ALL), t AS (SELECT operation, count(*) AS text_count, sum(found)::BIGINT AS result_count FROM r GROUP BY ALL)
SELECT operation, bucket, ({[float(x) for x in DURATIONS]})[bucket + 1]::DOUBLE AS upto_ms, n, text_count, result_count FROM h JOIN t USING (operation)"""


def sql_query(text: str):
    """The same text runs in either engine; Catalyst plans it."""

    def run(spark, sf_dir):
        for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels"):
            _table(spark, sf_dir, name).createOrReplaceTempView(name)
        return spark.sql(text)

    return run


RELATIONAL = {
    "rel_pricing": """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS disc
FROM lineitem GROUP BY l_returnflag, l_linestatus""",
    "rel_star_join": """SELECT n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""",
    "rel_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "rel_semi_anti": """SELECT count(*) AS n, 'with' AS kind FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) UNION ALL
SELECT count(*), 'without' FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""",
    "rel_set_ops": "(SELECT l_suppkey % 50 AS k FROM lineitem INTERSECT SELECT s_suppkey % 50 FROM supplier) EXCEPT SELECT p_partkey % 7 FROM part",
    "rel_lag": """SELECT event_type, count(*) AS n, sum(CASE WHEN prev = event_type THEN 1 ELSE 0 END) AS same FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) t GROUP BY event_type""",
    "rel_top_per_group": """SELECT o_custkey, o_orderkey, rnk FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rnk FROM orders) t WHERE rnk <= 2""",
}


def queries() -> dict:
    return {
        "stream_sessions": stream_sessions,
        "session_classes": session_classes,
        "metrics_by_operation": metrics_by_operation,
        "bench_summary": bench_summary,
        "bench_pivot": bench_pivot,
        "bench_delta": bench_delta,
        "bench_extremes": bench_extremes,
        "corpus_generated": corpus_generated,
    } | {name: sql_query(text) for name, text in RELATIONAL.items()}


def oracle_sql() -> dict[str, str]:
    return {
        "stream_sessions": STREAM_SESSIONS,
        "session_classes": SESSION_CLASSES,
        "metrics_by_operation": METRICS,
        "bench_summary": BENCH_SUMMARY,
        "bench_pivot": BENCH_PIVOT,
        "bench_delta": BENCH_DELTA,
        "bench_extremes": BENCH_EXTREMES,
    } | RELATIONAL
