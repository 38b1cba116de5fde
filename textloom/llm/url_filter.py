"""URL filter: listed rules, and for other URLs a ratio of character language models.

One smoothed variable-order Markov model is counted from accepted URLs and one from
rejected URLs (those that a rule decides). A character's probability is interpolated over
contexts of 0 to 2 symbols: it is read at the longest order at which its n-gram was seen,
times what each longer context that was seen leaves to symbols that never followed it, so
that a model's probabilities of all symbols sum to 1 in every context. A URL's score is the
difference of its log-likelihoods per symbol, and the threshold is where the scores of
accepted and rejected URLs that were kept out of the counts would cross if they were
normally distributed.

Only DataFrame functions are used. URLs are written in the printable characters of ASCII,
A-Z lower-cased, and one symbol for all others, so a model has at most SIZE + SIZE^2 + SIZE^3
n-grams (about 380,000), whatever the input: it is counted over all URLs, and small enough to
be broadcast.

Defined cases: a null url, or one without "://", has an empty host and path and is scored
by its characters (a null like an empty one); without examples of both kinds all URLs
without a rule are allowed, as are those whose score is just the threshold; very long URLs
are scored whole; repeated rows are judged alike; empty tables give no rows; extra columns
are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import discard, stored

#: (rule, verdict). Fixed values of the contract.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Symbols: any other character, then the printable characters of ASCII without A-Z, then end and padding, which no URL holds.
PRINTED = "".join(chr(c) for c in range(32, 127) if not 65 <= c <= 90)
SIZE = len(PRINTED) + 3
OTHER, STOP, PAD = 0, SIZE - 2, SIZE - 1
ORDER = 3
#: Weight of the next shorter context.
ALPHA = 2.0
#: Of this many parts of the ruled URLs one is kept out of the counts, for the threshold.
PARTS = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` (A-Z lower-cased) and ``path``."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.lit(2**31 - 1))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": F.translate(host, UPPER, LOWER), "path": path})


def rule_of(rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits host and path, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, says in sorted(rules, key=lambda r: len(r[0])):
        host, _, path = name.partition("/")
        fits = ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(f"/{path}"))
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def symbols(url: Column) -> Column:
    """The URL in the symbols' numbers, with padding before and the end's symbol after."""
    plain = F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER)
    letters = F.filter(F.split(plain, "", -1), lambda c: c != "")
    own = F.transform(letters, lambda c: F.instr(F.lit(PRINTED), c))
    return F.concat(F.array(*[F.lit(PAD)] * (ORDER - 1)), own, F.array(F.lit(STOP)))


def grams(rows: DataFrame, url: str = "url") -> DataFrame:
    """One row per symbol: ``g``, the number of the ORDER symbols that end there (its remainders are the shorter n-grams), and ``_one``, how many symbols the URL has."""
    rows = rows.withColumn("_s", symbols(F.col(url)))
    at = F.sequence(F.lit(ORDER - 1), F.size("_s") - 1)

    def number(i: Column) -> Column:
        out = F.get("_s", i - (ORDER - 1))
        for k in range(ORDER - 2, -1, -1):
            out = out * SIZE + F.get("_s", i - k)
        return out

    # never empty; the outer form keeps the optimizer from computing the array twice for a filter on its size
    return rows.withColumn("_g", F.transform(at, number)).drop("_s").withColumn("_one", F.size("_g")).withColumn("g", F.explode_outer("_g")).drop("_g")


def model(ruled: DataFrame) -> DataFrame:
    """``order, g, ratio, left``: what was seen of 1 to ORDER symbols.

    ``ratio`` is log P(accepted) - log P(rejected) of an n-gram's last symbol. ``left`` is the
    same for all symbols that never came after ``g`` as a context of ``order`` symbols, on top
    of their ratio at the order below; order 0 has one row, with the ratio of symbols that
    never came at all. Rows are n-grams, contexts or both. ``ruled`` has url and verdict.
    """
    seen = grams(ruled.select("url", (F.col("verdict") == "allow").alias("ok"))).groupBy("g").agg(F.count_if(F.col("ok")).alias("a"), F.count_if(~F.col("ok")).alias("b"))
    seen = stored(seen, "url-grams")
    below, tables = None, []
    for k in range(1, ORDER + 1):
        counts = seen.groupBy((F.col("g") % SIZE**k).alias("g")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        around = W.partitionBy(F.floor(F.col("g") / SIZE))  # at order 1 the context is empty: SIZE rows
        counts = counts.withColumns({"na": F.sum("a").over(around), "nb": F.sum("b").over(around)})
        if below is None:
            table = counts.withColumns({f"p{x}": (F.col(x) + 1) / (F.col(f"n{x}") + SIZE) for x in "ab"})
            left = F.log((F.col("nb") + SIZE) / (F.col("na") + SIZE))
        else:
            shorter = below.select(F.col("g").alias("_g"), F.col("pa").alias("_pa"), F.col("pb").alias("_pb"))
            joined = counts.withColumn("_g", F.col("g") % SIZE ** (k - 1)).join(shorter, "_g")
            table = joined.withColumns({f"p{x}": (F.col(x) + ALPHA * F.col(f"_p{x}")) / (F.col(f"n{x}") + ALPHA) for x in "ab"})
            left = F.log((F.col("nb") + ALPHA) / (F.col("na") + ALPHA))
        below = table.select("g", "pa", "pb")
        tables.append(below.select(F.lit(k).alias("order"), "g", (F.log("pa") - F.log("pb")).alias("ratio"), F.lit(None).cast("double").alias("left")))
        contexts = counts.groupBy(F.floor(F.col("g") / SIZE).alias("g")).agg(F.first(left).alias("left"))
        tables.append(contexts.select(F.lit(k - 1).alias("order"), "g", F.lit(None).cast("double").alias("ratio"), "left"))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    out = out.groupBy("order", "g").agg(F.max("ratio").alias("ratio"), F.max("left").alias("left"))
    out = stored(out.coalesce(4), "url-model")
    discard(seen)
    return out


def scored(rows: DataFrame, ratios: DataFrame) -> DataFrame:
    """``rows`` (url and what must be kept with it) with ``score``, the mean log-likelihood ratio per symbol. A model's size is bounded by its alphabet."""
    keep = rows.columns
    out = grams(rows)
    for k in range(1, ORDER + 1):
        part = ratios.where(F.col("order") == k).select(F.col("g").alias(f"_g{k}"), F.col("ratio").alias(f"_r{k}"))
        out = out.withColumn(f"_g{k}", F.col("g") % SIZE**k).join(F.broadcast(part.where(F.col(f"_r{k}").isNotNull())), f"_g{k}", "left")
    for k in range(ORDER):
        part = ratios.where((F.col("order") == k) & F.col("left").isNotNull()).select(F.col("g").alias(f"_h{k}"), F.col("left").alias(f"_l{k}"))
        out = out.withColumn(f"_h{k}", F.floor(F.col("g") / SIZE) % SIZE**k).join(F.broadcast(part), f"_h{k}", "left")
    # from the longest order down: what was seen there, or what its context leaves, and the order below
    ratio = F.coalesce("_l0", F.lit(0.0))
    for k in range(1, ORDER + 1):
        left = F.coalesce(F.col(f"_l{k - 1}"), F.lit(0.0)) + ratio if k > 1 else ratio
        ratio = F.coalesce(F.col(f"_r{k}"), left)
    # repeated rows fall into one group and are told out again
    per = out.groupBy(*keep).agg(F.avg(ratio).alias("score"), F.count("*").alias("_all"), F.max("_one").alias("_one"))
    copies = F.sequence(F.lit(1), (F.col("_all") / F.col("_one")).cast("int"))
    return per.withColumn("_copy", F.explode(copies)).select(*keep, "score")


def threshold(ruled: DataFrame) -> float:
    """Where normal distributions of accepted and rejected scores are equally far in their own deviations."""
    good, bad = F.col("verdict") == "allow", F.col("verdict") == "block"
    row = ruled.agg(*(f(F.when(c, F.col("score"))) for c in (good, bad) for f in (F.avg, F.stddev_pop))).first()
    if row[0] is None or row[2] is None:
        return 0.0
    if not row[1] + row[3]:
        return (row[0] + row[2]) / 2
    return (row[0] * row[3] + row[2] * row[1]) / (row[1] + row[3])


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, url, host, path, rule, verdict, score`` for every row."""
    rule, verdict = rule_of(rules)
    rows = parsed(pages.select("page_id", "url")).withColumns({"rule": rule, "_verdict": verdict})
    held = F.pmod(F.xxhash64("url"), F.lit(PARTS)) == 0
    ruled = rows.where(F.col("_verdict").isNotNull()).select("url", F.col("_verdict").alias("verdict"))
    result = stored(scored(rows, model(ruled.where(~held))), "url-scores")
    known = result.where(F.col("_verdict").isNotNull()).withColumnRenamed("_verdict", "verdict")
    kinds = known.select("verdict").distinct().count()
    cut = threshold(known.where(held)) if kinds > 1 else float("-inf")
    says = F.coalesce("_verdict", F.when(F.col("score") >= cut, "allow").otherwise("block"))
    return result.select("page_id", "url", "host", "path", "rule", says.alias("verdict"), "score")


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")
