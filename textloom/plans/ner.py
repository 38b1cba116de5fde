"""Queries: words, entities and their decoders, with SQL counterparts.

Scores come from ``HashScorer``, so that SQL can follow them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import spans as S
from ..operators.scorer import HashScorer

HASH = HashScorer()
ENTITIES = ("person", "location", "organization")
AT, WIDTH = 0.9, 4


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tasks a core where work per row is dear: with about one each, cores wait for the last.
WAVES = 4


def _spread(rows):
    """``rows`` over ``WAVES`` tasks a core where their files make fewer partitions than that; larger tables stay as they are."""
    tasks = WAVES * rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(tasks) if rows.rdd.getNumPartitions() < tasks else rows


def tokenize(how: T.Preset):
    def run(spark, sf_dir):
        rows = T.with_words(_spread(_table(spark, sf_dir, "documents").select("doc_id", "text")), how)
        total = lambda f: F.aggregate("words", F.lit(0).cast("long"), lambda s, w: s + w[f])
        return rows.select("doc_id", F.size("words").cast("long").alias("n_words"), total("s").alias("start_sum"), total("e").alias("end_sum"), F.md5(F.array_join(F.transform("words", lambda w: w["w"]), " ").cast("binary")).alias("words_md5"))

    return run


#: Unicode's word characters, and white space, as RE2 writes them.
_W, _SP = r"[\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}\x{200C}\x{200D}]", r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"
_RE = {
    "ascii": r"[\s\x0B]+|\w+(?:[-_]\w+)*|[^\s\x0B]",
    "unicode": rf"{_SP}+|{_W}+(?:[-_]{_W}+)*|[^\s\x0B\x{{85}}\p{{Z}}]",
    "web": rf"(?i){_SP}+|(?:https?://[^\s\x0B\x{{85}}\p{{Z}}]+|www\.[^\s\x0B\x{{85}}\p{{Z}}]+)|[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{{2,}}|@[a-z0-9_]+|{_W}+(?:[-_]{_W}+)*|[^\s\x0B\x{{85}}\p{{Z}}]",
}


def _words_sql(source: str, key: str, kind: str = "ascii") -> str:
    """CTEs ``pc`` (pieces with ends) and ``wd`` (words, numbered from 0)."""
    return rf"""
pa AS (SELECT {key}, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_RE[kind]}') AS ps FROM {source}),
px AS (SELECT {key}, unnest(ps) AS piece, generate_subscripts(ps, 1) AS k FROM pa),
pc AS (SELECT *, sum(length(piece)) OVER (PARTITION BY {key} ORDER BY k)::BIGINT AS e FROM px),
wd AS (SELECT {key}, piece AS w, k, e - length(piece) AS s, e, row_number() OVER (PARTITION BY {key} ORDER BY k) - 1 AS i FROM pc WHERE NOT regexp_matches(piece, '^{_SP}'))"""


def _tokenize_sql(kind: str, lower: bool = False, period: bool = False) -> str:
    word = "lower(w)" if lower else "w"
    dot = "UNION ALL SELECT doc_id, '.', length(text), length(text), 1000000000 FROM pa WHERE doc_id IN (SELECT doc_id FROM wd) AND text NOT SIMILAR TO '(?s).*[.!?]'" if period else ""
    return f"""WITH {_words_sql("documents", "doc_id", kind)},
al AS (SELECT doc_id, {word} AS w, s, e, i FROM wd {dot})
SELECT d.doc_id, count(w) AS n_words, coalesce(sum(s), 0)::BIGINT AS start_sum, coalesce(sum(e), 0)::BIGINT AS end_sum, md5(coalesce(string_agg(w, ' ' ORDER BY i), '')) AS words_md5
FROM documents d LEFT JOIN al USING (doc_id) GROUP BY d.doc_id"""


def _p(label: str, surface: str) -> str:
    return f"(('0x' || substr(md5({label} || '|' || {surface}), 1, 6))::BIGINT / 16777215.0)"


def _cands_sql(names, width: int = WIDTH, at: float = AT, source: str = "conversations", key: str = "conv_id, turn") -> str:
    """CTE ``ca``: candidates with p >= at."""
    using = key
    values = ", ".join(f"({i}, '{n}')" for i, n in enumerate(names))
    return f"""WITH {_words_sql(source, key)},
sp AS (SELECT a.*, b.i AS last, b.e AS fin, array_to_string(list_slice(q.ps, a.k, b.k), '') AS surface
  FROM wd a JOIN wd b USING ({using}) JOIN pa q USING ({using}) WHERE b.i BETWEEN a.i AND a.i + {width - 1}),
ca AS (SELECT {key}, (l.k * 1000000 + i) * 100 + last - i AS ord, l.name AS label, i AS first, last, s AS start_, fin AS end_, surface, {_p("l.name", "surface")} AS p
  FROM sp, (VALUES {values}) l(k, name) WHERE {_p("l.name", "surface")} >= {at})"""


def _greedy_sql(key: str = "conv_id, turn", lo: str = "start_", hi: str = "end_", cmp: str = "<", source: str = "ca") -> str:
    """CTE ``gr``: what the greedy choice keeps."""
    return f"""
li AS (SELECT {key}, list({{'s': {lo}, 'e': {hi}, 'o': ord}} ORDER BY p DESC, ord) AS xs FROM {source} GROUP BY {key}),
ke AS (SELECT {key}, unnest(list_reduce(list_transform(xs, lambda x: [x]), lambda acc, x:
  CASE WHEN len(list_filter(acc, lambda a: a.s {cmp} x[1].e AND x[1].s {cmp} a.e)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS x FROM li),
gr AS (SELECT c.* FROM {source} c JOIN (SELECT {key}, x.o AS ord FROM ke) USING ({key}, ord))"""


def _chats(spark, sf_dir):
    return T.with_words(_spread(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")))


def _found(spark, sf_dir):
    rows = S.candidates(_chats(spark, sf_dir), ENTITIES, HASH, AT, WIDTH)
    return S.greedy_many(rows)


def ner_greedy(spark, sf_dir):
    out = S.exploded(_found(spark, sf_dir), ["conv_id", "turn"])
    return out.withColumn("confidence", F.round("confidence", 6)).withColumns({c: F.col(c).cast("long") for c in ("start", "end")})


NER_GREEDY = f"""{_cands_sql(ENTITIES)},{_greedy_sql()}
SELECT conv_id, turn, label AS type, surface AS text, round(p, 6) AS confidence, start_ AS start, end_ AS "end" FROM gr"""


def ner_by_type(spark, sf_dir):
    out = S.exploded(_found(spark, sf_dir), ["conv_id", "turn"])
    return out.groupBy("type").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.min("start").cast("long").alias("first_start"))


NER_BY_TYPE = f"{_cands_sql(ENTITIES)},{_greedy_sql()} SELECT label AS type, count(*) AS n, round(avg(p), 6) AS mean_confidence, min(start_) AS first_start FROM gr GROUP BY label"


def ner_all_types(spark, sf_dir):
    rows = _found(spark, sf_dir).select("conv_id", "turn", F.explode(S.all_types(F.col("cands"), ENTITIES)).alias("type", "spans"))
    return rows.select("conv_id", "turn", "type", F.size("spans").cast("long").alias("n"))


NER_ALL_TYPES = f"""{_cands_sql(ENTITIES)},{_greedy_sql()}
SELECT c.conv_id, c.turn, l.name AS type, count(g.label) AS n FROM conversations c CROSS JOIN (VALUES ('person'), ('location'), ('organization')) l(name)
LEFT JOIN gr g ON g.conv_id = c.conv_id AND g.turn = c.turn AND g.label = l.name GROUP BY ALL"""


def ner_documents(spark, sf_dir):
    """Whole documents, however long: spans scored many at once, and the greedy choice in linear time."""
    rows = _spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = S.greedy_many(S.candidates_many(rows, ("person", "location"), HASH, 0.99, 3))
    out = S.exploded(rows, ["doc_id"])
    return out.groupBy("doc_id", "type").agg(F.count("*").alias("n"), F.sum("start").cast("long").alias("start_sum"), F.round(F.max("confidence"), 6).alias("best"))


NER_DOCUMENTS = f"""{_cands_sql(("person", "location"), 3, 0.99, "documents", "doc_id")},{_greedy_sql("doc_id")}
SELECT doc_id, label AS type, count(*) AS n, sum(start_)::BIGINT AS start_sum, round(max(p), 6) AS best FROM gr GROUP BY ALL"""


def ner_overrides(spark, sf_dir):
    """Labels as query data: each role asks for its own."""
    rows = _spread(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    names = F.when(F.col("role") == "user", F.array(F.lit("person"), F.lit("product"))).otherwise(F.array(F.lit("date")))
    rows = S.candidates(T.with_words(rows), names, HASH, AT, WIDTH)
    out = S.exploded(S.greedy_many(rows), ["conv_id", "turn"])
    return out.groupBy("conv_id", "type").agg(F.count("*").alias("n"))


NER_OVERRIDES = f"""{_cands_sql(("person", "product", "date"))},
cb AS (SELECT ca.* FROM ca JOIN conversations c USING (conv_id, turn) WHERE CASE WHEN role = 'user' THEN label IN ('person', 'product') ELSE label = 'date' END),{_greedy_sql(source="cb")}
SELECT conv_id, label AS type, count(*) AS n FROM gr GROUP BY ALL"""


def ner_gated(spark, sf_dir):
    """Count gate and abstention before the greedy choice, and before any span is scored that they rule out."""
    counts = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: HASH.score(F.concat(F.lit("count:"), k.cast("string")), F.col("text")))
    nulls = F.transform(S.labels_of(ENTITIES), lambda x: F.struct(x.alias("label"), HASH.score(F.concat(F.lit("null:"), x), F.col("text")).alias("p")))
    rows = _chats(spark, sf_dir).withColumn("_counts", counts).withColumn("_nulls", nulls)
    asked = F.transform(S.labels_of(ENTITIES), lambda x: F.struct(x.alias("label")))
    rows = rows.withColumn("_asked", S.not_abstained(S.gated(asked, F.col("_counts")), F.col("_nulls"), 0.5))
    rows = S.candidates(rows, F.transform("_asked", lambda x: x["label"]), HASH, AT, WIDTH)
    out = S.exploded(S.greedy_many(rows), ["conv_id", "turn"])
    return out.groupBy("conv_id", "turn", "type").agg(F.count("*").alias("n"))


NER_GATED = f"""{_cands_sql(ENTITIES)},
cn AS (SELECT conv_id, turn FROM (SELECT conv_id, turn, k, {_p("'count:' || k", "text")} AS v FROM conversations, range(4) r(k)) QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY v DESC, k) = 1 AND k > 0),
cb AS (SELECT ca.* FROM ca JOIN cn USING (conv_id, turn) JOIN conversations c USING (conv_id, turn) WHERE NOT {_p("'null:' || label", "c.text")} > 0.5),{_greedy_sql(source="cb")}
SELECT conv_id, turn, label AS type, count(*) AS n FROM gr GROUP BY ALL"""


def bio_spans(spark, sf_dir):
    rows = S.bio(_chats(spark, sf_dir), ("person", "location"), 0.6, HASH)
    out = S.exploded(rows.withColumn("cands", S.greedy(F.col("cands"))), ["conv_id", "turn"])
    return out.select("conv_id", "turn", "type", "text", F.round("confidence", 6).alias("confidence"), F.col("start").cast("long").alias("start"))


BIO_SPANS = f"""WITH {_words_sql("conversations", "conv_id, turn")},
sc AS (SELECT wd.*, l.k AS lk, l.name AS label, {_p("l.name || ':start:' || i", "w")} AS a, {_p("l.name || ':inside:' || i", "w")} AS m, {_p("l.name || ':end:' || i", "w")} AS z FROM wd, (VALUES (0, 'person'), (1, 'location')) l(k, name)),
rn AS (SELECT *, coalesce(min(CASE WHEN m < 0.6 THEN i END) OVER (PARTITION BY conv_id, turn, label ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1000000000) AS stop FROM sc),
ca AS (SELECT b.conv_id, b.turn, (b.i * 10 + b.lk) * 100000 + c.i AS ord, b.label, b.s AS start_, c.e AS end_, b.k AS k0, c.k AS k1,
  least(b.a, c.z, (SELECT min(x.m) FROM rn x WHERE x.conv_id = b.conv_id AND x.turn = b.turn AND x.label = b.label AND x.i BETWEEN b.i AND c.i)) AS p
  FROM rn b JOIN rn c ON b.conv_id = c.conv_id AND b.turn = c.turn AND b.label = c.label AND c.i >= b.i AND c.i < b.stop WHERE b.a >= 0.6 AND c.z >= 0.6),{_greedy_sql()}
SELECT conv_id, turn, label AS type, array_to_string(list_slice(ps, k0, k1), '') AS text, round(p, 6) AS confidence, start_ AS start FROM gr JOIN pa USING (conv_id, turn)"""


def wis_spans(spark, sf_dir):
    rows = S.candidates(_chats(spark, sf_dir), ("person", "location"), HASH, 0.95, WIDTH)
    out = S.exploded(S.scheduled(rows), ["conv_id", "turn"])
    return out.select("conv_id", "turn", "type", T.stripped(F.col("text")).alias("text"), F.round("confidence", 6).alias("confidence"), "start", "end").where("text <> ''")


def token_stats(spark, sf_dir):
    """Usage of a prompt of 11 tokens: prompt and words, nothing for texts that aren't run; totals by quality."""
    rows = T.with_words(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    usage = F.when(T.is_blank(F.col("text")) | (F.size("words") == 0), 0).otherwise(F.size("words") + 11)
    joined = rows.select("doc_id", usage.cast("long").alias("input_tokens")).join(_table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.groupBy("quality").agg(F.count("*").alias("n_docs"), F.sum("input_tokens").alias("input_tokens"))


TOKEN_STATS = f"""WITH {_words_sql("documents", "doc_id")}, n AS (SELECT doc_id, count(*) AS n FROM wd GROUP BY doc_id)
SELECT quality, count(*) AS n_docs, sum(CASE WHEN n IS NULL THEN 0 ELSE n + 11 END)::BIGINT AS input_tokens FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN labels USING (doc_id) GROUP BY quality"""


def semantic_text(spark, sf_dir):
    """Normalised texts and strict subsets of token sets, turn against the next."""
    from pyspark.sql import Window as W

    rows = _table(spark, sf_dir, "conversations").withColumn("norm", T.semantic(F.coalesce("text", F.lit("")))).withColumn("tokens", T.token_set(F.coalesce("text", F.lit(""))))
    after = F.lead("tokens").over(W.partitionBy("conv_id").orderBy("turn"))
    return rows.withColumn("after", after).select("conv_id", "turn", F.md5(F.col("norm").cast("binary")).alias("norm_md5"), F.size("tokens").cast("long").alias("n_tokens"), F.coalesce(T.strict_subset(F.col("tokens"), F.col("after")), F.lit(False)).alias("within_next"))


SEMANTIC_TEXT = r"""WITH t AS (SELECT conv_id, turn, regexp_replace(regexp_replace(lower(coalesce(text, '')), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'), '[\s\x0B]+', ' ', 'g') AS norm FROM conversations),
s AS (SELECT *, list_sort(list_distinct(string_split(norm, ' '))) AS tokens FROM t), n AS (SELECT *, lead(tokens) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM s)
SELECT conv_id, turn, md5(norm) AS norm_md5, len(tokens)::BIGINT AS n_tokens, coalesce(list_has_all(nx, tokens) AND len(tokens) < len(nx), false) AS within_next FROM n"""


def queries() -> dict:
    return {
        "tokenize_ascii": tokenize(T.DEFAULT),
        "tokenize_unicode": tokenize(T.Preset(T.UNICODE)),
        "tokenize_web": tokenize(T.WEB_WORDS),
        "token_stats": token_stats,
        "semantic_text": semantic_text,
        "ner_greedy": ner_greedy,
        "ner_by_type": ner_by_type,
        "ner_all_types": ner_all_types,
        "ner_documents": ner_documents,
        "ner_overrides": ner_overrides,
        "ner_gated": ner_gated,
        "bio_spans": bio_spans,
        "wis_spans": wis_spans,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "tokenize_ascii": _tokenize_sql("ascii"),
        "tokenize_unicode": _tokenize_sql("unicode"),
        "tokenize_web": _tokenize_sql("web", lower=True, period=True),
        "token_stats": TOKEN_STATS,
        "semantic_text": SEMANTIC_TEXT,
        "ner_greedy": NER_GREEDY,
        "ner_by_type": NER_BY_TYPE,
        "ner_all_types": NER_ALL_TYPES,
        "ner_documents": NER_DOCUMENTS,
        "ner_overrides": NER_OVERRIDES,
        "ner_gated": NER_GATED,
        "bio_spans": BIO_SPANS,
    }
