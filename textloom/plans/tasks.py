"""Queries: classification, decisions, relations, structures and pools, with SQL counterparts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import boundary as B
from ..operators import decide as D
from ..operators import pool as P
from ..operators import relations as R
from ..operators import spans as S
from ..operators.schema import Family, Field, Label, Question
from ..session import stored
from .ner import HASH, _chats, _p, _table, _words_sql

TOPICS = ("politics", "sports", "science", "travel")
MOODS = ("positive", "negative", "neutral")


def classify_multi(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").where(~T.is_blank(F.col("text")))
    raw = D.logits(F.col("text"), TOPICS, HASH)
    out = docs.select("doc_id", F.posexplode_outer(D.multi_label(raw, 0.7)).alias("place", "r")).where("r IS NOT NULL")
    return out.select("doc_id", F.col("place").cast("long").alias("place"), F.col("r.label").alias("label"), F.round("r.p", 6).alias("p"))


def _raw(names, text: str, source: str, keys: str) -> str:
    values = ", ".join(f"({i}, '{n}')" for i, n in enumerate(names))
    return f"SELECT {keys}, k, name, 4.0::DOUBLE * {_p('name', text)} AS v FROM {source}, (VALUES {values}) l(k, name)"


CLASSIFY_MULTI = f"""WITH r AS ({_raw(TOPICS, "text", "documents", "doc_id")} WHERE text IS NOT NULL AND NOT regexp_matches(text, '^[\\s\\x0B]*$')), s AS (SELECT *, 1 / (1 + exp(-v)) AS p FROM r)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, k) - 1 AS place, name AS label, round(p, 6) AS p FROM s WHERE p >= 0.7"""


def classify_single(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").where(~T.is_blank(F.col("text")))
    best = F.get(D.single_label(D.logits(F.col("text"), MOODS, HASH)), 0)
    return docs.withColumn("r", best).groupBy(F.col("r.label").alias("label")).agg(F.count("*").alias("n"), F.round(F.avg("r.p"), 6).alias("mean_p"))


CLASSIFY_SINGLE = f"""WITH r AS ({_raw(MOODS, "text", "documents", "doc_id")} WHERE text IS NOT NULL AND NOT regexp_matches(text, '^[\\s\\x0B]*$')),
s AS (SELECT *, exp(v) / sum(exp(v)) OVER (PARTITION BY doc_id) AS p FROM r), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, k) = 1)
SELECT name AS label, count(*) AS n, round(avg(p), 6) AS mean_p FROM b GROUP BY name"""

FAMILIES = [Family("mood", MOODS, True), Family("topic", TOPICS)]


def route_families(spark, sf_dir):
    rows = D.route(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), FAMILIES, HASH)
    out = rows.select("conv_id", "turn", F.explode_outer("routes").alias("r")).where("r IS NOT NULL")
    return out.groupBy(F.col("r.family").alias("family"), F.col("r.label").alias("label")).agg(F.count("*").alias("n"), F.round(F.avg("r.p"), 6).alias("mean_p"))


ROUTE_FAMILIES = f"""WITH c AS (SELECT * FROM conversations WHERE text IS NOT NULL AND NOT regexp_matches(text, '^[\\s\\x0B]*$')),
m AS ({_raw(MOODS, "text", "c", "conv_id, turn")}), ms AS (SELECT *, exp(v) / sum(exp(v)) OVER (PARTITION BY conv_id, turn) AS p FROM m),
mb AS (SELECT 'mood' AS family, name, p FROM ms QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY p DESC, k) = 1),
t AS ({_raw(TOPICS, "text", "c", "conv_id, turn")}), u AS (SELECT * FROM mb UNION ALL SELECT 'topic', name, 1 / (1 + exp(-v)) FROM t)
SELECT family, name AS label, count(*) AS n, round(avg(p), 6) AS mean_p FROM u GROUP BY ALL"""

QUESTIONS = [
    Question("intent", "choice", "", (Label("refund"), Label("question"), Label("praise"))),
    Question("urgency", "score", "how soon an answer is needed", (Label("low"), Label("normal"), Label("high"))),
    Question("handoff", "noul", "asks for a person"),
]


def decide_choice_score_noul(spark, sf_dir):
    rows = D.decide(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), QUESTIONS, HASH)
    d = rows.select("conv_id", "turn", F.explode_outer("decisions").alias("d")).where("d IS NOT NULL")
    p = F.col("d.probabilities")
    return d.select("conv_id", "turn", F.col("d.id").alias("id"), D.choice(p).alias("choice"), F.round(D.confidence(p), 6).alias("confidence"), F.round(D.expected(p), 6).alias("level"), F.round(D.probability_true(p), 6).alias("p_true"))


_Q = " UNION ALL ".join(_raw([o.name for o in q.options], f"'{q.prompt}' || chr(10) || text", "c", f"conv_id, turn, '{q.id}' AS id") for q in QUESTIONS)
DECIDE = f"""WITH c AS (SELECT * FROM conversations WHERE text IS NOT NULL AND NOT regexp_matches(text, '^[\\s\\x0B]*$')), r AS ({_Q}),
s AS (SELECT *, exp(v) / sum(exp(v)) OVER (PARTITION BY conv_id, turn, id) AS p FROM r)
SELECT conv_id, turn, id, arg_min(name, {{'p': -p, 'k': k}}) AS choice, round(max(p), 6) AS confidence, round(sum(k * p), 6) AS level, round(coalesce(max(p) FILTER (WHERE name = 'yes'), 0), 6) AS p_true
FROM s GROUP BY conv_id, turn, id"""

FIELDS = ("head", "tail")


def _related(spark, sf_dir):
    rows = _chats(spark, sf_dir)
    count = T.argmax(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: HASH.score(F.concat(F.lit("count:"), k.cast("string")), F.col("text"))))
    return R.best_spans(rows.withColumn("n", count), "works_for", list(FIELDS), HASH, 0.95, F.least(F.coalesce("n", F.lit(0)), F.lit(20)), 3)


def relations_min_conf(spark, sf_dir):
    rows = _related(spark, sf_dir).select("conv_id", "turn", F.explode_outer(R.relations(F.col("best"))).alias("r")).where("r IS NOT NULL")
    span = lambda i, f: F.col("r.fields")[i][f]
    return rows.select("conv_id", "turn", span(0, "text").alias("head"), span(1, "text").alias("tail"), F.round("r.confidence", 6).alias("confidence"), span(0, "start").cast("long").alias("head_start"), span(1, "start").cast("long").alias("tail_start"))


_BEST = f"""WITH {_words_sql("conversations", "conv_id, turn")},
cn AS (SELECT conv_id, turn, k AS n FROM (SELECT conv_id, turn, k, {_p("'count:' || k", "text")} AS v FROM conversations WHERE text IS NOT NULL CROSS JOIN range(4) r(k)) QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY v DESC, k) = 1)
""".replace("FROM conversations WHERE text IS NOT NULL CROSS JOIN range(4) r(k)", "FROM conversations, range(4) r(k) WHERE text IS NOT NULL")


def _best_sql(unit: str, fields, at: float, width: int) -> str:
    values = ", ".join(f"({i}, '{f}')" for i, f in enumerate(fields))
    return f"""{_BEST},
sp AS (SELECT a.*, b.i AS last, b.e AS fin, array_to_string(list_slice(q.ps, a.k, b.k), '') AS surface FROM wd a JOIN wd b USING (conv_id, turn) JOIN pa q USING (conv_id, turn) WHERE b.i BETWEEN a.i AND a.i + {width - 1}),
ca AS (SELECT conv_id, turn, inst, f.k AS fk, f.name AS field, i, last - i AS j, s AS start_, fin AS end_, surface, {_p(f"'{unit}:' || inst || ':' || f.name", "surface")} AS p
  FROM sp JOIN cn USING (conv_id, turn), range(3) n(inst), (VALUES {values}) f(k, name) WHERE inst < n AND {_p(f"'{unit}:' || inst || ':' || f.name", "surface")} >= {at})"""


RELATIONS = f"""{_best_sql("works_for", FIELDS, 0.95, 3)},
be AS (SELECT * FROM ca QUALIFY row_number() OVER (PARTITION BY conv_id, turn, inst, fk ORDER BY p DESC, i, j) = 1),
re AS (SELECT h.conv_id, h.turn, h.inst, h.surface AS head, t.surface AS tail, least(h.p, t.p) AS p, h.start_ AS hs, h.end_ AS he, t.start_ AS ts, t.end_ AS te
  FROM be h JOIN be t ON h.conv_id = t.conv_id AND h.turn = t.turn AND h.inst = t.inst AND h.fk = 0 AND t.fk = 1)
SELECT conv_id, turn, head, tail, round(p, 6) AS confidence, hs AS head_start, ts AS tail_start FROM re QUALIFY row_number() OVER (PARTITION BY conv_id, turn, hs, he, ts, te ORDER BY inst) = 1"""


#: Arguments of a role, pairs of a text, and their threshold.
ROLE, PAIRS, ARGUMENT = 8, 40, 0.985


def _edges(spark, sf_dir):
    """Edges of each text between its best heads and tails."""
    rows = S.candidates(_chats(spark, sf_dir), ("person", "company"), HASH, ARGUMENT, 2)
    role = lambda k: B.arguments(S.of_labels(F.col("cands"), k, k + 1, 2), ARGUMENT, ROLE)
    pairs = rows.withColumns({"_h": role(0), "_t": role(1)}).select("conv_id", "turn", F.explode_outer(B.argument_pairs(F.col("_h"), F.col("_t"), ROLE, PAIRS)).alias("p")).where("p IS NOT NULL")
    part = lambda x, y: [F.col(f"p.{x}.text").alias(x), F.col(f"p.{x}.start").cast("long").alias(f"{y}s"), F.col(f"p.{x}.end").cast("long").alias(f"{y}e")]
    return pairs.select("conv_id", "turn", F.col("p.i").alias("k"), (-F.col("p.k")).alias("p"), *part("head", "h"), *part("tail", "t"))


def relations_boundary(spark, sf_dir):
    # read several times
    out = R.deduplicated(stored(_edges(spark, sf_dir), "edges"), ["conv_id", "turn"])
    return out.select("conv_id", "turn", "head", "hs", "tail", "ts", F.round("p", 6).alias("p"), "ord")


def _role_sql(label: str, name: str, x: str) -> str:
    p = _p(f"'{label}'", "surface")
    return f"""{name} AS (SELECT conv_id, turn, i AS {x}i, last AS {x}l, surface AS {x}, s AS {x}s, fin AS {x}e, {p} AS {x}p, row_number() OVER (PARTITION BY conv_id, turn ORDER BY {p} DESC, i, last) - 1 AS {x}r FROM sp WHERE {p} >= {ARGUMENT}
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY {p} DESC, i, last) <= {ROLE})"""


RELATIONS_BOUNDARY = rf"""WITH {_words_sql("conversations", "conv_id, turn")},
sp AS (SELECT a.*, b.i AS last, b.e AS fin, array_to_string(list_slice(q.ps, a.k, b.k), '') AS surface FROM wd a JOIN wd b USING (conv_id, turn) JOIN pa q USING (conv_id, turn) WHERE b.i BETWEEN a.i AND a.i + 1),
{_role_sql("person", "ra", "h")}, {_role_sql("company", "rb", "t")},
ed AS (SELECT conv_id, turn, h AS head, hs, he, t AS tail, ts, te, hp * tp AS p, hr * {ROLE} + tr AS k, count(*) OVER (PARTITION BY conv_id, turn) AS n FROM
  (SELECT * FROM ra JOIN rb USING (conv_id, turn) WHERE NOT (hi = ti AND hl = tl) QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY hp * tp DESC, hr * {ROLE} + tr) <= {PAIRS})),
hm AS (SELECT m.conv_id, m.turn, m.hs, m.he, arg_min({{'t': o.head, 's': o.hs, 'e': o.he}}, {{'n': o.hs - o.he, 's': o.hs, 'e': o.he, 't': o.head}}) AS b FROM (SELECT DISTINCT conv_id, turn, hs, he FROM ed) m JOIN (SELECT DISTINCT conv_id, turn, head, hs, he FROM ed) o ON m.conv_id = o.conv_id AND m.turn = o.turn AND o.hs <= m.hs AND o.he >= m.he GROUP BY ALL),
tm AS (SELECT m.conv_id, m.turn, m.ts, m.te, arg_min({{'t': o.tail, 's': o.ts, 'e': o.te}}, {{'n': o.ts - o.te, 's': o.ts, 'e': o.te, 't': o.tail}}) AS b FROM (SELECT DISTINCT conv_id, turn, ts, te FROM ed) m JOIN (SELECT DISTINCT conv_id, turn, tail, ts, te FROM ed) o ON m.conv_id = o.conv_id AND m.turn = o.turn AND o.ts <= m.ts AND o.te >= m.te GROUP BY ALL),
gr AS (SELECT ed.conv_id, ed.turn, k, p, n, hm.b.t AS head, hm.b.s AS hs, hm.b.e AS he, tm.b.t AS tail, tm.b.s AS ts, tm.b.e AS te FROM ed JOIN hm USING (conv_id, turn, hs, he) JOIN tm USING (conv_id, turn, ts, te) WHERE n > 1),
ex AS (SELECT *, min(k) OVER (PARTITION BY conv_id, turn, hs, he, ts, te) AS ord FROM gr QUALIFY row_number() OVER (PARTITION BY conv_id, turn, hs, he, ts, te ORDER BY p DESC, k) = 1),
nm AS (SELECT *, regexp_replace(trim(lower(head)), '\s+', ' ', 'g') AS h, regexp_replace(trim(lower(tail)), '\s+', ' ', 'g') AS t FROM ex),
cl AS (SELECT *, list_sort(list_distinct(string_split(h, ' '))) AS hset, list_sort(list_distinct(string_split(t, ' '))) AS tset FROM nm QUALIFY row_number() OVER (PARTITION BY conv_id, turn, h, t ORDER BY greatest(hs - te, ts - he, 0), p DESC, hs, ts, ord) = 1),
ok AS (SELECT * FROM cl a WHERE NOT EXISTS (SELECT 1 FROM cl b WHERE a.conv_id = b.conv_id AND a.turn = b.turn AND (list_has_all(b.hset, a.hset) AND len(a.hset) < len(b.hset) AND a.tset = b.tset OR list_has_all(b.tset, a.tset) AND len(a.tset) < len(b.tset) AND a.hset = b.hset)))
SELECT conv_id, turn, head, hs, tail, ts, round(p, 6) AS p, ord FROM ok UNION ALL SELECT conv_id, turn, head, hs, tail, ts, round(p, 6), k FROM ed WHERE n = 1"""

CHOICES = Field("kind", "STRING", None, ("the", "and of", "la"))


def structure_choices(spark, sf_dir):
    """A LIST field by the greedy choice, and a STRING field whose spans snap to choices."""
    rows = S.candidates(_chats(spark, sf_dir), ("item", "kind"), HASH, 0.9, 2)
    of = lambda name: F.filter("cands", lambda c: c["label"] == name)
    rows = rows.withColumns({"items": S.greedy(of("item")), "kinds": S.by_confidence(R.snapped(of("kind"), CHOICES))})
    return rows.select("conv_id", "turn", F.size("items").cast("long").alias("n_items"), F.md5(F.array_join(F.transform("items", lambda c: c["text"]), "|").cast("binary")).alias("items_md5"), F.get("kinds", 0)["text"].alias("kind"), F.round(F.get("kinds", 0)["p"], 6).alias("kind_p"))


def _structure_sql() -> str:
    from .ner import _cands_sql, _greedy_sql

    return f"""{_cands_sql(("item", "kind"), 2, 0.9)}, it AS (SELECT * FROM ca WHERE label = 'item'),{_greedy_sql(source="it")},
sn AS (SELECT c.*, x.k AS xk, x.choice FROM ca c, (VALUES (0, 'the'), (1, 'and of'), (2, 'la')) x(k, choice) WHERE label = 'kind' AND (contains(lower(surface), choice) OR contains(choice, lower(surface)))
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn, ord ORDER BY length(choice) DESC, xk) = 1),
kb AS (SELECT * FROM sn QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY p DESC, ord) = 1),
gi AS (SELECT conv_id, turn, count(*) AS n, string_agg(surface, '|' ORDER BY start_) AS t FROM gr GROUP BY ALL)
SELECT c.conv_id, c.turn, coalesce(n, 0) AS n_items, md5(coalesce(t, '')) AS items_md5, choice AS kind, round(p, 6) AS kind_p FROM conversations c LEFT JOIN gi USING (conv_id, turn) LEFT JOIN kb USING (conv_id, turn)"""


#: Vectors whose id this divides ask; all rows answer.
ASKED = 20


def _vectors(spark, sf_dir):
    """All vectors, and those of them that ask, as if these were labels."""
    v = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return v, v.where(F.col("vec_id") % ASKED == 0).select(F.col("vec_id").alias("q"), F.col("embedding").alias("qe"))


_VEC = f"vs AS (SELECT e.label, a.vec_id AS q, e.vec_id AS vec, round(list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: e.embedding[i]::DOUBLE * a.embedding[i]::DOUBLE)), 5) AS v FROM embeddings e, embeddings a WHERE a.vec_id % {ASKED} = 0)"


def _places(column: str, n: int):
    """Rounded to ``n`` places by the value's own bits; ``F.round`` goes by its decimal digits, which may tie where the value doesn't."""
    return F.signum(column) * F.floor(F.abs(column) * 10**n + 0.5) / 10**n


def pool_topk(spark, sf_dir):
    v, asked = _vectors(spark, sf_dir)
    out = P.nearest(asked, v.select(F.col("vec_id").alias("at"), F.col("embedding").alias("e")), None, 10)
    return out.select("q", F.col("at").alias("vec"), _places("v", 4).alias("v"), F.col("rank").cast("long").alias("rank"))


POOL_TOPK = f"WITH {_VEC} SELECT q, vec, round(v, 4) AS v, row_number() OVER (PARTITION BY q ORDER BY v DESC, vec) - 1 AS rank FROM vs QUALIFY row_number() OVER (PARTITION BY q ORDER BY v DESC, vec) <= 10"


def pool_topk_all(spark, sf_dir):
    """``pool_topk`` with every vector of the table as a query."""
    v = _table(spark, sf_dir, "embeddings")
    out = P.nearest(v.select(F.col("vec_id").alias("q"), F.col("embedding").alias("qe")), v.select(F.col("vec_id").alias("at"), F.col("embedding").alias("e")), None, 10)
    return out.select("q", F.col("at").alias("vec"), F.round("v", 4).alias("v"), F.col("rank").cast("long").alias("rank"))


def pool_quota(spark, sf_dir):
    return _quota(*_pools(*_vectors(spark, sf_dir)))


def pool_quota_all(spark, sf_dir):
    """``pool_quota`` with every vector of the table as a query."""
    v = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return _quota(*_pools(v, v.select(F.col("vec_id").alias("q"), F.col("embedding").alias("qe"))))


def _pools(v, asked):
    """The best score of each row over all that ask, and the 8 best rows of each label for each that asks."""
    rows = v.select("label", F.col("vec_id").alias("at"), F.col("embedding").alias("e"))
    own = P.nearest(asked, rows, "label", 8)
    # a dot product has no direction: a row's best query is the nearest of those that ask
    best = P.nearest(v.select(F.struct("label", "vec_id").alias("q"), F.col("embedding").alias("qe")), asked.select(F.col("q").alias("at"), F.col("qe").alias("e")), None, 1)
    return P.unioned(best.select("q.label", F.col("q.vec_id").alias("at"), "v"), ["label"], "at", "v"), stored(own, "own")


def _quota(wide, own):
    """The pool of each label from the best scores of its rows, and the 8 best rows of each query."""
    k = 8
    tops = P.top_k(wide, ["label"], "v", "at", k)
    all_pairs = P.pairs(tops, tops, ["label"], k)
    by_label = P.pairs(own, own, ["label", "q"], k)
    out = P.pooled(all_pairs, by_label, ["label"], "q", 3, 12)
    return out.select("label", F.col("s").alias("s"), F.col("e").alias("e"), F.round("v", 3).alias("v"), F.col("rank").cast("long").alias("rank"))


def _pairs_sql(top: str, keys: str) -> str:
    return f"SELECT {keys}, a.vec AS s, b.vec AS e, a.v + b.v AS v, a.r * 8 + b.r AS i FROM {top} a JOIN {top} b USING ({keys}) WHERE b.vec > a.vec"


POOL_QUOTA = f"""WITH {_VEC}, w AS (SELECT label, vec, max(v) AS v FROM vs GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY v DESC, vec) - 1 AS r FROM w QUALIFY row_number() OVER (PARTITION BY label ORDER BY v DESC, vec) <= 8),
o AS (SELECT *, row_number() OVER (PARTITION BY label, q ORDER BY v DESC, vec) - 1 AS r FROM vs QUALIFY row_number() OVER (PARTITION BY label, q ORDER BY v DESC, vec) <= 8),
pw AS ({_pairs_sql("t", "label")}), po AS ({_pairs_sql("o", "label, q")}),
pb AS (SELECT label, s, e, 5003.0 - (row_number() OVER (PARTITION BY label, q ORDER BY v DESC, i) - 1) AS v, q * 3 + row_number() OVER (PARTITION BY label, q ORDER BY v DESC, i) - 1 - 1099511627776 AS i FROM po QUALIFY row_number() OVER (PARTITION BY label, q ORDER BY v DESC, i) <= 3),
u AS (SELECT label, s, e, v, i FROM pw UNION ALL SELECT * FROM pb), d AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY label, s, e ORDER BY v DESC, i) = 1)
SELECT label, s, e, round(v, 3) AS v, row_number() OVER (PARTITION BY label ORDER BY v DESC, i) - 1 AS rank FROM d QUALIFY row_number() OVER (PARTITION BY label ORDER BY v DESC, i) <= 12"""


def bucketize(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    borders = P.length_buckets(docs, "n_chars", 1.3)
    bucket = F.size(F.filter(F.array(*map(F.lit, borders)), lambda b: b <= F.col("n_chars"))) - 1 if borders else F.lit(0)
    return docs.withColumn("bucket", bucket).groupBy("bucket").agg(F.count("*").alias("n"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest")).withColumn("bucket", F.col("bucket").cast("long"))


BUCKETIZE = """WITH RECURSIVE b(bucket, n) AS (SELECT 0, min(n_chars) FROM documents UNION ALL SELECT bucket + 1, (SELECT min(n_chars) FROM documents WHERE n_chars > greatest(b.n, 1) * 1.3::DOUBLE) FROM b WHERE b.n IS NOT NULL)
SELECT bucket, count(*) AS n, min(n_chars) AS shortest, max(n_chars) AS longest FROM (SELECT n_chars, max(bucket) AS bucket FROM documents JOIN b ON b.n <= n_chars GROUP BY doc_id, n_chars) GROUP BY bucket"""


def prompts(spark, sf_dir):
    """Text prompts of a label classifier, text last."""
    head = "".join(f"<<LABEL>>{t}" for t in TOPICS) + "<<SEP>>"
    rows = _table(spark, sf_dir, "documents").where(~T.is_blank(F.col("text")))
    prompt = F.concat(F.lit(head), F.col("text"))
    return rows.select("doc_id", F.length(prompt).cast("long").alias("n_chars"), F.md5(prompt.cast("binary")).alias("prompt_md5"))


PROMPTS = f"""SELECT doc_id, length(p) AS n_chars, md5(p) AS prompt_md5 FROM (SELECT doc_id, '{"".join(f"<<LABEL>>{t}" for t in TOPICS)}<<SEP>>' || text AS p FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '^[\\s\\x0B]*$'))"""


def queries() -> dict:
    return {
        "classify_multi": classify_multi,
        "classify_single": classify_single,
        "route_families": route_families,
        "decide_choice_score_noul": decide_choice_score_noul,
        "relations_min_conf": relations_min_conf,
        "relations_boundary": relations_boundary,
        "structure_choices": structure_choices,
        "pool_topk": pool_topk,
        "pool_quota": pool_quota,
        "pool_topk_all": pool_topk_all,
        "pool_quota_all": pool_quota_all,
        "bucketize": bucketize,
        "prompts": prompts,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "classify_multi": CLASSIFY_MULTI,
        "classify_single": CLASSIFY_SINGLE,
        "route_families": ROUTE_FAMILIES,
        "decide_choice_score_noul": DECIDE,
        "relations_min_conf": RELATIONS,
        "relations_boundary": RELATIONS_BOUNDARY,
        "structure_choices": _structure_sql(),
        "pool_topk": POOL_TOPK,
        "pool_quota": POOL_QUOTA,
        "bucketize": BUCKETIZE,
        "prompts": PROMPTS,
    }
