"""Queries of structures, combined extraction, boundary evidence and label embeddings, with SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import api
from ..functions.text import let, sigmoid, with_words
from ..operators import boundary as B
from ..operators import layout as L
from ..operators import pool as P
from ..operators import spans as S
from ..operators import tensors as T
from ..operators.schema import Field, Label, Relation, Schema, Structure
from ..session import stored
from .prompt import assemble, entity_unit, first_runs, relation_unit, usage_cached
from .ner import HASH, _cands_sql, _greedy_sql, _p, _spread, _table, _words_sql

PRODUCT = Structure("product", (Field("name"), Field("features", "LIST"), Field("kind", "STRING", None, ("the", "and of", "la"))))
SCHEMA = Schema(entities=(Label("person"), Label("location")), relations=(Relation("works_for"), Relation("located_in", fields=("place", "area"))), structures=(PRODUCT,))
AT, WIDTH = 0.97, 3


def _texts(spark, sf_dir):
    return _spread(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"))


def _md5(spans, part):
    return F.md5(F.array_join(F.transform(spans, part), "|").cast("binary"))


def structures_instances(spark, sf_dir):
    """Every instance with its three fields: the best span, the greedy choice, and the best that snaps to a choice."""
    rows = api.extract_structures(_texts(spark, sf_dir), [PRODUCT], HASH, threshold=AT, width=WIDTH)
    rows = rows.select("conv_id", "turn", F.posexplode_outer(F.col("structures")["product"]).alias("inst", "s")).where("inst IS NOT NULL")
    field = lambda name: F.coalesce(F.try_element_at("s", F.lit(name)), F.array())
    return rows.select(
        "conv_id", "turn", F.col("inst").cast("long").alias("inst"), F.size("s").cast("long").alias("n_fields"), F.get(field("name"), F.lit(0))["text"].alias("name"), F.round(F.get(field("name"), F.lit(0))["p"], 6).alias("name_p"),
        F.size(field("features")).cast("long").alias("n_features"), _md5(field("features"), lambda c: c["text"]).alias("features_md5"), F.get(field("kind"), F.lit(0))["text"].alias("kind"), F.get(field("kind"), F.lit(0))["start"].cast("long").alias("kind_start"),
    )


def _count_sql(unit: str, name: str) -> str:
    """CTE: how many instances each text has of a unit."""
    return f"""{name} AS (SELECT conv_id, turn, k AS n FROM (SELECT conv_id, turn, k, {_p(f"'{unit}:count:' || k", "text")} AS v FROM conversations, range(4) r(k) WHERE text IS NOT NULL AND NOT regexp_matches(text, '^[\\s\\x0B]*$')) QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY v DESC, k) = 1)"""


_SPANS = f"""sp AS (SELECT a.*, b.i AS last, b.e AS fin, array_to_string(list_slice(q.ps, a.k, b.k), '') AS surface FROM wd a JOIN wd b USING (conv_id, turn) JOIN pa q USING (conv_id, turn) WHERE b.i BETWEEN a.i AND a.i + {WIDTH - 1})"""


def _fields_sql(unit: str, fields: list[str], count: str, name: str) -> str:
    """CTE: candidates of every field of every instance."""
    values, p = ", ".join(f"({i}, '{f}')" for i, f in enumerate(fields)), _p(f"'{unit}:' || inst || ':' || f.name", "surface")
    return f"""{name} AS (SELECT conv_id, turn, inst, f.k AS fk, f.name AS field, i * 100 + last - i AS ord, s AS start_, fin AS end_, surface, {p} AS p
  FROM sp JOIN {count} USING (conv_id, turn), range(3) n(inst), (VALUES {values}) f(k, name) WHERE inst < n AND {p} >= {AT})"""


def _structure_sql() -> str:
    """CTEs: ``np`` (numbers of instances), and ``na``, ``fe``, ``kb``: the three fields."""
    choices = ", ".join(f"({i}, '{c}')" for i, c in enumerate(PRODUCT.fields[2].choices))
    return f"""{_count_sql("product", "np")}, {_fields_sql("product", [f.name for f in PRODUCT.fields], "np", "cp")},
na AS (SELECT * FROM cp WHERE fk = 0 QUALIFY row_number() OVER (PARTITION BY conv_id, turn, inst ORDER BY p DESC, ord) = 1),
lf AS (SELECT * FROM cp WHERE fk = 1), {_greedy_sql("conv_id, turn, inst", source="lf").replace("li AS", "l1 AS").replace("FROM li", "FROM l1").replace("ke AS", "k1 AS").replace("FROM ke", "FROM k1").replace("gr AS", "gs AS")},
fe AS (SELECT conv_id, turn, inst, count(*) AS n, string_agg(surface, '|' ORDER BY start_) AS t FROM gs GROUP BY ALL),
sn AS (SELECT c.*, x.k AS xk, x.choice FROM cp c, (VALUES {choices}) x(k, choice) WHERE fk = 2 AND (contains(lower(surface), choice) OR contains(choice, lower(surface)))
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn, inst, ord ORDER BY length(choice) DESC, xk) = 1),
kb AS (SELECT * FROM sn QUALIFY row_number() OVER (PARTITION BY conv_id, turn, inst ORDER BY p DESC, ord) = 1),
ip AS (SELECT conv_id, turn, inst, np.n AS n_inst, na.surface AS name, na.p AS name_p, fe.n AS n_features, fe.t, kb.choice AS kind, kb.start_ AS kind_start,
    (na.surface IS NOT NULL)::BIGINT + (fe.n IS NOT NULL)::BIGINT + (kb.choice IS NOT NULL)::BIGINT AS n_fields
  FROM np JOIN range(3) r(inst) ON inst < np.n LEFT JOIN na USING (conv_id, turn, inst) LEFT JOIN fe USING (conv_id, turn, inst) LEFT JOIN kb USING (conv_id, turn, inst))"""


STRUCTURES = f"""WITH {_words_sql("conversations", "conv_id, turn")}, {_SPANS}, {_structure_sql()}
SELECT conv_id, turn, inst, n_fields, name, round(name_p, 6) AS name_p, coalesce(n_features, 0) AS n_features, md5(coalesce(t, '')) AS features_md5, kind, kind_start FROM ip"""


def extract_schema(spark, sf_dir):
    """Entities, two relations and a structure of every text: how many of each unit, and a digest of what they are."""
    rows = api.extract(_texts(spark, sf_dir), SCHEMA, HASH, AT, WIDTH)
    of = lambda c: F.concat(c["text"], F.lit("@"), c["start"].cast("string"))
    units = [F.struct(F.lit(f"entity {x.name}").alias("unit"), F.transform(F.coalesce(F.try_element_at("entities", F.lit(x.name)), F.array()), of).alias("found")) for x in SCHEMA.entities]
    units += [F.struct(F.lit(f"relation {x.name}").alias("unit"), F.transform(F.col("relations")[x.name], lambda r: F.array_join(F.transform(r["fields"], of), ">")).alias("found")) for x in SCHEMA.relations]
    parts = lambda s: F.array_join(F.transform(F.map_entries(s), lambda e: F.concat(e["key"], F.lit("="), F.array_join(F.transform(e["value"], of), "+"))), ",")
    units += [F.struct(F.lit(f"structure {x.name}").alias("unit"), F.transform(F.col("structures")[x.name], parts).alias("found")) for x in SCHEMA.structures]
    rows = rows.select("conv_id", "turn", F.explode(F.array(*units)).alias("u"))
    return rows.select("conv_id", "turn", "u.unit", F.size("u.found").cast("long").alias("n"), F.md5(F.array_join("u.found", ";").cast("binary")).alias("found_md5"))


def _relation_sql(unit: Relation, k: int) -> str:
    """CTE ``r{k}``: complete instances, once per offsets."""
    return f"""{_count_sql(unit.name, f"n{k}")}, {_fields_sql(unit.name, list(unit.fields), f"n{k}", f"c{k}")},
b{k} AS (SELECT * FROM c{k} QUALIFY row_number() OVER (PARTITION BY conv_id, turn, inst, fk ORDER BY p DESC, ord) = 1),
r{k} AS (SELECT h.conv_id, h.turn, h.inst, h.surface || '@' || h.start_ || '>' || t.surface || '@' || t.start_ AS x FROM b{k} h JOIN b{k} t ON h.conv_id = t.conv_id AND h.turn = t.turn AND h.inst = t.inst AND h.fk = 0 AND t.fk = 1
  QUALIFY row_number() OVER (PARTITION BY h.conv_id, h.turn, h.start_, h.end_, t.start_, t.end_ ORDER BY h.inst) = 1)"""


def _schema_sql() -> str:
    entities = _cands_sql([x.name for x in SCHEMA.entities], WIDTH, AT)
    of = "{0}.surface || '@' || {0}.start_"
    found = [f"SELECT conv_id, turn, 'entity {x.name}' AS unit, count(*) AS n, string_agg({of.format('gr')}, ';' ORDER BY start_) AS t FROM gr WHERE label = '{x.name}' GROUP BY ALL" for x in SCHEMA.entities]
    found += [f"SELECT conv_id, turn, 'relation {x.name}', count(*), string_agg(x, ';' ORDER BY inst) FROM r{k} GROUP BY ALL" for k, x in enumerate(SCHEMA.relations)]
    found += ["SELECT conv_id, turn, 'structure product', count(*), string_agg(x, ';' ORDER BY inst) FROM sx GROUP BY ALL"]
    units = ", ".join(f"('{u}')" for u in [*(f"entity {x.name}" for x in SCHEMA.entities), *(f"relation {x.name}" for x in SCHEMA.relations), "structure product"])
    return f"""{entities}, {_greedy_sql()}, {", ".join(_relation_sql(x, k) for k, x in enumerate(SCHEMA.relations))}, {_structure_sql()},
fx AS (SELECT conv_id, turn, inst, string_agg({of.format('gs')}, '+' ORDER BY start_) AS t FROM gs GROUP BY ALL),
sx AS (SELECT ip.conv_id, ip.turn, ip.inst, array_to_string(list_filter(['name=' || {of.format('na')}, 'features=' || fx.t, 'kind=' || kb.choice || '@' || kb.start_], lambda x: x IS NOT NULL), ',') AS x
  FROM ip LEFT JOIN na USING (conv_id, turn, inst) LEFT JOIN fx USING (conv_id, turn, inst) LEFT JOIN kb USING (conv_id, turn, inst)),
al AS ({" UNION ALL ".join(found)})
SELECT c.conv_id, c.turn, u.unit, coalesce(al.n, 0) AS n, md5(coalesce(al.t, '')) AS found_md5 FROM conversations c CROSS JOIN (VALUES {units}) u(unit) LEFT JOIN al ON al.conv_id = c.conv_id AND al.turn = c.turn AND al.unit = u.unit"""


#: A pool's starts and ends, pairs of each label that are sure to be in it, its size; temperature and threshold.
NAMES, TOP, QUOTA, POOL, TEMPERATURE, SURE = ("person", "location"), 8, 2, 24, 1.5, 0.75


def boundary_evidence(spark, sf_dir):
    """The pairs of each text's pool that a label is sure of, with the evidence of their inside."""
    rows = B.with_evidence(B.marks(with_words(_texts(spark, sf_dir)), NAMES, HASH))
    rows = B.candidates(B.with_pool(rows, TOP, QUOTA, POOL), SURE, TEMPERATURE, POOL)
    said = lambda c, own: B.evidence(F.get(own["prefix"], (c["ord"] / POOL).cast("int")), F.get(own["mean"], (c["ord"] / POOL).cast("int")), c["first"], c["last"] + 1)
    found = let(F.struct("prefix", "mean"), lambda own: F.transform("cands", lambda c: F.struct(c.alias("c"), said(c, own).alias("v"))))
    rows = rows.select("conv_id", "turn", F.explode_outer(found).alias("x")).where("x IS NOT NULL")
    return rows.select("conv_id", "turn", F.col("x.c.label").alias("label"), F.col("x.c.first").cast("long").alias("s"), (F.col("x.c.last") + 1).cast("long").alias("e"), F.col("x.c.text").alias("text"), F.round("x.v", 6).alias("evidence"), F.round("x.c.p", 6).alias("p"))


def _evidence_sql() -> str:
    values = ", ".join(f"({i}, '{n}')" for i, n in enumerate(NAMES))
    logit = lambda part: f"4 * {_p(f"l.name || ':{part}:' || i", 'w')} - 2"
    top = lambda name, at, v: f"{name} AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY v DESC, b) - 1 AS r FROM (SELECT conv_id, turn, {at} AS b, max({v}) AS v FROM lg GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY v DESC, b) <= {TOP})"
    return f"""WITH {_words_sql("conversations", "conv_id, turn")},
lg AS (SELECT conv_id, turn, i, l.k AS lk, l.name AS label, {logit("start")} AS a, {logit("inside")} AS m, {logit("end")} AS z FROM wd, (VALUES {values}) l(k, name)),
{top("us", "i", "a")}, {top("ue", "i + 1", "z")},
pr AS (SELECT us.conv_id, us.turn, us.b AS s, ue.b AS e, us.v + ue.v AS v, us.r * {TOP} + ue.r AS i FROM us JOIN ue USING (conv_id, turn) WHERE ue.b > us.b),
ow AS (SELECT pr.conv_id, pr.turn, pr.s, pr.e, a.lk, row_number() OVER (PARTITION BY pr.conv_id, pr.turn, a.lk ORDER BY a.a + z.z DESC, pr.i) - 1 AS r
  FROM pr JOIN lg a ON a.conv_id = pr.conv_id AND a.turn = pr.turn AND a.i = pr.s JOIN lg z ON z.conv_id = pr.conv_id AND z.turn = pr.turn AND z.i = pr.e - 1 AND z.lk = a.lk),
al AS (SELECT conv_id, turn, s, e, v, i FROM pr UNION ALL SELECT conv_id, turn, s, e, 5000.0 + {QUOTA} - r, lk * {QUOTA} + r - 1099511627776 FROM ow WHERE r < {QUOTA}),
on1 AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY conv_id, turn, s, e ORDER BY v DESC, i) = 1),
po AS (SELECT * FROM on1 QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY v DESC, i) <= {POOL}),
ev AS (SELECT po.conv_id, po.turn, po.s, po.e, x.label, x.lk, sum(x.m) / sqrt(max(po.e - po.s)) AS v, max(CASE WHEN x.i = po.s THEN x.a END) AS a, max(CASE WHEN x.i = po.e - 1 THEN x.z END) AS z
  FROM po JOIN lg x ON x.conv_id = po.conv_id AND x.turn = po.turn AND x.i >= po.s AND x.i < po.e GROUP BY ALL),
sc AS (SELECT *, 1 / (1 + exp(-(a + z + v) / {TEMPERATURE}::DOUBLE)) AS p FROM ev)
SELECT sc.conv_id, sc.turn, sc.label, sc.s, sc.e, array_to_string(list_slice(pa.ps, f.k, t.k), '') AS text, round(sc.v, 6) AS evidence, round(sc.p, 6) AS p FROM sc JOIN pa USING (conv_id, turn)
JOIN wd f ON f.conv_id = sc.conv_id AND f.turn = sc.turn AND f.i = sc.s JOIN wd t ON t.conv_id = sc.conv_id AND t.turn = sc.turn AND t.i = sc.e - 1 WHERE sc.p >= {SURE}"""


def label_embeddings(spark, sf_dir):
    """Every vector against the mean vector of each label: its two best labels, by dot product over the root of the dimension."""
    v = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    labels = stored(B.mean_vectors(v, "label", "embedding"), "labels")
    asked = v.select(F.struct("vec_id", F.size("embedding").alias("dim")).alias("q"), F.col("embedding").alias("qe"))
    best = P.nearest(asked, labels.select(F.col("label").alias("at"), F.col("embedding").alias("e")), None, 2)
    scaled = F.col("v") / F.sqrt(F.col("q.dim").cast("double"))
    return best.select(F.col("q.vec_id").alias("vec_id"), F.col("rank").cast("long").alias("rank"), F.col("at").alias("label"), F.round(B.probability(scaled, TEMPERATURE), 6).alias("p"))


LABEL_EMBEDDINGS = f"""WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings WHERE label IS NOT NULL),
m AS (SELECT label, d, avg(x) AS x FROM x GROUP BY ALL), l AS (SELECT label, list(x ORDER BY d) AS e FROM m GROUP BY label),
s AS (SELECT vec_id, l.label, len(embedding) AS dim, round(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: embedding[i]::DOUBLE * l.e[i])), 5) AS v FROM embeddings, l),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, label) - 1 AS rank FROM s)
SELECT vec_id, rank, label, round(1 / (1 + exp(-v / sqrt(dim) / {TEMPERATURE}::DOUBLE)), 6) AS p FROM r WHERE rank < 2"""


RATIO = 1.3


def _prompt():
    return assemble([entity_unit(SCHEMA.entities), relation_unit(SCHEMA.relations[1])])


def row_layout(spark, sf_dir):
    """Each text as a padded row of numbers after a prompt: its bucket, its numbers, and where its words begin."""
    prefix, markers = _prompt()
    rows = L.cut(with_words(_texts(spark, sf_dir))).select("conv_id", "turn", "parts")
    vocab = stored(L.vocabulary(rows, list(dict.fromkeys(prefix))), "vocabulary")
    rows = stored(L.numbered(rows, vocab, ["conv_id", "turn"], prefix, markers, vocab.count()), "numbered")
    borders = P.length_buckets(rows.select(F.size("ids").alias("n")), "n", RATIO)
    joined = lambda c: F.md5(F.array_join(F.transform(c, lambda x: x.cast("string")), " ").cast("binary"))
    return L.padded(rows, borders).select("conv_id", "turn", F.col("bucket").cast("long").alias("bucket"), F.col("n_words").cast("long").alias("n_words"), F.size("ids").cast("long").alias("row_length"), joined("ids").alias("ids_md5"), F.size("first").cast("long").alias("n_places"), joined("first").alias("first_md5"))


def _layout_sql() -> str:
    prefix, _ = _prompt()
    marks = list(dict.fromkeys(prefix))
    lead = [marks.index(t) + 1 for t in prefix]
    return f"""WITH RECURSIVE {_words_sql("conversations", "conv_id, turn")},
pt AS (SELECT conv_id, turn, i, unnest(list_transform(range(0, length(w), {L.PIECE}), lambda x: substr(w, x + 1, {L.PIECE}))) AS piece, unnest(range(0, length(w), {L.PIECE})) AS o FROM wd),
vo AS (SELECT piece, row_number() OVER (ORDER BY encode(piece)) + {len(marks)} AS id FROM (SELECT DISTINCT piece FROM pt)),
nu AS (SELECT conv_id, turn, list(id ORDER BY i, o) AS ids FROM pt JOIN vo USING (piece) GROUP BY ALL),
nw AS (SELECT conv_id, turn, i, ceil(length(w) / {float(L.PIECE)})::BIGINT AS n FROM wd),
fw AS (SELECT conv_id, turn, i, {len(prefix)} + coalesce(sum(n) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS f FROM nw),
fi AS (SELECT conv_id, turn, list(f ORDER BY i) AS fs FROM fw GROUP BY ALL),
ro AS (SELECT c.conv_id, c.turn, list_concat({lead}::BIGINT[], coalesce(ids, []::BIGINT[])) AS ids, coalesce(fs, []::BIGINT[]) AS fs FROM conversations c LEFT JOIN nu USING (conv_id, turn) LEFT JOIN fi USING (conv_id, turn)),
le AS (SELECT DISTINCT len(ids) AS n FROM ro),
b(bucket, n) AS (SELECT 0, min(n) FROM le UNION ALL SELECT bucket + 1, (SELECT min(n) FROM le WHERE le.n > greatest(b.n, 1) * {RATIO}::DOUBLE) FROM b WHERE b.n IS NOT NULL),
bu AS (SELECT ro.*, (SELECT max(bucket) FROM b WHERE b.n <= len(ids)) AS bucket FROM ro),
mo AS (SELECT bucket, max(len(ids)) AS li, max(len(fs)) AS lf FROM bu GROUP BY bucket)
SELECT conv_id, turn, bucket::BIGINT AS bucket, len(fs) AS n_words, li AS row_length, md5(array_to_string(list_resize(ids, li, 0), ' ')) AS ids_md5, lf AS n_places, md5(array_to_string(list_resize(fs, lf, -1), ' ')) AS first_md5 FROM bu JOIN mo USING (bucket)"""


#: Labels that turns of a role are asked for.
ROLES = {"user": ("person", "product"), "assistant": ("date",)}


def usage_cold_cache(spark, sf_dir):
    """Input tokens where the first text of each label list pays for the labels: three for each, by the order of conversations."""
    labels = F.lit(None).cast("array<string>")
    for role, names in ROLES.items():
        labels = F.when(F.col("role") == role, F.array(*map(F.lit, names))).otherwise(labels)
    rows = with_words(_table(spark, sf_dir, "conversations").select("conv_id", "turn", labels.alias("labels"), "text"))
    rows = first_runs(rows, "labels", ["conv_id", "turn"])
    cost = F.coalesce(3 * F.size("labels"), F.lit(0))
    return rows.select("conv_id", "turn", usage_cached(F.col("text"), F.col("words"), F.col("first"), cost).cast("long").alias("input_tokens"), "first")


_ROLE = " ".join(f"WHEN '{role}' THEN '{','.join(names)}'" for role, names in ROLES.items())
_COST = " ".join(f"WHEN '{role}' THEN {3 * len(names)}" for role, names in ROLES.items())
USAGE_COLD = f"""WITH {_words_sql("conversations", "conv_id, turn")}, n AS (SELECT conv_id, turn, count(*) AS n FROM wd GROUP BY ALL),
r AS (SELECT c.conv_id, c.turn, n, CASE role {_ROLE} END AS labels, CASE role {_COST} ELSE 0 END AS cost FROM conversations c LEFT JOIN n USING (conv_id, turn)),
f AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY labels ORDER BY conv_id, turn) = 1 AS first FROM r WHERE n IS NOT NULL)
SELECT r.conv_id, r.turn, CASE WHEN n IS NULL THEN 0 ELSE n + 2 + CASE WHEN first THEN cost ELSE 0 END END AS input_tokens, coalesce(first, false) AS first FROM r LEFT JOIN f USING (conv_id, turn)"""


def _tensors(spark, sf_dir, words: str):
    """Vectors as a model's output beside a text of five to eight words."""
    n = F.expr(f"5 + pmod(vec_id, {words})").cast("int")
    text = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.lit("w"), i.cast("string"))), " ")
    return with_words(_table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64).select("vec_id", F.col("embedding").alias("e"), text.alias("text")))


def _nested(values, *sizes: int):
    """A flat array as nested arrays of the given sizes; the rest of it is left."""
    if len(sizes) == 1:
        return F.slice(values, 1, sizes[0])
    step = 1
    for k in sizes[1:]:
        step *= k
    return F.transform(F.sequence(F.lit(0), F.lit(sizes[0] - 1)), lambda i: _nested(F.slice(values, i * step + 1, step), *sizes[1:]))


def tensor_spans(spark, sf_dir):
    """Entities from tensors [1][2 fields][8 words][4 widths] of probabilities, by the greedy choice."""
    rows = _tensors(spark, sf_dir, "4")
    p = F.transform("e", lambda x: sigmoid(8 * x.cast("double")))
    rows = T.spans_of(rows.withColumn("scores", _nested(p, 1, 2, 8, 4)), "scores", NAMES, 0.8, 4)
    out = S.exploded(rows.withColumn("cands", S.greedy(F.col("cands"))), ["vec_id"])
    return out.select("vec_id", "type", "text", F.round("confidence", 6).alias("confidence"), F.col("start").cast("long").alias("start"))


TENSOR_SPANS = f"""WITH e AS (SELECT vec_id, 5 + vec_id % 4 AS n, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS o FROM embeddings WHERE len(embedding) = 64),
sc AS (SELECT vec_id, n, 1 / (1 + exp(-8 * x)) AS p, o // 32 AS f, o // 4 % 8 AS i, o % 4 AS j FROM e),
ca AS (SELECT vec_id, (f * n + i) * 4 + j AS ord, f, i * 3 AS start_, (i + j) * 3 + 2 AS end_, array_to_string(list_transform(range(i, i + j + 1), lambda k: 'w' || k), ' ') AS surface, p FROM sc WHERE i + j < n AND p >= 0.8),{_greedy_sql("vec_id")}
SELECT vec_id, CASE f WHEN 0 THEN '{NAMES[0]}' ELSE '{NAMES[1]}' END AS type, surface AS text, round(p, 6) AS confidence, start_ AS start FROM gr"""


def tensor_tokens(spark, sf_dir):
    """Entities from token logits [7 words][3 classes][start, end, inside], for texts of up to eight words."""
    logits = _nested(F.transform("e", lambda x: 8 * x.cast("double")), 7, 3, 3)
    rows = T.tokens_of(_tensors(spark, sf_dir, "4").withColumn("logits", logits), "logits", [*NAMES, "organization"], 0.5)
    out = S.exploded(rows.withColumn("cands", S.greedy(F.col("cands"))), ["vec_id"])
    return out.select("vec_id", "type", "text", F.round("confidence", 6).alias("confidence"), F.col("start").cast("long").alias("start"))


TENSOR_TOKENS = f"""WITH e AS (SELECT vec_id, 5 + vec_id % 4 AS n, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS o FROM embeddings WHERE len(embedding) = 64),
sg AS (SELECT vec_id, n, 1 / (1 + exp(-8 * x)) AS p, o // 9 AS i, o // 3 % 3 AS c, o % 3 AS ch FROM e WHERE o < 63 AND o // 9 < n),
w AS (SELECT vec_id, n, i, c, max(p) FILTER (ch = 0) AS a, max(p) FILTER (ch = 1) AS z, max(p) FILTER (ch = 2) AS m FROM sg GROUP BY ALL),
ca AS (SELECT s.vec_id, (s.i * 3 + s.c) * s.n + t.i AS ord, s.c, s.i * 3 AS start_, t.i * 3 + 2 AS end_, array_to_string(list_transform(range(s.i, t.i + 1), lambda k: 'w' || k), ' ') AS surface,
    least(max(s.a), min(r.m), max(t.z)) AS p FROM w s JOIN w t ON s.vec_id = t.vec_id AND s.c = t.c AND t.i >= s.i JOIN w r ON r.vec_id = s.vec_id AND r.c = s.c AND r.i BETWEEN s.i AND t.i
  WHERE s.a >= 0.5 AND t.z >= 0.5 GROUP BY s.vec_id, s.n, s.i, s.c, t.i HAVING min(r.m) >= 0.5),{_greedy_sql("vec_id")}
SELECT vec_id, CASE c WHEN 0 THEN '{NAMES[0]}' WHEN 1 THEN '{NAMES[1]}' ELSE 'organization' END AS type, surface AS text, round(p, 6) AS confidence, start_ AS start FROM gr"""


def tensor_instances(spark, sf_dir):
    """Relations and structures from tensors [2][2 fields][4 words][4 widths] and a count of up to three instances."""
    p = F.transform("e", lambda x: sigmoid(8 * x.cast("double")))
    rows = _tensors(spark, sf_dir, "4").withColumn("scores", _nested(p, 2, 2, 4, 4)).withColumn("n", F.expr("pmod(vec_id, 4)").cast("int"))
    rows = T.structures_of(T.relations_of(rows, "scores", F.col("n"), ["head", "tail"], 0.7, 4), "scores", F.col("n"), (Field("head"), Field("tail", "LIST")), 0.7, 4)
    of = lambda c: F.concat(c["text"], F.lit("@"), c["start"].cast("string"))
    related = F.transform("relations", lambda r: F.array_join(F.transform(r["fields"], of), ">"))
    structured = F.transform("structures", lambda s: F.array_join(F.transform(F.map_entries(s), lambda e: F.concat(e["key"], F.lit("="), F.array_join(F.transform(e["value"], of), "+"))), ","))
    return rows.select("vec_id", F.size("relations").cast("long").alias("n_relations"), F.array_join(related, ";").alias("relations"), F.size("structures").cast("long").alias("n_structures"), F.array_join(structured, ";").alias("structures"))


TENSOR_INSTANCES = f"""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS o FROM embeddings WHERE len(embedding) = 64),
sc AS (SELECT vec_id, 1 / (1 + exp(-8 * x)) AS p, o // 32 AS inst, o // 16 % 2 AS f, o // 4 % 4 AS i, o % 4 AS j FROM e WHERE o // 32 < vec_id % 4 AND o // 4 % 4 + o % 4 < 5 + vec_id % 4),
ca AS (SELECT vec_id, inst, f, i * 4 + j AS ord, i * 3 AS start_, (i + j) * 3 + 2 AS end_, array_to_string(list_transform(range(i, i + j + 1), lambda k: 'w' || k), ' ') || '@' || (i * 3) AS x, p FROM sc WHERE p >= 0.7),
be AS (SELECT * FROM ca QUALIFY row_number() OVER (PARTITION BY vec_id, inst, f ORDER BY p DESC, ord) = 1),
re AS (SELECT h.vec_id, h.inst, h.x || '>' || t.x AS x FROM be h JOIN be t ON h.vec_id = t.vec_id AND h.inst = t.inst AND h.f = 0 AND t.f = 1 QUALIFY row_number() OVER (PARTITION BY h.vec_id, h.start_, h.end_, t.start_, t.end_ ORDER BY h.inst) = 1),
lt AS (SELECT * FROM ca WHERE f = 1),{_greedy_sql("vec_id, inst", source="lt")},
ls AS (SELECT vec_id, inst, string_agg(x, '+' ORDER BY start_) AS x FROM gr GROUP BY ALL),
st AS (SELECT v.vec_id, r.inst, array_to_string(list_filter(['head=' || b.x, 'tail=' || ls.x], lambda x: x IS NOT NULL), ',') AS x FROM embeddings v JOIN range(2) r(inst) ON r.inst < v.vec_id % 4
  LEFT JOIN be b ON b.vec_id = v.vec_id AND b.inst = r.inst AND b.f = 0 LEFT JOIN ls ON ls.vec_id = v.vec_id AND ls.inst = r.inst WHERE len(v.embedding) = 64),
ra AS (SELECT vec_id, count(*) AS n, string_agg(x, ';' ORDER BY inst) AS t FROM re GROUP BY ALL), sa AS (SELECT vec_id, count(*) AS n, string_agg(x, ';' ORDER BY inst) AS t FROM st GROUP BY ALL)
SELECT v.vec_id, coalesce(ra.n, 0) AS n_relations, coalesce(ra.t, '') AS relations, coalesce(sa.n, 0) AS n_structures, coalesce(sa.t, '') AS structures FROM embeddings v LEFT JOIN ra USING (vec_id) LEFT JOIN sa USING (vec_id) WHERE len(v.embedding) = 64"""


def queries() -> dict:
    return {"structures_instances": structures_instances, "extract_schema": extract_schema, "boundary_evidence": boundary_evidence, "label_embeddings": label_embeddings, "row_layout": row_layout, "usage_cold_cache": usage_cold_cache, "tensor_spans": tensor_spans, "tensor_tokens": tensor_tokens, "tensor_instances": tensor_instances}


def oracle_sql() -> dict[str, str]:
    return {"structures_instances": STRUCTURES, "extract_schema": _schema_sql(), "boundary_evidence": _evidence_sql(), "label_embeddings": LABEL_EMBEDDINGS, "row_layout": _layout_sql(), "usage_cold_cache": USAGE_COLD, "tensor_spans": TENSOR_SPANS, "tensor_tokens": TENSOR_TOKENS, "tensor_instances": TENSOR_INSTANCES}
