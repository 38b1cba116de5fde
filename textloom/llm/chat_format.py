"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs and sorted, adjacent turns of one
role are merged by array aggregation, and blocks are concatenated::

    <s>role[INST]text[/INST][INST]text of the same role[/INST]</s>...

Control strings inside texts and roles are escaped with a backslash, so the output
can be read back turn by turn (``read_back``).

Defined cases: a null text or role is empty; a null turn sorts first; rows that tie on
turn are ordered by role, then text; repeated rows are turns of their own; rows with a
null conv_id form one conversation; extra columns are ignored; no rows give no rows.

A conversation may hold a large share of all rows, so turns are first formatted in
runs of ``RUN`` turn numbers, and only those runs meet in one row per conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

OPEN, SEP, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
#: What a text may not contain, and what stands for it.
ESCAPES = (("\\", "\\\\"), ("<s>", "\\ls>"), ("</s>", "\\l/s>"), ("[INST]", "\\bINST]"), ("[/INST]", "\\b/INST]"))
#: Turn numbers that are formatted together before runs are joined.
RUN = 256


def escaped(text: Column) -> Column:
    for plain, stands in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(stands))
    return text


def unescaped(text: Column) -> Column:
    """Doubled backslashes cut the text into parts in which ``\\l`` and ``\\b`` are unambiguous."""
    parts = F.split(text, r"\\\\", -1)
    plain = F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("[")))
    return F.array_join(plain, "\\")


#: Parts that are merged in one step of adding up lengths.
STEP = 64


def _places(sizes: Column) -> Column:
    """Where each of the parts begins, given their sizes: running sums within steps, and of whole steps before them."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    before = lambda a: F.transform(a, lambda _, i: total(F.slice(a, 1, i)))
    steps = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / STEP).cast("int")), lambda k: F.slice(sizes, k * STEP + 1, F.lit(STEP)))

    def joined(s: Column) -> Column:
        return let(before(F.transform(s, total)), lambda starts: F.flatten(F.transform(s, lambda part, k: F.transform(before(part), lambda x: x + F.get(starts, k)))))

    return let(steps, joined)


def _merged(parts: Column, glue) -> Column:
    """An array of structs(first, last, body, spans) as one; ``glue`` says what stands between two roles.

    What stands before each part is put in front of it, and all is concatenated once.
    """

    def whole(p: Column) -> Column:
        bodies = F.transform(p, lambda x, i: F.when(i == 0, x["body"]).otherwise(F.concat(glue(F.get(p, i - 1)["last"], x["first"]), x["body"])))

        def placed(b: Column) -> Column:
            def moved(starts: Column) -> Column:
                own = lambda x, i: F.get(starts, i) + F.length(F.get(b, i)) - F.length(x["body"])
                shift = lambda x, at: F.transform(x["spans"], lambda s: F.struct((s["start"] + at).alias("start"), (s["end"] + at).alias("end")))
                return F.flatten(F.transform(p, lambda x, i: shift(x, own(x, i))))

            spans = let(_places(F.transform(b, lambda x: F.length(x))), moved)
            return F.struct(F.get(p, 0)["first"].alias("first"), F.element_at(p, -1)["last"].alias("last"), F.array_join(b, "").alias("body"), spans.alias("spans"))

        return let(bodies, placed)

    return let(parts, whole)


def _glue(left: Column, right: Column) -> Column:
    return F.when(left == right, F.lit("")).otherwise(F.concat(F.lit(END + OPEN), right))


def format_chats(rows: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``conv_id, formatted, loss_spans``: one row per conversation.

    ``loss_spans`` are code point ranges (end exclusive) of ``formatted`` that hold the
    texts of ``loss_role``, in order and without any control string.
    """
    role, text = escaped(F.coalesce("role", F.lit(""))), escaped(F.coalesce("text", F.lit("")))
    turns = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    runs = turns.groupBy("conv_id", F.floor(F.col("turn") / RUN).alias("run")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def piece(t: Column) -> Column:
        spans = F.array(F.struct(F.lit(len(SEP)).alias("start"), (F.length(t["text"]) + len(SEP)).alias("end")))
        return F.struct(
            t["role"].alias("first"),
            t["role"].alias("last"),
            F.concat(F.lit(SEP), t["text"], F.lit(CLOSE)).alias("body"),
            F.when(t["role"] == escaped(F.lit(loss_role)), spans).otherwise(F.slice(spans, 1, 0)).alias("spans"),
        )

    runs = runs.select("conv_id", "run", _merged(F.transform("turns", piece), _glue).alias("part"))
    whole = runs.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("run", "part"))).alias("runs"))
    whole = whole.select("conv_id", _merged(F.transform("runs", lambda r: r["part"]), _glue).alias("all"))
    head = F.concat(F.lit(OPEN), F.col("all.first"))
    moved = F.transform("all.spans", lambda s: F.struct((s["start"] + F.length(head)).alias("start"), (s["end"] + F.length(head)).alias("end")))
    return whole.select("conv_id", F.concat(head, F.col("all.body"), F.lit(END)).alias("formatted"), moved.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``turns`` (array of role, text) and ``loss_text``, both taken from the formatted output alone."""

    def turns(block: Column) -> Column:
        parts = F.split(F.substring(block, len(OPEN) + 1, 2**31 - 1), r"\[/?INST\]", -1)
        # role, text, "", text, "", ...
        texts = F.filter(parts, lambda _, i: i % 2 == 1)
        return F.transform(texts, lambda t: F.struct(unescaped(F.element_at(parts, 1)).alias("role"), unescaped(t).alias("text")))

    blocks = F.filter(F.split("formatted", END, -1), lambda b: b != "")
    loss = F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return formatted.withColumns({"turns": F.flatten(F.transform(blocks, turns)), "loss_text": F.array_join(loss, "")})


def digest(rows: DataFrame) -> DataFrame:
    """Columns of the contract, all read back from the formatted text."""
    back = read_back(format_chats(rows))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The conversation that the contract adds.
EXTRA = "SELECT -7L AS conv_id, CAST(k AS BIGINT) AS turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS t(k, role)"


def query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return digest(rows.unionByName(spark.sql(EXTRA)))


SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *,
  length(replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '\ls>'), '</s>', '\l/s>'), '[INST]', '\bINST]'), '[/INST]', '\b/INST]')) AS n_text,
  length(replace(replace(replace(replace(replace(role, '\', '\\'), '<s>', '\ls>'), '</s>', '\l/s>'), '[INST]', '\bINST]'), '[/INST]', '\b/INST]')) AS n_role,
  lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS DISTINCT FROM role AS opens
  FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n_text + 13 + CASE WHEN opens THEN n_role + 7 ELSE 0 END) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
