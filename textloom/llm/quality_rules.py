"""Quality rules as a short-circuit cascade, in DataFrame functions only.

``statistics`` adds per-text counts. ``estimate`` finds, on a sample of rows and in one job,
what each rule costs (counted: characters and values that its condition goes through, so
that the figures are the same in every run) and how many rows it rejects; ``cascade`` orders
the rules by rejection per cost and stops at the first that fails. The order changes the
time and the reported reason, never the verdict. Statistics are results themselves, and
computed for every row: a rule over them costs a comparison, and those that go through the
text again come after the rules that reject more for less.

Defined cases: a null text has no words and fails the base rules; empty and blank
texts likewise; very long texts are counted whole; rules of equal rejection per cost keep
their given order; repeated rows and null ids are judged row by row; an empty table gives
an empty table (rules then keep their given order); extra columns are carried along, and a
column with the name of a result is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let, spaced_pieces

#: Characters that count as symbols. Fixed values.
SYMBOLS = ("#", "*", "$", "%", "&", "|", "<", ">")
WINDOW = 8
#: Rows, about, on which cost and selectivity are measured.
SAMPLE_ROWS = 512


@dataclass(frozen=True)
class Rule:
    """``fails`` is a condition over the statistics or the text; null counts as passed. ``work``: how many characters and values it goes through, one if none is given."""

    name: str
    fails: Column
    work: Column | None = None

    def cost(self) -> Column:
        return (F.lit(1) if self.work is None else self.work).cast("double")


def base_rules() -> list[Rule]:
    n = F.col("n_words")
    return [Rule("few_words", n < 20), Rule("repeats", 100 * F.col("n_repeat_words") > 30 * n)]


def method_rules() -> list[Rule]:
    """Each rule looks for one kind of junk and leaves ordinary prose alone."""
    n, text = F.col("n_words"), F.coalesce("text", F.lit(""))
    capitals = F.length(F.regexp_replace(text, r"[^\p{Lu}]+", ""))
    chars = F.length(text)
    return [
        Rule("symbols", 5 * F.col("n_symbols") > n),
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n), F.lit(2)),
        Rule("same_lines", 100 * F.col("n_dup_lines") > 30 * F.size(F.split(text, "\n", -1)), chars + 1),
        # a regular expression takes several steps a character
        Rule("shouting", 2 * capitals > F.col("word_chars"), 5 * chars + 1),
        Rule("exclaiming", 4 * (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))) > n, 2 * chars + 1),
    ]


def _repeated(h: Column) -> Column:
    """Words covered by windows whose hash occurs twice, given window hashes in order of position."""

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def positions(s: Column) -> Column:
        same = lambda x, j: F.coalesce(x["h"] == F.get(s, j)["h"], F.lit(False))
        return F.sort_array(F.array_compact(F.transform(s, lambda x, i: F.when(same(x, i - 1) | same(x, i + 1), x["p"]))))

    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    return F.when(F.size(F.array_distinct(h)) < F.size(h), let(pairs, lambda s: let(positions(s), covered))).otherwise(F.lit(0).cast("long"))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (all long).

    Windows are compared by 64-bit hashes that are built by doubling (1, 2, 4, 8 words),
    and sorted within the row only if one occurs twice: no shuffle, and time in
    proportion to n log n at worst.
    """
    own = F.coalesce(F.col(text), F.lit(""))
    bare = own
    for s in SYMBOLS:
        bare = F.replace(bare, F.lit(s), F.lit(""))
    lines = F.filter(F.split(own, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    pieces, words, own_lines, h = fresh(docs.columns, "_pieces", "_words", "_lines", "_h")
    out = docs.withColumn(pieces, spaced_pieces(own)).withColumn(words, F.array_remove(pieces, "")).withColumn(own_lines, lines)
    out = out.withColumn(h, F.transform(words, lambda w: F.xxhash64(w)))
    for step in (1, 2, 4):
        shifted = F.slice(h, step + 1, F.greatest(F.size(h), F.lit(0)))
        out = out.withColumn(h, F.zip_with(h, shifted, lambda a, b: F.xxhash64(a, b)))
    out = out.withColumn(h, F.slice(h, 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0))))
    found = {
        "n_words": F.size(words),
        "word_chars": F.length(own) - F.size(pieces) + 1,
        "n_symbols": F.length(own) - F.length(bare),
        "n_dup_lines": F.size(own_lines) - F.size(F.array_distinct(own_lines)),
        "n_repeat_words": _repeated(F.col(h)),
    }
    out = out.withColumns({k: v.cast("long") for k, v in found.items()})
    return out.drop(pieces, words, own_lines, h)


def estimate(docs: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS) -> dict[str, tuple[float, float]]:
    """Rule name -> (work a row, share rejected), on about ``sample_rows`` rows of ``docs`` (texts), in one job."""
    n = docs.count()
    sample = statistics(docs.sample(min(1.0, sample_rows / max(n, 1)), seed=0))
    row = sample.agg(*(x for r in rules for x in (F.avg(r.cost()), F.avg(F.coalesce(r.fails, F.lit(False)).cast("double"))))).first()
    return {r.name: (row[2 * k] or 1.0, row[2 * k + 1] or 0.0) for k, r in enumerate(rules)}


def ordered(rules: list[Rule], found: dict[str, tuple[float, float]]) -> list[Rule]:
    """Most rejection per cost first; ties keep the given order."""
    return sorted(rules, key=lambda r: -found[r.name][1] / max(found[r.name][0], 1e-12))


def cascade(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds ``failed_rule``: the first rule that fails, else null. Later rules aren't evaluated."""
    return docs.withColumn("failed_rule", F.coalesce(*(F.when(r.fails, F.lit(r.name)) for r in rules), F.lit(None).cast("string")))


def judge(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Statistics, ``base_failed``, ``kept`` and ``failed_rule`` for every row."""
    rules = base_rules() + method_rules() if rules is None else rules
    found = estimate(docs.select("text"), rules, sample_rows)
    base = F.lit(False)
    for r in base_rules():
        base = base | r.fails
    out = cascade(statistics(docs), ordered(rules, found))
    return out.withColumns({"base_failed": base, "kept": F.col("failed_rule").isNull() & ~base})


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
p AS (SELECT r, unnest(range(1, len(words) - 6)) AS pos, unnest(list_transform(range(1, len(words) - 6), lambda i: array_to_string(words[i:i + 7], ' '))) AS win FROM w WHERE len(words) >= 8),
g AS (SELECT r, pos, count(*) OVER (PARTITION BY r, win) AS n FROM p),
c AS (SELECT r, count(DISTINCT q) AS n_repeat FROM (SELECT r, unnest(range(pos, pos + 8)) AS q FROM g WHERE n > 1) GROUP BY r),
s AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words,
    len(string_split(text, chr(10))) AS n_lines, length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) AS n_upper,
    length(regexp_replace(text, '[^!]+', '', 'g')) AS n_bang
  FROM w LEFT JOIN c USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 5 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR 100 * n_dup_lines > 30 * n_lines OR 2 * n_upper > word_chars OR 4 * n_bang > n_words) AS kept
FROM b
"""
