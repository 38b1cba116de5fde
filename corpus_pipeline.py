"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``documents``. The result of a stage is to be written before the next is
called: folders that earlier stages left in the shared folder are removed then, except
those that ``docs`` itself still reads.

Defined cases, for every stage: an empty table gives an empty table of the same columns;
extra columns, whatever their names, are kept with their contents up to the last stage;
very long texts are read whole. Null and empty texts, ties and repeated rows: see the
stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import decontaminate, mixing, near_dup, pii, quality_model
from textloom.llm.common import fresh, text_key, without
from textloom.session import discard, discard_all, left, stored

#: Folders that stages have left, to be removed when a later stage begins.
_DONE: list[str] = []


def _begin(spark: SparkSession, docs: DataFrame) -> set[str]:
    """Remove what earlier stages left and ``docs`` doesn't read; what is there before this stage."""
    there = left(spark)
    old = [p for p in _DONE if p in there]
    read = {f.split(":", 1)[-1].lstrip("/") for f in docs.inputFiles()} if old else set()
    gone = [p for p in old if not any(f.startswith(p.split(":", 1)[-1].lstrip("/") + "/") for f in read)]
    discard_all(spark, gone)
    _DONE[:] = [p for p in old if p not in gone]
    return set(there) - set(gone)


def _end(spark: SparkSession, before: set[str], out: DataFrame) -> DataFrame:
    _DONE.extend(p for p in left(spark) if p not in before)
    return out


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Null and empty texts are scored by their statistics of 0; repeated rows go or stay together.
    """
    before = _begin(spark, docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    forest = quality_model.train(docs, labels)
    score, predicted = fresh(docs.columns, "_score", "_predicted")
    kept = quality_model.score(docs, forest, (score, predicted)).where(F.col(predicted) == 1)
    return _end(spark, before, kept.drop(score, predicted))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: the first by (doc_id, key), null ids last, and of rows that repeat it one.

    Texts without words are in no group, so that all of them stay, repeated rows apart.
    """
    before = _begin(spark, docs)
    marked = stored(near_dup.groups(docs).select("key", "component_key"), "groups")
    rows = without(docs, marked.where("key <> component_key").select("key"), text_key())
    twice = stored(marked.where("key = component_key").groupBy("key").count().where("count > 1").select("key"), "twice")
    if twice.isEmpty():
        return _end(spark, before, rows)
    own, again = fresh(docs.columns, "_own", "_again")
    once = rows.withColumn(own, text_key()).join(twice.select(F.col("key").alias(again)), F.col(own) == F.col(again), "left_semi")
    once = once.drop(own).dropDuplicates(["doc_id", "text"])
    return _end(spark, before, without(rows, twice, text_key()).unionByName(once))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item; null and empty texts have none, repeated rows go or stay together."""
    before = _begin(spark, docs)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = decontaminate.contamination(docs.select("doc_id", "text"), items)
    gone = stored(found.where("contaminated").select("key"), "contaminated")
    return _end(spark, before, without(docs, gone, text_key()))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data and secrets replaced by their kind; ``n_chars`` follows the text.

    Null texts stay null, and their ``n_chars`` as it is; repeated rows are changed alike.
    """
    before = _begin(spark, docs)
    rows = pii.redact(docs, pii.trained(pii.snippets(docs)))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        rows = rows.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return _end(spark, before, rows)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes, repeats counted; none of null and empty texts."""
    before = _begin(spark, docs)
    return _end(spark, before, mixing.taken(docs))


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("personal data", personal_data),
    ("source mix", mix),
]

#: Trees and a neural tagger decide here; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each result is written and read again."""
    docs, own = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        now = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if own is not None:
            discard(own)
        docs = own = now
    return STAGES[-1][1](spark, docs, sf_dir)
