"""The corpus pipeline: language ID, near-duplicate removal, PII redaction, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``. Before a stage the
driver and the executors give back the memory that the one before it left.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.llm import langid, mixing, ngram_join, packing, pii
from loomgrid.llm.common import distinct_ids, ordered_keys, rest_all, sized, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def rested(stage: Stage) -> Stage:
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        rest_all(spark)
        return stage(spark, docs, sf_dir)

    return run


@rested
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; text without letters and undecided text go."""
    model = langid.fit_on(docs)
    found = langid.identify(docs, model)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= 0.5)).select(*docs.columns)


@rested
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of shingle similarity 0.8 or more join: the one of least doc_id (null ids come first, rows that
    share an id in the order of a hash of their text). Documents without words are no one's duplicates and all stay."""
    unique = distinct_ids(docs, "doc_id")
    rows = docs.withColumn("_key", F.col("doc_id").cast("long")) if unique else ordered_keys(docs, "doc_id", "text", "_key")
    found = written(spark, ngram_join.ngram_components(rows.select(F.col("_key").alias("doc_id"), "text")).select("doc_id", "component_id"), "components")
    gone = sized(written(spark, found.where("doc_id <> component_id").select(F.col("doc_id").alias("_key")), "gone"))
    return rows.join(gone, "_key", "left_anti").select(*docs.columns)


@rested
def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; n_chars follows."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


@rested
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rates for no toxic tokens and all the others' own; documents whose rate rounds to 0 go."""
    rates = mixing.mix(docs, table(spark, sf_dir, "labels"), {"toxic": 0.0}, max_rate=1.0, keep=tuple(docs.columns))
    return rates.where("rate >= 0.5").select(*docs.columns)


@rested
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language_id", language), ("ngram_jaccard", near_duplicates), ("pii", private_data), ("source_mixing", source_mix), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
