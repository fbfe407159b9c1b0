"""The corpus pipeline: five stages over ``documents``, each of which decides for itself.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.

Defined cases: a null text is the empty text, which fails the base rules; texts of any length are read whole; of rows
that repeat id and text one stays; of equal or similar texts the smallest doc_id stays (a null one only if all are
null); extra columns, whatever their names, go through all stages but the last; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from flowloom.llm import common, exact_dedup, packing, quality_rules, similar, toxicity

#: Tables that earlier stages staged for themselves.
_left: list[str] = []


def stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage's result is written before the next stage runs, so what the stages before staged, and docs doesn't read, goes first."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.release(spark, _left, docs)
        with common.collecting(_left):
            return f(spark, docs, sf_dir)

    return run_stage


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that score as toxic go."""
    return toxicity.drop_toxic(docs, toxicity.fit(spark, docs, toxicity.learning_labels(spark, sf_dir)))


@stage
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that fail the base rules or whose posterior is low go."""
    return quality_rules.keep_good(spark, docs)


@stage
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of equal texts the row with the smallest doc_id stays."""
    return exact_dedup.drop_exact_copies(spark, docs)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2 with the pipeline's rule: of texts linked by a similarity of 0.8 (5-word shingles) the row with the smallest doc_id stays."""
    return similar.drop_similar(spark, docs)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: the pieces of the packed sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", keep_good),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("packing", pack),
]
#: Learnt scores, EM and packing can't be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what stands between them is written to the shared folder and goes once it is read."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, run_stage in STAGES:
        docs = common.stage(spark, run_stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            common.forget(spark, before)
        before = docs
    return docs
