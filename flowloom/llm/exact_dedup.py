"""Exact deduplication with a heavy-hitter split (DataFrame functions only).

Digests (SHA-256 of the white-space-normalised text) are computed in one pass and staged. A
Misra-Gries summary (Spark's ``freqItems``) names at most ``1 / support`` candidates that could hold
more than ``support`` of all rows; an exact count verifies them, and the verified winners, whose
number the summary bounds, are broadcast, so that rows of large groups are settled on the map side.
The remaining digests, each below ``support`` of the rows, go through an ordinary shuffle, summed before it.

Defined cases: a null text is the empty text; texts of any length are read whole; a null doc_id sorts after every other id; of rows that
repeat both id and text, one (the first in the staged order) stays; an empty table gives an empty
result; extra columns are ignored by ``exact_groups`` and kept by ``drop_exact_copies``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def text_digest(text: Column) -> Column:
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), common.WS, " "), 256)


def _settle(spark: SparkSession, digests: DataFrame, support: float) -> DataFrame:
    """digests(doc_id, uid, text_sha256), staged -> the same rows with first (the struct that stays) and group_size."""
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("uid"))
    sums = (F.count(F.lit(1)).alias("group_size"), F.min(order).alias("first"))
    candidates = digests.stat.freqItems(["text_sha256"], support).select(F.explode(F.col("text_sha256_freqItems")).alias("text_sha256"))
    winners = digests.join(F.broadcast(candidates), "text_sha256").groupBy("text_sha256").agg(*sums).filter("group_size > 1")
    winners = common.stage(spark, winners, "winners")
    heavy = digests.join(F.broadcast(winners), "text_sha256")
    rest = digests.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    # summed before the shuffle, and staged: a group's rows meet its sum in a join of plain shuffles, which can be split
    groups = common.stage(spark, rest.groupBy("text_sha256").agg(*sums).filter("group_size > 1"), "groups")
    light = rest.join(groups, "text_sha256", "left").select(
        *[F.col(c) for c in digests.columns], F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.coalesce("first", order).alias("first")
    )
    return heavy.unionByName(light)


def exact_groups(spark: SparkSession, docs: DataFrame, support: float = 1e-3) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = common.stage(spark, docs.select("doc_id", F.monotonically_increasing_id().alias("uid"), text_digest(F.col("text")).alias("text_sha256")), "digests")
    return _settle(spark, digests, support).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("first.uid")).alias("kept"), "text_sha256"
    )


def drop_exact_copies(spark: SparkSession, docs: DataFrame, support: float = 1e-3) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    The rows are numbered once, in a staged copy, so that a kept row is found again by its number.
    """
    row = docs.select(common.whole_row(docs).alias("row"), "doc_id", F.monotonically_increasing_id().alias("uid"), text_digest(F.col("text")).alias("text_sha256"))
    numbered = common.stage(spark, row, "numbered")
    # staged, so that its size is known and a small one is broadcast: the texts don't move then
    gone = common.stage(spark, _settle(spark, numbered.drop("row"), support).filter(F.col("uid") != F.col("first.uid")).select("uid"), "gone")
    return numbered.join(gone, "uid", "left_anti").select("row.*")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark, common.table(spark, sf_dir, "documents"))


SQL = {
    "op7_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d"""
}
QUERIES = {"op7_exact_dedup": op7_exact_dedup}
