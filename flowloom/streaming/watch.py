"""Analysis of source files as they arrive: each micro-batch is a batch of modules of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..engine import analyze
from ..operators import findings


def source_stream(spark: SparkSession, path: str, pattern: str = "*.{js,ts}") -> DataFrame:
    """New files below path as a stream of sources."""
    lines = spark.readStream.format("text").schema("value string").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    full = F.col("_metadata.file_path")
    return lines.select(full.alias("module_id"), F.element_at(F.split(full, "/"), -1).alias("file"), F.col("value").alias("code"))


def watch(spark: SparkSession, path: str, out: str, checkpoint: str, config: findings.Config | None = None) -> StreamingQuery:
    """Appends the findings of new files to out. A batch that runs again overwrites its own folder, so results come once."""

    def each(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        _, found = analyze(session, batch, config)
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return source_stream(spark, path).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
