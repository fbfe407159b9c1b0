"""The rule catalog: JSON entries to the ordered rule table."""

from __future__ import annotations

import json
import warnings
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr

ENTRY = "cwe int, name string, sources array<string>, sinks array<string>, sanitizers array<string>"
MANIFEST = "version int, entries array<string>"
RULE = "rule_ord int, rule_id string, rule_kind string, cwe int, cwe_name string, pattern string"
SOURCE_RULE, SOURCE_LABEL = "param-any", "Parámetros de función (excepto res/next)"


def default_dir() -> str:
    return str(Path(__file__).parent / "catalog")


@cache
def _packaged() -> list[tuple]:
    """The packaged entries, which lie with the driver and don't change: read once per process."""
    at = Path(default_dir())
    names = json.loads((at / "index.json").read_text(encoding="utf-8"))["entries"]
    found = [json.loads((at / n).read_text(encoding="utf-8")) for n in names]
    return [(i, e["cwe"], e["name"], e["sources"], e["sinks"], e["sanitizers"]) for i, e in enumerate(found)]


def _read(spark: SparkSession, schema: str, path: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def load(spark: SparkSession, directory: str | None = None) -> DataFrame:
    """Catalog entries in the manifest's order: entry_ord and ENTRY. Without a manifest, no entries."""
    if directory in (None, default_dir()):
        return spark.createDataFrame(_packaged(), f"entry_ord int, {ENTRY}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(f"{directory}/index.json")
    if not at.getFileSystem(conf).exists(at):
        return spark.createDataFrame([], f"entry_ord int, {ENTRY}")
    names = [r["e"] for r in _read(spark, MANIFEST, f"{directory}/index.json").select(F.explode("entries").alias("e")).collect()]
    out = None
    for i, name in enumerate(names):  # a handful of files, each its own place in the order
        one = _read(spark, ENTRY, f"{directory}/{name}").select(F.lit(i).alias("entry_ord"), "*")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], f"entry_ord int, {ENTRY}")


def _patterns(entries: list) -> list[tuple]:
    """(rule_ord, rule_kind, cwe, cwe_name, pattern): per entry its sinks, then its sanitizers."""
    rows = [(kind, cwe, name, p) for _, cwe, name, _, sinks, sanitizers in sorted(entries, key=lambda e: e[0]) for kind, held in (("sink", sinks), ("sanitizer", sanitizers)) for p in held or ()]
    return [(i + 1, *r) for i, r in enumerate(rows)]


def rules(spark: SparkSession, entries: DataFrame | None = None) -> DataFrame:
    """The ordered rule table (RULE): the source rule, then the catalog's patterns. A catalog has tens of entries."""
    named = _patterns(_packaged() if entries is None else entries.collect())
    table = spark.createDataFrame(named, "rule_ord int, rule_kind string, cwe int, cwe_name string, pattern string")
    rule_id = F.concat(F.lit("cwe-"), F.col("cwe").cast("string"), F.lit("-"), F.col("rule_kind"), F.lit("-"), expr.rule_slug(F.col("pattern")))
    source = spark.createDataFrame([(0, SOURCE_RULE, "source", None, None, None)], RULE)
    return source.unionByName(table.select("rule_ord", rule_id.alias("rule_id"), "rule_kind", "cwe", "cwe_name", "pattern"))


def labels(rule_table: DataFrame) -> DataFrame:
    """(rule_id, label); of rules with one id the last counts."""
    label = F.when(F.col("rule_kind") == "source", F.lit(SOURCE_LABEL)).otherwise(F.concat(F.lit("CWE-"), F.col("cwe").cast("string"), F.lit(" "), F.col("rule_kind"), F.lit(": "), F.col("pattern")))
    return rule_table.groupBy("rule_id").agg(F.max_by(label, "rule_ord").alias("label"))


def summary(entries: DataFrame) -> DataFrame:
    """Per entry: cwe, name, number of sinks and sanitizers."""
    return entries.select("entry_ord", "cwe", "name", F.size("sinks").alias("n_sinks"), F.size("sanitizers").alias("n_sanitizers"))


def __getattr__(name: str):
    """RULE_LABELS, the packaged rules' labels by id, is kept for old callers; ``labels`` gives those of any rule table."""
    if name != "RULE_LABELS":
        raise AttributeError(name)
    warnings.warn("RULE_LABELS: use labels(rules(spark))", DeprecationWarning, stacklevel=2)
    spark = SparkSession.getActiveSession()
    return {r["rule_id"]: r["label"] for r in labels(rules(spark)).collect()}
