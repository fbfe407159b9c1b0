"""The labelled benchmark: per-case outcome and classification metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr


def case_sources(cases: DataFrame) -> DataFrame:
    """The cases as a sources table; the case id is the module, as cases may share a file name."""
    return cases.select(F.col("id").alias("module_id"), F.coalesce("file", F.concat(F.lower("id"), F.lit(".ts"))).alias("file"), "code")


def case_results(cases: DataFrame, findings: DataFrame, elapsed_ms: Column | None = None) -> DataFrame:
    """One row per case: findings, predicted label, confusion class. elapsed_ms: per case, 0 if not measured."""
    n = findings.groupBy(F.col("module_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    df = cases.join(n, "id", "left").withColumn("findings", F.coalesce("n", F.lit(0)).cast("long"))
    df = df.withColumn("predicted", expr.predicted_label(F.col("findings"), F.col("label"), F.col("min_findings"), F.col("max_findings")))
    return df.select(
        "case_ord", "id", "title", "label", "findings", "predicted", expr.confusion(F.col("label"), F.col("predicted")).alias("classification"),
        (F.col("label") == F.col("predicted")).alias("correct"), (elapsed_ms if elapsed_ms is not None else F.lit(0.0)).alias("elapsed_ms"),
        expr.line_count(F.col("code")).alias("line_count"), "cwe", "tags",
    )


def _share(a: Column, b: Column, empty: float) -> Column:
    return F.when(b == 0, F.lit(empty)).otherwise(a / b)


def metrics(results: DataFrame) -> DataFrame:
    """One row, also of no cases: counts, precision and recall (1 where undefined), f1, accuracy, times."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    row = results.agg(
        *[F.count_if(F.col("classification") == k).alias(k.lower()) for k in ("TP", "FP", "TN", "FN")],
        F.count(F.lit(1)).alias("total_cases"), total("findings").cast("long").alias("total_findings"),
        total("elapsed_ms").cast("double").alias("total_elapsed_ms"), total("line_count").cast("long").alias("lines"),
    )
    row = row.withColumn("precision", _share(F.col("tp").cast("double"), F.col("tp") + F.col("fp"), 1.0)).withColumn("recall", _share(F.col("tp").cast("double"), F.col("tp") + F.col("fn"), 1.0))
    p, r = F.col("precision"), F.col("recall")
    return row.select(
        "tp", "fp", "tn", "fn", "precision", "recall", F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r)).alias("f1"),
        _share((F.col("tp") + F.col("tn")).cast("double"), F.col("total_cases"), 0.0).alias("accuracy"), "total_cases", "total_findings", "total_elapsed_ms",
        _share(F.col("total_elapsed_ms"), F.col("lines"), 0.0).alias("ms_per_line"),
    )


def corpus_stats(cases: DataFrame) -> DataFrame:
    return cases.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("label") == "vulnerable").alias("vulnerable"), F.count_if(F.col("label") == "safe").alias("safe"),
        F.coalesce(F.sum(expr.line_count(F.col("code"))), F.lit(0)).cast("long").alias("lines"),
    )


def failed(results: DataFrame) -> DataFrame:
    return results.filter("NOT correct")


def report_table(results: DataFrame, row: DataFrame) -> str:
    """The tab-separated table of a benchmark run with its summary lines (a row per case of the benchmark)."""
    mark = F.when(F.col("correct"), "✓").otherwise("✗")
    line = F.concat_ws("\t", "id", "title", "label", F.col("findings").cast("string"), "classification", mark, F.format_string("%.1f", F.col("elapsed_ms").cast("double")))
    lines = [r["l"] for r in results.orderBy("case_ord").select(line.alias("l")).collect()]
    m = row.first()
    pct = lambda x: f"{x * 100:.1f}%"
    return "\n".join([
        "\t".join(("ID", "Título", "Esperado", "Findings", "Clase", "OK", "ms")), *lines, "", "── Métricas (clasificación por snippet) ──",
        f"TP={m['tp']}  FP={m['fp']}  TN={m['tn']}  FN={m['fn']}",
        f"Precisión={pct(m['precision'])}  Recall={pct(m['recall'])}  F1={pct(m['f1'])}  Accuracy={pct(m['accuracy'])}",
        f"Tiempo total={m['total_elapsed_ms']:.1f}ms  ms/línea={m['ms_per_line']:.2f}",
    ])
