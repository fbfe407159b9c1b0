"""python -m flowloom benchmark | analyze PATH OUT"""

from __future__ import annotations

import json
import sys

from pyspark.sql import SparkSession

from . import engine


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("flowloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def benchmark(spark: SparkSession) -> int:
    """Corpus statistics, the table, the results as JSON; 1 if a case fails."""
    print(json.dumps(engine.metrics.corpus_stats(engine.fixtures.cases(spark)).first().asDict()))
    results, row = engine.run_benchmark(spark)
    print(engine.metrics.report_table(results, row))
    print(json.dumps({"cases": [r.asDict() for r in results.orderBy("case_ord").collect()], "metrics": row.first().asDict()}, ensure_ascii=False, indent=2))
    wrong = [r["id"] for r in engine.metrics.failed(results).collect()]
    if wrong:
        print("failed:", *wrong, file=sys.stderr)
    return int(bool(wrong))


def analyze(spark: SparkSession, path: str, out: str) -> int:
    """Findings of every source file below path, written to out."""
    _, found = engine.analyze(spark, engine.read_sources(spark, path))
    found.write.mode("overwrite").parquet(out)
    print(spark.read.parquet(out).count(), "findings")
    return 0


def main(args: list[str]) -> int:
    if args == ["benchmark"]:
        return benchmark(_session())
    if len(args) == 3 and args[0] == "analyze":
        return analyze(_session(), *args[1:])
    print(__doc__, file=sys.stderr)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
