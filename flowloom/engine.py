"""The engine's public names."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.expr import callee_matches, line_count
from .operators import edges, elements, metrics, reach, report, roles, store
from .operators.findings import Config, find_flows, find_stored_flows
from .operators.report import analyze_code, to_html, to_json
from .plans.schemas import DEFAULT_EDGE_KINDS, Graph
from .plans.staging import staged
from .sources import fixtures, rules, scan
from .sources.scan import parse_nodes, read_sources


def build_graph(nodes: DataFrame) -> Graph:
    return edges.build_graph(nodes)


def analyze(spark: SparkSession, sources: DataFrame, config: Config | None = None) -> tuple[Graph, DataFrame]:
    """sources(module_id, file, code) -> (graph, findings). Nodes and edges are written once, as every later step reads them."""
    nodes = staged(spark, parse_nodes(sources), "nodes")
    graph = Graph(nodes, staged(spark, edges.build_edges(nodes), "edges"))
    return graph, find_flows(spark, graph, config)


def analyze_stored(spark: SparkSession, sources: DataFrame, path: str, config: Config | None = None) -> tuple[Graph, DataFrame]:
    """As analyze, but the graph is kept below path and searched there: (graph, findings by all trails)."""
    nodes = staged(spark, parse_nodes(sources), "nodes")
    graph = Graph(nodes, staged(spark, edges.build_edges(nodes), "edges"))
    return graph, find_stored_flows(spark, graph, path, config)


def run_benchmark(spark: SparkSession, cases: DataFrame | None = None, config: Config | None = None) -> tuple[DataFrame, DataFrame]:
    """The labelled cases in one run -> (case results, metrics).

    All cases are analysed together, so what is measured is the whole run; a case's time is its share of it by lines.
    """
    cases = fixtures.cases(spark) if cases is None else cases
    began = time.perf_counter()
    _, found = analyze(spark, metrics.case_sources(cases), config)
    found = staged(spark, found, "findings")
    took = 1000 * (time.perf_counter() - began)
    lines = cases.agg(F.sum(line_count(F.col("code"))).alias("n")).first()["n"] or 1
    results = metrics.case_results(cases, found, F.lit(took) * line_count(F.col("code")) / lines)
    return results, metrics.metrics(results)


__all__ = [
    "DEFAULT_EDGE_KINDS", "Config", "Graph", "analyze", "analyze_code", "analyze_stored", "build_graph", "callee_matches", "elements", "find_flows", "find_stored_flows", "fixtures", "metrics",
    "parse_nodes", "reach", "read_sources", "report", "roles", "rules", "run_benchmark", "scan", "store", "to_html", "to_json",
]
