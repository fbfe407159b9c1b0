"""Findings: unsanitized source-to-sink paths, with the weakness class of the sink."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.schemas import DEFAULT_EDGE_KINDS, MAX_DEPTH, Graph
from ..plans.staging import staged
from ..sources import rules as catalog
from . import reach, roles, store

COLUMNS = ("module_id", "finding_ord", "source_id", "sink_id", "path", "sanitized", "cwe", "cwe_name", "rule_id")


@dataclass(frozen=True)
class Config:
    """rules replace the catalog's; max_depth and edge_kinds bound the traversal; mode is 'shortest' or 'all_paths'.

    plan: 'grouped' searches module by module, 'levels' joins level by level from the sinks; they give the same rows.
    """

    rules: DataFrame | list[roles.Predicate] | None = None
    max_depth: int = MAX_DEPTH
    edge_kinds: tuple[str, ...] = DEFAULT_EDGE_KINDS
    mode: str = "shortest"
    plan: str = "grouped"


def sanitized_keys(paths: DataFrame, sanitizers: DataFrame) -> DataFrame:
    """(module_id, source_id, node_id) of paths with a sanitizer strictly between their ends."""
    inner = paths.filter(F.size("path") > 2).select("module_id", "source_id", "node_id", F.explode(F.expr("slice(path, 2, size(path) - 2)")).alias("mid"))
    return inner.join(sanitizers.select("module_id", F.col("node_id").alias("mid")).distinct(), ["module_id", "mid"], "left_semi").select("module_id", "source_id", "node_id").distinct()


def _ordered(df: DataFrame, role_rows: DataFrame, *more: str) -> DataFrame:
    """Adds finding_ord by the order of sources, then of sinks."""
    ords = role_rows.groupBy("module_id", "node_id", "role").agg(F.min("node_ord").alias("o"))
    src = ords.filter("role = 'source'").select("module_id", F.col("node_id").alias("source_id"), F.col("o").alias("source_ord"))
    snk = ords.filter("role = 'sink'").select("module_id", F.col("node_id").alias("sink_id"), F.col("o").alias("sink_ord"))
    order = Window.partitionBy("module_id").orderBy("source_ord", "sink_ord", *more)
    return df.join(src, ["module_id", "source_id"]).join(snk, ["module_id", "sink_id"]).withColumn("finding_ord", F.row_number().over(order) - 1)


def find_flows(spark: SparkSession, graph: Graph, config: Config | None = None) -> DataFrame:
    """The findings table (COLUMNS) of all modules of a graph."""
    config = config or Config()
    rule_rows = catalog.rules(spark) if config.rules is None else config.rules
    # both are read by several later steps: written once instead of worked out again
    hits = staged(spark, roles.rule_hits(graph.nodes, rule_rows), "hits")
    found = staged(spark, roles.roles_of(hits, graph.edges), "roles")
    by_role = {r: found.filter(F.col("role") == r).select("module_id", "node_id").distinct() for r in roles.PRIORITY}
    starts = by_role["source"].withColumnRenamed("node_id", "source_id")
    if config.mode == "all_paths":
        main = roles.main_role(found)
        of = lambda r: main.filter(F.col("role") == r).select("module_id", "node_id")
        trails = reach.all_paths(spark, graph.edges, of("source").withColumnRenamed("node_id", "source_id"), of("sink"), of("sanitizer"), config.max_depth, config.edge_kinds)
        pairs = trails.withColumnRenamed("node_id", "sink_id")
        rows = _ordered(pairs, found, "path_ord").join(roles.first_sink_rule(hits, last=True), ["module_id", "sink_id"], "left")
        return rows.withColumn("sanitized", F.lit(False)).select(*COLUMNS)
    if config.mode != "shortest":
        raise ValueError(config.mode)
    if config.plan == "levels":
        paths = reach.shortest_paths_to(spark, graph.edges, starts, by_role["sink"], config.max_depth, config.edge_kinds)
    else:
        paths = reach.shortest_paths_grouped(graph.edges, starts, config.max_depth, config.edge_kinds)
    to_sinks = staged(spark, paths.join(by_role["sink"], ["module_id", "node_id"], "left_semi"), "paths")
    clean = to_sinks.join(sanitized_keys(to_sinks, by_role["sanitizer"]), ["module_id", "source_id", "node_id"], "left_anti").withColumnRenamed("node_id", "sink_id")
    rows = _ordered(clean, found).join(roles.first_sink_rule(hits), ["module_id", "sink_id"], "left")
    return rows.withColumn("sanitized", F.lit(False)).select(*COLUMNS)


def find_stored_flows(spark: SparkSession, graph: Graph, path: str, config: Config | None = None) -> DataFrame:
    """Persist, query, enrich: the graph is stored below path, its trails are searched there, and the sinks' rules are added."""
    config = config or Config()
    rule_rows = catalog.rules(spark) if config.rules is None else config.rules
    hits = staged(spark, roles.rule_hits(graph.nodes, rule_rows), "hits")
    found = staged(spark, roles.roles_of(hits, graph.edges), "roles")
    store.write(graph, found, path)
    trails = staged(spark, store.read_flows(spark, path, config.max_depth), "trails")
    rows = _ordered(trails, found, "path").join(roles.first_sink_rule(hits, last=True), ["module_id", "sink_id"], "left")
    return rows.withColumn("sanitized", F.lit(False)).select(*COLUMNS)
