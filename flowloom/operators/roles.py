"""Roles: which nodes are sources, sinks and sanitizers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr

PRIORITY = {"source": 0, "sink": 1, "sanitizer": 2}


@dataclass(frozen=True)
class Predicate:
    """A rule of its own: any condition on the node columns."""

    rule_id: str
    kind: str
    condition: Column
    cwe: int | None = None
    cwe_name: str | None = None


def rule_hits(nodes: DataFrame, rules: DataFrame | list[Predicate]) -> DataFrame:
    """(module_id, node_ord, node_id, kind, role, rule_ord, rule_id, cwe, cwe_name) for each node and rule that match.

    Patterns are held against distinct callees only, by a broadcast of the rules: a catalog's rows, whose
    number does not depend on the data.
    """
    keys = ["module_id", "node_ord", F.col("id").alias("node_id"), F.col("kind").alias("node_kind")]
    if isinstance(rules, list):
        out = None
        for i, r in enumerate(rules):
            one = nodes.filter(r.condition).select(
                *keys, F.lit(r.kind).alias("role"), F.lit(i).alias("rule_ord"), F.lit(r.rule_id).alias("rule_id"), F.lit(r.cwe).cast("int").alias("cwe"), F.lit(r.cwe_name).cast("string").alias("cwe_name")
            )
            out = one if out is None else out.unionByName(one)
        if out is None:
            raise ValueError("no rules")
        return out
    tail = ["role", "rule_ord", "rule_id", "cwe", "cwe_name"]
    table = rules.withColumnRenamed("rule_kind", "role")
    callees = nodes.filter("kind = 'Call'").select("callee").distinct()
    hits = callees.join(F.broadcast(table.filter("pattern IS NOT NULL")), expr.callee_matches(F.col("callee"), F.col("pattern")))
    of_calls = nodes.filter("kind = 'Call'").join(hits, "callee").select(*keys, *tail)
    source = F.broadcast(table.filter("pattern IS NULL"))
    of_params = nodes.filter(expr.is_param_source(F.col("kind"), F.col("name"))).join(source, F.col("kind") == F.lit("Parameter")).select(*keys, *tail)
    return of_calls.unionByName(of_params)


def roles_of(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """(module_id, node_ord, node_id, role), one row per node and role; parameters that a call binds are no sources."""
    found = hits.select("module_id", "node_ord", "node_id", "node_kind", "role").distinct()
    bound = edges.filter("kind = 'BINDS_TO'").select("module_id", F.col("dst").alias("node_id"), F.lit("source").alias("role"), F.lit("Parameter").alias("node_kind")).distinct()
    return found.join(bound, ["module_id", "node_id", "role", "node_kind"], "left_anti").select("module_id", "node_ord", "node_id", "role")


def main_role(roles: DataFrame) -> DataFrame:
    """(module_id, node_id, role): one role per id; sources before sinks before sanitizers."""
    rank = F.when(F.col("role") == "source", 0).when(F.col("role") == "sink", 1).otherwise(2)
    return roles.groupBy("module_id", "node_id").agg(F.min_by("role", rank).alias("role"))


def role_lists(roles: DataFrame) -> DataFrame:
    """(module_id, source_ids, sink_ids, sanitizer_ids), in node order; lists are of one module."""

    def ids(role: str) -> Column:
        pairs = F.collect_list(F.when(F.col("role") == role, F.struct("node_ord", "node_id")))
        return F.transform(F.array_sort(pairs), lambda p: p["node_id"]).alias(f"{role}_ids")

    return roles.groupBy("module_id").agg(*[ids(r) for r in PRIORITY])


def first_sink_rule(hits: DataFrame, last: bool = False) -> DataFrame:
    """(module_id, sink_id, cwe, cwe_name, rule_id): of the first (or last) sink node with the id, its first rule."""
    sinks = hits.filter("role = 'sink'")
    what = F.struct("cwe", "cwe_name", "rule_id")
    per_node = sinks.groupBy("module_id", "node_id", "node_ord").agg(F.min_by(what, "rule_ord").alias("r"))
    pick = F.max_by("r", "node_ord") if last else F.min_by("r", "node_ord")
    return per_node.groupBy("module_id", F.col("node_id").alias("sink_id")).agg(pick.alias("r")).select("module_id", "sink_id", "r.*")
