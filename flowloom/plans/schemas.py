"""Schemas of the engine's tables and the pair of tables that make a graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

SOURCES = "module_id string, file string, code string"
NODES = (
    "module_id string, file string, node_ord int, id string, kind string, name string, code string, line int, col int, `index` int, "
    "owner_fn_id string, init_text string, value string, callee string, arg_texts array<string>, param_ids array<string>, "
    "return_texts array<string>, parse_errors int"
)
EDGES = "module_id string, edge_ord int, kind string, src string, dst string"
NODE_KINDS = ("Function", "Parameter", "Variable", "Literal", "Call")
#: SANITIZED_BY is declared, never derived.
EDGE_KINDS = ("CALLS", "FLOWS_TO", "BINDS_TO", "RETURNS", "SANITIZED_BY")
DEFAULT_EDGE_KINDS = ("CALLS", "FLOWS_TO", "BINDS_TO", "RETURNS")
MAX_DEPTH = 15


@dataclass(frozen=True)
class Graph:
    """nodes: NODES, edges: EDGES; both carry module_id, by which all work is parted."""

    nodes: DataFrame
    edges: DataFrame
