"""Bounded reachability over an edge table.

Of the shortest paths between two nodes, the one with the least sequence of edge_ord counts: it is the path that a
first-in-first-out search of the ordered edges finds. Four plans give the same rows:

* ``shortest_paths_to``: from the targets backwards, a row of ids per node and target; the next hop is the least
  edge into the level before, so no path is carried, and paths are put together for the starts that arrive;
* ``shortest_paths``: from the starts forwards to every node, one join and one grouped minimum per level;
* ``shortest_paths_grouped``: one search per module in an Arrow cogroup, for many small modules (a
  module is one source file, so a group is bounded by a file);
* ``layered_shortest``: for graphs whose edges lead from one layer of nodes to the next, layer by layer from the end.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.schemas import DEFAULT_EDGE_KINDS, MAX_DEPTH
from ..plans.staging import staged

PATHS = "module_id string, source_id string, node_id string, depth int, path array<string>, path_ord array<int>"


def adjacency(edges: DataFrame, kinds: tuple[str, ...] | None = DEFAULT_EDGE_KINDS) -> DataFrame:
    """(module_id, src, dst, edge_ord) of the kinds that propagate."""
    kept = edges.filter(F.col("kind").isin(*kinds)) if kinds is not None else edges
    return kept.select("module_id", "src", "dst", F.col("edge_ord").cast("int").alias("edge_ord"))


def _starts(starts: DataFrame) -> DataFrame:
    return starts.select("module_id", "source_id", F.col("source_id").alias("node_id"), F.lit(0).alias("depth"), F.array("source_id").alias("path"), F.array().cast("array<int>").alias("path_ord"))


def shortest_paths(spark: SparkSession, edges: DataFrame, starts: DataFrame, max_depth: int = MAX_DEPTH, kinds: tuple[str, ...] | None = DEFAULT_EDGE_KINDS) -> DataFrame:
    """starts(module_id, source_id), distinct -> PATHS: the path to each node reached, the start itself included.

    Each level is written before the next one reads it. The map-side half of the minimum leaves one row
    per start and node, so parallel edges and hubs shrink before the shuffle.
    """
    adj = adjacency(edges, kinds).withColumnRenamed("src", "node_id")
    frontier = staged(spark, _starts(starts.select("module_id", "source_id").distinct()), "reach")
    found = frontier
    for depth in range(1, max_depth + 1):
        step = frontier.join(adj, ["module_id", "node_id"]).select(
            "module_id", "source_id", F.col("dst").alias("node_id"),
            F.struct(F.concat("path_ord", F.array("edge_ord")).alias("path_ord"), F.concat("path", F.array("dst")).alias("path")).alias("p"),
        )
        best = step.groupBy("module_id", "source_id", "node_id").agg(F.min("p").alias("p"))
        new = best.join(found.select("module_id", "source_id", "node_id"), ["module_id", "source_id", "node_id"], "left_anti")
        frontier = staged(spark, new.select("module_id", "source_id", "node_id", F.lit(depth).alias("depth"), "p.path", "p.path_ord"), "reach")
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def _search(starts: list[str], edges: list[tuple[str, str, int]], max_depth: int) -> list[tuple]:
    out: dict[str, list[tuple[str, int]]] = {}
    for src, dst, ord_ in sorted(edges, key=lambda e: e[2]):
        out.setdefault(src, []).append((dst, ord_))
    rows = []
    for s in dict.fromkeys(starts):
        came: dict[str, tuple[str, int, int] | None] = {s: None}
        queue = deque([(s, 0)])
        while queue:
            node, depth = queue.popleft()
            path, taken, at = [node], [], node
            while came[at] is not None:
                at, ord_, _ = came[at]
                path.append(at)
                taken.append(ord_)
            rows.append((s, node, depth, path[::-1], taken[::-1]))
            if depth < max_depth:
                for nxt, ord_ in out.get(node, ()):
                    if nxt not in came:
                        came[nxt] = (node, ord_, depth)
                        queue.append((nxt, depth + 1))
    return rows


def shortest_paths_grouped(edges: DataFrame, starts: DataFrame, max_depth: int = MAX_DEPTH, kinds: tuple[str, ...] | None = DEFAULT_EDGE_KINDS) -> DataFrame:
    """The rows of shortest_paths; each module is searched in one piece."""
    left = starts.select(F.col("module_id").alias("start_module"), "source_id")
    right = adjacency(edges, kinds).select(F.col("module_id").alias("edge_module"), "src", "dst", "edge_ord")

    def run(s: pa.Table, e: pa.Table) -> pa.Table:
        module = s.column("start_module")[0].as_py() if s.num_rows else None
        links = list(zip(*(e.column(c).to_pylist() for c in ("src", "dst", "edge_ord")))) if s.num_rows else []
        rows = _search(s.column("source_id").to_pylist(), links, max_depth) if s.num_rows else []
        cols = list(zip(*rows)) or [()] * 5
        kinds_ = (pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()))
        arrays = [pa.array([module] * len(rows), pa.string()), *(pa.array(list(c), k) for c, k in zip(cols, kinds_))]
        return pa.Table.from_arrays(arrays, names=["module_id", "source_id", "node_id", "depth", "path", "path_ord"])

    return left.groupBy("start_module").cogroup(right.groupBy("edge_module")).applyInArrow(run, PATHS)


def _levels_back(spark: SparkSession, adj: DataFrame, first: DataFrame, max_depth: int, hop: bool) -> list[DataFrame]:
    """first(module_id, node_id, target_id) -> per level its new (module_id, node_id, target_id[, dst, edge_ord]), staged."""
    keys = ["module_id", "node_id", "target_id"]
    none = [F.lit(None).cast("string").alias("dst"), F.lit(None).cast("int").alias("edge_ord")] if hop else []
    levels = [staged(spark, first.select(*keys, *none).distinct(), "back")]
    found = levels[0].select(*keys)
    into = adj.withColumnRenamed("dst", "node_id")
    for _ in range(max_depth):
        step = levels[-1].select(*keys).join(into, ["module_id", "node_id"])
        by = ["module_id", F.col("src").alias("node_id"), "target_id"]
        step = step.select(*by, F.struct("edge_ord", F.col("node_id").alias("dst")).alias("h")).groupBy(*keys).agg(F.min("h").alias("h")).select(*keys, "h.dst", "h.edge_ord") if hop else step.select(*by).distinct()
        level = staged(spark, step.join(found, keys, "left_anti"), "back")
        if level.isEmpty():
            break
        levels.append(level)
        found = found.unionByName(level.select(*keys))
    return levels


def shortest_paths_to(spark: SparkSession, edges: DataFrame, starts: DataFrame, targets: DataFrame, max_depth: int = MAX_DEPTH, kinds: tuple[str, ...] | None = DEFAULT_EDGE_KINDS) -> DataFrame:
    """The rows of shortest_paths whose node is one of targets(module_id, node_id), searched from there."""
    first = targets.select("module_id", "node_id", F.col("node_id").alias("target_id"))
    levels = _levels_back(spark, adjacency(edges, kinds), first, max_depth, hop=True)
    begin = starts.select("module_id", "source_id").distinct()
    out = walk = None
    for depth in range(len(levels) - 1, -1, -1):
        here = levels[depth].withColumnRenamed("node_id", "at")
        if walk is not None:  # those on their way take the hop of this level
            walk = walk.join(here, ["module_id", "at", "target_id"]).select(
                "module_id", "source_id", "target_id", "depth", F.concat("path", F.array("dst")).alias("path"), F.concat("path_ord", F.array("edge_ord")).alias("path_ord"), F.col("dst").alias("at"),
            ) if depth else walk
        new = begin.join(here.withColumnRenamed("at", "source_id"), ["module_id", "source_id"])
        hop = lambda c, kind: F.array(c) if depth else F.array().cast(kind)  # noqa: B023, E731
        new = new.select(
            "module_id", "source_id", "target_id", F.lit(depth).alias("depth"), F.concat(F.array("source_id"), hop("dst", "array<string>")).alias("path"),
            hop("edge_ord", "array<int>").alias("path_ord"), (F.col("dst") if depth else F.col("source_id")).alias("at"),
        )
        walk = new if walk is None else walk.unionByName(new)
    out = walk
    return out.select("module_id", "source_id", F.col("target_id").alias("node_id"), "depth", "path", "path_ord")


def reaching(spark: SparkSession, edges: DataFrame, targets: DataFrame, max_depth: int = MAX_DEPTH, kinds: tuple[str, ...] | None = DEFAULT_EDGE_KINDS) -> DataFrame:
    """(module_id, node_id) of every node from which one of targets(module_id, node_id) is reached, the targets included."""
    levels = _levels_back(spark, adjacency(edges, kinds), targets.select("module_id", "node_id", F.lit("").alias("target_id")), max_depth, hop=False)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.select("module_id", "node_id")


def reaches(paths: DataFrame, targets: DataFrame) -> DataFrame:
    """targets(module_id, node_id): (module_id, source_id, node_id) of those that are reached."""
    return paths.select("module_id", "source_id", "node_id").join(targets, ["module_id", "node_id"], "left_semi")


def all_paths(spark: SparkSession, edges: DataFrame, starts: DataFrame, sinks: DataFrame, blocked: DataFrame, max_depth: int = MAX_DEPTH, kinds: tuple[str, ...] | None = DEFAULT_EDGE_KINDS) -> DataFrame:
    """Every trail (no edge twice) of 1 to max_depth edges from a start to a sink without a blocked node: PATHS, a row per trail.

    starts(module_id, source_id), sinks(module_id, node_id) and blocked(module_id, node_id) are distinct. Blocked nodes
    and nodes from which no sink is reached are cut before trails multiply; trails themselves are the result, however
    many there are.
    """
    adj = adjacency(edges, kinds)
    # both are read by every level: written once instead of worked out again
    open_ = staged(spark, adj.join(blocked.select("module_id", F.col("node_id").alias("dst")), ["module_id", "dst"], "left_anti"), "open")
    alive = reaching(spark, open_.withColumn("kind", F.lit("")), sinks, max_depth - 1, None).withColumnRenamed("node_id", "dst")
    adj = staged(spark, open_.join(alive, ["module_id", "dst"], "left_semi").withColumnRenamed("src", "node_id"), "open")
    first = starts.join(blocked.select("module_id", F.col("node_id").alias("source_id")), ["module_id", "source_id"], "left_anti")
    frontier = staged(spark, _starts(first), "trails")
    out = frontier.limit(0)
    for depth in range(1, max_depth + 1):
        step = frontier.join(adj, ["module_id", "node_id"]).filter(~F.array_contains("path_ord", F.col("edge_ord"))).select(
            "module_id", "source_id", F.col("dst").alias("node_id"), F.lit(depth).alias("depth"),
            F.concat("path", F.array("dst")).alias("path"), F.concat("path_ord", F.array("edge_ord")).alias("path_ord"),
        )
        frontier = staged(spark, step, "trails")
        if frontier.isEmpty():
            break
        out = out.unionByName(frontier.join(sinks.select("module_id", "node_id"), ["module_id", "node_id"], "left_semi"))
    return out


# --- layered graphs: layers[i](src, dst) leads from layer i of the nodes to layer i + 1, so every path from the first
# layer to the last takes one edge of each. Nodes are keys of any type that sorts; edges of a node go by their dst.


def _layer(layers: list[DataFrame], i: int) -> DataFrame:
    return layers[i].select(F.col("src").alias(f"n{i}"), F.col("dst").alias(f"n{i + 1}")).dropna()


def layered_trails(layers: list[DataFrame]) -> DataFrame:
    """(n0, n1, ...), a row per path from the first layer to the last; parallel edges give a path each. Nothing is staged."""
    out = _layer(layers, 0)
    for i in range(1, len(layers)):
        out = out.join(_layer(layers, i), f"n{i}")
    return out.select(*[f"n{i}" for i in range(len(layers) + 1)])


def layered_shortest(spark: SparkSession, layers: list[DataFrame]) -> DataFrame:
    """(n0, n1, ...), a row per pair of n0 and last node: the least sequence of nodes between them.

    From the end backwards a row per node and last node is kept, with the least next node; the minima are of plain
    keys, so they hash. Levels are staged, so that the planner knows their size, but for the last two.
    """
    k = len(layers)
    best = _layer(layers, k - 1).distinct()
    for i in range(k - 2, -1, -1):
        nxt = f"n{i + 1}"
        step = _layer(layers, i).join(best, nxt).repartition(f"n{i}")
        rest = [F.min_by(f"n{j}", nxt).alias(f"n{j}") for j in range(i + 2, k)]
        best = step.groupBy(f"n{i}", f"n{k}").agg(F.min(nxt).alias(nxt), *rest)
        if i > 1:
            best = staged(spark, best, "layer")
    return best.select(*[f"n{i}" for i in range(k + 1)])


def layered_sources(layers: list[DataFrame]) -> DataFrame:
    """(n0): the nodes of the first layer from which the last is reached."""
    alive = _layer(layers, len(layers) - 1)
    for i in range(len(layers) - 2, -1, -1):
        alive = _layer(layers, i).join(alive.select(f"n{i + 1}"), f"n{i + 1}", "left_semi")
    return alive.select("n0").distinct()
