"""Graph storage: node and edge tables, and the statements that would load them into a graph database."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.schemas import DEFAULT_EDGE_KINDS, EDGES, Graph
from . import roles as roles_

PROPERTIES = ("id", "kind", "name", "code", "file", "line", "col", "taintRole", "callee")


def node_properties(nodes: DataFrame, roles: DataFrame) -> DataFrame:
    """The stored columns of each node; the role by precedence, the callee of calls only."""
    main = roles_.main_role(roles).select("module_id", F.col("node_id").alias("id"), F.col("role").alias("taintRole"))
    return nodes.join(main, ["module_id", "id"], "left").select("module_id", "node_ord", "id", "kind", "name", "code", "file", "line", "col", "taintRole", F.when(F.col("kind") == "Call", F.col("callee")).alias("callee"))


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def write(graph: Graph, roles: DataFrame, path: str) -> None:
    """Stores the graph as a new version below path, then names it the current one: readers see the old graph or the new one.

    Edges are parted by kind, so that readers prune. The version before the last is deleted.
    """
    spark = graph.nodes.sparkSession
    fs, _ = _fs(spark, path)
    old = versions(spark, path)
    version = f"v{old[-1] + 1 if old else 0:09d}"
    node_properties(graph.nodes, roles).write.mode("overwrite").parquet(f"{path}/{version}/nodes")
    graph.edges.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/{version}/edges")
    fs.create(_fs(spark, f"{path}/{version}/_COMPLETE")[1]).close()  # made last, so a version with it is whole
    for v in old[:-1]:
        fs.delete(_fs(spark, f"{path}/v{v:09d}")[1], True)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The whole versions below path, ascending."""
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()]
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(_fs(spark, f"{path}/{n}/_COMPLETE")[1]))


def exists(spark: SparkSession, path: str) -> bool:
    return bool(versions(spark, path))


def read(spark: SparkSession, path: str) -> Graph:
    """The latest whole version."""
    found = versions(spark, path)
    if not found:
        raise FileNotFoundError(path)
    at = f"{path}/v{found[-1]:09d}"
    return Graph(spark.read.parquet(f"{at}/nodes"), spark.read.schema(EDGES).parquet(f"{at}/edges"))


def read_flows(spark: SparkSession, path: str, max_depth: int = 15) -> DataFrame:
    """(module_id, source_id, sink_id, path): all unsanitized trails of the stored graph."""
    from . import reach

    g = read(spark, path)
    of = lambda r: g.nodes.filter(F.col("taintRole") == r).select("module_id", F.col("id").alias("node_id")).distinct()
    found = reach.all_paths(spark, g.edges, of("source").withColumnRenamed("node_id", "source_id"), of("sink"), of("sanitizer"), max_depth)
    return found.select("module_id", "source_id", F.col("node_id").alias("sink_id"), "path")


def quoted(c: Column) -> Column:
    """A string as a JSON literal."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)\A\{"v":(.*)\}\z', 1)


def statements(graph: Graph, roles: DataFrame) -> DataFrame:
    """(module_id, part, ord, statement): clear, one create per node, one per edge of the four kinds."""
    nodes = node_properties(graph.nodes, roles)
    values = [F.concat(F.lit(f"{p}: "), F.col(p).cast("string") if p in ("line", "col") else F.coalesce(F.when(F.col(p).isNotNull(), quoted(F.col(p))), F.lit("null"))) for p in PROPERTIES]
    create = nodes.select("module_id", F.lit(1).alias("part"), F.col("node_ord").alias("ord"), F.concat(F.lit("CREATE (n:GSNode { "), F.concat_ws(", ", *values), F.lit(" })")).alias("statement"))
    link = graph.edges.filter(F.col("kind").isin(*DEFAULT_EDGE_KINDS)).select(
        "module_id", F.lit(2).alias("part"), F.col("edge_ord").alias("ord"),
        F.concat(F.lit("MATCH (a:GSNode {id: "), quoted(F.col("src")), F.lit("}), (b:GSNode {id: "), quoted(F.col("dst")), F.lit("}) CREATE (a)-[:"), F.col("kind"), F.lit("]->(b)")).alias("statement"),
    )
    clear = graph.nodes.select("module_id").distinct().select("module_id", F.lit(0).alias("part"), F.lit(0).alias("ord"), F.lit("MATCH (n:GSNode) DETACH DELETE n").alias("statement"))
    return clear.unionByName(create).unionByName(link)
