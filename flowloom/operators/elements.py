"""Drawing rows of a graph: nodes and edges with their classes, and what a finding touches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr
from ..plans.schemas import Graph

COLUMNS = ("module_id", "element", "ord", "id", "label", "kind", "code", "line", "source", "target", "classes")


def path_nodes(findings: DataFrame) -> DataFrame:
    """(module_id, node_id) on the paths."""
    return findings.select("module_id", F.explode("path").alias("node_id")).distinct()


def path_pairs(findings: DataFrame) -> DataFrame:
    """(module_id, src, dst) of consecutive nodes on the paths."""
    pairs = F.arrays_zip(F.expr("slice(path, 1, greatest(size(path) - 1, 0))").alias("src"), F.expr("slice(path, 2, greatest(size(path) - 1, 0))").alias("dst"))
    return findings.select("module_id", F.explode(pairs).alias("p")).select("module_id", F.col("p.src").alias("src"), F.col("p.dst").alias("dst")).distinct()


def node_elements(nodes: DataFrame, roles: DataFrame, findings: DataFrame | None = None, dim: bool = False) -> DataFrame:
    """One row per node; modules without a finding have nothing on a path, so nothing is dimmed there."""
    flags = roles.groupBy("module_id", F.col("node_id").alias("id")).agg(*[F.max(F.col("role") == r).alias(r) for r in ("source", "sink", "sanitizer")])
    df = nodes.join(flags, ["module_id", "id"], "left")
    if findings is None:
        df = df.withColumn("on_path", F.lit(False)).withColumn("has_path", F.lit(False))
    else:
        on = path_nodes(findings).select("module_id", F.col("node_id").alias("id"), F.lit(True).alias("on_path"))
        has = findings.select("module_id", F.lit(True).alias("has_path")).distinct()
        df = df.join(on, ["module_id", "id"], "left").join(has, "module_id", "left")
    parts = [F.lower("kind"), *[F.when(F.col(r), F.lit(r)) for r in ("source", "sink", "sanitizer")], F.when(F.col("on_path"), F.lit("risk-path"))]
    parts.append(F.when(F.lit(dim) & F.coalesce("has_path", F.lit(False)) & ~F.coalesce("on_path", F.lit(False)), F.lit("dimmed")))
    return df.select(
        "module_id", F.lit("node").alias("element"), F.col("node_ord").alias("ord"), "id", expr.node_label(F.col("kind"), F.col("name"), F.col("callee")).alias("label"), "kind", "code", "line",
        F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("target"), F.concat_ws(" ", *parts).alias("classes"),
    )


def edge_elements(edges: DataFrame, findings: DataFrame | None = None, visible: tuple[str, ...] | None = None, dim: bool = False) -> DataFrame:
    df = edges.filter(F.col("kind").isin(*visible)) if visible is not None else edges
    if findings is None:
        df = df.withColumn("on_path", F.lit(False)).withColumn("has_path", F.lit(False))
    else:
        has = findings.select("module_id", F.lit(True).alias("has_path")).distinct()
        df = df.join(path_pairs(findings).withColumn("on_path", F.lit(True)), ["module_id", "src", "dst"], "left").join(has, "module_id", "left")
    on, has_path = F.coalesce("on_path", F.lit(False)), F.coalesce("has_path", F.lit(False))
    plain = F.replace(F.lower("kind"), F.lit("_"), F.lit("-"))
    classes = F.concat_ws(" ", F.when(on, F.lit("risk-edge")).otherwise(plain), F.when(F.lit(dim) & has_path & ~on, F.lit("dimmed")))
    return df.select(
        "module_id", F.lit("edge").alias("element"), F.col("edge_ord").alias("ord"), F.concat_ws("|", "src", "kind", "dst").alias("id"), F.col("kind").alias("label"), "kind",
        F.lit(None).cast("string").alias("code"), F.lit(None).cast("int").alias("line"), F.col("src").alias("source"), F.col("dst").alias("target"), classes.alias("classes"),
    )


def elements(graph: Graph, roles: DataFrame, findings: DataFrame | None = None, visible: tuple[str, ...] | None = None, dim: bool = False) -> DataFrame:
    return node_elements(graph.nodes, roles, findings, dim).unionByName(edge_elements(graph.edges, findings, visible, dim))


def _first_nodes(nodes: DataFrame) -> DataFrame:
    """One node per id: the first."""
    return nodes.groupBy("module_id", F.col("id").alias("node_id")).agg(F.min_by(F.struct("kind", "name", "callee", "line"), "node_ord").alias("n")).select("module_id", "node_id", "n.*")


def lines_on_path(nodes: DataFrame, findings: DataFrame) -> DataFrame:
    """(module_id, finding_ord, lines): distinct lines of each finding's path, ascending."""
    steps = findings.select("module_id", "finding_ord", F.explode("path").alias("node_id"))
    found = steps.join(_first_nodes(nodes), ["module_id", "node_id"])
    return found.groupBy("module_id", "finding_ord").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def finding_texts(nodes: DataFrame, findings: DataFrame) -> DataFrame:
    """(module_id, finding_ord, path_text, title): the path by labels, and the finding's headline; unknown ids stand for themselves."""
    steps = findings.select("module_id", "finding_ord", "cwe", F.posexplode("path").alias("pos", "node_id"))
    label = F.coalesce(expr.node_label(F.col("kind"), F.col("name"), F.col("callee")), F.col("node_id"))
    named = steps.join(_first_nodes(nodes), ["module_id", "node_id"], "left").select("module_id", "finding_ord", "cwe", "pos", label.alias("label"))
    texts = named.groupBy("module_id", "finding_ord", "cwe").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))), lambda s: s["label"]).alias("labels"))
    cwe = F.when(F.col("cwe").isNotNull(), F.concat(F.lit(" [CWE-"), F.col("cwe").cast("string"), F.lit("]"))).otherwise("")
    ends = F.concat(F.element_at("labels", 1), F.lit(" → "), F.element_at("labels", -1))
    title = F.concat(F.lit("Hallazgo "), (F.col("finding_ord") + 1).cast("string"), cwe, F.lit(": "), ends)
    return texts.select("module_id", "finding_ord", F.array_join("labels", " → ").alias("path_text"), title.alias("title"))


def code_lines(sources: DataFrame, marked: DataFrame | None = None) -> DataFrame:
    """(module_id, line, text, on_path, html): one row per source line; marked(module_id, line) flags lines."""
    rows = sources.select("module_id", F.posexplode(F.split(F.coalesce("code", F.lit("")), "\n", -1)).alias("i", "text")).select("module_id", (F.col("i") + 1).alias("line"), "text")
    if marked is None:
        rows = rows.withColumn("on_path", F.lit(False))
    else:
        rows = rows.join(marked.select("module_id", "line", F.lit(True).alias("on_path")).distinct(), ["module_id", "line"], "left").withColumn("on_path", F.coalesce("on_path", F.lit(False)))
    shown = expr.escape_html(F.col("text"), quotes=False)
    html = F.concat(
        F.lit('<div class="code-line'), F.when(F.col("on_path"), " risk").otherwise(""), F.lit('"><span class="ln">'), F.col("line").cast("string"),
        F.lit('</span><code class="text">'), F.when(shown == "", " ").otherwise(shown), F.lit("</code></div>"),
    )
    return rows.withColumn("html", html)
