"""Edge builders: relational joins over the node table.

Names are joined within a module on (module_id, name); the scope test stays a residual of that join. The
result is a bag with a fixed order (edge_ord), which decides shortest paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr
from ..plans.schemas import Graph

_RAW = ("module_id", "stage", "k1", "k2", "k3", "k4", "kind", "src", "dst")
_LAST = 2**31 - 1


def _raw(df: DataFrame, stage: int, kind: str, src: str, dst: str, *keys: str) -> DataFrame:
    ks = [F.col(keys[i]).cast("int") if i < len(keys) else F.lit(0) for i in range(4)]
    return df.select("module_id", F.lit(stage).alias("stage"), *[k.alias(f"k{i + 1}") for i, k in enumerate(ks)], F.lit(kind).alias("kind"), F.col(src).alias("src"), F.col(dst).alias("dst"))


def _scope() -> Column:
    return expr.scope(F.col("kind"), F.col("owner_fn_id")).alias("scope")


def _calls(nodes: DataFrame) -> DataFrame:
    return nodes.filter("kind = 'Call'").select("module_id", F.col("node_ord").alias("call_ord"), F.col("id").alias("call_id"), "callee", "arg_texts", _scope())


def _functions(nodes: DataFrame) -> DataFrame:
    return nodes.filter("kind = 'Function' AND name <> ''").select("module_id", F.col("node_ord").alias("fn_ord"), F.col("id").alias("fn_id"), F.col("name").alias("callee"), "param_ids")


def _defs(nodes: DataFrame) -> DataFrame:
    return nodes.filter("kind IN ('Variable', 'Parameter')").select("module_id", F.col("name").alias("ref"), F.col("node_ord").alias("def_ord"), F.col("id").alias("def_id"), F.col("owner_fn_id").alias("def_owner"))


def in_scope() -> Column:
    return F.col("scope").isNull() | (F.col("def_owner") == F.col("scope"))


def _uses(df: DataFrame, defs: DataFrame) -> DataFrame:
    """df(module_id, ref, scope, ...) joined with the definitions that its scope sees."""
    return df.join(defs, ["module_id", "ref"]).filter(in_scope())


def calls(nodes: DataFrame) -> DataFrame:
    """CALLS: call -> each function of that name."""
    return _raw(_calls(nodes).join(_functions(nodes), ["module_id", "callee"]), 0, "CALLS", "call_id", "fn_id", "call_ord", "fn_ord")


def flows_to(nodes: DataFrame) -> DataFrame:
    """FLOWS_TO: definitions to the calls and variables that use them, and call results to variables."""
    defs, call = _defs(nodes), _calls(nodes)
    args = call.select("module_id", "call_ord", "call_id", "scope", F.posexplode("arg_texts").alias("pos", "text")).unionByName(
        call.select("module_id", "call_ord", "call_id", "scope", F.lit(_LAST).alias("pos"), expr.receiver(F.col("callee")).alias("text"))
    )
    args = args.withColumn("ref", expr.operand_name(F.col("text"))).filter("ref IS NOT NULL")
    into_calls = _raw(_uses(args, defs), 1, "FLOWS_TO", "def_id", "call_id", "call_ord", "pos", "def_ord")

    variables = nodes.filter("kind = 'Variable' AND init_text IS NOT NULL").select("module_id", F.col("node_ord").alias("var_ord"), F.col("id").alias("var_id"), "init_text", _scope())
    built = expr.new_init(F.col("init_text"))
    plain = variables.withColumn("ref", expr.operand_name(F.coalesce(built, F.col("init_text")))).filter("ref IS NOT NULL")
    into_variables = _raw(_uses(plain, defs).filter("def_id <> var_id"), 2, "FLOWS_TO", "def_id", "var_id", "var_ord", "def_ord")

    callee, arg = expr.call_init(F.col("init_text"))
    # (a construction never looks like a plain call, as its text has a space before the callee's parenthesis)
    results = variables.select("module_id", "var_ord", "var_id", "scope", callee.alias("callee"), arg.alias("arg")).filter("arg IS NOT NULL")
    single = call.filter(F.size("arg_texts") == 1).select("module_id", "callee", F.element_at("arg_texts", 1).alias("arg"), F.col("scope").alias("call_scope"), "call_ord", "call_id")
    from_calls = _raw(
        results.join(single, (results.module_id == single.module_id) & (results.callee == single.callee) & (results.arg == single.arg) & results.scope.eqNullSafe(single.call_scope)).drop(single.module_id),
        3, "FLOWS_TO", "call_id", "var_id", "var_ord", "call_ord",
    )
    return into_calls.unionByName(into_variables).unionByName(from_calls)


def binds_to(nodes: DataFrame) -> DataFrame:
    """BINDS_TO: definitions passed as arguments -> the parameter at that place."""
    bound = _calls(nodes).join(_functions(nodes), ["module_id", "callee"])
    args = bound.select("module_id", "call_ord", "fn_ord", "scope", "param_ids", F.posexplode("arg_texts").alias("pos", "text"))
    args = args.withColumn("param_id", F.get("param_ids", "pos")).withColumn("ref", expr.operand_name(F.col("text"))).filter("param_id IS NOT NULL AND ref IS NOT NULL").drop("param_ids")
    return _raw(_uses(args, _defs(nodes)), 4, "BINDS_TO", "def_id", "param_id", "call_ord", "fn_ord", "pos", "def_ord")


def returns(nodes: DataFrame) -> DataFrame:
    """RETURNS: function -> the definitions of its own scope that it returns."""
    out = nodes.filter("kind = 'Function'").select("module_id", F.col("node_ord").alias("fn_ord"), F.col("id").alias("fn_id"), F.posexplode("return_texts").alias("pos", "text"))
    out = out.withColumn("ref", expr.operand_name(F.col("text"))).filter("ref IS NOT NULL")
    return _raw(out.join(_defs(nodes), ["module_id", "ref"]).filter("def_owner = fn_id"), 5, "RETURNS", "fn_id", "def_id", "fn_ord", "pos", "def_ord")


def build_edges(nodes: DataFrame) -> DataFrame:
    """All edges with edge_ord, the place in the fixed order of the module."""
    every = calls(nodes).unionByName(flows_to(nodes)).unionByName(binds_to(nodes)).unionByName(returns(nodes))
    order = Window.partitionBy("module_id").orderBy("stage", "k1", "k2", "k3", "k4", "src", "dst")
    return every.select("module_id", (F.row_number().over(order) - 1).alias("edge_ord"), "kind", "src", "dst")


def build_graph(nodes: DataFrame) -> Graph:
    return Graph(nodes, build_edges(nodes))


def edge_kind_counts(edges: DataFrame, *by: str) -> DataFrame:
    return edges.groupBy(*by, "kind").agg(F.count(F.lit(1)).alias("n_edges"))
