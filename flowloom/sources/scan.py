"""The parse scan: source text to the node table.

Rows of a module come in a fixed order (node_ord): top-level functions, then arrows, then function
expressions, each after its parameters; then variables, string literals and calls, each kind in
document order, outer before inner. A null text is the empty text; text that can't be parsed gives
what could be found and a count in parse_errors.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import schemas
from .jslex import string_value
from .jsparse import Node, parse
from .jsx import masked, may_hold_jsx

DEFAULT_FILE = "input.ts"
_COLUMNS = ("module_id", "file", "node_ord", "id", "kind", "name", "code", "line", "col", "index", "owner_fn_id", "init_text", "value", "callee", "arg_texts", "param_ids", "return_texts", "parse_errors")
_TYPES = [pa.string(), pa.string(), pa.int32(), *[pa.string()] * 4, pa.int32(), pa.int32(), pa.int32(), *[pa.string()] * 4, *[pa.list_(pa.string())] * 3, pa.int32()]


class _Places:
    """Line and column (UTF-16 units) of a place, both from 1."""

    def __init__(self, code: str) -> None:
        self.code, self.starts = code, [0]
        at = 0
        while (at := code.find("\n", at)) >= 0:
            at += 1
            self.starts.append(at)
        self.plain = code.isascii()

    def __call__(self, at: int) -> tuple[int, int]:
        line = bisect_right(self.starts, at)
        part = self.code[self.starts[line - 1] : at]
        return line, (len(part) if self.plain else len(part.encode("utf-16-le", "surrogatepass")) // 2) + 1


def _tree(code: str, file: str) -> tuple[Node, int]:
    if may_hold_jsx(file, code):
        try:
            return parse(masked(code))
        except RecursionError:  # markup nested too deep: read as script
            pass
    return parse(code)


def module_nodes(code: str, file: str) -> list[dict]:
    """The node rows of one module, without module_id."""
    tree, errors = _tree(code, file)
    place = _Places(code)
    file = file.replace("\\", "/").rsplit("/", 1)[-1]
    rows: list[dict] = []
    found: dict[str, list[tuple[Node, str | None]]] = {k: [] for k in ("top", "arrow", "expression", "var", "str", "call")}

    def ident(kind: str, node: Node) -> str:
        line, col = place(node.start)
        return f"{file}#{kind}@{line}:{col}"

    def emit(kind: str, node: Node, name: str, **more) -> None:
        line, col = place(node.start)
        rows.append({"file": file, "node_ord": len(rows), "id": f"{file}#{kind}@{line}:{col}", "kind": kind, "name": name, "code": code[node.start : node.end], "line": line, "col": col, "parse_errors": errors} | more)

    # in document order, outer before inner; each with the function that holds it
    stack: list[tuple[Node, str | None]] = [(tree, None)]
    while stack:
        node, owner = stack.pop()
        inner = owner
        if node.kind in ("function", "arrow"):
            group = "arrow" if node.kind == "arrow" else "expression" if node.info["expression"] else "top" if node.info["top"] else None
            if group:
                found[group].append((node, owner))
            inner = ident("Function", node)
        elif node.kind in found:
            found[node.kind].append((node, owner))
        stack.extend((k, inner) for k in reversed(node.kids))

    def returns(node: Node) -> list[str]:
        if node.info["value"]:
            a, b = node.info["value"]
            return [code[a:b]]
        out, todo = [], list(reversed(node.kids))
        while todo:
            x = todo.pop()
            if x.kind == "return" and x.info["value"]:
                out.append(code[slice(*x.info["value"])])
            todo.extend(reversed(x.kids))
        return out

    for node, _ in found["top"] + found["arrow"] + found["expression"]:
        own = ident("Function", node)
        params = node.info["params"]
        for k, p in enumerate(params):
            emit("Parameter", p, code[slice(*p.info["name"])], index=k, owner_fn_id=own)
        emit("Function", node, node.info["name"], param_ids=[ident("Parameter", p) for p in params], return_texts=returns(node))
    for node, owner in found["var"]:
        init = node.info["init"]
        emit("Variable", node, code[slice(*node.info["name"])], init_text=code[slice(*init)] if init else None, owner_fn_id=owner)
    for node, owner in found["str"]:
        emit("Literal", node, "", value=string_value(code[node.start : node.end]), owner_fn_id=owner)
    for node, owner in found["call"]:
        callee = code[slice(*node.info["callee"])]
        emit("Call", node, callee, callee=callee, arg_texts=[code[slice(*a)] for a in node.info["args"]], owner_fn_id=owner)
    return rows


def parse_nodes(sources: DataFrame) -> DataFrame:
    """sources(module_id, file, code) -> the node table. One narrow pass: nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sys

        sys.setrecursionlimit(max(5000, sys.getrecursionlimit()))
        for b in batches:
            cols: list[list] = [[] for _ in _COLUMNS]
            for module, file, code in zip(*(b.column(c).to_pylist() for c in ("module_id", "file", "code"))):
                for row in module_nodes(code or "", file or DEFAULT_FILE):
                    row["module_id"] = module
                    for held, name in zip(cols, _COLUMNS):
                        held.append(row.get(name))
                if len(cols[0]) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES)], names=list(_COLUMNS))
                    cols = [[] for _ in _COLUMNS]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES)], names=list(_COLUMNS))

    return sources.select("module_id", "file", "code").mapInArrow(run, schemas.NODES)


def parse_errors(sources: DataFrame) -> DataFrame:
    """sources(module_id, file, code) -> (module_id, errors): a row for each module, whether or not it has nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sys

        sys.setrecursionlimit(max(5000, sys.getrecursionlimit()))
        for b in batches:
            found = [_tree(code or "", file or DEFAULT_FILE)[1] for file, code in zip(b.column("file").to_pylist(), b.column("code").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("module_id"), pa.array(found, pa.int32())], names=["module_id", "errors"])

    return sources.select("module_id", "file", "code").mapInArrow(run, "module_id string, errors int")


def read_sources(spark: SparkSession, path: str, pattern: str = "*.{js,jsx,mjs,cjs,ts,tsx,mts,cts}") -> DataFrame:
    """Every source file below path as (module_id, file, code); module_id is the full path."""
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    full = F.col("_metadata.file_path")
    return files.select(full.alias("module_id"), F.element_at(F.split(full, "/"), -1).alias("file"), F.col("value").alias("code"))


def code_source(spark: SparkSession, code: str = "", file: str = DEFAULT_FILE) -> DataFrame:
    """One snippet as a sources table."""
    return spark.createDataFrame([(file, file, code)], schemas.SOURCES)
