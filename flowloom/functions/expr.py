"""Scalar operators as Column expressions: everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space (as JavaScript's trim() and \s see it), as a name, as request data, as a call and as a construction.
_JS_SPACE = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_IDENTIFIER = r"\A[A-Za-z_$][A-Za-z0-9_$]*\z"
_MEMBER_SOURCE = r"\Areq\.(body|query|params(\.[A-Za-z0-9_]+)?)\z"
_CALL_INIT = r"(?s)\A([A-Za-z_$][A-Za-z0-9_$]*)\(([^)]+)\)\z"
_NEW_INIT = rf"(?s)\Anew[{_JS_SPACE}]+[A-Za-z_$][A-Za-z0-9_$.]*\(([^)]+)\)[{_JS_SPACE}]*\z"
_RECEIVER = r"(?s)\A(.+)\.[^.]*\z"


def _or_null(c: Column) -> Column:
    return F.when(c != "", c)


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A[{_JS_SPACE}]+|[{_JS_SPACE}]+\z", "")


def is_identifier(c: Column) -> Column:
    return c.rlike(_IDENTIFIER)


def is_member_source(c: Column) -> Column:
    return c.rlike(_MEMBER_SOURCE)


def is_flow_operand(c: Column) -> Column:
    return is_identifier(c) | is_member_source(c)


def operand_name(c: Column) -> Column:
    """The name whose definitions an operand uses: itself, 'req' for a member source, else null."""
    return F.when(is_identifier(c), c).when(is_member_source(c), F.lit("req"))


def call_init(c: Column) -> tuple[Column, Column]:
    """(callee, argument) of an initializer that is one plain call with one operand, else nulls."""
    arg = js_trim(F.regexp_extract(c, _CALL_INIT, 2))
    ok = is_flow_operand(arg)
    return F.when(ok, F.regexp_extract(c, _CALL_INIT, 1)), F.when(ok, arg)


def new_init(c: Column) -> Column:
    """The argument of an initializer that is one construction with one operand, else null."""
    arg = js_trim(F.regexp_extract(c, _NEW_INIT, 1))
    return F.when(is_flow_operand(arg), arg)


def receiver(callee: Column) -> Column:
    """What stands before the last dot of a callee, if it is an operand, else null."""
    before = F.regexp_extract(callee, _RECEIVER, 1)
    return F.when(is_flow_operand(before), before)


def scope(kind: Column, owner: Column) -> Column:
    """The function that a node's names are looked up in; null for literals and functions."""
    return F.when(kind.isin("Parameter", "Variable", "Call"), owner)


def callee_matches(callee: Column, pattern: Column | str) -> Column:
    """Patterns that begin with a dot must end the callee, others must occur in it."""
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    return F.when(F.startswith(p, F.lit(".")), F.endswith(callee, p)).otherwise(F.contains(callee, p))


def is_param_source(kind: Column, name: Column) -> Column:
    return (kind == "Parameter") & ~name.isin("res", "next", "_")


def rule_slug(pattern: Column) -> Column:
    return F.regexp_replace(pattern, "[^A-Za-z0-9_]+", "_")


def line_count(code: Column) -> Column:
    return F.size(F.split(code, "\n", -1))


def predicted_label(n: Column, truth: Column, least: Column, most: Column) -> Column:
    hit = (n >= F.coalesce(least, F.lit(1))) & (most.isNull() | (n <= most))
    return F.when(truth == "vulnerable", F.when(hit, "vulnerable").otherwise("safe")).otherwise(F.when(n == 0, "safe").otherwise("vulnerable"))


def confusion(truth: Column, predicted: Column) -> Column:
    return (
        F.when((truth == "vulnerable") & (predicted == "vulnerable"), "TP").when((truth == "safe") & (predicted == "vulnerable"), "FP")
        .when((truth == "safe") & (predicted == "safe"), "TN").otherwise("FN")
    )


def percent(x: Column) -> Column:
    return F.format_string("%.1f%%", (x * 100).cast("double"))


def escape_html(c: Column, quotes: bool = True) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"),) if quotes else ())):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def node_label(kind: Column, name: Column, callee: Column) -> Column:
    return F.when(kind == "Call", callee).when(name != "", F.concat(kind, F.lit(": "), name)).otherwise(kind)
