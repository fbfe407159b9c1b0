import pytest
from pyspark.sql import functions as F

from flowloom.functions import expr


@pytest.fixture(scope="module")
def ask(spark):
    def run(make, *values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
        return [r["x"] for r in df.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]

    return run


def test_identifiers_and_operands(ask):
    assert ask(expr.is_identifier, "a", "$x_1", "this", "1a", "a b", "a\n", "") == [True, True, True, False, False, False, False]
    assert ask(expr.operand_name, "q", "req.body", "req.params.id", "req.query.x", "req.headers", "a.b", "req.params") == ["q", "req", "req", None, None, None, "req"]


def test_initializers(ask):
    assert ask(lambda c: expr.call_init(c)[1], "f(x)", "f( req.body )", "a.f(x)", "f(x, y)", "f()", "await f(x)", "f( x\t)") == ["x", "req.body", None, None, None, None, "x"]
    assert ask(lambda c: expr.call_init(c)[0], "f(x)", "f(1)") == ["f", None]
    assert ask(expr.new_init, "new A(x)", "new a.B( req.body ) ", "new A()", "A(x)") == ["x", "req.body", None, None]
    assert ask(expr.receiver, "a.b", "req.body.save", "a.b.c", ".x", "f", "a.") == ["a", "req.body", None, None, None, "a"]


@pytest.mark.parametrize(("pattern", "hits"), [("exec", [True, True, True, False]), (".save", [False, False, False, True]), ("re.exec", [False, True, False, False])])
def test_patterns(ask, pattern, hits):
    assert ask(lambda c: expr.callee_matches(c, pattern), "exec", "re.exec", "executeAll", "a.save") == hits


def test_texts(ask):
    assert ask(expr.line_count, "", "a", "a\n", "a\nb\n\n") == [1, 1, 2, 4]
    assert ask(expr.escape_html, '<a href="x">&') == ["&lt;a href=&quot;x&quot;&gt;&amp;"]
    assert ask(lambda c: expr.escape_html(c, quotes=False), '<"') == ['&lt;"']
    assert ask(expr.rule_slug, ".save", "child_process.exec", "a--b") == ["_save", "child_process_exec", "a_b"]
    assert ask(lambda c: expr.percent(c.cast("double")), "1", "0.6667") == ["100.0%", "66.7%"]
    assert ask(expr.js_trim, "  a b﻿\n") == ["a b"]


@pytest.mark.parametrize(("n", "truth", "least", "most", "label", "kind"), [
    (0, "vulnerable", None, None, "safe", "FN"), (1, "vulnerable", None, None, "vulnerable", "TP"), (4, "vulnerable", 3, 3, "safe", "FN"), (3, "vulnerable", 3, 3, "vulnerable", "TP"),
    (0, "safe", None, None, "safe", "TN"), (2, "safe", None, None, "vulnerable", "FP"),
])
def test_labels(spark, n, truth, least, most, label, kind):
    c = [F.lit(n), F.lit(truth), F.lit(least).cast("int"), F.lit(most).cast("int")]
    row = spark.range(1).select(expr.predicted_label(*c).alias("p"), expr.confusion(F.lit(truth), expr.predicted_label(*c)).alias("k")).first()
    assert (row["p"], row["k"]) == (label, kind)
