"""Labelled snippets and demo snippets: fixed values, on which results are compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CASE_SCHEMA = "case_ord int, id string, title string, label string, code string, file string, cwe string, tags array<string>, min_findings int, max_findings int"
EXAMPLE_SCHEMA = "example_ord int, id string, title string, description string, code string, expect_finding boolean"

# The snippets' texts, some of which serve both lists.
_INTRA = "function handler(input) {\n  const q = input;\n  db.query(q);\n}"
_INTER = "function sink(q) {\n  db.query(q);\n}\n\nfunction handler(input) {\n  sink(input);\n}"
_LITERAL = 'function handler(input) {\n  db.query("SELECT 1");\n}'
_SANITIZED = "function handler(input) {\n  const safe = sanitize(input);\n  db.query(safe);\n}"
_BODY = "function handler(req) {\n  const q = req.body;\n  db.query(q);\n}"
_EVAL = "function handler(input) {\n  eval(input);\n}"
_POST = "function postFinances(req) {\n  const data = req.body;\n  Finance.create(data);\n}"
_POST2 = "function postFinances(req, res) {\n  const data = req.body;\n  Finance.create(data);\n}\n"
_PUT = "function putFinance(req, res) {\n  const id = req.params.id;\n  const data = req.body;\n  Finance.findByIdAndUpdate(id, data);\n}"
_DELETE = "\nfunction deleteFinance(req, res) {\n  Finance.findByIdAndDelete(req.params.id);\n}"
_ARROW = "app.post('/finances', async (req, res) => {\n  const data = req.body;\n  Finance.create(data);\n});"
_SAVE = "app.post('/finances', async (req, res) => {\n  const finance = new Finance(req.body);\n  await finance.save();\n});"
_WRITE = "function render(msg) {\n  document.write(msg);\n}"
_RES = 'function handler(res) {\n  db.query("SELECT 1");\n}'
_TWO = 'function safeHandler(input) {\n  db.query("SELECT 1");\n}\nfunction other(data) {\n  const x = data;\n}'
_PARAMS = "function handler(req) {\n  db.query(req.params.id);\n}"

# Id, title, label, code, file, cwe, tags, least and most findings.
CASES = [
    ("A", "SQLi intra-procedural", "vulnerable", _INTRA, None, "CWE-89", ["sqli", "intra"], None, None),
    ("B", "SQLi inter-procedural", "vulnerable", _INTER, None, "CWE-89", ["sqli", "inter"], None, None),
    ("C", "Sink con literal (seguro)", "safe", _LITERAL, None, "CWE-89", ["sqli", "negative"], None, None),
    ("D", "Sanitizado en el camino", "safe", _SANITIZED, None, "CWE-89", ["sqli", "sanitizer"], None, None),
    ("E", "req.body → SQLi", "vulnerable", _BODY, None, "CWE-89", ["sqli", "express"], None, None),
    ("F", "eval / command injection", "vulnerable", _EVAL, None, "CWE-78", ["cmdi"], None, None),
    ("G1", "Mongoose create", "vulnerable", _POST, None, "CWE-20", ["mongoose", "express"], None, None),
    ("G3", "Finance App — tres handlers", "vulnerable", _POST2 + _PUT + _DELETE, None, "CWE-20", ["mongoose", "express", "multi-handler"], 3, 3),
    ("H-create", "Express arrow + Finance.create", "vulnerable", _ARROW, "routes.js", "CWE-20", ["express", "arrow"], None, None),
    ("H-save", "Express arrow + new/save", "vulnerable", _SAVE, "routes.js", "CWE-20", ["express", "arrow", "mongoose"], None, None),
    ("I", "XSS document.write", "vulnerable", _WRITE, None, "CWE-79", ["xss"], None, None),
    ("J", "Parámetro res no es source", "safe", _RES, None, None, ["express", "negative"], None, None),
    ("K", "Dos funciones — sin cruce espurio", "safe", _TWO, None, None, ["scope", "negative"], None, None),
    ("L", "req.params.id directo al sink", "vulnerable", _PARAMS, None, "CWE-89", ["sqli", "express"], None, None),
]

# Id, title, description, code, whether a finding is expected.
EXAMPLES = [
    ("intra", "A · SQLi intra-procedural", "input fluye a db.query sin sanitizar.", _INTRA, True),
    ("inter", "B · SQLi inter-procedural", "El dato cruza funciones vía BINDS_TO.", _INTER, True),
    ("safe-literal", "C · Sin vulnerabilidad", "El sink usa un literal, no el dato tainted.", _LITERAL, False),
    ("sanitized", "D · Sanitizado", "sanitize() en el camino bloquea el hallazgo.", _SANITIZED, False),
    ("req-body", "E · req.body (Express)", "Entrada HTTP vía req.body hasta db.query.", _BODY, True),
    ("eval-sink", "F · eval (command injection)", "Parámetro de función llega a eval().", _EVAL, True),
    ("finance-app", "G · Finance App (Express)", "Modelo de tu API: req.body → persistencia Mongoose sin validar.", _POST2 + "\n" + _PUT, True),
    ("express-arrow", "H · Express arrow callback", "app.post con async (req, res) => … — patrón real de rutas.", _ARROW, True),
    ("xss", "I · XSS document.write", "CWE-79: salida HTML sin sanitizar.", _WRITE, True),
    ("finance-full", "G+ · Finance App completa", "Tres handlers Mongoose con scoping por función.", _POST2 + _PUT + _DELETE, True),
]


def cases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], CASE_SCHEMA)


def examples(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *e) for i, e in enumerate(EXAMPLES)], EXAMPLE_SCHEMA)


def example(spark: SparkSession, name: str) -> DataFrame:
    """The example of that id, else the first."""
    every = examples(spark)
    return every.filter((every.id == name) | (every.example_ord == 0)).orderBy(every.example_ord.desc()).limit(1)
