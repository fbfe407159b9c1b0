"""Expected results on the labelled snippets, worked out by hand from the rules; the SQL side of the fixture queries."""

# Module, path nodes, rule, weakness class.
FINDINGS = [
    ("A", "a.ts#Parameter@1:18>a.ts#Variable@2:9>a.ts#Call@3:3", "cwe-89-sink-db_query", 89),
    ("B", "b.ts#Parameter@5:18>b.ts#Parameter@1:15>b.ts#Call@2:3", "cwe-89-sink-db_query", 89),
    ("E", "e.ts#Parameter@1:18>e.ts#Variable@2:9>e.ts#Call@3:3", "cwe-89-sink-db_query", 89),
    ("F", "f.ts#Parameter@1:18>f.ts#Call@2:3", "cwe-78-sink-eval", 78),
    ("G1", "g1.ts#Parameter@1:23>g1.ts#Variable@2:9>g1.ts#Call@3:3", "cwe-89-sink-_create", 89),
    ("G3", "g3.ts#Parameter@1:23>g3.ts#Variable@2:9>g3.ts#Call@3:3", "cwe-89-sink-_create", 89),
    ("G3", "g3.ts#Parameter@5:21>g3.ts#Variable@6:9>g3.ts#Call@8:3", "cwe-89-sink-findByIdAndUpdate", 89),
    ("G3", "g3.ts#Parameter@10:24>g3.ts#Call@11:3", "cwe-89-sink-findByIdAndDelete", 89),
    ("H-create", "routes.js#Parameter@1:30>routes.js#Variable@2:9>routes.js#Call@3:3", "cwe-89-sink-_create", 89),
    ("H-save", "routes.js#Parameter@1:30>routes.js#Variable@2:9>routes.js#Call@3:9", "cwe-89-sink-_save", 89),
    ("I", "i.ts#Parameter@1:17>i.ts#Call@2:3", "cwe-79-sink-document_write", 79),
    ("L", "l.ts#Parameter@1:18>l.ts#Call@2:3", "cwe-89-sink-db_query", 89),
]
# Module, number of nodes, number of edges by kind.
GRAPHS = [
    ("A", 4, {"FLOWS_TO": 2}), ("B", 6, {"CALLS": 1, "FLOWS_TO": 2, "BINDS_TO": 1}), ("C", 4, {}), ("D", 5, {"FLOWS_TO": 3}), ("E", 4, {"FLOWS_TO": 2}),
    ("F", 3, {"FLOWS_TO": 1}), ("G1", 4, {"FLOWS_TO": 2}), ("G3", 15, {"FLOWS_TO": 7}), ("H-create", 7, {"FLOWS_TO": 2}), ("H-save", 7, {"FLOWS_TO": 2}),
    ("I", 3, {"FLOWS_TO": 1}), ("J", 4, {}), ("K", 7, {"FLOWS_TO": 1}), ("L", 3, {"FLOWS_TO": 1}),
]

# A snippet of its own: a value that passes through a function's result, with every kind of edge.
RETURNS_THROUGH = ("returns_through", "returns_through.ts", "function id(p){ return p; } function h(input){ const y = id(input); db.query(y); }")
# Module, then its nodes in order: kind, line, column, length of the code, name or callee.
NODES = {
    "A": [("Parameter", 1, 18, 5, "input"), ("Function", 1, 1, 61, "handler"), ("Variable", 2, 9, 9, "q"), ("Call", 3, 3, 11, "db.query")],
    "B": [
        ("Parameter", 1, 15, 1, "q"), ("Function", 1, 1, 35, "sink"), ("Parameter", 5, 18, 5, "input"), ("Function", 5, 1, 42, "handler"),
        ("Call", 2, 3, 11, "db.query"), ("Call", 6, 3, 11, "sink"),
    ],
    "C": [("Parameter", 1, 18, 5, "input"), ("Function", 1, 1, 51, "handler"), ("Literal", 2, 12, 10, ""), ("Call", 2, 3, 20, "db.query")],
    "D": [
        ("Parameter", 1, 18, 5, "input"), ("Function", 1, 1, 77, "handler"), ("Variable", 2, 9, 22, "safe"), ("Call", 2, 16, 15, "sanitize"), ("Call", 3, 3, 14, "db.query"),
    ],
    "E": [("Parameter", 1, 18, 3, "req"), ("Function", 1, 1, 62, "handler"), ("Variable", 2, 9, 12, "q"), ("Call", 3, 3, 11, "db.query")],
    "F": [("Parameter", 1, 18, 5, "input"), ("Function", 1, 1, 42, "handler"), ("Call", 2, 3, 11, "eval")],
    "G1": [("Parameter", 1, 23, 3, "req"), ("Function", 1, 1, 79, "postFinances"), ("Variable", 2, 9, 15, "data"), ("Call", 3, 3, 20, "Finance.create")],
    "G3": [
        ("Parameter", 1, 23, 3, "req"), ("Parameter", 1, 28, 3, "res"), ("Function", 1, 1, 84, "postFinances"), ("Parameter", 5, 21, 3, "req"), ("Parameter", 5, 26, 3, "res"),
        ("Function", 5, 1, 125, "putFinance"), ("Parameter", 10, 24, 3, "req"), ("Parameter", 10, 29, 3, "res"), ("Function", 10, 1, 80, "deleteFinance"),
        ("Variable", 2, 9, 15, "data"), ("Variable", 6, 9, 18, "id"), ("Variable", 7, 9, 15, "data"),
        ("Call", 3, 3, 20, "Finance.create"), ("Call", 8, 3, 35, "Finance.findByIdAndUpdate"), ("Call", 11, 3, 40, "Finance.findByIdAndDelete"),
    ],
    "H-create": [
        ("Parameter", 1, 30, 3, "req"), ("Parameter", 1, 35, 3, "res"), ("Function", 1, 23, 72, ""), ("Variable", 2, 9, 15, "data"), ("Literal", 1, 10, 11, ""),
        ("Call", 1, 1, 95, "app.post"), ("Call", 3, 3, 20, "Finance.create"),
    ],
    "H-save": [
        ("Parameter", 1, 30, 3, "req"), ("Parameter", 1, 35, 3, "res"), ("Function", 1, 23, 88, ""), ("Variable", 2, 9, 31, "finance"), ("Literal", 1, 10, 11, ""),
        ("Call", 1, 1, 111, "app.post"), ("Call", 3, 9, 14, "finance.save"),
    ],
    "I": [("Parameter", 1, 17, 3, "msg"), ("Function", 1, 1, 47, "render"), ("Call", 2, 3, 19, "document.write")],
    "J": [("Parameter", 1, 18, 3, "res"), ("Function", 1, 1, 49, "handler"), ("Literal", 2, 12, 10, ""), ("Call", 2, 3, 20, "db.query")],
    "K": [
        ("Parameter", 1, 22, 5, "input"), ("Function", 1, 1, 55, "safeHandler"), ("Parameter", 4, 16, 4, "data"), ("Function", 4, 1, 42, "other"), ("Variable", 5, 9, 8, "x"),
        ("Literal", 2, 12, 10, ""), ("Call", 2, 3, 20, "db.query"),
    ],
    "L": [("Parameter", 1, 18, 3, "req"), ("Function", 1, 1, 52, "handler"), ("Call", 2, 3, 23, "db.query")],
    "returns_through": [
        ("Parameter", 1, 13, 1, "p"), ("Function", 1, 1, 27, "id"), ("Parameter", 1, 40, 5, "input"), ("Function", 1, 29, 54, "h"), ("Variable", 1, 54, 13, "y"),
        ("Call", 1, 58, 9, "id"), ("Call", 1, 69, 11, "db.query"),
    ],
}
# Module, then its edges in order, as places of nodes.
EDGES = {
    "A": [("FLOWS_TO", 2, 3), ("FLOWS_TO", 0, 2)],
    "B": [("CALLS", 5, 1), ("FLOWS_TO", 0, 4), ("FLOWS_TO", 2, 5), ("BINDS_TO", 2, 0)],
    "D": [("FLOWS_TO", 0, 3), ("FLOWS_TO", 2, 4), ("FLOWS_TO", 3, 2)],
    "E": [("FLOWS_TO", 2, 3), ("FLOWS_TO", 0, 2)],
    "F": [("FLOWS_TO", 0, 2)],
    "G1": [("FLOWS_TO", 2, 3), ("FLOWS_TO", 0, 2)],
    "G3": [("FLOWS_TO", 9, 12), ("FLOWS_TO", 10, 13), ("FLOWS_TO", 11, 13), ("FLOWS_TO", 6, 14), ("FLOWS_TO", 0, 9), ("FLOWS_TO", 3, 10), ("FLOWS_TO", 3, 11)],
    "H-create": [("FLOWS_TO", 3, 6), ("FLOWS_TO", 0, 3)],
    "H-save": [("FLOWS_TO", 3, 6), ("FLOWS_TO", 0, 3)],
    "I": [("FLOWS_TO", 0, 2)],
    "K": [("FLOWS_TO", 2, 4)],
    "L": [("FLOWS_TO", 0, 2)],
    "returns_through": [("CALLS", 5, 1), ("FLOWS_TO", 2, 5), ("FLOWS_TO", 4, 6), ("FLOWS_TO", 5, 4), ("BINDS_TO", 2, 0), ("RETURNS", 1, 0)],
}
# Module, place of the finding, its path as places of nodes, rule, weakness class.
PATHS = [
    ("A", 0, [0, 2, 3], "cwe-89-sink-db_query", 89), ("B", 0, [2, 0, 4], "cwe-89-sink-db_query", 89), ("E", 0, [0, 2, 3], "cwe-89-sink-db_query", 89),
    ("F", 0, [0, 2], "cwe-78-sink-eval", 78), ("G1", 0, [0, 2, 3], "cwe-89-sink-_create", 89), ("G3", 0, [0, 9, 12], "cwe-89-sink-_create", 89),
    ("G3", 1, [3, 10, 13], "cwe-89-sink-findByIdAndUpdate", 89), ("G3", 2, [6, 14], "cwe-89-sink-findByIdAndDelete", 89), ("H-create", 0, [0, 3, 6], "cwe-89-sink-_create", 89),
    ("H-save", 0, [0, 3, 6], "cwe-89-sink-_save", 89), ("I", 0, [0, 2], "cwe-79-sink-document_write", 79), ("L", 0, [0, 2], "cwe-89-sink-db_query", 89),
    ("returns_through", 0, [2, 5, 4, 6], "cwe-89-sink-db_query", 89),
]
# The one trail more that all paths give.
SECOND_TRAIL = ("G3", [3, 11, 13], "cwe-89-sink-findByIdAndUpdate", 89)


def sql_text(x) -> str:
    """A Python value as SQL."""
    if x is None:
        return "NULL"
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(sql_text, x)) + "]"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def table(name: str, columns: str, rows: list[tuple]) -> str:
    """A common table expression with these rows."""
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(sql_text, r)) + ')' for r in rows)})"


def values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
