"""Queries over the snippets, each held against SQL over hand-derived nodes, edges and paths."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr
from ..operators import edges as edges_
from ..operators import elements, findings, metrics, report, roles, store
from ..sources import fixtures, rules, scan
from . import fixture_goldens as goldens
from .registry import query
from .schemas import SOURCES, Graph
from .staging import shared_dir, staged


def _sources(spark: SparkSession) -> DataFrame:
    return metrics.case_sources(fixtures.cases(spark)).unionByName(spark.createDataFrame([goldens.RETURNS_THROUGH], SOURCES))


def _graph(spark: SparkSession) -> Graph:
    nodes = staged(spark, scan.parse_nodes(_sources(spark)), "nodes")
    return Graph(nodes, staged(spark, edges_.build_edges(nodes), "edges"))


def _roles(spark: SparkSession, graph: Graph) -> DataFrame:
    return staged(spark, roles.roles_of(roles.rule_hits(graph.nodes, rules.rules(spark)), graph.edges), "roles")


def _catalog() -> list[tuple]:
    """(cwe, name, kind, pattern) in the catalog's order, as its files have them."""
    at = Path(rules.default_dir())
    entries = [json.loads((at / f).read_text(encoding="utf-8")) for f in json.loads((at / "index.json").read_text())["entries"]]
    return [(e["cwe"], e["name"], k, p) for e in entries for k in ("sink", "sanitizer") for p in e[k + "s"]]


_CASES = [(c[0], c[4] or c[0].lower() + ".ts", c[3]) for c in fixtures.CASES] + [goldens.RETURNS_THROUGH]
_BASE = ",\n".join([
    goldens.table("cases", "module_id, file, code", _CASES),
    goldens.table("gn", "module_id, node_ord, kind, line, col, len, name", [(m, i, *n) for m, ns in goldens.NODES.items() for i, n in enumerate(ns)]),
    goldens.table("ge", "module_id, edge_ord, kind, a, b", [(m, i, *e) for m, es in goldens.EDGES.items() for i, e in enumerate(es)]),
    goldens.table("gp", "module_id, finding_ord, places, rule_id, cwe", goldens.PATHS),
    goldens.table("patterns", "rule_ord, cwe, cwe_name, role, pattern", [(i + 1, *r) for i, r in enumerate(_catalog())]),
    """n AS (SELECT module_id, node_ord, file || '#' || kind || '@' || line || ':' || col AS id, kind, name, file, line, col,
  substr(code, (SELECT coalesce(sum(length(x.t) + 1), 0) FROM (SELECT unnest(string_split(code, chr(10))[:line - 1]) AS t) x)::BIGINT + col, len) AS code FROM gn JOIN cases USING (module_id)),
e AS (SELECT ge.module_id, edge_ord, ge.kind, x.id AS src, y.id AS dst FROM ge JOIN n x ON x.module_id = ge.module_id AND x.node_ord = a JOIN n y ON y.module_id = ge.module_id AND y.node_ord = b),
hits AS (SELECT module_id, node_ord, id, role, rule_ord FROM n JOIN patterns ON kind = 'Call' AND CASE WHEN starts_with(pattern, '.') THEN ends_with(name, pattern) ELSE contains(name, pattern) END
  UNION ALL SELECT module_id, node_ord, id, 'source', 0 FROM n WHERE kind = 'Parameter' AND name NOT IN ('res', 'next', '_')),
r AS (SELECT DISTINCT module_id, node_ord, id, role FROM hits h WHERE NOT (role = 'source' AND EXISTS (SELECT 1 FROM e WHERE e.kind = 'BINDS_TO' AND e.module_id = h.module_id AND e.dst = h.id))),
steps AS (SELECT p.module_id, finding_ord, cwe, rule_id, pos, n.id, line, CASE WHEN kind = 'Call' THEN name WHEN name <> '' THEN kind || ': ' || name ELSE kind END AS label
  FROM (SELECT *, unnest(places) AS place, generate_subscripts(places, 1) AS pos FROM gp) p JOIN n ON n.module_id = p.module_id AND n.node_ord = p.place),
f AS (SELECT module_id, finding_ord, cwe, rule_id, list(id ORDER BY pos) AS path FROM steps GROUP BY ALL)""",
])


@query(f"""WITH {_BASE}
SELECT module_id, node_ord, id, kind, name, code, file, line, col, CASE WHEN module_id = 'returns_through' AND name = 'id' AND kind = 'Function' THEN 'p' WHEN kind = 'Function' THEN '' END AS returned FROM n""")
def fixture_node_rows(spark: SparkSession, sf: str) -> DataFrame:
    return scan.parse_nodes(_sources(spark)).select("module_id", "node_ord", "id", "kind", "name", "code", "file", "line", "col", F.array_join("return_texts", ",").alias("returned"))


@query(f"WITH {_BASE} SELECT module_id, edge_ord, kind, src, dst FROM e")
def fixture_edge_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _graph(spark).edges.select("module_id", "edge_ord", "kind", "src", "dst")


@query(f"WITH {_BASE} SELECT module_id, node_ord, id AS node_id FROM r WHERE role = 'source'")
def root_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Sources that no call binds."""
    return _roles(spark, _graph(spark)).filter("role = 'source'").select("module_id", "node_ord", "node_id")


_IDS = "coalesce(string_agg(id, ',' ORDER BY node_ord) FILTER (role = '{0}'), '') AS {0}_ids"


@query(f"WITH {_BASE} SELECT module_id, {', '.join(_IDS.format(k) for k in roles.PRIORITY)} FROM r GROUP BY module_id")
def fixture_role_lists(spark: SparkSession, sf: str) -> DataFrame:
    return roles.role_lists(_roles(spark, _graph(spark))).select("module_id", *[F.array_join(f"{k}_ids", ",").alias(f"{k}_ids") for k in roles.PRIORITY])


_ON = "on_path AS (SELECT DISTINCT module_id, id FROM steps), pairs AS (SELECT DISTINCT module_id, path[i] AS src, path[i + 1] AS dst FROM (SELECT *, unnest(range(1, len(path))) AS i FROM f)), has AS (SELECT DISTINCT module_id FROM f)"


@query(f"""WITH {_BASE}, {_ON}
SELECT n.module_id, 'node' AS element, node_ord AS ord, id, CASE WHEN kind = 'Call' THEN name WHEN name <> '' THEN kind || ': ' || name ELSE kind END AS label, kind, code, line, NULL::VARCHAR AS source, NULL::VARCHAR AS target,
  concat_ws(' ', lower(kind), (SELECT max(role) FROM r WHERE r.module_id = n.module_id AND r.id = n.id AND role = 'source'), (SELECT max(role) FROM r WHERE r.module_id = n.module_id AND r.id = n.id AND role = 'sink'),
    (SELECT max(role) FROM r WHERE r.module_id = n.module_id AND r.id = n.id AND role = 'sanitizer'), CASE WHEN (n.module_id, n.id) IN (SELECT (module_id, id) FROM on_path) THEN 'risk-path'
    WHEN n.module_id IN (SELECT module_id FROM has) THEN 'dimmed' END) AS classes FROM n
UNION ALL SELECT module_id, 'edge', edge_ord, src || '|' || kind || '|' || dst, kind, kind, NULL, NULL, src, dst,
  CASE WHEN (module_id, src, dst) IN (SELECT (module_id, src, dst) FROM pairs) THEN 'risk-edge' ELSE replace(lower(kind), '_', '-') || CASE WHEN module_id IN (SELECT module_id FROM has) THEN ' dimmed' ELSE '' END END FROM e""")
def fixture_elements(spark: SparkSession, sf: str) -> DataFrame:
    graph = _graph(spark)
    return elements.elements(graph, _roles(spark, graph), findings.find_flows(spark, graph), dim=True)


@query(f"""WITH {_BASE}, {_ON}
SELECT module_id, src || '|' || kind || '|' || dst AS id, CASE WHEN (module_id, src, dst) IN (SELECT (module_id, src, dst) FROM pairs) THEN 'risk-edge' ELSE replace(lower(kind), '_', '-') END AS classes
FROM e WHERE kind IN ('CALLS', 'RETURNS', 'BINDS_TO')""")
def fixture_visible_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edge elements of some kinds only, nothing dimmed."""
    graph = _graph(spark)
    return elements.edge_elements(graph.edges, findings.find_flows(spark, graph), visible=("CALLS", "RETURNS", "BINDS_TO")).select("module_id", "id", "classes")


_MAIN = "main AS (SELECT module_id, id, arg_min(role, CASE role WHEN 'source' THEN 0 WHEN 'sink' THEN 1 ELSE 2 END) AS role FROM r GROUP BY ALL)"


@query(f"""WITH {_BASE}, {_MAIN}, q AS (SELECT n.*, role, to_json(n.id)::VARCHAR AS jid FROM n LEFT JOIN main USING (module_id, id))
SELECT DISTINCT module_id, 0 AS part, 0 AS ord, 'MATCH (n:GSNode) DETACH DELETE n' AS statement FROM n
UNION ALL SELECT module_id, 1, node_ord, 'CREATE (n:GSNode {{ id: ' || jid || ', kind: ' || to_json(kind)::VARCHAR || ', name: ' || to_json(name)::VARCHAR || ', code: ' || to_json(code)::VARCHAR || ', file: ' || to_json(file)::VARCHAR
  || ', line: ' || line || ', col: ' || col || ', taintRole: ' || coalesce(to_json(role)::VARCHAR, 'null') || ', callee: ' || CASE WHEN kind = 'Call' THEN to_json(name)::VARCHAR ELSE 'null' END || ' }})' FROM q
UNION ALL SELECT module_id, 2, edge_ord, 'MATCH (a:GSNode {{id: ' || to_json(src)::VARCHAR || '}}), (b:GSNode {{id: ' || to_json(dst)::VARCHAR || '}}) CREATE (a)-[:' || kind || ']->(b)' FROM e""")
def fixture_statements(spark: SparkSession, sf: str) -> DataFrame:
    graph = _graph(spark)
    return store.statements(graph, _roles(spark, graph))


@query(f"""WITH {_BASE}
SELECT module_id, finding_ord, string_agg(label, ' → ' ORDER BY pos) AS path_text, 'Hallazgo ' || (finding_ord + 1) || ' [CWE-' || cwe || ']: ' || arg_min(label, pos) || ' → ' || arg_max(label, pos) AS title,
  array_to_string(list_sort(list(DISTINCT line)), ',') AS lines FROM steps GROUP BY module_id, finding_ord, cwe""")
def fixture_titles(spark: SparkSession, sf: str) -> DataFrame:
    graph = _graph(spark)
    found = staged(spark, findings.find_flows(spark, graph), "findings")
    lines = elements.lines_on_path(graph.nodes, found).withColumn("lines", F.array_join("lines", ","))
    return elements.finding_texts(graph.nodes, found).join(lines, ["module_id", "finding_ord"])


@query(f"""WITH {_BASE}, l AS (SELECT module_id, unnest(string_split(code, chr(10))) AS text, generate_subscripts(string_split(code, chr(10)), 1) AS line FROM cases),
m AS (SELECT l.*, (module_id, line) IN (SELECT (module_id, line) FROM steps) AS on_path, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS shown FROM l)
SELECT module_id, line::INT AS line, text, on_path, '<div class="code-line' || CASE WHEN on_path THEN ' risk' ELSE '' END || '"><span class="ln">' || line || '</span><code class="text">' || CASE WHEN shown = '' THEN ' ' ELSE shown END || '</code></div>' AS html FROM m""")
def fixture_code_lines(spark: SparkSession, sf: str) -> DataFrame:
    graph = _graph(spark)
    marked = elements.lines_on_path(graph.nodes, findings.find_flows(spark, graph)).select("module_id", F.explode("lines").alias("line"))
    return elements.code_lines(_sources(spark), marked)


@query(f"""WITH {_BASE}
SELECT module_id, len(string_split(code, chr(10)))::BIGINT AS line_count, (SELECT count(*) FROM n WHERE n.module_id = c.module_id) AS node_count, (SELECT count(*) FROM e WHERE e.module_id = c.module_id) AS edge_count,
  (SELECT count(*) FROM f WHERE f.module_id = c.module_id) AS finding_count FROM cases c""")
def fixture_report_stats(spark: SparkSession, sf: str) -> DataFrame:
    graph = _graph(spark)
    return report.module_stats(_sources(spark), graph, findings.find_flows(spark, graph)).withColumn("line_count", F.col("line_count").cast("long"))


@query(f"""WITH {_BASE}, named AS (SELECT rule_ord, 'cwe-' || cwe || '-' || role || '-' || regexp_replace(pattern, '[^A-Za-z0-9_]+', '_', 'g') AS rule_id, 'CWE-' || cwe || ' ' || role || ': ' || pattern AS label FROM patterns)
SELECT rule_id, arg_max(label, rule_ord) AS label FROM named GROUP BY rule_id UNION ALL SELECT 'param-any', 'Parámetros de función (excepto res/next)'""")
def rule_labels(spark: SparkSession, sf: str) -> DataFrame:
    return rules.labels(rules.rules(spark))


_G3 = goldens.SECOND_TRAIL


@query(f"""WITH {_BASE}, t AS (SELECT module_id, places, rule_id, cwe FROM gp UNION ALL SELECT {', '.join(map(goldens.sql_text, _G3))}),
s AS (SELECT t.*, unnest(places) AS place, generate_subscripts(places, 1) AS pos FROM t)
SELECT s.module_id, string_agg(id, '>' ORDER BY pos) AS path, s.rule_id, s.cwe FROM s JOIN n ON n.module_id = s.module_id AND node_ord = place GROUP BY s.module_id, places, s.rule_id, s.cwe""")
def fixture_stored_flows(spark: SparkSession, sf: str) -> DataFrame:
    """The graph is written, read back and searched there; rules are added to what is found."""
    graph = _graph(spark)
    found = findings.find_stored_flows(spark, graph, f"{shared_dir(spark)}/stored-{spark.sparkContext.applicationId}")
    return found.select("module_id", F.concat_ws(">", "path").alias("path"), "rule_id", "cwe")


@query(f"WITH {_BASE} SELECT module_id, count(*) AS n_shortest, count(*) + CASE WHEN module_id = '{_G3[0]}' THEN 1 ELSE 0 END AS n_all FROM f GROUP BY module_id")
def fixture_modes(spark: SparkSession, sf: str) -> DataFrame:
    """How many findings the two modes give, side by side."""
    graph = _graph(spark)
    n = lambda mode, name: findings.find_flows(spark, graph, findings.Config(mode=mode)).groupBy("module_id").agg(F.count(F.lit(1)).alias(name))
    return n("shortest", "n_shortest").join(n("all_paths", "n_all"), "module_id", "full")


@query(f"WITH {_BASE}, d AS (SELECT unnest([1, 2, 3]) AS max_depth) SELECT max_depth, module_id, count(*) AS n FROM f JOIN d ON len(path) - 1 <= max_depth GROUP BY ALL")
def fixture_depths(spark: SparkSession, sf: str) -> DataFrame:
    """Findings within one, two and three edges."""
    graph, out = _graph(spark), None
    for depth in (1, 2, 3):
        one = findings.find_flows(spark, graph, findings.Config(max_depth=depth)).groupBy("module_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(depth).alias("max_depth"), "module_id", "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT 'F' AS module_id, 'own-eval' AS rule_id, 7 AS cwe")
def fixture_own_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Predicates of the caller's own in place of the catalog."""
    own = [roles.Predicate("own-in", "source", F.col("kind") == "Parameter"), roles.Predicate("own-eval", "sink", F.col("callee") == "eval", 7, "own")]
    return findings.find_flows(spark, _graph(spark), findings.Config(rules=own)).select("module_id", "rule_id", "cwe")


@query(f"""WITH {_BASE} SELECT module_id AS id, f.n AS finding_count, l.n AS line_count, f.paths AS json_paths, '✓' AS json_and_html_agree FROM (SELECT module_id, len(string_split(code, chr(10)))::BIGINT AS n FROM cases WHERE module_id IN ('A', 'C', 'G3')) l
JOIN (SELECT c.module_id, count(f.module_id) AS n, coalesce(string_agg(array_to_string(path, '>'), ';' ORDER BY finding_ord), '') AS paths FROM cases c LEFT JOIN f USING (module_id) GROUP BY c.module_id) f USING (module_id)""")
def fixture_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Three snippets as a caller gets them: the report as JSON and as HTML, read back."""
    rows = []
    for case in fixtures.CASES:
        if case[0] in ("A", "C", "G3"):
            found = report.analyze_code(spark, case[3], case[4] or case[0].lower() + ".ts")["report"]
            back, page = json.loads(report.to_json(found)), report.to_html(found)
            shown = all(" → ".join(x["path"]) in page for x in back["findings"]) and page.count("<code>") == len(back["findings"])
            rows.append((case[0], len(back["findings"]), back["stats"]["lineCount"], ";".join(">".join(x["path"]) for x in back["findings"]), "✓" if shown else "✗"))
    return spark.createDataFrame(rows, "id string, finding_count long, line_count long, json_paths string, json_and_html_agree string")


_RESULTS = [(i, c[0], c[1], c[2], sum(p[0] == c[0] for p in goldens.PATHS)) for i, c in enumerate(fixtures.CASES)]


@query(f"""WITH {goldens.table("c", "k, id, title, label, n", _RESULTS)}
SELECT k + 1 AS line, concat_ws(chr(9), id, title, label, n::VARCHAR, CASE WHEN n > 0 THEN 'TP' ELSE 'TN' END, '✓') AS text FROM c
UNION ALL SELECT 0, concat_ws(chr(9), 'ID', 'Título', 'Esperado', 'Findings', 'Clase', 'OK') UNION ALL SELECT 15, '' UNION ALL SELECT 16, '── Métricas (clasificación por snippet) ──'
UNION ALL SELECT 17, 'TP=10  FP=0  TN=4  FN=0' UNION ALL SELECT 18, 'Precisión=100.0%  Recall=100.0%  F1=100.0%  Accuracy=100.0%'""")
def fixture_report_table(spark: SparkSession, sf: str) -> DataFrame:
    """The benchmark's table without the measured times."""
    from ..engine import run_benchmark

    text = metrics.report_table(*run_benchmark(spark)).split("\n")
    kept = [(i, x.rpartition("\t")[0] if "\t" in x else x) for i, x in enumerate(text) if not x.startswith("Tiempo")]
    return spark.createDataFrame(kept, "line int, text string")


@query("SELECT 14::BIGINT AS cases, 64::BIGINT AS lines, true AS each_case_timed, true AS total_is_their_sum, true AS ms_per_line_follows")
def fixture_times(spark: SparkSession, sf: str) -> DataFrame:
    """What the measured times of a benchmark run have to satisfy."""
    from ..engine import run_benchmark

    results, row = run_benchmark(spark)
    sums = results.agg(F.count(F.lit(1)).alias("cases"), F.sum("line_count").cast("long").alias("lines"), F.min("elapsed_ms").alias("least"), F.sum("elapsed_ms").alias("ms"))
    close = lambda a, b: F.abs(a - b) < 1e-6
    return sums.crossJoin(row.select("total_elapsed_ms", "ms_per_line")).select(
        "cases", "lines", (F.col("least") > 0).alias("each_case_timed"), close(F.col("ms"), F.col("total_elapsed_ms")).alias("total_is_their_sum"), close(F.col("ms") / F.col("lines"), F.col("ms_per_line")).alias("ms_per_line_follows")
    )


@query(f"WITH {goldens.table('x', 'id, expect_finding', [(e[0], e[4]) for e in fixtures.EXAMPLES])} SELECT id, expect_finding, expect_finding AS found FROM x")
def example_findings(spark: SparkSession, sf: str) -> DataFrame:
    every = fixtures.examples(spark)
    nodes = staged(spark, scan.parse_nodes(every.select(F.col("id").alias("module_id"), F.lit("demo.ts").alias("file"), "code")), "nodes")
    hit = findings.find_flows(spark, Graph(nodes, staged(spark, edges_.build_edges(nodes), "edges"))).select(F.col("module_id").alias("id"), F.lit(True).alias("found")).distinct()
    return every.join(hit, "id", "left").select("id", "expect_finding", F.coalesce("found", F.lit(False)).alias("found"))


@query("SELECT * FROM (VALUES ('xss', 'xss'), ('no such name', 'intra')) t(asked, id)")
def example_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """A known name and an unknown one."""
    one = lambda name: fixtures.example(spark, name).select(F.lit(name).alias("asked"), "id")
    return one("xss").unionByName(one("no such name"))


@query("""SELECT doc_id::VARCHAR AS id, CASE WHEN quality = 0 THEN 'vulnerable' ELSE 'safe' END AS label, toxic::BIGINT AS findings, CASE WHEN quality = 0 THEN 'FN' ELSE 'FP' END AS classification
FROM labels WHERE (quality = 0) <> (toxic >= 1)""")
def failed_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels as cases: those whose outcome differs from the truth."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    n, label = F.col("toxic").cast("long"), F.when(F.col("quality") == 0, "vulnerable").otherwise("safe")
    rows = labels.select(F.col("doc_id").cast("string").alias("id"), label.alias("label"), n.alias("findings"))
    rows = rows.withColumn("predicted", expr.predicted_label(F.col("findings"), F.col("label"), F.lit(None).cast("int"), F.lit(None).cast("int")))
    rows = rows.withColumn("classification", expr.confusion(F.col("label"), F.col("predicted"))).withColumn("correct", F.col("label") == F.col("predicted"))
    return metrics.failed(rows).select("id", "label", "findings", "classification")


@query("SELECT source, count(*) AS n, printf('%.1f%%', round(100.0 * count(*) FILTER (lang = 'en') / count(*), 1)) AS english FROM documents GROUP BY source")
def source_percent(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), expr.percent(F.round(F.count_if(F.col("lang") == "en") / F.count(F.lit(1)), 3)).alias("english"))


@query("SELECT * FROM (VALUES ('deep', 1), ('half', 1), ('fine', 0)) t(module_id, errors)")
def parse_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Modules with the number of statements that can't be read, also where no node is left."""
    rows = [("deep", "d.js", "f(" * 20_000 + ")" * 20_000), ("half", "h.js", "let = ;\ng(1);"), ("fine", "f.js", "g(1);")]
    return scan.parse_errors(spark.createDataFrame(rows, SOURCES))
