import json

import pytest
from pyspark.sql import functions as F

from flowloom import engine as E
from flowloom.operators import edges, elements, findings, metrics, reach, roles, store
from flowloom.plans import fixture_goldens as goldens
from flowloom.sources import fixtures, rules, scan

SNIPPETS = {  # name: code, findings by shortest paths, rows by all paths
    "clean_longer": ("function h(input){ const a = sanitize(input); const b = input; const c = b; const d = c; db.query(a, d); }", 0, 1),
    "tie_sanitized": ("function h(input){ const a = sanitize(input); const b = input; const c = b; db.query(a, c); }", 0, 1),
    "dup_arg": ("function h(x){ db.query(x, x); }", 1, 2),
    "chained": ("function h(x) { db.query(x).then(done); }", 1, None),
    "recursion": ("function f(x){ f(x); db.query(x); }", 0, 0),
    "closure": ("function h(input){ [1].forEach(() => { db.query(input); }); }", 0, 0),
    "top_level": ("function h(input) {}\ndb.query(input);", 1, 1),
    "nested_decl": ("function outer(){ function inner(p){ db.query(p); } }", 0, 0),
    "method": ("class A { m(p){ db.query(p); } }", 0, 0),
    "substring_sink": ("function h(s){ re.exec(s); }", 1, 1),
    "dotted_call_init": ("function h(input){ const s = validator.escape(input); db.query(s); }", 0, 0),
    "returns_through": ("function id(p){ return p; } function h(input){ const y = id(input); db.query(y); }", 1, 1),
}


@pytest.fixture(scope="module")
def corpus(spark):
    return E.analyze(spark, metrics.case_sources(fixtures.cases(spark)))


@pytest.fixture(scope="module")
def snippets(spark):
    return E.analyze(spark, spark.createDataFrame([(n, f"{n}.ts", c) for n, (c, _, _) in SNIPPETS.items()], "module_id string, file string, code string"))


def counts(df):
    return {r["module_id"]: r["count"] for r in df.groupBy("module_id").count().collect()}


def test_corpus_graph(corpus):
    graph, _ = corpus
    assert counts(graph.nodes) == {m: n for m, n, _ in goldens.GRAPHS}
    got = {(r["module_id"], r["kind"]): r["n_edges"] for r in edges.edge_kind_counts(graph.edges, "module_id").collect()}
    assert got == {(m, k): n for m, _, e in goldens.GRAPHS for k, n in e.items()}


def test_corpus_findings(corpus):
    got = [(r["module_id"], ">".join(r["path"]), r["rule_id"], r["cwe"]) for r in corpus[1].orderBy("module_id", "finding_ord").collect()]
    assert got == sorted(goldens.FINDINGS, key=lambda x: x[0]) or sorted(got) == sorted(goldens.FINDINGS)


def test_both_plans_and_both_modes(spark, corpus):
    graph, found = corpus
    levels = findings.find_flows(spark, graph, E.Config(plan="levels"))
    assert sorted(map(tuple, levels.collect())) == sorted(map(tuple, found.collect()))
    every = counts(findings.find_flows(spark, graph, E.Config(mode="all_paths")))
    assert every == counts(found) | {"G3": 4}
    with pytest.raises(ValueError):
        findings.find_flows(spark, graph, E.Config(mode="other"))


def test_snippets(spark, snippets):
    graph, found = snippets
    assert counts(found) == {n: k for n, (_, k, _) in SNIPPETS.items() if k}
    every = counts(findings.find_flows(spark, graph, E.Config(mode="all_paths")))
    assert {n: every.get(n, 0) for n, (_, _, k) in SNIPPETS.items() if k is not None} == {n: k for n, (_, _, k) in SNIPPETS.items() if k is not None}
    paths = {r["module_id"]: r["path"] for r in found.collect()}
    assert len(paths["returns_through"]) == 4


def test_depth_kinds_and_own_rules(spark, corpus):
    graph, _ = corpus
    assert "A" not in counts(findings.find_flows(spark, graph, E.Config(max_depth=1)))
    assert "B" not in counts(findings.find_flows(spark, graph, E.Config(edge_kinds=("FLOWS_TO",))))
    own = [roles.Predicate("src", "source", F.col("kind") == "Parameter"), roles.Predicate("snk", "sink", F.col("callee") == "eval", 1, "one")]
    assert [(r["module_id"], r["rule_id"], r["cwe"]) for r in findings.find_flows(spark, graph, E.Config(rules=own)).collect()] == [("F", "snk", 1)]


def test_metrics_and_table(spark, corpus):
    results = metrics.case_results(fixtures.cases(spark), corpus[1])
    m = metrics.metrics(results).first()
    assert (m["tp"], m["fp"], m["tn"], m["fn"], m["precision"], m["recall"], m["f1"], m["accuracy"], m["total_findings"]) == (10, 0, 4, 0, 1, 1, 1, 1, 12)
    assert metrics.failed(results).isEmpty()
    table = metrics.report_table(results, metrics.metrics(results)).split("\n")
    assert len(table) == 20 and table[1].startswith("A\tSQLi") and table[-3] == "TP=10  FP=0  TN=4  FN=0"
    none = metrics.metrics(results.limit(0)).first()
    assert (none["precision"], none["recall"], none["f1"], none["accuracy"], none["ms_per_line"], none["total_cases"]) == (1, 1, 1, 0, 0, 0)


def test_catalog(spark, tmp_path):
    table = rules.rules(spark)
    ids = [r["rule_id"] for r in table.orderBy("rule_ord").collect()]
    assert len(ids) == 37 and ids[0] == "param-any" and ids[1] == "cwe-89-sink-db_query" and "cwe-89-sink-_save" in ids
    assert rules.labels(table).count() == 37
    assert rules.load(spark, f"file://{tmp_path}").isEmpty()
    (tmp_path / "index.json").write_text(json.dumps({"version": 1, "entries": ["b.json", "a.json"]}))
    for n in "ab":
        (tmp_path / f"{n}.json").write_text(json.dumps({"cwe": ord(n), "name": n, "sources": [], "sinks": [f"{n}.x"], "sanitizers": []}, indent=1))
    got = rules.rules(spark, rules.load(spark, f"file://{tmp_path}")).orderBy("rule_ord").collect()
    assert [r["pattern"] for r in got] == [None, "b.x", "a.x"]


def test_reach_plans_agree_on_random_graphs(spark):
    import random

    rnd = random.Random(5)
    edge_rows, starts = [], []
    for g in range(40):
        n = rnd.randint(2, 9)
        edge_rows += [(f"g{g}", i, "FLOWS_TO", f"n{rnd.randrange(n)}", f"n{rnd.randrange(n)}") for i in range(rnd.randint(1, 22))]
        starts += [(f"g{g}", f"n{i}") for i in range(0, n, 2)]
    e = spark.createDataFrame(edge_rows, "module_id string, edge_ord int, kind string, src string, dst string")
    s = spark.createDataFrame(starts, "module_id string, source_id string")
    for depth in (1, 2, 15):
        a = sorted(map(str, reach.shortest_paths(spark, e, s, depth).collect()))
        b = sorted(map(str, reach.shortest_paths_grouped(e, s, depth).collect()))
        assert a == b and a
        targets = spark.createDataFrame([(m, n) for m, n in starts if n in ("n0", "n4")], "module_id string, node_id string")
        want = sorted(str(r) for r in reach.shortest_paths(spark, e, s, depth).join(targets, ["module_id", "node_id"], "left_semi").select("module_id", "source_id", "node_id", "depth", "path", "path_ord").collect())
        assert want == sorted(map(str, reach.shortest_paths_to(spark, e, s, targets, depth).collect())) and want
        to = {(r["module_id"], r["source_id"]) for r in reach.reaches(reach.shortest_paths(spark, e, s, depth), targets).collect()}
        assert to == {(r["module_id"], r["node_id"]) for r in reach.reaching(spark, e, targets, depth).collect()} & set(starts)


def test_all_paths_against_brute_force(spark):
    import random

    rnd = random.Random(7)
    edge_rows = [("m", i, "FLOWS_TO", f"n{rnd.randrange(6)}", f"n{rnd.randrange(6)}") for i in range(11)]
    e = spark.createDataFrame(edge_rows, "module_id string, edge_ord int, kind string, src string, dst string")
    node = lambda *xs, c="node_id": spark.createDataFrame([("m", x) for x in xs], f"module_id string, {c} string")
    got = sorted(tuple(r["path_ord"]) for r in reach.all_paths(spark, e, node("n0", "n1", c="source_id"), node("n4", "n5"), node("n2"), 5).collect())
    want, stack = [], [((), x) for x in ("n0", "n1")]
    while stack:
        used, at = stack.pop()
        for _, i, _, a, b in edge_rows:
            if a == at and i not in used and b != "n2" and len(used) < 5:
                stack.append(((*used, i), b))
                if b in ("n4", "n5"):
                    want.append((*used, i))
    assert got == sorted(want)


def test_elements(spark, corpus):
    graph, found = corpus
    held = roles.roles_of(roles.rule_hits(graph.nodes, rules.rules(spark)), graph.edges)
    a = elements.elements(graph, held, found, dim=True).filter("module_id = 'B'").collect()
    classes = {r["id"]: r["classes"] for r in a}
    assert classes["b.ts#Parameter@5:18"] == "parameter source risk-path" and classes["b.ts#Function@1:1"] == "function dimmed"
    assert classes["b.ts#Parameter@5:18|BINDS_TO|b.ts#Parameter@1:15"] == "risk-edge"
    assert elements.edge_elements(graph.edges, visible=("CALLS",)).select("classes").collect()[0]["classes"] == "calls"
    lines = {r["module_id"]: r["lines"] for r in elements.lines_on_path(graph.nodes, found).collect()}
    assert lines["B"] == [1, 2, 5]
    text = {r["module_id"]: (r["path_text"], r["title"]) for r in elements.finding_texts(graph.nodes, found).filter("module_id = 'A'").collect()}
    assert text["A"] == ("Parameter: input → Variable: q → db.query", "Hallazgo 1 [CWE-89]: Parameter: input → db.query")
    shown = elements.code_lines(spark.createDataFrame([("m", "f", "a<b\n\nc")], scan.schemas.SOURCES), spark.createDataFrame([("m", 3)], "module_id string, line int")).orderBy("line").collect()
    assert [(r["text"], r["on_path"]) for r in shown] == [("a<b", False), ("", False), ("c", True)] and 'class="text"> </code>' in shown[1]["html"]


def test_store(spark, corpus, tmp_path):
    graph, found = corpus
    held = roles.roles_of(roles.rule_hits(graph.nodes, rules.rules(spark)), graph.edges)
    path = f"file://{tmp_path}/g"
    assert not store.exists(spark, path)
    store.write(graph, held, path)
    assert store.exists(spark, path) and store.read(spark, path).edges.count() == graph.edges.count()
    assert store.read_flows(spark, path).count() == 13
    texts = [r["statement"] for r in store.statements(graph, held).filter("module_id = 'A'").orderBy("part", "ord").collect()]
    assert texts[0] == "MATCH (n:GSNode) DETACH DELETE n" and len(texts) == 7
    assert texts[1] == 'CREATE (n:GSNode { id: "a.ts#Parameter@1:18", kind: "Parameter", name: "input", code: "input", file: "a.ts", line: 1, col: 18, taintRole: "source", callee: null })'
    assert texts[-2].endswith('(b:GSNode {id: "a.ts#Call@3:3"}) CREATE (a)-[:FLOWS_TO]->(b)')


def test_analyze_code_and_reports(spark):
    out = E.analyze_code(spark, fixtures.CASES[0][3], "a.ts")
    assert out["stats"]["findingCount"] == 1 and out["stats"]["edgeKinds"] == {"FLOWS_TO": 2} and out["engine"] == "memory"
    assert out["roles"]["sourceIds"] == ["a.ts#Parameter@1:18"] and json.loads(E.to_json(out["report"])) == out["report"]
    page = E.to_html(out["report"])
    assert "CWE-89" in page and "db.query(q);" in page
    empty = E.analyze_code(spark)
    assert empty["findings"] == [] and "Sin hallazgos" in E.to_html(empty["report"])


def test_export_and_old_labels(spark, tmp_path):
    out = E.analyze_code(spark, fixtures.CASES[0][3], "a.ts")["report"]
    assert "<html" in open(E.report.export(out, f"{tmp_path}/r.html"), encoding="utf-8").read()
    assert json.loads(open(E.report.export(out, f"{tmp_path}/r.json"), encoding="utf-8").read()) == out
    with pytest.deprecated_call():
        assert len(rules.RULE_LABELS) == 37


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from flowloom import __main__ as cli

    monkeypatch.setattr(cli, "_session", lambda: spark)
    assert cli.main(["benchmark"]) == 0 and "TP=10  FP=0  TN=4  FN=0" in capsys.readouterr().out
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.ts").write_text(fixtures.CASES[0][3])
    assert cli.main(["analyze", f"file://{tmp_path}/src", f"file://{tmp_path}/out"]) == 0 and "1 findings" in capsys.readouterr().out
    assert cli.main([]) == 2


def test_stored_graph_is_replaced_as_a_whole(spark, corpus, tmp_path):
    graph, _ = corpus
    held = roles.roles_of(roles.rule_hits(graph.nodes, rules.rules(spark)), graph.edges)
    path = f"file://{tmp_path}/g"
    store.write(graph, held, path)
    (tmp_path / "g/v000000001/nodes").mkdir(parents=True)  # a write that failed half-way
    assert store.versions(spark, path) == [0] and store.read(spark, path).nodes.count() == graph.nodes.count()
    for n in (1, 2):
        store.write(graph, held, path)
        assert store.versions(spark, path) == [n - 1, n]
    with pytest.raises(FileNotFoundError):
        store.read(spark, f"file://{tmp_path}/none")


def test_files_and_stream(spark, tmp_path):
    from flowloom.streaming.watch import watch

    (tmp_path / "src/sub").mkdir(parents=True)
    (tmp_path / "src/a.ts").write_text(fixtures.CASES[0][3])
    (tmp_path / "src/sub/b.js").write_text(fixtures.CASES[1][3])
    (tmp_path / "src/c.txt").write_text("db.query(x)")
    rows = E.read_sources(spark, f"file://{tmp_path}/src").collect()
    assert sorted(r["file"] for r in rows) == ["a.ts", "b.js"]
    out = f"{tmp_path}/out"
    for _ in range(2):  # the second run finds no new file
        watch(spark, f"file://{tmp_path}/src", f"file://{out}", f"file://{tmp_path}/ck").awaitTermination()
    assert spark.read.parquet(f"file://{out}").count() == 2


def test_null_and_empty_sources(spark):
    rows = [("m1", None, None), ("m2", "x.js", ""), (None, "y.js", "f(1);")]
    nodes = scan.parse_nodes(spark.createDataFrame(rows, scan.schemas.SOURCES))
    assert [(r["module_id"], r["kind"]) for r in nodes.collect()] == [(None, "Call")]
    graph = E.build_graph(nodes.filter("false"))
    assert graph.edges.isEmpty() and findings.find_flows(spark, graph).isEmpty()
