"""The plans for layered graphs against the general ones, and how many rows the flow queries move."""

import random

import pytest

from flowloom.operators import reach
from flowloom.plans import queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def layered(spark):
    """(layers, edges, starts, ends, blocked): four layers of edges, some of them parallel, some ending nowhere."""
    rnd = random.Random(3)
    sizes = (9, 14, 6, 4, 3)
    rows = [sorted((rnd.randrange(sizes[i] + 1), rnd.randrange(sizes[i + 1] + 1)) for _ in range(n)) for i, n in enumerate((24, 40, 7, 5))]
    rows[0].append((10, 99))
    layers = [spark.createDataFrame([*r, (1, None), (None, 1)], "src long, dst long") for r in rows]
    edges = spark.createDataFrame(
        [("m", i * 1000 + at, "FLOWS_TO", f"{i}:{a}", f"{i + 1}:{b}") for i, r in enumerate(rows) for at, (a, b) in enumerate(r)],
        "module_id string, edge_ord int, kind string, src string, dst string",
    )
    node = lambda names, c="node_id": spark.createDataFrame([("m", n) for n in names], f"module_id string, {c} string")
    return layers, edges, node(sorted({f"0:{a}" for a, _ in rows[0]}), "source_id"), node(sorted({f"4:{b}" for _, b in rows[3]})), node(["1:2", "1:5", "1:7"])


def named(rows):
    return sorted([f"{i}:{n}" for i, n in enumerate(r)] for r in rows)


def moved(spark, run):
    """Rows shuffled and written by run()."""
    sc = spark.sparkContext._jsc.sc()
    jvm = spark.sparkContext._jvm

    def stages():
        sc.listenerBus().waitUntilEmpty()
        none = spark.sparkContext._gateway.new_array(jvm.double, 0)
        found = sc.statusStore().stageList(jvm.java.util.ArrayList(), False, False, none, jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() + s.outputRecords() for s in (found.apply(i) for i in range(found.size()))}

    before = stages()
    run()
    return sum(n for k, n in stages().items() if k not in before)


def per_row(spark, name):
    """Rows moved for each row of orders and lineitem, where only tables under 16 kB are broadcast."""
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 16384)
    try:
        n = moved(spark, lambda: queries.QUERIES[name](spark, SF).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    return n / sum(spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("orders", "lineitem"))


def test_layered_trails_are_all_paths(spark, layered):
    layers, edges, starts, ends, blocked = layered
    want = sorted(r["path"] for r in reach.all_paths(spark, edges, starts, ends, blocked).collect())
    first = layers[0].filter("dst NOT IN (2, 5, 7)")
    assert want == named(reach.layered_trails([first, *layers[1:]]).collect()) and len(want) > len({tuple(w) for w in want})


def test_all_paths_reads_its_edges_once(spark, layered):
    _, edges, starts, ends, blocked = layered
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    reach.all_paths(spark, edges.mapInArrow(count, edges.schema), starts, ends, blocked).collect()
    assert read.value == edges.count()


def test_flow_all_paths_moves_few_rows(spark):
    assert 0.5 < per_row(spark, "flow_all_paths") < 2


def test_layered_shortest_are_shortest_paths(spark, layered):
    layers, edges, starts, ends, _ = layered
    want = sorted(r["path"] for r in reach.shortest_paths_to(spark, edges, starts, ends).collect())
    assert want == named(reach.layered_shortest(spark, layers).collect()) and want


def test_layered_sources_are_those_that_reach(spark, layered):
    layers, edges, starts, ends, _ = layered
    want = {r["node_id"] for r in reach.reaching(spark, edges, ends).collect()} & {r["source_id"] for r in starts.collect()}
    assert sorted(want) == sorted(f"0:{r['n0']}" for r in reach.layered_sources(layers).collect()) and len(want) < starts.count()


@pytest.mark.parametrize("name", ["flow_reach_shortest", "flow_reaches"])
def test_flow_reach_moves_few_rows(spark, name):
    assert 0.5 < per_row(spark, name) < 2


def test_flow_findings_moves_few_rows(spark):
    assert 0.5 < per_row(spark, "flow_findings") < 2.5
