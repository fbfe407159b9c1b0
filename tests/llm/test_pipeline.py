import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from test_simhash import similar_survivors  # noqa: E402

from flowloom.llm import packing, quality_rules, toxicity  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_stages_against_operators(spark, tmp_path):
    """Each stage keeps what its operator's own verdicts say, on the documents that reached it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        path = f"file://{tmp_path}/{k}"
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "packing":
            assert docs.columns == columns
            kept[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
            texts = {r["doc_id"]: r["text"] for r in before.collect()}
        if name == "toxicity":
            model = toxicity.fit(spark, before, toxicity.learning_labels(spark, SF))
            assert kept[name] == {r["doc_id"] for r in toxicity.score(before, model).filter("score < 0.7").collect()}
        elif name == "quality_rules":
            assert kept[name] == {r["doc_id"] for r in quality_rules.judge(spark, before).filter("kept").collect()}
        elif name == "exact_dedup":
            first = {}
            for i, t in sorted(texts.items()):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), i)
            assert kept[name] == set(first.values())
        elif name == "simhash_near_dedup":
            assert kept[name] == set(similar_survivors(sorted(texts.items()))[0])
        else:
            got = docs.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
            assert {r["doc_id"] for r in got} == kept["simhash_near_dedup"] and all(r["sum(length)"] == r["max(doc_tokens)"] for r in got)
    assert packing.WINDOW == 2048


def test_run_and_registration(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in names}
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def words(i, n=70):
    spell = lambda x: f"{x:05d}".translate(str.maketrans("0123456789", "aeioutnsrl"))
    return " ".join(spell((i * 7919 + k * 104_729) % 99_991) + "." * (k % 9 == 8) for k in range(n)) + "."


def test_run_on_odd_rows(spark, tables, docs_of):
    """Nulls, empty and long texts, ties, repeated rows, extra columns with clashing names; then an empty table."""
    long_ = words(500, 20_000)
    near = words(3, 200).split()
    near[100] = "other"
    rows = [(i, words(i, 200 if i == 3 else 70)) for i in range(30)] + [(100, None), (101, ""), (None, None), (102, long_), (103, long_), (3, words(3, 200)), (4, words(4)), (4, words(4) + " "), (50, " ".join(near))]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(None, None, None)], "doc_id long, quality int, toxic int")
    sf = tables(documents=docs_of(rows), labels=labels)
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in got} == {*range(30), 102}
    tokens = {}
    for r in got:
        tokens.setdefault(r["doc_id"], [0, r["doc_tokens"]])[0] += r["length"]
    assert all(a == b for a, b in tokens.values()) and tokens[102][1] > 20_000
    empty = tables(documents=docs_of(rows).limit(0), labels=labels.limit(0))
    assert corpus_pipeline.run(spark, empty).isEmpty()
