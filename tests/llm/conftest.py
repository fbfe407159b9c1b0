import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LABEL = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="session")
def docs_of(spark):
    """texts, or (doc_id, text) pairs -> a documents table with clashing and extra columns."""

    def make(rows):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        full = [(i, t, "en", "src", 0, 1.5, "x", 7, "u", 3) for i, t in rows]
        return spark.createDataFrame(full, DOC + ", score double, fp string, uid int, `a.b` string, n_words int").repartition(3)

    return make


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """Writes tables and gives their folder."""

    def write(**dfs):
        at = tmp_path_factory.mktemp("tables")
        for name, df in dfs.items():
            df.write.parquet(f"file://{at}/{name}.parquet")
        return f"file://{at}"

    return write
