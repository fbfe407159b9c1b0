"""Helpers shared by the training-data operators: staged tables, vocabulary files, label folds."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts of the operators define it.
WS = r"[\x20\x09-\x0D]+"
WS_CHARS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode, where it is unset, one of our own."""
    set_ = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_:
        return set_.rstrip("/")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="flowloom-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already; the folder then stays for the cluster to clean
        pass


#: Lists to which the paths of staged tables are added while collecting() runs.
_collecting: list[list[str]] = []


def staged_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    for held in _collecting:
        held.append(path)
    return path


@contextmanager
def collecting(held: list[str]) -> Iterator[None]:
    """Adds the paths of all tables staged meanwhile to held."""
    _collecting.append(held)
    try:
        yield
    finally:
        _collecting.remove(held)


def release(spark: SparkSession, held: list[str], docs: DataFrame) -> None:
    """Deletes the staged tables in held that docs doesn't read, and forgets them."""
    read = "\n".join(docs.inputFiles()) if held else ""
    for path in [p for p in held if p.rsplit("/", 1)[-1] not in read]:
        _delete(spark, path)
        held.remove(path)


def stage(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it again: cuts lineage and survives lost executors."""
    path = staged_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._staged_at = path
    return found


def forget(spark: SparkSession, *staged: DataFrame) -> None:
    """Deletes tables that stage() wrote and nothing will read again, before the driver ends."""
    for df in staged:
        _delete(spark, df._staged_at)


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct, out of the way of whatever an operator adds; ``select("row.*")`` gives them back."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column | str) -> Column:
    """The fold that labels are never learnt from: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 3 == 1, F.lit(False))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def vocabulary(name: str) -> str:
    """Path of one of the public vocabulary files, on whichever machine asks."""
    import public_tokenizers

    return public_tokenizers.path(name)
