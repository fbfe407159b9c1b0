"""Token ids in a binary format coded by a static range asymmetric numeral system (rANS).

One frequency table, counted over all ids of the corpus and scaled to 2^20, is shared by all blocks. A
block holds whole documents in ascending doc_id order and is coded by itself: its ids are dealt over
interleaved lanes, each a 64-bit rANS state that gives off 32-bit words; every ``CHECK`` steps a
checkpoint keeps the word position and all states, so that decoding can start there; a crc32 guards
the coded bytes and the decoded ids.

A file is a folder that can be read by itself: ``blocks`` (part, block, start in the part, n_docs, n_ids,
data), ``parts`` (part, ids before it) and ``table`` (id, freq), all Parquet containers, so Spark's commit
protocol covers lost executors and any store that Spark can write. A part is a range of doc_ids; rows that
repeat an id, null ones too, are split over parts by their row number.

Block layout (little endian): magic "FRB1", u32 documents, u64 ids, u32 lanes, u32 checkpoints, u32 words,
u32 crc32 of all that follows and of the ids, u32 crc32 of the frequency table; i64 doc_id and u8 null flag per document; u32
length per document; u64 states; per checkpoint u32 word position and u64 states; u32 words.

Defined cases: a null text is the empty text; an empty text is its end id only; a document longer than a block
is a block of its own, whatever its length; a null doc_id comes before all others; rows that repeat a doc_id
follow each other in the order in which they were read; an empty table gives an empty file and result;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import per_process, runs, shared_encoder

VOCABULARY, END_ID = "word_bpe_49k.json", 2
BITS, LANES, CHECK, BLOCK = 20, 4096, 128, 1 << 20
_LOW = np.uint64(1 << 31)
_HEAD = "<4sIQIIIII"
_BITS, _WORD = np.uint64(BITS), np.uint64(32)


class Table:
    """Frequencies scaled to 2^BITS, which every symbol can be looked up by."""

    def __init__(self, freq: np.ndarray) -> None:
        freq = freq.astype(np.int64)
        self.freq, self.cum = freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64)
        self.crc = crc32(freq.astype("<u4").tobytes())
        self.symbols = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Table:
        """Every symbol that occurs has one slot at least."""
        total, size = int(counts.sum()), 1 << BITS
        seen = np.flatnonzero(counts)
        if len(seen) > size // 2:
            raise ValueError("too many different ids for the table")
        freq = np.zeros(len(counts), np.int64)
        if total:
            freq[seen] = np.maximum(1, np.floor(counts[seen] / total * size).astype(np.int64))
            over = int(freq.sum()) - size
            order = seen[np.argsort(-freq[seen], kind="stable")]
            k = 0
            while over:  # what rounding leaves is given to, or taken from, the most frequent symbols
                s = order[k % len(order)]
                step = -1 if over > 0 and freq[s] > 1 else 1 if over < 0 else 0
                step = step * max(1, min(abs(over), int(freq[s]) // 64))
                freq[s] += step
                over += step
                k += 1
        return cls(freq)


def encode_ids(ids: np.ndarray, t: Table, lanes: int = LANES) -> tuple[np.ndarray, list[tuple[int, np.ndarray]], np.ndarray]:
    """-> (states to start decoding from, checkpoints (word position, states), words in reading order)."""
    n = len(ids)
    steps = -(-n // lanes)
    x = np.full(lanes, _LOW, np.uint64)
    limit = (_LOW >> _BITS) << _WORD
    out, marks, written = [], [], 0
    for step in range(steps - 1, -1, -1):
        s = ids[step * lanes : (step + 1) * lanes]
        f, c = t.freq[s], t.cum[s]
        y = x[: len(s)]
        big = y >= f * limit
        words = y[big].astype(np.uint32)
        y = np.where(big, y >> _WORD, y)
        q = y // f
        x[: len(s)] = (q << _BITS) + (y - q * f) + c
        out.append(words)
        written += len(words)
        if step and step % CHECK == 0:
            marks.append((step, written, x.copy()))
    words = np.concatenate(out[::-1]) if out else np.empty(0, np.uint32)
    return x, [(written - w, states) for _, w, states in reversed(marks)], words


def decode_ids(n: int, states: np.ndarray, words: np.ndarray, t: Table, at: int = 0, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of the steps from first up to last (or the end), given the states and word position at first."""
    lanes = len(states)
    steps = -(-n // lanes)
    last = steps if last is None else min(last, steps)
    x, out = states.copy(), np.empty((max(0, last - first), lanes), np.uint32)
    mask, wide = np.uint64((1 << BITS) - 1), words.astype(np.uint64)
    for step in range(first, last):
        k = min(lanes, n - step * lanes)
        y = x[:k]
        slot = y & mask
        s = t.symbols[slot]
        y = t.freq[s] * (y >> _BITS) + slot - t.cum[s]
        need = np.flatnonzero(y < _LOW)
        y[need] = (y[need] << _WORD) | wide[at : at + len(need)]
        at += len(need)
        x[:k] = y
        out[step - first, :k] = s
    return out.ravel()[: max(0, min(n, last * lanes) - first * lanes)]


def write_block(names: list[int | None], lengths: list[int], ids: np.ndarray, t: Table) -> bytes:
    lanes, ids = max(1, min(LANES, len(ids))), ids.astype("<u4")
    states, marks, words = encode_ids(ids, t, lanes)
    parts = [np.array([x or 0 for x in names], "<i8").tobytes(), bytes(x is None for x in names), np.array(lengths, "<u4").tobytes(), states.astype("<u8").tobytes()]
    for at, x in marks:
        parts += [struct.pack("<I", at), x.astype("<u8").tobytes()]
    body = b"".join([*parts, words.astype("<u4").tobytes()])
    return struct.pack(_HEAD, b"FRB1", len(names), len(ids), lanes, len(marks), len(words), crc32(ids.tobytes(), crc32(body)), t.crc) + body


def read_block(raw: bytes, t: Table) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """-> (doc_ids, lengths, ids); decodes from each checkpoint on by itself and proves the checksum."""
    magic, docs, n, lanes, n_marks, n_words, sum_, table = struct.unpack_from(_HEAD, raw)
    if magic != b"FRB1" or table != t.crc:
        raise ValueError("not a block of this file")
    at = struct.calcsize(_HEAD)

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, kind, count, at)
        at += out.nbytes
        return out

    names, nulls, lengths = take("<i8", docs).tolist(), take("u1", docs), take("<u4", docs)
    starts = [(0, take("<u8", lanes).astype(np.uint64))]
    for _ in range(n_marks):
        where = int(take("<u4", 1)[0])
        starts.append((where, take("<u8", lanes).astype(np.uint64)))
    words = take("<u4", n_words)
    ids = np.concatenate([decode_ids(n, x, words, t, where, k * CHECK, (k + 1) * CHECK if k < n_marks else None) for k, (where, x) in enumerate(starts)]).astype("<u4")
    if crc32(ids.tobytes(), crc32(memoryview(raw)[struct.calcsize(_HEAD) :])) != sum_:
        raise ValueError("checksum of a block")
    return [None if z else x for x, z in zip(names, nulls.tolist())], lengths, ids


def encoded(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """-> (uid, doc_id, n_tokens, ids): ids as little-endian 16-bit numbers if the vocabulary allows, else 32-bit; uid is the row's number.

    Each task ends with a row without uid, whose ids are its counts of the ids from 0 on, as 64-bit numbers: texts
    and ids are read once.
    """
    names = ["uid", "doc_id", "n_tokens", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = shared_encoder(common.vocabulary(vocabulary)), np.array([end_id], "<u4").tobytes()
        seen, row = np.zeros(0, np.int64), TaskContext.get().partitionId() << 33
        kind = "<u2" if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        for b in batches:
            for x, y, texts in runs(b.column("text")):
                raws = encoder.encode(texts)
                n = np.fromiter(map(len, raws), np.int64, y - x) // 4 + 1
                ids = np.frombuffer(end.join([*raws, b""]), "<u4")
                c = np.bincount(ids)
                seen = np.pad(seen, (0, max(0, len(c) - len(seen))))
                seen[: len(c)] += c
                data = ids.astype(kind)
                ends = np.concatenate(([0], np.cumsum(n))) * data.itemsize
                held = pa.Array.from_buffers(pa.large_binary(), y - x, [None, pa.py_buffer(ends), pa.py_buffer(data)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + y - x)), b.column("doc_id").slice(x, y - x).cast(pa.int64()), pa.array(n), held], names=names)
                row += y - x
        yield pa.RecordBatch.from_arrays([*(pa.array([None], pa.int64()),) * 3, pa.array([seen.tobytes()], pa.binary())], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "uid long, doc_id long, n_tokens long, ids binary")


def _wide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")


def id_counts(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs, over all documents: the sum of the tasks' counts; as many rows as ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0).to_pylist():
                held = np.frombuffer(raw, "<i8")
                seen = np.flatnonzero(held)
                yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(held[seen])], names=["id", "c"])

    rows = tokens.filter("uid IS NULL").select("ids").mapInArrow(run, "id long, c long").groupBy("id").agg(F.sum("c").alias("c")).toPandas()
    out = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 1, np.int64)
    out[rows["id"].to_numpy(np.int64)] = rows["c"].to_numpy(np.int64)
    return out


def write_file(spark: SparkSession, docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> None:
    """Writes the ids of docs to the folder path, in ascending doc_id order."""
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tokens = common.stage(spark, encoded(docs, vocabulary, end_id), "tokens")
    freq = Table.of_counts(id_counts(tokens)).freq.astype(np.int64)
    seen = np.flatnonzero(freq)
    spark.createDataFrame(list(zip(seen.tolist(), freq[seen].tolist())), "id long, freq long").coalesce(1).write.parquet(f"{path}/table")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = per_process("tables", crc32(freq), lambda: Table(freq))
        names: list[int | None] = []
        lengths: list[int] = []
        raws: list[bytes] = []
        part, held, start, number = TaskContext.get().partitionId(), 0, 0, 0

        def block() -> pa.RecordBatch:
            nonlocal names, lengths, raws, held, start, number
            raw = write_block(names, lengths, _wide(b"".join(raws), held), t)
            row = [[part], [number], [start], [len(names)], [held], [raw]]
            start, number = start + held, number + 1
            names, lengths, raws, held = [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["part", "block", "start", "n_docs", "n_ids", "data"])

        for b in batches:
            for name, n, raw in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n_tokens", "ids"))):
                if held and held + n > BLOCK:
                    yield block()
                names.append(name)
                lengths.append(n)
                raws.append(raw)
                held += n
        if names:
            yield block()

    order = [F.col("doc_id").asc_nulls_first(), F.col("uid")]
    ordered = tokens.filter("uid IS NOT NULL").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ordered.select("doc_id", "n_tokens", "ids").mapInArrow(run, "part int, block int, start long, n_docs long, n_ids long, data binary").write.parquet(f"{path}/blocks")
    at, rows = 0, []  # a row per part
    for r in spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        rows.append((r["part"], at))
        at += r["n"]
    spark.createDataFrame(rows, "part int, before long").coalesce(1).write.parquet(f"{path}/parts")


def read_file(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32, and the ids on request. Blocks are decoded in parallel.

    The driver reads the table (as many rows as different ids) and the parts.
    """
    table = spark.read.parquet(f"{path}/table").toPandas()
    freq = np.zeros(int(table["id"].max()) + 1 if len(table) else 1, np.int64)
    freq[table["id"].to_numpy(np.int64)] = table["freq"].to_numpy(np.int64)
    before = {r["part"]: r["before"] for r in spark.read.parquet(f"{path}/parts").collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = per_process("tables", crc32(freq), lambda: Table(freq))
        for b in batches:
            for i in range(b.num_rows):
                part, start, raw = (b.column(k)[i].as_py() for k in range(3))
                names, lengths, ids = read_block(raw, t)
                stops = np.cumsum(lengths.astype(np.int64))
                starts = stops - lengths
                view = memoryview(ids.tobytes())
                crc = [crc32(view[4 * x : 4 * y]) for x, y in zip(starts.tolist(), stops.tolist())]
                cols = [pa.array(names, pa.int64()), pa.array(starts + (start + before[part])), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.array([ids[x:y] for x, y in zip(starts, stops)], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    blocks = spark.read.schema("part int, start long, data binary").parquet(f"{path}/blocks")
    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.staged_path(spark, "token-file")
    write_file(spark, common.table(spark, sf_dir, "documents"), path)
    return read_file(spark, path)


SQL: dict[str, str] = {}
QUERIES = {"op9_token_files": op9_token_files}
