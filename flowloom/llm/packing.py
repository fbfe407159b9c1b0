"""Packs documents into fixed windows by Karmarkar-Karp multiway differencing.

Each task packs the documents of its partition in blocks, so nothing is shuffled and memory is bounded
by a block and the longest document. A document's full windows are sequences of their own; the
remainders of a block are partitioned into windows by differencing: partial partitions are merged so
that the largest sums of one meet the smallest of the other, until one near-equal partition is left. The
number of windows starts at a lower bound and rises while a window exceeds the capacity, so differencing
itself cuts no document. What its windows then lack is made up for by the emptiest ones, whose documents
fill the others up and alone are cut; a window within ``slack`` tokens of the capacity is left as it is and
padded. Tokens that can't fill a window go on to the next block; the last ones of a task are cut into
power-of-two sequences, which need no padding.

Defined cases: a null text is the empty text; an empty text is its end id only; every row is packed,
repeated ids and rows too; a document longer than a block is a block of its own; of equal sizes the earlier
one is merged first; an empty table gives an empty result; columns other than doc_id and text are ignored.
Sequence ids are unique, not gapless: partition number * 2^32 + number in the partition.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right, insort
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import common
from .tokens import runs, shared_encoder

WINDOW, SLACK, BLOCK = 2048, 64, 1 << 17
VOCABULARY, END_ID = "word_bpe_49k.json", 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: list[int], ways: int) -> list[list[int]]:
    """Partitions the items into ways groups of near-equal sums; items by number.

    A partial partition holds its groups with sums above its least sum, ascending; the other groups,
    all at that least sum, are not listed unless they hold items.
    """
    if ways == 1:
        return [list(range(len(sizes)))]
    heap: list[tuple[int, int, list]] = [(-s, i, [(s, (i,))]) for i, s in enumerate(sizes)]  # (-spread, tie, groups (sum, items tree))
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        spare = ways - len(a)  # groups of a at its least sum, taken first by the largest of b
        if len(b) == 1 and spare:
            insort(a, b[0], key=lambda g: g[0])
        elif len(b) <= spare:
            a = sorted(a + b, key=lambda g: g[0])
        else:
            low = [(0, ())] * spare + a
            high = [(0, ())] * (ways - len(b)) + b
            met = [(x[0] + y[0], (x[1], y[1]) if x[1] and y[1] else x[1] or y[1]) for x, y in zip(low, reversed(high))]
            least = min(g[0] for g in met)
            a = sorted(((s - least, items) for s, items in met if items), key=lambda g: g[0])
        spread = a[-1][0] - (a[0][0] if len(a) == ways else 0)
        if len(a) == ways and a[0][0]:
            a = [(s - a[0][0], items) for s, items in a]
        heapq.heappush(heap, (-spread, tie, a))
        tie += 1

    def flat(tree: tuple) -> list[int]:
        out, stack = [], [tree]
        while stack:
            for x in stack.pop():
                (stack if isinstance(x, tuple) else out).append(x)
        return out

    return [flat(items) for _, items in heap[0][2]] if heap else []


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Groups of items whose sums are within the capacity (no item is above it).

    The number of groups starts at a lower bound (all tokens by the capacity; items over half of it can't meet)
    and rises by the excess, one at least, until differencing leaves no group above the capacity.
    """
    ways = max(-(-sum(sizes) // capacity), sum(2 * s > capacity for s in sizes))
    while ways:
        groups = differencing(sizes, ways)
        excess = sum(max(0, sum(sizes[i] for i in g) - capacity) for g in groups)
        if not excess:
            return groups
        ways += -(-excess // capacity)
    return []


def fill(pieces: list[tuple[int, int, int]], capacity: int, last: bool, slack: int = SLACK) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """pieces (document, start, length < capacity) -> (sequences, pieces left for the next block).

    The sequences lack slack tokens at most; the last block's leftover is cut into powers of two.
    """
    held = [[pieces[i] for i in g] for g in windows([p[2] for p in pieces], capacity)]
    held.sort(key=lambda w: -sum(p[2] for p in w))
    full: list[list[tuple[int, int, int]]] = []
    pool: list[tuple[int, int, int]] = []  # pieces of the emptiest windows, by length

    def draw(room: int, window: list) -> int:
        """Fills the window from the pool: the longest piece that fits, else a part of the longest; what room is left."""
        while room and pool:
            k = bisect_right(pool, room, key=lambda p: p[2])
            d, s, n = pool.pop(k - 1 if k else -1)
            window.append((d, s, min(n, room)))
            if n > room:
                insort(pool, (d, s + room, n - room), key=lambda p: p[2])
            room -= min(n, room)
        return room

    at = 0
    while at < len(held):
        window, at = held[at], at + 1
        room = capacity - sum(p[2] for p in window)
        while room > slack and (pool or at < len(held)):
            if not pool:
                pool = sorted(held.pop(), key=lambda p: p[2])
            room = draw(room, window)
        if room > slack:
            pool = sorted(window, key=lambda p: p[2])
        else:
            full.append(window)
    if last:
        left = sum(p[2] for p in pool)
        for bit in range(left.bit_length() - 1, -1, -1):
            if left >> bit & 1:
                draw(1 << bit, window := [])
                full.append(window)
    return full, pool


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, window: int = WINDOW, block_tokens: int = BLOCK, with_ids: bool = False) -> DataFrame:
    """One row per piece (see SCHEMA); with_ids adds the piece's ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = shared_encoder(common.vocabulary(vocabulary)), np.array([end_id], "<u4").tobytes()
        base, made = TaskContext.get().partitionId() << 32, 0
        names: list = []  # per document of the block: its id, its ids, their number
        raws: list[bytes] = []
        pieces: list[tuple[int, int, int]] = []
        wholes: list[list[tuple[int, int, int]]] = []
        held = 0

        def block(last: bool) -> pa.RecordBatch:
            nonlocal names, raws, pieces, wholes, held, made
            sequences, tails = fill(pieces, window, last)
            rows = []
            for seq in wholes + sequences:
                at = 0
                for d, s, n in seq:
                    part = memoryview(raws[d])[4 * s : 4 * (s + n)]
                    rows.append((names[d], s, n, crc32(part), len(raws[d]) // 4, base + made, at, *([np.frombuffer(part, "<u4")] if with_ids else [])))
                    at += n
                made += 1
            kept = {d: i for i, d in enumerate(dict.fromkeys(p[0] for p in tails))}
            names, raws = [names[d] for d in kept], [raws[d] for d in kept]
            pieces, wholes = [(kept[d], s, n) for d, s, n in tails], []
            held = sum(p[2] for p in pieces)
            cols = list(zip(*rows)) or [()] * (7 + with_ids)
            arrays = [pa.array(c, pa.int64()) for c in cols[:7]] + ([pa.array(list(cols[7]), pa.list_(pa.int64()))] if with_ids else [])
            return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in SCHEMA.split(", ")] + ["ids"] * with_ids)

        for b in batches:
            ids = b.column("doc_id").to_pylist()
            for x, y, texts in runs(b.column("text")):
                for name, raw in zip(ids[x:y], encoder.encode(texts)):
                    raw += end
                    d, n = len(names), len(raw) // 4
                    names.append(name)
                    raws.append(raw)
                    whole = n - n % window
                    wholes += [[(d, s, window)] for s in range(0, whole, window)]
                    if n > whole:
                        pieces.append((d, whole, n - whole))
                    held += n
                    if held >= block_tokens:
                        yield block(False)
        yield block(True)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA + (", ids array<long>" if with_ids else ""))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
QUERIES = {"op4_packing": op4_packing}
