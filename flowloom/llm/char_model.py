"""A character trigram model counted over a whole corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import runs

#: 0 is any character but a letter, 1-26 a-z, 27-58 the letters from U+00DF to U+00FF (U+00F7 aside), 59 other letters
ALPHABET = 64
OTHER = 59


def codes() -> np.ndarray:
    """Model code of each UTF-16 unit, lower and upper case alike."""
    out = np.zeros(1 << 16, np.uint8)
    for u in range(128, 1 << 16):
        if not 0xD800 <= u < 0xE000 and chr(u).isalpha():
            out[u] = OTHER
    for i in range(26):
        out[ord("a") + i] = out[ord("A") + i] = 1 + i
    for u in range(0xDF, 0x100):
        if u != 0xF7:
            out[u] = 27 + (u - 0xDF)
            if u >= 0xE0 and u != 0xFF:
                out[u - 32] = out[u]
    return out


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Trigram counts over all texts, as an ALPHABET^3 array; one partial table per task, then sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held = codes(), np.zeros(ALPHABET**3, np.int64)
        for b in batches:
            for _, _, texts in runs(b.column(0)):
                units = np.frombuffer(" ".join([" ", *(t or "" for t in texts), " "]).encode("utf-16-le"), "<u2")
                c = table[units].astype(np.int32)
                c = c[np.concatenate(([True], (c[1:] | c[:-1]) != 0))]  # runs of other characters count once
                held += np.bincount((c[:-2] * ALPHABET + c[1:-1]) * ALPHABET + c[2:], minlength=ALPHABET**3)
        seen = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(held[seen])], names=["gram", "c"])

    rows = docs.select("text").mapInArrow(run, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c")).toPandas()
    out = np.zeros(ALPHABET**3, np.int64)
    out[rows["gram"].to_numpy(np.int64)] = rows["c"].to_numpy(np.int64)
    return out.reshape(ALPHABET, ALPHABET, ALPHABET)


def log_probabilities(counts: np.ndarray, weights: tuple[float, float, float] = (0.7, 0.25, 0.05)) -> np.ndarray:
    """log P(c | a, b): trigram, bigram and unigram rates mixed; the share that a context lacks goes to the lower order."""
    n = counts.astype(np.float64)
    uni = n.sum(axis=(0, 1)) + 0.5
    uni /= uni.sum()
    pair = n.sum(axis=0)
    bi = (pair + 5 * uni) / (pair.sum(axis=1, keepdims=True) + 5)
    tri = (n + 5 * bi[None]) / (n.sum(axis=2, keepdims=True) + 5)
    return np.log(weights[0] * tri + weights[1] * bi[None] + weights[2] * uni).astype(np.float32)
