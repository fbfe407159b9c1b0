"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

A text's segmentations into vocabulary pieces form a lattice. A piece weighs ``(rank + 10) ** -theta``, its
rank in the vocabulary's order. Forward filtering sums the weights of all ways to reach each position;
backward sampling draws the last piece, then the one before it, and so on, which draws a whole
segmentation in proportion to its weight. Draws are a hash of the seed, the row's key, the chunk's place
and the step, so a row's segmentation depends on nothing else.

No piece of the vocabulary crosses the chunks that a text is cut into (checked at load), so the lattice
is a chain of chunk lattices. The different chunks of a run of texts are filtered together, position by
position, and all their occurrences are sampled together, piece by piece, in numpy. Pieces are found
by a rolling 64-bit hash of the characters before a position, as far as they end some piece.

Characters without a piece become their UTF-8 byte pieces, and so does U+2581 itself, which stands for
the space; decoding therefore gives back every text.

Defined cases: a null text is the empty text, which has no pieces; a null key is a key of its own;
repeated rows give the same pieces; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import sys
import types
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common
from .tokens import runs

VOCABULARY, SPACE = "piece_bpe_32k.model", "▁"
_CHUNK = re.compile(rf"{SPACE}*(?:[^\W\d_]+|(?:[\d_]|[^\w{SPACE}])+)|{SPACE}+")
_WIDE_CHUNK = re.compile(rf"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Chunks up to this length are filtered together, with plain sums; longer ones by themselves, as logarithms.
SHORT = 40
_BASE = 0x9E3779B97F4A7C15 | 1


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _numbered(chunks: list[str]) -> tuple[np.ndarray, list[str]]:
    """Each chunk's number among the different ones, and these."""
    if any("\0" in c for c in chunks):  # pandas reads strings up to a NUL
        number: dict[str, int] = {}
        return np.array([number.setdefault(c, len(number)) for c in chunks], np.int64), list(number)
    kind, kinds = pd.factorize(np.array(chunks, object))
    return kind, kinds.tolist()


def draws(rows: np.ndarray, chunks: np.ndarray, steps: np.ndarray | int) -> np.ndarray:
    """Numbers in [0, 1) by row seed, chunk and step."""
    x = rows + chunks.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(steps).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    return (_mix(_mix(x)) >> np.uint64(11)).astype(np.float64) * 2.0**-53


class Sampler:
    """Samples segmentations with a SentencePiece vocabulary. theta: 0 makes all segmentations alike, large values few pieces."""

    def __init__(self, path: str, theta: float = 1.0, seed: int = 0) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        order = sorted(plain, key=lambda i: (-sp.get_score(i), i))
        self.weight = {self.pieces[i]: ((rank + 10.0) ** -theta, i) for rank, i in enumerate(order)}
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.longest = max(map(len, self.weight))
        self.chunk = _CHUNK if all(_CHUNK.fullmatch(p) for p in self.weight) else _WIDE_CHUNK
        self.spelt: dict[str, int] = {}  # characters without a piece: a number above all pieces, for their bytes
        self.spellings: list[list[int]] = []
        self.seed = seed
        self._index()

    def _index(self) -> None:
        """A hash table of all endings of pieces: hash -> (weight, id), with id -1 if the ending is no piece itself."""
        known: dict[int, tuple[float, int]] = {}
        for piece, (w, i) in self.weight.items():
            h, power = 0, 1
            for k, ch in enumerate(reversed(piece)):
                h = (h + (ord(ch) + 1) * power) & (1 << 64) - 1
                power = power * _BASE & (1 << 64) - 1
                if k + 1 == len(piece):
                    if known.get(h, (0, -1))[1] >= 0:
                        raise ValueError("two pieces of one hash")
                    known[h] = (w, i)
                else:
                    known.setdefault(h, (0.0, -1))
        hashes = np.array(sorted(known), np.uint64)
        values = [known[int(h)] for h in hashes]
        # tables of places by a multiple of the hash; what a table has no room for goes to the next, smaller one
        self.hashes, self.weights, self.piece_ids = hashes, np.array([v[0] for v in values]), np.array([v[1] for v in values], np.int32)
        self.tables, left = [], np.arange(len(hashes))
        for factor, bits in ((0x9E3779B97F4A7C15, 21), (0xBF58476D1CE4E5B9, 16), (0x94D049BB133111EB, 16), (0xD1B54A32D192ED03, 16)):
            place = self._place(hashes[left], factor, bits)
            _, first = np.unique(place, return_index=True)
            table = np.full(1 << bits, -1, np.int32)
            table[place[first]] = left[first]
            self.tables.append((factor, bits, table))
            left = np.delete(left, first)
            if not len(left):
                return
        raise ValueError("the vocabulary's endings do not fit the tables")

    @staticmethod
    def _place(h: np.ndarray, factor: int, bits: int) -> np.ndarray:
        return ((h * np.uint64(factor)) >> np.uint64(64 - bits)).astype(np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash among the endings, or -1."""
        out = np.full(len(h), -1, np.int64)
        for factor, bits, table in self.tables:
            at = table[self._place(h, factor, bits)]
            same = (at >= 0) & (self.hashes[at] == h)
            out[same] = at[same]
        return out

    def row_seed(self, key) -> int:
        from xxhash import xxh64_intdigest

        return xxh64_intdigest(repr(key).encode(), self.seed)

    def _filter(self, chunks: list[str]) -> tuple[np.ndarray, ...]:
        """Forward filtering of chunks, laid end to end.

        Per edge, by end character: the running sum of probabilities, the piece and its length; per character
        its first edge. The edges of a character sum to one, so the edge for a draw u at character i is at i + u.
        """
        lens = np.fromiter(map(len, chunks), np.int64, len(chunks))
        text = "".join(chunks)
        code = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
        at = np.arange(len(code)) - np.repeat(np.cumsum(lens) - lens, lens) + 1  # place in the chunk, from 1
        live, h, power = np.arange(len(code)), np.zeros(len(code), np.uint64), 1
        ends, places = [], []
        for n in range(1, self.longest + 1):
            h = h + code[live - (n - 1)] * np.uint64(power)
            power = power * _BASE & (1 << 64) - 1
            found = self._find(h)
            ok = found >= 0
            live, h, found = live[ok], h[ok], found[ok]
            piece = self.piece_ids[found] >= 0
            ends.append(live[piece])
            places.append(found[piece])
            more = at[live] > n
            live, h = live[more], h[more]
        count = np.bincount(np.concatenate(ends), minlength=len(code))
        none = np.flatnonzero(count == 0)  # no piece ends here: the character's bytes
        count[none] = 1
        first = np.concatenate(([0], np.cumsum(count)))
        free = first[:-1].copy()  # the next place of each character's edges; long pieces come first
        total = int(first[-1])
        end, size, w, ids = np.empty(total, np.int64), np.ones(total, np.int64), np.ones(total), np.empty(total, np.int32)
        for n in range(self.longest, 0, -1):
            place = free[ends[n - 1]]
            free[ends[n - 1]] += 1
            end[place], size[place], w[place], ids[place] = ends[n - 1], n, self.weights[places[n - 1]], self.piece_ids[places[n - 1]]
        end[free[none]] = none
        ids[free[none]] = [self._spell(text[i]) for i in none.tolist()]
        alpha = np.ones(len(code) + 1)  # of the state after each character; the last place is every chunk's start
        place = at[end]
        source = np.where(place == size, len(code), end - size)
        by_place = np.argsort(place.astype(np.uint8), kind="stable")
        stops = np.cumsum(np.bincount(place))
        for a, b in zip(stops, stops[1:]):
            e = by_place[a:b]
            heads = np.flatnonzero(np.concatenate(([True], end[e][1:] != end[e][:-1])))
            alpha[end[e][heads]] = np.add.reduceat(alpha[source[e]] * w[e], heads)
        return np.cumsum(alpha[source] * w / alpha[end]), ids, size, first

    def _spell(self, ch: str) -> int:
        if ch not in self.spelt:
            self.spelt[ch] = len(self.pieces) + len(self.spellings)
            self.spellings.append([self.bytes[b] for b in ch.encode()])
        return self.spelt[ch]

    def _spelt_out(self, ids: np.ndarray) -> np.ndarray:
        n = len(self.pieces)
        if not len(ids) or ids.max() < n:
            return ids
        odd = np.flatnonzero(ids >= n)
        spelt = [self.spellings[i - n] for i in ids[odd].tolist()]
        out = np.repeat(ids, self._lengths(ids, odd, spelt))
        if len(out) == len(ids):
            out[odd] = [x[0] for x in spelt]
            return out
        at = odd + np.cumsum([0, *(len(x) - 1 for x in spelt[:-1])])
        for a, x in zip(at.tolist(), spelt):
            out[a : a + len(x)] = x
        return out

    @staticmethod
    def _lengths(ids: np.ndarray, odd: np.ndarray, spelt: list[list[int]]) -> np.ndarray:
        out = np.ones(len(ids), np.int64)
        out[odd] = [len(x) for x in spelt]
        return out

    def _slow(self, chunk: str, row: int, place: int, literal: bool) -> list[int]:
        """One long or literal chunk: forward sums as logarithms, then backward draws."""
        n, alpha, edges = len(chunk), [0.0], []
        for j in range(1, n + 1):
            found = []
            for i in range(max(0, j - self.longest), j):
                w = None if literal else self.weight.get(chunk[i:j])
                if w:
                    found.append((alpha[i] + np.log(w[0]), [w[1]], i))
            if not found:
                found.append((alpha[j - 1], [self.bytes[b] for b in chunk[j - 1].encode()], j - 1))
            top = max(f[0] for f in found)
            alpha.append(top + float(np.log(sum(np.exp(f[0] - top) for f in found))))
            edges.append(found)
        u = draws(np.full(n, row, np.uint64), np.full(n, place), np.arange(n))
        out, j, step = [], n, 0
        while j:
            x = u[step]
            for logw, ids, i in edges[j - 1]:
                x -= np.exp(logw - alpha[j])
                if x < 0:
                    break
            out += ids[::-1]
            j, step = i, step + 1
        return out[::-1]

    def _chunks(self, text: str) -> tuple[list[str], set[int]]:
        """The text's chunks, and the places of those that are U+2581 of the text itself."""
        if SPACE not in text:
            return self.chunk.findall(SPACE + text.replace(" ", SPACE)), set()
        out, literal = [], set()
        for k, part in enumerate(re.split(f"({SPACE}+)", text)):
            if k % 2:
                literal.add(len(out))
                out.append(part)
            else:
                out += self.chunk.findall((SPACE if not k else "") + part.replace(" ", SPACE))
        return out, literal

    def encode(self, texts: list[str | None], rows: list[int]) -> list[np.ndarray]:
        """Sampled piece ids of each text; rows: the texts' row seeds."""
        cut: list[list[str]] = []
        alone: dict[int, list[tuple[int, np.ndarray]]] = {}  # text -> chunks sampled by themselves: place, ids
        for k, t in enumerate(texts):
            found, literal = self._chunks(t) if t else ([], set())
            if found and (literal or max(map(len, found)) > SHORT):
                odd = [i for i, c in enumerate(found) if len(c) > SHORT or i in literal]
                alone[k] = [(i, np.array(self._slow(found[i], rows[k], i, i in literal), np.int32)) for i in odd]
                for i in odd:
                    found[i] = ""
            cut.append(found)
        kind, kinds = _numbered([c for part in cut for c in part])
        lens = np.fromiter(map(len, kinds), np.int64, len(kinds))
        keys, ids, size, first = self._filter(kinds) if lens.any() else (np.empty(0),) * 4
        last = np.cumsum(lens) - 1
        sizes = np.array([len(c) for c in cut], np.int64)
        starts = np.cumsum(sizes) - sizes
        row = np.repeat(np.array(rows, np.uint64), sizes)
        place = np.arange(len(kind)) - np.repeat(starts, sizes)
        state, stop = last[kind], (last - lens)[kind]
        count = np.zeros(len(kind), np.int64)
        live, step, got = np.flatnonzero(lens[kind]), 0, []
        while len(live):
            i = state[live]
            e, u, most = first[i], i + draws(row[live], place[live], step), first[i + 1] - 1
            on = np.flatnonzero(e < most)
            while len(on):  # the longest pieces come first, and mostly end the search
                on = on[keys[e[on]] <= u[on]]
                e[on] += 1
                on = on[e[on] < most[on]]
            got.append((live, ids[e]))
            state[live] = i = i - size[e]
            count[live] += 1
            live = live[i > stop[live]]
            step += 1
        ends = np.cumsum(count)
        flat = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        for k, (who, drawn) in enumerate(got):
            flat[ends[who] - 1 - k] = drawn
        edges = np.concatenate(([0], ends))
        out = []
        for k, (a, n) in enumerate(zip(starts.tolist(), sizes.tolist())):
            parts, at = [], edges[a]
            for i, own in alone.get(k, ()):
                parts += [flat[at : edges[a + i]], own]
                at = edges[a + i]
            parts.append(flat[at : edges[a + n]])
            out.append(self._spelt_out(np.concatenate(parts) if len(parts) > 1 else parts[0]))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text again."""
        if self._has_bytes(ids):
            raw = b"".join(bytes([self.byte_of[i]]) if i in self.byte_of else self.pieces[i].replace(SPACE, " ").encode() for i in ids.tolist())
            return raw.decode()[1:]
        return "".join(map(self.pieces.__getitem__, ids.tolist())).replace(SPACE, " ")[1:]

    def _has_bytes(self, ids: np.ndarray) -> bool:
        low, high = min(self.byte_of, default=0), max(self.byte_of, default=-1)
        return bool(((ids >= low) & (ids <= high)).any())


def shared_sampler(path: str, theta: float, seed: int) -> Sampler:
    """One sampler per process and parameters: its memo serves all tasks that the process runs."""
    holder = sys.modules.setdefault("_flowloom_process", types.ModuleType("_flowloom_process")).__dict__.setdefault("samplers", {})
    if (path, theta, seed) not in holder:
        holder[path, theta, seed] = Sampler(path, theta, seed)
    return holder[path, theta, seed]


def sample_pieces(docs: DataFrame, vocabulary: str = VOCABULARY, theta: float = 1.0, seed: int = 0, with_ids: bool = False) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_pieces, ids_crc32 (32-bit little-endian), text_crc32 of the decoded text, lossless; ids on request."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = shared_sampler(common.vocabulary(vocabulary), theta, seed)
        for b in batches:
            keys = b.column("doc_id").to_pylist()
            for x, y, texts in runs(b.column("text"), 1 << 21):
                found = sampler.encode(texts, [sampler.row_seed(k) for k in keys[x:y]])
                back = [sampler.decode(f) for f in found]
                cols = [
                    pa.array(keys[x:y], pa.int64()), pa.array([len(f) for f in found], pa.int64()), pa.array([crc32(f.astype("<u4").tobytes()) for f in found], pa.int64()),
                    pa.array([crc32(t.encode()) for t in back], pa.int64()), pa.array([t == (o or "") for t, o in zip(back, texts)], pa.bool_()),
                ]
                if with_ids:
                    cols.append(pa.array([f.astype(np.int64) for f in found], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_pieces", "ids_crc32", "text_crc32", "lossless", *["ids"] * with_ids])

    schema = "doc_id long, n_pieces long, ids_crc32 long, text_crc32 long, lossless boolean" + (", ids array<long>" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op6_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_pieces(common.table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
QUERIES = {"op6_piece_sampling": op6_piece_sampling}
