"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are the bitwise majority of the XXH64 hashes of 3-word shingles. Distinct fingerprints are
filed under masked bit patterns, the upper nodes of the index. A node's children share more bits: with a
radius of r, the bits that a node leaves open are cut into r + 1 blocks, and a child fixes one of them; two
fingerprints within r bits agree on a block at every level, so descending only at accumulated difference
zero loses no link. Nodes that hold over ``node_size`` fingerprints are split on, the others are leaves; as
fingerprints are distinct, a node with 16 open bits holds at most 65,536, so the descent ends and no
node is unbounded. Inside a leaf the members are sorted by Gray rank and factored into levels of
shared masked patterns; pairs of nodes descend together, and a pair is pruned as soon as the
differences accumulated on the bits that both share exceed the radius. Node pairs that lie
entirely within the radius are joined by one link. A leaf gives its members' local roots, never pairs;
the local roots are the edges of a distributed connected-components run.

Defined cases: null and empty texts and texts without words have fingerprint zero and are linked like
any other; texts of one or two words are one shingle; rows with a null doc_id take part but never name
a component unless all its ids are null; repeated rows get one row each; texts of any length are read whole; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import connected
from .tokens import runs

SEED, SHINGLE, RADIUS = 42, 3, 3
FINAL_BITS, LEAF, FAN = 16, 16, 8


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of the shingles (of three words), repeats included; a shorter text is one shingle; none without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: A-Z only, and exactly the six ASCII white spaces
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-shingle])).tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    return np.fromiter(map(xxh64_intdigest, [joined[a:b] for a, b in zip(starts, stops)], repeat(SEED)), np.uint64, len(starts))


def fingerprint(text: str | None) -> int:
    """The majority bits as a signed 64-bit number; zero without words."""
    return majority(shingle_hashes(text))


def majority(h: np.ndarray) -> int:
    """The bits that more than half of the hashes have, as a signed 64-bit number."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):
        part = h[at : at + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, *keys: str) -> DataFrame:
    """docs(keys..., text) -> (keys..., fp)."""
    source = docs.select(*keys, "text")
    schema = source.drop("text").withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array([fingerprint(t) for _, _, texts in runs(b.column("text")) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), fp], names=[*keys, "fp"])

    return source.mapInArrow(run, schema)


def gray_rank(fp: Column) -> Column:
    """The place of a bit pattern in the reflected Gray sequence, as a signed number of the same order."""
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, s))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def child_masks(mask: int, blocks: int = RADIUS + 1) -> list[int]:
    """The masks of a node's children: mask plus one of the blocks that its open bits are cut into."""
    free = [b for b in range(63, -1, -1) if not mask >> b & 1]
    cuts = [round(i * len(free) / blocks) for i in range(blocks + 1)]
    return [mask | sum(1 << b for b in free[x:y]) for x, y in zip(cuts, cuts[1:])]


def leaves(spark: SparkSession, fps: DataFrame, node_size: int = 2048) -> DataFrame:
    """fps(fp), distinct -> rows (mask, pattern, fp) of all index leaves that hold two fingerprints or more.

    The descent starts at the second level, whose nodes share 28 bits: most hold one fingerprint only.
    """
    out = None
    masks = sorted({c for m in child_masks(0) for c in child_masks(m)})
    rows = fps.select(F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"), "fp")
    while True:
        rows = rows.withColumn("pattern", F.col("fp").bitwiseAND(F.col("mask")))
        final = min(64 - m.bit_count() for m in masks) <= FINAL_BITS
        sizes = rows.groupBy("mask", "pattern").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
        sizes = common.stage(spark, sizes, "nodes")
        leaf = rows.join(sizes if final else sizes.filter(F.col("members") <= node_size), ["mask", "pattern"]).select("mask", "pattern", "fp")
        out = leaf if out is None else out.unionByName(leaf)
        hot = sizes.filter(F.col("members") > node_size)
        if final or hot.isEmpty():
            return out
        children = F.create_map(*[x for m in masks for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(c)) for c in child_masks(m)]))])
        split = rows.join(hot.drop("members"), ["mask", "pattern"]).select("mask", "fp")
        # two nodes can have a child in common
        rows = common.stage(spark, split.select(F.explode(children[F.col("mask")]).alias("mask"), "fp").distinct(), "split")
        masks = sorted({c for m in masks for c in child_masks(m)})


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merges the classes of label that the links (a, b) connect; a label is the least index of its class."""
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return label
        a, b = a[open_], b[open_]
        x, y = x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def link_leaf(fp: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Local classes of distinct fingerprints (uint64, in Gray order): the least index that each is linked to."""
    n = len(fp)
    label = np.arange(n)
    # levels of nodes: [first member, last + 1), the bits all members share, and whether all differ in radius bits at most
    levels = []
    starts = np.arange(0, n, LEAF)
    ands, ors = np.bitwise_and.reduceat(fp, starts), np.bitwise_or.reduceat(fp, starts)
    while True:
        levels.append((starts, ands, ors))
        if len(starts) <= FAN:
            break
        group = np.arange(0, len(starts), FAN)
        starts, ands, ors = starts[group], np.bitwise_and.reduceat(ands, group), np.bitwise_or.reduceat(ors, group)
    top = len(levels[-1][0])
    a, b = np.triu_indices(top)
    stack = [(len(levels) - 1, a, b)]
    while stack:
        level, a, b = stack.pop()
        starts, ands, ors = levels[level]
        shared = ~(ands ^ ors)
        keep = np.bitwise_count((ands[a] ^ ands[b]) & shared[a] & shared[b]) <= radius
        a, b = a[keep], b[keep]
        if not len(a):
            continue
        whole = np.bitwise_count((ands[a] & ands[b]) ^ (ors[a] | ors[b])) <= radius
        ends = np.append(starts[1:], n)
        for i, j in zip(a[whole].tolist(), b[whole].tolist()):
            members = np.concatenate((np.arange(starts[i], ends[i]), np.arange(starts[j], ends[j])))
            label = _join(label, np.full(len(members), starts[i]), members)
        a, b = a[~whole], b[~whole]
        if level:
            low = len(levels[level - 1][0])
            i = (a[:, None, None] * FAN + np.arange(FAN)[None, :, None] + np.zeros((1, 1, FAN), int)).ravel()
            j = (b[:, None, None] * FAN + np.arange(FAN)[None, None, :] + np.zeros((1, FAN, 1), int)).ravel()
            ok = (i < low) & (j < low) & (i <= j)
            i, j = i[ok], j[ok]
            stack += [(level - 1, i[k : k + 8192], j[k : k + 8192]) for k in range(0, len(i), 8192)]
            continue
        i = (a[:, None, None] * LEAF + np.arange(LEAF)[None, :, None] + np.zeros((1, 1, LEAF), int)).ravel()
        j = (b[:, None, None] * LEAF + np.arange(LEAF)[None, None, :] + np.zeros((1, LEAF, 1), int)).ravel()
        ok = (i < j) & (j < n)
        i, j = i[ok], j[ok]
        near = np.bitwise_count(fp[i] ^ fp[j]) <= radius
        label = _join(label, i[near], j[near])
    return label


def _link_small(fp: np.ndarray, group: np.ndarray, radius: int) -> np.ndarray:
    """Local classes of many small groups at once: group numbers ascend, members of a group are neighbours."""
    label = np.arange(len(fp))
    most = int(np.bincount(group - group[0]).max()) if len(group) else 0
    for s in range(1, most):
        i = np.flatnonzero(group[s:] == group[:-s])
        i = i[np.bitwise_count(fp[i] ^ fp[i + s]) <= radius]
        label = _join(label, i, i + s)
    return label


def _leaf_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (mask, pattern, fp) rows -> (u, v): members and the local root of their class. One leaf at most is carried over."""

    def settle(cols: tuple[np.ndarray, ...], starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        fp = cols[2].view(np.uint64)
        sizes = np.diff(np.append(starts, len(fp)))
        group = np.repeat(np.arange(len(starts)), sizes)
        small = (sizes <= LEAF)[group]
        found = []
        if small.any():
            f = fp[small]
            found.append((f, f[_link_small(f, group[small], RADIUS)]))
        for k in np.flatnonzero(sizes > LEAF).tolist():
            f = fp[starts[k] : starts[k] + sizes[k]]
            found.append((f, f[link_leaf(f)]))
        u, v = (np.concatenate(x) for x in zip(*found))
        ne = u != v
        yield pa.RecordBatch.from_arrays([pa.array(u[ne].view(np.int64)), pa.array(v[ne].view(np.int64))], names=["u", "v"])

    held = None
    for b in batches:
        cols = tuple(b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if held is not None:
            cols = tuple(np.concatenate(x) for x in zip(held, cols))
        if not len(cols[0]):
            continue
        new = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)) + 1
        starts = np.concatenate(([0], new))
        last = starts[-1]
        held = tuple(x[last:] for x in cols)
        if last:
            yield from settle(tuple(x[:last] for x in cols), starts[:-1])
    if held is not None and len(held[0]):
        yield from settle(held, np.array([0]))


def link_edges(spark: SparkSession, fps: DataFrame, node_size: int = 2048) -> DataFrame:
    """fps(fp), distinct -> edges (u, v) whose components are those of the graph of all links."""
    rows = leaves(spark, fps, node_size).withColumn("rank", gray_rank(F.col("fp")))
    dealt = rows.repartition("mask", "pattern").sortWithinPartitions("mask", "pattern", "rank").select("mask", "pattern", "fp")
    return dealt.mapInArrow(_leaf_edges, "u long, v long").distinct()


def components(spark: SparkSession, prints: DataFrame, order: Column) -> DataFrame:
    """prints(fp, ...) -> (fp, first): for each distinct fingerprint, the least order of its component."""
    fps = common.stage(spark, prints.groupBy("fp").agg(F.min(order).alias("own")), "prints")
    roots = connected(spark, link_edges(spark, fps.select("fp"))).withColumnRenamed("node", "fp")
    # aggregates are staged before they are joined, so that a hub's rows are a plain shuffle, which can be split
    rooted = common.stage(spark, fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    least = common.stage(spark, rooted.groupBy("root").agg(F.min("own").alias("first")), "least")
    return common.stage(spark, rooted.join(least, "root").select("fp", "first"), "components")


def near_groups(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id."""
    prints = common.stage(spark, fingerprints(docs, "doc_id"), "fingerprints")
    found = components(spark, prints, F.col("doc_id"))
    return prints.join(found, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first").alias("component_id"))


def drop_near_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: of each component the one with the smallest doc_id (of repeated ids one row)."""
    numbered = common.stage(spark, docs.select(common.whole_row(docs).alias("row"), "doc_id", F.monotonically_increasing_id().alias("uid")), "numbered")
    prints = common.stage(spark, fingerprints(numbered.select("doc_id", "uid", "row.text"), "doc_id", "uid"), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("uid"))
    stay = components(spark, prints, first).select("first.uid").distinct()
    return numbered.join(stay, "uid", "left_semi").select("row.*")


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark, common.table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
QUERIES = {"op2_simhash_dedup": op2_simhash_dedup}
