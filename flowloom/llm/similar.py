"""Near copies by shingle similarity, found through Gray-order nodes of SimHash fingerprints.

Copies are texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more, and texts that such links
connect. Texts of equal sets are tied first, by a digest of the set; one of each goes on.

Upper nodes hold the documents that share one of a few shingle hashes. A node's members are sorted by
the Gray rank of their fingerprints (majority bits of the set) and factored into levels of shared bits; pairs of
groups descend together and are pruned once their accumulated differences exceed WIDE bits. Of the pairs left, each
document offers the closest one of another class, by a signature of 512 min-hash bits. Offers are checked by the
exact sets, links merge classes, and the next round offers the closest ones not yet refused. Rounds end when few of
the offers hold. So a round checks SKETCH pairs a document at most, however large the groups are, and a document
stops offering once all its neighbours are of its class.

A node over ``node_size`` members is dealt into parts of that size, anew in each round, with some LEADERS of its
members in all parts, so no task holds an unbounded node and a group of near copies meets through its leaders.

The rounds join most of what belongs together; whatever they pass over is found exactly afterwards (``left_over``). Two
sets of the similarity share a hash among the first fifth of either, in any order common to all sets. Nodes of all
these hashes that hold several classes give their pairs of different classes, but only those that can be similar: of the
first hash two sets share, none of the hashes before it is shared, so what each has from there on must reach the overlap
that the similarity asks of their sizes. In nodes over LEAF members each set also brings the parities of its hashes by
buckets; sets differ in as many hashes as in parities at least. Both tests only rule out pairs that can't be similar. All
others are checked by the exact sets, unless the rounds refused them. So no link is lost. Hashes that are frequent in a
sample come last in the order, which keeps nodes small and changes no result. Of a large node, parts meet in pairs, but
not those of its commonest class with each other.

Defined cases: texts without words have equal, empty sets; texts of fewer words than a shingle are one shingle; of a
group the row with the smallest doc_id stays (a null id only if all are null; of repeated ids the first row read);
texts of any length are read whole; an empty table gives an empty result; extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from . import common
from .components import connected
from .simhash import FAN, LEAF, gray_rank, majority, shingle_hashes
from .tokens import runs

SHINGLE, SIMILARITY = 5, 0.8
#: Nodes of a document in the rounds, by hashes that aren't frequent and by any; bits of fingerprints within which pairs are looked at; members of a part; documents in all parts of a node.
SKETCH, ANY, WIDE, NODE_SIZE, LEADERS = 6, 2, 21, 1024, 16
#: Share of a round's pairs that hold, below which it is the last one.
WORTH = 0.1
#: Documents of the sample that shows frequent hashes; in how many of them a frequent one is; how many are told apart.
SAMPLE, FREQUENT, MOST_FREQUENT = 4096, 4, 100_000
SIGNATURE = 512
#: Parities of a set at most; a set has one to two buckets a hash below that.
MOST_PARITIES = 4096
_NONE = np.iinfo(np.int64).max


def signature(h: np.ndarray) -> bytes:
    """512 bits of one-permutation min-hashes of the ascending hashes h; empty buckets take over the next filled one's, mixed with the distance."""
    if not len(h):
        return bytes(SIGNATURE // 8)
    bucket = (h >> np.uint64(55)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    filled, least = bucket[first], h[first]
    every = np.arange(SIGNATURE)
    at = np.searchsorted(filled, every)
    at[at == len(filled)] = 0
    far = ((filled[at] - every) % SIGNATURE).astype(np.uint64)
    mixed = (least[at] ^ (far * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
    return np.packbits((mixed >> np.uint64(63)).astype(bool)).tobytes()


def parities(h: np.ndarray) -> bytes:
    """Of each bucket of the hashes h, by their last bits, whether it holds an odd number. The halves of a set's parities, XORed, are its parities by half the buckets."""
    n = min(MOST_PARITIES, max(64, 1 << (len(h) - 1).bit_length())) if len(h) else 64
    return np.packbits(np.bincount((h & np.uint64(n - 1)).astype(np.int64), minlength=n) % 2 == 1).tobytes()


def folded(bits: list[bytes]) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Words (of 64 parities) of each set, and by each number of words the parities of all sets that have as many or more."""
    words = np.array([len(x) // 8 for x in bits])
    w, by = int(words.max()), {}
    level = np.zeros((len(bits), w), np.uint64)
    while True:
        mine = np.flatnonzero(words == w)
        level[mine] = np.frombuffer(b"".join(bits[i] for i in mine.tolist()), "<u8").reshape(-1, w)
        by[w] = level
        if w == words.min():
            return words, by
        w //= 2
        level = level[:, :w] ^ level[:, w:]


def most_different(size: np.ndarray, similarity: float) -> np.ndarray:
    """Bits in which the signatures of two sets differ at most, if they are similar: four standard deviations above the mean."""
    seen = np.sqrt(np.minimum(np.maximum(size, 1), SIGNATURE))
    return SIGNATURE * ((1 - similarity) / 2 + 2 * np.sqrt(similarity * (1 - similarity)) / seen + 4 * np.sqrt(0.09 / SIGNATURE))


def shared_least(size: np.ndarray | int, similarity: float) -> np.ndarray:
    """Hashes that a set of the size shares at least with any similar set."""
    return np.ceil(similarity * np.asarray(size) - 1e-6).astype(np.int64)


def frequent(docs: DataFrame, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Ascending hashes that are frequent in a sample of docs(uid, text), and in how many of its texts each is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, texts in runs(b.column("text")):
                for t in texts:
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(t, shingle)).view(np.int64))], names=["key"])

    one_in = -(-docs.count() // SAMPLE) or 1
    keys = docs.filter(F.pmod(F.xxhash64("uid"), F.lit(one_in)) == 0).select("text").mapInArrow(run, "key long")
    found = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "key").limit(MOST_FREQUENT).collect()
    key, n = (np.array([r[i] for r in found], np.int64) for i in range(2))
    order = np.argsort(key.view(np.uint64))
    return key.view(np.uint64)[order], n[order]


def sketches(docs: DataFrame, common_: tuple[np.ndarray, np.ndarray], shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs(uid, text) -> (uid, fp, size, digest, keys, sig, first, bits): of each text's set its fingerprint, size, digest, hashes for the rounds, signature, first hashes and parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, times = common_
        for b in batches:
            rows = []
            for t in (t for _, _, texts in runs(b.column("text")) for t in texts):
                h = np.unique(shingle_hashes(t, shingle))
                seen = np.zeros(len(h), np.int64)
                if len(often):
                    at = np.minimum(np.searchsorted(often, h), len(often) - 1)
                    seen = np.where(often[at] == h, times[at], 0)
                order = np.argsort(seen, kind="stable")  # of equally frequent ones by hash
                first = h[order][: len(h) - int(shared_least(len(h), similarity)) + 1]
                keys = np.union1d(h[seen == 0][:SKETCH], h[:ANY])
                rows.append((majority(h) if len(h) else 0, len(h), xxh3_128_digest(h.tobytes()), keys.view(np.int64), signature(h), first.view(np.int64), parities(h)))
            cols = list(zip(*rows)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()), pa.binary())
            names = ["uid", "fp", "size", "digest", "keys", "sig", "first", "bits"]
            yield pa.RecordBatch.from_arrays([b.column("uid"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)

    return docs.select("uid", "text").mapInArrow(run, "uid long, fp long, size long, digest binary, keys array<long>, sig binary, first array<long>, bits binary")


def near_pairs(fp: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Fingerprints in Gray order -> batches of pairs (i < j) within the radius, by descent through groups of shared bits."""
    n, levels = len(fp), []
    starts = np.arange(0, n, LEAF)
    ands, ors = np.bitwise_and.reduceat(fp, starts), np.bitwise_or.reduceat(fp, starts)
    while True:
        levels.append((ands, ors))
        if len(starts) <= FAN:
            break
        group = np.arange(0, len(starts), FAN)
        starts, ands, ors = starts[group], np.bitwise_and.reduceat(ands, group), np.bitwise_or.reduceat(ors, group)
    stack = [(len(levels) - 1, *np.triu_indices(len(levels[-1][0])))]
    while stack:
        level, a, b = stack.pop()
        ands, ors = levels[level]
        shared = ~(ands ^ ors)
        keep = np.bitwise_count((ands[a] ^ ands[b]) & shared[a] & shared[b]) <= radius
        a, b = a[keep], b[keep]
        fan, low = (FAN, len(levels[level - 1][0])) if level else (LEAF, n)
        i = (a[:, None, None] * fan + np.arange(fan)[None, :, None] + np.zeros((1, 1, fan), int)).ravel()
        j = (b[:, None, None] * fan + np.arange(fan)[None, None, :] + np.zeros((1, fan, 1), int)).ravel()
        ok = (i <= j if level else i < j) & (i < low) & (j < low)
        i, j = i[ok], j[ok]
        if level:
            stack += [(level - 1, i[k : k + 1024], j[k : k + 1024]) for k in range(0, len(i), 1024)]
        else:
            near = np.bitwise_count(fp[i] ^ fp[j]) <= radius
            yield i[near], j[near]


def _pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum(a, b).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.maximum(a, b).view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)


def _offers(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows (key, part, uid, fp, size, sig, class, refused), parts together and in Gray order -> (a, b, far): each row's closest one of another class."""

    def settle(held: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        uid, fp, size, cls = (held.column(c).to_numpy(zero_copy_only=False) for c in ("uid", "fp", "size", "class"))
        fp, n = fp.view(np.uint64), held.num_rows
        sig = np.frombuffer(b"".join(held.column("sig").to_pylist()), "<u8").reshape(n, -1)
        partners = held.column("refused")
        many = np.diff(partners.offsets.to_numpy()) if n else np.empty(0, int)
        refused = _pair_key(np.repeat(uid, many), partners.flatten().to_numpy(zero_copy_only=False))
        cut, best = most_different(size, similarity), np.full(n, _NONE)

        def look(i: np.ndarray, j: np.ndarray) -> None:
            ok = (cls[i] != cls[j]) & (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]))
            i, j = i[ok], j[ok]
            far = np.bitwise_count(sig[i] ^ sig[j]).sum(axis=1, dtype=np.int64)
            ok = far <= np.maximum(cut[i], cut[j])
            if len(refused):
                ok &= ~np.isin(_pair_key(uid[i], uid[j]), refused)
            i, j, far = i[ok], j[ok], far[ok] << 40
            np.minimum.at(best, i, far | j)
            np.minimum.at(best, j, far | i)

        sizes = np.diff(np.append(starts, n))
        group = np.repeat(np.arange(len(starts)), sizes)
        small = np.flatnonzero((sizes <= LEAF)[group])
        for s in range(1, LEAF if len(small) else 1):
            i, j = small[:-s], small[s:]
            ok = (group[i] == group[j]) & (np.bitwise_count(fp[i] ^ fp[j]) <= WIDE)
            look(i[ok], j[ok])
        for at, k in zip(starts[sizes > LEAF].tolist(), sizes[sizes > LEAF].tolist()):
            if (cls[at : at + k] != cls[at]).any():
                for i, j in near_pairs(fp[at : at + k], WIDE):
                    look(i + at, j + at)
        i = np.flatnonzero(best != _NONE)
        return pa.RecordBatch.from_arrays([pa.array(uid[i]), pa.array(uid[best[i] & ((1 << 40) - 1)]), pa.array(best[i] >> 40)], names=["a", "b", "far"])

    rest = None
    for b in batches:
        b = pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0] if rest is not None and rest.num_rows else b
        if not b.num_rows:
            continue
        key, part = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "part"))
        starts = np.concatenate(([0], np.flatnonzero((np.diff(key) != 0) | (np.diff(part) != 0)) + 1))
        if starts[-1]:
            yield settle(b.slice(0, starts[-1]), starts[:-1])
        rest = b.slice(starts[-1])
    if rest is not None and rest.num_rows:
        yield settle(rest, np.array([0]))


def offers(nodes: DataFrame, roots: DataFrame, refused: DataFrame, round_: int, similarity: float, node_size: int) -> DataFrame:
    """nodes(key, members, uid, fp, size, sig), roots(node, root), refused(a, b) -> (a, b): whom each document offers, one at most."""
    mine = refused.groupBy("a").agg(F.collect_list("b").alias("refused")).withColumnRenamed("a", "uid")  # one a round at most, as many as it offered
    rows = nodes.join(roots.withColumnRenamed("node", "uid"), "uid", "left").join(mine, "uid", "left")
    parts = F.ceil(F.col("members") / node_size)
    leads = F.pmod(F.xxhash64("uid"), F.col("members")) < LEADERS
    dealt = F.when(parts == 1, F.array(F.lit(0).cast("long"))).when(leads, F.sequence(F.lit(0).cast("long"), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("uid", F.lit(round_)), parts)))
    rows = rows.select(
        "key", F.explode(dealt).alias("part"), "uid", "fp", "size", "sig", F.coalesce("root", "uid").alias("class"),
        F.coalesce("refused", F.array().cast("array<long>")).alias("refused"), gray_rank(F.col("fp")).alias("rank"),
    )
    ordered = rows.repartition("key", "part").sortWithinPartitions("key", "part", "rank").drop("rank")
    found = ordered.mapInArrow(lambda batches: _offers(batches, similarity), "a long, b long, far long")
    return found.groupBy("a").agg(F.min(F.struct("far", "b")).alias("best")).select("a", "best.b")


def checked(spark: SparkSession, pairs: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """pairs(u, v), docs(uid, text), both staged -> (u, v, holds), by the exact sets. Only the texts of these pairs move, which take less room than the sets."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for x, y in zip(b.column("a"), b.column("b")):
                x, y = (np.unique(shingle_hashes(z.as_py(), shingle)) for z in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                found.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v"), pa.array(found, pa.bool_())], names=["u", "v", "holds"])

    def side(k: str, c: str) -> DataFrame:
        # staged, so that its size is known and a small one is broadcast: the other texts don't move then
        ids = common.stage(spark, pairs.select(F.col(k).alias("uid")).distinct(), "ids")
        return docs.join(ids, "uid", "left_semi").select(F.col("uid").alias(k), F.col("text").alias(c))

    a, b = side("u", "a"), side("v", "b")
    return pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(check, "u long, v long, holds boolean")


def _cell_pairs(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows (key, cell, part, own, uid, class, size, rest, bits), cells together -> (u, v): pairs of different classes that can be similar, if key is the first hash they share.

    Members of one part meet in the cell that is their own, those of two parts in the cell of both.
    """

    def settle(cols: list[np.ndarray], starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        _, _, part, own, uid, cls, size, rest, bits = cols
        ends = np.append(starts[1:], len(uid))

        def told(i: np.ndarray, j: np.ndarray, at: int = 0, parities_: tuple[np.ndarray, dict[int, np.ndarray]] | None = None) -> Iterator[pa.RecordBatch]:
            ok = (cls[i] != cls[j]) & ((part[i] != part[j]) | own[i])
            i, j = i[ok], j[ok]
            all_ = size[i] + size[j]
            both = np.ceil(similarity / (1 + similarity) * all_ - 1e-6).astype(np.int64)
            ok = both <= np.minimum(rest[i], rest[j])
            i, j, most = i[ok], j[ok], (all_ - 2 * both)[ok]
            if parities_ is not None:
                words, by = parities_
                w, ok = np.minimum(words[i - at], words[j - at]), np.zeros(len(i), bool)
                for x in np.unique(w).tolist():
                    k = np.flatnonzero(w == x)
                    ok[k] = np.bitwise_count(by[x][i[k] - at] ^ by[x][j[k] - at]).sum(axis=1, dtype=np.int64) <= most[k]
                i, j = i[ok], j[ok]
            if len(i):
                u, v = np.minimum(uid[i], uid[j]), np.maximum(uid[i], uid[j])
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        sizes = ends - starts
        group = np.repeat(np.arange(len(starts)), sizes)
        small = np.flatnonzero((sizes <= LEAF)[group])
        for s in range(1, LEAF if len(small) else 1):
            i, j = small[:-s], small[s:]
            ok = group[i] == group[j]
            yield from told(i[ok], j[ok])
        for at, end in zip(starts[sizes > LEAF].tolist(), ends[sizes > LEAF].tolist()):
            parities_ = folded(bits[at:end].tolist())
            for i in range(at, end, 128):  # a strip of the cell's pairs at a time
                x, y = np.meshgrid(np.arange(i, min(i + 128, end)), np.arange(i, end), indexing="ij")
                yield from told(x[x < y], y[x < y], at, parities_)

    held = None
    for b in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        if not len(cols[0]):
            continue
        starts = np.concatenate(([0], np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)) + 1))
        held = [x[starts[-1] :] for x in cols]
        if starts[-1]:
            yield from settle([x[: starts[-1]] for x in cols], starts[:-1])
    if held is not None and len(held[0]):
        yield from settle(held, np.array([0]))


def left_over(spark: SparkSession, firsts: DataFrame, roots: DataFrame, similarity: float, node_size: int) -> DataFrame:
    """firsts(uid, size, first, bits), roots(node, root) -> (u, v): all pairs of different classes that can be similar by their first hashes and parities."""
    of = firsts.join(roots.withColumnRenamed("node", "uid"), "uid", "left").select("uid", "size", F.coalesce("root", "uid").alias("class"), "first")
    flat = of.select(F.posexplode("first").alias("before", "key"), "uid", "class", "size").select("key", "uid", "class", "size", (F.col("size") - F.col("before")).alias("rest"))
    several = common.stage(spark, flat.groupBy("key").agg(F.min("class").alias("a"), F.max("class").alias("b")).filter("a < b").select("key"), "several")
    inside = common.stage(spark, flat.join(several, "key"), "inside")
    counts = inside.groupBy("key", "class").agg(F.count(F.lit(1)).alias("n"))
    nodes = common.stage(spark, counts.groupBy("key").agg(F.max_by("class", F.struct("n", "class")).alias("top"), F.max("n").alias("most"), F.sum("n").alias("members")), "nodes")
    few, many = (inside.join(nodes.filter(which), "key") for which in (F.col("members") <= LEAF, F.col("members") > LEAF))
    rows = many.join(firsts.select("uid", "bits"), "uid").unionByName(few, allowMissingColumns=True)
    whole, is_top = F.col("members") <= node_size, F.col("class") == F.col("top")
    tops, others = F.ceil(F.col("most") / node_size), F.ceil((F.col("members") - F.col("most")) / node_size)
    part = F.when(whole, F.lit(0).cast("long")).when(is_top, others + F.pmod(F.xxhash64("uid"), tops)).otherwise(F.pmod(F.xxhash64("uid"), others))
    rows = rows.select("key", "uid", "class", "size", "rest", "bits", whole.alias("whole"), is_top.alias("is_top"), others.alias("others"), F.when(whole, F.lit(1)).otherwise(tops + others).alias("parts"), part.alias("part"))
    cell = lambda j: F.least("part", j) * F.col("parts") + F.greatest("part", j)
    last = F.when(F.col("whole"), F.lit(0)).when(F.col("is_top"), F.col("others") - 1).otherwise(F.col("parts") - 1)
    dealt = rows.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), last.cast("long")), cell)))
    dealt = dealt.select("key", "cell", "part", (F.col("cell") == F.col("part") * F.col("parts") + F.col("part")).alias("own"), "uid", "class", "size", "rest", "bits")
    found = dealt.repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(lambda batches: _cell_pairs(batches, similarity), "u long, v long")
    pairs = common.stage(spark, found.distinct(), "pairs")
    common.forget(spark, several, inside, nodes)
    return pairs


def similar_components(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, node_size: int = NODE_SIZE) -> DataFrame:
    """docs(uid, text), staged -> (node, root): of each document that is linked, except the roots, its component's least uid."""
    rows = common.stage(spark, sketches(docs, frequent(docs, shingle), shingle, similarity), "sketches")
    equal = common.stage(spark, rows.groupBy("digest").agg(F.min("uid").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "equal-sets")
    tied = rows.select("uid", "digest").join(equal, "digest").filter("uid <> least")
    edges = common.stage(spark, tied.select(F.col("uid").alias("u"), F.col("least").alias("v")), "links")
    single = rows.join(edges.select(F.col("u").alias("uid")), "uid", "left_anti")
    alone = single.select(F.explode("keys").alias("key"), "uid", "fp", "size", "sig")
    sizes = common.stage(spark, alone.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), "nodes")
    nodes = common.stage(spark, alone.join(sizes, "key").select("key", "members", "uid", "fp", "size", "sig"), "members")
    common.forget(spark, equal, sizes)
    roots, refused, round_ = edges.select(F.col("u").alias("node"), F.col("v").alias("root")), nodes.select(F.col("uid").alias("a"), F.col("uid").alias("b")).limit(0), 0
    pair = [F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")]
    while True:
        made = common.stage(spark, offers(nodes, roots, refused, round_, similarity, node_size), "offers")
        pairs = common.stage(spark, made.select(*pair).distinct(), "pairs")
        found = common.stage(spark, checked(spark, pairs, docs, shingle, similarity), "checked")
        common.forget(spark, pairs)
        held = found.filter("holds").select("u", "v")
        refused = refused.unionByName(made.select("a", "b", *pair).join(found.filter("NOT holds").select("u", "v"), ["u", "v"], "left_semi").select("a", "b"))
        hold, all_ = held.count(), found.count()
        if not hold:
            break
        links = roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(held)
        roots = common.stage(spark, connected(spark, links), "roots")
        if hold < WORTH * all_:
            break
        # who offered nobody, and so was offered by nobody, has no candidate left; parts of large nodes are dealt anew
        still = made.select(F.col("a").alias("uid"))
        active = common.stage(spark, nodes.join(still, "uid", "left_semi").unionByName(nodes.filter(F.col("members") > node_size).join(still, "uid", "left_anti")), "members")
        common.forget(spark, nodes)
        nodes, round_ = active, round_ + 1
    pairs = left_over(spark, single.select("uid", "size", "first", "bits"), roots, similarity, node_size)
    pairs = common.stage(spark, pairs.join(refused.select(*pair).distinct(), ["u", "v"], "left_anti"), "pairs")
    found = common.stage(spark, checked(spark, pairs, docs, shingle, similarity), "checked")
    held = found.filter("holds").select("u", "v")
    if not held.isEmpty():
        links = roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(held)
        roots = common.stage(spark, connected(spark, links), "roots")
    common.forget(spark, nodes, rows)
    return roots


def drop_similar(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that stay: of each component of similar texts the one with the smallest doc_id (of repeated ids one row)."""
    numbered = common.stage(spark, docs.select(common.whole_row(docs).alias("row"), "doc_id", F.monotonically_increasing_id().alias("uid")), "numbered")
    roots = similar_components(spark, numbered.select("uid", "row.text"), shingle, similarity)
    member = roots.select("root", F.col("node").alias("uid")).unionByName(roots.select("root", F.col("root").alias("uid")).distinct())
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("uid"))
    named = common.stage(spark, numbered.select("uid", "doc_id").join(member, "uid").select("root", order.alias("at")), "members")
    least = common.stage(spark, named.groupBy("root").agg(F.min("at").alias("first")), "least")
    gone = common.stage(spark, named.join(least, "root").filter(F.col("at.uid") != F.col("first.uid")).select("at.uid"), "gone")
    return numbered.join(gone, "uid", "left_anti").select("row.*")
