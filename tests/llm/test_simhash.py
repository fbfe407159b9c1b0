import re

import numpy as np
import pytest
import xxhash

from flowloom.llm import common, components, exact_dedup, similar
from flowloom.llm import simhash as S
from flowloom.llm.components import connected


def brute_print(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(len(w) - 2)] if len(w) > 2 else [xxhash.xxh64_intdigest(" ".join(w), 42)] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(prints):
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i in range(len(prints)):
            near = np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 3)
            least = min(label[j] for j in near)
            for j in near:
                if label[j] != least:
                    label[j], changed = least, True
    return label


def clustered(n, seed, spread=6):
    rnd = np.random.default_rng(seed)
    centres = rnd.integers(0, 1 << 63, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = set()
    while len(out) < n:
        x = int(centres[rnd.integers(4)])
        for b in rnd.integers(0, 64, rnd.integers(0, spread)):
            x ^= 1 << int(b)
        out.add(x)
    return np.array(sorted(out), np.uint64)


def gray(x):
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


@pytest.mark.parametrize("text", [None, "", " \t", "One", "one two", "a b c", "A b C d e f g a b c", "É é ß İ", "a\u00a0b c\x0bd", "x y " * 4000])
def test_fingerprint(text):
    assert S.fingerprint(text) & (1 << 64) - 1 == brute_print(text)


@pytest.mark.parametrize(("n", "spread"), [(1, 2), (40, 3), (700, 6), (1500, 9), (900, 30)])
def test_leaf_index_against_brute_force(n, spread):
    fp = clustered(n, n, spread)
    fp = fp[np.argsort(gray(fp))]
    want, got = brute_classes(fp), S.link_leaf(fp).tolist()
    same = lambda a: [a.index(x) for x in a]
    assert same(got) == same(want)


def test_gray_rank(spark):
    xs = [0, 1, 3, 2, 6, -1, 1 << 62, -(1 << 63)]
    got = [r["r"] for r in spark.createDataFrame([(x,) for x in xs], "fp long").select(S.gray_rank(S.F.col("fp")).alias("r")).collect()]
    assert [g + (1 << 63) for g in got] == [int(gray(np.array([x], np.int64).view(np.uint64))[0]) for x in xs]


def test_child_masks_cover_every_pair():
    for mask in S.child_masks(0):
        kids = S.child_masks(mask)
        assert len(kids) == 4 and all(k & mask == mask for k in kids)
        union = 0
        for k in kids:
            assert not union & (k & ~mask)
            union |= k & ~mask
        assert union | mask == (1 << 64) - 1


@pytest.mark.parametrize("node_size", [2, 50, 2048])
def test_links_lose_nothing_at_any_node_size(spark, node_size):
    fp = clustered(600, 3, 7)
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    parent = {int(x): int(x) for x in fp.view(np.int64)}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in S.link_edges(spark, df, node_size).collect():
        assert (r["u"] ^ r["v"]) is not None
        parent[root(r["u"])] = root(r["v"])
    got = [root(int(x)) for x in fp.view(np.int64)]
    want = brute_classes(fp)
    assert len(set(got)) == len(set(want)) and len(set(zip(got, want))) == len(set(want))


def test_components(spark):
    import random

    rnd = random.Random(2)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(200)]
    got = {r["node"]: r["root"] for r in connected(spark, spark.createDataFrame(pairs, "u long, v long")).collect()}
    adj = {}
    for a, b in pairs:
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).add(a)
    for x in adj:
        seen, todo = {x}, [x]
        while todo:
            for y in adj[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        assert got.get(x, x) == min(seen)


def test_documents(spark, docs_of):
    base = "the quick brown fox jumps over a lazy dog while many small birds sing in the old garden near the river bank today " * 8
    rows = [(7, base), (3, base.replace("today", "now", 1)), (9, base.upper()), (5, None), (6, ""), (4, "   "), (1, "something else entirely is written in this one"), (7, base), (None, base)]
    df = docs_of(rows)
    got = S.near_groups(spark, df).collect()
    prints = np.array([brute_print(t) for _, t in rows], np.uint64)
    label = brute_classes(prints)
    least = {c: min((i for (i, _), k in zip(rows, label) if k == c and i is not None), default=None) for c in label}
    want = sorted(((i, f"{int(p):016x}", least[c]) for (i, _), p, c in zip(rows, prints, label)), key=str)
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=str) == want
    left = S.drop_near_copies(spark, df)
    assert left.columns == df.columns and sorted(r["doc_id"] for r in left.collect()) == sorted(set(least.values()))
    assert S.near_groups(spark, df.limit(0)).isEmpty() and S.drop_near_copies(spark, df.limit(0)).isEmpty()


def shingle_sets(texts, k=5):
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) for t in texts]
    return [{" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set() for w in words]


def similar_survivors(rows):
    """Brute force: the least id of each component of rows (id, text) whose 5-word sets have a similarity of 0.8 or more."""
    sets = shingle_sets([t for _, t in rows])
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    pairs = 0
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b):
                pairs += 1
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
    least = {}
    for i, (k, _) in enumerate(rows):
        least.setdefault(root(i), []).append(k)
    return sorted(min(x) for x in least.values()), pairs


@pytest.mark.parametrize("node_size", [4, 2048])
def test_similar_texts_against_brute_force(spark, docs_of, node_size):
    """Edited copies (far beyond 3 bits), a large group of them, texts below 0.8, short and empty texts."""
    rnd = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(900)]
    rows = []
    for n in range(40):
        base = list(rnd.choice(vocabulary, 60 + 5 * n))
        for edits in ([0, 2, 5, 9] if n else [0] + [1] * 40):
            w = list(base)
            for at in rnd.integers(0, len(w), edits):
                w[at] = "edited" + str(rnd.integers(1000))
            rows.append((len(rows), " ".join(w)))
    rows += [(1000 + i, t) for i, t in enumerate(["", " ", "one two", "One  two", "one two three", None])]
    want, pairs = similar_survivors(rows)
    assert pairs > 100
    df = docs_of(rows)
    left = similar.drop_similar(spark, df)
    assert left.columns == df.columns and sorted(r["doc_id"] for r in left.collect()) == want
    staged = S.common.stage(spark, df.select(S.F.col("doc_id").cast("long").alias("uid"), "text"), "docs")
    gone = {r["node"] for r in similar.similar_components(spark, staged, node_size=node_size).collect()}
    assert sorted({i for i, _ in rows} - gone) == want
    assert similar.drop_similar(spark, df.limit(0)).isEmpty()


def test_similar_texts_without_a_common_node(spark, docs_of):
    """Texts above 0.8 whose least hashes all differ are linked."""
    rnd = np.random.default_rng(8)
    rows = []
    for n in range(5):
        w = [f"w{x}" for x in rnd.integers(0, 5000, 400)]
        other = list(w)
        for least in range(similar.SKETCH):  # a word of each of the least hashes' shingles is another one
            h = S.shingle_hashes(" ".join(w), 5)
            other[int(np.argsort(h)[least]) + 2] = f"other{n}"
        a, b = (np.sort(S.shingle_hashes(" ".join(x), 5)) for x in (w, other))
        assert not set(a[: similar.SKETCH]) & set(b[: similar.SKETCH])
        rows += [(2 * n, " ".join(w)), (2 * n + 1, " ".join(other))]
    want, pairs = similar_survivors(rows)
    assert pairs == 5 and len(want) == 5
    assert sorted(r["doc_id"] for r in similar.drop_similar(spark, docs_of(rows)).collect()) == want


@pytest.mark.parametrize("node_size, some", [(4, "false"), (2048, "a % 3 = 0")])
def test_what_the_rounds_pass_over_is_found(spark, docs_of, monkeypatch, node_size, some):
    """All links are found if the rounds offer nothing, or only what one document in three offers; large nodes with many classes, too."""
    rnd = np.random.default_rng(6)
    vocabulary = [f"w{i}" for i in range(900)]
    line, rows = list(rnd.choice(vocabulary, 30)), []
    for n in range(25):
        base = list(rnd.choice(vocabulary, 90 + 4 * n)) + line
        for edits in ([0, 1, 3, 8] if n else [0] + [1, 3] * 20):
            w = list(base)
            for at in rnd.integers(0, len(w), edits):
                w[at] = "edited" + str(rnd.integers(1000))
            rows.append((len(rows), " ".join(w)))
    want, pairs = similar_survivors(rows)
    assert pairs > 100 and len(want) > 25
    staged = S.common.stage(spark, docs_of(rows).select(S.F.col("doc_id").cast("long").alias("uid"), "text"), "docs")
    offers = similar.offers
    monkeypatch.setattr(similar, "offers", lambda *of: offers(*of).filter(some))
    gone = {r["node"] for r in similar.similar_components(spark, staged, node_size=node_size).collect()}
    assert sorted({i for i, _ in rows} - gone) == want


def test_pairs_of_a_large_group_of_near_copies(spark, docs_of, monkeypatch):
    """Of a large group whose members are edited to either side of 0.8, few pairs leave the nodes for the exact check, and no link is lost."""
    rnd = np.random.default_rng(11)
    base, rows = [f"w{x}" for x in rnd.integers(0, 5000, 150)], []
    for n in range(240):
        w = list(base)
        for at in rnd.integers(0, len(w), 1 if n < 120 else 3 + n % 4):
            w[at] = f"edited{n}"
        rows.append((n, " ".join(w)))
    want, pairs = similar_survivors(rows)
    assert pairs > 7000 and 20 < len(want) < 120
    made = []
    staged = S.common.stage(spark, docs_of(rows).select(S.F.col("doc_id").cast("long").alias("uid"), "text"), "docs")

    def counted(df, f, schema, *more):
        found = plain(df, f, schema, *more)
        if str(schema).startswith("u long, v long") and "holds" not in schema:
            made.append(found.count())
        return found

    plain = type(staged).mapInArrow
    monkeypatch.setattr(type(staged), "mapInArrow", counted)
    gone = {r["node"] for r in similar.similar_components(spark, staged).collect()}
    assert sorted({i for i, _ in rows} - gone) == want
    assert len(made) == 1 and made[0] < 10 * len(rows)


def test_parities(spark):
    """Sets differ in as many hashes as in parities at least, whatever their sizes."""
    rnd = np.random.default_rng(13)
    every = np.unique(rnd.integers(0, 2**63, 20_000).astype(np.uint64))
    sets = [every[:0], every[:1], *(np.sort(rnd.choice(every, n, replace=False)) for n in (60, 64, 65, 150, 300, 1000, 5000, 9000))]
    words, by = similar.folded([similar.parities(h) for h in sets])
    assert words.tolist() == [1, 1, 1, 1, 2, 4, 8, 16, 64, 64]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            level = by[min(words[i], words[j])]
            far = int(np.bitwise_count(level[i] ^ level[j]).sum())
            assert far <= len(np.setxor1d(a, b)) and (far - len(a) - len(b)) % 2 == 0


def test_pipeline_stage_drops_similar_texts(spark):
    """The stage keeps what brute force over 5-word sets keeps."""
    import corpus_pipeline

    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(1000)
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    want, _ = similar_survivors(rows)
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()) == want


def splits(df):
    """Whether Spark dealt a large key's rows to several tasks."""
    df.collect()
    return "skew=true" in df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def skewed(spark):
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k in conf:
        spark.conf.unset(k)


def test_a_hub_is_split(skewed):
    low = common.stage(skewed, skewed.range(1, 20_001, numPartitions=8).selectExpr("id AS u", "0L AS v"), "hub")
    assert splits(components._large_star(skewed, low))
    high = common.stage(skewed, skewed.range(1, 20_001, numPartitions=8).selectExpr("7000000L AS u", "id AS v"), "hub")
    assert splits(components._small_star(skewed, high))


def test_a_large_group_of_copies_is_split(skewed):
    digests = skewed.range(20_000, numPartitions=8).selectExpr("id AS doc_id", "id AS uid", "IF(id % 2 = 0, 'hot', CAST(id AS STRING)) AS text_sha256")
    settled = exact_dedup._settle(skewed, common.stage(skewed, digests, "digests"), 0.9)  # no winner: the ordinary way alone
    assert splits(settled) and {(r["group_size"], r["n"]) for r in settled.groupBy("group_size").count().withColumnRenamed("count", "n").collect()} == {(10_000, 10_000), (1, 10_000)}


def test_components_of_random_graphs(spark):
    """Many small graphs at once, chains, hubs and nodes that two roots share."""
    rnd = np.random.default_rng(12)
    edges = [(1000 * g + a, 1000 * g + b) for g in range(60) for a, b in rnd.integers(0, 9, (rnd.integers(1, 12), 2)).tolist()]
    edges += [(70_000 + i, 70_001 + i) for i in range(70)] + [(80_000, 80_000 + i) for i in range(1, 40)] + [(90_002, 90_000), (90_002, 90_001), (90_003, 90_001)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for x in root if find(x) != x}
    got = components.connected(spark, spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r["node"]: r["root"] for r in got} == want and len(got) == len(want)
