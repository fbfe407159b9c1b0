import random
import re
from zlib import crc32

import numpy as np
import pytest

from flowloom.llm import char_model, common, license_scan, quality_classifier, toxicity

SF = "/root/testdata/sf0.1"


def accuracy(spark, rows, column):
    labels = {r["doc_id"]: r[column] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    return held, sum(a == b for a, b in held) / len(held)


def test_held_out_rule(spark):
    got = spark.createDataFrame([(i,) for i in [*range(50), -7, None]], "doc_id long").select("doc_id", common.held_out("doc_id").alias("h")).collect()
    assert all(r["h"] == (r["doc_id"] is not None and crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)


# --- toxicity ---


@pytest.fixture(scope="module")
def decoder():
    rnd = random.Random(0)
    words = "the of and idiot moron pathetic trash people garden river stupid clown worthless loser scum there where nothing small".split()
    text = " ".join(rnd.choice(words) for _ in range(40_000))
    units = char_model.codes()[np.frombuffer(f" {text} ".encode("utf-16-le"), "<u2")].astype(np.int32)
    counts = np.bincount((units[:-2] * 64 + units[1:-1]) * 64 + units[2:], minlength=64**3).reshape(64, 64, 64)
    return toxicity.Decoder(char_model.log_probabilities(counts))


@pytest.mark.parametrize(("text", "word"), [
    ("you 1d10t!", "idiot"), ("i d i o t", "idiot"), ("such a m.o.r.o.n.", "moron"), ("idiooooot", "idiot"), ("$tupid", "stupid"), ("p@thet1c", "pathetic"), ("tr4sh,", "trash"),
    ("m-0-r-0-n", "moron"), ("CL0WN", "clown"), ("lo$er", "loser"), ("s c u m", "scum"),
])
def test_deobfuscation(decoder, text, word):
    assert word in decoder.words(text)


@pytest.fixture(scope="module")
def sentence_decoder():
    rnd = random.Random(1)
    words = "the of and idiot moron such a i you people garden river clown there where nothing small are".split()
    text = " ".join(rnd.choice(words) for _ in range(40_000))
    units = char_model.codes()[np.frombuffer(f" {text} ".encode("utf-16-le"), "<u2")].astype(np.int32)
    counts = np.bincount((units[:-2] * 64 + units[1:-1]) * 64 + units[2:], minlength=64**3).reshape(64, 64, 64)
    return toxicity.Decoder(char_model.log_probabilities(counts))


@pytest.mark.parametrize(("text", "words"), [
    ("a i d i o t", ["a", "idiot"]), ("s u c h a m o r o n", ["such", "a", "moron"]), ("i d i o t c l o w n", ["idiot", "clown"]),
    ("y o u   1 d 1 0 t", ["you", "idiot"]), ("s m a l l   c l o w n", ["small", "clown"]), ("i d i o t", ["idiot"]),
    (" ".join("idiotclown" * 12), ["idiot", "clown"] * 12),
])
def test_spaced_runs_are_cut_into_words(sentence_decoder, text, words):
    assert sentence_decoder.words(text)[len(text.split()) :] == words


def test_clean_words_stay(decoder):
    assert decoder.words("The river, and (where) small book 2024 x") == ["the", "river", "and", "where", "small", "book", "2024", "x"]
    assert decoder.words(None) == decoder.words("") == [] and decoder.words("4" * 5000 + " a1" * 2000)


def test_viterbi_against_enumeration(decoder):
    """Swaps only: every reading of the lattice is scored."""
    p = decoder.p

    def best(token):
        out = []

        def go(i, a, b, score, word):
            if i == len(token):
                out.append((score + float(p[a, b, 0]), word))
                return
            ch, own = token[i], decoder._c(token[i])
            for cost, x in [(0, ch)] * bool(own) + [(toxicity.SWAP, x) for x in toxicity.LOOKS_LIKE.get(ch, "")]:
                c = decoder._c(x)
                go(i + 1, b, c, score - cost + float(p[a, b, c]), word + x)

        go(0, 0, 0, 0.0, "")
        return max(out)[1]

    for token in ("1d107", "m0r0n", "p47h371c", "5cum"):
        assert decoder.viterbi(token) == best(token)


def test_viterbi_reads_long_and_ambiguous_tokens_whole(decoder):
    """Look-alikes after character 48 are decoded, and no reading of several marks is dropped."""
    assert decoder.viterbi("garden" * 12 + "1d10t").endswith("idiot")
    p = decoder.p
    for token in ("***1*!*", "*1!*|*1"):
        readings = [(0.0, 0, 0, "")]
        for ch in token:
            grown = []
            for score, a, b, out in readings:
                if not ch.isalnum():
                    grown.append((score - (toxicity.DROP_MARK if ch in toxicity.LOOKS_LIKE else toxicity.SEPARATOR), a, b, out))
                for x in toxicity.LOOKS_LIKE[ch]:
                    c = decoder._c(x)
                    if out.endswith(x):
                        grown.append((score, a, b, out))
                    grown.append((score - toxicity.SWAP + float(p[a, b, c]), b, c, out + x))
            best = {}
            for r in grown:
                if (r[1:] not in best) or best[r[1:]][0] < r[0]:
                    best[r[1:]] = r
            readings = list(best.values())
        want = max((score + float(p[a, b, 0]), out) for score, a, b, out in readings)
        assert decoder.viterbi(token) == want[1]


def readings(decoder, token):
    """Every path through the lattice of a token: swaps, kept and dropped characters, kept and merged repeats, each at its cost."""
    out = []

    def go(i, a, b, score, word):
        if i == len(token):
            out.append((score + float(decoder.p[a, b, 0]), word))
            return
        ch, own = token[i], decoder._c(token[i])
        third = i >= 2 and token[i - 2] == token[i - 1] == ch
        arcs = [(0.0, ch)] * bool(own) + [(toxicity.SWAP, x) for x in toxicity.LOOKS_LIKE.get(ch, "")]
        if not own and (ch not in toxicity.LOOKS_LIKE or not ch.isalnum()):
            go(i + 1, a, b, score - (toxicity.DROP_MARK if ch in toxicity.LOOKS_LIKE else toxicity.SEPARATOR), word)
        for cost, x in arcs:
            c = decoder._c(x)
            if b and b == c and word.endswith(x):
                go(i + 1, a, b, score - (0 if cost or third else toxicity.REPEAT), word)
            go(i + 1, b, c, score - cost - (toxicity.KEEP_RUN if third and not cost else 0) + float(decoder.p[a, b, c]), word + x)

    go(0, 0, 0, 0.0, "")
    return out


def test_viterbi_with_repeats_and_separators_against_enumeration(decoder):
    rnd = random.Random(11)
    tokens = ["idiooot", "m-o-r-on", "1d-10t", "m00r0n", "ssscuum", "p@+heti", "l.o.s.er", "***", "i-i-i", "a$$"]
    tokens += ["".join(rnd.choice("idot10-.*$oo") for _ in range(rnd.randint(3, 8))) for _ in range(150)]
    for token in tokens:
        every = readings(decoder, token)
        best = max(x for x, _ in every)
        assert decoder.viterbi(token) in {w.strip() for x, w in every if x > best - 1e-4}, token


def test_char_model_counts_all_texts(spark, docs_of):
    a = char_model.trigram_counts(docs_of(["ab", None, "", "AB ab"]))
    one, two = 1, 2
    assert a[0, one, two] == 3 and a[one, two, 0] == 3
    assert np.allclose(np.exp(char_model.log_probabilities(a).astype(float)).sum(axis=2), 1, atol=1e-3)
    assert char_model.trigram_counts(docs_of(["x"]).limit(0)).sum() == 0


def test_toxicity_held_out(spark):
    rows = toxicity.op1_toxicity(spark, SF).collect()
    held, acc = accuracy(spark, rows, "toxic")
    assert acc > 0.97 and sum(a and b for a, b in held) / sum(a for a, _ in held) > 0.85
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_toxicity_edges(spark, docs_of):
    rnd = random.Random(3)
    words = [f"wo{chr(97 + i % 26)}{chr(97 + i // 26)}k" for i in range(200)]
    rows = [(i, " ".join(rnd.choices(words, k=30)) + (" blarghface" if i % 4 == 0 else "")) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "blarghf4ce"), (1002, "blarghf4ce"), (1003, "wobak " * 20_000), (None, "blarghface")]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(None, 1, 1), (5000, 1, None)], "doc_id long, quality int, toxic int")
    df = docs_of(rows)
    model = toxicity.fit(spark, df, labels)
    got = [(r["doc_id"], r["score"] >= 0.7) for r in toxicity.score(df, model).collect()]
    assert len(got) == len(rows) and {i for i, bad in got if bad} == {*range(0, 400, 4), 1002, None}
    left = toxicity.drop_toxic(df, model)
    assert left.columns == df.columns and {r["doc_id"] for r in left.collect()} == {i for i, _ in rows} - {*range(0, 400, 4), 1002, None}
    assert toxicity.score(df.limit(0), model).isEmpty()
    flat = toxicity.fit(spark, df, labels.filter("toxic = 0"))
    assert len({r["score"] for r in toxicity.score(df, flat).collect()}) == 1 and not flat.cues
    assert not toxicity.fit(spark, df.limit(0), labels.limit(0)).cues


# --- quality classifier ---


def test_quality_held_out(spark):
    _, acc = accuracy(spark, quality_classifier.op10_quality_classifier(spark, SF).collect(), "quality")
    assert acc > 0.97


def test_statistics_and_moments(spark, docs_of):
    texts = [None, "", "One two three.", "A A A A", "x y z\nx y z", "é" * 40, "w " * 20_000]
    df = docs_of(texts)
    got = {r["doc_id"]: tuple(r)[1:] for r in quality_classifier.with_statistics(df).collect()}
    assert all(np.allclose(got[i], quality_classifier.statistics(t)) for i, t in enumerate(texts)) and got[0] == got[1]


def plain_statistics(t):
    """The same from the text itself, by plain counting."""
    t, k = t or "", quality_classifier._PRIOR
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    n, m = len(words), len(words) + k
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    rate = lambda c, usual=0.0: ((c + k * usual) / m) ** 0.5
    grams = [tuple(words[i : i + 3]) for i in range(n - 2)]
    return (
        np.log(n + 1), np.log((sum(len(w.encode()) for w in words) + 5 * k) / m), rate(sum(c in "#*$%&|<>" for c in t)), rate(sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ" for c in t), 0.1),
        rate(t.count("!")), rate(sum(c in ".!?" for c in t), 0.1), rate(sum(c in "0123456789" for c in t)), np.log(len(set(words)) + k) / np.log(m), (len(set(grams)) + k) / (len(grams) + k),
        rate(sum(a == b for a, b in zip(words, words[1:]))), np.log((n + k) / (len(lines) + 1)), ((len(lines) - len(set(lines))) / (len(lines) + 10)) ** 0.5,
    )


def test_statistics_against_plain_counting():
    rnd = random.Random(8)
    texts = [None, "", "ÀB Ü! ×\n\nÀB Ü! ×\n \nx", "a\u00a0b\x0bc"] + ["".join(rnd.choice("aB éÄ.!?1#$\n\t") for _ in range(rnd.randint(0, 300))) for _ in range(80)]
    for t in texts:
        assert np.allclose(quality_classifier.statistics(t), plain_statistics(t)), t


def test_fit_against_direct_moments(spark):
    """Means, covariances, their shrinkage and the factors, worked out from the rows themselves."""
    rnd = np.random.default_rng(4)
    d, shrink = len(quality_classifier.NAMES), 0.02
    x, y = rnd.normal(0, 1, (90, d)), np.arange(90) % 3 // 2
    x[y == 1] = x[y == 1] * 0.3 + 1
    stats = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "doc_id long, " + ", ".join(f"{n} double" for n in quality_classifier.NAMES))
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = quality_classifier.fit(stats, labels, shrink)
    covs = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    pooled = sum((y == c).sum() * covs[c] for c in (0, 1)) / len(y)
    for c, (mean, inverse, offset) in enumerate(model.parts):
        n = (y == c).sum()
        weak = min(0.9, shrink + d / n)
        cov = (1 - weak) * covs[c] + weak * (0.5 * np.diag(np.diag(covs[c])) + 0.5 * pooled) + 1e-6 * np.eye(d)
        assert np.allclose(mean, x[y == c].mean(axis=0)) and np.allclose(inverse @ cov @ inverse.T, np.eye(d)) and np.isclose(offset, np.log(n / len(y)) - 0.5 * np.linalg.slogdet(cov)[1])


def test_discriminant_against_direct_densities(spark):
    rnd = np.random.default_rng(0)
    d = len(quality_classifier.NAMES)
    a, b = rnd.normal(0, 1, (300, d)), rnd.normal(0.7, 0.5, (500, d))
    model = quality_classifier.Model({0: (300, a.sum(0), a.T @ a), 1: (500, b.sum(0), b.T @ b)}, 0.02)

    def density(x, mean, inverse, prior):
        cov = np.linalg.inv(inverse) @ np.linalg.inv(inverse).T
        return prior * np.exp(-0.5 * (x - mean) @ np.linalg.solve(cov, x - mean)) / np.sqrt(np.linalg.det(cov))

    for x in b[:5]:
        p0, p1 = (density(x, m, i, k / 800) for (m, i, _), k in zip(model.parts, (300, 500)))
        assert abs(model.score(x[None])[0] - p1 / (p0 + p1)) < 1e-6
    assert (model.score(b) > 0.5).mean() > 0.97 > 0.03 > (model.score(a) > 0.5).mean()


def test_quality_edges(spark, docs_of):
    df = docs_of([(1, "a b c."), (1, "a b c."), (2, None), (None, "x")])
    for labels in ([], [(1, 1, 0)], [(None, 0, 0), (1, None, 0)]):
        got = quality_classifier.score(spark, df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
        assert len(got) == 4 and len({r["score"] for r in got}) == 1
    assert quality_classifier.score(spark, df.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).isEmpty()


# --- license scan ---


def brute_matches(text):
    """Every template against every window of the text, by full longest common subsequence."""
    words, out = license_scan.words_of(text), set()
    for name, body in license_scan.TEMPLATES.items():
        t = license_scan.words_of(body)
        for at in range(len(words)):
            part = words[at : at + len(t) + license_scan.BAND]
            row = [0] * (len(part) + 1)
            for w in t:
                prev = row[:]
                for j, x in enumerate(part):
                    row[j + 1] = prev[j] + 1 if x == w else max(prev[j + 1], row[j])
            if row[-1] >= license_scan.COVERAGE * len(t):
                out.add(name)
    return out


def test_license_scan(spark, docs_of):
    rnd = random.Random(4)
    filler = lambda n: " ".join(rnd.choice(["alpha", "beta", "license", "the", "version", "under", "gamma"]) for _ in range(n))
    bodies = license_scan.TEMPLATES
    texts = [f"{filler(20)} {bodies[n]} {filler(15)}" for n in sorted(bodies)]
    long = license_scan.words_of(bodies["MIT-permission"])
    texts += [" ".join(w for k, w in enumerate(long) if k % 12), None, "", "licensed", f"{bodies['MIT']} {filler(9)} {bodies['MIT']}", filler(60)]
    got = license_scan.scan_licenses(docs_of(texts)).collect()
    found = {}
    for r in got:
        found.setdefault(r["doc_id"], set()).add(r["license"])
        assert r["coverage"] >= 0.8 and r["end_word"] > r["first_word"] and r["span"] == " ".join(license_scan.words_of(texts[r["doc_id"]])[r["first_word"] : r["end_word"]])
    for i, n in enumerate(sorted(bodies)):
        assert found[i] & brute_matches(texts[i]) == found[i] and n in found[i] | ({n} if n in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "CC-BY-4.0") else set()), n
    assert found[len(bodies)] == {"MIT-permission"} and len([r for r in got if r["doc_id"] == len(bodies) + 4 and r["license"] == "MIT"]) == 2
    assert not any(len(bodies) < i < len(bodies) + 4 for i in found)
    assert license_scan.scan_licenses(docs_of(texts).limit(0)).isEmpty()


def test_alignment_against_full_table():
    rnd = random.Random(6)
    for _ in range(60):
        t, part = np.array([rnd.randint(1, 5) for _ in range(7)]), np.array([rnd.randint(1, 6) for _ in range(12)])
        m, x, y = license_scan.aligned(t, part, -20, 20)
        row = [0] * (len(part) + 1)
        for w in t.tolist():
            prev = row[:]
            for j, v in enumerate(part.tolist()):
                row[j + 1] = prev[j] + 1 if v == w else max(prev[j + 1], row[j])
        assert m == row[-1] and (not m or y - x >= m)
        if m:
            assert part[x] in t and part[y - 1] in t


def test_winnowing_hits_every_long_run():
    s = license_scan.Scanner()
    for name, ids in zip(s.names, s.templates):
        k, window = license_scan.gram_size(len(ids)), license_scan.winnow_size(len(ids))
        grams, need = s.grams(ids, k), k + window - 1
        for at in range(len(ids) - need + 1):
            assert np.isin(grams[at : at + window], s.keys[k]).any(), name


def test_repeats_side_by_side_are_all_found():
    s, body = license_scan.Scanner(), license_scan.TEMPLATES["MIT"]
    for n, gap in ((2, ""), (4, ""), (3, " and also "), (5000, "")):
        got = s.scan((body + gap + "\n") * n)
        assert [g[0] for g in got] == ["MIT"] * n and all(a[2] <= b[1] for a, b in zip(got, got[1:]))


def test_recall_on_edited_notices():
    """Words go, change and come in at random; where full alignment still covers a template, the scan finds a match there."""
    rnd, s, found, wanted = random.Random(9), license_scan.Scanner(), 0, 0
    for _ in range(600):
        name = rnd.choice(s.names)
        words = license_scan.words_of(license_scan.TEMPLATES[name])
        edited = [w for w in words if rnd.random() > 0.1]
        for _ in range(rnd.randint(0, max(1, len(words) // 12))):
            edited.insert(rnd.randrange(len(edited) + 1), "zzz")
        row = [0] * (len(edited) + 1)
        for w in words:
            prev = row[:]
            for j, x in enumerate(edited):
                row[j + 1] = prev[j] + 1 if x == w else max(prev[j + 1], row[j])
        if row[-1] >= license_scan.COVERAGE * len(words):
            wanted += 1
            found += bool(s.scan("some text before it " + " ".join(edited) + " and after it"))
    assert wanted > 300 and found >= 0.99 * wanted, (found, wanted)


def test_odd_license_tables(spark, docs_of):
    body = license_scan.TEMPLATES["MIT"]
    rows = [(1, body), (1, body), (None, body), (2, "filler " * 200_000 + body)]
    got = license_scan.scan_licenses(docs_of(rows)).collect()
    assert sorted(((r["doc_id"], r["first_word"]) for r in got), key=str) == sorted([(1, 0), (1, 0), (None, 0), (2, 200_000)], key=str)
