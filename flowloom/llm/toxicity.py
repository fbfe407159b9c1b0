"""Toxicity of deobfuscated text: a noisy channel over character lattices, then a classifier of the restored words.

Writers hide words by look-alike characters (1d10t), spacing (i d i o t, i.d.i.o.t) and repetition
(idiooot). A token that shows such signs becomes a lattice: each character may stand for itself or for
the letters it resembles, separators and repeats may be noise, each at a channel cost. Viterbi decoding
under a character trigram model, counted over the whole corpus, finds the likeliest letters. A run of
single characters is one lattice, in which a word may end at each gap (cheaper at wider gaps). Other
tokens decode to themselves. Tokens of any length are decoded exactly: the states are the last two letters, and
none is dropped. Of equally likely readings the first found stays. The memo of decoded words is bounded and
changes no result.

The classifier reads restored words only. Its cues are words and word beginnings that labelled toxic
documents use far more than others, counted by document over a sample of labelled rows (about
``max_labelled`` at most, those of least id hash, each text once; nothing else bounds the cues). The sample
has two halves: a cue that stands out in one half (two toxic documents or more use it, and of those that use it
nine in ten are toxic, were both kinds as many) gets its weight, the share of toxic documents among those that use it, from the
other, less one standard error, so chance finds weigh little and those under ``LEAST_WEIGHT`` nothing.
The evidence of a document is the sum of the log-odds of its three strongest cue words; the level that
parts the labelled sample with the fewest errors (a clean document counts CLEAN_COST times) scores 0.7,
the rest follows the logistic curve. Labels come from the learning folds only.

Defined cases: null and empty texts and texts without cues have the lowest score; rows with null labels
teach nothing; without labels of both kinds there are no cues and all scores are equal; repeated rows get one row each; an empty table gives an empty result; extra columns
of documents are ignored by ``score`` and kept by ``drop_toxic``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import char_model, common
from .tokens import runs

#: Letters that a character may stand for.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "*": "aeiou", "#": "h", "€": "e", "£": "l",
}
#: Channel costs in nats: a look-alike, a dropped repeat, a dropped separator, a dropped mark that could be a letter, a kept third repeat.
SWAP, REPEAT, SEPARATOR, DROP_MARK, KEEP_RUN = 1.0, 0.5, 1.0, 5.0, 4.0
#: In a spaced run: a word that ends at a gap of one character or of more, one that goes on over a gap of more.
BREAK, WIDE_BREAK, WIDE_JOIN = 1.0, 0.0, 4.0
THRESHOLD, LEAST_WEIGHT, CLEAN_COST = 0.7, 0.6, 1

_EDGE = ".,;:!?$%&*#|()-\"'[]{}<>_`~/\\=+«»„“”‘’…"
#: a letter run of three, a look-alike before a letter or between two, separators between single letters
_ODD = re.compile(r"([^\W\d_])\1\1|[0-9@$!|+(<*#€£][^\W\d_]|[^\W\d_][0-9@$!|+(<*#€£]+[^\W\d_]|[^\W\d_][0135478]$|(?:^|[\W_])[^\W_][\W_][^\W_][\W_][^\W_]")
_SPACED = re.compile(r"(?<!\S)(?:\S[ \t]+){2,}\S(?![^\s.,;:!?])")

_GAP = re.compile(r"[ \t]+")


class Decoder:
    """Restores words. log_p: char_model.log_probabilities."""

    def __init__(self, log_p: np.ndarray, limit: int = 50_000) -> None:
        self.p, self.code, self.limit = log_p, char_model.codes(), limit
        self.memo: dict[str, str] = {}

    def _c(self, ch: str) -> int:
        if ord(ch) < 1 << 16:
            return int(self.code[ord(ch)])
        return char_model.OTHER if ch.isalpha() else 0

    def viterbi(self, token: str, gaps: list[int] | None = None) -> str:
        """The likeliest letters of one token. States are the last two letters; 0 stands before the word.

        gaps: the white space before each character of a spaced run, whose words come back parted by spaces.
        No state is dropped. Readings are linked letters, so that long tokens cost no copies.
        """
        p, states = self.p, {(0, 0): (0.0, None)}
        for i, ch in enumerate(token):
            own = self._c(ch)
            moves = [(0.0, ch, own)] * bool(own) + [(SWAP, x, self._c(x)) for x in LOOKS_LIKE.get(ch, "")]
            skip = not own and (ch not in LOOKS_LIKE or not ch.isalnum())
            third = i >= 2 and token[i - 1] == ch and token[i - 2] == ch
            if i and gaps is not None:
                wide = gaps[i] > 1
                ended = [(v[0] + float(p[a, b, 0]) - (WIDE_BREAK if wide else BREAK), (v[1], " ")) for (a, b), v in states.items() if b]
                states = {k: (v[0] - WIDE_JOIN * wide * bool(k[1]), v[1]) for k, v in states.items()}
                if ended:
                    best = max(ended, key=lambda v: v[0])
                    if (0, 0) not in states or states[0, 0][0] < best[0]:
                        states[0, 0] = best
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}

            def put(key: tuple[int, int], score: float, out: tuple | None) -> None:
                if key not in new or new[key][0] < score:
                    new[key] = (score, out)

            for (a, b), (score, out) in states.items():
                if skip:
                    put((a, b), score - (DROP_MARK if ch in LOOKS_LIKE else SEPARATOR), out)
                for cost, x, c in moves:
                    if b and c == b and out[1] == x:
                        put((a, b), score - REPEAT * (cost == 0 and not third), out)
                    put((b, c), score - cost - KEEP_RUN * (third and cost == 0) + float(p[a, b, c]), (out, x))
            states = new or states
        _, out = max(((v[0] + float(p[a, b, 0]) * bool(b or gaps is None), v[1]) for (a, b), v in states.items()), key=lambda v: v[0])
        letters = []
        while out:
            out, x = out
            letters.append(x)
        return "".join(reversed(letters)).strip()

    def word(self, raw: str) -> str:
        """One white-space token, lower case, restored; '' if no letters are left."""
        core = raw.strip(_EDGE)
        if core.isalpha() and not (len(core) > 3 and _ODD.search(core)) and raw[:1] not in "@$!|(<*#":
            return core
        lead = raw.lstrip("\"'[]{}-_").rstrip(_EDGE)
        if not _ODD.search(lead):
            return core
        return self.viterbi(lead)

    def words(self, text: str | None) -> list[str]:
        """The restored words of a text, in order; spaced-out words at the end."""
        tokens = (text or "").lower().split()
        if len(self.memo) > self.limit:
            self.memo.clear()
        memo, word = self.memo, self.word
        for t in set(tokens).difference(memo):
            memo[t] = word(t)
        out = [memo[t] for t in tokens]
        for m in _SPACED.finditer((text or "").lower()) if list(map(len, tokens)).count(1) >= 3 else ():
            joined = "".join(m.group().split())
            if sum(c.isalpha() or c in LOOKS_LIKE for c in joined) >= 3:
                out += self.viterbi(joined, [0, *map(len, _GAP.findall(m.group()))]).split()
        return out


def features(word: str) -> list[str]:
    """A word and its beginnings of three to nine letters."""
    n = len(word)
    return [word, *(word[:k] + "-" for k in range(3, min(n, 10)))] if n >= 3 else []


class Cues:
    """Cue weights (log-odds) by feature; a word's weight is that of its strongest feature."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights, self.memo = weights, {}

    def evidence(self, words: list[str]) -> float:
        """The sum of a document's three strongest cue words."""
        memo = self.memo
        if len(memo) > 50_000:
            memo.clear()
        hits = []
        for w in set(words):
            x = memo.get(w)
            if x is None:
                x = memo[w] = max((self.weights.get(f, 0.0) for f in features(w)), default=0.0)
            if x:
                hits.append(x)
        return sum(sorted(hits, reverse=True)[:3])


def _feature_counts(sample: DataFrame, log_p: np.ndarray) -> DataFrame:
    """sample(text, toxic, half) -> (feature, c0..c3): documents with it that are clean or toxic in half 0, then in half 1.

    Each task sums what it can hold before the shuffle.
    """
    names = ["feature", "c0", "c1", "c2", "c3"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(log_p)
        held = [Counter() for _ in range(4)]

        def flush() -> pa.RecordBatch:
            found = list(set().union(*held))
            out = pa.RecordBatch.from_arrays([pa.array(found, pa.string()), *(pa.array([c[f] for f in found], pa.int64()) for c in held)], names=names)
            for c in held:
                c.clear()
            return out

        for b in batches:
            for t, y, half in zip(*(b.column(c).to_pylist() for c in ("text", "toxic", "half"))):
                held[2 * half + y].update({f for w in set(decoder.words(t)) for f in features(w)})
                if sum(map(len, held)) > 200_000:
                    yield flush()
        yield flush()

    rows = sample.select("text", "toxic", "half").mapInArrow(run, "feature string, c0 long, c1 long, c2 long, c3 long")
    return rows.groupBy("feature").agg(*[F.sum(c).alias(c) for c in names[1:]])


class Model:
    """What scoring needs: the character model, the cues and the evidence that scores THRESHOLD."""

    def __init__(self, log_p: np.ndarray, cues: dict[str, float], level: float) -> None:
        self.log_p, self.cues, self.level = log_p, cues, level

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(self.level - evidence) * (1 - THRESHOLD) / THRESHOLD)


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> Model:
    """labels(doc_id, toxic), learning folds only. The character model covers all docs."""
    log_p = char_model.log_probabilities(char_model.trigram_counts(docs))
    y = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    n = y.count()
    share = 1.0 if n <= max_labelled else max_labelled / n
    y = y.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
    # the labels are about max_labelled rows now, so they can be broadcast: no text but theirs moves
    rows = docs.select("doc_id", "text").join(F.broadcast(y), "doc_id").withColumn("t", F.xxhash64("text"))
    rows = common.stage(spark, rows, "labelled")
    once = rows.groupBy("t", "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    sample = rows.join(once, "doc_id", "left_semi").select("text", "toxic", F.pmod("t", F.lit(2)).cast("int").alias("half"))
    sample = common.stage(spark, sample.repartition(max(1, spark.sparkContext.defaultParallelism)), "sample")
    size = {(r["half"], r["toxic"]): r["c"] for r in sample.groupBy("half", "toxic").agg(F.count(F.lit(1)).alias("c")).collect()}
    counts = _feature_counts(sample, log_p)

    def stands_out(half: int) -> Column:
        """Enough toxic documents of the half use it, and nine in ten of its documents are toxic if both kinds were as many."""
        good, bad = F.col(f"c{2 * half}"), F.col(f"c{2 * half + 1}")
        g, b = size.get((half, 0), 0), size.get((half, 1), 0)
        if not g or not b:
            return F.lit(False)
        return (bad >= 2) & (bad / b >= 0.9 * (bad / b + (good + 1) / g)) & (bad >= good)

    def weight(good: Column, bad: Column) -> Column:
        p, n = (bad + 0.5) / (good + bad + 1), good + bad + 1
        return p - F.sqrt(p * (1 - p) / n)

    a, b = stands_out(0), stands_out(1)
    w = (
        F.when(a & b, weight(F.col("c0") + F.col("c2"), F.col("c1") + F.col("c3")))
        .when(a, weight(F.col("c2"), F.col("c3"))).when(b, weight(F.col("c0"), F.col("c1")))
    )
    # as many rows as the words of the sample's toxic documents at most
    found = counts.select("feature", w.alias("w")).filter(F.col("w") >= LEAST_WEIGHT).collect()
    model = Model(log_p, {r["feature"]: math.log(r["w"] / (1 - r["w"])) for r in found}, 1.0)
    judged = _evidence(
        sample.select("text", "toxic"), model, "toxic int, evidence double",
        lambda b, x: pa.RecordBatch.from_arrays([b.column("toxic").cast(pa.int32()), pa.array(x, pa.float64())], names=["toxic", "evidence"]),
    ).toPandas()
    model.level = best_level(judged["evidence"].to_numpy(np.float64), judged["toxic"].to_numpy(np.int64))
    return model


def best_level(evidence: np.ndarray, toxic: np.ndarray, least: float = 1.0) -> float:
    """The level (least or more) with the fewest errors at or above it and below it, a clean document counting CLEAN_COST times.

    It lies between two values that occur; of equally good places the middle one of the lowest run is taken.
    """
    order = np.argsort(evidence, kind="stable")
    e, y = evidence[order], toxic[order]
    cuts = np.unique(np.concatenate(([least], e[e > least])))
    below = np.searchsorted(e, cuts, side="left")
    missed = np.concatenate(([0], np.cumsum(y)))[below]
    hurt = (1 - y).sum() - np.concatenate(([0], np.cumsum(1 - y)))[below]
    k = int(np.argmin(missed + CLEAN_COST * hurt))
    return float(max(least, (cuts[k] + cuts[k - 1]) / 2)) if k else least


def _evidence(docs: DataFrame, model: Model, schema, finish: Callable) -> DataFrame:
    """Runs finish(batch, evidence of its texts) on each batch of docs (with a text column, or one struct 'row' that has it)."""
    log_p, weights = model.log_p, model.cues

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, cues = Decoder(log_p), Cues(weights)
        for b in batches:
            column = b.column("row").field("text") if "row" in b.schema.names else b.column("text")
            yield finish(b, [cues.evidence(decoder.words(t)) for _, _, texts in runs(column) for t in texts])

    return docs.mapInArrow(run, schema)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text) -> doc_id, score."""
    return _evidence(docs.select("doc_id", "text"), model, "doc_id long, score double", lambda b, x: pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array([model.score(e) for e in x], pa.float64())], names=["doc_id", "score"]))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns."""
    rows = docs.select(common.whole_row(docs).alias("row"))
    return _evidence(rows, model, rows.schema, lambda b, x: b.filter(pa.array([model.score(e) < threshold for e in x], pa.bool_()))).select("row.*")


def learning_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.table(spark, sf_dir, "labels").filter(~common.held_out("doc_id"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = score(docs, fit(spark, docs, learning_labels(spark, sf_dir)))
    return found.select("doc_id", common.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


SQL: dict[str, str] = {}
QUERIES = {"op1_toxicity": op1_toxicity}
