"""Document quality by weak supervision (DataFrame functions only).

Each rule reads whole-text counts and votes good (1), bad (-1) or abstains (0): bad where its measure is
beyond one bound, good where it is well within another. Rules overlap on purpose (symbols, letters and word
lengths see the same markup; shouting shows in capitals, marks and sentence ends), so that they can confirm or
overrule each other. Votes fall into a bounded number of patterns (3 ** number of rules); one aggregate counts
them over all documents, and expectation-maximisation over those counts estimates the share of good documents
and, for each rule, how often it votes bad, abstains or votes good on good and on bad documents. The posterior
probability that a document is good replaces the rule that all filters must pass: a vote by a rule that
often errs is outvoted, one by a rule that never does is enough.

Repeated 3-word windows are counted within a row and without a shuffle: each window's 64-bit hash
shares a long with its position, the longs are sorted as primitives, and neighbours with equal hashes
whose words are equal too mark their positions. Where neighbours with equal hash bits hold different words (in
texts of many millions of words), that text's windows are sorted by their words instead, so the count is exact
at any length.

Defined cases: a null text is the empty text; a text without words has all counts 0 and fails the
base rule; texts of any length are read whole; a posterior equal to the threshold keeps; repeated rows are judged
alike, one row each; an empty table gives an empty result; columns other than doc_id and text are ignored
by ``judge`` and kept by ``keep_good``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bang", "n_stop", "n_letters", "n_distinct")
#: What EM starts from: how often a rule votes bad, abstains, votes good, on bad and on good documents; and its weight in documents.
START, WEIGHT = ((0.30, 0.10, 0.60), (0.02, 0.10, 0.88)), 20.0
#: No rate is taken to be below this: a rule may always err.
LEAST_RATE = 0.005


def _without(pattern: str) -> Column:
    """Characters of the text that the pattern's matches hold."""
    return F.length("__t") - F.length(F.regexp_replace("__t", pattern, ""))


def _covered(positions: Column) -> Column:
    """Words in 3-word windows that begin at the ascending positions."""
    start = F.struct(F.lit(-3).alias("prev"), F.lit(0).alias("total"))
    return F.aggregate(
        positions, start, lambda acc, p: F.struct(p.alias("prev"), (acc["total"] + F.least(F.lit(3), p - acc["prev"])).alias("total")), lambda acc: acc["total"]
    )


def _repeat_words(words: Column) -> tuple[Column, ...]:
    """Words in 3-word windows that occur twice or more, first ones included. Expects __h, the windows' hashes."""
    mask = F.expr("shiftleft(1L, length(bin(n_words))) - 1")
    packed = F.sort_array(F.transform("__h", lambda x, i: x.bitwiseAND(F.bitwise_not(F.col("__mask"))).bitwiseOR(i.cast("long"))))
    at = lambda x: x.bitwiseAND(F.col("__mask")).cast("int")
    same_words = lambda a, b: ((F.get(words, a) == F.get(words, b)) & (F.get(words, a + 1) == F.get(words, b + 1)) & (F.get(words, a + 2) == F.get(words, b + 2)))
    same_bits = lambda x, y: F.coalesce((x.bitwiseXOR(y) <= F.col("__mask")) & (x.bitwiseXOR(y) >= 0), F.lit(False))
    same = lambda x, y: same_bits(x, y) & same_words(at(x), at(y))
    marked = F.filter("__sorted", lambda x, i: same(x, F.get("__sorted", i + 1)) | same(x, F.get("__sorted", i - 1)))
    mixed = F.size(F.filter("__sorted", lambda x, i: same_bits(x, F.get("__sorted", i + 1)) & ~same_words(at(x), at(F.get("__sorted", i + 1))))) > 0
    windows = F.sort_array(F.transform("__h", lambda x, i: F.struct(F.concat_ws(" ", F.slice(words, i + 1, F.lit(3))).alias("w"), i.alias("i"))))
    equal = lambda x, y: F.coalesce(x["w"] == y["w"], F.lit(False))
    by_words = F.transform(F.filter("__windows", lambda x, i: equal(x, F.get("__windows", i + 1)) | equal(x, F.get("__windows", i - 1))), lambda x: x["i"])
    positions = F.sort_array(F.when(F.col("__mixed"), by_words).otherwise(F.transform("__marked", at)))
    return mask, packed, marked, mixed, F.when(F.col("__mixed"), windows), positions, _covered(F.col("__positions"))


def counts(docs: DataFrame, window_hash: Callable[..., Column] = F.xxhash64) -> DataFrame:
    """docs with one long column per name in COUNTS added (existing columns of these names are replaced)."""
    w = F.col("__w")
    df = docs.withColumn("__t", F.coalesce(F.col("text"), F.lit("")))
    trimmed = F.btrim("__t", F.lit(common.WS_CHARS))
    df = df.withColumn("__trim", trimmed).withColumn("__w", F.when(F.col("__trim") == "", F.array().cast("array<string>")).otherwise(F.split("__trim", common.WS)))
    df = df.withColumn("n_words", F.size("__w").cast("long"))
    hashes = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: window_hash(x, F.get(w, i + 1), F.get(w, i + 2)))
    df = df.withColumn("__h", hashes).withColumn("n_distinct", F.size(F.array_distinct("__h")).cast("long"))
    df = df.withColumn("__h", F.when(F.col("n_distinct") < F.size("__h"), F.col("__h")).otherwise(F.array().cast("array<bigint>")))
    *steps, covered = _repeat_words(w)
    for name, c in zip(("__mask", "__sorted", "__marked", "__mixed", "__windows", "__positions"), steps):
        df = df.withColumn(name, c)
    lines = F.filter(F.split("__t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("__l", lines)
    added = {
        "n_repeat_words": covered,
        "word_chars": F.length(F.regexp_replace("__t", common.WS, "")),
        "n_symbols": _without(r"[#*$%&|<>]+"),
        "n_lines": F.size("__l"),
        "n_dup_lines": F.size("__l") - F.size(F.array_distinct("__l")),
        "n_upper": _without(r"[A-ZÀ-ÖØ-Þ]+"),
        "n_bang": _without(r"!+"),
        "n_stop": _without(r"[.!?]+"),
        "n_letters": _without(r"\p{L}+"),
    }
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in COUNTS]
    return df.select(*keep, "n_words", "n_distinct", *[c.cast("long").alias(n) for n, c in added.items()])


def votes() -> list[Column]:
    """The rules: 1 good, -1 bad, 0 abstains; all from ratios of whole-text counts."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    windows = F.greatest(F.col("n_words") - 2, F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    symbols, repeats, bangs, stops = (F.col(c) / n for c in ("n_symbols", "n_repeat_words", "n_bang", "n_stop"))
    letters, upper, mean = F.col("n_letters") / chars, F.col("n_upper") / chars, chars / n
    copied, distinct = F.col("n_dup_lines") / lines, F.col("n_distinct") / windows
    vote = lambda bad, good: F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))
    long_ = F.col("n_words") >= 30
    return [
        vote(symbols > 0.1, symbols < 0.02),
        vote(letters < 0.9, letters > 0.93),
        vote(repeats > 0.45, repeats < 0.2),
        F.when(long_, vote(distinct < 0.5, distinct > 0.8)).otherwise(F.lit(0)),
        F.when(F.col("n_lines") >= 3, vote(copied > 0.4, copied < 0.1)).otherwise(F.lit(0)),
        vote(upper > 0.3, upper < 0.1),
        vote(bangs > 0.3, bangs < 0.1),
        vote((stops > 1) | (long_ & (stops < 0.01)), (stops >= 0.02) & (stops < 0.5)),
        vote((mean < 4.35) | (mean > 7), (mean >= 4.5) & (mean <= 6.5)),
    ]


def pattern() -> Column:
    """All votes as one number in base 3."""
    out = F.lit(0)
    for v in votes():
        out = out * 3 + (v + 1)
    return out.cast("int")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


class Fit(NamedTuple):
    """What EM has estimated: the share of good documents, each rule's rates (by class, then vote), each pattern's posterior."""

    balance: float
    rates: list[list[list[float]]]
    posterior: dict[int, float]


def fit(tally: dict[int, int], n_rules: int, rounds: int = 500) -> Fit:
    """EM over pattern counts: two classes, in which the rules vote independently of each other.

    The rates start at START, which also counts as WEIGHT documents, so that tables without documents of one class
    teach nothing about it. A rule that would vote bad more often on good documents than on bad ones says nothing by
    that vote.
    """
    votes_of = {p: [(p // 3 ** (n_rules - 1 - r)) % 3 for r in range(n_rules)] for p in tally}
    rates, balance = [[list(x) for x in START] for _ in range(n_rules)], 0.5
    total, post = sum(tally.values()), {}
    for _ in range(rounds):
        logs = [[math.log(good / bad) for bad, good in zip(*r)] for r in rates]
        odds = math.log(balance / (1 - balance))
        new = {p: 1 / (1 + math.exp(-max(-700.0, min(700.0, odds + sum(x[k] for x, k in zip(logs, v)))))) for p, v in votes_of.items()}
        done = bool(post) and max(abs(new[p] - post[p]) for p in post) < 1e-9
        post = new
        if done or not post:
            break
        for r in range(n_rules):
            for good in (0, 1):
                held = [WEIGHT * x for x in START[good]]
                for p, c in tally.items():
                    held[votes_of[p][r]] += c * (post[p] if good else 1 - post[p])
                held = [max(LEAST_RATE, x / sum(held)) for x in held]
                rates[r][good] = [x / sum(held) for x in held]
            bad, good = rates[r]
            if good[0] > bad[0]:
                bad[0] = good[0] = (bad[0] + good[0]) / 2
        balance = (sum(c * post[p] for p, c in tally.items()) + WEIGHT / 2) / (total + WEIGHT)
    return Fit(balance, rates, post)


def _kept(scored: DataFrame, threshold: float) -> Column:
    """scored has __pattern and the base counts. At most 3 ** rules patterns reach the driver."""
    tally = {r["__pattern"]: r["c"] for r in scored.groupBy("__pattern").agg(F.count(F.lit(1)).alias("c")).collect()}
    good = [p for p, x in fit(tally, len(votes())).posterior.items() if x >= threshold]
    return ~base_failed() & F.col("__pattern").isin(good)


def judge(spark: SparkSession, docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed and kept."""
    scored = common.stage(spark, counts(docs.select("doc_id", "text")).withColumn("__pattern", pattern()).drop("text"), "rule-counts")
    return scored.select("doc_id", *COUNTS[:5], base_failed().alias("base_failed"), _kept(scored, threshold).alias("kept"))


def keep_good(spark: SparkSession, docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that are kept, with their columns."""
    slim = docs.select(common.whole_row(docs).alias("__row"), "text")
    scored = common.stage(spark, counts(slim).withColumn("__pattern", pattern()).drop("text"), "rule-rows")
    return scored.filter(_kept(scored, threshold)).select("__row.*")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark, common.table(spark, sf_dir, "documents"))


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op5 counts and decides before any vote, which SQL can state."""
    rows = counts(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", *COUNTS[:5], base_failed().alias("base_failed"))


SQL = {
    "quality_base_counts": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(w[1:len(w) - 2]) AS a, unnest(w[2:len(w) - 1]) AS b, unnest(w[3:]) AS c FROM w WHERE len(w) > 2),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM c WHERE n > 1) GROUP BY doc_id),
s AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s"""
}
QUERIES = {"op5_quality_rules": op5_quality_rules, "quality_base_counts": quality_base_counts}
