"""Quality rules under weak supervision: rules vote or abstain, EM weighs them, a posterior decides.

Every rule looks at one statistic of a text and votes good (1), bad (-1) or abstains (0). Votes are counted
by pattern (3 ** len(RULES) at most, whatever the number of texts). Rules that see the same fault vote
together, so votes are independent only among texts with the same fault: the model is a mixture of good
texts and of one kind of bad text for each rule. Expectation maximisation on the counts estimates the
kinds' shares and how often each rule votes bad in each kind, which gives the rules' accuracies; nothing
holds these numbers but START, worth BELIEF texts. Each fault is seen by two rules at least, so that
START decides little. The posterior probability of a good text is then one column expression over the
votes. No UDF runs anywhere.

Nulls and empty texts have no words and fail the base rule. Repeated rows get one result each, ties at
0.5 are kept, an empty table gives an empty result, extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored, white_words

WINDOW = 8
#: Statistic, good below or at, bad above or at.
RULES = (
    ("symbols_per_word", 0.05, 0.20),
    ("dup_line_share", 0.10, 0.40),
    ("repeat_share", 0.05, 0.25),
    ("capital_share", 0.15, 0.50),
    ("mean_word_off", 3.5, 7.0),
    ("commonest_off", 0.12, 0.30),
    ("odd_word_share", 0.10, 0.30),
)
#: Runs of marks, and marks that stand alone.
ODD_WORDS = r"[^\p{L}\p{N}\x09-\x0D\x20]{2,}|(?<![^\x09-\x0D\x20])[^\p{L}\p{N}\x09-\x0D\x20](?![^\x09-\x0D\x20])"
#: Share of good texts; how often a rule votes bad on good texts, on its own kind of bad text, and on other kinds.
START = (0.8, 0.02, 0.8, 0.1)
#: Texts' worth of belief in START; it keeps every probability above zero.
BELIEF, ROUNDS, SETTLED = 2.0, 500, 1e-9


def _covered(positions: Column, width: int) -> Column:
    """Words covered by windows of `width` at the ascending positions."""
    gaps = F.transform(F.sequence(F.lit(1), F.size(positions) - 1), lambda k: F.least(F.lit(width), F.get(positions, k) - F.get(positions, k - 1)))
    return F.when(F.size(positions) == 0, F.lit(0)).when(F.size(positions) == 1, F.lit(width)).otherwise(width + F.aggregate(gaps, F.lit(0), lambda a, x: a + x))


def measures(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and what the rules look at.

    Windows of eight words are compared by hash first; only texts in which two hashes agree compare the words."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = docs.select(F.col(key).alias("doc_id"), body.alias("body"), white_words(F.col(text)).alias("words"), lines.alias("lines"))
    starts = F.sequence(F.lit(1), F.size("words") - (WINDOW - 1))
    hashed = split.withColumn("hashes", F.when(F.size("words") > WINDOW, F.transform(starts, lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>")))
    again = F.size("hashes") > F.size(F.array_distinct("hashes"))
    window = F.transform(starts, lambda i: F.struct(F.array_join(F.slice("words", i, WINDOW), " ").alias("w"), i.alias("i")))
    keyed = hashed.withColumn("sorted", F.when(again, F.array_sort(window)))
    same = F.filter("sorted", lambda x, j: (x["w"] == F.get(F.col("sorted"), j - 1)["w"]) | (x["w"] == F.get(F.col("sorted"), j + 1)["w"]))
    # get() outside the array is null, which leaves the other side to decide
    found = keyed.withColumn("positions", F.when(F.col("sorted").isNotNull(), F.array_sort(F.transform(same, lambda x: x["i"]))))
    n = F.size("words")
    per = lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))
    counted = found.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("body", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_covered(F.col("positions"), WINDOW), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
        F.regexp_count("body", F.lit(r"\p{Lu}")).alias("n_capitals"),
        per(F.size(F.array_distinct("words"))).alias("distinct_share"),
        F.regexp_count("body", F.lit(ODD_WORDS)).alias("n_odd_words"),
    )
    return counted


def statistics(counted: DataFrame) -> DataFrame:
    """The statistics of RULES, beside the counts."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return counted.withColumns({
        "symbols_per_word": share("n_symbols", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "capital_share": share("n_capitals", "word_chars"),
        "odd_word_share": share("n_odd_words", "n_words"),
        "mean_word_off": F.abs(share("word_chars", "n_words") - F.lit(5.5)),
        # a text of n words has at most about 4 * n ** 0.85 words that differ, and far fewer if it stutters
        "commonest_off": F.greatest(F.lit(0.0), F.lit(0.45) - F.col("distinct_share") * F.pow(F.greatest("n_words", F.lit(1)) / 300.0, F.lit(0.25))),
    })


def votes() -> list[Column]:
    return [F.when(F.col(s) <= good, 1).when(F.col(s) >= bad, -1).otherwise(0).cast("int").alias(f"vote_{s}") for s, good, bad in RULES]


def expectation_maximisation(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray]:
    """(shares, bad) from counts by vote pattern: each kind's share of all texts, good ones first, and how often each rule
    that votes says bad in each kind. Abstaining says nothing."""
    good, alarm, own, other = START
    n = len(RULES)
    share0 = np.array([good] + [(1 - good) / n] * n)
    bad0 = np.vstack([np.full(n, alarm), np.where(np.eye(n) > 0, own, other)])
    share, bad = share0, bad0
    if not patterns:
        return share, bad
    votes_, count = np.array([p for p, _ in patterns]), np.array([c for _, c in patterns], float)
    says_bad, says = (votes_ < 0).astype(float), (votes_ != 0).astype(float)
    for _ in range(ROUNDS):
        weight = kinds(votes_, share, bad) * count[:, None]
        share, before = (weight.sum(0) + BELIEF * share0) / (count.sum() + BELIEF), share
        bad = (weight.T @ says_bad + BELIEF * bad0) / (weight.T @ says + BELIEF)
        if np.abs(share - before).max() < SETTLED:
            break
    return share, bad


def kinds(votes_: np.ndarray, share: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """patterns x kinds: the posterior of each kind."""
    log = np.log(share) + (votes_ < 0) @ np.log(bad).T + (votes_ > 0) @ np.log(1 - bad).T
    p = np.exp(log - log.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def accuracies(share: np.ndarray, bad: np.ndarray) -> list[tuple[float, float]]:
    """Of each rule: how often it votes bad on bad texts, and good on good ones."""
    of_bad = (share[1:] @ bad[1:]) / share[1:].sum()
    return [(float(b), float(1 - a)) for b, a in zip(of_bad, bad[0], strict=True)]


def posterior(share: np.ndarray, bad: np.ndarray) -> Column:
    """The probability of a good text, over the vote columns."""
    against = F.lit(0.0)
    for k in range(1, len(share)):
        z = F.lit(math.log(share[k] / share[0]))
        for r, (s, *_) in enumerate(RULES):
            vote = F.col(f"vote_{s}")
            z = z + F.when(vote < 0, math.log(bad[k, r] / bad[0, r])).when(vote > 0, math.log((1 - bad[k, r]) / (1 - bad[0, r]))).otherwise(0.0)
        against = against + F.exp(z)
    return 1 / (1 + against)


def quality_rules(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least_words: int = 20, most_repeat_percent: int = 30, threshold: float = 0.5) -> DataFrame:
    """The counts, votes, base_failed, posterior and kept of every row of docs.

    base_failed: fewer words than least_words, or more than most_repeat_percent of them in repeated windows.
    kept: not base_failed, and a posterior of threshold or more."""
    names = [f"vote_{s}" for s, *_ in RULES]
    voted = stored(statistics(measures(docs, key=key, text=text)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *votes()), "votes")
    # at most 3 ** len(RULES) rows come to the driver
    counts = [(tuple(r[n] for n in names), r["count"]) for r in voted.groupBy(*names).count().collect()]
    share, bad = expectation_maximisation(sorted(counts))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat_percent * F.col("n_words"))
    return voted.withColumns({"base_failed": failed, "posterior": posterior(share, bad)}).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
