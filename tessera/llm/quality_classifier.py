"""Quality classifier: a sparse rule ensemble, compiled into Spark column expressions.

Texts are described by a few statistics, all column expressions. On a bounded sample of labelled rows,
shallow boosted trees are grown over the statistics; every path from a root to a node is a conjunctive rule
(statistic above or below a threshold, and ...); a lasso logistic regression over all rules keeps the few
that matter. What is left is a sum of weighted conditions, which is one column expression for Spark: the
corpus is scored by code that it compiles, with no Python on any row.

The sample (`sample` rows of those not held out, by hash of the id) is the only thing that comes to the
driver. Null and empty texts have zero statistics and are scored like any other. Rows with no usable label
are not learnt from; without labels of both kinds every score is the share of good ones (1.0 if there are
none). Repeated rows get one result each, ties in splits go to the first statistic and lowest threshold,
an empty table gives an empty result, extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import held_out, white_words

SAMPLE, TREES, DEPTH, LEAF, SHRINK, BINS = 6000, 24, 3, 20, 0.3, 32
LASSO, STEPS = 0.004, 400


# ---------------------------------------------------------------- statistics


def statistics(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the whole row as a struct, and STATISTICS of every row of docs."""
    body = F.coalesce(F.col(text), F.lit(""))
    split = docs.select(F.struct("*").alias("row"), F.col(key).alias("doc_id"), body.alias("body"), white_words(F.col(text)).alias("words"))
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    chars = F.length("body")
    of = lambda pattern: F.regexp_count("body", F.lit(pattern)).cast("double")
    lines = F.split("body", "\n")
    counted = split.select(
        "row",
        "doc_id",
        n.cast("double").alias("n_words"),
        chars.cast("double").alias("n_chars"),
        distinct.cast("double").alias("n_distinct"),
        of(r"[#*$%&|<>]").alias("n_symbols"),
        of(r"\p{Lu}").alias("n_capitals"),
        of(r"[0-9]").alias("n_digits"),
        of(r"!").alias("n_exclamations"),
        of(r"[.,;:?]").alias("n_punctuation"),
        of(r"\|").alias("n_bars"),
        F.size(lines).cast("double").alias("n_lines"),
        F.size(F.array_distinct(lines)).cast("double").alias("n_distinct_lines"),
        (F.size(F.filter("words", lambda w, i: w == F.get(F.col("words"), i - 1)))).cast("double").alias("n_stutters"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return counted.select(
        "row",
        "doc_id",
        "n_words",
        share("n_chars", "n_words").alias("word_length"),
        share("n_distinct", "n_words").alias("distinct_share"),
        (share("n_distinct", "n_words") * F.pow(F.greatest("n_words", F.lit(1.0)) / 300.0, F.lit(0.25))).alias("richness"),
        share("n_symbols", "n_words").alias("symbols"),
        share("n_bars", "n_words").alias("bars"),
        share("n_capitals", "n_chars").alias("capitals"),
        share("n_digits", "n_chars").alias("digits"),
        share("n_exclamations", "n_words").alias("exclamations"),
        share("n_punctuation", "n_words").alias("punctuation"),
        (1.0 - share("n_distinct_lines", "n_lines")).alias("repeated_lines"),
        share("n_words", "n_lines").alias("line_words"),
        share("n_stutters", "n_words").alias("stutters"),
    )


STATISTICS = ("n_words", "word_length", "distinct_share", "richness", "symbols", "bars", "capitals", "digits", "exclamations", "punctuation", "repeated_lines", "line_words", "stutters")


# ---------------------------------------------------------------- rules


@dataclass(frozen=True, order=True)
class Condition:
    statistic: int
    above: bool
    value: float

    def on(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.statistic] > self.value if self.above else x[:, self.statistic] <= self.value

    def column(self) -> Column:
        c = F.col(STATISTICS[self.statistic])
        return c > self.value if self.above else c <= self.value


Rule = tuple[Condition, ...]


def simplified(path: Rule) -> Rule:
    """The path's tests, the tightest one of each statistic and direction."""
    kept: dict[tuple[int, bool], float] = {}
    for t in path:
        old = kept.get((t.statistic, t.above))
        kept[t.statistic, t.above] = t.value if old is None else max(old, t.value) if t.above else min(old, t.value)
    return tuple(sorted(Condition(s, a, v) for (s, a), v in kept.items()))


def grow(x: np.ndarray, cuts: list[np.ndarray], binned: np.ndarray, gradient: np.ndarray, curvature: np.ndarray, rows: np.ndarray, path: Rule, depth: int, out: list[Rule], score: np.ndarray) -> None:
    """A regression tree on the rows; its paths go to out, its values onto score."""
    best = None
    if depth and len(rows) >= 2 * LEAF:
        g, h = gradient[rows], curvature[rows]
        whole = g.sum() ** 2 / (h.sum() + 1)
        for s in range(x.shape[1]):
            b = binned[rows, s]
            gs, hs, ns = (np.cumsum(np.bincount(b, w, len(cuts[s]) + 1))[:-1] for w in (g, h, None))
            if not len(gs):
                continue
            gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - whole
            gain[(ns < LEAF) | (len(rows) - ns < LEAF)] = -1
            k = int(gain.argmax())
            if gain[k] > 1e-3 and (best is None or gain[k] > best[0] + 1e-9):
                best = gain[k], s, k
    if best is None:
        score[rows] += SHRINK * gradient[rows].sum() / (curvature[rows].sum() + 1)
        return
    _, s, k = best
    for above in (False, True):
        test = Condition(s, above, float(cuts[s][k]))
        own = rows[(binned[rows, s] > k) == above]
        out.append(simplified((*path, test)))
        grow(x, cuts, binned, gradient, curvature, own, (*path, test), depth - 1, out, score)


def tree_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """The distinct paths of boosted trees."""
    cuts = [np.unique(np.quantile(x[:, s], np.linspace(0.01, 0.99, BINS), method="nearest")) for s in range(x.shape[1])]
    # halfway to the next value: a threshold that equals a value is fragile
    cuts = [np.array([(c + (x[x[:, s] > c, s].min() if (x[:, s] > c).any() else c)) / 2 for c in cut]) for s, cut in enumerate(cuts)]
    binned = np.stack([np.searchsorted(c, x[:, s], "left") for s, c in enumerate(cuts)], axis=1)
    score, out, everything = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), [], np.arange(len(y))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        grow(x, cuts, binned, y - p, p * (1 - p), everything, (), DEPTH, out, score)
    return list(dict.fromkeys(out))


def lasso(z: np.ndarray, y: np.ndarray, penalty: float = LASSO, steps: int = STEPS) -> tuple[float, np.ndarray]:
    """Intercept and weights of a logistic regression with an L1 penalty, by accelerated proximal gradients."""
    n, m = z.shape
    design = np.concatenate((np.ones((n, 1)), z), axis=1)
    v = np.ones(m + 1)
    for _ in range(30):
        v = design.T @ (design @ v)
        v /= np.linalg.norm(v)
    step = 1 / (0.25 * np.linalg.norm(design @ v) ** 2 / n + 1e-9)
    w = np.zeros(m + 1)
    w[0] = np.log(y.mean() / (1 - y.mean()))
    ahead, t = w.copy(), 1.0
    for _ in range(steps):
        slope = design.T @ (1 / (1 + np.exp(-(design @ ahead))) - y) / n
        new = ahead - step * slope
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return float(w[0]), w[1:]


@dataclass(frozen=True)
class Ensemble:
    intercept: float
    rules: tuple[tuple[float, Rule], ...]

    def column(self) -> Column:
        """The score as an expression over STATISTICS."""
        z = F.lit(self.intercept)
        for weight, rule in self.rules:
            holds = rule[0].column()
            for test in rule[1:]:
                holds = holds & test.column()
            z = z + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-z))


def fit(x: np.ndarray, y: np.ndarray) -> Ensemble:
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 1.0
        return Ensemble(float(np.log((share + 1e-6) / (1 - share + 1e-6))), ())
    rules = tree_rules(x, y)
    if not rules:
        return Ensemble(float(np.log(y.mean() / (1 - y.mean()))), ())
    z = np.stack([np.logical_and.reduce([t.on(x) for t in r]) for r in rules], axis=1).astype(float)
    spread = np.maximum(z.std(0), 0.05)  # a rule's penalty shouldn't depend on how rare it is, within reason
    intercept, w = lasso(z / spread, y)
    kept = [(float(a), r) for a, r in zip(w / spread, rules, strict=True) if abs(a) > 1e-6]
    return Ensemble(intercept, tuple(kept))


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", label_key: str = "doc_id", sample: int = SAMPLE) -> Ensemble:
    """The rules learnt from at most `sample` labelled rows that are not held out."""
    usable = labels.select(F.col(label_key).alias("doc_id"), F.col(label).cast("double").alias("y")).where(F.col("y").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id").limit(sample)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    found = statistics(rows.join(F.broadcast(chosen.select("doc_id")), "doc_id")).join(F.broadcast(chosen), "doc_id")
    values = sorted(tuple(r) for r in found.select("doc_id", "y", *STATISTICS).collect())
    table = np.array(values, float).reshape(-1, 2 + len(STATISTICS))
    return fit(table[:, 2:], table[:, 1])


def quality_classifier(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", label_key: str = "doc_id", sample: int = SAMPLE, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    ensemble = train(docs, labels, key=key, text=text, label=label, label_key=label_key, sample=sample)
    scored = statistics(docs, key=key, text=text).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), ensemble.column().alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", label_key: str = "doc_id", sample: int = SAMPLE, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold."""
    ensemble = train(docs, labels, key=key, text=text, label=label, label_key=label_key, sample=sample)
    scored = statistics(docs, key=key, text=text).select("row", ensemble.column().alias("score"))
    # a filter on the score itself would be pushed below the statistics, and each of its conditions would compute them again
    return scored.select("row", F.explode(F.array("score")).alias("score")).where(F.col("score") >= threshold).select("row.*")
