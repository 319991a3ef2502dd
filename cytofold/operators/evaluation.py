"""How well neighbours, labels and batches agree: local inverse Simpson index, normalised mutual information, overlap of neighbour lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from cytofold.operators.community import contingency


def calibrated(d: np.ndarray, perplexity: float, rounds: int = 60) -> np.ndarray:
    """Weights exp(-b (d - least)) of rows of distances, each row adding up to 1, b being such that the row's entropy is log(perplexity).

    Entropy falls as b grows, so b is found by halving between bounds that are widened until they hold it. Rows that are too short, or whose distances are all equal, stay even.
    """
    goal, gap = np.log(perplexity), d - d.min(1, keepdims=True)

    def at(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = np.exp(-gap * b[:, None])
        w /= w.sum(1, keepdims=True)
        return w, -(w * np.log(np.maximum(w, 1e-300))).sum(1)

    lo, hi = np.zeros(len(d)), 1 / np.maximum(gap.mean(1), 1e-300)
    for _ in range(200):
        if not (wide := at(hi)[1] > goal).any() or not np.isfinite(hi * 2).all():
            break
        hi = np.where(wide, hi * 2, hi)
    even = (gap.max(1) == 0) | (d.shape[1] <= perplexity)
    for _ in range(rounds):
        mid = (lo + hi) / 2
        high = at(mid)[1] > goal
        lo, hi = np.where(high, mid, lo), np.where(high, hi, mid)
    return at(np.where(even, 0.0, (lo + hi) / 2))[0]


def lisi(knn: DataFrame, labels: DataFrame, name: str = "label", perplexity: float | None = None) -> DataFrame:
    """(i, lisi): the effective number of labels among the neighbours (i, j, dist) of each point, 1 if all have one.

    Weights fall with the distance at the perplexity given, else a third of the number of neighbours; the index is one over the sum of the squared shares of the labels (cell_id, name). A null label is one of its own. Points
    of one list stay together: labels are joined to the pairs, which are grouped once.
    """
    pairs = knn.select("i", "j", "dist").join(labels.select(F.col("cell_id").alias("j"), F.coalesce(F.col(name).cast("string"), F.lit("NA")).alias("l")), "j")
    rows = pairs.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("dist", "j", "l"))).alias("r")).select("i", F.col("r.dist").alias("d"), F.col("r.l").alias("l"))

    @F.pandas_udf("array<double>")
    def weigh(d: pd.Series) -> pd.Series:
        out: list = [None] * len(d)
        size = d.str.len().to_numpy()
        for s in np.unique(size):
            at = np.nonzero(size == s)[0]
            for i, w in zip(at, calibrated(np.array(d.iloc[at].tolist(), dtype=np.float64), perplexity or max(1.0, s / 3)), strict=True):
                out[i] = w
        return pd.Series(out)

    share = rows.select("i", F.explode(F.arrays_zip("l", weigh("d").alias("w"))).alias("e")).groupBy("i", F.col("e.l").alias("l")).agg(F.sum(F.col("e.w")).alias("p"))
    return share.groupBy("i").agg((1 / F.sum(F.col("p") * F.col("p"))).alias("lisi"))


def _entropy(n: Column, total: Column) -> Column:
    return -F.sum(n / total * F.log(n / total))


def normalized_mutual_information(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row, nmi: the mutual information of two labellings (cell_id, label) over the mean of their entropies; 1 where neither says anything. No common cells: no row."""
    t = contingency(a, b)
    total = t.agg(F.sum("n").alias("total")).where("total > 0")
    of = lambda c, name: t.groupBy(c).agg(F.sum("n").alias("n")).crossJoin(total).groupBy("total").agg(_entropy(F.col("n"), F.col("total")).alias(name))  # noqa: E731  total is one row
    joint = t.crossJoin(total).groupBy("total").agg(_entropy(F.col("n"), F.col("total")).alias("ab"))
    h = joint.join(of("a", "ha"), "total").join(of("b", "hb"), "total")
    mean = (F.col("ha") + F.col("hb")) / 2
    return h.select(F.when(mean > 0, F.greatest(F.lit(0.0), F.col("ha") + F.col("hb") - F.col("ab")) / mean).otherwise(1.0).alias("nmi"))


def knn_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, overlap): for each point of a, which share of its neighbours (i, j) in a are also its neighbours in b."""
    both = a.select("i", "j").distinct().join(b.select("i", "j", F.lit(1).alias("hit")).distinct(), ["i", "j"], "left")
    return both.groupBy("i").agg((F.count("hit") / F.count(F.lit(1))).alias("overlap"))


def auroc(scores: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row, auroc: the chance that a row of label 1 scores above one of label 0, ties counting half. Rows of null score or label don't count; null without both labels.

    Equal scores are combined first; ranks come from running sums within 64 ranges of scores, to which the sums of the ranges below are added.
    """
    by = scores.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("q"))
    cuts = by.agg(F.percentile_approx("s", [k / 64 for k in range(1, 64)], 1000)).first()[0] or []
    part = sum((F.when(F.col("s") > c, 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0))
    dealt = by.withColumn("part", part)
    sums = dealt.groupBy("part").agg(F.sum("q").alias("q"))
    before = sums.withColumn("off", F.coalesce(F.sum("q").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "off")
    w = Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = dealt.join(F.broadcast(before), "part").withColumn("below", F.col("off") + F.coalesce(F.sum("q").over(w), F.lit(0)))
    t = ranked.agg(F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)).alias("u"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    return t.select((F.col("u") / F.nullif(F.col("p").cast("double") * F.col("q"), F.lit(0.0))).alias("auroc"))
