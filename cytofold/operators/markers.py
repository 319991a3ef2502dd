"""Marker genes of groups of cells: Welch's t-test and Wilcoxon's rank-sum test against the rest, and gene-set scores."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from cytofold.frame import CountFrame, _local
from cytofold.functions.stats import bh, normal_p, t_p
from cytofold.operators.qc import gene_stats, weighted_row_sums


def natural(s: str) -> list:
    """A sort key by which digits count as numbers."""
    return [(0, int(x), "") if x.isdigit() else (1, 0, x) for x in re.split(r"(\d+)", s)]


def _labels(cf: CountFrame, groupby: str, groups: str | Sequence[str]) -> DataFrame:
    labels = cf.obs.select("cell_id", F.col(groupby).cast("string").alias("group")).where("group is not null")
    return labels if isinstance(groups, str) and groups == "all" else labels.where(F.col("group").isin(list(groups)))


def _grid(cf: CountFrame, labels: DataFrame, sums: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(group, gene_id, n1, n2, columns) for every group and gene, with zeros where sums (group, gene_id, columns) has no row."""
    sizes = labels.groupBy("group").agg(F.count(F.lit(1)).cast("double").alias("n1"))
    n_all = F.sum("n1").over(Window.partitionBy(F.lit(0)))
    grid = F.broadcast(sizes.withColumn("n2", n_all - F.col("n1")))
    t = cf.var.select("gene_id").crossJoin(grid).join(sums, ["group", "gene_id"], "left")
    return t.select("group", "gene_id", "n1", "n2", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in columns])


def _welch(t: DataFrame) -> DataFrame:
    """t (group, gene_id, n1, n2, s, q, ...) with means and variances of the group and of the other labelled cells."""
    gene = Window.partitionBy("gene_id")
    t = t.withColumns({"s_all": F.sum("s").over(gene), "q_all": F.sum("q").over(gene)})
    mean = lambda s, n: F.when(n > 0, s / F.nullif(n, F.lit(0.0))).otherwise(0.0)
    t = t.withColumns({"m1": mean(F.col("s"), F.col("n1")), "m2": mean(F.col("s_all") - F.col("s"), F.col("n2"))})
    var = lambda q, n, m: F.when(n > 1, F.greatest(F.lit(0.0), (q - n * m * m) / F.nullif(n - 1, F.lit(0.0)))).otherwise(0.0)
    return t.withColumns({"v1": var(F.col("q"), F.col("n1"), F.col("m1")), "v2": var(F.col("q_all") - F.col("q"), F.col("n2"), F.col("m2"))}).drop("s", "q", "s_all", "q_all")


def moments(cf: CountFrame, labels: DataFrame) -> DataFrame:
    """(group, gene_id, n1, n2, m1, m2, v1, v2) for every group and gene, the rest being the other labelled cells. One aggregate of the matrix."""
    x = cf.with_cells(cf.matrix(), labels).groupBy("group", "gene_id").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    return _welch(_grid(cf, labels, x, ["s", "q"]))


def fold_change(m1, m2):
    """log2 of the ratio of means on the count scale."""
    return F.log2((F.expm1(m1) + 1e-9) / (F.expm1(m2) + 1e-9))


def _stretch(v: Column) -> Column:
    """A whole number that never falls as the value rises: where its logarithm is, in steps of a 32nd."""
    size = F.floor(F.log2(F.abs(v)) * 32).cast("int") + 100_000
    return F.when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0))


def rank_table(cf: CountFrame, labels: DataFrame) -> DataFrame:
    """(group, gene_id, n1, n2, rank_sum, ties, s, q): sums of average ranks, t^3 - t over the tie blocks of the gene, zeros being one block in closed form, and sums of values and squares. One pass over the matrix.

    Equal values of a group are counted in slices of the cells, as many as the counts have partitions, so a value that most cells share is one row a slice and group. Counts are
    then dealt by gene and stretch of value and ranked there, so that a window holds the distinct values of one stretch, not of a whole gene; what all lower stretches of the gene
    hold is then added to a stretch's sums. Each exchange has as many partitions as the matrix asks for, not as the session has, as most values are distinct and nothing else bounds a task.
    """
    keys, n = ["gene_id", "b", "value", "group"], cf.parts or int(cf.obs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = cf.with_cells(cf.matrix(), labels).select("gene_id", "value", "group", _stretch(F.col("value")).alias("b"), F.pmod(F.xxhash64("cell_id"), F.lit(n)).cast("int").alias("slice"))
    counted = cf.dealt(x.repartitionById(n, "slice").groupBy("slice", *keys).agg(F.count(F.lit(1)).alias("k")), "gene_id", "b").groupBy(*keys).agg(F.sum("k").alias("k"))
    values = counted.groupBy("gene_id", "b", "value").agg(F.sum("k").alias("t"), F.collect_list(F.struct("group", "k")).alias("by"))
    upto = F.sum("t").over(Window.partitionBy("gene_id", "b").orderBy("value"))
    rows = values.withColumn("mid", upto - F.col("t") + (F.col("t") + 1) / 2).select("gene_id", "b", "value", "mid", F.col("t").cast("double").alias("t"), F.posexplode("by").alias("at", "e"))
    k = F.col("e.k")
    per = rows.groupBy("gene_id", "b", F.col("e.group").alias("group")).agg(
        F.sum(F.col("mid") * k).alias("r"),
        F.sum(k).cast("double").alias("nnz"),
        F.sum(F.when(F.col("at") == 0, F.col("t") * F.col("t") * F.col("t") - F.col("t")).otherwise(0.0)).alias("tt"),
        F.sum(F.col("value") * k).alias("s"),
        F.sum(F.col("value") * F.col("value") * k).alias("q"),
    )
    per = cf.dealt(per, "gene_id")
    before = F.coalesce(F.sum("nnz").over(Window.partitionBy("gene_id").orderBy("b").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    per = per.withColumn("r", F.col("r") + before * F.col("nnz")).groupBy("group", "gene_id").agg(*[F.sum(c).alias(c) for c in ("r", "nnz", "tt", "s", "q")])
    t = _grid(cf, labels, per, ["r", "nnz", "tt", "s", "q"])
    gene = Window.partitionBy("gene_id")
    zero = F.col("n1") + F.col("n2") - F.sum("nnz").over(gene)
    t = t.withColumns({"zero": zero, "tt": F.sum("tt").over(gene)})
    rank_sum = F.col("r") + F.col("nnz") * F.col("zero") + (F.col("n1") - F.col("nnz")) * (F.col("zero") + 1) / 2
    ties = F.col("tt") + F.col("zero") * F.col("zero") * F.col("zero") - F.col("zero")
    return t.select("group", "gene_id", "n1", "n2", rank_sum.alias("rank_sum"), ties.alias("ties"), "s", "q")


def rank_sums(cf: CountFrame, labels: DataFrame) -> DataFrame:
    """(group, gene_id, n1, n2, rank_sum, ties)."""
    return rank_table(cf, labels).drop("s", "q")


def scores(cf: CountFrame, groupby: str, method: str = "t-test", groups: str | Sequence[str] = "all", tie_correct: bool = False) -> DataFrame:
    """(group, gene_id, names, scores, logfoldchanges, pvals, pvals_adj) of every gene and group."""
    labels = _labels(cf, groupby, groups)
    if method not in ("t-test", "wilcoxon"):
        raise ValueError(f"unknown method {method!r}")
    t = moments(cf, labels) if method == "t-test" else _welch(rank_table(cf, labels))
    t = t.withColumn("logfoldchanges", fold_change(F.col("m1"), F.col("m2")))
    if method == "t-test":
        a, b = F.col("v1") / F.nullif(F.col("n1"), F.lit(0.0)), F.col("v2") / F.nullif(F.col("n2"), F.lit(0.0))
        t = t.withColumn("se2", a + b).withColumn("scores", (F.col("m1") - F.col("m2")) / F.nullif(F.sqrt("se2"), F.lit(0.0)))
        df = F.col("se2") ** 2 / F.nullif(a * a / F.nullif(F.col("n1") - 1, F.lit(0.0)) + b * b / F.nullif(F.col("n2") - 1, F.lit(0.0)), F.lit(0.0))
        t = t.withColumn("pvals", t_p(F.col("scores"), F.coalesce(df, F.lit(1.0))))
    else:
        n = F.col("n1") + F.col("n2")
        tie = 1 - F.col("ties") / F.nullif(n * n * n - n, F.lit(0.0)) if tie_correct else F.lit(1.0)
        t = t.withColumn("scores", (F.col("rank_sum") - F.col("n1") * (n + 1) / 2) / F.nullif(F.sqrt(tie * F.col("n1") * F.col("n2") * (n + 1) / 12), F.lit(0.0)))
        t = t.withColumn("pvals", normal_p(F.col("scores")))
    fine = lambda c, other: F.when(F.isnan(c), other).otherwise(F.coalesce(F.col(c), F.lit(other)))
    t = t.withColumn("scores", fine("scores", 0.0)).withColumn("pvals", fine("pvals", 1.0))
    t = bh(t, by=["group"], order=["gene_id"])
    return t.join(cf.var.select("gene_id", cf.name_column().alias("names")), "gene_id").select("group", "gene_id", "names", "scores", "logfoldchanges", "pvals", "pvals_adj")


def rank_genes_groups(cf: CountFrame, groupby: str, method: str = "t-test", groups: str | Sequence[str] = "all", n_genes: int | None = 100, tie_correct: bool = False) -> DataFrame:
    """The n_genes of highest score of each group; the whole table is kept in uns. Groups in natural order have group_order 0, 1, ..."""
    t = scores(cf, groupby, method, groups, tie_correct)
    found = sorted((r[0] for r in t.select("group").distinct().collect()), key=natural)
    order = F.element_at(F.create_map(*[x for i, g in enumerate(found) for x in (F.lit(g), F.lit(i))]), F.col("group")) if found else F.lit(0)
    t = t.withColumn("rank", F.row_number().over(Window.partitionBy("group").orderBy(F.desc("scores"), "gene_id"))).withColumn("group_order", order)
    top = t if n_genes is None else t.where(F.col("rank") <= n_genes)
    cf.uns["rank_genes_groups"] = {"table": top, "params": {"groupby": groupby, "method": method}}
    return top


def score_genes(cf: CountFrame, gene_list: Sequence[str], ctrl_size: int = 50, n_bins: int = 25, random_state: int = 0, score_name: str = "score", ctrl_as_ref: bool = True) -> CountFrame:
    """Adds to obs the mean of a gene set less the mean of controls drawn from genes of like mean expression, ctrl_size at most from each bin that the set is in.

    With ctrl_as_ref, the draw is from all genes of a bin, and those of the set are left out afterwards; without, before.
    """
    names = cf.var.select("gene_id", cf.name_column().alias("name"))
    means = gene_stats(cf).join(names, "gene_id").select("gene_id", "name", F.col("s1") / max(1, cf.n_obs)).toPandas()
    means.columns = ["gene_id", "name", "mean"]
    means = means.sort_values("gene_id", ignore_index=True)
    # of genes of one name the last counts
    own = (means["name"].isin(set(gene_list)) & ~means["name"].duplicated(keep="last")).to_numpy()
    if not own.any():
        raise ValueError("none of the genes is in var")
    width = round(len(means) / (n_bins - 1))
    if width < 1:
        raise ValueError(f"{len(means)} genes are too few for {n_bins} bins")
    bins = (means["mean"].rank(method="min") // width).to_numpy()
    draw, control = np.random.RandomState(random_state), set()
    for b in np.unique(bins[own]):
        pool = means["gene_id"].to_numpy()[(bins == b) & (ctrl_as_ref | ~own)]
        control.update((pool if len(pool) <= ctrl_size else pool[draw.choice(len(pool), ctrl_size, replace=False)]).tolist())
    control -= set(means["gene_id"][own].tolist())
    if not control:
        raise RuntimeError("no gene is left to be a control")
    return score_with(cf, means["gene_id"][own].tolist(), sorted(control), score_name)


def score_with(cf: CountFrame, genes: Sequence[int], control: Sequence[int], score_name: str = "score") -> CountFrame:
    """The same with given controls: both means are one weighted sum."""
    w = pd.concat([pd.DataFrame({"gene_id": list(genes), "weight": 1.0 / max(1, len(genes))}), pd.DataFrame({"gene_id": list(control), "weight": -1.0 / max(1, len(control))})])
    got = weighted_row_sums(cf, _local(cf.obs.sparkSession, w.astype({"gene_id": "int32"}), "gene_id int, weight double"), score_name)
    cf.obs = cf.obs.drop(score_name).join(got, "cell_id")
    return cf
