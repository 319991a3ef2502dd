"""Quality-control metrics, filters and the recorded transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cytofold.frame import CountFrame


def qc_tables(cf: CountFrame, mito_prefix: str | None = "MT-") -> tuple[DataFrame, DataFrame]:
    """(per cell, per gene): counts and totals of the kept matrix; empty cells and genes have zeros.

    mito_prefix is matched in any case; empty or None matches nothing.
    """
    x = cf.kept()
    mito = F.upper(cf.name_column()).startswith(mito_prefix.upper()) if mito_prefix else F.lit(False)
    marked = cf.var.select("gene_id", F.coalesce(mito, F.lit(False)).alias("_mt"))
    cells = x.join(marked, "gene_id").groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"), F.sum("count").alias("t"), F.sum(F.when(F.col("_mt"), F.col("count")).otherwise(0.0)).alias("m"))
    cells = cf.obs.select("cell_id").join(cells, "cell_id", "left").select("cell_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_genes_by_counts"), F.coalesce("t", F.lit(0.0)).alias("total_counts"), F.when(F.col("t") > 0, 100 * F.col("m") / F.col("t")).otherwise(0.0).alias("pct_counts_mt"))
    genes = x.groupBy("gene_id").agg(F.count(F.lit(1)).alias("n"), F.sum("count").alias("t"))
    genes = cf.var.select("gene_id").join(genes, "gene_id", "left").select("gene_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_cells_by_counts"), F.coalesce("t", F.lit(0.0)).alias("total_counts"))
    return cells, genes


def calculate_qc_metrics(cf: CountFrame, mito_prefix: str | None = "MT-", inplace: bool = True):
    """Adds the metrics to obs and var and returns nothing, or returns the two tables."""
    cells, genes = qc_tables(cf, mito_prefix)
    if not inplace:
        return cells, genes
    cf.obs = cf.obs.drop(*cells.columns[1:]).join(cells, "cell_id")
    cf.var = cf.var.drop(*genes.columns[1:]).join(genes, "gene_id")
    return None


def _within(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    for c, (lo, hi) in bounds.items():
        if lo is not None:
            df = df.where(F.col(c) >= lo)
        if hi is not None:
            df = df.where(F.col(c) <= hi)
    return df


def filter_cells(cf: CountFrame, min_genes=None, min_counts=None, max_genes=None, max_counts=None, max_pct_mt=None, mito_prefix: str | None = "MT-") -> CountFrame:
    """Cells within the bounds, ends included, by metrics of the matrix as it is now."""
    cells, _ = qc_tables(cf, mito_prefix)
    return cf.keep(cells=_within(cells, {"n_genes_by_counts": (min_genes, max_genes), "total_counts": (min_counts, max_counts), "pct_counts_mt": (None, max_pct_mt)}))


def filter_genes(cf: CountFrame, min_cells=None, min_counts=None, max_cells=None, max_counts=None) -> CountFrame:
    _, genes = qc_tables(cf, None)
    return cf.keep(genes=_within(genes, {"n_cells_by_counts": (min_cells, max_cells), "total_counts": (min_counts, max_counts)}))


def normalize_total(cf: CountFrame, target_sum: float = 1e4) -> CountFrame:
    if not target_sum > 0:
        raise ValueError("target_sum has to be positive")
    cf.record("normalize_total", float(target_sum))
    return cf


def log1p(cf: CountFrame) -> CountFrame:
    cf.record("log1p")
    return cf


def scale(cf: CountFrame, max_value: float | None = 10) -> CountFrame:
    """Records that principal components are of scaled genes; 0 or None: no clip."""
    cf.uns["scale"] = {"max_value": max_value or None}
    return cf


def gene_stats(cf: CountFrame) -> DataFrame:
    """Per gene of the transformed matrix: sums of x, x^2, expm1 x and (expm1 x)^2, and the non-zeros. Genes without any have zeros."""
    x = cf.matrix().withColumn("e", F.expm1("value"))
    got = x.groupBy("gene_id").agg(F.sum("value").alias("s1"), F.sum(F.col("value") * F.col("value")).alias("s2"), F.sum("e").alias("e1"), F.sum(F.col("e") * F.col("e")).alias("e2"), F.count(F.lit(1)).alias("nnz"))
    return cf.var.select("gene_id").join(got, "gene_id", "left").na.fill(0.0, ["s1", "s2", "e1", "e2"]).na.fill(0, ["nnz"])


def group_moments(cf: CountFrame, labels: DataFrame, clip: DataFrame | None = None, transform: bool = True) -> DataFrame:
    """(group, gene_id, s1, s2, nnz) over the cells that `labels` (cell_id, group) names; clip (group, gene_id, clip) caps values."""
    x = cf.with_cells(cf.matrix(transform), labels.select("cell_id", "group"))
    if clip is not None:
        x = x.join(clip, ["group", "gene_id"]).withColumn("value", F.least("value", "clip"))
    return x.groupBy("group", "gene_id").agg(F.sum("value").alias("s1"), F.sum(F.col("value") * F.col("value")).alias("s2"), F.count(F.lit(1)).alias("nnz"))


def weighted_row_sums(cf: CountFrame, weights: DataFrame, name: str = "weighted") -> DataFrame:
    """Per kept cell the sum of weight times transformed value; weights is (gene_id, weight)."""
    got = cf.matrix().join(weights.select("gene_id", "weight"), "gene_id").groupBy("cell_id").agg(F.sum(F.col("value") * F.col("weight")).alias(name))
    return cf.obs.select("cell_id").join(got, "cell_id", "left").na.fill(0.0, [name])
