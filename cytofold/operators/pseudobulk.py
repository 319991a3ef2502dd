"""Sums of raw counts over samples."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cytofold.frame import CountFrame


@dataclass
class Pseudobulk:
    """counts (pseudobulk, gene_id, count), a row of obs per sample, and the genes' names."""

    counts: DataFrame
    obs: DataFrame
    var: DataFrame

    def subset(self, condition: Column | str) -> Pseudobulk:
        obs = self.obs.where(condition)
        return Pseudobulk(self.counts.join(obs.select("pseudobulk"), "pseudobulk", "left_semi"), obs, self.var)

    def to_pandas(self) -> tuple[pd.DataFrame, pd.DataFrame]:
        """(samples x genes, obs) on the driver, samples by name; samples are few."""
        obs = self.obs.orderBy("pseudobulk").toPandas()
        long = self.counts.toPandas()
        genes = [r[0] for r in self.var.orderBy("gene_id").select("gene_id").collect()]
        wide = long.pivot(index="pseudobulk", columns="gene_id", values="count").reindex(index=obs["pseudobulk"], columns=genes).fillna(0.0)
        return wide, obs

    def to_anndata(self):
        import anndata

        wide, obs = self.to_pandas()
        return anndata.AnnData(wide.to_numpy(), obs=obs.set_index("pseudobulk"), var=pd.DataFrame(index=[str(g) for g in wide.columns]))


def group_gene_totals(cf: CountFrame, labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, gene_id, count): sums of raw counts; transforms don't matter."""
    return cf.with_cells(cf.kept(), labels.select("cell_id", *keys)).groupBy(*keys, "gene_id").agg(F.sum("count").alias("count"))


def pseudobulk(cf: CountFrame, sample_key: str | Sequence[str], groupby: str | Sequence[str] | None = None, min_cells: int = 10) -> Pseudobulk:
    """Samples are the combinations of the keys that at least min_cells cells have; cells with a null key are left out.

    Columns of obs that are constant within every combination, null being a value of its own, come along; that is judged before samples are dropped.
    """
    keys = list(dict.fromkeys([*([sample_key] if isinstance(sample_key, str) else sample_key), *([] if groupby is None else [groupby] if isinstance(groupby, str) else groupby)]))
    own = cf.obs.dropna(subset=keys)
    others = [c for c in cf.obs.columns if c not in (*keys, "cell_id")]
    seen = [F.count_distinct(F.struct(F.col(c))).alias(f"d_{i}") for i, c in enumerate(others)]
    groups = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cells"), *seen, *[F.first(c).alias(f"v_{i}") for i, c in enumerate(others)])
    most = groups.agg(*[F.max(f"d_{i}").alias(f"d_{i}") for i in range(len(others))]).first() if others else None
    constant = [i for i in range(len(others)) if most[f"d_{i}"] == 1]
    name = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    obs = groups.where(F.col("n_cells") >= min_cells).select(*keys, "n_cells", *[F.col(f"v_{i}").alias(others[i]) for i in constant], name.alias("pseudobulk")).orderBy(*keys)
    counts = group_gene_totals(cf, own, keys).join(obs.select(*keys, "pseudobulk"), keys).select("pseudobulk", "gene_id", "count")
    return Pseudobulk(counts, obs, cf.var.select("gene_id", cf.name_column().alias("gene_name")))


def size_factors(counts: DataFrame, kind: str = "ratio") -> DataFrame:
    """(pseudobulk, size_factor): the median over genes of a sample's count against the gene's geometric mean.

    ratio uses genes that every sample has; poscounts takes the mean over the samples that have it, as of all.
    """
    n = counts.agg(F.count_distinct("pseudobulk").alias("n"))
    log = F.log("count")
    # a gene's samples, which are few, go along with its mean, so that counts aren't joined with themselves
    genes = counts.where("count > 0").groupBy("gene_id").agg(F.sum(log).alias("s"), F.count(F.lit(1)).alias("k"), F.collect_list(F.struct("pseudobulk", log.alias("log"))).alias("own")).crossJoin(F.broadcast(n))
    genes = genes.where("k = n") if kind == "ratio" else genes
    ratios = genes.select((F.col("s") / F.col("n")).alias("m"), F.explode("own").alias("x")).select(F.col("x.pseudobulk").alias("pseudobulk"), (F.col("x.log") - F.col("m")).alias("r"))
    sf = ratios.groupBy("pseudobulk").agg(F.exp(F.percentile("r", F.lit(0.5))).alias("size_factor"))
    if kind == "poscounts":
        mean = sf.agg(F.exp(F.avg(F.log("size_factor"))).alias("g"))
        sf = sf.crossJoin(F.broadcast(mean)).select("pseudobulk", (F.col("size_factor") / F.col("g")).alias("size_factor"))
    return sf


def gene_arrays(pb: Pseudobulk) -> tuple[DataFrame, list[str]]:
    """(gene_id, counts array<double>) with samples in order of name, and the names. Genes without counts have zeros."""
    names = [r[0] for r in pb.obs.select("pseudobulk").orderBy("pseudobulk").collect()]
    at = F.create_map(*[x for i, s in enumerate(names) for x in (F.lit(s), F.lit(i))])
    rows = pb.counts.groupBy("gene_id").agg(F.map_from_entries(F.collect_list(F.struct(F.element_at(at, F.col("pseudobulk")), F.col("count")))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    zeros = F.array_repeat(F.lit(0.0), len(names))
    return pb.var.select("gene_id", "gene_name").join(rows, "gene_id", "left").select("gene_id", "gene_name", F.when(F.col("m").isNull(), zeros).otherwise(dense).alias("counts")), names


def array_size_factors(genes: DataFrame, m: int, kind: str = "ratio") -> np.ndarray:
    """size_factors() of the m samples in the arrays of gene_arrays(), as numbers here: a median a sample, by percentile()."""
    logs = F.transform("counts", lambda v: F.when(v > 0, F.log(v)).otherwise(0.0))
    total = F.aggregate(logs, F.lit(0.0), lambda t, v: t + v)
    if kind == "ratio":
        of = genes.where(F.forall("counts", lambda v: v > 0))
    else:
        of = genes.where(F.exists("counts", lambda v: v > 0))
    each = of.select((total / m).alias("mean"), F.posexplode("counts").alias("s", "v")).where("v > 0")
    got = {r["s"]: r["r"] for r in each.groupBy("s").agg(F.exp(F.percentile(F.log("v") - F.col("mean"), F.lit(0.5))).alias("r")).collect()}
    if kind == "ratio" and not got:
        raise ValueError("every gene has a zero; use size_factor_type='poscounts'")
    for s in range(m):
        if s not in got:
            raise ValueError(f"sample {s} has no counts to go by")
    sf = np.array([got[s] for s in range(m)])
    return sf if kind == "ratio" else sf / np.exp(np.log(sf).mean())


def wide(df: pd.DataFrame, column: str = "counts") -> np.ndarray:
    return np.array(df[column].tolist(), dtype=np.float64).reshape(len(df), -1)
