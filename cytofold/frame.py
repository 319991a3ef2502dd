"""The handle: a raw count matrix in long form, the tables beside it, and transforms that are recorded rather than done."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

NAMES = ("gene_name", "gene_symbols", "gene_ids")


def parts_for(spark: SparkSession, rows: int) -> int:
    """How many partitions keep each at half a million of so many rows; of few rows, as many as there are cores, if each then has 50,000."""
    return max(1, -(-rows // 500_000), min(spark.sparkContext.defaultParallelism, -(-rows // 50_000)))


@dataclass
class CountFrame:
    """Counts (cell_id, gene_id, count) with obs (a row per cell) and var (a row per gene).

    Raw counts never change. Filters make smaller obs or var; normalize_total and log1p are kept in ops. All of it is
    bound when matrix() builds a plan, so cell totals are those over the genes that are kept at that time. Embeddings are keyed by id, never by position.
    """

    store: DataFrame
    obs: DataFrame
    var: DataFrame
    obsm: dict[str, DataFrame] = field(default_factory=dict)
    varm: dict[str, DataFrame] = field(default_factory=dict)
    uns: dict[str, Any] = field(default_factory=dict)
    ops: tuple[tuple, ...] = ()
    #: Whether obs and var still hold every id of the store, so that no semi-join is needed.
    all_cells: bool = True
    all_genes: bool = True
    #: How many partitions the counts are dealt to, if that was set by their number.
    parts: int | None = None

    # --- construction -------------------------------------------------------------------------------------------

    @classmethod
    def from_triplets(cls, df: DataFrame, obs: DataFrame | None = None, var: DataFrame | None = None, n_cells: int | None = None, n_genes: int | None = None, cell_col: str = "cell_id", gene_col: str = "gene_id", value_col: str = "count", rows: int | None = None) -> CountFrame:
        """Wraps a long frame. Duplicate (cell, gene) rows are summed and zeros left out; missing obs or var are the ids from 0 to the largest in df.

        Rows are dealt by cell once, and sums, totals and joins by cell that follow keep that dealing; a cell has at most as many sums as there are genes.
        With `rows`, about how many df has, there are as many partitions as keep each at half a million; without, as many as the session shuffles to.
        """
        spark = df.sparkSession
        raw = df.select(F.col(cell_col).cast("long").alias("cell_id"), F.col(gene_col).cast("int").alias("gene_id"), F.col(value_col).cast("double").alias("count"))
        parts = None if rows is None else parts_for(spark, rows)
        store = (raw.repartition("cell_id") if parts is None else raw.repartition(parts, "cell_id")).groupBy("cell_id", "gene_id").agg(F.sum("count").alias("count")).where("count <> 0")

        def ids(given: DataFrame | None, n: int | None, key: str) -> DataFrame:
            if given is not None and key in given.columns:
                return given
            if given is not None:
                got = _numbered(given, key)
                if n is not None and got.count() != n:
                    raise ValueError(f"{key}: {n} rows are needed")
                return got
            if n is None:
                top = raw.agg(F.max(key)).first()[0]
                n = 0 if top is None else top + 1
            return spark.range(n).select(F.col("id").cast(dict(raw.dtypes)[key]).alias(key))

        return cls(store, ids(obs, n_cells, "cell_id"), ids(var, n_genes, "gene_id"), parts=parts)

    @classmethod
    def from_csr(cls, spark: SparkSession, indptr: Sequence[int], indices: Sequence[int], data: Sequence[float], n_genes: int, obs: DataFrame | None = None, var: DataFrame | None = None) -> CountFrame:
        """From the three arrays of a compressed sparse row matrix on the driver."""
        n = len(indptr) - 1
        pdf = pd.DataFrame({"cell_id": np.repeat(np.arange(n), np.diff(indptr)), "gene_id": np.asarray(indices, dtype=np.int32), "count": np.asarray(data, dtype=np.float64)})
        return cls.from_triplets(_local(spark, pdf, "cell_id long, gene_id int, count double"), obs, var, n, n_genes)

    @classmethod
    def from_scipy(cls, spark: SparkSession, x, obs: DataFrame | None = None, var: DataFrame | None = None) -> CountFrame:
        """From anything with indptr, indices, data and shape."""
        x = x.tocsr() if hasattr(x, "tocsr") else x
        return cls.from_csr(spark, x.indptr, x.indices, x.data, x.shape[1], obs, var)

    @classmethod
    def from_anndata(cls, spark: SparkSession, adata) -> CountFrame:
        """Counts, obs, var and obsm of an AnnData object; its other parts are left."""
        frame = lambda p, name, key: _local(spark, p.assign(**{c: p[c].astype(str) for c in p if str(p[c].dtype) == "category"}).rename_axis(name).reset_index().assign(**{key: np.arange(len(p))}))
        x = adata.X if hasattr(adata.X, "indptr") else _Csr(np.asarray(adata.X))
        out = cls.from_scipy(spark, x, frame(adata.obs, "barcode", "cell_id"), frame(adata.var, "gene_name", "gene_id"))
        for k, v in adata.obsm.items():
            out.obsm[k] = _local(spark, pd.DataFrame({"cell_id": np.arange(len(v)), "vec": list(np.asarray(v, dtype=np.float32))}), "cell_id long, vec array<float>")
        return out

    # --- size and names -----------------------------------------------------------------------------------------

    @property
    def n_obs(self) -> int:
        return self._counted("obs")

    @property
    def n_vars(self) -> int:
        return self._counted("var")

    def _counted(self, what: str) -> int:
        known = self.__dict__.setdefault("_sizes", {})
        df = getattr(self, what)
        if known.get(what, (None,))[0] is not df:
            known[what] = (df, df.count())
        return known[what][1]

    @property
    def shape(self) -> tuple[int, int]:
        return self.n_obs, self.n_vars

    @property
    def nnz(self) -> int:
        return self.kept().count()

    def name_column(self) -> Column:
        """The name to show for a gene: the first of gene_name, gene_symbols and gene_ids that var has, else the id."""
        return next((F.col(c) for c in NAMES if c in self.var.columns), F.col("gene_id").cast("string"))

    @property
    def var_names(self) -> list[str]:
        return [r[0] for r in self.var.orderBy("gene_id").select(self.name_column()).collect()]

    def __repr__(self) -> str:
        return f"CountFrame({self.n_obs} x {self.n_vars}, obs: {', '.join(self.obs.columns)}; var: {', '.join(self.var.columns)}; obsm: {', '.join(self.obsm)}; ops: {list(self.ops)})"

    # --- subsetting ---------------------------------------------------------------------------------------------

    def copy(self) -> CountFrame:
        return replace(self, obsm=dict(self.obsm), varm=dict(self.varm), uns=dict(self.uns))

    def filter_cells(self, condition: Column | str) -> CountFrame:
        """Cells whose obs row meets a Column or SQL condition. The neighbour graph goes, as it is of other cells."""
        return replace(self.copy(), obs=self.obs.where(condition), all_cells=False, uns={k: v for k, v in self.uns.items() if k != "neighbors"})

    def filter_genes(self, condition: Column | str) -> CountFrame:
        return replace(self.copy(), var=self.var.where(condition), all_genes=False)

    def keep(self, cells: DataFrame | None = None, genes: DataFrame | None = None) -> CountFrame:
        """The cells and genes whose ids the given frames hold."""
        out = self.copy()
        if cells is not None:
            out.obs, out.all_cells = out.obs.join(cells.select("cell_id"), "cell_id", "left_semi"), False
            out.uns.pop("neighbors", None)
        if genes is not None:
            out.var, out.all_genes = out.var.join(genes.select("gene_id"), "gene_id", "left_semi"), False
        return out

    def embedding(self, key: str) -> DataFrame:
        """(cell_id, vec) of the cells that are kept."""
        if key not in self.obsm:
            raise ValueError(f"no embedding {key!r}")
        e = self.obsm[key]
        return e if self.all_cells else e.join(self.obs.select("cell_id"), "cell_id", "left_semi")

    # --- the matrix ---------------------------------------------------------------------------------------------

    def kept(self) -> DataFrame:
        """Raw counts of the kept cells and genes."""
        x = self.store
        if not self.all_genes:
            x = x.join(self.var.select("gene_id"), "gene_id", "left_semi")
        if not self.all_cells:
            x = x.join(self.obs.select("cell_id"), "cell_id", "left_semi")
        return x.select("cell_id", "gene_id", "count")

    def dealt(self, x: DataFrame, *keys: str) -> DataFrame:
        """x, which has about as many rows as the counts, dealt by the keys to as many partitions."""
        return x.repartition(*keys) if self.parts is None else x.repartition(self.parts, *keys)

    def with_cells(self, x: DataFrame, cells: DataFrame) -> DataFrame:
        """x, dealt by cell as the counts are, joined with a table (cell_id, ...) of the cells. That is dealt in the same way and merged, as it grows with the cells: sent whole, every task would hold it."""
        return x.join(cells, "cell_id") if self.parts is None else x.join(cells.repartition(self.parts, "cell_id").hint("merge"), "cell_id")

    def matrix(self, transform: bool = True) -> DataFrame:
        """(cell_id, gene_id, count, value): value has the recorded transforms, in single precision as ties are decided by it.

        Totals are sums over a window of each cell, whose rows are as many as its genes at most and are together already, so no rows are shuffled for them.
        """
        x = self.kept()
        value = F.col("count")
        for op in self.ops if transform else ():
            if op[0] == "normalize_total":
                x = x.withColumn("_total", F.sum("count").over(Window.partitionBy("cell_id")))
                value = (value * F.when(F.col("_total") > 0, F.lit(float(op[1])) / F.col("_total")).otherwise(F.lit(1.0))).cast("float").cast("double")
            elif op[0] == "log1p":
                value = F.log1p(value).cast("float").cast("double")
        return x.select("cell_id", "gene_id", "count", value.alias("value"))

    def record(self, *op) -> None:
        """Adds a transform, or takes the place of one of the same kind. Normalising must come before log1p."""
        kinds = [o[0] for o in self.ops]
        if op[0] == "normalize_total" and "log1p" in kinds:
            raise ValueError("normalize_total has to come before log1p")
        self.ops = tuple(op if o[0] == op[0] else o for o in self.ops) if op[0] in kinds else (*self.ops, op)

    # --- exports ------------------------------------------------------------------------------------------------

    def write_parquet(self, path: str, rows_per_file: int = 1 << 23, embeddings: bool = False) -> None:
        """Raw counts as part files of whole cells in order, with obs.parquet and var.parquet; ids are dealt anew from 0."""
        obs, var = _renumbered(self.obs, "cell_id"), _renumbered(self.var, "gene_id")
        x = self.kept().join(obs.select(F.col("cell_id"), F.col("_new").alias("_c")), "cell_id").join(var.select("gene_id", F.col("_new").alias("_g")), "gene_id")
        parts = max(1, -(-x.count() // rows_per_file))
        out = x.select(F.col("_c").alias("cell_id"), F.col("_g").cast("int").alias("gene_id"), F.col("count").cast("float").alias("count"))
        out.repartitionByRange(parts, "cell_id").sortWithinPartitions("cell_id", "gene_id").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/counts.parquet")
        for name, df, key in (("obs", obs, "cell_id"), ("var", var, "gene_id")):
            df.withColumn(key, F.col("_new").cast(dict(df.dtypes)[key])).drop("_new").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}.parquet")
        for k in self.obsm if embeddings else ():
            self.embedding(k).join(obs.select("cell_id", "_new"), "cell_id").select(F.col("_new").alias("cell_id"), "vec").write.mode("overwrite").parquet(f"{path}/obsm-{k}.parquet")

    def to_csr(self, transform: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[int, int]]:
        """(indptr, indices, data, shape) on the driver, cells and genes by id; for small results."""
        cells = [r[0] for r in self.obs.select("cell_id").orderBy("cell_id").collect()]
        genes = [r[0] for r in self.var.select("gene_id").orderBy("gene_id").collect()]
        p = self.matrix(transform).select("cell_id", "gene_id", "value").toPandas()
        i, j = np.searchsorted(cells, p["cell_id"]), np.searchsorted(genes, p["gene_id"])
        order = np.lexsort((j, i))
        return np.append(0, np.cumsum(np.bincount(i, minlength=len(cells)))), j[order], p["value"].to_numpy(dtype=np.float32)[order], (len(cells), len(genes))

    def to_scipy(self, transform: bool = True):
        from scipy.sparse import csr_matrix

        indptr, indices, data, shape = self.to_csr(transform)
        return csr_matrix((data, indices, indptr), shape=shape)

    def to_anndata(self, transform: bool = False):
        """An AnnData object with obs, var, embeddings and, if there is a graph, its symmetric weights."""
        import anndata

        obs, var = self.obs.orderBy("cell_id").toPandas(), self.var.orderBy("gene_id").toPandas()
        out = anndata.AnnData(self.to_scipy(transform), obs=obs.set_index(obs["cell_id"].astype(str)), var=var.set_index(pd.Index(self.var_names)))
        for k in self.obsm:
            out.obsm[k] = np.array(self.embedding(k).orderBy("cell_id").toPandas()["vec"].tolist(), dtype=np.float32)
        if "neighbors" in self.uns:
            from scipy.sparse import csr_matrix

            at = {c: i for i, c in enumerate(obs["cell_id"])}
            e = self.uns["neighbors"]["graph"].toPandas()
            i, j = e["src"].map(at), e["dst"].map(at)
            m = csr_matrix((e["weight"], (i, j)), shape=(len(obs), len(obs)))
            out.obsp["connectivities"] = m + m.T
        return out


class _Csr:
    """A dense array as compressed rows."""

    def __init__(self, x: np.ndarray):
        i, self.indices = np.nonzero(x)
        self.data, self.shape = x[i, self.indices], x.shape
        self.indptr = np.append(0, np.cumsum(np.bincount(i, minlength=len(x))))


def _local(spark: SparkSession, pdf: pd.DataFrame, schema=None) -> DataFrame:
    before = spark.conf.get("spark.sql.execution.arrow.pyspark.enabled")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    try:
        return spark.createDataFrame(pdf, schema) if schema else spark.createDataFrame(pdf)
    finally:
        spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", before)


def _pandas(df: DataFrame) -> pd.DataFrame:
    """df on the driver, by columns: rows of Python objects would take many times the room."""
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.execution.arrow.pyspark.enabled")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    try:
        return df.toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", before)


def held(df: DataFrame) -> DataFrame:
    """df with its rows on the driver, for tables of a row per gene or per group and gene that several steps need; nothing stays cached on executors."""
    return _local(df.sparkSession, df.toPandas(), df.schema)


def _numbered(df: DataFrame, key: str) -> DataFrame:
    """Ids by place in df, for a table that is read in order; numbers are dense, unlike monotonically_increasing_id()."""
    at = df.withColumn("_m", F.monotonically_increasing_id())
    starts = {r["_p"]: r["n"] for r in at.groupBy(F.shiftright("_m", 33).alias("_p")).count().withColumnRenamed("count", "n").collect()}
    before, total = {}, 0
    for p in sorted(starts):
        before[p], total = total, total + starts[p]
    offset = F.element_at(F.create_map(*[x for p, b in before.items() for x in (F.lit(p).cast("long"), F.lit(b).cast("long"))]), F.shiftright("_m", 33)) if before else F.lit(0)
    return at.withColumn(key, (offset + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).cast("long" if key == "cell_id" else "int")).drop("_m")


def _renumbered(df: DataFrame, key: str) -> DataFrame:
    """df with _new, the rank of its id from 0. Ids are dealt to ranges and ranked within, so no task holds them all."""
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = df.select(F.percentile_approx(key, [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or []
    bucket = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c < F.col(key))) if cuts else F.lit(0)
    at = df.withColumn("_b", bucket)
    before, total = {}, 0
    for r in at.groupBy("_b").count().orderBy("_b").collect():
        before[r["_b"]], total = total, total + r["count"]
    start = F.element_at(F.create_map(*[x for b, t in before.items() for x in (F.lit(b), F.lit(t).cast("long"))]), F.col("_b")) if before else F.lit(0)
    return at.withColumn("_new", start + F.row_number().over(Window.partitionBy("_b").orderBy(key)) - 1).drop("_b")


def concat(frames: Iterable[DataFrame]) -> DataFrame:
    frames = list(frames)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
