"""Readers of count matrices: Parquet datasets, Matrix Market folders, and HDF5 files.

HDF5 files are opened by h5py if it is installed, or by whatever `opener` names as "module:function": it is called with a path and "r" and gives a
context with groups (keys(), in, [name], attrs) and arrays (dtype, slices), and tasks have to be able to import it.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cytofold.frame import CountFrame, _local


def read_parquet(spark: SparkSession, path: str) -> CountFrame:
    """A dataset as CountFrame.write_parquet leaves it, or with part-*.parquet beside obs.parquet and var.parquet."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/counts.parquet")
    inner = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    x = spark.read.parquet(f"{path}/counts.parquet" if inner else f"{path}/part-*.parquet")
    obs, var = spark.read.parquet(f"{path}/obs.parquet"), spark.read.parquet(f"{path}/var.parquet")
    return CountFrame.from_triplets(x, obs, var)


def _first(spark: SparkSession, path: str, names: list[str]) -> str:
    for n in names:
        for suffix in ("", ".gz"):
            p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}{suffix}")
            if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
                return f"{path}/{n}{suffix}"
    raise FileNotFoundError(f"{path} has none of {names}")


def _lines(spark: SparkSession, path: str) -> list[list[str]]:
    return [r[0].split("\t") for r in spark.read.text(path).collect()]


def read_10x_mtx(spark: SparkSession, path: str, gex_only: bool = True) -> CountFrame:
    """matrix.mtx, barcodes.tsv and features.tsv or genes.tsv, compressed or not. Ids start from 0 in the order of the files; names fit on the driver, counts are read by tasks."""
    cells = [x[0] for x in _lines(spark, _first(spark, path, ["barcodes.tsv"]))]
    genes = _lines(spark, _first(spark, path, ["features.tsv", "genes.tsv"]))
    obs = _local(spark, pd.DataFrame({"cell_id": np.arange(len(cells)), "barcode": cells}), "cell_id long, barcode string")
    part = lambda k, d: [g[k] if len(g) > k else d for g in genes]
    var = _local(spark, pd.DataFrame({"gene_id": np.arange(len(genes), dtype=np.int32), "gene_ids": part(0, ""), "gene_name": [g[1] if len(g) > 1 else g[0] for g in genes], "feature_types": part(2, "Gene Expression")}), "gene_id int, gene_ids string, gene_name string, feature_types string")
    text = spark.read.text(_first(spark, path, ["matrix.mtx"])).where(~F.col("value").startswith("%"))
    v = F.split(F.trim("value"), r"\s+")
    # the line of sizes is the only one with these numbers in place of a position beyond the matrix or of as many counts
    rows = text.select(v[0].cast("long").alias("g"), v[1].cast("long").alias("c"), F.try_element_at(v, F.lit(3)).cast("double").alias("count"))
    size = spark.read.text(_first(spark, path, ["matrix.mtx"])).where(~F.col("value").startswith("%")).first()[0].split()
    head = (F.col("g") == int(size[0])) & (F.col("c") == int(size[1])) & (F.col("count") == float(size[2]))
    same = rows.where(head)
    x = rows.where(~head)
    if same.count() > 1:
        x = x.unionByName(same.limit(1))
    cf = CountFrame.from_triplets(x.select((F.col("c") - 1).alias("cell_id"), (F.col("g") - 1).alias("gene_id"), "count"), obs, var)
    return cf.filter_genes("feature_types = 'Gene Expression'") if gex_only else cf


H5PY = "h5py:File"


def _open(opener: str, path: str):
    module, name = opener.split(":")
    return getattr(importlib.import_module(module), name)(path, "r")


def _is_array(x) -> bool:
    return hasattr(x, "dtype")


class _Cells(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class CompressedRows(DataSource):
    """Non-zeros of a compressed sparse matrix in an HDF5 file, a range of its rows a partition: options path, group, rows_per_partition, opener."""

    @classmethod
    def name(cls) -> str:
        return "h5_compressed_rows"

    def schema(self) -> str:
        return "major long, minor long, count double"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.group, self.step, self.opener = options["path"], options["group"], int(options.get("rows_per_partition", 20_000)), options.get("opener", H5PY)

    def partitions(self) -> list[_Cells]:
        with _open(self.opener, self.path) as f:
            n = len(f[self.group]["indptr"]) - 1
        return [_Cells(i, min(n, i + self.step)) for i in range(0, n, self.step)]

    def read(self, partition: _Cells) -> Iterator:
        import pyarrow as pa

        with _open(self.opener, self.path) as f:
            g = f[self.group]
            at = g["indptr"][partition.first : partition.last + 1]
            for lo in range(partition.first, partition.last, 2000):
                hi = min(partition.last, lo + 2000)
                a, b = int(at[lo - partition.first]), int(at[hi - partition.first])
                rows = np.repeat(np.arange(lo, hi), np.diff(at[lo - partition.first : hi - partition.first + 1]))
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(g["indices"][a:b].astype(np.int64)), pa.array(g["data"][a:b].astype(np.float64))], names=["major", "minor", "count"])


def _h5(spark: SparkSession, path: str, group: str, opener: str) -> DataFrame:
    spark.dataSource.register(CompressedRows)
    return spark.read.format("h5_compressed_rows").options(path=path, group=group, opener=opener).load()


def _text(x) -> list[str]:
    return [v.decode() if isinstance(v, bytes) else str(v) for v in x]


def read_10x_h5(spark: SparkSession, path: str, gex_only: bool = True, backed: str | None = None, opener: str = H5PY) -> CountFrame:
    """A 10x file of layout 3 (matrix/features) or 2 (its first genome). With `backed`, counts go to a Parquet dataset there first and are read from it."""
    with _open(opener, path) as f:
        if "matrix" in f:
            group, ft = "matrix", f["matrix"]["features"]
            ids, names, kinds = _text(ft["id"][:]), _text(ft["name"][:]), _text(ft["feature_type"][:]) if "feature_type" in ft else None
        else:
            group = next(iter(f.keys()))
            ids, names, kinds = _text(f[group]["genes"][:]), _text(f[group]["gene_names"][:]), None
        cells = _text(f[group]["barcodes"][:])
    obs = _local(spark, pd.DataFrame({"cell_id": np.arange(len(cells)), "barcode": cells}), "cell_id long, barcode string")
    var = _local(spark, pd.DataFrame({"gene_id": np.arange(len(ids), dtype=np.int32), "gene_ids": ids, "gene_name": names, "feature_types": kinds or ["Gene Expression"] * len(ids)}), "gene_id int, gene_ids string, gene_name string, feature_types string")
    cf = CountFrame.from_triplets(_h5(spark, path, group, opener).withColumnsRenamed({"major": "cell_id", "minor": "gene_id"}), obs, var)
    if gex_only:
        cf = cf.filter_genes("feature_types = 'Gene Expression'")
    if backed:
        cf.write_parquet(backed)
        return read_parquet(spark, backed)
    return cf


def convert_h5_to_parquet(spark: SparkSession, path: str, out: str, opener: str = H5PY) -> CountFrame:
    return read_10x_h5(spark, path, gex_only=False, backed=out, opener=opener)


def _column(x) -> np.ndarray | None:
    """A column of obs or var; None for an encoding that isn't known, such as numbers with a mask."""
    if _is_array(x):
        v = x[:]
        return np.array(_text(v), dtype=object) if v.dtype.kind in "SUO" else v
    if "categories" in x and "codes" in x:
        return np.array([*_text(x["categories"][:]), "nan"], dtype=object)[x["codes"][:]]
    return None


def _annotations(g) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(index, columns) of a group of columns, or of one array of records as older files have."""
    if _is_array(g):
        v = g[:]
        cols = {n: np.array(_text(v[n]), dtype=object) if v[n].dtype.kind in "SUO" else v[n] for n in v.dtype.names}
        return cols.pop("index") if "index" in cols else cols.pop("_index"), cols
    key = _text([g.attrs.get("_index", "_index")])[0]
    names = [n for n in _text(g.attrs.get("column-order", list(g.keys()))) if n != key]
    found = {n: _column(g[n]) for n in names}
    return _column(g[key]), {n: v for n, v in found.items() if v is not None}


def read_h5ad(spark: SparkSession, path: str, opener: str = H5PY) -> CountFrame:
    """X as compressed rows, compressed columns or dense, with the columns of obs and var; categories become strings and missing ones 'nan', and columns of unknown encodings are left out."""

    def frame(g, key):
        index, cols = _annotations(g)
        out = pd.DataFrame({key: np.arange(len(index)), **{"barcode" if key == "cell_id" else "gene_name": index}, **cols})
        return _local(spark, out.astype({key: "int64" if key == "cell_id" else "int32"}))

    with _open(opener, path) as f:
        obs, var = frame(f["obs"], "cell_id"), frame(f["var"], "gene_id")
        x = f["X"]
        kind = "dense" if _is_array(x) else _text([x.attrs.get("encoding-type", x.attrs.get("h5sparse_format", "csr_matrix"))])[0]
        dense = x[:] if kind == "dense" else None
    if dense is not None:
        i, j = np.nonzero(dense)
        long = _local(spark, pd.DataFrame({"cell_id": i, "gene_id": j, "count": dense[i, j].astype(float)}), "cell_id long, gene_id long, count double")
    else:
        rows = _h5(spark, path, "X", opener)
        long = rows.withColumnsRenamed({"major": "cell_id", "minor": "gene_id"} if kind.startswith("csr") else {"major": "gene_id", "minor": "cell_id"})
    return CountFrame.from_triplets(long, obs, var)
