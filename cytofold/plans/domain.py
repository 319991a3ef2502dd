"""The retail tables read as count matrices, and small result helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cytofold.frame import CountFrame, parts_for
from cytofold.shared import shared_dir  # noqa: F401


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def orders_by_part(spark: SparkSession, sf: str) -> CountFrame:
    """M1: orders are cells, parts are genes, and a count is the quantity ordered. Sparse; some cells are empty."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    obs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("cell_id"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    var = table(spark, sf, "part").select(F.col("p_partkey").cast("int").alias("gene_id"), F.col("p_name").alias("gene_name"))
    return CountFrame.from_triplets(li, obs, var, cell_col="l_orderkey", gene_col="l_partkey", value_col="l_quantity", rows=li.count())


def customers_by_supplier(spark: SparkSession, sf: str) -> CountFrame:
    """M2: customers are cells, suppliers are genes. A third of the matrix is non-zero. Orders are dealt and merged: sent whole, all of them would be in every task's memory."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    rows = li.count()
    parts = parts_for(spark, rows)
    x = li.repartition(parts, "l_orderkey").join(o.repartition(parts, "o_orderkey").hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    obs = table(spark, sf, "customer").select(F.col("c_custkey").alias("cell_id"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    var = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("int").alias("gene_id"), F.col("s_name").alias("gene_name"))
    return CountFrame.from_triplets(x, obs, var, cell_col="o_custkey", gene_col="l_suppkey", value_col="l_quantity", rows=rows)


def points(spark: SparkSession, sf: str) -> DataFrame:
    """(id, vec, label) of the embedding table."""
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def as_frame(spark: SparkSession, sf: str) -> CountFrame:
    """The embedding table as the X_pca of a frame without counts."""
    p = points(spark, sf)
    obs = p.select(F.col("id").alias("cell_id"), F.col("label").cast("string").alias("label"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("half"))
    empty = spark.createDataFrame([], "cell_id long, gene_id int, count double")
    cf = CountFrame(empty, obs, spark.createDataFrame([(0, "g0")], "gene_id int, gene_name string"))
    cf.obsm["X_pca"] = p.select(F.col("id").alias("cell_id"), "vec")
    return cf


def r(c: str | Column, digits: int = 6) -> Column:
    return F.round(c, digits)
