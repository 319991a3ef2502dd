"""Quality metrics of counts that keep arriving, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

_TRIPLET = "cell_id long, gene_id int, count double"


def accumulate(stream: DataFrame, folder: str) -> StreamingQuery:
    """Starts writing a stream of (cell_id, gene_id, count) to `folder` as sums by cell and gene, a sub-folder for each batch, until what is available is read.

    A batch that runs again after a failure writes its own sub-folder anew, so nothing counts twice; where the stream has come to is kept in the folder too, so that a later call goes on from there. Nulls in a key leave the row out; null counts are none.
    """

    def put(batch: DataFrame, number: int) -> None:
        sums = batch.where("cell_id is not null and gene_id is not null").groupBy("cell_id", "gene_id").agg(F.coalesce(F.sum("count"), F.lit(0.0)).alias("count"))
        sums.write.mode("overwrite").parquet(f"{folder}/sums/batch={number}")

    rows = stream.select(F.col("cell_id").cast("long"), F.col("gene_id").cast("int"), F.col("count").cast("double"))
    return rows.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()


def accumulated(spark: SparkSession, folder: str) -> DataFrame:
    """(cell_id, gene_id, count) of all batches so far, each pair once, without zeros."""
    return spark.read.schema(f"{_TRIPLET}, batch int").parquet(f"{folder}/sums").groupBy("cell_id", "gene_id").agg(F.sum("count").alias("count")).where("count <> 0")


def cell_metrics(triplets: DataFrame) -> DataFrame:
    """(cell_id, n_genes_by_counts, total_counts) of accumulated() triplets."""
    return triplets.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n_genes_by_counts"), F.sum("count").alias("total_counts"))


def gene_metrics(triplets: DataFrame) -> DataFrame:
    """(gene_id, n_cells_by_counts, total_counts) likewise."""
    return triplets.groupBy("gene_id").agg(F.count(F.lit(1)).alias("n_cells_by_counts"), F.sum("count").alias("total_counts"))
