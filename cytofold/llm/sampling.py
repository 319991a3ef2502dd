"""A bounded sample of labelled documents for fitting a model on the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def labelled(docs: DataFrame, labels: DataFrame, label: str, limit: int, where: Column | None = None, more: Sequence[str] = ()) -> DataFrame:
    """(doc_id, label, more, text) of at most `limit` labelled documents, those of the lowest hash of their id: the same at every run, and from all over the table.

    Labels that are null, or of a null id, don't count; an id with both labels counts as the larger. Repeated rows of an id give one text.
    `limit` bounds what is broadcast (ids and labels) and what a model is fitted on.
    """
    names = ["label", *more]
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"), *[F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c) for c in more]).dropna()
    if where is not None:
        own = own.where(where)
    own = own.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in names]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = [tuple(r) for r in own.collect()]
    few = docs.sparkSession.createDataFrame(rows, ", ".join(["doc_id long", *[f"`{c}` int" for c in names]]))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(few), "doc_id").groupBy("doc_id", *names).agg(F.min("text").alias("text"))
