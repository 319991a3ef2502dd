"""A corpus from raw documents to packed sequences: toxic documents go, repeated lines go, one document of each group of near copies stays, leaked benchmark passages take their documents along, and what is left is packed.

Every stage but the last returns the columns of its input. No rows: no rows. Null texts count as empty ones, which are clean, have nothing to lose and are packed as their end mark alone. Rows of null id go through
all stages. Columns beside doc_id and text pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cytofold.llm import decontamination, line_dedup, minhash_dedup, packing, toxicity
from cytofold.llm.common import drop_durable, durable, free, named_nodes, table, whole_row
from cytofold.llm.registry import tokenizer_path

TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chain ends at a probability below TOXIC; the chain is fitted on labelled documents, and one that finds no telling features rejects none. Rows of one id are judged each by its own text."""
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"))
    if not chain.vocabulary:
        return docs
    name = free(docs.columns, "_toxicity")
    return toxicity.toxicity(docs, chain, into=name).where(F.col(f"{name}.toxic") < TOXIC).drop(name)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that many share; n_chars follows the text. A document that loses all lines stays, empty."""
    name = free(docs.columns, "_lines")
    out = line_dedup.line_dedup(docs, into=name)
    new = {"text": F.col(f"{name}.text"), "n_chars": F.char_length(f"{name}.text").cast(dict(docs.dtypes).get("n_chars", "long"))}
    changed = F.col(f"{name}.n_dropped") > 0
    return out.withColumns({c: F.when(changed, v).otherwise(F.col(c)) for c, v in new.items() if c in docs.columns}).drop(name)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least id. Rows of null id stay, and of rows equal in id and text one stays.

    Rows of one id with unlike texts are documents of their own here, so that a text never goes for being of the same id as a copy.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), whole_row(docs).alias("row"))
    real = rows.where("id is not null")
    again = durable(real.groupBy("id").count().where("count > 1").select("id"), "pipeline-again")
    units = real
    if not again.isEmpty():
        many = real.join(again, "id", "left_semi").groupBy("id", "text").agg(F.min_by("row", F.to_json("row")).alias("row"))
        units = durable(real.join(again, "id", "left_anti").unionByName(many), "pipeline-units")
    named = units.withColumn("hash", F.xxhash64("text"))
    if again.isEmpty():
        kept = named.join(minhash_dedup.minhash_groups(named.select(F.col("id").alias("doc_id"), "text")).where("kept").select(F.col("doc_id").alias("id")), "id", "left_semi")
    else:
        named = named_nodes(named, ["id", "hash"], real.select("id"), "pipeline")
        groups = minhash_dedup.minhash_groups(named.select(F.col("node").alias("doc_id"), "text")).select(F.col("doc_id").alias("node"), "component_id")
        first = groups.join(named.select("node", "id", "hash"), "node").groupBy("component_id").agg(F.min_by("node", F.struct("id", "hash")).alias("node"))
        kept = named.join(first.select("node"), "node", "left_semi")
    return rows.where("id is null").select("row").unionByName(kept.select("row")).select("row.*")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    name = free(docs.columns, "_leaks")
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), into=name).where(F.size(name) == 0).drop(name)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, and their places in sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_dedup", drop_copies), ("decontamination", drop_leaks), ("packing", pack)]

#: A fitted classifier and a tokenizer can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_durable(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
