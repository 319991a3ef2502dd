"""What the operators of this subpackage share: durable tables, connected components and null-safe columns."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or for local sessions without it a temporary one. On a cluster without it there is none, which is an error."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors see")
    made = getattr(shared_dir, "made", None)
    if not made:
        made = shared_dir.made = "file://" + tempfile.mkdtemp(prefix="cytofold-")
    return made


def new_dir(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def durable(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back. This cuts the lineage, and lost executors don't cause it to be made again."""
    path = new_dir(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._durable_path = path
    return back


def drop_durable(df: DataFrame | None) -> None:
    """Deletes the files of a durable() table that nothing reads any more."""
    if df is not None and (path := getattr(df, "_durable_path", None)):
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def free(taken: Sequence[str], name: str) -> str:
    """name, with as many underscores before it as it needs to be none of `taken`, in any case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def whole_row(df: DataFrame, *without: str) -> Column:
    """A struct of df's columns, whatever their names, less those in `without`."""
    gone = {c.lower() for c in without}
    kept = [F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c.lower() not in gone]
    return F.struct(*kept) if kept else F.struct(F.lit(None).cast("string").alias("_"))


def named_nodes(nodes: DataFrame, key: Sequence[str], ids: DataFrame, tag: str) -> DataFrame:
    """nodes (key, id, ...), a row for each key, with a column `node` that tells them apart: the id, but where several rows have one id the least key keeps it and the others get hashes that aren't in ids (id)."""
    twice = durable(nodes.groupBy("id").count().where("count > 1").select("id"), f"{tag}-several")
    if twice.isEmpty():
        return nodes.withColumn("node", F.col("id"))
    w = Window.partitionBy("id").orderBy(*key)
    more = nodes.join(twice, "id", "left_semi").select(*key, F.row_number().over(w).alias("_k")).where("_k > 1")
    for salt in range(100):
        fresh = durable(more.select(*key, F.xxhash64(*key, F.lit(salt)).alias("_fresh")), f"{tag}-fresh")
        taken = fresh.select("_fresh").unionByName(ids.select(F.col("id").alias("_fresh")).distinct()).groupBy("_fresh").count().where("count > 1")
        if taken.isEmpty():
            return durable(nodes.join(fresh, list(key), "left").withColumn("node", F.coalesce("_fresh", "id")).drop("_fresh"), f"{tag}-nodes")
    raise RuntimeError("named_nodes: no free ids")


def few(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """df, to be broadcast in a join if it has at most `most` rows, which are to be some ten bytes each; else an ordinary side of one. It is counted, so it should be a durable() table."""
    return F.broadcast(df) if df.count() <= most else df


def batches_of(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum to `most` at most, or of one row."""
    ends, at = np.cumsum(sizes), 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, to
        at = to


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each of n nodes' component under the edges (i, j)."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = np.minimum(new, new[label])
        while (deeper := new[new] < new).any():
            new[deeper] = new[new[deeper]]
        if (new == label).all():
            break
        label = new
    return label


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased and nothing else. lower() is much faster than translate() and does the same where all characters are ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def components(edges: DataFrame, tag: str, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b): the smallest node that it reaches.

    Alternating large-star and small-star steps (Kiveris et al. 2014). Every round is one or two aggregations of
    the edge list and is written to the shared folder; the rounds grow with the logarithm of the size. A node's neighbours are only
    ever reduced to their minimum, so a node with very many of them is pre-aggregated before the shuffle.
    """
    spark = edges.sparkSession

    def stats(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())

    now = durable(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{tag}-edges")
    before = stats(now)
    for _ in range(rounds):
        if not before[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        after = durable(small, f"{tag}-round")
        drop_durable(now)
        now, last, before = after, before, stats(after)
        if last == before:
            break
    else:
        raise RuntimeError(f"components: not settled after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
