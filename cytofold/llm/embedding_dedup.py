"""Links between embeddings of high cosine, from int8 tile products with rigorous error bounds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from cytofold.llm.common import components, drop_durable, durable, named_nodes, roots, whole_row

FOUND = "node long, other long, links long"


def plan(n: int, threshold: float, miss: float = 1e-7, room: int = 64) -> tuple[int, int]:
    """(bits, tables) of sign projections for n vectors.

    Two vectors at the threshold agree on a bit with probability 1 - angle / pi. Bits grow with log2(n), so that a
    bucket holds about `room` unrelated vectors; tables are as many as a pair right at the threshold needs to share none with probability `miss`.
    """
    bits = min(30, max(1, math.ceil(math.log2(max(2, n / room)))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-same)))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision; each is first divided by its largest component, so that squares neither overflow nor vanish."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def keys(x: np.ndarray, bits: int, tables: int, seed: int = 11) -> np.ndarray:
    """The bucket of each unit vector in each table."""
    planes = np.random.default_rng([seed, x.shape[1], bits]).standard_normal((x.shape[1], bits * tables))
    signs = (x @ planes >= 0).reshape(len(x), tables, bits)
    return (signs @ (1 << np.arange(bits))).astype(np.int32)


class Quantised:
    """Unit vectors as int8 times a scale each, with the length of what that leaves out."""

    def __init__(self, unit: np.ndarray):
        self.unit = unit
        scale = np.abs(unit).max(axis=1, keepdims=True) / 127
        q = np.rint(unit / scale)
        self.error = np.linalg.norm(unit - q * scale, axis=1) + 1e-12
        # products of int8 and their sums are whole numbers below 2^24 for up to 1000 dimensions, so float32 holds them exactly and BLAS can make them
        self.kind = np.float32 if unit.shape[1] <= 1000 else np.float64
        self.q, self.scale = q.astype(self.kind), scale[:, 0]

    def pairs(self, a: slice, b: slice, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Row pairs of two ranges whose cosine, in double precision, reaches the threshold.

        With u = s + e for each vector, |u.v - s.t| <= |e||t| + |s||f| + |e||f| and |s| <= 1 + |e|. Pairs that the bound
        leaves in doubt are made again in full; those above it for sure are not.
        """
        dot = (self.q[a] @ self.q[b].T).astype(np.float64) * self.scale[a][:, None] * self.scale[b][None, :]
        e, f = self.error[a][:, None], self.error[b][None, :]
        bound = e + f + 3 * e * f + 1e-9
        i, j = np.nonzero(dot >= threshold - bound)
        i, j = i + a.start, j + b.start
        keep = i < j
        i, j = i[keep], j[keep]
        sure = dot[i - a.start, j - b.start] - (self.error[i] + self.error[j] + 3 * self.error[i] * self.error[j] + 1e-9) >= threshold
        doubt = np.nonzero(~sure)[0]
        for s in range(0, len(doubt), 1 << 16):
            x = doubt[s : s + (1 << 16)]
            sure[x] = np.einsum("ij,ij->i", self.unit[i[x]], self.unit[j[x]]) >= threshold
        return i[sure], j[sure]


def _tile(g: pd.DataFrame, dims: int, kind: str, threshold: float, bits: int, tables: int, side: int = 2048) -> list[tuple]:
    """Links of the vectors of some buckets. A pair that an earlier table has together is left to that table's count, but for a bucket in parts: rows of `part` meet only as their tile says."""
    g = g.sort_values(["key", "part", "node"], ignore_index=True)
    n = len(g)
    x = _unit(np.frombuffer(b"".join(g["vector"]), dtype=kind).reshape(n, dims))
    q = Quantised(x)
    node, copies = g["node"].to_numpy(), g["copies"].to_numpy()
    part, table = g["part"].to_numpy(), int(g["table"].iloc[0])
    mixed = bool(g["tile_a"].iloc[0] != g["tile_b"].iloc[0])
    key = g["key"].to_numpy()
    edge = np.nonzero(np.append(True, key[1:] != key[:-1]))[0]
    ii, jj = [], []
    for lo, hi in zip(edge.tolist(), np.append(edge[1:], n).tolist(), strict=True):
        for a in range(lo, hi, side):
            for b in range(a, hi, side):
                i, j = q.pairs(slice(a, min(a + side, hi)), slice(b, min(b + side, hi)), threshold)
                if mixed:
                    across = part[i] != part[j]
                    i, j = i[across], j[across]
                ii.append(i)
                jj.append(j)
    i, j = np.concatenate(ii), np.concatenate(jj)
    if table and len(i):
        some, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        own = keys(x[some], bits, tables)[:, :table]
        i_, j_ = at[: len(i)], at[len(i) :]
        first = np.ones(len(i), dtype=bool)
        for s in range(0, len(i), 1 << 16):
            first[s : s + (1 << 16)] = ~(own[i_[s : s + (1 << 16)]] == own[j_[s : s + (1 << 16)]]).any(axis=1)
        i, j = i[first], j[first]
    if not len(i):
        return []
    links = np.bincount(i, weights=copies[j], minlength=n) + np.bincount(j, weights=copies[i], minlength=n)
    root = roots(n, i, j)
    some = np.nonzero(links)[0]
    out = list(zip(node[some].tolist(), [None] * len(some), links[some].astype(int).tolist(), strict=True))
    far = some[root[some] != some]
    return out + list(zip(node[far].tolist(), node[root[far]].tolist(), [None] * len(far), strict=True))


def linked(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", tile: int = 2048, group: int = 4096) -> DataFrame:
    """vectors with n_links, component_id and kept, in place of columns of these names.

    Vectors that are equal are one node with a count. Nodes are dealt to buckets of sign projections, in as many tables as a pair at
    the threshold needs, and buckets are compared tile by tile. A bucket over `tile` rows is dealt out in parts, every two of
    which meet in a task of their own, so no task grows with a bucket; buckets that are small share a task. What a task returns is a
    count per vector and the edges of a forest, never pairs.

    Components are kept in the precision they come in, double or float, and cosines are in double precision. Vectors meet those of their own length only, in buckets and tables planned for as many. Vectors that are null, zero, or that hold null or non-finite components, and rows of null id, link with nothing. Repeated rows of an id
    and vector count as one; other rows of one id are vectors of their own. No rows: no rows. Other columns pass through, whatever their names.
    """
    spark = vectors.sparkSession
    single = "array<float>" in dict(vectors.dtypes)[vector_col].lower()
    kind, number = ("<f4", "float") if single else ("<f8", "double")
    own = vectors.select(whole_row(vectors, "n_links", "component_id", "kept").alias("row"), F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col), lambda x: x.cast(number)).alias("v"))
    fine = F.coalesce(F.col("id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    own = own.withColumn("a", F.when(fine, F.xxhash64("v"))).withColumn("b", F.when(fine, F.hash("v")))
    sets = own.where(fine).groupBy("a", "b").agg(F.min("id").alias("id"), F.count_distinct("id").alias("copies"), F.first("v").alias("v"))
    sets = named_nodes(durable(sets, "embedding-sets"), ["a", "b"], own.where(fine).select("id"), "embedding")
    lengths = {r["d"]: r["count"] for r in sets.groupBy(F.size("v").alias("d")).count().collect()}
    n = sum(lengths.values())
    planned = {d: plan(count, threshold) for d, count in lengths.items()}

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            size = b["v"].str.len()
            for d in size.unique().tolist():
                some = b[size == d]
                x = np.array(some["v"].tolist(), dtype=kind).reshape(len(some), d)
                yield pd.DataFrame({"d": d, "node": some["node"].to_numpy(), "copies": some["copies"].to_numpy(), "vector": [r.tobytes() for r in x], "bucket": list(keys(_unit(x), *planned[d]))})

    signed = durable(sets.select("node", "copies", "v").mapInPandas(sign, "d int, node long, copies long, vector binary, bucket array<int>"), "embedding-keys")
    sizes = signed.select("d", F.posexplode("bucket").alias("table", "key")).groupBy("d", "table", "key").count()
    hot = durable(sizes.where(F.col("count") > tile).select("d", "table", "key", F.ceil(F.col("count") / tile).cast("int").alias("parts")), "embedding-hot")
    rows = signed.select("d", "node", "copies", "vector", F.posexplode("bucket").alias("table", "key")).join(hot, ["d", "table", "key"], "left")
    tasks = max(1, -(-n // group))
    part = F.pmod(F.xxhash64("node", F.lit(5)), F.col("parts")).cast("int")
    cold = rows.where(F.col("parts").isNull()).withColumns({"part": F.lit(0), "tile_a": F.lit(-1), "tile_b": F.lit(-1), "deal": F.pmod(F.xxhash64("key"), F.lit(tasks)).cast("int")})
    warm = (
        rows.where(F.col("parts").isNotNull())
        .withColumn("part", part)
        .withColumn("to", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumns({"tile_a": F.least("part", "to"), "tile_b": F.greatest("part", "to"), "deal": F.col("key")})
        .drop("to")
    )
    both = cold.drop("parts").unionByName(warm.drop("parts"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        d = int(g["d"].iloc[0])
        return pd.DataFrame(_tile(g, d, kind, threshold, *planned[d]), columns=["node", "other", "links"]).astype("Int64")

    found = durable(both.groupBy("d", "table", "deal", "tile_a", "tile_b").applyInPandas(run, FOUND), "embedding-links")
    links = found.where("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")), "embedding")
    of = sets.join(groups, "node", "left").select("a", "b", "id", "node", "copies", F.coalesce("component", "node").alias("component"))
    # a component's least node may be a hash
    least = of.groupBy("component").agg(F.min("id").alias("least"))
    known = durable(of.join(least, "component").join(links, "node", "left").select("a", "b", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("links"), "least"), "embedding-known")
    out = own.join(known, ["a", "b"], "left").select("row.*", F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("least", "id").alias("component_id"), F.coalesce(F.col("id") == F.coalesce("least", "id"), F.lit(True)).alias("kept"))
    for x in (signed, hot, found):
        drop_durable(x)
    return out


def digest(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    return linked(vectors.select("vec_id", "embedding")).select("vec_id", "n_links", "component_id", "kept")


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v
), link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95
), reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x
), c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x
), k AS (SELECT x, count(*) AS n FROM link GROUP BY x)
SELECT e.vec_id, coalesce(k.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e LEFT JOIN k ON e.vec_id = k.x LEFT JOIN c ON e.vec_id = c.x
"""
