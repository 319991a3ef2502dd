"""Near-duplicate documents: SuperMinHash signatures, banding, verification on whole sets and grouping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from cytofold.llm.common import batches_of, components, drop_durable, durable, few, named_nodes, roots

_GOLD, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


#: What a byte of a word and its place in the word weigh in the word's hash.
_LETTER = mix(np.arange(256, dtype=np.uint64) + np.uint64(1 << 40))
_PLACE = mix(np.arange(1 << 10, dtype=np.uint64)) | np.uint64(1)


def _word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each run of bytes that aren't white space: the sum of its bytes' numbers, each times that of its place, mixed with its length."""
    b = np.frombuffer(text, dtype=np.uint8)
    edge = np.diff(np.concatenate([[True], _SPACES[b], [True]]).astype(np.int8))
    start, end = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
    size = end - start
    if not len(start):
        return start, np.zeros(0, dtype=np.uint64)
    h = np.empty(len(start), dtype=np.uint64)
    for at in range(0, len(start), 1 << 17):
        s, n = start[at : at + (1 << 17)], size[at : at + (1 << 17)]
        own = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(own, n)
        weight = _PLACE if n.max() <= len(_PLACE) else mix(np.arange(int(n.max()), dtype=np.uint64)) | np.uint64(1)
        h[at : at + (1 << 17)] = np.add.reduceat(_LETTER[b[place + np.repeat(s, n)]] * weight[place], own)
    return start, mix(h ^ size.astype(np.uint64))


def shingles(texts: list[str], size: int = 5) -> list[np.ndarray]:
    """The distinct shingles of each text, as sorted 64-bit hashes. Words are what ASCII white space parts, A-Z lower-cased. Fewer words than a shingle has: the whole sequence as one. No words: none."""
    parts = [t.encode().lower() for t in texts]
    first = np.cumsum([0, *(len(p) + 1 for p in parts)])
    start, flat = _word_hashes(b"\n".join(parts))
    edges = np.searchsorted(start, first)
    n = len(flat)
    run = np.zeros(n, dtype=np.uint64)
    for j in range(size if n >= size else 0):
        run[: n - size + 1] = mix(run[: n - size + 1] + flat[j : n - size + 1 + j])
    out = []
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if hi - lo >= size:
            out.append(np.unique(run[lo : hi - size + 1]))
        elif hi > lo:
            h = np.full(1, hi - lo, dtype=np.uint64)
            for x in flat[lo:hi]:
                h = mix(h + x)
            out.append(h)
        else:
            out.append(flat[:0])
    return out


def _offers(h: np.ndarray, doc: np.ndarray, best: np.ndarray, m: int) -> None:
    """Lowers best (sets x slots, flat) by what the elements h of the sets doc offer."""
    place = np.tile(np.arange(m, dtype=np.uint16), (len(h), 1))
    row, n = np.arange(len(h)), len(best) // m
    for j in range(m):
        live = best.reshape(n, m).max(axis=1) > j
        some = live[doc]
        if not some.any():
            break
        if not some.all():
            h, doc, row = h[some], doc[some], row[some]
        r = mix(h ^ mix(np.full(1, j + 1, dtype=np.uint64)))
        k = j + ((r & np.uint64(0xFFFFFF)) * np.uint64(m - j) >> np.uint64(24)).astype(np.int64)
        slot = place[row, k]
        place[row, k] = place[row, j]
        np.minimum.at(best, doc * m + slot, j + (r >> np.uint64(24)).astype(np.float64) * 2.0**-40)


def signatures(sets: list[np.ndarray], m: int, block: int = 10_000) -> np.ndarray:
    """The SuperMinHash signature of each set (infinite for empty ones), many sets at a time, and a set over `block` elements block by block.

    An element has a random permutation of the m slots and a random fraction for each of its places; place j offers
    the slot j + fraction, and a slot keeps its least offer. The permutation is drawn place by place (Fisher-Yates), for all elements of
    a block together, and a set stops at place j once all its slots hold less than j, as no later offer can be lower.
    """
    out = np.full((len(sets), m), np.inf)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    for at, to in batches_of(sizes[order], block):
        own = order[at:to]
        best = np.full(len(own) * m, np.inf)
        if len(own) == 1:
            for s in range(0, int(sizes[own[0]]), block):
                h = sets[own[0]][s : s + block]
                _offers(h, np.zeros(len(h), dtype=np.int64), best, m)
        else:
            _offers(np.concatenate([sets[i] for i in own]), np.repeat(np.arange(len(own)), sizes[own]), best, m)
        out[own] = best.reshape(len(own), m)
    return out


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """A hash per band of `rows` slots, other for each band."""
    bits = signature.view(np.uint64).reshape(len(signature), -1, rows)
    h = np.broadcast_to(np.arange(1, bits.shape[1] + 1, dtype=np.uint64), bits.shape[:2])
    for j in range(rows):
        h = mix(h + bits[:, :, j])
    return h.view(np.int64)


SIGNED = "doc_id long, n long, s1 long, s2 long, sig binary, bands array<long>"


def sums(sets: list[np.ndarray]) -> dict:
    """Columns n, s1 and s2 of sets of hashes."""
    return {
        "n": [len(s) for s in sets],
        "s1": np.array([np.add.reduce(s) for s in sets], dtype=np.uint64).view(np.int64),
        "s2": np.array([np.bitwise_xor.reduce(mix(s)) if len(s) else 0 for s in sets], dtype=np.uint64).view(np.int64),
    }


def _some(batches: Iterator[pd.DataFrame], size: int, most: int = 2 << 20) -> Iterator[tuple[pd.DataFrame, list[np.ndarray]]]:
    """Rows, some megabytes of text at a time, and their sets."""
    for b in batches:
        b = b.assign(text=b["text"].fillna(""))
        for at, to in batches_of(b["text"].str.len().to_numpy(dtype=np.int64), most):
            part = b.iloc[at:to]
            yield part, shingles(part["text"].tolist(), size)


def sign(docs: DataFrame, size: int, m: int, rows: int) -> DataFrame:
    """doc_id, set size, two sums over the set's hashes that tell equal sets, the signature (a byte a slot, which can only make slots agree that don't) and the bands."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, sets in _some(batches, size):
            sig = signatures(sets, m)
            low = mix(sig.view(np.uint64)).astype(np.uint8)
            yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), **sums(sets), "sig": [x.tobytes() for x in low], "bands": list(bands(sig, rows))})

    return docs.mapInPandas(run, SIGNED)


def set_texts(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n, s1, s2 and text of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, sets in _some(batches, size):
            yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), **sums(sets), "text": part["text"].to_numpy()})

    return docs.mapInPandas(run, "doc_id long, n long, s1 long, s2 long, text string")


def _forest(node: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the least one of its component."""
    root = roots(len(node), i, j)
    far = np.nonzero(root != np.arange(len(node)))[0]
    return node[root[far]], node[far]


def _like(g: pd.DataFrame, least: int, percent: int, side: int = 512, narrow: int = 8) -> pd.DataFrame:
    """A forest (a, b) over nodes of the same bucket whose sizes allow a link and whose signatures agree in `least` slots or more. Pairs of small buckets are compared all together, those of larger ones tile by tile."""
    g = g.sort_values(["key", "node"], ignore_index=True)
    sig = np.frombuffer(b"".join(g["sig"]), dtype=np.uint8).reshape(len(g), -1)
    low = np.ascontiguousarray(sig.T)
    key, n = g["key"].to_numpy(), g["n"].to_numpy()
    node, own = np.unique(g["node"].to_numpy(), return_inverse=True)
    edge = np.nonzero(np.append(True, key[1:] != key[:-1]))[0]
    count = np.diff(np.append(edge, len(g)))
    fits = lambda i, j: 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
    left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    wide = np.repeat(count > narrow, count)
    for d in range(1, narrow):
        i = np.nonzero((key[d:] == key[:-d]) & ~wide[d:])[0]
        i = i[fits(i, i + d)]
        for s in range(0, len(i), 1 << 16):
            x = i[s : s + (1 << 16)]
            x = x[(sig[x] == sig[x + d]).sum(axis=1) >= least]
            left.append(own[x])
            right.append(own[x + d])
    for lo, k in zip(edge[count > narrow].tolist(), count[count > narrow].tolist(), strict=True):
        ii, jj = [], []
        for x in range(lo, lo + k, side):
            for y in range(x, lo + k, side):
                p, q = np.arange(x, min(x + side, lo + k)), np.arange(y, min(y + side, lo + k))
                same = np.zeros((len(p), len(q)), dtype=np.uint16)
                for slot in low:
                    same += slot[p][:, None] == slot[q][None, :]
                i, j = np.nonzero((same >= least) & fits(p[:, None], q[None, :]))
                ii.append(i + x - lo)
                jj.append(j + y - lo)
        root = roots(k, np.concatenate(ii), np.concatenate(jj))
        far = np.nonzero(root != np.arange(k))[0]
        left.append(own[lo + root[far]])
        right.append(own[lo + far])
    a, b = _forest(node, np.concatenate(left), np.concatenate(right))
    return pd.DataFrame({"a": a, "b": b})


def _common(x: list[np.ndarray], y: list[np.ndarray], block: int = 4096) -> np.ndarray:
    """Sizes of the intersections of two lists of sets, as products of 0-1 matrices over elements that both lists hold, some columns at a time. Counts below 2^24 are exact in float32, those above go on in float64."""
    out = np.zeros((len(x), len(y)), dtype=np.float64)
    both = np.intersect1d(np.unique(np.concatenate(x)), np.unique(np.concatenate(y)), assume_unique=True)
    if not len(both):
        return out

    def cells(sets):
        flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(both, flat)
        at[at == len(both)] = 0
        held = both[at] == flat
        order = np.argsort(at[held], kind="stable")
        return row[held][order], at[held][order]

    (rx, cx), (ry, cy) = cells(x), cells(y)
    for s in range(0, len(both), block):
        m = []
        for r, c, k in ((rx, cx, len(x)), (ry, cy, len(y))):
            lo, hi = np.searchsorted(c, (s, s + block))
            dense = np.zeros((k, min(block, len(both) - s)), dtype=np.float32)
            dense[r[lo:hi], c[lo:hi] - s] = 1
            m.append(dense)
        out += m[0] @ m[1].T
    return out


def linked_sets(sets: list[np.ndarray], percent: int, some: np.ndarray | None = None, side: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) that join the components of the sets under links: pairs with 100 * intersection >= percent * union.

    First the set that shares most with the others is held against all; those that it doesn't reach are then held against all. With `some`, only
    pairs of which one is in `some` count.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.int64)

    def test(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        got = _common([sets[k] for k in p], [sets[k] for k in q])
        i, j = np.nonzero(100 * got >= percent * (size[p][:, None] + size[q][None, :] - got))
        return p[i], q[j]

    every = np.arange(n)
    ii, jj = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    if some is None:
        some = every
        if n > 8:
            flat = np.concatenate(sets)
            _, at, count = np.unique(flat, return_inverse=True, return_counts=True)
            held = np.add.reduceat(count[at].astype(np.float64), np.cumsum(size) - size) / size
            i, j = test(np.array([held.argmax()]), every)
            ii.append(i)
            jj.append(j)
            some = np.setdiff1d(every, j)
    for s in range(0, len(some), side):
        for t in range(0, n, side):
            i, j = test(some[s : s + side], every[t : t + side])
            ii.append(i)
            jj.append(j)
    root = roots(n, np.concatenate(ii), np.concatenate(jj))
    far = np.nonzero(root != every)[0]
    return root[far], far


def _arrays(blobs) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype="<u8") for x in blobs]


LINK = "a long, b long"


def verified(held: DataFrame, percent: int, most_nodes: int, most_shingles: int) -> DataFrame:
    """Links (a, b) that join the components of each family. held: (family, node, n, shared, set), shared telling how much of its buckets a node shares.

    A family of bounded size is one task's, and small ones share a task. Of a larger one, the node that shares most is held against all the others, dealt out in parts; those that it
    doesn't reach, in parts, meet every part of the family, each two in a task of their own, so that no task grows with a family, and a set goes once to a task however many pairs it is in there.
    """
    sizes = held.groupBy("family").agg(F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("shingles"), F.max_by("node", F.struct("shared", -F.col("node"))).alias("pivot"))
    parts = F.ceil(F.greatest(F.col("nodes") / (most_nodes / 2), F.col("shingles") / (most_shingles / 2))).cast("int")
    sizes = durable(sizes.withColumn("parts", F.when((F.col("nodes") > most_nodes) | ((F.col("shingles") > most_shingles) & (F.col("nodes") > 2)), parts).otherwise(F.lit(1))), "minhash-families")
    total, wide = sizes.agg(F.sum("shingles"), F.max("parts")).first()
    tasks = max(1, -(-(total or 0) // (most_shingles // 4)))

    def whole(g: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        for _, x in g.sort_values(["family", "node"]).groupby("family", sort=False):
            node = x["node"].to_numpy()
            i, j = linked_sets(_arrays(x["set"]), percent)
            a.append(node[i])
            b.append(node[j])
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    small = held.join(sizes.where("parts = 1").select("family"), "family")
    links = small.select("family", "node", "set", F.pmod(F.xxhash64("family"), F.lit(tasks)).alias("deal")).groupBy("deal").applyInPandas(whole, LINK)
    if (wide or 1) == 1:
        return durable(links, "minhash-links")
    large = held.join(sizes.where("parts > 1").select("family", "parts", "pivot"), "family").withColumn("part", F.pmod(F.xxhash64("node", F.lit(7)), "parts").cast("int"))

    def meet(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("node")
        node = g["node"].to_numpy()
        i, j = linked_sets(_arrays(g["set"]), percent, np.nonzero(g["first"].to_numpy())[0])
        return pd.DataFrame({"a": node[i], "b": node[j]})

    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    pivot = large.where("node = pivot").select("family", every.alias("part"), "node", "set", F.lit(True).alias("first"))
    others = large.where("node <> pivot").select("family", "part", "node", "set", F.lit(False).alias("first"))
    near = durable(pivot.unionByName(others).groupBy("family", "part").applyInPandas(meet, LINK), "minhash-near")
    # in each part the pivot's component is what it reaches, and the edges of its forest are the only ones
    reached = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
    out = durable(large.where("node <> pivot").join(reached, "node", "left_anti"), "minhash-apart")
    apart = out.groupBy("family").agg(F.ceil(F.greatest(F.count(F.lit(1)) / (most_nodes / 2), F.sum("n") / (most_shingles / 2))).cast("int").alias("groups"))
    group = F.pmod(F.xxhash64("node", F.lit(9)), F.col("groups")).cast("int")
    left = out.join(apart, "family").select("family", group.alias("group"), every.alias("part"), "node", "set", F.lit(True).alias("first"))
    right = large.join(apart, "family").select("family", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), "part", "node", "set", F.lit(False).alias("first"))
    # a node that is on both sides of a task goes there once
    right = right.join(out.join(apart, "family").select("node", group.alias("group")), ["node", "group"], "left_anti").select("family", "group", "part", "node", "set", "first")
    far = left.unionByName(right).groupBy("family", "group", "part").applyInPandas(meet, LINK)
    found = durable(links.unionByName(near).unionByName(far), "minhash-links")
    for x in (near, out):
        drop_durable(x)
    return found


def minhash_groups(docs: DataFrame, size: int = 5, percent: int = 75, n_bands: int = 36, rows: int = 4, part: int = 1000, most_nodes: int = 4096, most_shingles: int = 4 << 20) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs.

    Documents of equal sets are one node, its least id. Nodes that share a band are in a bucket; those of a bucket whose sizes and signatures
    agree as far as linked ones' do (five standard errors allowed) are of one family, as are all of a bucket of over `part` nodes. So linked nodes that share a
    band are in one family, and links are counted on whole sets inside families (see verified()). Only sets of families are
    shipped, once for each task that compares them. A pair right at the threshold misses all bands with probability (1 - 0.75^rows)^n_bands, about 1e-6.

    Null or empty text, or white space alone: an empty set, linked with nothing. Null ids: their rows link with nothing and are kept.
    Repeated rows of an id are one document, which holds each of their texts: each set of it is a node of its own, and the nodes of an id are one component.
    A set is held whole by the tasks that compare it, eight bytes a shingle. No rows: no rows. Other columns, whatever their names, are left out.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    m = n_bands * rows
    signed = durable(sign(own, size, m, rows), "minhash-signed")
    real = signed.where("n > 0 and doc_id is not null")
    least = real.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("node"))
    nodes = durable(real.join(least, ["n", "s1", "s2"]).where("doc_id = node").dropDuplicates(["n", "s1", "s2"]).select("n", "s1", "s2", "doc_id", "node", "sig", "bands"), "minhash-nodes")
    spent = [signed, nodes]
    known, merged = own.where("doc_id is not null").select(F.col("doc_id").alias("node"), "text"), None
    ends = [f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("n", "s1", "s2")]
    several = durable(signed.where("doc_id is not null").groupBy("doc_id").agg(*ends).where("min_n < max_n or min_s1 < max_s1 or min_s2 < max_s2").select("doc_id"), "minhash-several")
    if not several.isEmpty():
        nodes = named_nodes(nodes.drop("node").withColumnRenamed("doc_id", "id"), ["n", "s1", "s2"], real.select(F.col("doc_id").alias("id")), "minhash").withColumnRenamed("id", "doc_id")
        of_sets = set_texts(own.join(several, "doc_id", "left_semi"), size).join(nodes.select("n", "s1", "s2", "doc_id", "node"), ["n", "s1", "s2", "doc_id"])
        known = durable(own.where("doc_id is not null").join(several, "doc_id", "left_anti").select(F.col("doc_id").alias("node"), "text").unionByName(of_sets.select("node", "text")), "minhash-texts")
        held = real.join(several, "doc_id", "left_semi").select("doc_id", "n", "s1", "s2").join(nodes.select("n", "s1", "s2", "node"), ["n", "s1", "s2"]).select("doc_id", "node").distinct()
        first = held.groupBy("doc_id").agg(F.min("node").alias("a"))
        merged = durable(held.join(first, "doc_id").select("doc_id", "a", F.col("node").alias("b")), "minhash-merged")
        spent += [nodes, known]
    rows_ = nodes.select("node", F.explode("bands").alias("key"))
    buckets = rows_.groupBy("key").agg(F.count(F.lit(1)).alias("count"), F.min("node").alias("low")).where("count > 1")
    shared = durable(rows_.join(buckets, "key"), "minhash-shared")
    share = percent / 100
    agree = int(m * share - 5 * (m * share * (1 - share)) ** 0.5)
    deal = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-shared.count() // 10_000))))
    close = shared.where(F.col("count") <= part).select("key", "node", deal.alias("deal")).join(nodes.select("node", "n", "sig"), "node")
    like = close.groupBy("deal").applyInPandas(lambda g: _like(g, agree, percent), LINK)
    like = like.unionByName(shared.where((F.col("count") > part) & (F.col("node") > F.col("low"))).select(F.col("low").alias("a"), F.col("node").alias("b")))
    families = durable(components(like, "minhash").join(shared.groupBy("node").agg(F.sum("count").alias("shared")), "node").select("node", F.col("component").alias("family"), "shared"), "minhash-members")
    texts = known.join(few(families), "node")

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b, sets in _some(batches, size):
            yield pd.DataFrame({"family": b["family"].to_numpy(), "node": b["node"].to_numpy(), "n": [len(s) for s in sets], "shared": b["shared"].to_numpy(), "set": [s.tobytes() for s in sets]})

    # of the rows of a node, all are of one set
    sets = durable(texts.dropDuplicates(["node"]).mapInPandas(make, "family long, node long, n long, shared long, set binary"), "minhash-sets")
    links = verified(sets, percent, most_nodes, most_shingles)
    spent += [several, shared, families, sets, links]
    if merged is not None:
        links = links.unionByName(merged.where("a < b").select("a", "b"))
    first = components(links, "minhash")
    groups = nodes.join(first, "node", "left").select("n", "s1", "s2", "doc_id", "node", F.coalesce("component", "node").alias("component"))
    if merged is not None:  # a component's least node may be a hash
        named = groups.groupBy("component").agg(F.min("doc_id").alias("_name"))
        groups = durable(groups.join(named, "component").drop("component").withColumnRenamed("_name", "component"), "minhash-named")
        whole = groups.join(merged.where("a = b").select(F.col("doc_id").alias("_id"), F.col("a").alias("node")), "node").select("_id", F.col("component").alias("_whole"))
    out = signed.join(groups.select("n", "s1", "s2", "component"), ["n", "s1", "s2"], "left")
    if merged is not None:  # rows without shingles go with their document's others
        out = out.join(whole, F.col("doc_id") == F.col("_id"), "left").withColumn("component", F.coalesce("component", "_whole"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    out = durable(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "minhash-groups")
    for x in spent:
        drop_durable(x)
    return out


def digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return minhash_groups(docs)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2
), link AS (SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)
), reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x
), c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.x = d.doc_id
"""
