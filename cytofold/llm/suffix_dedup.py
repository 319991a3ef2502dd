"""Exact removal of long repeated substrings, by sorting suffixes in shards that hold all copies of a string."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from cytofold.llm.common import drop_durable, durable, new_dir
from cytofold.llm.decontamination import grams
from cytofold.llm.suffix import joined, ordered

CHUNK = "chunk long, bytes long, blob binary"
CLEAN = "doc_id long, n_bytes long, spans array<long>, kept binary"
_NONE = (1 << 63) - 1


def _pack(*parts) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(parts, protocol=5))


def _unpack(blob: bytes) -> tuple:
    import zstandard

    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


#: A region as it is sent: its document, row and first window, how many windows it has, and its anchor's hash.
REGION = np.dtype([("doc", "<i8"), ("row", "<i4"), ("lo", "<i8"), ("n", "<i4"), ("h", "<u4")])
REGIONS = "shard long, chunk long, meta binary, text binary, copies binary"


class Squeezer:
    """Bytes of some length compressed, shorter ones as they are, as a small piece gains nothing; a first byte tells which."""

    def __init__(self, least: int = 4096):
        import zstandard

        self.least, self._in, self._out = least, zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()

    def __call__(self, b: bytes) -> bytes:
        return b"\x01" + self._in.compress(b) if len(b) >= self.least else b"\x00" + b

    def back(self, b: bytes) -> bytes:
        return self._out.decompress(b[1:]) if b[0] else b[1:]


def parcels(chunk: int, to: np.ndarray, regions: np.ndarray, texts: bytes, size: np.ndarray, again: np.ndarray, copies: np.ndarray, squeeze: Squeezer) -> pd.DataFrame:
    """A row for each shard that gets something from a chunk. to, regions, size: of each region its shard, what it is, and its bytes' number in `texts`; again, copies: the shard and (row, lo, hi) of what the chunk has earlier itself.

    Everything is put in order of shards once and then cut, so a chunk's cost is that of its regions, however many shards there are, and there are never more rows than regions.
    """
    order, order2 = np.argsort(to, kind="stable"), np.argsort(again, kind="stable")
    start = np.cumsum(size) - size
    text = _gather(np.frombuffer(texts, dtype=np.uint8), start[order], size[order]).tobytes()
    meta, more = regions[order].tobytes(), np.ascontiguousarray(copies[order2]).tobytes()
    some = np.unique(np.concatenate([to, again]))
    cut = lambda x: (np.searchsorted(x, some), np.searchsorted(x, some, side="right"))
    (a, z), (a2, z2) = cut(to[order]), cut(again[order2])
    place = np.append(0, np.cumsum(size[order]))
    m, k = REGION.itemsize, 24
    rows = [(meta[i * m : j * m], squeeze(text[p:q]), more[i2 * k : j2 * k]) for i, j, p, q, i2, j2 in zip(a.tolist(), z.tolist(), place[a].tolist(), place[z].tolist(), a2.tolist(), z2.tolist(), strict=True)]
    out = pd.DataFrame(rows, columns=["meta", "text", "copies"])
    out.insert(0, "chunk", chunk)
    out.insert(0, "shard", some)
    return out


def _shard(g: pd.DataFrame, squeeze: Squeezer) -> list[tuple]:
    """What parcels() sent to a shard: (chunk, doc, row, lo, n, bytes, hash, copies) of each chunk."""
    out = []
    for c, meta, text, copies in zip(g["chunk"].tolist(), g["meta"], g["text"], g["copies"], strict=True):
        r = np.frombuffer(meta, dtype=REGION)
        out.append((c, r["doc"], r["row"].astype(np.int64), r["lo"], r["n"].astype(np.int64), squeeze.back(text), r["h"], np.frombuffer(copies, dtype=np.int64).reshape(-1, 3).T))
    return out


def chunks(docs: DataFrame, size: int) -> DataFrame:
    """Documents gathered into chunks of about `size` bytes: ids (the largest number for null), lengths and the bytes, compressed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk = TaskContext.get().partitionId() << 32
        ids, parts, held = [], [], 0

        def out():
            nonlocal chunk, ids, parts, held
            row = pd.DataFrame({"chunk": [chunk], "bytes": [held], "blob": [_pack(np.array(ids, dtype=np.int64), np.array([len(p) for p in parts], dtype=np.int64), b"".join(parts))]})
            chunk, ids, parts, held = chunk + 1, [], [], 0
            return row

        for b in batches:
            for i, t in zip(b["doc_id"].astype("Int64").fillna(_NONE).tolist(), b["text"].fillna("").tolist(), strict=True):
                ids.append(i)
                parts.append(t.encode())
                held += len(parts[-1])
                if held >= size:
                    yield out()
        if ids:
            yield out()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, CHUNK)


def _both(h: np.ndarray, other: np.ndarray, salt: int) -> np.ndarray:
    """A hash of two, which isn't 0."""
    x = (h * np.uint64(0x9E3779B97F4A7C15) + other + np.uint64(salt)) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) | np.uint64(1)


def anchors(sizes: np.ndarray, text: bytes, length: int, q: int, block: int = 1 << 17):
    """(hash, left, right, row, first window, windows) of each anchor of a chunk.

    A window is `length` bytes of one document; its anchor is the leftmost of its q-grams of least hash (of 40 bits), so windows of equal
    bytes have anchors of equal hash at equal places. Windows that follow each other mostly share one. Of what a window has beside its anchor, half or more is
    on one side; left and right are hashes of the anchor with so many bytes before and after it, 0 where the windows don't hold them. So equal windows have
    equal lefts or equal rights. Texts are gone through block by block, long ones as well, so that what is made on the way fits in a processor's cache.
    """
    end = np.cumsum(sizes)
    start, side, width = end - sizes, (length - q + 1) // 2, length - q + 1
    b, out = np.frombuffer(text, dtype=np.uint8), []
    low = np.uint64((1 << 24) - 1)
    for s in range(0, max(0, len(b) - length + 1), block):
        e = min(s + block, len(b) - length + 1)
        part = b[s : e + length - 1]
        h = grams(part, q)
        least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        k = 1
        while k * 2 <= width:
            least = np.minimum(least[:-k], least[k:])
            k *= 2
        if width > k:
            least = np.minimum(least[: len(least) - (width - k)], least[width - k :])
        place = (least & low).astype(np.int64)
        rows = np.arange(int(np.searchsorted(end, s, side="right")), int(np.searchsorted(start, e, side="left")))
        row = np.repeat(rows, np.minimum(end[rows], e) - np.maximum(start[rows], s))
        ok = np.arange(s + length, e + length) <= end[row]
        new = ok.copy()
        new[1:] &= (place[1:] != place[:-1]) | ~ok[:-1] | (row[1:] != row[:-1])
        first = np.nonzero(new)[0]
        if not len(first):
            continue
        upto = np.add.reduceat(ok.astype(np.int64), first)
        p, sides = place[first], grams(part, side)
        own = h[p]
        left, right = np.zeros(len(p), dtype=np.uint64), np.zeros(len(p), dtype=np.uint64)
        for to, at, fine, salt in ((left, p - side, p - first >= side, 1), (right, p + q, first + upto + length - 1 - (p + q) >= side, 2)):
            to[fine] = _both(own[fine], sides[at[fine]], salt)
        out.append((own, left, right, row[first], first + s - start[row[first]], upto))
    if not out:
        return (*(np.zeros(0, dtype=np.uint64) for _ in range(3)), *(np.zeros(0, dtype=np.int64) for _ in range(3)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _gather(b: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of many ranges, end to end."""
    end = np.cumsum(size)
    out = np.empty(int(end[-1]) if len(end) else 0, dtype=b.dtype)
    for s in range(0, len(start), 2000):
        x = slice(s, s + 2000)
        first = int(end[s] - size[s])
        out[first : end[x][-1]] = b[np.repeat(start[x] - (end[x] - size[x]), size[x]) + np.arange(first, int(end[x][-1]))]
    return out


def _same(b: np.ndarray, start: np.ndarray, size: np.ndarray, block: int = 1000) -> np.ndarray:
    """For each range the first one of equal bytes; ranges are told apart by two hashes, and a match is confirmed byte by byte. Goes block by block, as what it makes on the way is many times the bytes."""
    n = len(start)
    weight = np.random.default_rng(3).integers(1, 1 << 63, size=(2, int(size.max(initial=1))), dtype=np.uint64) | np.uint64(1)
    h = np.empty((2, n), dtype=np.uint64)
    for s in range(0, n, block):
        x = slice(s, min(n, s + block))
        part = b[start[x][0] : start[x][-1] + size[x][-1]].astype(np.uint64) + np.uint64(1)
        inner = np.arange(len(part)) - np.repeat(start[x] - start[s], size[x])
        for k in (0, 1):
            h[k, x] = np.add.reduceat(part * weight[k][inner], start[x] - start[s])
    order = np.lexsort((np.arange(n), size, h[1], h[0]))
    new = np.ones(n, dtype=bool)
    new[1:] = (h[0][order][1:] != h[0][order][:-1]) | (h[1][order][1:] != h[1][order][:-1]) | (size[order][1:] != size[order][:-1])
    first = np.empty(n, dtype=np.int64)
    first[order] = order[np.maximum.accumulate(np.where(new, np.arange(n), 0))]
    for s in range(0, n, block):
        x = np.arange(s, min(n, s + block))
        x = x[first[x] != x]
        if len(x):
            differ = _gather(b, start[first[x]], size[x]) != _gather(b, start[x], size[x])
            wrong = x[np.add.reduceat(differ.astype(np.int64), np.cumsum(size[x]) - size[x]) > 0]
            first[wrong] = wrong
    return first


def squeezed(shard: list[tuple], length: int) -> list[tuple]:
    """The same of a part of a shard, in which of regions that are equal only the earliest is left; the others are their chunks' copies."""
    chunk = np.concatenate([np.full(len(x[1]), x[0], dtype=np.int64) for x in shard])
    doc, row, lo, n, h = (np.concatenate([x[k] for x in shard]) for k in (1, 2, 3, 4, 6))
    b = np.frombuffer(b"".join(x[5] for x in shard), dtype=np.uint8)
    size = n + length - 1
    start = np.cumsum(size) - size
    order = np.lexsort((lo, row, chunk, doc))
    kept = np.zeros(len(n), dtype=bool)
    kept[order] = _same(_gather(b, start[order], size[order]), np.cumsum(size[order]) - size[order], size[order]) == np.arange(len(n))
    out, at = [], 0
    for x in shard:
        own = np.arange(at, at + len(x[1]))
        at += len(own)
        y, z = own[kept[own]], own[~kept[own]]
        out.append((x[0], doc[y], row[y], lo[y], n[y], _gather(b, start[y], size[y]).tobytes(), h[y], np.concatenate([x[7], np.stack([row[z], lo[z], lo[z] + size[z]])], axis=1)))
    return out


def repeated(shard: list[tuple], length: int, folder: str, budget: int) -> Iterator[tuple[int, np.ndarray]]:
    """(chunk, rows of (row, lo, hi)) of what goes from a shard's regions.

    shard: (chunk, doc id, row, first window, windows, bytes, anchor hash, copies) of each chunk's regions, a region being the windows of one anchor and all their bytes; copies (row, lo, hi) are
    those that a chunk has earlier itself. Regions that are equal go into the text once, with all their places; if an anchor hash has but one such, it has nothing to be compared with and stays out, as windows of
    equal bytes have their anchor at the same place. The suffixes of the text are put in order; windows whose common prefixes reach `length` are
    copies, and all but the earliest place go.
    """
    chunk = np.concatenate([np.full(len(x[1]), x[0], dtype=np.int64) for x in shard])
    doc, row, lo, n = (np.concatenate([x[k] for x in shard]) for k in (1, 2, 3, 4))
    b = np.frombuffer(b"".join(x[5] for x in shard), dtype=np.uint8)
    h = np.concatenate([x[6] for x in shard])
    size = n + length - 1
    start = np.cumsum(size) - size
    first = _same(b, start, size)
    order = np.lexsort((lo, row, chunk, doc))
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    least = np.full(len(order), len(order), dtype=np.int64)
    np.minimum.at(least, first, rank)
    earliest = least[first] == rank
    # a document's place in order, for windows that start in it
    same = np.append(True, (doc[order][1:] != doc[order][:-1]) | (row[order][1:] != row[order][:-1]) | (chunk[order][1:] != chunk[order][:-1]))
    document = np.empty(len(order), dtype=np.int64)
    document[order] = np.cumsum(same)
    own = np.nonzero(earliest)[0]
    _, kind, count = np.unique(h[own], return_inverse=True, return_counts=True)
    own = own[count[kind] > 1]
    text = joined([b[s : s + z].tobytes() for s, z in zip(start[own].tolist(), size[own].tolist(), strict=True)])
    base = np.cumsum(size[own] + 1) - size[own] - 1
    region = np.full(len(text), -1, dtype=np.int32)
    windows = np.repeat(base - (np.cumsum(n[own]) - n[own]), n[own]) + np.arange(int(n[own].sum()))
    region[windows] = np.repeat(np.arange(len(own), dtype=np.int32), n[own])
    groups, keys, places, g = [], [], [], 0
    for place, lcp in ordered(text, folder, length, budget):
        group = g + np.cumsum(lcp < length)
        g = int(group[-1])
        r = region[place]
        some = r >= 0
        place, r = place[some], r[some]
        groups.append(group[some])
        places.append(place)
        keys.append(document[own[r]] << np.int64(33) | (lo[own[r]] + place - base[r]))
    group, key, place = np.concatenate(groups), np.concatenate(keys), np.concatenate(places)
    goes = np.zeros(len(text) + 1, dtype=bool)
    if len(key):
        head = np.nonzero(np.append(True, group[1:] != group[:-1]))[0]
        stays = np.repeat(np.minimum.reduceat(key, head), np.diff(np.append(head, len(key)))) == key
        goes[place[~stays]] = True
    edge = np.diff(np.append(False, goes).astype(np.int8))
    a, z = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    r = region[a]
    rest = np.nonzero(~earliest)[0]
    who = np.concatenate([own[r], rest])
    gone = np.stack([row[who], np.concatenate([lo[own[r]] + a - base[r], lo[rest]]), np.concatenate([lo[own[r]] + z - base[r] + length - 1, lo[rest] + size[rest]])])
    of = np.concatenate([chunk[who], *[np.full(x[7].shape[1], x[0], dtype=np.int64) for x in shard]])
    gone = np.concatenate([gone, *[x[7] for x in shard]], axis=1)
    order = np.argsort(of, kind="stable")
    told, first = np.unique(of[order], return_index=True)
    for c, some in zip(told.tolist(), np.split(order, first[1:]), strict=True) if len(told) else ():
        yield c, gone[:, some]


def remove_repeats(docs: DataFrame, length: int = 100, q: int = 24, chunk: int = 4 << 20, shard: int = 6 << 20, budget: int = 256 << 20, fan: int = 1000) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of each row: the UTF-8 bytes less every byte of a string of `length` bytes that also starts earlier.

    Earlier: in a document of smaller id (null is the largest; rows of one id go by their place in the input), or before it in the same one. spans holds the
    ends of the removed runs in turn.

    1. Texts are gathered into compressed chunks, which are what is stored and joined. 2. Each window of `length` bytes is given to
    an anchor, its q-gram of least hash; hashes of a chunk's anchors with what is on either side, each twice at most, are dealt to buckets, which answer the chunks with those that occur twice
    anywhere. 3. Only the regions of such anchors are dealt to shards, by anchor hash, so all copies of a window meet; of regions that are equal, a chunk sends one, and
    where there are over `fan` chunks, parts of a shard of so many chunks leave one before they meet, so that what a shard gets of a passage that very many documents hold is one region for each part. Each shard sorts
    suffixes by induced sorting and says what goes. 4. Chunks are joined with that. Shards and buckets are as many as the bytes need.

    Null or empty text: no bytes. Texts shorter than `length` stay whole. A very long text is in one chunk, which is then longer than `chunk` bytes. No rows: no rows.
    Other columns are left out.
    """
    spark = docs.sparkSession
    stored = durable(chunks(docs, chunk), "suffix-chunks")
    total = stored.agg(F.sum("bytes")).first()[0] or 0
    buckets, shards, folder = max(1, total // (8 << 20)), max(1, total // shard), new_dir(spark, "suffix-spool")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for c, blob in zip(b["chunk"], b["blob"], strict=True):
                _, sizes, text = _unpack(blob)
                h = np.concatenate(anchors(sizes, text, length, q)[1:3])
                h, count = np.unique(h[h > 0], return_counts=True)
                h = np.repeat(h, np.minimum(count, 2))
                to = (h % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                some, first = np.unique(to[order], return_index=True)
                raw, edges = h[order].tobytes(), [8 * x for x in (*first.tolist(), len(h))]
                yield pd.DataFrame({"bucket": some, "chunk": c, "h": [raw[x:y] for x, y in zip(edges, edges[1:], strict=False)]})

    def answer(g: pd.DataFrame) -> pd.DataFrame:
        chunk = np.repeat(g["chunk"].to_numpy(), g["h"].str.len().to_numpy(dtype=np.int64) // 8)
        h = np.frombuffer(b"".join(g["h"]), dtype=np.uint64)
        _, kind, count = np.unique(h, return_inverse=True, return_counts=True)
        some = count[kind] > 1
        chunk, h = chunk[some], h[some]
        order = np.lexsort((h, chunk))
        chunk, h = chunk[order], h[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (chunk[1:] != chunk[:-1]) | (h[1:] != h[:-1])
        chunk, h = chunk[new], h[new]
        told, first = np.unique(chunk, return_index=True)
        raw, edges = h.tobytes(), [8 * x for x in (*first.tolist(), len(h))]
        return pd.DataFrame({"chunk": told, "h": [raw[x:y] for x, y in zip(edges, edges[1:], strict=False)]})

    asked = stored.select("chunk", "blob").mapInPandas(ask, "bucket long, chunk long, h binary")
    known = durable(asked.groupBy("bucket").applyInPandas(answer, "chunk long, h binary"), "suffix-known")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        squeeze = Squeezer()
        for b in batches:
            for c, blob, hs in zip(b["chunk"], b["blob"], b["hs"], strict=True):
                ids, sizes, text = _unpack(blob)
                h, left, right, row, lo, n = anchors(sizes, text, length, q)
                twice = np.frombuffer(b"".join(hs), dtype=np.uint64)
                some = np.nonzero(np.isin(left, twice) | np.isin(right, twice))[0]
                some = some[np.lexsort((lo[some], row[some], ids[row[some]]))]
                h, row, lo, n = h[some], row[some], lo[some], n[some]
                whole, start, size = np.frombuffer(text, dtype=np.uint8), np.cumsum(sizes) - sizes, n + length - 1
                held = _gather(whole, start[row] + lo, size)
                own = _same(held, np.cumsum(size) - size, size) == np.arange(len(n))
                to = ((h >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)
                regions = np.empty(int(own.sum()), dtype=REGION)
                for name, of in (("doc", ids[row]), ("row", row), ("lo", lo), ("n", n), ("h", h >> np.uint64(32))):
                    regions[name] = of[own]
                held = held[np.repeat(own, size)].tobytes()
                copies = np.stack([row, lo, lo + size], axis=1)[~own].astype(np.int64)
                yield parcels(c, to[own], regions, held, size[own], to[~own], copies, squeeze)

    told = known.groupBy("chunk").agg(F.collect_list("h").alias("hs"))
    regions = stored.select("chunk", "blob").join(told, "chunk").mapInPandas(cut, REGIONS)

    if (parts := -(-stored.count() // fan)) > 1:

        def squeeze(g: pd.DataFrame) -> pd.DataFrame:
            pack, k, rows = Squeezer(), int(g["shard"].iloc[0]), []
            for c, doc, row, lo, n, text, h, copies in squeezed(_shard(g, pack), length):
                regions = np.empty(len(doc), dtype=REGION)
                for name, of in (("doc", doc), ("row", row), ("lo", lo), ("n", n), ("h", h)):
                    regions[name] = of
                rows.append((k, c, regions.tobytes(), pack(text), np.ascontiguousarray(copies.T).tobytes()))
            return pd.DataFrame(rows, columns=["shard", "chunk", "meta", "text", "copies"])

        regions = regions.withColumn("part", F.pmod(F.xxhash64("chunk"), F.lit(parts))).groupBy("shard", "part").applyInPandas(squeeze, REGIONS)

    def sort(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(c, np.ascontiguousarray(x.T).tobytes()) for c, x in repeated(_shard(g, Squeezer()), length, folder, budget)], columns=["chunk", "gone"])

    gone = durable(regions.groupBy("shard").applyInPandas(sort, "chunk long, gone binary"), "suffix-gone")
    drop_durable(known)

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for blob, parts in zip(b["blob"], b["parts"], strict=True):
                ids, sizes, text = _unpack(blob)
                whole, start = np.frombuffer(text, dtype=np.uint8), np.cumsum(sizes) - sizes
                depth = np.zeros(len(whole) + 1, dtype=np.int32)
                row, lo, hi = np.frombuffer(b"".join(parts if parts is not None else ()), dtype=np.int64).reshape(-1, 3).T
                np.add.at(depth, start[row] + lo, 1)
                np.add.at(depth, start[row] + hi, -1)
                covered = np.cumsum(depth[:-1]) > 0
                rows = []
                for i, s, z in zip(ids.tolist(), start.tolist(), sizes.tolist(), strict=True):
                    mask = covered[s : s + z]
                    if mask.any():
                        spans = np.nonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))[0]
                        rows.append((None if i == _NONE else i, z, spans.tolist(), whole[s : s + z][~mask].tobytes()))
                    else:
                        rows.append((None if i == _NONE else i, z, [], text[s : s + z]))
                yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "spans", "kept"]).astype({"doc_id": "Int64"})

    by_chunk = gone.groupBy("chunk").agg(F.collect_list("gone").alias("parts"))
    return stored.select("chunk", "blob").join(by_chunk, "chunk", "left").select("blob", "parts").mapInPandas(clean, CLEAN)


def digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    out = remove_repeats(docs)
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
