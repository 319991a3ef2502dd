"""Packing of token sequences into windows of bounded length by multiway differencing."""

from __future__ import annotations

import heapq
import os
import re
import sys
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from cytofold.llm.common import durable

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, slot long"
WINDOWS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: The characters that are white space to the tokenizer's pattern.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: the pattern that parts text before merges in byte-level BPE.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CHUNK = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")


def _ranked(path: str):
    """The tokenizer's own merges as a table of ranks, which the rank encoder applies several times as fast to a single chunk; None if it isn't plain byte-level BPE whose ids follow its merges."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or spec.get("normalizer") or sys.byteorder != "little":
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    ids = [model["vocab"][m] for m in merged]
    if ids != sorted(ids) or len(set(ids)) != len(ids):
        return None
    ranks = {bytes(of[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    return tiktoken.Encoding("chunks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Token ids of whole texts, exactly as the tokenizer gives them.

    The byte-level pattern always ends a piece before white space that follows something else. So white space with what
    follows it is encoded on its own, and remembered. Texts that may hold a special token go to the tokenizer whole. The
    memory is emptied when it holds `room` chunks.
    """

    def __init__(self, path: str, room: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.room = Tokenizer.from_file(path), {}, room
        self.ranks = _ranked(path)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(x.ids, dtype="<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def chunks(self, texts: list[str]) -> list[bytes]:
        if self.ranks is None:
            return self.whole(texts)
        encode = self.ranks.encode_ordinary
        return [array("I", encode(t)).tobytes() for t in texts]

    def __call__(self, texts: list[str]) -> list[bytes]:
        known = self.known
        split = [None if "<|" in t else _CHUNK.findall(t) for t in texts]
        new: set[str] = set()
        for parts in split:
            if parts:
                new.update(parts)
        new = {x for x in new if x not in known}
        if len(known) + len(new) > self.room:
            known.clear()
            new = {x for parts in split if parts for x in parts}
        if new:
            order = list(new)
            known.update(zip(order, self.chunks(order), strict=True))
        get = known.__getitem__
        return [self.whole([t])[0] if parts is None else b"".join(map(get, parts)) for t, parts in zip(texts, split, strict=True)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One to a Python worker, so that tasks share what is remembered."""
    return Encoder(path)


def cut(n: int, window: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of pieces of n tokens: full windows, and what is left in near-equal pieces of `most` tokens at most."""
    full = n // window
    out = [(k * window, window) for k in range(full)]
    if rest := n - full * window:
        parts = -(-rest // most)
        edges = [full * window + rest * k // parts for k in range(parts + 1)]
        out += [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
    return out


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, window: int = 1024, most: int = 256) -> DataFrame:
    """Each document's ids and then end_id, cut up; a piece carries the CRC-32 of its little-endian 32-bit ids. Null text: end_id alone."""

    def run(batches):
        encode, end = encoder(tokenizer), np.asarray([end_id], dtype="<u4").tobytes()
        slot = TaskContext.get().partitionId() << 34
        for batch in batches:
            texts = batch["text"].fillna("").tolist()
            for at in range(0, len(texts), 512):
                rows = []
                for doc, b in zip(batch["doc_id"].iloc[at : at + 512], encode(texts[at : at + 512]), strict=True):
                    b += end
                    view, n = memoryview(b), len(b) // 4
                    for s, m in cut(n, window, most):
                        rows.append((doc, s, m, zlib.crc32(view[4 * s : 4 * (s + m)]), n, slot))
                        slot += 1
                yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "slot"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, PIECES)


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window, of k, of each size, by Karmarkar-Karp multiway differencing.

    A partial partition has k sums. The two of greatest spread are merged again and again, the largest sums of one with the
    smallest of the other, until one is left. Ties go by age, so that the result depends on the sizes alone.
    """
    n = len(sizes)
    sums, nodes, heap = {}, {}, []
    for i, x in enumerate(sizes.tolist()):
        s, v = np.zeros(k, dtype=np.int64), np.full(k, -1, dtype=np.int64)
        s[0], v[0] = x, i
        sums[i], nodes[i] = s, v
        heap.append((-x if k > 1 else 0, i))
    heapq.heapify(heap)
    count, left, right, firsts = n, [], [], []
    new = n
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        s = sums.pop(a) + sums.pop(b)[::-1]
        x, y = nodes.pop(a), nodes.pop(b)[::-1]
        both = (x >= 0) & (y >= 0)
        v = np.maximum(x, y)
        if m := int(np.count_nonzero(both)):
            left.append(x[both])
            right.append(y[both])
            firsts.append(count)
            v[both] = np.arange(count, count + m)
            count += m
        order = np.argsort(-s, kind="stable")
        s, v = s[order], v[order]
        sums[new], nodes[new] = s, v
        heapq.heappush(heap, (int(s[-1] - s[0]), new))
        new += 1
    window = np.full(count, -1, dtype=np.int64)
    if heap:
        v = nodes[heap[0][1]]
        window[v[v >= 0]] = np.nonzero(v >= 0)[0]
    for at, x, y in zip(reversed(firsts), reversed(left), reversed(right), strict=True):
        w = window[at : at + len(x)]
        window[x], window[y] = w, w
    return window[:n]


def fill(sizes: np.ndarray, window: int) -> np.ndarray:
    """The window of each size, windows near-equal and none over `window`; their number starts at the least and rises whenever one is too full."""
    k = max(1, -(-int(sizes.sum()) // window))
    while True:
        got = difference(sizes, k)
        over = int(np.bincount(got, weights=sizes, minlength=k).max()) - window
        if over <= 0:
            return got
        k += max(1, over * k // (2 * window))


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, window: int = 1024, most: int = 256, group: int = 1024) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's full windows are sequences of their own. The rest is cut into pieces of at most `most` tokens, dealt
    by a hash of their place to groups of about `group` pieces (however many documents there are), and each group is packed on its own; a
    group wastes less than a window or two. The tokens themselves are never shuffled, only their places.

    Null or empty text: end_id alone. A very long text is one row to the tokenizer, and as many sequences as it fills. Null ids stay null; repeated rows are packed one by one;
    no documents: no rows. Other columns are left out.
    """
    cuts = durable(pieces(docs, tokenizer, end_id, window, most), "pieces")
    rest = cuts.where(F.col("length") < window)
    groups = max(1, -(-rest.count() // group))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("slot", ignore_index=True)
        got = fill(g["length"].to_numpy(dtype=np.int64), window)
        g["sequence_id"] = (g["g"].iloc[0] * (1 << 20) + got) * 2
        order = np.argsort(got, kind="stable")
        g = g.iloc[order]
        g["offset"] = g.groupby("sequence_id", sort=False)["length"].cumsum() - g["length"]
        return g[[x.split()[0] for x in WINDOWS.split(", ")]]

    packed = rest.withColumn("g", F.pmod(F.xxhash64("slot"), F.lit(groups))).groupBy("g").applyInPandas(run, WINDOWS)
    full = cuts.where(F.col("length") == window).withColumns({"sequence_id": F.col("slot") * 2 + 1, "offset": F.lit(0).cast("long")}).drop("slot")
    return packed.unionByName(full)


def digest(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    return pack(docs, tokenizer)
