"""Runs against a search of every period, on small words of few letters, odd rows and a whole table."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytofold.llm import periodic_runs


def plain(words, min_words=24, times=3):
    """Every maximal stretch of every period whose smallest period it is."""
    code: dict = {}
    x = np.array([code.setdefault(w, len(code)) for w in words], dtype=np.int64)
    out = []
    for q in range(1, len(words) // times + 1):
        edge = np.flatnonzero(np.diff(np.concatenate([[False], x[q:] == x[:-q], [False]]).astype(np.int8))).reshape(-1, 2)
        for s, e in edge.tolist():
            n = e - s + q
            y = x[s : s + n]
            if n >= max(min_words, times * q) and not any((y[d:] == y[:-d]).all() for d in range(1, q)):
                out.append((s, q, n))
    return sorted(out)


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        a = (h // 10) % n
        p = 1 + (n - a) // (3 + (h // 10) % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = plain(words)
    gone = {i for s, q, k in found for i in range(s + q, s + k)}
    best = max(found, key=lambda r: (r[2] / r[1], -r[0], -r[1]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id,
        len(found),
        *((best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4),
        sha("".join(f"{s},{k},{q}\n" for s, q, k in found)),
        sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def periodic(rng, n, letters):
    w = [b"%d" % rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        if n > 5:
            a, p = rng.randrange(n), rng.randint(1, max(1, n // 4))
            for i in range(a + p, n):
                w[i] = w[i - p]
    return w


@pytest.mark.parametrize("seed", range(6))
def test_small_alphabets(seed):
    rng = random.Random(seed)
    for _ in range(150):
        w = periodic(rng, rng.randint(0, 130), rng.choice([1, 2, 2, 3, 5]))
        for least, times in ((24, 3), (4, 2), (6, 3), (30, 4)):
            assert periodic_runs.runs(w, least, times) == plain(w, least, times)


def test_automaton_is_one():
    """Every substring is accepted, and states are as many as there are sets of end positions."""
    rng = random.Random(5)
    for _ in range(40):
        w = [rng.randrange(3) for _ in range(rng.randint(1, 30))]
        a = periodic_runs.Automaton(w, 3)
        ends = {}
        for i in range(len(w)):
            for j in range(i + 1, len(w) + 1):
                ends.setdefault(tuple(w[i:j]), set()).add(j)
                s = 0
                for c in w[i:j]:
                    s = a._next(s, c)
                    assert s > 0
        assert len(a.size) == 1 + len({frozenset(x) for x in ends.values()})


def test_long_and_one_word():
    assert periodic_runs.runs([b"z"] * 50_000) == [(0, 1, 50_000)]
    w = [b"%d" % (k % 4000) for k in range(20_000)]
    assert periodic_runs.runs([b"x", *w, b"y"]) == [(1, 4000, 20_000)]


def test_odd_rows(spark):
    rng = random.Random(9)
    cycle = " ".join(f"c{k}" for k in range(9))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, f"{cycle} " * 4), (4, f"{cycle} " * 4), (5, "A\xa0b " * 30), (6, "na " * 23), (7, "na " * 24), (8, "x " * 200_000), (10, "ñ é " * 100)]
    rows += [(k, b" ".join(periodic(rng, 80, 2)).decode()) for k in range(20, 120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = periodic_runs.digest(spark, df.withColumns({c: F.lit("mine") for c in ("r", "start", "_runs", "words")})).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(plain_row(*r)) for r in rows)
    assert periodic_runs.digest(spark, df.where("false")).count() == 0
    null = periodic_runs.digest(spark, spark.createDataFrame([(None, "na " * 30)], df.schema)).first()
    assert null["doc_id"] is None and (null["start"], null["length"], null["period"]) == (0, 30, 1)
    out = periodic_runs.periodic_runs(df.withColumn("_runs", F.lit(1)).withColumn("start", F.lit("mine"))).where("doc_id = 4").first()
    assert out["start"] == "mine" and out["_runs"]["start"] == [0] and out["_runs"]["text"] == cycle


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted(repr(plain_row(r["doc_id"], r["text"])) for r in docs.select("doc_id", "text").collect())
    got = [tuple(r) for r in periodic_runs.digest(spark, docs).collect()]
    assert sorted(map(repr, got)) == want
    assert sum(r[1] > 0 for r in got) > 5
