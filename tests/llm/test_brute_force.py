"""Whole tables against plain computations, where SQL can't say what a query does."""

import hashlib
import itertools
import math
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cytofold.llm import decontamination, packing, quality, registry, suffix_dedup, token_counts, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_pieces_are_the_tokenizers(spark, docs):
    from tokenizers import Tokenizer

    path = registry.tokenizer_path()
    t = Tokenizer.from_file(path)
    p = registry.queries()["op5_packing"](spark, SF).toPandas()
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for d, own in p.sort_values("start").groupby("doc_id"):
        x = np.asarray([*t.encode(texts[d] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        assert own["length"].sum() == len(x) == own["doc_tokens"].iloc[0] and (own["start"] == own["length"].cumsum() - own["length"]).all()
        assert [zlib.crc32(x[s : s + m].tobytes()) for s, m in zip(own["start"], own["length"], strict=True)] == own["ids_crc32"].tolist()
    assert set(p["doc_id"]) == set(texts)
    for _, g in p.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"] == g["length"].cumsum() - g["length"]).all() and g["length"].sum() <= 1024
    assert p["length"].sum() > 0.95 * 1024 * p["sequence_id"].nunique()


def test_counts_are_the_unigram_models(spark, docs):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.Unigram(token_counts.vocabulary(registry.tokenizer_path("piece_bpe_32k.model")), 0))
    t.pre_tokenizer = pre_tokenizers.Metaspace()
    got = {r["doc_id"]: r["n_tokens"] for r in registry.queries()["op6_token_counts"](spark, SF).collect()}
    assert got == {r["doc_id"]: len(t.encode(r["text"] or "").ids) for r in docs.collect()}


def _removed(rows, length=100):
    """(n_removed, n_spans, sha256) by id, with a set of all strings so far."""
    seen, out = set(), {}
    for d, text in sorted(rows):
        b = (text or "").encode()
        gone = np.zeros(len(b) + 1, dtype=int)
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                gone[i] += 1
                gone[i + length] -= 1
            seen.add(b[i : i + length])
        mask = np.cumsum(gone[:-1]) > 0
        out[d] = (int(mask.sum()), int((np.diff(np.append(False, mask).astype(int)) == 1).sum()), hashlib.sha256(np.frombuffer(b, dtype=np.uint8)[~mask].tobytes()).hexdigest())
    return out


def test_removed_bytes_of_the_whole_table(spark, docs):
    want = _removed([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert {r["doc_id"]: (r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in registry.queries()["op9_suffix_dedup"](spark, SF).collect()} == want


def test_removed_bytes_when_queues_spill_and_chunks_are_small(spark, docs, tmp_path, monkeypatch):
    """The same with queues of a few kilobytes, which go to disk, several chunks and shards, and parts of shards that leave one of equal regions."""
    want = _removed([tuple(r) for r in docs.select("doc_id", "text").collect()])
    monkeypatch.setattr(suffix_dedup, "new_dir", lambda spark, tag: str(tmp_path / tag))
    out = suffix_dedup.remove_repeats(docs, chunk=1 << 15, shard=1 << 16, budget=1 << 13, fan=5)
    got = {r["doc_id"]: (r["n_bytes"] - r["left"], r["h"]) for r in out.select("doc_id", "n_bytes", F.octet_length("kept").alias("left"), F.sha2("kept", 256).alias("h")).collect()}
    assert got == {d: (n, h) for d, (n, _, h) in want.items()}
    assert (tmp_path / "suffix-spool").exists()


def test_anchors_don_t_depend_on_blocks():
    rng = np.random.default_rng(0)
    parts = [bytes(rng.integers(97, 100, n).astype(np.uint8)) for n in rng.integers(0, 900, 30)]
    parts += parts[5:9]
    sizes, text = np.array([len(p) for p in parts]), b"".join(parts)
    whole = suffix_dedup.anchors(sizes, text, 100, 24)
    some = suffix_dedup.anchors(sizes, text, 100, 24, block=333)
    window = lambda a: {(r, lo + k, h) for h, r, lo, n in zip(a[0].tolist(), a[3].tolist(), a[4].tolist(), a[5].tolist(), strict=True) for k in range(n)}
    assert window(whole) == window(some)
    assert {(r, k) for r, k, _ in window(whole)} == {(r, k) for r, p in enumerate(parts) for k in range(len(p) - 99)}


def _nearest(probe: str, text: str) -> int:
    """The least edit distance of probe to any part of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(probe, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            last, row[j] = row[j], min(last + (c != d), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_leaks_of_a_small_fixture(spark):
    rng = np.random.default_rng(3)
    alphabet = "abcdefgh é中文"
    say = lambda n: " ".join("".join(rng.choice(list(alphabet), n)).split())
    items = [(k, say(int(rng.integers(45, 140)))) for k in range(8)] + [(90, "x1 y2"), (91, "中文中")]
    rows = []
    for d in range(24):
        text = list(say(150))
        if d % 2:
            part = list(items[int(rng.integers(8))][1])
            for at in rng.integers(0, len(part), int(rng.integers(0, 14))):
                part[at] = str(rng.choice(list(alphabet + "q")))
            text += [" ", *part, " "]
        if d % 5 == 0:
            text += list(" x1 y2.")
        rows.append((d, "".join(text) + say(40)))
    index = decontamination.Index(items)
    want = set()
    for (d, text), k in itertools.product(rows, range(len(index.probes))):
        probe = "".join(map(chr, index.probes[k].tolist()))
        if _nearest(probe, decontamination.normal(text)) <= index.edits[k]:
            want.add((d, int(index.ids[k])))
    want |= {(d, 90) for d, text in rows if " x1 y2 " in f" {decontamination.normal(text)} "} | {(d, 91) for d, text in rows if "中文中" in decontamination.normal(text)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontamination.digest(spark, docs, spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], i) for r in got.collect() for i in r["item_ids"]} == want and len({i for _, i in want}) > 5
    small = decontamination.Index(items)
    texts = [decontamination.normal(t) for _, t in rows]
    # texts gone through in parts, and candidates in small steps
    assert [{x[0] for x in leaks} for leaks in small(texts, block=420)] == [{i for d, i in want if d == k} for k in range(len(rows))]
    plain = small._regions
    small._regions = lambda text, start: plain(text, start, most=50)
    assert small(texts) == index(texts)


def test_telling_features_and_probabilities(spark):
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for d in range(400):
        toxic = d % 4 == 0
        words = [f"w{x}" for x in rng.integers(0, 60, 12)] + (["scum", "vile"][: 1 + d % 8 // 4] if toxic and d % 40 else [])
        rows.append((d, " ".join(words)))
        labels.append((d, int(toxic)))
    docs, labs = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    chain = toxicity.train(docs, labs)
    own = [(set(f for w in toxicity.words(t) for f in toxicity.shown(w)), y) for (_, t), (_, y) in zip(rows, labels, strict=True)]
    once = {(frozenset(fs), y) for fs, y in own}
    n1, n0 = sum(y for _, y in once), sum(1 - y for _, y in once)
    told, every = {}, set().union(*(fs for fs, _ in once))
    least = math.sqrt(2 * math.log(sum(sum(f in fs for fs, _ in once) >= 5 for f in every)))
    for f in every:
        a, b = sum(y for fs, y in once if f in fs), sum(1 - y for fs, y in once if f in fs)
        term = lambda o, e: o * math.log(o / e) if o else 0.0
        s = (a + b) / (n1 + n0)
        g = 2 * (term(a, n1 * s) + term(b, n0 * s) + term(n1 - a, n1 * (1 - s)) + term(n0 - b, n0 * (1 - s)))
        if a + b >= 5 and math.sqrt(max(g, 0)) >= least:
            told.setdefault((round(g, 6), frozenset(i for i, (fs, _) in enumerate(once) if f in fs)), set()).add(f)
    assert len(chain.vocabulary) == len(told) and all(len(fs & set(chain.vocabulary)) == 1 for fs in told.values())
    got = {r["doc_id"]: r["_toxicity"] for r in toxicity.toxicity(docs, chain).collect()}
    for d, (fs, _) in enumerate(own):
        x, odds = [float(f in fs) for f in chain.vocabulary], []
        for name, w in zip(chain.names, chain.links, strict=True):
            odds.append(min(15.0, max(-15.0, float(np.dot([*x, *odds, 1.0], w)))))
            assert abs(got[d][name] - 1 / (1 + math.exp(-odds[-1]))) < 1e-9
    assert np.mean([(got[d]["toxic"] >= 0.5) == (y == 1) for d, y in labels]) > 0.96


def test_out_of_fold_accuracy_of_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    mine = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    chain = toxicity.train(docs, labels, where=~mine)
    p = toxicity.toxicity(docs.select("doc_id", "text").where(mine), chain).join(labels, "doc_id").select("toxic", F.col("_toxicity.toxic").alias("p")).toPandas()
    assert ((p["p"] >= 0.5) == (p["toxic"] == 1)).mean() > 0.95 and ((p["p"] >= 0.5) & (p["toxic"] == 0)).mean() < 0.01


def test_line_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    field = quality.Chain(37)
    field.t = rng.normal(size=(2, 2))
    e, start, size = rng.normal(size=11), np.array([0, 1, 6]), np.array([1, 5, 5])
    got = field._walk(e, start, size, field.t)
    for s, n in zip(start, size, strict=True):
        total, good = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=int(n)):
            w = math.exp(sum(e[s + k] for k in range(n) if y[k]) + sum(field.t[a, b] for a, b in itertools.pairwise(y)))
            total += w
            good += w * np.array(y)
        assert np.allclose(got[s : s + n], good / total)


def test_long_documents_are_fitted_whole():
    rng = np.random.default_rng(0)
    texts = ["\n".join(("Good plain words here." if k % 2 else "@@ ## $$ %% !!") + f" {x}" for x in rng.integers(0, 99, 900)) for k in range(12)]
    field = quality.fitted(texts, np.array([k % 2 for k in range(12)], dtype=float), longest=100)
    assert ((field.documents(texts) > 0.5) == np.array([bool(k % 2) for k in range(12)])).all()


def test_slices_say_what_one_says(spark):
    rng = np.random.default_rng(1)
    say = lambda n: " ".join("".join(chr(97 + x) for x in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(n))
    items = [(k, say(30)) for k in range(12)]
    docs = spark.createDataFrame(pd.DataFrame({"doc_id": range(6), "text": [say(20) + " " + items[2 * k][1] + " " + say(5) for k in range(6)]}))
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = lambda **o: sorted((r["doc_id"], sorted(map(tuple, r["_leaks"]))) for r in decontamination.decontaminate(docs, bench, **o).collect())
    assert rows() == rows(slice_bytes=600) and all(len(x) == 1 for _, x in rows())


@pytest.mark.parametrize("name", ["op1_decontamination", "op2_toxicity", "op7_quality"])
def test_query_has_a_row_per_document(spark, docs, name):
    got = registry.queries()[name](spark, SF)
    assert sorted(r["doc_id"] for r in got.select("doc_id").collect()) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())


def test_packed_rows_repeat(spark, docs):
    a, b = (packing.pack(docs, registry.tokenizer_path()).toPandas().sort_values(["doc_id", "start"], ignore_index=True) for _ in range(2))
    pd.testing.assert_frame_equal(a[["doc_id", "start", "length", "ids_crc32"]], b[["doc_id", "start", "length", "ids_crc32"]])
