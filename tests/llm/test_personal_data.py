"""Base spans against the patterns taken literally, the tagger's gradients and decoding against enumeration, held-out recall, and odd rows."""

import hashlib
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytofold.llm import personal_data as pd_

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def plain(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text or ""):
            d = [int(c) for c in m[0] if c in "0123456789"]
            twice = [x * 2 - 9 * (x > 4) if i % 2 else x for i, x in enumerate(reversed(d))]
            ok = (True, k == 1 and all(int(x) <= 255 for x in re.findall("[0-9]+", m[0])), 16 <= len(d) <= 19 and sum(twice) % 10 == 0, 8 <= len(d) <= 15)[k]
            if ok:
                out.append((k, m.start(), m.end()))
    return out


def row(text):
    spans = plain(text)
    said = ",".join(f"{pd_.KINDS[k]}:{s}:{e}" for k, s, e in spans)
    return [sum(k == x for x, _, _ in spans) for k in range(4)], hashlib.sha256(said.encode()).hexdigest(), said


def test_base_spans():
    rng = np.random.default_rng(0)
    letters = list("a1@.-+ ()0%5") + ["4111 1111 1111 1111", "1.2.3.4", "a.b@c.de", "+1 (499) 555-6503", "é", "\n", "256.1.1.1", "00000000001.2.3.4"]
    for _ in range(4000):
        t = "".join(rng.choice(letters, int(rng.integers(0, 25))))
        assert pd_.base_spans(t) == plain(t), t


def test_long_texts_take_linear_time():
    n = 400_000
    for t in ("z" * n, "1" * n, "a@" * n, "1." * n, "+1 " * n, "@a." * n, "1 " * n, "a." * n + "@"):
        pd_.base_spans(t)


def test_gradients():
    x, y = pd_.examples(["write to some.one@mail.example.com or +1 (499) 555-6503 now, card 4111111111111111 at 10.20.30.40 please"] * 3, 24, 6)
    tagger = pd_.Tagger(5, seed=3)
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    _, g = tagger.loss(x, y)
    rng = np.random.default_rng(1)
    for k, v in tagger.p.items():
        for _ in range(4):
            at = tuple(int(rng.integers(0, n)) for n in v.shape)
            was, two = v[at], []
            for step in (1e-3, -1e-3):
                v[at] = was + step
                two.append(tagger.loss(x, y)[0])
            v[at] = was
            assert (two[0] - two[1]) / 2e-3 == pytest.approx(float(g[k][at]), rel=0.03, abs=3e-3)


def test_decoding_is_the_best_chain():
    tagger = pd_.Tagger(4, seed=5)
    tagger.p["trans"] = np.random.default_rng(2).standard_normal(tagger.p["trans"].shape).astype(np.float32)
    x = np.random.default_rng(3).integers(0, pd_.N_CLASSES, (4, 6))
    y, _ = tagger.decode(x)
    e, step = tagger.emissions(x)[0].astype(float), tagger._step()
    for r in range(6):
        score = lambda c, r=r: tagger.allowed[0][c[0]] + sum(e[t, r, c[t]] for t in range(4)) + sum(step[c[t - 1], c[t]] for t in range(1, 4))
        best = max(itertools.product(range(pd_.N_TAGS), repeat=4), key=score)
        assert tuple(y[:, r]) == best
        # and the loss is minus the log share of the chain among all
        total = np.logaddexp.reduce([score(c) for c in itertools.product(range(pd_.N_TAGS), repeat=4)])
        assert tagger.loss(x[:, [r]], np.array(best)[:, None])[0] == pytest.approx(total - score(best), abs=1e-4)


def test_reconciling():
    rng = np.random.default_rng(4)
    for _ in range(300):
        found = [(float(rng.random()), int(rng.integers(0, 4)), s, s + int(rng.integers(1, 6))) for s in rng.integers(0, 15, int(rng.integers(0, 8))).tolist()]
        base = [(0, 5, 8)] if rng.random() < 0.5 else []
        got = pd_.reconciled(found, base)
        apart = lambda xs: all(a[2] <= b[1] for a, b in itertools.pairwise(sorted(xs, key=lambda x: x[1])))
        best: dict = {}
        for c, *x in found:
            best[tuple(x)] = max(c, best.get(tuple(x), 0))
        fine = [x for x in best if not any(x[1] < e and s < x[2] for _, s, e in base)]
        most = max(sum(best[x] for x in xs) for n in range(len(fine) + 1) for xs in itertools.combinations(fine, n) if apart(xs))
        assert apart(got) and sum(best[x] for x in got) == pytest.approx(most)


@pytest.fixture(scope="module")
def finder(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 3 > 0")
    return pd_.train(docs)


def test_held_out(spark, finder):
    """On documents that it wasn't fitted on, the tagger by itself finds the base spans, also when they are redrawn and disguised, and nothing in texts without personal data."""
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 3 = 0").select("text").collect()]
    rng = np.random.default_rng(6)

    def recall(texts, wanted):
        got: dict = {}
        for i, _, k, s, e in finder.candidates(texts):
            if cut := pd_._trimmed(texts[i], k, s, e):
                got.setdefault(i, set()).add((k, *cut))
        hit = sum(x in got.get(i, ()) for i, xs in enumerate(wanted) for x in xs)
        return hit / sum(map(len, wanted))

    rich = [(t, s) for t in texts if (s := pd_.base_spans(t))]
    assert recall([t for t, _ in rich], [s for _, s in rich]) > 0.93
    new = [pd_.redrawn(t, s, rng) for t, s in rich]
    fine = [[(k, s, e) for k, s, e in spans if k in (0, 1, 3)] for _, spans in new]
    assert recall([t for t, _ in new], fine) > 0.7
    clean = [t for t in texts if not pd_.base_spans(t)]
    added = sum(len(x) for x in finder.spans(clean))
    assert added <= 0.002 * len(clean)


def test_adds_what_the_patterns_miss(finder):
    texts = [
        "this is the thing that she said to him about some.one @ mail3.example.com and then went home",
        "on the other hand 87 4521940886194967 was what they had all paid with in the end of it",
        "they were at 10[.]22[.]31[.]44 for the whole of the time and no one knew about it",
    ]
    assert [[(k, t[s:e]) for k, s, e, base in x if not base] for t, x in zip(texts, finder.spans(texts), strict=True)][0][:1] == [(0, "some.one @ mail3.example.com")]
    assert all(not pd_.base_spans(t) for t in texts)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r["doc_id"]: row(r["text"]) for r in docs.select("doc_id", "text").collect()}
    got = pd_.digest(spark, docs).collect()
    assert len(got) == len(want) == docs.count()
    for r in got:
        n, sha, said = want[r["doc_id"]]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == n and r["base_sha256"] == sha
        assert set(filter(None, said.split(","))) <= set(r["spans"].split(","))
        assert len(list(filter(None, r["spans"].split(",")))) == sum(n) + r["n_added"]


def test_odd_rows(spark):
    mail = "a.b@c.de"
    rows = [(1, None), (2, ""), (3, mail), (3, mail), (None, mail), (4, f"é😀 {mail} 1.2.3.4 +1 (499) 555-6503"), (5, "7" * 3_000), (6, ("word " * 40 + mail + " ") * 8000), (7, "4111 1111 1111 1111")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = pd_.digest(spark, df.withColumns({c: F.lit("mine") for c in ("kind", "start", "p", "s", "_personal", "h")})).collect()
    assert sorted((r["doc_id"] or 0, r["n_email"], r["base_sha256"]) for r in got) == sorted((i or 0, row(t)[0][0], row(t)[1]) for i, t in rows)
    assert next(r for r in got if r["doc_id"] == 4)["spans"] == "email:3:11,ip:12:19,phone:20:37"
    assert pd_.digest(spark, df.where("false")).count() == 0
    assert pd_.digest(spark, df.where("doc_id = 2")).first()["spans"] == ""
    out = pd_.personal_data(df.withColumn("kind", F.lit("mine")), pd_.train(df.where("false")))
    assert out.where("kind = 'mine'").count() == len(rows) and out.where("doc_id = 3 and size(_personal.kind) = 1").count() == 2
