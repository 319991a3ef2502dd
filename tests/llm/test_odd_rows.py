"""Every operator on null, empty, very long, equal and repeated rows, on empty tables, and beside columns of the names that it uses itself."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytofold.llm import decontamination, embedding_dedup, line_dedup, minhash_dedup, packing, quality, registry, suffix_dedup, token_counts, toxicity, warc

NAMES = "_id _lost _left _lines _leaks _more _toxicity score n_tokens node key n s1 s2 sig bands row id links least a b v d bucket part family shared deal kept component_id n_links slot g start length offset sequence_id chunk blob bytes h label fold mark fs at page url html payload count hash unit".split()
LONG = 10 << 20
LINE = "a line of over forty characters that many documents hold"


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(0)
    words = np.array(["".join(chr(97 + x) for x in rng.integers(0, 26, n)) for n in rng.integers(2, 9, 4000)])
    long = "\n".join(" ".join(x) for x in words[rng.integers(0, 4000, (LONG // 60, 10))])[:LONG]
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "another text of the same id"), (None, None), (None, "x y"), (2, ""), (3, "A  b c\nd e f g"), (4, "z" * 5000), (5, long), (6, long + " more")]
    rows += [(10 + k, f"{LINE}\nown words of number {k}") for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    return df.withColumns({c: F.lit(f"my {c}") for c in NAMES})


def _kept(out, but=()):
    """Whether the columns that an operator doesn't make came through."""
    return all(out.where(F.col(f"`{c}`") != f"my {c}").isEmpty() for c in NAMES if c not in but and c in out.columns) and set(NAMES) - set(but) <= set(out.columns)


def test_line_dedup(odd):
    out = line_dedup.line_dedup(odd)
    assert _kept(out, ["_lines"])
    got = {r["doc_id"]: tuple(r["l"]) for r in out.where("doc_id >= 10").select("doc_id", F.struct("_lines.n_lines", "_lines.n_dropped", "_lines.text").alias("l")).collect()}
    assert got == {10 + k: (2, int(k < 5), f"own words of number {k}" if k < 5 else f"{LINE}\nown words of number 5") for k in range(6)}
    assert out.where("_lines.n_dropped > 0").count() == 5 and out.count() == 16
    assert line_dedup.line_dedup(odd.where("false")).count() == 0


def test_minhash(odd):
    got = minhash_dedup.minhash_groups(odd).collect()
    by = {r["doc_id"]: (r["component_id"], r["kept"]) for r in got if r["doc_id"] is not None}
    assert len(got) == 16 and by[3] == (1, False) and by[6] == (5, False) and by[2] == (2, True) and by[1] == (1, True) and all(r["kept"] for r in got if r["doc_id"] is None)
    assert minhash_dedup.minhash_groups(odd.where("false")).count() == 0


def test_minhash_at_the_threshold(spark):
    """6 of 8 shingles are a link, 17 of 23 are none."""
    short, long = [f"a{i}" for i in range(11)], [f"b{i}" for i in range(24)]
    texts = {1: short, 2: short[:10] + ["other"], 3: long, 4: long[:21] + ["other"] + long[22:]}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_dedup.minhash_groups(df).collect()}
    assert got == {1: (7, 1), 2: (7, 1), 3: (20, 3), 4: (20, 4)}


def test_suffix_dedup(odd):
    got = sorted(((r["doc_id"] or 0), r["n_bytes"], r["left"]) for r in suffix_dedup.remove_repeats(odd).select("doc_id", "n_bytes", F.octet_length("kept").alias("left")).collect())
    by = {i: (n, left) for i, n, left in got}
    assert suffix_dedup.remove_repeats(odd.where("false")).count() == 0
    assert len(got) == 16 and by[4] == (5000, 1) and by[5] == (LONG, LONG) and by[6][0] == LONG + 5 and by[6][1] < 200 and by[2] == (0, 0)


def test_packing(odd):
    p = packing.pack(odd, registry.tokenizer_path()).toPandas()
    assert (p[p["doc_id"] == 2]["length"] == 1).all() and p.groupby("sequence_id")["length"].sum().max() <= 1024
    five = p[p["doc_id"] == 5].sort_values("start")
    assert five["length"].sum() == five["doc_tokens"].iloc[0] > 1_000_000 and (five["start"] == five["length"].cumsum() - five["length"]).all()
    assert packing.pack(odd.where("false"), registry.tokenizer_path()).count() == 0


def test_token_counts(odd):
    out = token_counts.token_counts(odd, registry.tokenizer_path("piece_bpe_32k.model"))
    assert _kept(out, ["n_tokens"])
    got = {r["doc_id"]: r["n_tokens"] for r in out.select("doc_id", "n_tokens").collect()}
    assert got[2] == 0 and got[5] > 1_000_000
    assert token_counts.token_counts(odd.where("false"), registry.tokenizer_path("piece_bpe_32k.model")).count() == 0


def test_toxicity_and_quality(spark, odd):
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(1, 16)] + [(None, 0, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(odd, labels)
    out = toxicity.toxicity(odd, chain)
    assert _kept(out, ["_toxicity"]) and out.where("_toxicity.toxic between 0 and 1").count() == 16
    assert toxicity.toxicity(odd.where("false"), chain).count() == 0
    assert toxicity.train(odd.where("false"), labels.where("false")).names == ["theme_1", "theme_2", "toxic"]
    field = quality.train(odd, labels)
    out = quality.quality(odd, field)
    assert _kept(out, ["score"]) and out.where("score between 0 and 1").count() == 16
    assert quality.quality(odd.where("false"), field).count() == 0


def test_decontamination(spark, odd):
    item = odd.where("doc_id = 5").select(F.substring("text", 5_000_000, 400)).first()[0]
    benchmark = spark.createDataFrame([(1, item), (1, item), (2, None), (None, item), (3, ""), (4, "x y"), (5, "?!")], "item_id long, text string")
    out = decontamination.decontaminate(odd, benchmark)
    assert _kept(out, ["_leaks"]) and out.count() == 16
    assert sorted((r["doc_id"] or 0, [x["item_id"] for x in r["_leaks"]]) for r in out.where("size(_leaks) > 0").select("doc_id", "_leaks").collect()) == [(0, [4]), (5, [1]), (6, [1])]
    assert decontamination.decontaminate(odd.where("false"), benchmark).count() == 0
    assert decontamination.decontaminate(odd, benchmark.where("false")).where("size(_leaks) > 0").count() == 0
    some = odd.where("doc_id < 5 or doc_id is null")
    assert [tuple(r) for r in decontamination.decontaminate(some, benchmark, slice_bytes=100).where("size(_leaks) > 0").select("doc_id", F.size("_leaks")).collect()] == [(None, 1)]


def test_archives(spark, odd):
    pages = odd.select(F.col("doc_id").alias("page_id"), F.lit("http://a").alias("url"), F.col("text").alias("html"), *[c for c in NAMES if c not in ("url", "html")])
    got = warc.digest(spark, pages).toPandas()
    assert len(got) == 16 and got["payload_bytes"].max() == LONG + 5 and (got["record_type"] == "response").all()
    twice = warc.digest(spark, pages.where("page_id = 5").unionByName(pages.where("page_id = 5").withColumn("page_id", F.lit(9).cast("long")))).toPandas().sort_values("page_id")
    assert twice["record_type"].tolist() == ["response", "revisit"] and twice["refers_to"].iloc[1] == 5
    assert warc.digest(spark, pages.where("false")).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    v = rng.standard_normal(16)
    u = v / np.linalg.norm(v)
    w = rng.standard_normal(16)
    w -= (w @ u) * u
    w /= np.linalg.norm(w)
    at = lambda c: (c * u + np.sqrt(1 - c * c) * w)
    rows = [(1, u), (2, at(0.95 + 1e-9)), (3, -at(0.95 - 1e-9)), (4, at(0.95 - 1e-9)), (5, u * 1e39), (6, w), (6, -u), (7, np.zeros(16)), (8, None), (None, u), (9, np.full(16, np.inf)), (10, u), (10, u)]
    df = spark.createDataFrame([(i, None if x is None else x.tolist()) for i, x in rows], "vec_id long, embedding array<double>").withColumns({c: F.lit(f"my {c}") for c in NAMES})
    out = embedding_dedup.linked(df)
    assert _kept(out, ["n_links", "component_id", "kept"])
    got = sorted(((r["vec_id"] or 0), r["n_links"], r["component_id"] or 0) for r in out.select("vec_id", "n_links", "component_id").collect())
    assert got == [(0, 0, 0), (1, 3, 1), (2, 4, 1), (3, 0, 3), (4, 1, 1), (5, 3, 1), (6, 0, 6), (6, 0, 6), (7, 0, 7), (8, 0, 8), (9, 0, 9), (10, 3, 1), (10, 3, 1)]
    assert embedding_dedup.linked(df.where("false")).count() == 0
