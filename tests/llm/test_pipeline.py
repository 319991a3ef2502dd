"""The corpus pipeline: each stage on its own input against SQL or a plain computation, and all of it on odd rows."""

import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from cytofold.llm import decontamination, line_dedup, minhash_dedup, registry, toxicity

SF = "/root/testdata/sf0.001"


def _sql(df, sql):
    c = duckdb.connect()
    c.register("documents", df.select("doc_id", "text").toPandas())
    return c.execute(sql).df().set_index("doc_id")


def test_stages_against_plain_computations(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, steps = docs.columns, dict(pipeline.STAGES)
    assert list(steps) == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    run = lambda name, x: pipeline.durable(steps[name](spark, x, SF), f"test-{name}")
    ids = lambda x: {r["doc_id"] for r in x.select("doc_id").collect()}

    clean = run("toxicity", docs)
    chain = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    score = dict(zip((r["doc_id"] for r in docs.orderBy("doc_id").collect()), chain.scores([toxicity.words(r["text"] or "") for r in docs.orderBy("doc_id").collect()])[:, -1], strict=True))
    assert ids(clean) == {d for d, p in score.items() if p < pipeline.TOXIC}  # so few labels tell nothing of most words

    lines = run("line_dedup", clean)
    want = _sql(clean, line_dedup.SQL)
    got = lines.select("doc_id", F.sha2("text", 256).alias("h"), "n_chars", F.char_length("text").alias("n")).toPandas().set_index("doc_id")
    assert (got["h"] == want["kept_sha256"].reindex(got.index)).all() and len(got) == len(want) and (got["n_chars"] == got["n"]).all()

    single = run("near_dedup", lines)
    groups = _sql(lines, minhash_dedup.SQL)
    assert ids(single) == set(groups.index[groups["kept"]]) and single.count() < lines.count()

    free = run("decontamination", single)
    items = sorted({(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()})
    rows = single.select("doc_id", "text").collect()
    leaks = decontamination.Index(items)([decontamination.normal(r["text"]) for r in rows])
    assert ids(free) == {r["doc_id"] for r, x in zip(rows, leaks, strict=True) if not x} and free.count() < single.count()

    assert all(x.columns == columns and dict(x.dtypes) == dict(docs.dtypes) for x in (clean, lines, single, free))
    t = Tokenizer.from_file(registry.tokenizer_path())
    tokens = {r["doc_id"]: np.asarray([*t.encode(r["text"] or "", add_special_tokens=False).ids, 0], dtype="<u4") for r in free.collect()}
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    whole = pipeline.run(spark, SF).toPandas().sort_values(["doc_id", "start"], ignore_index=True)
    assert set(whole["doc_id"]) == set(tokens)
    for r in whole[key].itertuples(index=False):
        assert r.doc_tokens == len(tokens[r.doc_id]) and zlib.crc32(tokens[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert whole.groupby("doc_id")["length"].sum().to_dict() == {d: len(x) for d, x in tokens.items()} and whole.groupby("sequence_id")["length"].sum().max() <= 1024


@pytest.fixture
def folder(spark, tmp_path):
    item = " ".join(f"word{i}" for i in range(20))
    near = [f"t{i}" for i in range(60)]
    rows = [(1, "a b c d e f g", "s"), (1, "a b c d e f g", "s"), (1, "quite another text of id one", "s"), (None, None, "s"), (None, "x y", None), (2, "", "s"), (3, "A  b c\nd e f g", "s"), (4, " ".join(near), "s"), (5, " ".join(near[:58]), "s"), (5, "a text that five has alone", "s"), (6, "before " + item + " after", "s"), (7, None, None), (8, "quite another text of id one", "s")]
    names = [c for c in ("_toxicity", "_lines", "_leaks", "_id", "row", "id", "unit", "kept", "component_id", "node", "hash") if c]
    docs = spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(f"my {c}") for c in names})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0), (3, 1, 1), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_odd_rows_go_through_all_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    lines = pipeline.drop_lines(spark, docs, folder)
    assert lines.columns == docs.columns and lines.count() == docs.count()
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in pipeline.drop_copies(spark, docs, folder).select("doc_id", "text").collect())
    near = [f"t{i}" for i in range(60)]
    other = {(i, "quite another text of id one") for i in (1, 8)}
    assert len(set(got) & other) == 1
    assert (1, "quite another text of id one") in got
    assert sorted(set(got) - other) == sorted([(0, ""), (0, "x y"), (1, "a b c d e f g"), (2, ""), (4, " ".join(near)), (5, "a text that five has alone"), (6, "before " + " ".join(f"word{i}" for i in range(20)) + " after"), (7, "")])
    assert {r["doc_id"] for r in pipeline.drop_leaks(spark, docs, folder).select("doc_id").collect()} == {1, 2, 3, 4, 5, 7, 8, None}
    out = pipeline.drop_copies(spark, docs, folder)
    assert out.columns == docs.columns and out.where("kept <> 'my kept' or node <> 'my node'").isEmpty()
    pieces = pipeline.run(spark, folder).toPandas()
    assert pieces["doc_id"].isna().sum() == 2 and 6 not in set(pieces["doc_id"].dropna()) and {2, 7} <= set(pieces["doc_id"].dropna())


def test_no_rows(spark, folder, tmp_path):
    empty = f"{tmp_path}/empty"
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").where("false").write.parquet(f"{empty}/{t}.parquet")
    assert pipeline.run(spark, empty).count() == 0
