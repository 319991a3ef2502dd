"""Evaluation against plain loops, and streams that are read in several goes."""

import numpy as np
import pandas as pd
import pytest

from cytofold.operators import evaluation, neighbors
from cytofold.shared import dropped, stored
from cytofold.streaming import counts


def test_weights_have_the_perplexity():
    d = np.sort(np.random.default_rng(0).random((50, 30)) * 5, axis=1)
    w = evaluation.calibrated(d, 10.0)
    assert np.allclose(np.exp(-(w * np.log(w)).sum(1)), 10, rtol=1e-6) and np.allclose(w.sum(1), 1) and (np.diff(w, axis=1) <= 0).all()
    assert np.allclose(evaluation.calibrated(np.ones((2, 5)), 3.0), 0.2) and np.allclose(evaluation.calibrated(d[:, :4], 8.0), 0.25)


def test_lisi_by_plain_loops(spark):
    rng = np.random.default_rng(1)
    x, lab = rng.normal(size=(80, 3)), [None if k % 9 == 0 else "abc"[k % 3] for k in range(80)]
    p = spark.createDataFrame(pd.DataFrame({"id": range(80), "vec": x.tolist()}))
    got = {r["i"]: r["lisi"] for r in evaluation.lisi(neighbors.knn_blocks(p, p, 12, True), spark.createDataFrame(list(enumerate(lab)), "cell_id long, label string")).collect()}
    for i in range(80):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        near = sorted((d[j], j) for j in range(80) if j != i)[:12]
        w = evaluation.calibrated(np.array([[v for v, _ in near]]), 4.0)[0]
        share = {}
        for v, (_, j) in zip(w, near, strict=True):
            share[lab[j] or "NA"] = share.get(lab[j] or "NA", 0) + v
        assert got[i] == pytest.approx(1 / sum(s * s for s in share.values()))


def test_lisi_tells_mixed_from_apart(spark):
    rng = np.random.default_rng(2)
    x, batch = rng.normal(size=(400, 4)), rng.integers(0, 2, 400)
    index = []
    for gap in (0, 50):
        p = spark.createDataFrame(pd.DataFrame({"id": range(400), "vec": (x + gap * batch[:, None]).tolist()}))
        labels = spark.createDataFrame(pd.DataFrame({"cell_id": range(400), "label": batch.astype(str)}))
        index.append(np.median([r["lisi"] for r in evaluation.lisi(neighbors.knn_blocks(p, p, 30, True), labels).collect()]))
    assert index[0] > 1.8 and index[1] == pytest.approx(1)


def test_agreement(spark):
    side = lambda v: spark.createDataFrame(list(enumerate(v)), "cell_id long, label string")
    nmi = lambda a, b: evaluation.normalized_mutual_information(side(a), side(b)).first()
    assert nmi("aabbcc", "xxyyzz")["nmi"] == pytest.approx(1) and nmi("abab", "xxyy")["nmi"] == pytest.approx(0) and nmi("aaaa", "xxxx")["nmi"] == 1
    assert evaluation.normalized_mutual_information(side(""), side("")).count() == 0
    a, b = (spark.createDataFrame(x, "i long, j long") for x in ([(1, 2), (1, 3), (1, 3), (2, 1)], [(1, 3), (1, 4), (3, 1)]))
    assert {r["i"]: r["overlap"] for r in evaluation.knn_overlap(a, b).collect()} == {1: 0.5, 2: 0.0}


def test_auroc(spark):
    rng = np.random.default_rng(3)
    rows = [(float(s), int(v)) for s, v in zip(rng.integers(0, 40, 500), rng.integers(0, 2, 500), strict=True)]
    want = np.mean([(a > b) + (a == b) / 2 for a, x in rows if x == 1 for b, y in rows if y == 0])
    df = spark.createDataFrame([*rows, (None, 1), (3.0, None)], "score double, label int")
    assert evaluation.auroc(df).first()["auroc"] == pytest.approx(want)
    assert evaluation.auroc(df.where("label = 1")).first()["auroc"] is None and evaluation.auroc(df.where("false")).first()["auroc"] is None


def test_stream_in_several_goes(spark, tmp_path):
    """A second call reads only what came since; cells and genes that come again are not counted as new ones; nulls, zeros and what sums to nothing are left out."""
    schema, source, folder = "cell_id long, gene_id int, count double", f"{tmp_path}/in", f"file://{tmp_path}/out"
    goes = [[(1, 1, 2.0), (1, 2, 3.0), (2, 1, 1.0), (None, 1, 5.0), (3, None, 5.0)], [(1, 1, 4.0), (2, 2, 7.0), (2, 1, -1.0), (4, 1, 0.0), (5, 1, None)]]
    for rows in goes:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        counts.accumulate(spark.readStream.schema(schema).parquet(source), folder).awaitTermination()
    got = {r["cell_id"]: (r["n_genes_by_counts"], r["total_counts"]) for r in counts.cell_metrics(counts.accumulated(spark, folder)).collect()}
    assert got == {1: (2, 9.0), 2: (1, 7.0)}
    assert {r["gene_id"]: (r["n_cells_by_counts"], r["total_counts"]) for r in counts.gene_metrics(counts.accumulated(spark, folder)).collect()} == {1: (1, 6.0), 2: (2, 10.0)}


def test_stored_tables_go(spark):
    df = stored(spark.range(5))
    path = df._stored_path
    assert df.count() == 5
    dropped(df, None, spark.range(2))
    assert not spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path))
