"""Readers over small files; HDF5 ones over a stand-in with the same groups, as h5py isn't installed here."""

import gzip
import pickle

import numpy as np
import pytest

from cytofold.sources import files

FAKE = "tests.fake_h5:File"
X = np.array([[0, 2, 0, 1], [0, 0, 0, 0], [3, 0, 0.5, 0]])


def rows(x):
    """(indptr, indices, data) of compressed rows."""
    i, j = np.nonzero(x)
    return {"indptr": np.append(0, np.cumsum(np.bincount(i, minlength=len(x)))), "indices": j.astype(np.int32), "data": x[i, j].astype(np.float32)}


def save(path, tree):
    path.write_bytes(pickle.dumps(tree))
    return str(path)


def entries(cf):
    return sorted((r["cell_id"], r["gene_id"], r["count"]) for r in cf.kept().collect())


WANT = [(0, 1, 2.0), (0, 3, 1.0), (2, 0, 3.0), (2, 2, 0.5)]
CELLS = np.array([b"AA-1", b"CC-1", b"GG-1"])


def test_10x_layouts(spark, tmp_path):
    v3 = {"matrix": {**rows(X), "barcodes": CELLS, "shape": np.array([4, 3]), "features": {"id": np.array([b"e0", b"e1", b"e2", b"e3"]), "name": np.array([b"A", b"B", b"C", b"D"]), "feature_type": np.array([b"Gene Expression"] * 3 + [b"Antibody Capture"])}}}
    v2 = {"hg19": {**rows(X), "barcodes": CELLS, "genes": np.array([b"e0", b"e1", b"e2", b"e3"]), "gene_names": np.array([b"A", b"B", b"C", b"D"])}}
    three = files.read_10x_h5(spark, save(tmp_path / "3.h5", v3), gex_only=False, opener=FAKE)
    two = files.read_10x_h5(spark, save(tmp_path / "2.h5", v2), opener=FAKE)
    assert entries(three) == entries(two) == WANT and three.var_names == two.var_names == list("ABCD")
    assert [r["barcode"] for r in three.obs.orderBy("cell_id").collect()] == ["AA-1", "CC-1", "GG-1"]
    genes = files.read_10x_h5(spark, str(tmp_path / "3.h5"), opener=FAKE)
    assert genes.shape == (3, 3) and entries(genes) == [e for e in WANT if e[1] < 3]
    kept = files.convert_h5_to_parquet(spark, str(tmp_path / "3.h5"), str(tmp_path / "out"), opener=FAKE)
    assert entries(kept) == WANT and kept.shape == (3, 4)


OBS = {"@": {"_index": "cell", "column-order": ["kind", "depth", "masked"]}, "cell": CELLS, "kind": {"categories": np.array([b"a", b"b"]), "codes": np.array([1, -1, 0])}, "depth": np.array([1.5, 2.5, 3.5]), "masked": {"values": np.array([1, 2, 3]), "mask": np.array([0, 1, 0])}}
VAR = {"@": {}, "_index": np.array(["A", "B", "C", "D"], dtype=object), "score": np.arange(4)}


@pytest.mark.parametrize("kind", ["csr_matrix", b"csc_matrix", "old", "dense"])
def test_h5ad_layouts(spark, tmp_path, kind):
    x = X if kind == "dense" else {**rows(X.T if kind == b"csc_matrix" else X), "@": {"h5sparse_format": b"csr"} if kind == "old" else {"encoding-type": kind}}
    obs = np.array([(b"AA-1", 1.5), (b"CC-1", 2.5), (b"GG-1", 3.5)], dtype=[("index", "S4"), ("depth", "f8")]) if kind == "old" else OBS
    cf = files.read_h5ad(spark, save(tmp_path / "x.h5ad", {"X": x, "obs": obs, "var": VAR}), opener=FAKE)
    assert entries(cf) == WANT and cf.var_names == list("ABCD") and cf.shape == (3, 4)
    got = cf.obs.orderBy("cell_id").collect()
    assert [r["barcode"] for r in got] == ["AA-1", "CC-1", "GG-1"] and [r["depth"] for r in got] == [1.5, 2.5, 3.5] and "masked" not in cf.obs.columns
    assert kind == "old" or [r["kind"] for r in got] == ["b", "nan", "a"]
    assert [r["score"] for r in cf.var.orderBy("gene_id").collect()] == [0, 1, 2, 3]


def test_compressed_mtx_folder(spark, tmp_path):
    for name, text in {"matrix.mtx": "%%MatrixMarket matrix coordinate real general\n4 3 4\n2 1 2\n4 1 1\n1 3 3\n3 3 0.5\n", "barcodes.tsv": "AA-1\nCC-1\nGG-1\n", "genes.tsv": "e0\tA\ne1\tB\ne2\tC\ne3\tD\n"}.items():
        with gzip.open(tmp_path / f"{name}.gz", "wt") as f:
            f.write(text)
    cf = files.read_10x_mtx(spark, str(tmp_path))
    assert entries(cf) == WANT and cf.var_names == list("ABCD")
