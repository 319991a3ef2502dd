"""Plans over small frames, and every query that has SQL against DuckDB."""

import re

import duckdb
import numpy as np
import pandas as pd
import pytest

from cytofold.frame import CountFrame
from cytofold.operators import markers, neighbors, pseudobulk, qc
from cytofold.plans.domain import customers_by_supplier as m2
from cytofold.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(p: pd.DataFrame) -> list:
    return sorted((tuple(None if pd.isna(v) else v for v in r) for r in p[sorted(p.columns)].itertuples(index=False)), key=repr)


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_query_is_what_its_sql_says(spark, duck, name):
    f, sql = QUERIES[name]
    assert rows(f(spark, SF).toPandas()) == rows(duck.execute(sql).df())


def test_queries_take_the_operators_defaults(monkeypatch):
    from unittest.mock import MagicMock

    from cytofold.plans import queries

    community, embedding, doublets = MagicMock(), MagicMock(), MagicMock()
    for name, x in {"community": community, "embedding": embedding, "doublets": doublets, "neighbors": MagicMock(), "as_frame": MagicMock(), "m2": MagicMock()}.items():
        monkeypatch.setattr(queries, name, x)
    for name in ("umap", "leiden_sweep", "scrublet"):
        QUERIES[name][0](None, SF)
    assert [(len(c.args), set(c.kwargs)) for c in (embedding.umap.call_args, community.leiden_sweep.call_args, doublets.scrublet.call_args)] == [(1, set()), (1, {"n_seeds"}), (1, set())]


def test_recall_of_approximate_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((20, 12))[rng.integers(20, size=1500)] * 2 + rng.standard_normal((1500, 12))
    p = spark.createDataFrame(pd.DataFrame({"id": range(len(x)), "vec": x.tolist()}))
    pairs = lambda t: {(r["i"], r["j"]) for r in t.select("i", "j").collect()}
    exact = pairs(neighbors.knn_blocks(p, p, 10, True))
    lists = neighbors.knn_lists(p, p, 10, True, 40_000, probes=4)  # 78 lists
    assert len(pairs(lists) & exact) >= 0.9 * len(exact)
    asked = []
    monkeypatch.setattr(neighbors, "knn_lists", lambda *a, **k: asked.append(k))
    neighbors.knn_query(p, p, 5, exact_pairs=0)
    assert asked == [{"probes": 32}]


@pytest.fixture
def small(spark):
    x = spark.createDataFrame([(0, 0, 2.0), (0, 1, 6.0), (1, 0, 5.0), (2, 1, 1.0), (2, 2, 3.0)], "cell_id long, gene_id int, count double")
    return CountFrame.from_triplets(x, n_cells=4, n_genes=3)


def test_totals_are_of_the_genes_kept(small):
    cf = qc.normalize_total(small.filter_cells("cell_id in (0, 2)").filter_genes("gene_id < 2"), 100)
    got = sorted((r["cell_id"], r["gene_id"], r["value"]) for r in cf.matrix().collect())
    assert got == [(0, 0, 25.0), (0, 1, 75.0), (2, 1, 100.0)]


def test_empty_cells_stay(small):
    cells = qc.calculate_qc_metrics(small, None, inplace=False)[0].toPandas().set_index("cell_id")
    assert cells.loc[3].tolist() == [0, 0.0, 0.0]


def test_order_of_transforms(small):
    qc.log1p(small)
    with pytest.raises(ValueError, match="before"):
        qc.normalize_total(small)


def test_duplicates_add_up_and_zeros_go(spark):
    x = spark.createDataFrame([(0, 0, 2.0), (0, 0, 3.0), (1, 0, 0.0)], "cell_id long, gene_id int, count double")
    cf = CountFrame.from_triplets(x)
    assert [(r["cell_id"], r["count"]) for r in cf.kept().collect()] == [(0, 5.0)]
    assert cf.shape == (2, 1)  # the largest ids of all rows, zeros as well


def test_mtx_folder(spark, tmp_path):
    from cytofold.sources.files import read_10x_mtx

    (tmp_path / "matrix.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n%\n3 2 4\n1 1 5\n3 1 1\n2 2 7\n3 2 4\n")
    (tmp_path / "barcodes.tsv").write_text("AA\nBB\n")
    (tmp_path / "features.tsv").write_text("e0\tG0\tGene Expression\ne1\tG1\tGene Expression\ne2\tG2\tAntibody Capture\n")
    cf = read_10x_mtx(spark, str(tmp_path))
    assert sorted(map(tuple, cf.kept().collect())) == [(0, 0, 5.0), (1, 1, 7.0)]
    assert cf.var_names == ["G0", "G1"]


def test_equal_values_are_counted_before_they_are_sent(spark):
    """Below the exchange by gene, value and group there is a partial count."""
    cells = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(40)], "cell_id long, group string")
    x = spark.createDataFrame([(i, j, 1.0 + (i * j) % 3) for i in range(40) for j in range(5)], "cell_id long, gene_id int, count double")
    plan = markers.rank_sums(CountFrame.from_triplets(x, obs=cells), cells)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    sent = [i for i, v in enumerate(lines) if "Exchange hashpartitioning(gene_id" in v and "group" in v.split("),")[0] and "value" in v]
    assert sent and all("partial_count(1)" in " ".join(lines[i + 1 : i + 3]) for i in sent)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_task_holds_all_orders_or_cells(spark):
    """What grows with the orders or the cells is dealt and merged, so no task's memory grows with it (deseq2_wald, deseq2_lrt)."""
    cf = m2(spark, SF)
    plan = _plan(pseudobulk.group_gene_totals(cf, cf.obs, ["nation", "segment"]))
    assert plan.count("SortMergeJoin") == 2 and "BroadcastHashJoin" not in plan


def test_ranks_are_dealt_by_the_size_of_the_matrix(spark):
    """No exchange of counted values or of stretches has as many partitions as the session, which would be larger with each row (marker_wilcoxon_scores, rank_genes_groups)."""
    cf = m2(spark, SF)
    cf.parts = 7
    labels = markers._labels(cf, "segment", "all")
    plan = _plan(markers.rank_table(cf, labels))
    own = re.findall(r"Exchange hashpartitioning\((.*?)\), ENSURE", plan)
    assert not any(re.search(r"\b(value|b)#", keys) for keys in own) and len(re.findall(r", 7\), REPARTITION_BY_NUM", plan)) >= 3, plan
