"""Kernels that need no session, against fixed values and plain computations."""

import math

import numpy as np
import pytest

from cytofold.functions.smooth import loess, lowess
from cytofold.functions.stats import bh_array, chi2_sf, normal_pvalues, t_pvalues, trigamma
from cytofold.operators.community import by_size, leiden_labels
from cytofold.operators.deseq import model_matrix
from cytofold.operators.doublets import threshold_minimum
from cytofold.operators.embedding import codes, find_ab_params, per_level
from cytofold.operators.neighbors import memberships
from cytofold.operators.pseudobulk import array_size_factors


def test_lowess_fixed_values():
    want = [2.287396884, 3.169721026, 4.152120654, 4.854933645, 6.145245957, 6.854889276, 8.154400363, 9.526068707, 14.803207661, 19.483632229]
    assert np.allclose(lowess(np.arange(1, 11), np.array([2, 4, 3, 6, 5, 8, 7, 10, 9, 20.0]), 0.5, 3, 0.09), want, atol=1e-8)
    got = lowess(np.array([1, 2, 2, 3, 5, 8, 8, 9, 12, 13, 20.0]), np.array([1, 3, 2, 5, 4, 9, 7, 8, 15, 11, 30.0]), 0.2, 3, 0.19)
    assert np.allclose(got, [1, 2.5, 2.5, 5, 4, 8, 8, 8, 15, 11, 30])


def test_loess_reproduces_a_parabola():
    x = np.round(np.random.default_rng(0).random(900) * 3, 2)
    y = 1 + 2 * x - x * x
    assert np.abs(loess(x, y, 0.3) - y).max() < 1e-10


def test_special_functions():
    assert np.allclose(trigamma(np.array([1, 0.5, 10])), [math.pi**2 / 6, math.pi**2 / 2, 0.10516633568168572], atol=1e-12)
    assert t_pvalues(np.array([2.0]), np.array([10.0]))[0] == pytest.approx(0.0733880, abs=1e-6)
    assert chi2_sf(np.array([3.841458820694124]), 1)[0] == pytest.approx(0.05, abs=1e-9)
    assert np.isnan(normal_pvalues(np.array([np.inf, np.nan]))).all()


def test_bh_leaves_nan_out():
    assert np.allclose(bh_array(np.array([0.01, np.nan, 0.04, 0.03])), [0.03, np.nan, 0.04, 0.04], equal_nan=True)


@pytest.mark.parametrize(("spread", "min_dist", "a", "b"), [(1, 0.1, 1.5769, 0.8951), (1, 0.5, 0.5830, 1.3342)])
def test_curve_parameters(spread, min_dist, a, b):
    assert find_ab_params(spread, min_dist) == pytest.approx((a, b), abs=2e-3)


def test_memberships_add_up():
    w = memberships(np.array([[1, 1.5, 2, 2.2, 3]]), 6, 1.0)
    assert w.sum() == pytest.approx(np.log2(6), abs=1e-4)


def test_two_triangles_are_two_communities():
    i, j, w = [0, 0, 1, 3, 3, 4, 2], [1, 2, 2, 4, 5, 5, 3], [1, 1, 1, 1, 1, 1, 0.01]
    got = leiden_labels(6, np.array(i), np.array(j), np.array(w))
    assert len(set(got[:3])) == len(set(got[3:])) == 1 and got[0] != got[3]


def test_planted_partition_is_found():
    rng = np.random.default_rng(1)
    block = np.repeat(np.arange(8), 50)
    i, j = np.triu_indices(400, 1)
    keep = rng.random(len(i)) < np.where(block[i] == block[j], 0.3, 0.005)
    got = leiden_labels(400, i[keep], j[keep], np.ones(keep.sum()))
    assert len(np.unique(got)) == 8 and all(len(np.unique(got[block == b])) == 1 for b in range(8))


def test_labels_by_size():
    assert by_size(np.array([5, 5, 2, 2, 2, 9])).tolist() == [1, 1, 0, 0, 0, 2]


def test_threshold_between_two_peaks():
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.normal(0.1, 0.03, 4000), rng.normal(0.6, 0.1, 1500)])
    assert 0.2 < threshold_minimum(v) < 0.45
    assert threshold_minimum(np.zeros(10)) is None


def test_factor_helpers():
    assert codes(["b", "a", "b"])[0].tolist() == [1, 0, 1]
    with pytest.raises(ValueError, match="null"):
        codes(["a", None])
    assert per_level([1, 2], [2, 1]).tolist() == [1, 1, 2]


def test_model_matrix_errors():
    import pandas as pd

    obs = pd.DataFrame({"a": ["x", "y", "x", "y"], "b": ["x", "y", "x", "y"]})
    assert model_matrix(obs, "~ a")[1] == ["Intercept", "a_y_vs_x"]
    with pytest.raises(ValueError, match="full rank"):
        model_matrix(obs, "~ a + b")
    with pytest.raises(ValueError, match="additive"):
        model_matrix(obs, "~ a:b")


def test_size_factors(spark):
    y = np.array([[10, 20, 5.0], [4, 8, 3], [100, 200, 40], [0, 1, 2]])
    genes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "gene_id int, counts array<double>")
    sf = array_size_factors(genes, 3, "ratio")
    assert sf[1] / sf[0] == pytest.approx(2)
