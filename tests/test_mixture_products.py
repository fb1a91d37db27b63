import numpy as np
import pytest

from shapescreen.operators import gmm


def one_by_one(mix, x):
    out = []
    for w, mu, s in zip(mix["w"], mix["mu"], mix["s"]):
        s = np.diag(s) if s.ndim == 1 else s
        gap = x - mu
        quad = np.einsum("ni,ij,nj->n", gap, np.linalg.inv(s), gap)
        out.append(np.log(w) - 0.5 * (quad + np.linalg.slogdet(2 * np.pi * s)[1]))
    return np.array(out).T


def mixture(full, scale=1.0, k=40, d=5):
    rng = np.random.default_rng(2)
    half = rng.normal(size=(k, d, d)) * 0.3
    s = (half @ np.swapaxes(half, 1, 2) + 0.05 * np.eye(d)) * scale**2
    s = s if full else np.diagonal(s, axis1=1, axis2=2).copy()
    mix = gmm._finish(np.full(k, 1 / k), rng.normal(size=(k, d)) * scale, s)
    return mix, rng.normal(size=(300, d)) * scale


@pytest.mark.parametrize("full", [True, False])
@pytest.mark.parametrize("scale", [1.0, 1e4])
def test_densities_of_many_components_are_one_product(full, scale):
    mix, x = mixture(full, scale)
    found = gmm._expanded_forms(mix["root"], mix["mu"], x)
    assert found.shape == (300, 40)
    np.testing.assert_allclose(gmm.log_density(mix, x), one_by_one(mix, x), rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("full", [True, False])
def test_terms_that_cancel_are_not_expanded(full):
    mix, x = mixture(full)
    far = x.copy()
    far[0] = 1e7
    assert gmm._expanded_forms(mix["root"], mix["mu"], far) is None
    np.testing.assert_allclose(gmm.log_density(mix, far)[1:], one_by_one(mix, x)[1:], rtol=1e-9)
    assert gmm._expanded_forms(mix["root"], mix["mu"], np.where(x > 2, np.nan, x)) is None


def test_sums_of_products_take_each_pair_of_features_once():
    rng = np.random.default_rng(3)
    resp, x = rng.random((200, 30)), rng.normal(size=(200, 4))
    n, first, second = gmm._statistics(resp, x, True)
    np.testing.assert_allclose(second, np.einsum("nk,ni,nj->kij", resp, x, x))
    np.testing.assert_allclose(first, resp.T @ x)
    assert (second == np.swapaxes(second, 1, 2)).all()
