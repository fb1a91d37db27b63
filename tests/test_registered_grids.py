"""Registered model queries cover the whole grid, folds and portions of their family."""

import pytest

from shapescreen.operators import gmm, iforest, sampling
from shapescreen.plans import experiment, queries


class Stop(Exception):
    pass


@pytest.fixture
def calls(monkeypatch):
    """What the queries ask for; nothing is trained."""
    seen = {}

    def split(molecules, portions=sampling.PORTIONS, folds=5, *args):
        seen.update(portions=portions, split_folds=folds)

    def cross_validate(data, family, params=None, folds=None, train_mode="all", **options):
        seen.update(params=params or family.params, folds=folds or family.folds, mode=train_mode, options=options)
        raise Stop

    def fit(rows, params, *args, **options):
        seen.update(params=params)
        raise Stop

    monkeypatch.setattr(experiment, "split", split)
    monkeypatch.setattr(experiment, "cross_validate", cross_validate)
    for module in (gmm, iforest):
        monkeypatch.setattr(module, "fit", fit)
    for name in ("_dataset", "training_rows"):
        monkeypatch.setattr(queries, name, lambda *args, **options: None)
    monkeypatch.setattr(queries.embeddings, "molecules", lambda *args: None)
    return seen


@pytest.mark.parametrize(
    "name, family",
    [
        ("final_eval", "gmm_auc"), ("refit_model", "gmm"), ("gmm_xval", "gmm"), ("gmm_lec_xval", "gmm"),
        ("iforest_xval", "iforest"), ("mlp_xval", "mlp"), ("ocsvm_xval", "ocsvm"),
    ],
)
def test_experiments_are_whole(calls, name, family):
    with pytest.raises(Stop):
        getattr(queries, name)(None, None)
    family = experiment.FAMILIES[family]
    assert tuple(calls["portions"]) == sampling.PORTIONS and calls["split_folds"] == calls["folds"] == family.folds
    assert tuple(calls["params"]) == family.params and calls["options"] == {}
    assert calls["mode"] == ("lec" if "lec" in name else "all")


@pytest.mark.parametrize("name, grid", [("gmm_fit", gmm.COMPONENTS), ("gmm_score", gmm.COMPONENTS), ("iforest_fit", iforest.TREES)])
def test_fits_are_whole(calls, name, grid):
    with pytest.raises(Stop):
        getattr(queries, name)(None, None)
    assert tuple(calls["params"]) == tuple(grid)
