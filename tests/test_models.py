import numpy as np
import pytest
from pyspark.sql import functions as F

from shapescreen.operators import gmm, iforest, mlp, models, ocsvm, training
from shapescreen.operators.models import training_rows


def actives(dataset, target):
    rows = dataset.filter(f"target = {target} and active").collect()
    return np.concatenate([[c["features"] for c in r["conformers"]] for r in rows])


def score_map(df):
    return {(r["target"], r["param"], r["mol_id"]): r["score"] for r in df.collect()}


def test_one_component_is_mean_and_covariance(dataset):
    table = gmm.components(gmm.fit(training_rows(dataset), (1,)))
    for row in table.collect():
        x = actives(dataset, row["target"])
        assert row["mean"] == pytest.approx(x.mean(0))
        assert np.array(row["cov"]) == pytest.approx(np.cov(x.T, bias=True) + 1e-6 * np.eye(x.shape[1]))


@pytest.mark.parametrize("covariance", ["diag", "full"])
def test_likelihood_never_falls(covariance):
    trainer, seen = gmm.mixture_trainer(covariance, tol=1e-9, max_iter=25), []
    update = trainer.update
    trainer.update = lambda model, sums, i: seen.append(sums[-2] / sums[-1]) or update(model, sums, i)
    x = np.random.default_rng(3).normal(size=(300, 4)) * [1, 2, 3, 4]
    zero = np.zeros(300)
    model = models.Model(0, 1.0, 3, -1, 300, 4)
    training.train_here(model, trainer, x, zero, zero - 1, np.arange(300))
    assert len(seen) > 3 and all(b >= a - 1e-9 for a, b in zip(seen, seen[1:]))


def test_mixture_scores_are_mean_log_densities(dataset):
    fitted = gmm.fit(training_rows(dataset), (2,))
    mixes = {r["target"]: gmm.decode(r["payload"]) for r in fitted.collect()}
    got = score_map(gmm.score(dataset, fitted))
    for r in dataset.filter("mol_id % 5 = 0").collect():
        x = np.array([c["features"] for c in r["conformers"]])
        mix = mixes[r["target"]]
        density = np.zeros(len(x))
        for w, mu, s in zip(mix["w"], mix["mu"], mix["s"]):
            d = x - mu
            density += w * np.exp(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d)) / np.sqrt(
                np.linalg.det(2 * np.pi * s)
            )
        assert got[r["target"], 2, r["mol_id"]] == pytest.approx(np.log(density).mean())


def test_too_many_components_are_skipped(dataset):
    fitted = gmm.fit(training_rows(dataset), (1000,)).collect()
    assert {r["status"] for r in fitted} == {"skipped"} and all(r["payload"] is None for r in fitted)


def test_models_do_not_depend_on_partitions_waves_or_rounds(dataset, monkeypatch):
    rows = training_rows(dataset)
    want = score_map(gmm.score(dataset, gmm.fit(rows, (1, 2))))
    monkeypatch.setattr(models, "_DIRECT_BYTES", 0)
    monkeypatch.setattr(models, "_FAN_IN", 2)
    monkeypatch.setattr(models, "WAVE_BYTES", 1)
    monkeypatch.setattr(models.waves, "__defaults__", (1,))
    moved = rows.repartition(5, "mol_id")
    assert score_map(gmm.score(dataset.repartition(3), gmm.fit(moved, (1, 2), task_data=0))) == pytest.approx(want)


def test_folds_train_on_the_other_folds(dataset):
    folded = dataset.withColumn("fold", (F.floor(F.col("mol_id") / 10) % 2).cast("int"))
    table = gmm.components(gmm.fit(training_rows(folded), (1,), (0, 1)))
    for row in table.collect():
        x = actives(dataset.filter(f"floor(mol_id / 10) % 2 <> {row['fold']}"), row["target"])
        assert row["mean"] == pytest.approx(x.mean(0))
    scored = gmm.score(folded, gmm.fit(training_rows(folded), (1,), (0, 1))).collect()
    assert len(scored) == dataset.count()
    assert all(r["fold"] == r["mol_id"] // 10 % 2 for r in scored)


def test_lowest_energy_training(dataset):
    rows = training_rows(dataset, train_mode="lec")
    assert rows.filter(F.size("conformers") != 1).count() == 0
    n = {r["target"]: r["n_rows"] for r in gmm.fit(rows, (1,)).collect()}
    assert n == {r["target"]: r["count"] for r in dataset.filter("active").groupBy("target").count().collect()}


def test_forest_scores_lie_in_range_and_small_forests_are_prefixes(dataset):
    fitted = iforest.fit(training_rows(dataset), (30, 5))
    scores = score_map(iforest.score(dataset, fitted))
    assert all(-0.5 <= v <= 0.5 for v in scores.values())
    forests = {(r["target"], r["param"]): iforest.decode(r["payload"]) for r in fitted.collect()}
    for target in (0, 1):
        small, large = forests[target, 5], forests[target, 30]
        assert len(large) == 30
        assert all((a[1] == b[1]).all() for a, b in zip(small, large))
    nodes = iforest.nodes(fitted).filter("param = 5 and target = 0").toPandas()
    roots = nodes[nodes["node"] == 0]
    assert len(roots) == 5 and (roots["size"] == len(actives(dataset, 0))).all()


def test_forest_isolates_an_outlier():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(200, 3)), [[9, 9, 9]]])
    forest = [(len(x), iforest.grow(x, np.random.default_rng(i))) for i in range(60)]
    scores = iforest.decision(forest, x)
    assert scores.argmin() == 200 and scores[200] < 0 < np.median(scores)


def test_average_path_lengths():
    assert list(iforest.average_path([0, 1, 2])) == [0, 0, 1]
    assert iforest.average_path(256) == pytest.approx(10.2448, abs=1e-3)


def test_network_gradient_matches_finite_differences():
    rng = np.random.default_rng(0)
    d, h = 3, 4
    theta = rng.normal(size=d * h + 2 * h + 1)
    x, y = rng.normal(size=(20, d)), rng.normal(size=20)
    state = {"d": d, "h": h, "theta": theta, "mean": np.zeros(d), "scale": np.ones(d), "held": 0, "activity_l2": 0.3}

    def loss(t):
        net = {"mean": 0, "scale": 1, "layers": mlp._views(t, d, h)}
        out = mlp.predict(net, x)
        return 0.5 * ((out - y) ** 2).sum() + 0.15 * (out**2).sum()

    grad = mlp._gradient(state, x, y, np.zeros(20, dtype=np.int64))[:-4]
    for i in range(len(theta)):
        step = np.zeros_like(theta)
        step[i] = 1e-6
        assert grad[i] == pytest.approx((loss(theta + step) - loss(theta - step)) / 2e-6, rel=1e-4, abs=1e-6)


def test_network_learns_and_stops_early(dataset):
    rows = training_rows(dataset, False)
    short = mlp.fit(rows, max_iter=2).collect()
    long = mlp.fit(rows, max_iter=40)
    for a, b in zip(sorted(short, key=lambda r: r["target"]), long.orderBy("target").collect()):
        assert b["objective"] < a["objective"]
    mean = long.join(mlp.score(dataset, long), ["target", "portion", "param", "fold"])
    by_label = {r["truth"]: r["m"] for r in mean.groupBy("truth").agg(F.avg("score").alias("m")).collect()}
    assert by_label[True] > by_label[False]
    stopped = mlp.fit(rows, max_iter=60, early_stopping=True, tol=1e9).collect()
    assert {r["n_iter"] for r in stopped} <= {10, 11}


def test_one_class_machine_leaves_about_half_outside(dataset):
    fitted = ocsvm.fit(training_rows(dataset), max_iter=40)
    for r in fitted.collect():
        x = actives(dataset, r["target"])
        outside = (ocsvm.decision(ocsvm.decode(r["payload"]), x) < 0).mean()
        assert outside == pytest.approx(0.5, abs=0.05)


def test_one_class_machine_ranks_an_outlier_last():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(60, 2)), [[30.0, -30.0]]])
    state_model = models.Model(0, 1.0, 50, -1, len(x))

    class Local:
        pass

    def step_sums(m):
        return ocsvm._sums(m.state, x, None, None)

    gamma_rng = np.random.default_rng(0)
    gamma = 1 / (2 * x.var())
    state_model.state = {
        "w": gamma_rng.normal(scale=np.sqrt(2 * gamma), size=(2, 512)),
        "b": gamma_rng.uniform(0, 2 * np.pi, 512),
        "normal": np.zeros(512), "cut": 0.0, "lo": -1.0, "hi": 1.0,
    }
    for step in range(41):
        ocsvm._advance(state_model, step_sums(state_model), 512, step, 40)
    scores = ocsvm.decision(ocsvm.decode(ocsvm._encode(state_model)), x)
    assert scores.argmin() == 60


def test_models_are_stored_and_read_back(spark, dataset, tmp_path):
    from shapescreen.sources.store import load_models, save_models

    fitted = gmm.fit(training_rows(dataset), (1,))
    save_models(fitted, str(tmp_path / "models"))
    again = load_models(spark, str(tmp_path / "models")).select(fitted.columns)
    assert score_map(gmm.score(dataset, again)) == score_map(gmm.score(dataset, fitted))


@pytest.mark.parametrize("task_data", [None, 0])
def test_a_model_that_breaks_down_is_reported_and_left_out(dataset, task_data):
    huge = F.when(F.col("target") == 1, 1e200).otherwise(1.0)
    broken = dataset.withColumn(
        "conformers",
        F.transform("conformers", lambda c: c.withField("features", F.transform(c["features"], lambda v: v * huge))),
    )
    fitted = gmm.fit(training_rows(broken), (1,), task_data=task_data)
    assert sorted(r["status"] for r in fitted.collect()) == ["failed", "ok"]
    assert gmm.score(dataset, fitted).select("target").distinct().count() == 1


def payloads(df):
    keys = ("target", "portion", "param", "fold", "status", "n_rows", "n_iter")
    return {tuple(r[k] for k in keys): r["payload"] and np.frombuffer(r["payload"]) for r in df.collect()}


@pytest.mark.parametrize("family", ["gmm", "mlp", "ocsvm"])
def test_data_sets_train_alike_inside_a_task_and_over_tasks(dataset, family):
    rows = training_rows(dataset, family != "mlp").withColumn("fold", F.pmod(F.xxhash64("mol_id"), F.lit(3)).cast("int"))
    fit = {
        "gmm": lambda rows, **o: gmm.fit(rows, (1, 3, 5), (-1, 0, 1), start_rows=20, max_iter=8, **o),
        "mlp": lambda rows, **o: mlp.fit(rows, (6,), (-1, 2), max_iter=12, standardise=True, **o),
        "ocsvm": lambda rows, **o: ocsvm.fit(rows, (50, 20), (0,), max_iter=6, features=32, **o),
    }[family]
    here, spread = payloads(fit(rows)), payloads(fit(rows.repartition(5), task_data=0))
    assert here.keys() == spread.keys()
    for name, want in here.items():
        assert want == pytest.approx(spread[name], rel=1e-6, abs=1e-9), name


def test_trees_are_the_same_inside_a_task_and_over_tasks(dataset):
    rows = training_rows(dataset).withColumn("fold", F.pmod(F.xxhash64("mol_id"), F.lit(3)).cast("int"))
    rows = rows.withColumn("target", F.col("target").cast("int"))
    node_list = lambda df: sorted(map(tuple, iforest.nodes(df).collect()))
    here = node_list(iforest.fit(rows, (9, 4), (-1, 0, 2), rows_per_tree=20))
    assert here and here == node_list(iforest.fit(rows.repartition(5), (9, 4), (-1, 0, 2), rows_per_tree=20, task_data=0))


def test_slots_don_t_change_models(dataset, monkeypatch):
    rows = training_rows(dataset)
    one = payloads(gmm.fit(rows, (1, 2, 3), start_rows=9))
    monkeypatch.setattr(training, "SLOT_COST", 1)
    many = payloads(gmm.fit(rows.repartition(7, "mol_id"), (1, 2, 3), start_rows=9))
    assert one.keys() == many.keys() and all((one[k] == many[k]).all() for k in one)


def test_models_in_shards_score_like_whole_ones(dataset, monkeypatch):
    folded = dataset.withColumn("fold", F.pmod(F.xxhash64("mol_id"), F.lit(2)).cast("int"))
    mixtures = gmm.fit(training_rows(folded), (1, 9), (0, 1))
    forests = iforest.fit(training_rows(folded), (30, 7), (0, 1))
    whole = score_map(gmm.score(folded, mixtures)), score_map(iforest.score(folded, forests))
    monkeypatch.setattr(models, "SHARD_BYTES", 4000)
    monkeypatch.setattr(models, "CHUNK_BYTES", 3000)
    assert max(len(gmm._cut(bytes(r["payload"]), 4000)) for r in mixtures.collect()) > 3
    assert max(len(iforest._cut(bytes(r["payload"]), 4000)) for r in forests.collect()) > 3
    assert score_map(gmm.score(folded, mixtures)) == pytest.approx(whole[0])
    assert score_map(iforest.score(folded, forests)) == pytest.approx(whole[1])


def test_a_thousand_forests(dataset):
    """Models of a thousand data sets meet their molecules in one join."""
    many = dataset.filter("target = 0").withColumn("target", F.explode(F.sequence(F.lit(0), F.lit(999))))
    actives = training_rows(many).filter("target < 2")
    few = iforest.fit(actives, (3,))
    forests = few.filter("target = 0").drop("target").withColumn("target", F.explode(F.sequence(F.lit(0), F.lit(999))))
    forests = forests.select(few.columns)
    scores = iforest.score(many, forests)
    one = scores.filter("target = 0").count()
    assert one > 0 and scores.count() == 1000 * one


def test_starts_do_not_depend_on_the_grid(dataset):
    """The larger model of a grid draws a larger sample; the smaller one starts as it does alone."""
    rows = training_rows(dataset)
    alone = score_map(gmm.score(dataset, gmm.fit(rows, (2,), start_rows=6, covariance="diag")))
    both = score_map(gmm.score(dataset, gmm.fit(rows, (2, 9), start_rows=6, covariance="diag")))
    assert {k: v for k, v in both.items() if k[1] == 2} == pytest.approx(alone)


def test_losses_that_are_not_finite_fail(dataset):
    broken = dataset.withColumn(
        "conformers",
        F.transform("conformers", lambda c: c.withField("features", F.transform(c["features"], lambda v: v * 1e200))),
    )
    for fitted in (mlp.fit(training_rows(broken, False), (4,), max_iter=5), ocsvm.fit(training_rows(broken), max_iter=2)):
        found = fitted.collect()
        assert {r["status"] for r in found} == {"failed"} and all(r["payload"] is None for r in found)


def test_weight_penalty_is_an_argument(dataset):
    rows = training_rows(dataset, False)
    norm = lambda alpha: sum(
        float((mlp.decode(r["payload"])["layers"][0] ** 2).sum())
        for r in mlp.fit(rows, (8,), max_iter=40, alpha=alpha).collect()
    )
    assert norm(1e4) < norm(0.0)


def test_targets_may_have_other_widths(dataset):
    mixed = dataset.withColumn(
        "conformers",
        F.when(
            F.col("target") == 1,
            F.transform("conformers", lambda c: c.withField("features", F.slice(c["features"], 1, 12))),
        ).otherwise(F.col("conformers")),
    )
    fitted = mlp.fit(training_rows(mixed, False), (4,), max_iter=3).collect()
    assert {r["target"]: mlp.decode(r["payload"])["mean"].shape for r in fitted} == {0: (18,), 1: (12,)}
    assert {r["status"] for r in ocsvm.fit(training_rows(mixed), max_iter=2, features=16).collect()} == {"ok"}


def test_reductions(dataset):
    fitted = ocsvm.fit(training_rows(dataset), max_iter=4, features=32)
    by = {how: score_map(ocsvm.score(dataset, fitted, how)) for how in ("max", "min", "mean")}
    assert all(by["min"][k] <= by["mean"][k] + 1e-12 and by["mean"][k] <= by["max"][k] + 1e-12 for k in by["max"])
    turned = score_map(ocsvm.score(dataset, fitted, "max", np.negative))
    assert turned == pytest.approx({k: -v for k, v in by["min"].items()})
    with pytest.raises(ValueError):
        ocsvm.score(dataset, fitted, "median")


def test_short_molecules_are_shrunk_or_rejected(molecules):
    rows = molecules.filter("target = 0")
    status = {r["mol_id"]: r for r in gmm.mixture_status(rows).collect()}
    short = {m for m, r in status.items() if r["status"] == "short"}
    assert short and len(short) < len(status)
    kept = {r["mol_id"] for r in gmm.molecule_mixtures(rows, "diag", short="reject").collect()}
    assert kept == set(status) - short
    sizes = {r["mol_id"]: len(r["rows"]) for r in gmm.molecule_mixtures(rows, "diag").collect()}
    assert all(sizes[m] == min(r["k"], r["conformers"]) for m, r in status.items())
    with pytest.raises(ValueError):
        gmm.molecule_mixtures(rows, short="drop")


def test_rows_per_tree_is_an_argument(dataset):
    fitted = iforest.fit(training_rows(dataset), (3,), rows_per_tree=5).collect()
    assert all({n for n, _ in iforest.decode(r["payload"])} == {5} for r in fitted)
