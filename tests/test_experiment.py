import math

import pytest
from pyspark.sql import functions as F

from shapescreen.operators import sampling
from shapescreen.plans import experiment
from shapescreen.plans.experiment import FAMILIES
from shapescreen.sources.store import RunLog


def table(spark, actives, decoys):
    rows = [("t", i, True) for i in range(actives)] + [("t", actives + i, False) for i in range(decoys)]
    return spark.createDataFrame(rows, "target string, mol_id bigint, active boolean")


def counts(df):
    r = df.agg(F.count_if("active").alias("a"), F.count_if(~F.col("active")).alias("d")).first()
    return r["a"], r["d"]


def test_quota_rules(spark):
    rows = table(spark, 100, 300)
    # 0.1 * 0.2 * 100 is a little above 2, so three actives are taken.
    assert counts(sampling.draw(rows, (0.1,), 0.2, 0, "RANDOM")) == (3, 0)
    assert counts(sampling.draw(rows, (0.5,), 1.0, 1.0)) == (50, 50)
    assert counts(sampling.draw(rows, (0.5,), 1.0, -1)) == (50, 150)
    assert counts(sampling.draw(rows, (10.0,), 0.2, -1)) == (2, 6)
    assert counts(sampling.draw(rows, (1.0,), 1.0, 5.0)) == (100, 300)
    # Exclusions leave 20 actives; the wanted total is filled up with decoys.
    used = rows.filter("mol_id < 80").withColumn("portion", F.lit(0.5))
    assert counts(sampling.draw(rows, (0.5,), 1.0, 1.0, exclude=used)) == (20, 80)


def test_sequential_order_is_that_of_file_names(spark):
    drawn = sampling.draw(table(spark, 12, 0), (4.0,), 1.0, 0)
    assert sorted(r["mol_id"] for r in drawn.collect()) == [0, 1, 10, 11]


def test_same_seed_same_rows_whatever_the_partitions(spark):
    rows = table(spark, 300, 900)
    a = {tuple(r) for r in sampling.draw(rows, (0.3,), 1, -1, "RANDOM", 5).collect()}
    b = {tuple(r) for r in sampling.draw(rows.repartition(13), (0.3,), 1, -1, "RANDOM", 5).collect()}
    c = {tuple(r) for r in sampling.draw(rows, (0.3,), 1, -1, "RANDOM", 6).collect()}
    assert a == b and a != c


def test_folds(spark):
    rows = table(spark, 3, 20)
    folded = sampling.kfold(rows, 5, ["target"]).collect()
    assert len(folded) == 20 and len({r["mol_id"] for r in folded}) == 20
    assert sorted(r["fold"] for r in folded) == sorted(list(range(5)) * 4)
    assert sampling.kfold(rows, 24, ["target"]).count() == 0
    assert sampling.kfold(rows, 23, ["target"]).count() == 23


def test_take_portion_excludes(spark):
    rows = table(spark, 5, 15)
    first = sampling.take_portion(rows, 0.5, ["target"], seed=1)
    rest = sampling.take_portion(rows, 15, ["target"], seed=2, exclude=first)
    assert first.count() == 10 and rest.count() == 10
    assert first.join(rest, "mol_id").count() == 0


def test_split_keeps_test_molecules_out_of_training(spark, molecules):
    data = experiment.split(molecules, (1.0, 0.3), 3)
    key = ["target", "portion", "mol_id"]
    for other in (data.train, data.cross, data.redraw):
        assert data.test.join(other, key).count() == 0
    # The redraw asks for actives; only a shortfall is filled up with decoys, which training leaves out.
    total = {r["target"]: r["n"] for r in molecules.filter("active").groupBy("target").agg(F.count("*").alias("n")).collect()}
    held = data.test.filter("active").groupBy("target", "portion").count().collect()
    left = {(r["target"], r["portion"]): total[r["target"]] - r["count"] for r in held}
    drawn = data.redraw.groupBy("target", "portion").agg(F.count_if("active").alias("a"), F.count("*").alias("n"))
    for r in drawn.collect():
        want = math.ceil(total[r["target"]] * (r["portion"] * 0.8))
        assert (r["a"], r["n"]) == (min(want, left[r["target"], r["portion"]]), want)
    assert data.cross.groupBy(*key).count().filter("count > 1").count() == 0


def test_first_parameter_wins_ties(spark):
    rows = [("a", 1.0, 10, 2.0), ("a", 1.0, 1, 2.0), ("b", 1.0, 1, 1.0), ("b", 1.0, 10, 3.0), ("c", 1.0, 1, None), ("c", 1.0, 10, None)]
    summary = spark.createDataFrame(rows, "target string, portion double, param int, mean_ef_1 double")
    best = experiment.best_param(summary, "ef_1", (1, 10)).collect()
    assert {r["target"]: r["best_param"] for r in best} == {"a": 1, "b": 10, "c": 1}


@pytest.mark.parametrize("name, params, options", [("gmm", (1, 2), {}), ("iforest", (10, 5), {})])
def test_whole_experiment(spark, molecules, name, params, options):
    few = molecules.filter("target < 2")
    result = experiment.run(few, FAMILIES[name], (1.0,), params, 3, **options)
    assert result.xval.count() == 2 * len(params)
    assert {r["folds"] for r in result.xval.collect()} <= {0, 1, 2, 3}
    final = result.final.collect()
    assert len(final) == 2 and all(0 <= r["auc"] <= 1 and r["elapsed_s"] > 0 for r in final)
    best = {r["target"]: r["best_param"] for r in result.best.collect()}
    assert {r["target"]: r["param"] for r in result.models.collect()} == best


def test_screening_results_for_several_descriptor_types(spark):
    from check_oracle import SMALL

    from shapescreen.operators.molecules import union_frames
    from shapescreen.sources import embeddings

    both = union_frames(*[embeddings.molecules(spark, SMALL, d).filter("target < 2") for d in ("usr", "es5")])
    whole = experiment.screening_results(both).collect()
    assert {(r["target"], r["dtype"], r["portion"]) for r in whole} == {(t, d, 1.0) for t in (0, 1) for d in ("usr", "es5")}
    parts = experiment.screening_results(both, (0.8, 0.5)).collect()
    assert len(parts) == 8 and all(r["elapsed_s"] > 0 and 0 <= r["auc"] <= 1 for r in parts)


def test_lumped_samples_hold_every_conformer(molecules):
    sample = sampling.draw(molecules, (0.5,), 1.0, 1.0, "RANDOM", 1)
    lumped = sampling.with_descriptors(sample, molecules, "LUMPED")
    packed = sampling.with_descriptors(sample, molecules)
    assert packed.count() == sample.count()
    assert lumped.count() == packed.agg(F.sum(F.size("conformers"))).first()[0]


def test_gaps_and_counts_with_several_types_and_repeats(spark):
    from shapescreen.operators.molecules import label_counts, numbering_gaps

    rows = [("t", d, f"active_mol_{n}", True, n) for d in ("usr", "esh", "es5") for n in (0, 1, 3, 5, 7, 8, 8)]
    table = spark.createDataFrame(rows, "target string, dtype string, mol_id string, active boolean, mol_no int")
    gaps = {(r["dtype"], r["mol_no"]) for r in numbering_gaps(table).collect()}
    assert gaps == {(d, n) for d in ("usr", "esh", "es5") for n in (2, 4, 6)}
    assert {r["mol_no"] for r in numbering_gaps(table.drop("dtype")).collect()} == {2, 4, 6}
    assert [tuple(r) for r in label_counts(table).collect()] == [("t", 6, 0)]
    assert {r["num_actives"] for r in label_counts(table, ("target", "dtype")).collect()} == {6}


def test_decoys_below_the_actives_leave_gaps(spark):
    from shapescreen.operators.molecules import numbering_gaps

    rows = [("t", True, n) for n in range(5)] + [("t", False, n) for n in (0, 1, 2, 6, 8)]
    table = spark.createDataFrame(rows, "target string, active boolean, mol_no int")
    assert sorted(r["mol_no"] for r in numbering_gaps(table).collect()) == [5, 7]


def test_names_with_a_common_stem_spread_over_cells(spark):
    rows = spark.range(2000).selectExpr("'t' AS target", "concat('active_mol_', id) AS mol_id", "true AS active")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cells = sampling._ordered(rows, "SEQUENTIAL", 0, None).select("cell").distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert cells > 4
    drawn = sampling.draw(rows, (3.0,), 1.0, 0).collect()
    assert sorted(r["mol_id"] for r in drawn) == ["active_mol_0", "active_mol_1", "active_mol_10"]


def test_quotas_of_all_files(spark):
    usable = table(spark, 6, 12)
    totals = spark.createDataFrame([("t", 10, 20)], "target string, num_actives bigint, num_decoys bigint")
    assert counts(sampling.draw(usable, (0.5,), 1.0, 1.0, totals=totals)) == (5, 5)
    assert counts(sampling.draw(usable, (0.5,), 1.0, 1.0)) == (3, 3)


def test_resume_skips_finished_targets(spark, molecules, tmp_path, monkeypatch):
    folder = str(tmp_path / "runs")
    family, options = FAMILIES["gmm"], {"portions": (1.0,), "params": (1,), "folds": 2, "covariance": "diag"}
    log = experiment.resume(molecules.filter("target = 3"), family, folder, **options)
    # A run that stopped before its commit left a result that nobody sees.
    log.write("results", log.start(), log.read("results").drop("run").withColumn("target", F.lit(4).cast("bigint")))
    ran = []
    run = experiment.run
    monkeypatch.setattr(
        experiment, "run", lambda m, *a, **k: ran.append({r[0] for r in m.select("target").distinct().collect()}) or run(m, *a, **k)
    )
    both = molecules.filter("target in (3, 4)")
    log = experiment.resume(both, family, folder, **options)
    assert ran == [{4}] and sorted(r["target"] for r in log.read("results").collect()) == [3, 4]
    assert experiment.resume(both, family, folder, **options).read("results").count() == 2 and len(ran) == 1
    assert log.read("models").count() == 2


def test_a_target_that_two_runs_finished_is_read_once(spark, tmp_path):
    log = RunLog(spark, str(tmp_path / "runs"))
    assert log.read("results") is None and log.pending(spark.range(2).withColumnRenamed("id", "target")).count() == 2
    rows = spark.createDataFrame([(0, 1.0), (1, 2.0)], "target long, auc double")
    first, second = log.start(), log.start()
    for run, part in ((second, rows), (first, rows.filter("target = 0"))):
        log.write("results", run, part)
        log.commit(run, part)
    assert sorted((r["target"], r["run"]) for r in log.read("results").collect()) == [(0, first), (1, second)]
    assert log.read("models") is None


def test_split_stores_descriptors_once(spark, molecules, monkeypatch):
    written = []
    own = experiment.stage
    monkeypatch.setattr(experiment, "stage", lambda df, name: written.append(df.columns) or own(df, name))
    data = experiment.split(molecules, (1.0, 0.5), 3)
    parts = [data.test, data.train, data.cross, data.redraw]
    assert [c for c in written if "conformers" in c] == [["target", "mol_id", "active", "conformers", "roles"]]
    roles = data.molecules.select(F.explode("roles")).count()
    assert all(p.count() for p in parts) and sum(p.count() for p in parts) == roles


def test_types_run_one_by_one(spark, molecules):
    one = molecules.filter("target = 3")
    other = one.withColumn("dtype", F.lit("usr"))
    found = experiment.run_types(
        one.unionByName(other), FAMILIES["gmm"], ("es5", "usr"), portions=(1.0,), params=(1,), folds=2, covariance="diag"
    )
    assert sorted(r["dtype"] for r in found.final.collect()) == ["es5", "usr"]
    report = experiment.screening_report(one.unionByName(other)).collect()
    assert sorted(r["dtype"] for r in report) == ["es5", "usr"]
