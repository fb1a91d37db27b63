import pytest
from pyspark.sql import functions as F

from shapescreen.operators import molecules as mols
from shapescreen.sources import descriptors, store


def line(i, features, energy, extra="9"):
    return ",".join([str(i), *map(str, features), str(energy), extra])


@pytest.fixture(scope="module")
def home(tmp_path_factory):
    home = tmp_path_factory.mktemp("home")
    for target in ("ace", "ada"):
        folder = home / target
        folder.mkdir()
        for i in range(12):
            label = "active" if i < 3 else "decoy"
            body = [line(c, [i, c, 0.5], (c * 7 + i) % 5 - 2) for c in range(4)]
            (folder / f"{label}_mol_{i}.usr").write_text("\n".join([str(i % 4), *body]) + "\n")
    ada = home / "ada"
    (ada / "active_mol_1.usr").write_text("2\n0,1,,3,-1,9\n1,NaN,5,6,,9\n")
    (ada / "decoy_mol_3.usr").write_text("two\n0,1,2,3,-1,9\n")
    (ada / "decoy_mol_4.usr").write_text("2\n")
    (ada / "decoy_mol_5.usr").write_text("2\n0,1,2,3,-1,9\n1,1,2,3,4,-1,9\n")
    (ada / "decoy_mol_6.usr").write_text("2\n0,1,2,3,-1,9\n1,4,5\n")
    (ada / "decoy_mol_7.usr").write_text("1\n0,1,2,x,-1,9\n")
    (ada / "decoy_mol_13.usr").write_text("1\n0,1,2,3,-1,9\n")
    (ada / "active_mol_0.esh").write_text("1\n0,1,2,3,4,-1,9\n")
    (ada / "notes.usr").write_text("none of this is a molecule")
    return str(home)


def test_scan_labels_and_order(spark, home):
    table = descriptors.molecules(descriptors.read_descriptors(spark, home, "usr"))
    rows = {(r["target"], r["mol_id"]): r for r in table.collect()}
    assert len(rows) == 12 + 13 - 4
    first = rows["ace", "active_mol_2"]
    assert first["active"] and first["n_rot"] == 2 and first["mol_no"] == 2
    energies = [c["energy"] for c in first["conformers"]]
    assert energies == sorted(energies) and len(energies) == 4
    assert first["conformers"][0]["features"] == [2.0, first["conformers"][0]["conf_id"], 0.5]


def test_missing_cells_are_zero_and_short_rows_are_filled(spark, home):
    table = descriptors.molecules(descriptors.read_descriptors(spark, home, "usr"))
    rows = {(r["target"], r["mol_id"]): r["conformers"] for r in table.collect()}
    by_id = {c["conf_id"]: (c["features"], c["energy"]) for c in rows["ada", "active_mol_1"]}
    assert by_id == {0: ([1.0, 0.0, 3.0], -1.0), 1: ([0.0, 5.0, 6.0], 0.0)}
    assert [c["features"] for c in rows["ada", "decoy_mol_6"] if c["conf_id"] == 1] == [[4.0, 5.0, 0.0]]


def test_unusable_files_are_listed(spark, home):
    bad = descriptors.rejects(descriptors.read_descriptors(spark, home, "usr"))
    reasons = {r["path"].rsplit("/", 1)[1]: r["reason"] for r in bad.collect()}
    assert reasons == {
        "decoy_mol_3.usr": "bad first line",
        "decoy_mol_4.usr": "no conformers",
        "decoy_mol_5.usr": "ragged row",
        "decoy_mol_7.usr": "not a number",
    }


def test_feature_count_is_derived(spark, home):
    table = descriptors.molecules(descriptors.read_descriptors(spark, home, "esh"))
    assert [len(r["conformers"][0]["features"]) for r in table.collect()] == [4]


def test_listing_counts_and_gaps(spark, home):
    files = descriptors.list_files(spark, home, "usr")
    counts = {r["target"]: (r["num_actives"], r["num_decoys"]) for r in mols.label_counts(files).collect()}
    assert counts == {"ace": (3, 9), "ada": (3, 10)}
    gaps = mols.numbering_gaps(files.filter("mol_id not in ('active_mol_1', 'decoy_mol_8')"))
    got = {(r["target"], r["active"], r["mol_no"]) for r in gaps.collect()}
    assert got == {(t, True, 1) for t in ("ace", "ada")} | {(t, False, 8) for t in ("ace", "ada")} | {("ada", False, 12)}


def test_gaps_across_cells_match_brute_force(spark):
    present = set(range(0, 200_000)) - {5, 65_535, 65_536, 131_072}
    decoys = set(range(200_000, 270_000)) - {200_000, 262_144}
    rows = spark.createDataFrame([("t", True, i) for i in present] + [("t", False, i) for i in decoys], "target string, active boolean, mol_no int")
    got = {(r["active"], r["mol_no"]) for r in mols.numbering_gaps(rows).collect()}
    assert got == {(True, i) for i in (5, 65_535, 65_536, 131_072)} | {(False, i) for i in (200_000, 262_144)}


def test_compact_and_views(spark, home, tmp_path):
    files = descriptors.read_descriptors(spark, home, "usr")
    descriptors.compact(files, str(tmp_path / "molecules"))
    table = spark.read.parquet(str(tmp_path / "molecules"))
    assert table.count() == descriptors.molecules(files).count()
    plan = table.filter("target = 'ace'").select("mol_id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(target" in plan and "conformers" not in plan.split("ReadSchema")[1]
    lowest = mols.conformers(mols.lowest_energy(table))
    best = mols.conformers(table).groupBy("target", "mol_id").agg(F.min("energy").alias("energy"))
    assert lowest.join(best, ["target", "mol_id", "energy"]).count() == table.count()


def test_results_resume_and_models(spark, tmp_path):
    done = spark.createDataFrame([("a", 0.5), ("b", None)], "target string, auc double")
    store.append_results(store.with_status(done), str(tmp_path / "results"))
    store.append_results(store.with_status(done.filter("target = 'a'")), str(tmp_path / "results"))
    saved = spark.read.parquet(str(tmp_path / "results"))
    assert saved.count() == 3 and {r["status"] for r in saved.collect()} == {"ok", "skipped"}
    targets = spark.createDataFrame([("a",), ("b",), ("c",)], "target string")
    assert [r["target"] for r in store.pending_targets(targets, saved).collect()] == ["c"]
    store.append_results(done, str(tmp_path / "json"), "json")
    assert spark.read.json(str(tmp_path / "json")).count() == 2
