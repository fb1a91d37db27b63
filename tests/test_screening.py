import numpy as np
import pytest
from pyspark.sql import functions as F

from shapescreen.functions import similarity
from shapescreen.functions.packed import Packed
from shapescreen.operators import screening
from shapescreen.operators.screening import screen


def brute(molecules, lec=False):
    rows = molecules.filter("target < 2").collect()
    out = {}
    for t in rows:
        if not t["active"]:
            continue
        a = np.array([c["features"] for c in t["conformers"]][: 1 if lec else None])
        for m in rows:
            if m["target"] == t["target"]:
                b = np.array([c["features"] for c in m["conformers"]])
                dist = np.abs(a[:, None] - b[None]).sum(-1)
                out[t["target"], t["mol_id"], m["mol_id"]] = 1 / (1 + dist.min() / a.shape[1])
    return out


def as_dict(df):
    return {(r["target"], r["template_id"], r["mol_id"]): r["score"] for r in df.filter("target < 2").collect()}


@pytest.mark.parametrize("mode", ["all", "lec"])
def test_screening_matches_brute_force_in_both_layouts(spark, molecules, mode):
    want = brute(molecules, mode == "lec")
    near = as_dict(screen(molecules, mode))
    spread = as_dict(screen(molecules, mode, max_broadcast=0))
    assert near == spread
    assert near == pytest.approx(want)


def test_self_similarity_symmetry_and_range(spark, molecules):
    got = as_dict(screen(molecules))
    for (target, a, b), value in got.items():
        assert 0 < value <= 1
        if a == b:
            assert value == 1
        if (target, b, a) in got:
            assert value == pytest.approx(got[target, b, a])


def test_truth_is_the_candidates_label(spark, molecules):
    labels = {(r["target"], r["mol_id"]): r["active"] for r in molecules.collect()}
    for r in screen(molecules).collect():
        assert r["truth"] == labels[r["target"], r["mol_id"]]


def test_own_kernel(spark, molecules):
    def nearest(templates: Packed, candidates: Packed) -> np.ndarray:
        gap = ((templates.values[:, None] - candidates.values[None]) ** 2).sum(-1)
        best = np.minimum.reduceat(np.minimum.reduceat(gap, templates.starts, 0), candidates.starts, 1)
        return -best

    got = as_dict(screen(molecules, kernel=nearest))
    assert max(got.values()) == 0 and len(got) == len(as_dict(screen(molecules)))


def test_hand_computed_similarities(spark):
    a = Packed(np.array([[0.0], [4.0]]), np.array([0]), None)
    b = Packed(np.array([[1.0], [9.0]]), np.array([0]), None)
    one = Packed(np.array([[0.0, 0.0]]), np.array([0]), None)
    two = Packed(np.array([[1.0, 3.0]]), np.array([0]), None)

    class Ids:
        def slice(self, *_):
            return self

    for p in (a, b, one, two):
        p.ids = Ids()
    assert similarity.best_shape_match(a, b)[0, 0] == 0.5
    assert similarity.best_shape_match(one, two)[0, 0] == pytest.approx(1 / 3)
    row = spark.createDataFrame([([0.0, 0.0], [1.0, 3.0])], "a array<double>, b array<double>")
    value = row.select(similarity.manhattan_similarity(F.col("a"), F.col("b"), 2).alias("s")).first()["s"]
    assert value == pytest.approx(1 / 3)


def test_blocks_larger_than_one_piece_agree(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(0)
    make = lambda n: Packed(rng.random((n * 3, 4)), np.arange(n) * 3, pa.array(range(n)))
    a, b = make(40), make(70)
    whole = similarity.best_shape_match(a, b)
    monkeypatch.setattr(similarity, "_TEMPLATE_ROWS", 7)
    monkeypatch.setattr(similarity, "_CANDIDATE_ROWS", 5)
    assert (similarity.best_shape_match(a, b) == whole).all()


def test_few_templates_need_no_shuffle(spark, molecules):
    plan = screen(molecules)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


@pytest.mark.parametrize("max_broadcast", [20_000, 0])
@pytest.mark.parametrize("as_text", [False, True])
def test_pruned_best_candidates_equal_those_of_the_whole_matrix(spark, max_broadcast, as_text):
    from shapescreen.operators import nearest, ranking

    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 6)) * 30
    rows = []
    for i in range(900):
        x = centres[i % 12] + rng.normal(size=(1 + i % 3, 6)).round(1)
        rows.append((i % 2, f"m{i}" if as_text else i, i % 40 < 2, [(float(j), j, v.tolist()) for j, v in enumerate(x)]))
    kind = "string" if as_text else "long"
    schema = f"target long, mol_id {kind}, active boolean, conformers array<struct<energy:double,conf_id:int,features:array<double>>>"
    molecules = spark.createDataFrame(rows, schema).repartition(3, "mol_id")
    whole = screen(molecules).withColumn("score", F.round("score", 9))
    want = ranking.top_k(whole, ["target", "template_id"], 7)
    pairs, skipped = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    got = nearest.screen_top(molecules, 7, max_broadcast=max_broadcast, pairs=pairs, skipped=skipped)
    names = ["target", "template_id", "position", "mol_id", "score", "truth"]
    assert sorted(map(tuple, got.select(names).collect())) == sorted(map(tuple, want.select(names).collect()))
    assert pairs.value >= whole.count() and skipped.value > 0.3 * pairs.value


def test_every_data_set_is_cut_into_chunks_on_its_own(spark, monkeypatch):
    monkeypatch.setattr(screening, "_TEMPLATES_PER_CHUNK", 10)
    monkeypatch.setattr(screening, "_CANDIDATES_PER_CHUNK", 10)
    rows = F.array(F.array(F.col("id").cast("double"), F.lit(0.5)))
    made = spark.range(160).select((F.col("id") % 8).alias("target"), F.col("id").alias("mol_id"), rows.alias("rows"))
    left = made.withColumnRenamed("mol_id", "template_id")
    right = made.withColumn("truth", F.lit(True))
    # 20 molecules a target are two chunks, whatever the other targets hold.
    met = screening._chunked(left, right, ["target"]).select(F.size("templates") * F.size("candidates")).collect()
    assert len(met) <= 8 * 2 * 2
    assert sum(r[0] for r in met) == 8 * 20 * 20
    # Large molecules make more chunks of bounded bytes.
    monkeypatch.setattr(screening, "_CHUNK_BYTES", 5 * 16)
    assert screening._chunks_of_largest(made, ["target"], 10) == 4


@pytest.mark.parametrize("kind", ["long", "double"])
def test_tasks_follow_the_pairs_and_not_the_bytes(spark, monkeypatch, kind):
    monkeypatch.setattr(screening, "_CANDIDATES_PER_CHUNK", 10)
    monkeypatch.setattr(screening, "_SALT_PAIRS", 2_000, raising=False)
    monkeypatch.setattr(screening, "_TASK_PAIRS", 1_000, raising=False)
    rows = F.array(F.array(F.col("id").cast("double"), F.lit(0.5)))
    made = spark.range(400).select((F.col("id") % 2).cast(kind).alias("target"), F.col("id").alias("mol_id"), rows.alias("rows"))
    met = screening._chunked(made.withColumnRenamed("mol_id", "template_id"), made.withColumn("truth", F.lit(True)), ["target"])
    pairs = F.size("templates") * F.size("candidates")
    found = met.select(F.spark_partition_id().alias("task"), pairs.alias("pairs")).groupBy("task").agg(F.sum("pairs").alias("pairs")).collect()
    assert sum(r["pairs"] for r in found) == 2 * 200 * 200
    # 80 partitions for 40 salts; adaptive execution does not put these few bytes together.
    assert len(found) >= 20 and max(r["pairs"] for r in found) <= 5 * 2_000


def test_best_of_scattered_candidates_are_found_without_scoring_most_pairs():
    import pyarrow as pa

    from shapescreen.operators import nearest

    rng = np.random.default_rng(9)

    def made(n, first):
        counts = rng.integers(1, 4, n)
        return Packed(rng.normal(size=(counts.sum(), 18)), np.cumsum(counts) - counts, pa.array(range(first, first + n)))

    templates, candidates = made(50, 0), made(4000, 100)
    whole = np.round(similarity.best_shape_match(templates, candidates), 9)
    counted = {"pairs": 0, "skipped": 0}
    best = nearest.Best(10, 9)
    best.count = lambda pairs, skipped: counted.update(pairs=counted["pairs"] + pairs, skipped=counted["skipped"] + skipped)
    for lo in range(0, 4000, 1000):
        best.see((0,), templates, candidates.piece(lo, lo + 1000), np.ones(1000, bool))
    kinds = nearest._kinds(["k"], pa.schema([("k", pa.int64())]), pa.int64(), pa.int64())
    rows = [r for batch in best.rows(["k"], kinds) for r in batch.to_pylist()]
    for t in range(50):
        want = sorted(zip(-whole[t], range(100, 4100)))[:10]
        assert [(-r["score"], r["mol_id"]) for r in rows if r["template_id"] == t] == want
    assert counted["pairs"] == 50 * 4000 and counted["skipped"] > 0.9 * counted["pairs"]
