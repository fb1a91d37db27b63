import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shapescreen.functions import bands
from shapescreen.operators import evaluation, ranking


def scores(spark, score, truth, group="a", template="t"):
    rows = pd.DataFrame({"target": group, "template_id": template, "mol_id": range(len(score)), "score": score, "truth": truth})
    return spark.createDataFrame(rows.astype({"score": float, "truth": bool}))


def single(df, column):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0][column]


def brute_auc(score, truth):
    score, truth = np.asarray(score, float), np.asarray(truth, bool)
    diff = score[truth][:, None] - score[~truth][None]
    return ((diff > 0) + 0.5 * (diff == 0)).mean()


def test_all_tied_scores_give_half(spark):
    assert single(evaluation.roc_auc(scores(spark, [1.0] * 6, [1, 0, 1, 0, 0, 1]), ["target"]), "auc") == 0.5


def test_auc_matches_brute_force_for_wide_and_tied_scores(spark):
    rng = np.random.default_rng(1)
    score = np.concatenate([rng.normal(size=300) * 10.0 ** rng.integers(-8, 8, 300), np.full(200, 0.25), [0.0, -0.0]])
    truth = rng.random(len(score)) < 0.3
    got = evaluation.roc_auc(scores(spark, score, truth), ["target"])
    assert single(got, "auc") == pytest.approx(brute_auc(score, truth), abs=1e-12)
    flipped = evaluation.roc_auc(scores(spark, -score, truth), ["target"])
    assert single(flipped, "auc") == pytest.approx(1 - brute_auc(score, truth), abs=1e-12)
    monotone = evaluation.roc_auc(scores(spark, np.arctan(score), truth), ["target"])
    assert single(monotone, "auc") == pytest.approx(brute_auc(np.arctan(score), truth), abs=1e-12)


def test_one_class_has_no_auc(spark):
    assert single(evaluation.roc_auc(scores(spark, [1, 2], [1, 1]), ["target"]), "auc") is None


def test_unusable_scores_are_cleaned(spark):
    score = [math.nan, math.inf, -math.inf, 1.0]
    hist = ranking.score_histogram(scores(spark, score, [0, 1, 0, 1]), ["target"]).orderBy("score").collect()
    assert [r["score"] for r in hist] == [-1.7976931348623157e308, 0.0, 1.0, 1.7976931348623157e308]


def test_average_ranks(spark):
    counted = evaluation.counts(scores(spark, [10, 20, 20, 30], [0, 1, 0, 1]), ["target"])
    ranks = {r["score"]: r["avg_rank"] for r in ranking.average_ranks(counted, ["target"]).collect()}
    assert ranks == {10: 1, 20: 2.5, 30: 4}


def test_rank_auc_pools_ranks_over_templates(spark):
    a = scores(spark, [1, 2, 3, 4], [0, 1, 0, 1], template="t1")
    b = scores(spark, [400, 100, 300, 300], [0, 1, 0, 1], template="t2")
    pooled = pd.concat([x.toPandas() for x in (a, b)])
    pooled["r"] = pooled.groupby("template_id")["score"].rank()
    want = brute_auc(pooled["r"], pooled["truth"])
    assert single(evaluation.rank_auc(a.union(b), ["target"]), "auc_rank") == pytest.approx(want)


def test_enrichment_of_a_perfect_order(spark):
    efs = evaluation.enrichment(scores(spark, range(100, 0, -1), [1] * 5 + [0] * 95), ["target"]).collect()
    assert {r["threshold"]: (r["top_n"], r["ef"]) for r in efs} == {0.01: (1, 20.0), 0.05: (5, 20.0)}


def test_enrichment_of_no_rows_is_infinite(spark):
    efs = evaluation.enrichment(scores(spark, range(50), [1] * 5 + [0] * 45), ["target"], (0.01,)).collect()
    assert (efs[0]["top_n"], efs[0]["ef"]) == (0, math.inf)


def test_low_scores_first_for_distances(spark):
    efs = evaluation.enrichment(scores(spark, range(100), [1] * 5 + [0] * 95), ["target"], (0.05,), "dist").collect()
    assert efs[0]["ef"] == 20.0


@pytest.mark.parametrize("limit", [100_000, 0])
def test_enrichment_inside_a_mixed_tie_takes_whole_rows(spark, monkeypatch, limit):
    import hashlib

    monkeypatch.setattr(evaluation, "_MAX_BROADCAST_CUTS", limit)
    rng = np.random.default_rng(2)
    score = np.concatenate([[5.0] * 7, [3.0] * 900, rng.random(93)])
    truth = rng.random(1000) < 0.2
    order = sorted(range(1000), key=lambda i: (-score[i], hashlib.md5(f"0:{i}".encode()).hexdigest()))
    want = {t: truth[order[: int(t * 1000)]].sum() / (truth.mean() * int(t * 1000)) for t in (0.01, 0.05, 0.5)}
    got = evaluation.enrichment(scores(spark, score, truth), ["target"], (0.01, 0.05, 0.5)).collect()
    assert {r["threshold"]: r["ef"] for r in got} == pytest.approx(want)


def test_roc_points_start_at_the_origin_and_end_at_one(spark):
    points = evaluation.roc_points(scores(spark, [4, 3, 3, 1], [1, 1, 0, 0]), ["target"]).toPandas()
    assert sorted(zip(points["fpr"], points["tpr"])) == [(0, 0), (0, 0.5), (0.5, 1), (1, 1)]


def test_numbered_equals_row_number_under_skew(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"g": np.where(rng.random(3000) < 0.4, 0, rng.integers(1, 50, 3000)), "v": rng.permutation(3000)})
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(frame).withColumn("cell", F.floor(F.col("v") / 100))
    got = ranking.numbered(rows, ["g"], "cell", ["v"]).toPandas().sort_values("v")
    want = frame.sort_values("v").groupby("g")["v"].rank().astype(int)
    assert (got["rn"].to_numpy() == want.to_numpy()).all()


def test_report_agrees_with_single_measures(spark):
    rng = np.random.default_rng(4)
    parts = [scores(spark, rng.integers(0, 60, 200), rng.random(200) < 0.1, template=t) for t in ("x", "y", "z")]
    pool = parts[0].union(parts[1]).union(parts[2])
    row = evaluation.evaluate(pool, ["target"], "template_id").first()
    assert row["auc"] == pytest.approx(single(evaluation.roc_auc(pool, ["target"]), "auc"))
    assert row["auc_rank"] == pytest.approx(single(evaluation.rank_auc(pool, ["target"]), "auc_rank"))
    means = {r["threshold"]: r["mean_ef"] for r in evaluation.mean_enrichment(pool, ["target"]).collect()}
    assert (row["ef_1"], row["ef_5"]) == pytest.approx((means[0.01], means[0.05]))


def test_measures_never_shuffle_to_one_task(spark):
    pool = scores(spark, range(50), [1, 0] * 25)
    for df in (evaluation.roc_auc(pool, ["target"]), evaluation.rank_auc(pool, ["target"])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan and "CartesianProduct" not in plan


def skewed(rng, n=3000):
    """Scores near 1.7e9, some far away and many ties: one group holds two thirds of the rows."""
    return np.concatenate([1.7e9 + rng.normal(size=n - 600).round(3), rng.normal(size=300) * 10.0 ** rng.integers(-300, 300, 300), np.full(300, 1.7e9)])


def test_bands_follow_the_data(spark, monkeypatch):
    monkeypatch.setattr(bands, "BAND_ROWS", 50)
    rng = np.random.default_rng(4)
    score = skewed(rng)
    hist = ranking.score_histogram(scores(spark, score, score > 1.7e9), ["target"]).cache()
    per_band = [r["count"] for r in hist.groupBy("band").count().collect()]
    assert len(per_band) > 20 and max(per_band) < 4 * 50
    ordered = hist.orderBy("score").collect()
    places = [(r["band"], r["fine"]) for r in ordered]
    assert places == sorted(places) and len({r["fine"] for r in ordered}) > 20


def test_measures_do_not_depend_on_the_bands(spark, monkeypatch):
    rng = np.random.default_rng(5)
    score = skewed(rng)
    truth = rng.random(len(score)) < 0.3
    rows = scores(spark, score, truth, template=[f"t{i % 3}" for i in range(len(score))])
    want = evaluation.evaluate(rows, ["target"], "template_id").collect()
    points = sorted(map(str, evaluation.roc_points(rows, ["target"]).collect()))
    monkeypatch.setattr(bands, "BAND_ROWS", 40)
    assert evaluation.evaluate(rows, ["target"], "template_id").collect()[0] == pytest.approx(tuple(want[0]), nan_ok=True)
    assert want[0]["auc"] == pytest.approx(brute_auc(score, truth), abs=1e-12)
    assert sorted(map(str, evaluation.roc_points(rows, ["target"]).collect())) == points


def test_tasks_of_a_histogram_grow_with_its_rows(spark, monkeypatch):
    monkeypatch.setattr(bands, "BAND_ROWS", 50)
    scores = spark.range(4000).select((F.col("id") % 2).alias("g"), (F.col("id") / 7).alias("score"), (F.col("id") % 3 == 0).alias("truth"))
    hist = ranking.score_histogram(scores, ["g"])
    assert hist.rdd.getNumPartitions() == 80
    dealt = hist.select("g", "band", F.spark_partition_id().alias("task"))
    assert dealt.groupBy("task").count().agg(F.max("count")).first()[0] < 4000 / 8
    assert dealt.groupBy("g", "band").agg(F.count_distinct("task").alias("n")).filter("n > 1").count() == 0
