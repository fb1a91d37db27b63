import numpy as np
import pytest
from pyspark.sql import functions as F

from shapescreen.operators import evaluation, lists, ranking
from shapescreen.operators.lists import ScreenLists, half_up
from shapescreen.operators.screening import screen

LISTS = ["target", "template_id"]


@pytest.fixture(scope="module")
def tied(spark):
    """Coarse features, so that most scores are shared by molecules of both labels; some labels are NULL."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(260):
        target, active = (0, i % 5 == 0) if i < 200 else (1, i % 3 == 0)
        x = rng.integers(0, 3, (1 + i % 3, 2)).astype(float)
        poses = [(float(j), j, v.tolist()) for j, v in enumerate(x)]
        rows.append((target, i, None if i % 37 == 36 else active, poses))
    rows.append((1, 900, True, []))
    schema = "target long, mol_id long, active boolean, conformers array<struct<energy:double,conf_id:int,features:array<double>>>"
    return spark.createDataFrame(rows, schema).repartition(5, "mol_id")


def normal(df):
    df = df.select(*sorted(df.columns))
    return sorted(str([f"{v:.9g}" if isinstance(v, float) else v for v in row]) for row in df.collect())


def pairs(molecules):
    return screen(molecules).withColumn("score", F.round("score", 9))


def expected(molecules):
    scores = pairs(molecules).cache()
    return {
        "average_ranks": ranking.average_ranks(evaluation.counts(scores, LISTS), LISTS).drop("pos"),
        "rank_auc": evaluation.rank_auc(scores, ["target"]),
        "enrichment": evaluation.enrichment(scores, LISTS, (0.0, 0.01, 0.05, 0.3, 1.0)),
        "from_below": evaluation.enrichment(scores, LISTS, (0.0, 0.05, 0.3), "dist"),
        "figures": evaluation.evaluate(scores, ["target"], "template_id"),
    }


def measured(molecules):
    found = ScreenLists(molecules, digits=9)
    return {
        "average_ranks": found.average_ranks(),
        "rank_auc": found.rank_auc(),
        "enrichment": found.enrichment((0.0, 0.01, 0.05, 0.3, 1.0)),
        "from_below": found.enrichment((0.0, 0.05, 0.3), "dist"),
        "figures": found.figures(),
    }


@pytest.mark.parametrize("limit", [lists.LISTS_BYTES, 16 * 200, 0])
def test_measures_equal_those_of_rows_per_pair(tied, monkeypatch, limit):
    # All templates together, a few at a time, and rows per pair.
    monkeypatch.setattr(lists, "LISTS_BYTES", limit)
    want, got = expected(tied), measured(tied)
    for name in want:
        assert normal(got[name]) == normal(want[name]), name


def test_rank_measures_neither_shuffle_nor_store_pairs(tied, monkeypatch):
    def none(*_, **__):
        raise AssertionError("a row per pair")

    monkeypatch.setattr(lists, "screen", none)
    found = ScreenLists(tied, digits=9)
    assert found.rank_auc().count() == 2 and found.mean_enrichment().count() == 4
    plan = found.average_ranks()._jdf.queryExecution().optimizedPlan().toString()
    # Only molecules are dealt to tasks, below the step that makes the scores.
    assert plan.index("MapInArrow") < plan.index("RepartitionByExpression")


def test_rounding_is_that_of_spark(spark):
    values = np.array([1 / 1024, 3 / 1024, 0.1234567895, 0.5, 1.0, 1 / 3, 0.9999999995, 1e-12])
    made = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    want = [r["v"] for r in made.select("i", F.round("v", 9).alias("v")).orderBy("i").collect()]
    assert half_up(values, 9).tolist() == want
