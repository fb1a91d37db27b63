import numpy as np
import pytest
from pyspark.sql import functions as F
from test_lists import expected, measured, normal, tied  # noqa: F401

from shapescreen.operators import evaluation, lists, pooled, screening
from shapescreen.operators.lists import ScreenLists


@pytest.mark.parametrize("digits", [9, None])
def test_blocks_hold_what_they_were_made_of(digits):
    rng = np.random.default_rng(1)
    wide = [-1.7976931348623157e308, -2.5, -1e-9, 0.0, 5e-324, 1e-9, 0.1234567891234, 3.0, 1.7976931348623157e308]
    for score in (np.array(wide), np.unique(rng.random(5000).round(9)), np.unique(rng.normal(size=999)), np.array([0.5])):
        n = rng.integers(1, 300, len(score))
        labelled = rng.random(len(score)) < 0.8
        pos = np.where(labelled, np.minimum(n, rng.integers(0, 3, len(score))), 0)
        found = pooled.decode(pooled.encode(score, n, pos, labelled, digits))
        assert all((a == b).all() for a, b in zip(found, (score, n, pos, labelled)))
    # A score to nine decimals takes a few bytes with its counts.
    score = np.unique(rng.random(1 << 16).round(9))
    one = np.ones(len(score), np.int64)
    assert len(pooled.encode(score, one, one, one > 0, 9)) < 3 * len(score)


@pytest.mark.parametrize("shares", [(1.0, 0.0), (0.4, 0.3)])
def test_bands_of_any_borders_give_the_area_of_the_rows(spark, shares):
    rng = np.random.default_rng(2)
    score = rng.integers(-40, 40, 4000) / 8 if shares[1] else rng.random(4000)
    truth = [None if u < shares[1] / 3 else bool(u < 0.5) for u in rng.random(4000)]
    rows = [(int(i % 2), float(v), t) for i, (v, t) in enumerate(zip(score, truth))]
    rows += [(2, 0.5, None), (3, 0.5, True)]
    scores = spark.createDataFrame(rows, "g int, score double, truth boolean")
    want = {r["g"]: r["auc"] for r in evaluation.roc_auc(scores, ["g"]).collect()}
    for borders in ([], [0.0], [0.1, 0.125, 0.9], list(np.linspace(-3, 3, 50))):
        parts = []
        for g in range(4):
            bands = {}
            for turn in range(3):
                own = [(s, t) for i, (k, s, t) in enumerate(rows) if k == g and i // 2 % 3 == turn]
                sorter = pooled.Sorter(np.array(borders), None)
                values = sorted({s for s, _ in own})
                count = lambda f: np.array([sum(1 for s, t in own if s == v and f(t)) for v in values], np.int64)
                if own:
                    sorter.add(np.array(values), count(lambda t: True), count(bool), count(lambda t: t is not None) > 0)
                for band, block in sorter.flush():
                    bands.setdefault(band, []).append(block)
            parts += [(g, band, *pooled.band_parts(blocks)) for band, blocks in bands.items()]
        frame = spark.createDataFrame(parts, "g int, band int, pos long, neg long, pairs double")
        got = {r["g"]: r["auc"] for r in evaluation.auc_of_bands(frame, ["g"], "auc").collect()}
        assert got == {g: v if v is None else pytest.approx(v, rel=1e-12) for g, v in want.items()}


@pytest.mark.parametrize("chunk", [1024, 7])
def test_candidates_that_tasks_read_give_the_same_measures(tied, monkeypatch, chunk):  # noqa: F811
    want = expected(tied) | {"auc": evaluation.roc_auc(expected_pairs(tied), ["target"])}
    monkeypatch.setattr(lists, "COPIED_BYTES", 0)
    monkeypatch.setattr(lists, "LISTS_BYTES", 16 * 200)
    monkeypatch.setattr(screening, "_CANDIDATES_PER_CHUNK", chunk)
    monkeypatch.setattr(screening, "_HELD_BYTES", 2000)
    monkeypatch.setattr(pooled, "BAND_SCORES", 500)
    monkeypatch.setattr(pooled, "SORTED_SCORES", 300)
    got = measured(tied) | {"auc": ScreenLists(tied, digits=9).auc()}
    for name in want:
        assert normal(got[name]) == normal(want[name]), name


def expected_pairs(molecules):
    return screening.screen(molecules).withColumn("score", F.round("score", 9))


def test_candidates_are_not_copied_for_the_slots(spark, tied, monkeypatch):  # noqa: F811
    monkeypatch.setattr(lists, "LISTS_BYTES", 16 * 200)
    copied = ScreenLists(tied, digits=9)
    assert any(s.many > 5 for s in copied.slots)
    rows = lambda frame: frame._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(sequence" in rows(copied.enrichment())
    monkeypatch.setattr(lists, "COPIED_BYTES", 0)
    plan = rows(ScreenLists(tied, digits=9).enrichment())
    assert "Join Cross" in plan
    # One partition for each slot, whatever adaptive execution makes of the few bytes.
    found = ScreenLists(tied, digits=9)
    joined = dict((s.keys, f) for s, f in found._read_by_tasks(found._crossed()))
    assert joined
    for s in found._crossed():
        assert joined[s.keys].rdd.getNumPartitions() == s.many


def test_pooled_figures_store_and_shuffle_no_row_per_score(tied, monkeypatch):  # noqa: F811
    def none(*_, **__):
        raise AssertionError("a row per pair")

    monkeypatch.setattr(lists, "screen", none)
    monkeypatch.setattr(evaluation, "score_histogram", none)
    monkeypatch.setattr(pooled, "BAND_SCORES", 2000)
    found = ScreenLists(tied, digits=9)
    assert found.figures().count() == 2 and found.auc().count() == 2
    # As many rows as tasks, parts and bands, not as scores.
    assert found._measured(found._pool()).count() <= sum(s.many for s in found.slots) * 20


@pytest.mark.parametrize("kind", ["long", "double", "string"])
def test_screened_pairs_of_stored_chunks_are_those_of_the_other_layouts(spark, tied, monkeypatch, kind):  # noqa: F811
    molecules = tied.withColumn("target", F.col("target").cast(kind))
    want = normal(screening.screen(molecules))
    assert normal(screening.screen(molecules, max_broadcast=0)) == want
    monkeypatch.setattr(screening, "COPIED_BYTES", 0)
    monkeypatch.setattr(screening, "_SALT_PAIRS", 500)
    monkeypatch.setattr(screening, "_CANDIDATES_PER_CHUNK", 16)
    monkeypatch.setattr(screening, "KEPT_BYTES", 300)
    for pairs in (2_000, 100):
        # The larger data set alone, and both.
        monkeypatch.setattr(screening, "_TASK_PAIRS", pairs)
        assert normal(screening.screen(molecules, max_broadcast=0)) == want


def test_templates_are_not_copied_for_the_salts(spark, tied, monkeypatch):  # noqa: F811
    monkeypatch.setattr(screening, "_TASK_PAIRS", 100)
    monkeypatch.setattr(screening, "_SALT_PAIRS", 500)
    monkeypatch.setattr(screening, "_CANDIDATES_PER_CHUNK", 16)
    plan = lambda: screening.screen(tied, max_broadcast=0)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan() and "generate explode" in plan().lower()
    monkeypatch.setattr(screening, "COPIED_BYTES", 0)
    found = plan()
    assert "explode" not in found and "collect_list" not in found and "Join Cross" in found
