"""Mixing: targets, exact quotas, disjoint runs, and the splitting tree's draws."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapescreen.llm import mixing

WORD = re.compile("[^\x20\x09-\x0d]+")


def _words(text):
    return len(WORD.findall(text or ""))


def _targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Shares by weight, then again and again the excess over the limit by weight."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = set(), share * sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        weighing = sum(weight[s] for s in names if s not in full)
        above = {s for s in names if s not in full and weighing and rest * weight[s] / weighing > most * sizes[s]}
        if not above:
            return {s: most * sizes[s] if s in full else (rest * weight[s] / weighing if weighing else 0) for s in names}
        full |= above


def _check(docs, found, shards, block_words, share=1.5, most=2):
    rows = docs.collect()
    totals = Counter()
    for r in rows:
        totals[r.source] += _words(r.text)
    sources = {s: 0 for s in {r.source for r in rows}} | totals
    want = _targets(sources, share=share, most=most)
    got = mixing.taken_words(found).collect()
    assert Counter((r.key, r.size) for r in got) == Counter((r.doc_id, _words(r.text)) for r in rows)
    by_target = defaultdict(int)
    for r in got:
        assert r.taken <= most * r.size
        by_target[(r.source_size, round(r.target, 6))] += r.taken
    expect = defaultdict(int)
    for s, t in want.items():
        expect[(sources[s], round(t, 6))] += int(t + 0.5)
    assert by_target == expect
    drawn = found.drawn.collect()
    # No words of a document come twice in a turn, and shards are gapless and even.
    times = defaultdict(list)
    for d in drawn:
        assert 0 < d.words <= block_words
        times[d.row, d.turn].append((d.start, d.start + d.words))
    for spans in times.values():
        spans.sort()
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    per_shard = defaultdict(list)
    for d in drawn:
        per_shard[d.shard].append(d.slot)
    assert all(sorted(slots) == list(range(len(slots))) for slots in per_shard.values())
    sizes = [len(per_shard.get(i, ())) for i in range(shards)]
    assert sum(sizes) == len(drawn) and max(sizes) - min(sizes) <= 1


@pytest.mark.parametrize("shards", [1, 5, 16])
def test_mix_of_awkward_rows(awkward, shards):
    _check(awkward, mixing.mix(awkward, block_words=100, shards=shards), shards, 100)


def test_many_sources_of_uneven_sizes(spark):
    # 130 sources need two levels of groups; one source has a third of all rows, one has no name.
    docs = spark.range(900).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 != 1, F.concat(F.lit("s"), F.col("id") % 131)).alias("source"),
        F.repeat(F.lit("word "), (F.col("id") * F.col("id") % 41).cast("int")).alias("text"),
    )
    one = mixing.mix(docs, block_words=7, shards=11)
    _check(docs, one, 11, 7)
    again = mixing.mix(docs.repartition(5, "text"), block_words=7, shards=11)
    names = ["shard", "slot", "key", "start", "words", "turn"]
    assert sorted(one.drawn.select(names).collect()) == sorted(again.drawn.select(names).collect())
    other = mixing.mix(docs, block_words=7, shards=11, seed=1)
    assert sorted(one.drawn.select(names).collect()) != sorted(other.drawn.select(names).collect())
    # Each shard holds a fair part of the hot source.
    hot = one.drawn.join(docs.select(F.col("doc_id").alias("key"), "source"), "key").filter("source = 'hot'")
    counts = [r["count"] for r in hot.groupBy("shard").count().collect()]
    assert len(counts) == 11 and max(counts) < 2 * sum(counts) / 11


def test_share_that_fills_every_source(awkward):
    found = mixing.mix(awkward, share=3.0, most=2, block_words=50, shards=2)
    assert all(r.taken == 2 * r.size for r in mixing.taken_words(found).collect())


def test_empty_blank_and_clashing(spark, nothing, awkward, clashing):
    assert mixing.taken_words(mixing.mix(nothing)).count() == 0
    blank = awkward.filter("trim(coalesce(text, '')) = '' or text = '  \\n '")
    got = mixing.taken_words(mixing.mix(blank)).collect()
    assert len(got) == blank.count() and {(r.size, r.source_size, r.target, r.taken) for r in got} == {(0, 0, 0.0, 0)}
    # Of the two rows that are alike in all columns either may be drawn.
    names = ["shard", "slot", "key", "start", "words", "turn"]
    plain = mixing.mix(awkward, shards=3).drawn.select(names)
    assert sorted(map(str, mixing.mix(clashing, shards=3).drawn.select(names).collect())) == sorted(map(str, plain.collect()))


@pytest.mark.parametrize("good,pool,taken", [(7, 20, 9), (300, 1000, 500), (40_000_000, 90_000_000, 1_000_000), (3, 3, 2), (0, 9, 4)])
def test_hypergeometric_moments(spark, good, pool, taken):
    n = 4000
    lit = lambda x: F.lit(x).cast("long")
    got = spark.range(n).select(mixing.hypergeometric(lit(good), lit(pool), lit(taken), F.col("id"))).collect()
    values = np.array([r[0] for r in got], float)
    mean = taken * good / pool
    variance = mean * (1 - good / pool) * (pool - taken) / max(1, pool - 1)
    assert values.min() >= max(0, taken - (pool - good)) and values.max() <= min(good, taken)
    assert abs(values.mean() - mean) <= 4 * (variance / n) ** 0.5
    assert abs(values.var() - variance) <= 0.12 * variance


def test_small_draws_have_the_right_frequencies(spark):
    from math import comb

    lit = lambda x: F.lit(x).cast("long")
    n = 6000
    rows = spark.range(n).select(mixing.hypergeometric(lit(4), lit(10), lit(5), F.col("id")).alias("k"))
    counts = {r.k: r["count"] for r in rows.groupBy("k").count().collect()}
    for k in range(5):
        p = comb(4, k) * comb(6, 5 - k) / comb(10, 5)
        assert abs(counts.get(k, 0) / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-3
