"""Exact dedup, sharding, top-k search: brute force on small and awkward tables."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from shapescreen.llm import exact_dedup, sharding, topk


def _norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def _groups(rows):
    found = defaultdict(list)
    for r in rows:
        found[_norm(r.text)].append(r.doc_id)
    return found


@pytest.mark.parametrize("support", [0.001, 0.2])
def test_exact_groups(awkward, support):
    got = exact_dedup.groups(awkward, support=support).collect()
    rows = awkward.collect()
    groups = _groups(rows)
    assert len(got) == len(rows)
    by_digest = {hashlib.sha256(t.encode()).digest(): ids for t, ids in groups.items()}
    kept = defaultdict(int)
    for r in got:
        ids = by_digest[bytes(r.digest)]
        assert r.group_size == len(ids)
        assert r.keep_id == min((i for i in ids if i is not None), default=None)
        kept[bytes(r.digest)] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}


def test_exact_deduplicate_keeps_one_row_and_all_columns(clashing):
    left = exact_dedup.deduplicate(clashing)
    assert left.columns == clashing.columns
    assert sorted(_norm(r.text) for r in left.collect()) == sorted(_groups(clashing.collect()))


def test_exact_empty(nothing):
    assert exact_dedup.groups(nothing).count() == 0
    assert exact_dedup.deduplicate(nothing).count() == 0


def test_shards_against_prefix_sums(spark, awkward):
    rows = awkward.collect()
    order = sorted(
        ((r.doc_id is not None, r.doc_id or 0), zlib.crc32((r.text or "").encode()), len((r.text or "").encode()) + 8)
        for r in rows
    )
    total, before, want, slots = sum(s for _, _, s in order), 0, [], defaultdict(int)
    for (some, key), crc, size in order:
        shard = (2 * before + size) * 4 // (2 * total)
        want.append((key if some else None, size, crc, shard, slots[shard]))
        slots[shard] += 1
        before += size
    got = sharding.byte_shards(awkward, 4).collect()
    key = lambda t: tuple(-1 if v is None else v for v in t)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_shards_are_balanced_over_many_rows(spark):
    docs = spark.range(5000).selectExpr("7 AS doc_id", "repeat('x', int(id % 50)) AS text")  # one key holds all rows
    got = sharding.byte_shards(docs, 24).groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in got]
    assert len(sizes) == 24 and max(sizes) - min(sizes) <= 2 * 58


def test_shards_empty(nothing):
    assert sharding.byte_shards(nothing).count() == 0


def _brute_topk(rows, k, every):
    valid = [
        (i, [int(np.floor(256 * float(x))) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    found = []
    for n, (q, a) in enumerate(valid):
        if q % every == 0:
            scored = [(-sum(x * y for x, y in zip(a, b)), i) for m, (i, b) in enumerate(valid) if m != n]
            found += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(found)


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_topk_against_brute_force(spark, scale):
    draw = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in draw.normal(0, scale, 8)]) for i in range(300)]
    rows += [(int(i), [0.5 * scale] * 8) for i in range(300, 420)]  # ties
    rows += [(100, [0.5 * scale] * 8), (50, [1.0, 2.0]), (None, [1.0]), (7, None), (8, [float("nan")]), (9, [float("inf")])]
    rows += [(11, [None, 1.0]), (150, [])]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 5, 50).collect()
    assert sorted(map(tuple, got)) == _brute_topk(rows, 5, 50)


def test_topk_with_few_candidates(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0])]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 5, 50).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 0)]
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
