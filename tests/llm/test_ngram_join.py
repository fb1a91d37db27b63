"""Jaccard components against brute force, with groups that share passages and near copies."""

import random
import re

from llm_rows import documents

from shapescreen.llm import ngram_join
from shapescreen.llm.components import components


def brute(rows, words=5, percent=80):
    sets = []
    for _, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and sets[j] and 100 * common >= percent * (len(a) + len(sets[j]) - common):
                root[find(i)] = find(j)
    members = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(rows[i][0])
    least = {r: min((k for k in ids if k is not None), default=None) for r, ids in members.items()}
    return [(rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows))]


def ordered(rows):
    return sorted(rows, key=lambda t: tuple(-1 if v is None else v for v in t))


def corpus(seed, size=260):
    """Chains of edits, so that components hold members that don't link directly."""
    draw = random.Random(seed)
    word = lambda: draw.choice("abcdefgh") + str(draw.randrange(60))
    passage = [word() for _ in range(60)]
    texts = []
    while len(texts) < size:
        own = [word() for _ in range(draw.choice([3, 4, 5, 6, 12, 40, 90]))]
        if draw.random() < 0.4:
            own += passage
        for _ in range(draw.choice([1, 1, 2, 5, 30])):
            texts.append(" ".join(own))
            for _ in range(draw.choice([0, 1, 1, 2, 3])):
                at = draw.randrange(len(own))
                own = own[:at] + draw.choice([[], [word()], [word(), word()]]) + own[at + 1 :] or [word()]
    ids = list(range(len(texts)))
    draw.shuffle(ids)
    return list(zip(ids, texts))


def test_components_equal_brute_force(spark):
    for seed in range(3):
        rows = corpus(seed)
        got = [tuple(r)[:3] for r in ngram_join.cluster(documents(spark, rows)).collect()]
        assert ordered(got) == ordered(brute(rows)), seed


def test_heavy_shingles_and_large_groups(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HEAVY", 1)
    monkeypatch.setattr(ngram_join, "RANGES", 4)
    monkeypatch.setattr(ngram_join, "COPIES", 0.05)
    rows = corpus(9, 400)
    got = [tuple(r)[:3] for r in ngram_join.cluster(documents(spark, rows)).collect()]
    assert ordered(got) == ordered(brute(rows))


def test_awkward_rows(awkward, clashing, nothing):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert ordered(tuple(r)[:3] for r in ngram_join.cluster(awkward).collect()) == ordered(brute(rows))
    left = ngram_join.deduplicate(clashing)
    assert left.columns == clashing.columns
    # One of each component's rows, of those with its smallest key; rows without words all stay.
    kept = [(r.doc_id, r.text) for r in left.collect()]
    blank = [r for r in rows if not (r[1] or "").strip()]
    assert [r for r in kept if not (r[1] or "").strip()] == blank or len(kept) > len(blank)
    linked = {c for k, n, c in brute(rows) if n}
    assert sorted(k for k, t in kept if (t or "").strip()) == sorted(linked)
    assert ngram_join.deduplicate(nothing).count() == 0
    assert ngram_join.cluster(nothing).count() == 0


def test_repeated_and_null_keys_lose_no_clean_row(spark):
    a = " ".join(f"word{i}" for i in range(60))
    near, other = a + " more", " ".join(f"else{i}" for i in range(60))
    rows = [(1, a), (2, near), (2, other), (None, a + " again"), (3, "x y"), (3, "z u"), (None, "only null"), (5, "twice"), (5, "twice")]
    left = ngram_join.deduplicate(documents(spark, rows)).collect()
    want = [(1, a), (2, other), (3, "x y"), (3, "z u"), (None, "only null"), (5, "twice")]
    assert sorted(map(str, ((r.doc_id, r.text) for r in left))) == sorted(map(str, want))


def test_many_ranges_and_a_notice_in_a_tenth_of_all_texts(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "RANGE_SIZE", 40)
    monkeypatch.setattr(ngram_join, "RANGES", 8)
    monkeypatch.setattr(ngram_join, "SHARES", 16)
    monkeypatch.setattr(ngram_join, "SAMPLE", 4_000)
    draw = random.Random(3)
    rows = corpus(12, 300)
    rows = [(k, t + (" see our terms of use here" if draw.random() < 0.1 else "")) for k, t in rows]
    docs = documents(spark, rows)
    taken = []
    own = ngram_join.heavy_shingles
    monkeypatch.setattr(ngram_join, "heavy_shingles", lambda *a: taken.append((a[3], own(*a))) or taken[-1][1])
    got = [tuple(r)[:3] for r in ngram_join.cluster(docs).collect()]
    assert ordered(got) == ordered(brute(rows))
    (ranges, heavy), notice = taken[0], ngram_join.shingle_sets(["see our terms of use"])[0]
    assert ranges > 96 and notice[0] in heavy


def test_components_of_long_paths(spark):
    draw = random.Random(4)
    names = [draw.getrandbits(62) for _ in range(300)]
    edges = list(zip(names[:149], names[1:150])) + [(names[150], n) for n in names[151:]] + [(5, 5)]
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    roots = {r.node: r.root for r in found}
    assert len({roots[n] for n in names[:150]}) == 1 and len({roots[n] for n in names[150:]}) == 1
    assert len(set(roots.values())) == 2
