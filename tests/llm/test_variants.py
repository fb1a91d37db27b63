"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from shapescreen.llm import variants


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _pairs(words):
    return {(a, b) for a in words for b in words if a != b and _near(a, b)}


def _grouped(counts, times=5):
    near = defaultdict(list)
    for a, b in _pairs(counts):
        near[a].append(b)
    forms = {}
    for w in counts:
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        forms[w] = best if best is not None and counts[best] >= times * counts[w] else None
    for w in counts:
        root = w
        while forms[root] is not None:
            root = forms[root]
        yield w, forms[w], root, counts[w], len(near[w]), forms[w] and counts[forms[w]]


def _random_words(seed, letters="abé", count=400, longest=7):
    draw = random.Random(seed)
    return sorted({"".join(draw.choice(letters) for _ in range(draw.randint(1, longest))) for _ in range(count)})


@pytest.mark.parametrize("seed", range(4))
def test_composition_gives_each_pair_once(seed):
    words = _random_words(seed, "ab" if seed % 2 else "abcÿ", 150)
    got = [(words[i], words[j]) for i, j in variants.composed(words)]
    assert len(got) == len(set(map(frozenset, got)))
    assert {p for a, b in got for p in ((a, b), (b, a))} == _pairs(words)


def test_very_long_words():
    long = "ab" * 100_000
    changed = long[:50_000] + "c" + long[50_001:]
    words = sorted({long, long + "b", "b" + long, changed, "a" * 150_000, "a" * 150_001})
    got = {frozenset((words[i], words[j])) for i, j in variants.composed(words)}
    pairs = [(long, long + "b"), (long, "b" + long), (long, changed), ("a" * 150_000, "a" * 150_001)]
    assert got == set(map(frozenset, pairs))


def test_acceptor_is_minimal():
    words = sorted({"ing", "walking", "talking", "walks", "talks", "ings", "a", ""})
    moves, final, start = variants.acceptor(words)

    def endings(state):
        return frozenset({""} if final[state] else set()) | {c + e for c, s in moves[state].items() for e in endings(s)}

    assert endings(start) == set(words)
    assert len({endings(s) for s in range(len(moves))}) == len(moves)


@pytest.mark.parametrize("state_words", [1, 4, 60, 10_000])
def test_near_words_for_any_size_of_states(spark, state_words):
    words = _random_words(7)
    rows = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long")
    got = [(r.word, r.near) for r in variants.near_words(rows, state_words).collect()]
    assert len(got) == len(set(got)) and set(got) == _pairs(words)


def test_one_beginning_holds_most_words(spark):
    # All but a few words share a long beginning, so that states lie deep.
    words = sorted({"gemeinschaft" + w for w in _random_words(3, "abc", 300, 5)} | {"hemeinschaftab", "gemeinschaft", "gmeinschaftab"})
    rows = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    got = [(r.word, r.near) for r in variants.near_words(rows, 10).collect()]
    assert len(got) == len(set(got)) and set(got) == _pairs(words)


@pytest.mark.parametrize("state_words", [3, 10_000])
def test_forms_and_roots(spark, state_words):
    draw = random.Random(5)
    counts = {w: draw.choice([1, 1, 2, 3, 5, 11, 30, 31, 160, 800, 4001]) for w in _random_words(11, "abcd", 500, 6)}
    rows = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = variants.group_variants(rows, state_words=state_words).collect()
    assert Counter(tuple(r) for r in got) == Counter(_grouped(counts))
    assert any(r.root != r.form for r in got if r.form)


def _counts(rows, slips, shortest, least):
    found = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'null' if r.doc_id is None else r.doc_id}:{w}".encode())
            if slips and h % slips == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= shortest:
                found[w] += 1
    return {w: n for w, n in found.items() if n >= least}


@pytest.mark.parametrize("slips", [None, 1, 3, 199])
def test_counts_of_awkward_texts(awkward, slips):
    got = {r.word: r.n for r in variants.vocabulary(awkward, 2, 1, slips).collect()}
    assert got == _counts(awkward.collect(), slips, 2, 1)


def test_long_texts_are_split_at_gaps(monkeypatch):
    text = " ".join(f"Wort{chr(192 + i % 60)}ende" for i in range(500))
    whole = variants.counted(text)
    monkeypatch.setattr(variants, "PIECE", 7)
    assert variants.counted(text) == whole


def test_variants_of_awkward_rows(awkward, clashing, nothing):
    want = Counter(_grouped(_counts(awkward.collect(), 199, 2, 1)))
    assert Counter(tuple(r) for r in variants.variants(awkward, shortest=2, least=1).collect()) == want
    assert Counter(tuple(r) for r in variants.variants(clashing, shortest=2, least=1).collect()) == want
    assert variants.variants(nothing).count() == 0
