"""Learned operators: held-out accuracy, brute-force base spans, awkward rows."""

import random
import re

import numpy as np
import pytest

from shapescreen.llm import batches, language_id, pii, secrets, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_suffix_automaton_knows_every_substring():
    draw = random.Random(1)
    text = [draw.randrange(3) for _ in range(60)]
    moves = language_id.suffix_automaton(text)

    def known(part):
        state = 0
        for s in part:
            state = moves[state].get(s)
            if state is None:
                return False
        return True

    held = {tuple(text[i:j]) for i in range(60) for j in range(i, 61)}
    for _ in range(3000):
        part = tuple(draw.randrange(3) for _ in range(draw.randrange(9)))
        assert known(part) == (part in held)


def test_cross_parsing_counts_phrases_like_brute_force():
    texts = {"x": ["abracadabra alakazam"], "y": ["hocus pocus fidibus"]}
    model = language_id.CrossParser(texts, 200)
    symbols = {k: f" {v[0]} " for k, v in texts.items()}
    for text in ("abra", "hocus alakazam pocus", "zzz", "fidibusabra"):
        bits = {}
        for k, known in symbols.items():
            at = phrases = 0
            while at < len(text):
                size = 1
                while at + size < len(text) and text[at : at + size + 1] in known:
                    size += 1
                phrases += 1
                at += size
            bits[k] = phrases * np.log2(len(known) + 1)
        found = model.predict([text])
        low = min(bits.values())
        assert found["lang_pred"][0] == min(k for k, v in bits.items() if v == low)


def test_language_held_out_accuracy(spark, corpus):
    held = batches.remainder("doc_id", 4) == 2
    model = language_id.train(corpus.filter(~held))
    found = language_id.identify(corpus, model).join(corpus.filter(held).select("doc_id", "lang"), "doc_id")
    rows = found.collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)


def test_language_of_awkward_rows(awkward, clashing, nothing):
    model = language_id.train(clashing)
    rows = language_id.identify(awkward, model).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    unknown = sorted(r.doc_id or -1 for r in rows if r.lang_pred == "und")
    assert unknown == [-1, 4, 5, 6, 7]
    kept = language_id.keep_known(clashing, model)
    assert kept.columns == clashing.columns and kept.count() == awkward.count() - 5
    assert language_id.identify(nothing, language_id.train(nothing)).count() == 0
    assert {r.lang_pred for r in language_id.identify(awkward, language_id.train(nothing)).collect()} == {"und"}


PII = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def brute_pii(text):
    found = []
    for kind, pattern in enumerate(PII):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"\D", "", m[0])
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            ok = (
                True,
                kind == 1 and all(int(p) <= 255 for p in m[0].split(".")),
                13 <= len(digits) <= 19 and sum(d // 10 + d % 10 for d in doubled) % 10 == 0,
                9 <= len(digits) <= 15,
            )[kind]
            if ok:
                found.append((kind, *m.span()))
    return found


def test_pii_base_spans_equal_brute_force():
    draw = random.Random(3)
    known = ["4111 1111 1111 1111", "a.b@c.d@e.f@g.h", "1.2.3.4.5.6.7.8", "+1 (743) 555-3824", "x@y..z", "0000.1.2.3"]
    for _ in range(5000):
        text = "".join(draw.choice(draw.choice(["0123456789", "..@--  +()", "ab%_Zé١ \n"])) for _ in range(draw.randrange(60)))
        text += draw.choice(["", *known])
        assert pii.base_spans(text) == brute_pii(text), text


def test_long_runs_are_quick():
    for text in ("1" * 300_000, "a" * 300_000, "+" * 300_000, "1." * 150_000, "a@" * 150_000, "+1" + " " * 300_000):
        pii.base_spans(text)
        secrets.base_spans(text)


def test_field_spreads_to_distant_mentions(corpus):
    field = pii.train(corpus)
    text = "call +1 (743) 555-3824 now" + " word" * 100 + " again 555-3824 or 24 times"
    (base, added), = field.find([text])
    assert [k for k, _, _ in base] == [3]
    assert [(k, text[a:b]) for k, a, b in added] == [(3, "555-3824")]
    assert field.find(["version 12.3 of 2024-01-01 has 4785 rows"])[0][1] == []


def test_field_reaches_every_mention(corpus):
    """One number is known by its first spelling only, or by its last; fifty others follow it."""
    field = pii.train(corpus)
    whole, variants = "call +1 (743) 555-3824 now", ["555-3824", "555.3824", "5553824"]
    for first in (True, False):
        rest = "".join(" word" * 12 + f" again {variants[i % 3]} then" for i in range(50))
        text = whole + rest if first else rest[1:] + " or " + whole
        (base, added), (_, alone) = field.find([text, "none 12 here"])
        assert [k for k, _, _ in base] == [3]
        assert [(k, text[a:b]) for k, a, b in added] == [(3, variants[i % 3]) for i in range(50)]
        assert alone == []


def test_messages_settle_along_a_chain():
    """Without local evidence a chain's beliefs are exact: powers of the link's transition matrix."""
    field = pii.Field()
    field.skip = 4.0 * np.eye(pii.LABELS)
    chain = np.stack([np.arange(49), np.arange(1, 50)], axis=1)
    known = np.full(50, pii.OUTSIDE)
    known[0] = 3
    rows = [np.array([0], np.int32)] * 50
    belief = field.marginals(rows, known, np.zeros((0, 2), np.int64), chain)
    link = np.exp(field.skip)
    link /= link.sum(axis=1, keepdims=True)
    for hop in range(1, 50):
        assert abs(belief[hop, 3] - np.linalg.matrix_power(link, hop)[3, 3]) < 0.02


def test_pii_of_awkward_rows(awkward, clashing, nothing):
    field = pii.train(clashing)
    rows = {r.doc_id: r for r in pii.scan(awkward, field).collect()}
    assert (rows[12].n_card, rows[12].n_email, rows[12].n_ip, rows[12].n_phone) == (1, 1, 1, 1)
    assert rows[4].spans == "" and rows[11].spans == ""
    masked = pii.redact(clashing, field, length="n_chars")
    assert masked.columns == clashing.columns
    texts = {r.doc_id: r for r in masked.collect()}
    assert texts[12].text == "card [CARD], mail [EMAIL], [IP], [PHONE]" and texts[12].n_chars == len(texts[12].text)
    assert texts[4].text is None and texts[1].text.startswith("The cat") and texts[9].lang is None
    assert pii.scan(nothing, pii.train(nothing)).count() == 0


SECRETS = (
    r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    r"AKIA[A-Z0-9]+",
    r"[0-9a-f]+",
)


def test_secret_base_spans_equal_brute_force():
    draw = random.Random(3)
    parts = "password Passwd toKen ſecret api_key apikey = : ' \" abc123 AKIA A1B2C3D4E5F6 deadbeef 0123456789abcdef x é".split()
    for _ in range(5000):
        text = "".join(draw.choice([*parts, " "]) for _ in range(draw.randrange(25)))
        want = [(m.start(), 0, m.end()) for m in re.finditer(SECRETS[0], text) if len(m[2]) >= 8]
        want += [(m.start(), 1, m.end()) for m in re.finditer(SECRETS[1], text) if len(m[0]) >= 16]
        want += [(m.start(), 2, m.end()) for m in re.finditer(SECRETS[2], text) if len(m[0]) >= 32]
        assert secrets.base_spans(text) == sorted(want), text


def test_network_slopes_match_differences():
    draw = np.random.default_rng(0)
    net = secrets.Network(embed=3, filters=4, hidden=3)
    x, y = draw.integers(0, secrets.SYMBOLS, (6, 20)), np.array([0, 1, 0, 1, 1, 0.0])

    def loss():
        out = net.forward(x)[-1]
        return np.mean(np.log1p(np.exp(out)) - y * out)

    slopes = net._slopes(x, y)
    for name, part in net.parts.items():
        flat, at = part.reshape(-1), int(np.abs(slopes[name]).argmax())
        old = flat[at]
        flat[at] = old + 1e-5
        up = loss()
        flat[at] = old - 1e-5
        down = loss()
        flat[at] = old
        assert abs((up - down) / 2e-5 - slopes[name].reshape(-1)[at]) < 1e-4, name


def test_scanner_on_held_back_formats_and_awkward_rows(corpus, awkward, clashing, nothing):
    scanner = secrets.train(clashing.unionByName(corpus, allowMissingColumns=True))
    texts, labels = secrets.generated(1200, seed=99)
    found = np.array([bool(b or a) for b, a in scanner.find(texts)])
    labels = np.array(labels) == 1
    assert found[labels].mean() >= 0.9 and found[~labels].mean() <= 0.05
    rows = {r.doc_id: r for r in secrets.scan(awkward, scanner).collect()}
    assert rows[13].n_assign == 1 and rows[4].spans == "" and rows[11].spans == "hex:0:200000"
    assert secrets.scan(nothing, secrets.train(nothing, made=200)).count() == 0


def test_isotonic_rises_and_fits_blocks():
    draw = np.random.default_rng(2)
    score = draw.normal(size=2000)
    y = (draw.random(2000) < 1 / (1 + np.exp(-2 * score))).astype(float)
    xs, ys = toxicity.isotonic(score, y)
    assert (np.diff(xs) >= 0).all() and (np.diff(ys) >= 0).all()
    assert abs(np.interp(score, xs, ys).mean() - y.mean()) < 0.01


def test_toxicity_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    held = batches.remainder("doc_id", 5) == 0
    both = docs.join(labels, "doc_id")
    model = toxicity.train(both.filter(~held))
    rows = toxicity.score(both.filter(held), model).join(labels, "doc_id").toPandas()
    ranks, ones = rows.score.rank(), rows.toxic.sum()
    auc = (ranks[rows.toxic == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(rows) - ones))
    assert auc > 0.95 and (rows.predicted == rows.toxic).mean() > 0.95


def test_toxicity_of_awkward_rows(spark, awkward, clashing, nothing):
    from pyspark.sql import functions as F

    labelled = clashing.withColumn("toxic", F.when(F.col("doc_id") < 9, F.col("doc_id") % 2).cast("int"))
    rows = toxicity.score(awkward, toxicity.train(labelled)).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    none = nothing.withColumn("toxic", F.lit(1))
    assert toxicity.score(nothing, toxicity.train(none)).count() == 0
    raw = toxicity.features(["", None, "YOU idiot!", "1d10t you"], toxicity.fixed_lists())
    names = dict(zip(toxicity.FEATURES, raw.T))
    assert names["insults"].tolist() == [0, 0, 1, 0] and names["near"].tolist() == [0, 0, 1, 0]


def test_scanner_learns_from_every_document(spark, monkeypatch):
    token = "".join(np.random.default_rng(3).choice(list("abcdefghij0123456789"), 20))
    rows = [(i, f"see {i:016d}x{token} here, " * 9 + f"token={i}{token}") for i in range(2600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = secrets.windows(docs).toPandas()
    # More documents than a bounded sample would hold; the tenth finding of each is the labelled one.
    assert found.label.sum() >= 2600 and (found.label == 0).sum() >= 2600
    scanner = secrets.train(docs.filter("doc_id < 300"), made=400, shard=150)
    again = secrets.train(docs.filter("doc_id < 300").repartition(7), made=400, shard=150)
    assert scanner.threshold == again.threshold and scanner.slope == again.slope
