"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text are rates: hits of word lists, their nearness to second-person words, capitals,
punctuation, and obfuscated spellings.  One word list is fixed; two are learned, as the words whose
odds under the label are highest.  The labelled sample is divided by hash into three parts: one
chooses the words, one grows the trees, one calibrates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapescreen.llm.batches import bound_batches, code_points, map_texts, slices, totals
from shapescreen.llm.pretokens import LETTER, NUMBER, SPACE, classes, span_hashes

# Insults and second-person words of several languages.
INSULTS = """
idiot moron stupid dumb loser trash garbage worthless pathetic disgusting clown fool scum filth vermin
hate kill die shut ugly freak creep liar coward imbecile idiota tonto estupido basura idiote imbecile
stupide ordure dummkopf idiot abschaum dumm
""".split()
SECOND_PERSON = "you your yours yourself u ur tu te ti tus usted ustedes toi vous votre vos du dich dir dein deine ihr euch".split()
SWAPS = str.maketrans("013457@$!", "oieastasi")

#: Words from a hit within which a second-person word counts as near.
NEAR = 4
#: Lengths of the word beginnings that count as stems.
STEMS = (3, 4, 5, 6)
#: Learned words per list, and the least documents that a word must be in.
LISTED, LEAST_DOCS = 150, 5

FEATURES = (
    "words letters insults strong weak insult_rate strong_rate weak_rate near near_rate second_rate capitals shouted "
    "marks exclaimed questions starred obfuscated disguised repeated strong_distinct stems stem_rate stem_excess"
).split()


def word_hash(words: list[str]) -> np.ndarray:
    """Hashes of single words, sorted."""
    points, offsets = code_points(list(dict.fromkeys(words)))
    return np.sort(span_hashes(points, offsets[:-1], offsets[1:]))


_lower: list[np.ndarray] = []


def lower_case() -> np.ndarray:
    """Lower case of every code point (itself if that is not one code point); made once a process."""
    if not _lower:
        table = np.arange(0x110000, dtype=np.uint32)
        for c in range(0x20000):
            low = chr(c).lower()
            if len(low) == 1:
                table[c] = ord(low)
        _lower.append(table)
    return _lower[0]


class Words:
    """Words of all texts: runs without white space, and their cores without signs at the ends."""

    def __init__(self, texts: list[str]):
        self.points, self.offsets = code_points(texts)
        kinds = classes()[self.points]
        begins = np.zeros(len(self.points) + 1, bool)
        begins[self.offsets] = True
        solid = np.concatenate([[False], kinds != SPACE, [False]])
        self.starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | begins[:-1]))
        self.ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | begins[1:])) + 1
        self.text_of = np.searchsorted(self.offsets, self.starts, "right") - 1
        self.kinds = kinds
        self.low = lower_case()[self.points]
        # Cores: from the first to the last letter or number of a word.
        core = (kinds == LETTER) | (kinds == NUMBER)
        nexts = np.where(core, np.arange(len(core)), len(core))
        nexts = np.minimum.accumulate(nexts[::-1])[::-1] if len(core) else nexts
        lasts = np.maximum.accumulate(np.where(core, np.arange(len(core)), -1)) if len(core) else nexts
        if len(self.starts):
            self.core_starts = np.minimum(nexts[self.starts], self.ends)
            self.core_ends = np.maximum(lasts[self.ends - 1] + 1, self.core_starts)
        else:
            self.core_starts = self.core_ends = self.starts
        self.hashes = span_hashes(self.low, self.core_starts, self.core_ends) if len(self.starts) else np.zeros(0, np.uint64)

    def stem_hashes(self, length: int) -> np.ndarray:
        """Hashes of the words' beginnings, of no use for words that are shorter."""
        ends = np.minimum(self.core_starts + length, self.core_ends)
        found = span_hashes(self.low, self.core_starts, ends) if len(self.starts) else np.zeros(0, np.uint64)
        # Told apart from whole words; words of the length or less give nothing that a list holds.
        return np.where(self.core_ends - self.core_starts > length, found ^ np.uint64(0x5DEECE66D), np.uint64(0))

    def inside(self, flags: np.ndarray) -> np.ndarray:
        """How many flagged characters each word holds."""
        run = np.concatenate([[0], np.cumsum(flags)])
        return run[self.ends] - run[self.starts]


def features(texts: list[str | None], lists: dict[str, np.ndarray]) -> np.ndarray:
    """One row of FEATURES per text."""
    texts = [t or "" for t in texts]
    w = Words(texts)
    size = len(texts)
    per_text = lambda flags, weights=None: np.bincount(w.text_of[flags], weights, minlength=size)
    chars = lambda flags: totals(flags, w.offsets)
    hit = {name: np.isin(w.hashes, found) for name, found in lists.items()}
    words = np.bincount(w.text_of, minlength=size)
    letters = w.kinds == LETTER
    upper = w.low != w.points
    many_letters, many_upper = w.inside(letters), w.inside(upper)
    signs = (w.kinds != LETTER) & (w.kinds != NUMBER) & (w.kinds != SPACE)
    core_signs = np.concatenate([[0], np.cumsum((w.kinds != LETTER))])
    inner = core_signs[w.core_ends] - core_signs[w.core_starts]

    stem = np.zeros(len(w.hashes), bool)
    for length in STEMS:
        stem |= np.isin(w.stem_hashes(length), lists["stems"])

    # Distance in words to the nearest second-person word of the same text.
    seconds = np.flatnonzero(hit["second"])
    insulting = hit["insults"] | hit["strong"]
    near = np.zeros(len(w.hashes), bool)
    for shift in range(-NEAR, NEAR + 1):
        at = seconds + shift
        ok = (at >= 0) & (at < len(near))
        at, of = at[ok], seconds[ok]
        near[at[w.text_of[at] == w.text_of[of]]] = True
    near &= insulting

    # Spellings with digits or signs for letters: undo the usual swaps and look again.
    odd = np.flatnonzero((inner > 0) & (many_letters > 1) & (w.core_ends - w.core_starts <= 24))
    plain = ["".join(map(chr, w.low[a:b])) for a, b in zip(w.core_starts[odd].tolist(), w.core_ends[odd].tolist())]
    plain = ["".join(c for c in p.translate(SWAPS) if c.isalpha()) for p in plain]
    disguised = np.zeros(len(w.hashes), bool)
    if plain:
        points, offsets = code_points(plain)
        undone = span_hashes(points, offsets[:-1], offsets[1:])
        disguised[odd] = np.isin(undone, lists["insults"]) | np.isin(undone, lists["strong"])
    same = np.zeros(len(w.low), bool)
    same[2:] = (w.low[2:] == w.low[1:-1]) & (w.low[1:-1] == w.low[:-2]) & letters[2:]
    distinct = np.unique((w.text_of[hit["strong"]].astype(np.uint64) << np.uint64(40)) + (w.hashes[hit["strong"]] >> np.uint64(24)))
    strong_distinct = np.bincount((distinct >> np.uint64(40)).astype(np.int64), minlength=size)

    total, all_letters, length = np.maximum(words, 1), np.maximum(chars(letters), 1), np.maximum(np.diff(w.offsets), 1)
    columns = {
        "words": np.log1p(words),
        "letters": chars(letters) / length,
        "insults": per_text(hit["insults"]),
        "strong": per_text(hit["strong"]),
        "weak": per_text(hit["weak"]),
        "insult_rate": per_text(hit["insults"]) / total,
        "strong_rate": per_text(hit["strong"]) / total,
        "weak_rate": per_text(hit["weak"]) / total,
        "near": per_text(near),
        "near_rate": per_text(near) / np.maximum(per_text(insulting), 1),
        "second_rate": per_text(hit["second"]) / total,
        "capitals": chars(upper) / all_letters,
        "shouted": per_text((many_upper == many_letters) & (many_letters > 2)) / total,
        "marks": chars(signs) / length,
        "exclaimed": chars(w.points == ord("!")) / total,
        "questions": chars(w.points == ord("?")) / total,
        "starred": chars((w.points == ord("*")) | (w.points == ord("$")) | (w.points == ord("#"))) / total,
        "obfuscated": per_text((inner > 0) & (many_letters > 1)) / total,
        "disguised": per_text(disguised),
        "repeated": per_text(w.inside(same) > 0) / total,
        "strong_distinct": strong_distinct,
        "stems": per_text(stem),
        "stem_rate": per_text(stem) / total,
        "stem_excess": per_text(stem) / np.sqrt(total),
    }
    return np.stack([columns[name] for name in FEATURES], axis=1).astype(np.float64)


class Boosted:
    """Gradient-boosted trees of fixed depth for a 0/1 label, on binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 3, rate: float = 0.1, bins: int = 64):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)], axis=1)
        mean = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(mean / (1 - mean)))
        self.rate, self.depth, self.trees = rate, depth, []
        score = np.full(len(y), self.base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            tree, leaf = self._grow(binned, y - p, p * (1 - p), bins)
            self.trees.append(tree)
            score += rate * tree[2][leaf]

    def _grow(self, binned, gradient, weight, bins, l2: float = 1.0):
        """A complete tree: feature and cut of every inner node, value of every leaf, leaf of every row."""
        nodes = (1 << self.depth) - 1
        feature, cut = np.zeros(nodes, np.int64), np.full(nodes, bins, np.int64)
        at = np.zeros(len(gradient), np.int64)
        for level in range(self.depth):
            first, count = (1 << level) - 1, 1 << level
            best = np.zeros(count)
            for f in range(binned.shape[1]):
                cell = (at - first) * bins + binned[:, f]
                g = np.bincount(cell, gradient, count * bins).reshape(count, bins).cumsum(axis=1)
                h = np.bincount(cell, weight, count * bins).reshape(count, bins).cumsum(axis=1)
                n = np.bincount(cell, minlength=count * bins).reshape(count, bins).cumsum(axis=1)
                gain = g**2 / (h + l2) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + l2) - g[:, -1:] ** 2 / (h[:, -1:] + l2)
                gain[(n < 5) | (n[:, -1:] - n < 5)] = 0
                at_cut = gain.argmax(axis=1)
                better = gain[np.arange(count), at_cut] > best + 1e-9
                nodes_now = first + np.flatnonzero(better)
                feature[nodes_now], cut[nodes_now] = f, at_cut[better]
                best[better] = gain[better, at_cut[better]]
            at = 2 * at + 1 + (binned[np.arange(len(at)), feature[at]] > cut[at])
        leaf = at - nodes
        g = np.bincount(leaf, gradient, nodes + 1)
        h = np.bincount(leaf, weight, nodes + 1)
        return (feature, cut, g / (h + l2)), leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)], axis=1)
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (binned[rows, feature[at]] > cut[at])
            total += self.rate * value[at - len(feature)]
        return total


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: rising scores and the calibrated share at each."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum, weight, first score, last score
    for s, v in zip(score[order].tolist(), y[order].tolist()):
        blocks.append([v, 1.0, s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    # Half an observation of each class keeps the ends off 0 and 1.
    share = [(a + 0.5 * (y.mean() if len(y) else 0.5)) / (w + 0.5) for a, w, _, _ in blocks]
    xs = [x for b in blocks for x in (b[2], b[3])]
    ys = [v for v in share for _ in range(2)]
    return np.array(xs), np.maximum.accumulate(np.array(ys)) if ys else np.array(ys)


class Model:
    def __init__(self, lists: dict[str, np.ndarray], trees: Boosted | None, curve, base: float):
        self.lists, self.trees, self.curve, self.base = lists, trees, curve, base

    def predict(self, texts: list[str | None]) -> dict[str, np.ndarray]:
        if self.trees is None:
            score = np.full(len(texts), self.base)
        else:
            raw = self.trees.score(features(texts, self.lists))
            score = np.interp(raw, *self.curve)
            # Keep the trees' order where the curve is flat.
            score = np.clip(score + 1e-6 * np.tanh(raw), 0.0, 1.0)
        return {"score": score, "predicted": (score >= 0.5).astype(np.int32)}


def train(labelled: DataFrame, rows: int = 24_000, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learn from at most ``rows`` labelled rows, those with the smallest hashes of their keys.

    ``labelled`` holds text and label side by side; null labels are no labels.  Words are counted
    and features computed in tasks; the driver gets the chosen words and one row of features a
    sampled text.  Without both labels in each part the model says the share of the label.
    """
    spark = labelled.sparkSession
    bound_batches(spark)
    known = labelled.filter(F.col(label).isNotNull()).select(
        F.xxhash64(F.col(key), F.lit(7)).alias("hash"), F.col(text).alias("text"), F.col(label).cast("int").alias("y")
    )
    last = known.select("hash").orderBy("hash").limit(rows).agg(F.max("hash")).first()[0]
    if last is None:
        return Model(fixed_lists(), None, None, 0.0)
    sample = known.filter(F.col("hash") <= last).withColumn("part", F.pmod(F.col("hash"), F.lit(10)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            w = Words([t or "" for t in batch.column(0).to_pylist()])
            y = batch.column(1).to_numpy(zero_copy_only=False)
            tokens = np.concatenate([w.hashes, *(w.stem_hashes(n) for n in STEMS)])
            texts = np.tile(w.text_of.astype(np.uint64), 1 + len(STEMS))
            pair = np.stack([texts, tokens], axis=1)[tokens != 0]
            pair = np.unique(pair, axis=0) if len(pair) else pair
            names, inverse = np.unique(pair[:, 1], return_inverse=True)
            ones = np.bincount(inverse, y[pair[:, 0].astype(np.int64)], minlength=len(names)) if len(names) else []
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names.view(np.int64)),
                    pa.array(np.asarray(ones, np.int64)),
                    pa.array(np.bincount(inverse, minlength=len(names)).astype(np.int64)),
                    pa.array(~np.isin(names, w.hashes)),
                ],
                ["word", "ones", "docs", "stem"],
            )

    first = F.col("part") < 4
    size = sample.filter(first).agg(F.count("*"), F.sum("y")).first()
    share = ((size[1] or 0) + 1) / (size[0] + 2)
    counts = (
        sample.filter(first).select("text", "y").mapInArrow(count, "word long, ones long, docs long, stem boolean")
        .groupBy("word", "stem")
        .agg(F.sum("ones").alias("ones"), F.sum("docs").alias("docs"))
        .filter(F.col("docs") >= LEAST_DOCS)
    )
    # How far the share among a word's documents lies above the whole share, in standard errors.
    strength = (F.col("ones") - F.col("docs") * share) / F.sqrt(F.col("docs") * share * (1 - share))
    strong = counts.withColumn("z", strength).filter("z > 2")
    ranked = {
        stems: strong.filter(F.col("stem") == stems).orderBy(F.desc("z"), "word").limit(2 * LISTED).collect()
        for stems in (False, True)
    }
    pick = lambda rows: np.sort(np.array([r["word"] for r in rows][:LISTED], np.int64).view(np.uint64))
    lists = fixed_lists() | {
        "strong": pick([r for r in ranked[False] if r["z"] > 6]),
        "weak": pick([r for r in ranked[False] if r["z"] <= 6]),
        "stems": pick([r for r in ranked[True] if r["z"] > 4]),
    }

    shared = spark.sparkContext.broadcast(lists)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = features(batch.column(0).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], ["y", "hash", "x"]
            )

    rest = sample.filter(~first).select("text", "y", "hash").mapInArrow(measure, "y int, hash long, x array<double>")
    found = rest.toPandas().sort_values("hash")
    y = found["y"].to_numpy(float)
    x = np.stack(found["x"].to_list()) if len(found) else np.zeros((0, len(FEATURES)))
    grown = (found["hash"].to_numpy() % 10 < 8) if len(found) else np.zeros(0, bool)
    if min(len(np.unique(y[grown])), len(np.unique(y[~grown]))) < 2:
        return Model(lists, None, None, share)
    trees = Boosted(x[grown], y[grown])
    return Model(lists, trees, isotonic(trees.score(x[~grown]), y[~grown]), share)


def fixed_lists() -> dict[str, np.ndarray]:
    none = np.zeros(0, np.uint64)
    return {"insults": word_hash(INSULTS), "second": word_hash(SECOND_PERSON), "strong": none, "weak": none, "stems": none}


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``key, score, predicted``.  Null and empty texts score like any text
    without words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, lambda texts: shared.value.predict(texts), "score double, predicted int", key, text)
