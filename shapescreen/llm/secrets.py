"""Secrets by fixed patterns and a character network over every candidate.

The patterns give the base spans.  Candidates are runs of token characters of some length that hold
a digit; a convolutional network in NumPy reads each with the text around it, in as many windows as
its length takes.  It learns from labelled findings: all candidates of all documents, labelled by the
patterns, and generated tokens of well-known secret and harmless formats.  Scores
are calibrated on findings held back, and the threshold is the highest that keeps a stated recall
there.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapescreen.llm.batches import bound_batches, code_points, map_texts, slices
from shapescreen.sources.store import stage

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(
    r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")

#: Shortest candidate; characters of context on either side; characters of a window of the candidate.
LEAST, CONTEXT, WINDOW = 16, 16, 48
WIDTH = 2 * CONTEXT + WINDOW
#: Symbols: printable ASCII, white space, other characters, and the window's padding.
SYMBOLS = 98
PAD, BLANK, FOREIGN = 97, 95, 96
#: Windows that a task learns from, rounds of learning and passes of a round; largest score of a held-back window.
SHARD, ROUNDS, EPOCHS = 8000, 5, 2
RANGE = 30.0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in that order; leftmost and non-overlapping in a kind."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


class Candidates:
    """Runs of ``[A-Za-z0-9+/_=-]`` of LEAST characters or more with a digit, of all texts."""

    def __init__(self, texts: list[str]):
        self.points, offsets = code_points(texts)
        table = np.zeros(128, bool)
        table[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True
        inside = table[np.minimum(self.points, 127)] & (self.points < 128)
        begins = np.zeros(len(self.points) + 1, bool)
        begins[offsets] = True
        solid = np.concatenate([[False], inside, [False]])
        starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | begins[:-1]))
        ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | begins[1:])) + 1
        digits = np.concatenate([[0], np.cumsum((self.points >= 48) & (self.points <= 57))])
        chosen = (ends - starts >= LEAST) & (digits[ends] > digits[starts])
        self.starts, self.ends = starts[chosen], ends[chosen]
        self.text_of = np.searchsorted(offsets, self.starts, "right") - 1
        self.offsets = offsets

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of every window, and the candidate that it belongs to.

        Windows overlap by half and together hold the whole candidate; each has the text beside it.
        """
        lengths = self.ends - self.starts
        counts = 1 + np.maximum(0, -(-(lengths - WINDOW) // (WINDOW // 2)))
        of = np.repeat(np.arange(len(lengths)), counts)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        begin = self.starts[of] + nth * (WINDOW // 2)
        end = np.minimum(begin + WINDOW, self.ends[of])
        place = np.arange(WIDTH) - CONTEXT
        # A short candidate's right context follows its end.
        at = begin[:, None] + place
        low, high = self.offsets[self.text_of[of]][:, None], self.offsets[self.text_of[of] + 1][:, None]
        ok = (at >= low) & (at < np.minimum(high, end[:, None] + CONTEXT))
        return np.where(ok, symbols(self.points[np.where(ok, at, 0)]) if len(self.points) else PAD, PAD), of

    def relative(self) -> list[tuple[int, int, int]]:
        """(text, start, end) with positions in the text."""
        base = self.offsets[self.text_of]
        return list(zip(self.text_of.tolist(), (self.starts - base).tolist(), (self.ends - base).tolist()))


def symbols(points: np.ndarray) -> np.ndarray:
    found = np.where((points > 32) & (points < 127), points.astype(np.int64) - 33, FOREIGN)
    return np.where((points <= 32) | (points == 0xA0), BLANK, found)


class Network:
    """Embedding, one convolution, maximum over the window, one hidden layer; trained by Adam."""

    def __init__(self, embed: int = 8, filters: int = 32, span: int = 5, hidden: int = 16, seed: int = 17):
        draw = np.random.default_rng(seed)
        self.span = span
        self.parts = {
            "embed": draw.normal(0, 0.5, (SYMBOLS, embed)),
            "filters": draw.normal(0, (2 / (span * embed)) ** 0.5, (span * embed, filters)),
            "shift": np.zeros(filters),
            "hidden": draw.normal(0, (2 / filters) ** 0.5, (filters, hidden)),
            "hidden_shift": np.zeros(hidden),
            "out": draw.normal(0, 0.1, hidden),
            "out_shift": np.zeros(1),
        }

    def forward(self, x: np.ndarray) -> tuple:
        p = self.parts
        vectors = p["embed"][x]
        places = x.shape[1] - self.span + 1
        wide = np.concatenate([vectors[:, k : k + places] for k in range(self.span)], axis=2)
        maps = wide @ p["filters"] + p["shift"]
        at = maps.argmax(axis=1)
        top = np.maximum(np.take_along_axis(maps, at[:, None], axis=1)[:, 0], 0)
        layer = np.maximum(top @ p["hidden"] + p["hidden_shift"], 0)
        return wide, at, top, layer, layer @ p["out"] + p["out_shift"]

    def score(self, x: np.ndarray, block: int = 2048) -> np.ndarray:
        return np.concatenate([self.forward(x[a : a + block])[-1] for a in range(0, len(x), block)] or [np.zeros(0)])

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 10, batch: int = 128, rate: float = 2e-3, seed: int = 23):
        draw = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.parts.items()}
        second = {k: np.zeros_like(v) for k, v in self.parts.items()}
        step = 0
        for _ in range(epochs):
            order = draw.permutation(len(x))
            for a in range(0, len(x), batch):
                rows = order[a : a + batch]
                step += 1
                for k, slope in self._slopes(x[rows], y[rows]).items():
                    first[k] += 0.1 * (slope - first[k])
                    second[k] += 0.001 * (slope**2 - second[k])
                    mean, square = first[k] / (1 - 0.9**step), second[k] / (1 - 0.999**step)
                    self.parts[k] -= rate * mean / (np.sqrt(square) + 1e-8)
        return self

    def _slopes(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.parts
        wide, at, top, layer, out = self.forward(x)
        error = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y) / len(y)
        to_layer = np.outer(error, p["out"]) * (layer > 0)
        to_top = (to_layer @ p["hidden"].T) * (top > 0)
        rows, names = np.arange(len(x))[:, None], np.arange(top.shape[1])
        chosen = wide[rows, at]  # row, filter, values under the filter
        to_wide = to_top[:, :, None] * p["filters"].T[None]
        embed = np.zeros_like(p["embed"])
        size = p["embed"].shape[1]
        for k in range(self.span):
            np.add.at(embed, x[rows, at + k], to_wide[:, :, k * size : (k + 1) * size])
        return {
            "embed": embed,
            "filters": np.einsum("rf,rfv->vf", to_top, chosen),
            "shift": to_top.sum(axis=0),
            "hidden": top.T @ to_layer,
            "hidden_shift": to_layer.sum(axis=0),
            "out": layer.T @ error,
            "out_shift": np.array([error.sum()]),
        }


def generated(count: int, seed: int = 5) -> tuple[list[str], list[int]]:
    """Texts with one finding each, secret or harmless, in well-known formats."""
    draw = np.random.default_rng(seed)
    pick = lambda chars, n: "".join(draw.choice(list(chars), n))
    hexes, lower, digits = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    mixed = lower + lower.upper() + digits
    word = lambda: pick("etaoinshrdlu", int(draw.integers(2, 9)))
    size = lambda a, b: int(draw.integers(a, b))
    secret = (
        lambda: "ghp_" + pick(mixed, 36),
        lambda: "sk_live_" + pick(mixed, 24),
        lambda: f"xoxb-{pick(digits, 12)}-{pick(mixed, 24)}",
        lambda: "AKIA" + pick(lower.upper() + digits, 16),
        lambda: pick(hexes, size(32, 65)),
        lambda: pick(mixed + "+/", size(32, 64)) + draw.choice(["", "=", "=="]),
        lambda: pick(mixed + "-_", size(24, 48)),
    )
    harmless = (
        lambda: f"{pick(hexes, 8)}-{pick(hexes, 4)}-{pick(hexes, 4)}-{pick(hexes, 4)}-{pick(hexes, 12)}",
        lambda: f"20{pick(digits, 2)}-0{pick('123456789', 1)}-1{pick(digits, 1)}-{word()}-{word()}",
        lambda: pick(digits, size(16, 24)),
        lambda: "/".join([word(), word(), f"v{pick(digits, 1)}", word(), word()]),
        lambda: "_".join(word() for _ in range(4)) + pick(digits, 2),
        lambda: "-".join([word(), pick(digits, 4), pick(digits, 3), word(), word()]),
        lambda: "=" * size(16, 40) + pick(digits, 1),
        lambda: (word() + word().title() + word().title() + word() + word())[:30] + pick(digits, 1),
        lambda: f"mail-{word()}-{pick(digits, 8)}-{word()}",
        lambda: (word() * 12)[: size(16, 40)] + pick(digits, 1),
    )
    texts, labels = [], []
    for i in range(count):
        made = secret if i % 2 else harmless
        token = made[(i // 2) % len(made)]()
        before = draw.choice(["", "key: ", "auth=", "id ", 'value = "', "see "])
        texts.append(f"{word()} {word()} {before}{token}{draw.choice(['', '.', ',', chr(34)])} {word()} {word()}")
        labels.append(i % 2)
    return texts, labels


class Scanner:
    """Network, calibration and threshold; picklable, so that it can be broadcast."""

    def __init__(self, network: Network, slope: float, shift: float, threshold: float):
        self.network, self.slope, self.shift, self.threshold = network, slope, shift, threshold

    def probabilities(self, candidates: Candidates) -> np.ndarray:
        """Calibrated probability of each candidate: that of its likeliest window."""
        x, of = candidates.windows()
        raw = np.full(len(candidates.starts), -np.inf)
        np.maximum.at(raw, of, self.network.score(x))
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.shift, -30, 30)))

    def find(self, texts: list[str]) -> list[tuple[list, list]]:
        """Base spans, and the spans that the network adds where no base span lies, of every text."""
        base = [base_spans(t) for t in texts]
        candidates = Candidates(texts)
        added: list[list[tuple[int, int]]] = [[] for _ in texts]
        if len(candidates.starts):
            sure = self.probabilities(candidates) >= self.threshold
            for (text, start, end), yes in zip(candidates.relative(), sure.tolist()):
                if yes and not any(a < end and start < b for a, _, b in base[text]):
                    added[text].append((start, end))
        return list(zip(base, added))


def calibrated(score: np.ndarray, y: np.ndarray, n: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope and shift of the logistic curve through held-back scores, each counted ``n`` times."""
    slope, shift = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(slope * score + shift, -30, 30)))
        w = n * (p * (1 - p) + 1e-3)
        g = np.array([(n * (y - p) * score).sum() - 1e-2 * (slope - 1), (n * (y - p)).sum()])
        h = np.array([[(w * score**2).sum() + 1e-2, (w * score).sum()], [(w * score).sum(), w.sum()]])
        move = np.linalg.solve(h + 1e-6 * np.eye(2), g)
        slope, shift = max(0.05, slope + float(move[0])), shift + float(move[1])
        if np.abs(move).max() < 1e-6:
            break
    return slope, shift


def train(
    docs: DataFrame,
    made: int = 4000,
    recall: float = 0.97,
    key: str = "doc_id",
    text: str = "text",
    shard: int = SHARD,
) -> Scanner:
    """Learn from the distinct first windows of all candidates of all documents and from ``made``
    generated ones.

    Windows are dealt by hash to shards of about ``shard``; in each round every shard trains the network
    of the last round on its windows and on the generated ones, and the networks are averaged.  A fifth
    of the windows, also by hash, is held back for calibration and for the threshold, the highest with a
    recall of at least ``recall`` (and never under one half).
    """
    bound_batches(docs.sparkSession)
    found = stage(windows(docs, text), "secret-windows")
    learn = found.filter("part > 0")
    shards = max(1, -(-learn.count() // shard))
    dealt = learn.withColumn("shard", F.pmod(F.xxhash64("window", F.lit(shards)), F.lit(shards)))
    # As many tasks as shards: their bytes are few, but not their work.
    dealt = dealt.repartition(shards, "shard")
    extra, truth = made_windows(made)
    held = np.random.default_rng(11).random(len(extra)) < 0.2
    network = Network()
    for turn in range(ROUNDS):
        parts = dealt.groupBy("shard").applyInArrow(
            _turn(network.parts, turn, extra[~held], truth[~held]), "shard long, n long, parts binary"
        )
        nets = sorted(parts.collect(), key=lambda r: r["shard"])
        if nets:
            shares = np.array([r["n"] for r in nets]) / sum(r["n"] for r in nets)
            each = [pickle.loads(r["parts"]) for r in nets]
            network.parts = {k: sum(s * e[k] for s, e in zip(shares, each)) for k in network.parts}
        else:
            network.fit(extra[~held], truth[~held].astype(float), EPOCHS, seed=turn)
    counts = _held_scores(found.filter("part = 0"), network)
    raw = np.concatenate([network.score(extra[held]), counts[0]])
    y, n = np.concatenate([truth[held], counts[1]]), np.concatenate([np.ones(held.sum()), counts[2]])
    slope, shift = calibrated(raw, y, n)
    order = np.argsort(raw[y == 1])
    p = 1 / (1 + np.exp(-np.clip(slope * raw[y == 1][order] + shift, -30, 30)))
    upto = np.cumsum(n[y == 1][order])
    at = np.searchsorted(upto, int((1 - recall) * upto[-1]), "right") if len(p) else 0
    threshold = max(0.5, float(p[at])) if len(p) else 0.5
    return Scanner(network, slope, shift, threshold)


def windows(docs: DataFrame, text: str = "text") -> DataFrame:
    """Distinct first windows of all candidates with their labels; ``part`` 0 to 4 by hash."""
    marked = docs.filter(F.col(text).rlike(f"[A-Za-z0-9+/_=-]{{{LEAST},}}") & F.col(text).rlike("[0-9]"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x, labels = labelled(batch.column(0).to_pylist())
            rows = [row.astype(np.uint8).tobytes() for row in x]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.binary()), pa.array(labels, pa.int32())], ["window", "label"]
            )

    every = marked.select(F.col(text).alias("text")).mapInArrow(run, "window binary, label int").distinct()
    return every.withColumn("part", F.pmod(F.xxhash64("window"), F.lit(5)))


def _matrix(column) -> np.ndarray:
    return np.array([np.frombuffer(b, np.uint8) for b in column.to_pylist()], np.int64).reshape(-1, WIDTH)


def _turn(parts: dict, turn: int, extra: np.ndarray, truth: np.ndarray):
    """Train a copy of the network on a shard and the generated windows."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("window", "ascending"), ("label", "ascending")])
        network = Network()
        network.parts = {k: v.copy() for k, v in parts.items()}
        x = np.concatenate([extra, _matrix(table.column("window"))])
        y = np.concatenate([truth, table.column("label").to_numpy()]).astype(float)
        network.fit(x, y, EPOCHS, seed=turn)
        row = {"shard": key[0].as_py(), "n": table.num_rows, "parts": pickle.dumps(network.parts)}
        return pa.Table.from_pylist([row])

    return run


def _held_scores(held: DataFrame, network: Network) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of held-back windows to three decimals, their labels and how many windows have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.clip(network.score(_matrix(batch.column(0))), -RANGE, RANGE)
            scores = np.rint(raw * 1000).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(scores), batch.column(1)], ["score", "label"])

    scored = held.select("window", "label").mapInArrow(run, "score long, label int")
    rows = scored.groupBy("score", "label").count().orderBy("score", "label").collect()
    score, label, n = np.array([tuple(r) for r in rows], float).reshape(-1, 3).T
    return score / 1000, label, n


def labelled(texts: list[str]) -> tuple[np.ndarray, list[int]]:
    """First windows of the candidates, and whether a base span holds them."""
    candidates = Candidates(texts)
    x, of = candidates.windows()
    first = np.flatnonzero(np.diff(of, prepend=-1))
    spans = [base_spans(t) for t in texts]
    inside = [int(any(a < end and start < b for a, _, b in spans[text])) for text, start, end in candidates.relative()]
    return x[first], inside


def made_windows(count: int) -> tuple[np.ndarray, np.ndarray]:
    """First windows and labels of the generated findings that are candidates."""
    texts, truth = generated(count)
    candidates = Candidates(texts)
    x, of = candidates.windows()
    # The first candidate of a text is the finding.
    first = np.unique(candidates.text_of[of], return_index=True)[1]
    return x[first], np.array(truth)[candidates.text_of[of[first]]]


def joined(base: list[tuple[int, int, int]], added: list[tuple[int, int]]) -> str:
    """All spans by start, base spans first among equals, then by kind as listed."""
    named = [(start, kind, end) for start, kind, end in base] + [(start, len(KINDS), end) for start, end in added]
    return ",".join(f"{(*KINDS, 'network')[kind]}:{start}:{end}" for start, kind, end in sorted(named))


def scan(docs: DataFrame, scanner: Scanner, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``key``, the number of base spans of each kind, ``base_sha256`` and
    ``spans``.

    Added spans are named ``network``.  Positions are code points, ends exclusive.  Null text is
    empty and has no spans.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scanner)

    def work(texts):
        found = shared.value.find([t or "" for t in texts])
        counts = {f"n_{k}": [sum(s[1] == i for s in b) for b, _ in found] for i, k in enumerate(KINDS)}
        return counts | {
            "base_sha256": [hashlib.sha256(joined(b, []).encode()).hexdigest() for b, _ in found],
            "spans": [joined(b, a) for b, a in found],
        }

    schema = ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return map_texts(docs, work, schema, key, text)
