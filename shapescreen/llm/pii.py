"""Personal data by fixed patterns and a skip-chain conditional random field.

The patterns (e-mail, network address, payment card, phone) give the base spans.  The field adds
spans that they miss: its nodes are the document's tokens with a digit or an @; neighbouring nodes
form a chain, and nodes that repeat or resemble each other, however far apart, share a skip edge.
Loopy message passing over both kinds of edges, until the messages of a document settle, spreads
what is known about one mention to the others, however many they are, so that a number that is
plainly a phone in one place is one everywhere in the document.

Base spans are observed during inference, and never given up.  The field learns its weights from
the base labels of a bounded sample, by pseudo-likelihood.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapescreen.llm.batches import bound_batches, code_points, map_texts, slices

KINDS = ("email", "ip", "card", "phone")
OUTSIDE = len(KINDS)
LABELS = OUTSIDE + 1

#: Posterior that an added span needs.
CERTAIN = 0.9
#: Messages of a document have settled when none moves by more.
SETTLED = 1e-3
#: Rounds after which messages that still swing, which loops may cause, are damped more and more.
ROUNDS = 1000
#: Characters between chain neighbours at most.
CHAIN = 24
#: Hashed features of a node.
SPACE = 4096
#: Shortest token keys that skip edges join.
LEAST_KEY = 6

# Possessive runs never give back what they took, so long runs cost one pass.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Spans found from each @, so that long runs without one cost nothing."""
    found = []
    done = 0
    at = text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > done and _is_local(text[start - 1]):
                start -= 1
            if start < at:
                found.append((start, domain.end()))
                done = domain.end()
        at = text.find("@", max(at + 1, done))
    return found


def _is_local(c: str) -> bool:
    return c.isascii() and (c.isalnum() or c in "._%+-")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind as listed, then start; leftmost and non-overlapping in a kind."""
    found = [(0, *span) for span in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            found.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((3, *m.span()))
    return found


class Nodes:
    """Tokens with a digit or an @ of all texts, in order."""

    def __init__(self, texts: list[str]):
        points, offsets = code_points(texts)
        gap = (points == 32) | ((points >= 9) & (points <= 13))
        begins = np.zeros(len(points) + 1, bool)
        begins[offsets] = True
        solid = np.concatenate([[False], ~gap, [False]])
        starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | begins[:-1]))
        ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | begins[1:])) + 1
        run = np.concatenate([[0], np.cumsum(((points >= 48) & (points <= 57)) | (points == 64))])
        chosen = run[ends] > run[starts]
        self.starts, self.ends = starts[chosen], ends[chosen]
        self.text_of = np.searchsorted(offsets, self.starts, "right") - 1
        self.offsets = offsets
        self.starts -= offsets[self.text_of]
        self.ends -= offsets[self.text_of]
        self.tokens = [texts[t][a:b] for t, a, b in zip(self.text_of.tolist(), self.starts.tolist(), self.ends.tolist())]

    def chain(self) -> np.ndarray:
        """Pairs of neighbours in one text that stand close together."""
        left = np.arange(len(self.tokens) - 1) if len(self.tokens) else np.zeros(0, np.int64)
        near = (self.text_of[left] == self.text_of[left + 1]) & (self.starts[left + 1] - self.ends[left] <= CHAIN)
        return np.stack([left[near], left[near] + 1], axis=1)

    def skips(self, known: np.ndarray | None = None) -> np.ndarray:
        """Pairs of mentions of one key in a text: each mention joins the one before it, the key's
        first and, of each kind in ``known``, the first that has it.  So any two mentions are at
        most two edges apart, and the edges of a key grow with its mentions, not with their pairs."""
        mentions: dict[tuple, list[int]] = {}
        for i, (text, token) in enumerate(zip(self.text_of.tolist(), self.tokens)):
            letters = re.sub(r"[^a-z0-9@]", "", token.lower())
            digits = re.sub(r"[^0-9]", "", token)
            for kind, key in ((0, letters), (1, digits)):
                if len(key) >= LEAST_KEY:
                    mentions.setdefault((text, kind, key), []).append(i)
        labels = [OUTSIDE] * len(self.tokens) if known is None else known.tolist()
        found = set()
        for own in mentions.values():
            found.update(zip(own, own[1:]))
            hubs = {labels[i]: i for i in reversed(own) if labels[i] != OUTSIDE}
            for hub in {own[0], *hubs.values()}:
                found.update((min(hub, i), max(hub, i)) for i in own if i != hub)
        return np.array(sorted(found), np.int64).reshape(-1, 2)


def shape(token: str) -> str:
    """The token's pattern: digits as 9, letters as a, repeats once."""
    plain = re.sub(r"[0-9]", "9", re.sub(r"[^\W\d_]", "a", token[:64]))
    return re.sub(r"(.)\1+", r"\1", plain)


def node_features(nodes: Nodes, texts: list[str]) -> list[np.ndarray]:
    """Hashed features of every node: shape, sizes, signs, checks and the words around it."""
    found = []
    for text_of, start, end, token in zip(nodes.text_of.tolist(), nodes.starts.tolist(), nodes.ends.tolist(), nodes.tokens):
        text = texts[text_of]
        digits = re.sub(r"[^0-9]", "", token)
        before = re.findall(r"[^\W\d_]+", text[max(0, start - 32) : start].lower())[-2:]
        after = re.findall(r"[^\W\d_]+", text[end : end + 32].lower())[:1]
        core = token.strip(".,;:!?\"'*#$%&()[]")
        names = [
            "bias",
            f"shape {shape(token)}",
            f"core {shape(core)}",
            f"digits {min(len(digits), 20)}",
            f"length {min(len(token), 40) // 4}",
            f"at {'@' in token}",
            f"plus {token[:1] == '+' or core[:1] == '+'}",
            f"dots {min(token.count('.'), 4)}",
            f"dashes {min(token.count('-'), 4)}",
            f"letters {any(c.isalpha() for c in token)}",
            f"checked {13 <= len(digits) <= 19 and luhn(digits)}",
            f"address {bool(_IP.fullmatch(core)) and all(len(p) <= 3 and int(p) <= 255 for p in core.split('.'))}",
            *(f"before {w}" for w in before),
            *(f"after {w}" for w in after),
        ]
        found.append(np.array([zlib.crc32(n.encode("utf-8", "replace")) % SPACE for n in names], np.int32))
    return found


def observed(nodes: Nodes, spans: list[list[tuple[int, int, int]]]) -> np.ndarray:
    """The kind of the base span that each node overlaps, OUTSIDE if none.  Of several the first listed."""
    labels = np.full(len(nodes.tokens), OUTSIDE)
    first = np.searchsorted(nodes.text_of, np.arange(len(spans)))
    last = np.searchsorted(nodes.text_of, np.arange(len(spans)), "right")
    for text, own in enumerate(spans):
        a, b = int(first[text]), int(last[text])
        for kind, start, end in reversed(own):
            low = a + int(np.searchsorted(nodes.ends[a:b], start, "right"))
            high = a + int(np.searchsorted(nodes.starts[a:b], end, "left"))
            labels[low:high] = kind
    return labels


class Field:
    """Weights: unary by feature and label, and one matrix each for chain and skip edges."""

    def __init__(self):
        self.unary = np.zeros((SPACE, LABELS))
        self.chain = np.zeros((LABELS, LABELS))
        self.skip = np.zeros((LABELS, LABELS))

    def energies(self, rows: list[np.ndarray]) -> np.ndarray:
        if not rows:
            return np.zeros((0, LABELS))
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        return np.add.reduceat(self.unary[np.concatenate(rows)], np.cumsum(lengths) - lengths, axis=0)

    def fit(self, rows: list[np.ndarray], labels: np.ndarray, chain: np.ndarray, skips: np.ndarray, steps: int = 150):
        """Pseudo-likelihood: each label given its neighbours' labels, by damped gradient steps."""
        if not len(labels):
            return self
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), lengths)
        truth = np.eye(LABELS)[labels]
        speed = [np.full_like(m, 1e-8) for m in (self.unary, self.chain, self.skip)]
        for _ in range(steps):
            score = self.energies(rows)
            for edges, weight in ((chain, self.chain), (skips, self.skip)):
                np.add.at(score, edges[:, 0], weight[:, labels[edges[:, 1]]].T)
                np.add.at(score, edges[:, 1], weight[labels[edges[:, 0]]])
            p = np.exp(score - score.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            error = (truth - p) / len(labels)
            slopes = [np.zeros_like(m) for m in (self.unary, self.chain, self.skip)]
            np.add.at(slopes[0], flat, error[owner])
            for edges, slope in ((chain, slopes[1]), (skips, slopes[2])):
                np.add.at(slope.T, labels[edges[:, 1]], error[edges[:, 0]])
                np.add.at(slope, labels[edges[:, 0]], error[edges[:, 1]])
            for weight, slope, past in zip((self.unary, self.chain, self.skip), slopes, speed):
                slope -= 1e-5 * weight
                past += slope**2
                weight += 0.3 * slope / np.sqrt(past)
        # Mentions of one entity agree, even if the sample has no such pair.
        self.skip = np.maximum(self.skip, 0) * np.eye(LABELS) + np.minimum(self.skip, 0) * (1 - np.eye(LABELS))
        self.skip += 2.0 * np.eye(LABELS)
        return self

    def marginals(
        self,
        rows: list[np.ndarray],
        known: np.ndarray,
        chain: np.ndarray,
        skips: np.ndarray,
        text_of: np.ndarray | None = None,
    ) -> np.ndarray:
        """Beliefs by loopy sum-product with damping; known nodes (not OUTSIDE) are held.

        Each text goes on until its own messages settle, whatever else is in the batch.
        """
        local = self.energies(rows)
        local[known != OUTSIDE] = -30.0
        held = np.flatnonzero(known != OUTSIDE)
        local[held, known[held]] = 30.0
        source = np.concatenate([chain[:, 0], chain[:, 1], skips[:, 0], skips[:, 1]])
        target = np.concatenate([chain[:, 1], chain[:, 0], skips[:, 1], skips[:, 0]])
        # Weight [edge, label of the source, label of the target].
        weights = np.concatenate(
            [np.tile(m, (len(e), 1, 1)) for m, e in ((self.chain, chain), (self.chain.T, chain), (self.skip, skips), (self.skip.T, skips))]
        )
        turn = np.concatenate([np.arange(len(chain)) + len(chain), np.arange(len(chain))])
        turn = np.concatenate(
            [turn, 2 * len(chain) + np.concatenate([np.arange(len(skips)) + len(skips), np.arange(len(skips))])]
        ).astype(np.int64)
        messages = np.zeros((len(source), LABELS))
        text = np.zeros(len(source), np.int64) if text_of is None else text_of[source]
        live = np.arange(len(source))
        rounds = 0
        while len(live):
            belief = local.copy()
            np.add.at(belief, target[live], messages[live])
            out = (belief[source[live]] - messages[turn[live]])[:, :, None] + weights[live]
            top = out.max(axis=1, keepdims=True)
            new = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0]
            new -= new.max(axis=1, keepdims=True)
            # Halves at first; later less and less, so that the steps end.
            step = 0.5 * min(1.0, 0.97 ** (rounds - ROUNDS))
            change = step * (new - messages[live])
            messages[live] += change
            moved = np.zeros(int(text[live].max()) + 1)
            np.maximum.at(moved, text[live], np.abs(change).max(axis=1))
            live = live[moved[text[live]] > SETTLED / 2]
            rounds += 1
        belief = local
        np.add.at(belief, target, messages)
        belief = np.exp(belief - belief.max(axis=1, keepdims=True))
        return belief / belief.sum(axis=1, keepdims=True)

    def find(self, texts: list[str]) -> list[tuple[list, list]]:
        """Base spans and added spans of every text."""
        base = [base_spans(t) for t in texts]
        nodes = Nodes(texts)
        added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        known = observed(nodes, base)
        if len(known):
            belief = self.marginals(node_features(nodes, texts), known, nodes.chain(), nodes.skips(known), nodes.text_of)
            label, sure = belief.argmax(axis=1), belief.max(axis=1) >= CERTAIN
            before = -2
            for i in np.flatnonzero((known == OUTSIDE) & (label != OUTSIDE) & sure).tolist():
                text, kind = int(nodes.text_of[i]), int(label[i])
                start, end = trimmed(nodes.tokens[i], int(nodes.starts[i]))
                own = added[text]
                close = own and before == i - 1 and own[-1][0] == kind and start - own[-1][2] <= 3
                if start < end:
                    if close:
                        own[-1] = (kind, own[-1][1], end)
                    else:
                        own.append((kind, start, end))
                before = i
        return list(zip(base, added))


def trimmed(token: str, start: int) -> tuple[int, int]:
    """The token without signs at its ends."""
    solid = [i for i, c in enumerate(token) if c.isalnum() or c == "+"]
    return (start + solid[0], start + solid[-1] + 1) if solid else (start, start)


def train(docs: DataFrame, rows: int = 2000, nodes: int = 48, key: str = "doc_id", text: str = "text") -> Field:
    """Learn from the base labels of at most ``rows`` documents that hold a digit, those with the
    smallest hashes of their keys, and of each at most ``nodes`` tokens in a row.

    Features are computed in tasks; the driver gets at most ``rows * nodes`` short rows.
    """
    bound_batches(docs.sparkSession)
    marked = docs.filter(F.col(text).rlike("[0-9@]")).select(F.xxhash64(F.col(key), F.lit(4)).alias("hash"), F.col(text).alias("text"))
    last = marked.select("hash").orderBy("hash").limit(rows).agg(F.max("hash")).first()[0]
    if last is None:
        return Field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            found = Nodes(texts)
            labels = observed(found, [base_spans(t) for t in texts])
            rows_of = node_features(found, texts)
            nth = np.arange(len(labels)) - np.searchsorted(found.text_of, found.text_of)
            kept = np.flatnonzero(nth < nodes)
            place = {int(k): n for n, k in enumerate(kept)}
            pairs = []
            for edges in (found.chain(), found.skips()):
                own = [[] for _ in kept]
                for a, b in edges.tolist():
                    if a in place and b in place:
                        own[place[b]].append(int(nth[b] - nth[a]))
                pairs.append(own)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(found.text_of[kept])),
                    pa.array(nth[kept].astype(np.int64)),
                    pa.array(labels[kept].astype(np.int64)),
                    pa.array([rows_of[k].tolist() for k in kept], pa.list_(pa.int32())),
                    *(pa.array(own, pa.list_(pa.int32())) for own in pairs),
                ],
                ["hash", "nth", "label", "features", "chain", "skips"],
            )

    schema = "hash long, nth long, label long, features array<int>, chain array<int>, skips array<int>"
    sample = marked.filter(F.col("hash") <= last).mapInArrow(run, schema).toPandas()
    sample = sample.sort_values(["hash", "nth"], kind="stable").reset_index(drop=True)
    edges = [
        np.array([(i - back, i) for i, own in enumerate(sample[c]) for back in own], np.int64).reshape(-1, 2)
        for c in ("chain", "skips")
    ]
    features = [np.asarray(f, np.int32) for f in sample["features"]]
    return Field().fit(features, sample["label"].to_numpy(np.int64), *edges)


def joined(spans: list[tuple[int, int, int]], names=KINDS) -> str:
    return ",".join(f"{names[kind]}:{start}:{end}" for kind, start, end in sorted(spans))


def scan(docs: DataFrame, field: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``key``, the number of base spans of each kind, ``base_sha256`` and
    ``spans``.

    Added spans are named ``field_<kind>`` and stand after the base spans.  Positions are code
    points, ends exclusive.  Null text is empty and has no spans.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def work(texts):
        found = shared.value.find([t or "" for t in texts])
        base = [joined(b) for b, _ in found]
        more = [joined(a, [f"field_{k}" for k in KINDS]) for _, a in found]
        counts = {f"n_{k}": [sum(s[0] == i for s in b) for b, _ in found] for i, k in enumerate(KINDS)}
        return counts | {
            "base_sha256": [hashlib.sha256(b.encode()).hexdigest() for b in base],
            "spans": [",".join(filter(None, pair)) for pair in zip(base, more)],
        }

    schema = ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return map_texts(docs, work, schema, key, text)


def masked_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind; spans that overlap become one, named by the first."""
    parts, done = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e in spans):
        if start >= done:
            parts += [text[done:start], f"[{KINDS[kind].upper()}]"]
        done = max(done, end)
    return "".join([*parts, text[done:]])


def redact(docs: DataFrame, field: Field, text: str = "text", length: str | None = None) -> DataFrame:
    """All columns of the input, the text with personal data replaced; ``length`` names a column
    that is kept equal to the text's length.  Null text stays null; other texts stay as they are."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    names = docs.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            texts = batch.column(at).to_pylist()
            found = shared.value.find([t or "" for t in texts])
            columns = list(batch.columns)
            new = [t if not (b or a) else masked_text(t, b + a) for t, (b, a) in zip(texts, found)]
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if length:
                k = names.index(length)
                old = columns[k].to_pylist()
                sizes = [n if t is s else len(s) for n, t, s in zip(old, texts, new)]
                columns[k] = pa.array(sizes, batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)
