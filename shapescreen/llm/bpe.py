"""Exact byte-pair encoding by dynamic programming over prefixes, and decoding.

Byte-pair encoding gives every prefix of a word one encoding, so it is enough to know the last token
of each prefix.  A suffix automaton of the vocabulary follows the word; its state and the states
above it by suffix links name all tokens that end at a position.  Of these, the last token of the
prefix is the one that may stand after the last token of the prefix before it.  Following the last
tokens back from the end of the word gives the ids.

Two tokens may stand side by side if undoing their merges at the seam, latest first, never meets a
merge across the seam that would have come earlier.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapescreen.llm.batches import map_texts
from shapescreen.llm.pretokens import Pieces, Vocabulary, printed_bytes, starts_without_spaces

#: Rank of symbols that no merge makes.
BASE = -1
#: Remembered seams; beyond that they are forgotten and tested anew.
SEAMS = 1 << 20


class Automaton:
    """Suffix automaton of many sequences of symbols below ``width``."""

    def __init__(self, sequences: list[list[int]], width: int):
        moves: list[dict[int, int]] = [{}]
        self.link, longest = [-1], [0]
        for sequence in sequences:
            last = 0
            for symbol in sequence:
                last = self._extend(moves, longest, last, symbol)
        self.width = width
        self.moves = {state * width + symbol: to for state, own in enumerate(moves) for symbol, to in own.items()}
        self.longest = longest

    def _extend(self, moves: list[dict[int, int]], longest: list[int], last: int, symbol: int) -> int:
        def copy_of(at: int, target: int) -> int:
            """Split off the shorter strings of a state that is reached too early."""
            clone = len(moves)
            moves.append(dict(moves[target]))
            longest.append(longest[at] + 1)
            self.link.append(self.link[target])
            self.link[target] = clone
            while at >= 0 and moves[at].get(symbol) == target:
                moves[at][symbol] = clone
                at = self.link[at]
            return clone

        if symbol in moves[last]:  # another sequence came this way
            target = moves[last][symbol]
            return target if longest[target] == longest[last] + 1 else copy_of(last, target)
        state = len(moves)
        moves.append({})
        longest.append(longest[last] + 1)
        self.link.append(0)
        at = last
        while at >= 0 and symbol not in moves[at]:
            moves[at][symbol] = state
            at = self.link[at]
        if at >= 0:
            target = moves[at][symbol]
            self.link[state] = target if longest[target] == longest[at] + 1 else copy_of(at, target)
        return state

    def state_of(self, sequence: list[int]) -> int:
        state = 0
        for symbol in sequence:
            state = self.moves[state * self.width + symbol]
        return state


class PairEncoder:
    """Encoder and decoder of one vocabulary; picklable, so that it can be broadcast."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        vocabulary: dict[str, int] = model["vocab"]
        self.names = {n: token for token, n in vocabulary.items()}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        size = max(vocabulary.values()) + 1
        self.rank = [BASE] * size
        self.halves: list[tuple[int, int]] = [(-1, -1)] * size
        self.merges: dict[int, int] = {}
        self.size = size
        for rank, (a, b) in enumerate(pairs):
            left, right, token = vocabulary[a], vocabulary[b], vocabulary[a + b]
            self.rank[token], self.halves[token] = rank, (left, right)
            self.merges[left * size + right] = rank
        printed = {byte: c for c, byte in printed_bytes().items()}
        self.inner = [vocabulary.get(printed[b], -1) for b in range(256)]
        self.final = [vocabulary.get(printed[b] + self.end, -1) for b in range(256)]

        # Symbols of every token, by its halves; only tokens that encode to themselves take part.
        spelled: dict[int, list[int]] = {t: [t] for t in (*self.inner, *self.final) if t >= 0}
        for rank, (a, b) in enumerate(pairs):
            left, right, token = vocabulary[a], vocabulary[b], vocabulary[a + b]
            if left in spelled and right in spelled and self._apart(left, right, rank):
                spelled.setdefault(token, spelled[left] + spelled[right])
        automaton = Automaton(list(spelled.values()), size)
        own: dict[int, list[tuple[int, int]]] = {}
        for token, symbols in spelled.items():
            own.setdefault(automaton.state_of(symbols), []).append((len(symbols), token))
        self.own = {state: sorted(tokens, reverse=True) for state, tokens in own.items()}
        # The nearest state above that holds tokens.
        self.above = [0] * len(automaton.link)
        for state in sorted(range(1, len(automaton.link)), key=automaton.longest.__getitem__):
            up = automaton.link[state]
            self.above[state] = up if up in own else self.above[up]
        self.keys = np.fromiter(automaton.moves.keys(), np.int64, len(automaton.moves))
        self.targets = np.fromiter(automaton.moves.values(), np.int32, len(automaton.moves))
        self.link, self.longest = np.array(automaton.link, np.int32), np.array(automaton.longest, np.int32)
        self.above = np.array(self.above, np.int32)

    def _start(self) -> None:
        """What only a worker needs."""
        self.moves = dict(zip(self.keys.tolist(), self.targets.tolist()))
        self.links, self.lengths, self.ups = self.link.tolist(), self.longest.tolist(), self.above.tolist()
        self.seams: dict[int, bool] = {}
        self.words = Vocabulary(self._make, self._forget, bits=20)
        self.odd = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) or "(?!)")

    def _apart(self, left: int, right: int, limit: int) -> bool:
        """No merge of a rank below the limit joins the two before they are complete."""
        rank, halves = self.rank, self.halves
        while True:
            merge = self.merges.get(left * self.size + right)
            if merge is not None and merge < limit:
                return False
            if rank[left] > rank[right]:
                limit = rank[left]
                left = halves[left][1]
            elif rank[right] != BASE:
                limit = rank[right] + 1  # of equal merges the one further left comes first
                right = halves[right][0]
            else:
                return True

    def _seam(self, left: int, right: int) -> bool:
        key = left * self.size + right
        found = self.seams.get(key)
        if found is None:
            if len(self.seams) >= SEAMS:
                self.seams.clear()
            found = self.seams[key] = self._apart(left, right, len(self.merges))
        return found

    def encode_word(self, word: str) -> list[int]:
        """Ids of one piece of a text."""
        data = word.encode("utf-8", "surrogatepass")
        symbols = [self.inner[b] for b in data[:-1]] + [self.final[data[-1]]]
        moves, links, lengths, ups, own, size = self.moves, self.links, self.lengths, self.ups, self.own, self.size
        last = [-1] * (len(symbols) + 1)
        begin = [0] * (len(symbols) + 1)
        state = length = 0
        for i, symbol in enumerate(symbols, 1):
            target = moves.get(state * size + symbol)
            while target is None:
                state = links[state]
                length = lengths[state]
                target = moves.get(state * size + symbol)
            state = target
            length += 1
            at = state
            while at:
                for n, token in own.get(at, ()):
                    if n <= length:
                        before = last[i - n]
                        if n == i or (before >= 0 and self._seam(before, token)):
                            last[i], begin[i] = token, i - n
                            at = 0
                            break
                else:
                    at = ups[at]
        ids = []
        at = len(symbols)
        while at:
            ids.append(last[at])
            at = begin[at]
        return ids[::-1]

    def _forget(self) -> None:
        self.printed: list[str] = []
        self.counts = np.zeros(0, np.int64)
        self.decoded: list[str] = []

    def _make(self, words: list[str]) -> None:
        found = [self.encode_word(w) for w in words]
        self.printed += [" ".join(map(str, ids)) for ids in found]
        self.decoded += [" ".join([self.names[i] for i in ids]) for ids in found]
        self.counts = np.concatenate([self.counts, np.fromiter(map(len, found), np.int64, len(found))])

    def normal(self, text: str) -> str:
        """Composed and in lower case, character by character; white space needs no change."""
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()

    def run(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """Number of tokens, printed ids and decoded text of each text."""
        if not hasattr(self, "words"):
            self._start()
        # Special tokens divide a text; their parts are encoded like texts.
        parts: list[str] = []
        layout: list[tuple[int, list[int]]] = []
        for text in texts:
            first = len(parts)
            between: list[int] = []
            at = 0
            for match in self.odd.finditer(text or ""):
                parts.append(self.normal(text[at : match.start()]))
                between.append(self.specials[match[0]])
                at = match.end()
            parts.append(self.normal((text or "")[at:]))
            layout.append((first, between))
        pieces = Pieces(parts, starts_without_spaces)
        numbers = self.words.numbers_of(pieces)
        edges = np.concatenate([[0], np.cumsum(pieces.counts)]).tolist()
        sums = np.concatenate([[0], np.cumsum(self.counts[numbers])]).tolist()
        at = numbers.tolist()
        printed, decoded = self.printed, self.decoded
        found = []
        for first, between in layout:
            a, b = edges[first], edges[first + 1]
            ids = " ".join([printed[n] for n in at[a:b]])
            text = " ".join([decoded[n] for n in at[a:b]])
            count = sums[b] - sums[a]
            for k, special in enumerate(between, first + 1):
                a, b = edges[k], edges[k + 1]
                name = next(c for c, n in self.specials.items() if n == special)
                ids = " ".join(filter(None, [ids, str(special), *(printed[n] for n in at[a:b])]))
                text = " ".join(filter(None, [text, name, *(decoded[n] for n in at[a:b])]))
                count += 1 + sums[b] - sums[a]
            found.append((count, ids, text))
        return found

    def encode(self, text: str | None) -> list[int]:
        return [int(n) for n in self.run([text])[0][1].split()]

    def digests(self, texts: list[str | None]) -> dict[str, list]:
        found = self.run(texts)
        sha = lambda text: hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
        return {
            "n_tokens": [n for n, _, _ in found],
            "ids_sha256": [sha(ids) for _, ids, _ in found],
            "decoded_sha256": [sha(text) for _, _, text in found],
        }

    def __getstate__(self) -> dict:
        made = ("moves", "links", "lengths", "ups", "seams", "words", "odd", "printed", "counts", "decoded")
        return {k: v for k, v in self.__dict__.items() if k not in made}


def encode(docs: DataFrame, definition: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``key, ids``.  Null and empty texts have no ids."""
    shared = docs.sparkSession.sparkContext.broadcast(PairEncoder(definition))

    def work(texts):
        found = [[int(n) for n in ids.split()] for _, ids, _ in shared.value.run(texts)]
        return {"ids": pa.array(found, pa.list_(pa.int32()))}

    return map_texts(docs, work, "ids array<int>", key, text)


def decode(rows: DataFrame, definition: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """One row per input row: ``key, text``: the tokens' strings joined by spaces, as the vocabulary
    has no decoder.  Ids that it lacks are left out; null ids give an empty text."""
    spec = json.loads(definition)
    names = {n: token for token, n in spec["model"]["vocab"].items()}
    names |= {t["id"]: t["content"] for t in spec["added_tokens"]}
    shared = rows.sparkSession.sparkContext.broadcast(names)

    @F.pandas_udf("string")
    def joined(column):
        known = shared.value
        return column.map(lambda found: " ".join(known[i] for i in (() if found is None else found) if i in known))

    return rows.select(key, joined(F.col(ids)).alias("text"))


def encode_digests(docs: DataFrame, definition: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``key, n_tokens, ids_sha256, decoded_sha256``.

    The digests are of the decimal ids joined by one space and of the decoded text.  Null text is
    empty text, of no tokens.
    """
    shared = docs.sparkSession.sparkContext.broadcast(PairEncoder(definition))
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_texts(docs, lambda texts: shared.value.digests(texts), schema, key, text)
