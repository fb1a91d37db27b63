"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text knows every substring of that text.  A
document is parsed against it from left to right into phrases, each the longest match that the
labelled text holds; a phrase costs ``log2`` of that text's length.  The language with the fewest
normalised phrases (bits per character) wins.

The automata are stored as dense transition tables in which a missing transition already leads to
the state after the first character of a new phrase, so tasks parse thousands of blocks of text in
step with a few NumPy operations per character.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shapescreen.llm.batches import bound_batches, code_points, map_texts, slices, totals

#: Documents are parsed in blocks of so many characters; a phrase ends at a block's end.
BLOCK = 512
#: Sharpness of the score: characters that count as independent evidence.
EVIDENCE = 16
#: Phrases that end at a table entry are counted in its bits from here on.
PHRASE = 1 << 28
SPACE, OTHER, DROP = 0, 1, 255


def sample(docs: DataFrame, rows: int) -> DataFrame:
    """Of ``key, text, label``: at most ``rows`` rows of each label, those with the smallest hashes of
    their keys."""
    order = Window.partitionBy("chosen_label").orderBy("hash", "chosen_key")
    named = docs.filter(F.col("label").isNotNull() & F.col("text").isNotNull()).select(
        F.col("key").alias("chosen_key"), F.col("label").alias("chosen_label"), F.xxhash64("key").alias("hash")
    )
    chosen = named.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= rows)
    same = (F.col("key") == F.col("chosen_key")) & (F.col("label") == F.col("chosen_label"))
    return docs.join(F.broadcast(chosen.select("chosen_key", "chosen_label")), same, "left_semi")


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the root."""
    moves: list[dict[int, int]] = [{}]
    link, longest = [-1], [0]
    last = 0
    for symbol in symbols:
        state = len(moves)
        moves.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and symbol not in moves[at]:
            moves[at][symbol] = state
            at = link[at]
        if at >= 0:
            target = moves[at][symbol]
            if longest[at] + 1 == longest[target]:
                link[state] = target
            else:
                copy = len(moves)
                moves.append(dict(moves[target]))
                longest.append(longest[at] + 1)
                link.append(link[target])
                link[target] = link[state] = copy
                while at >= 0 and moves[at].get(symbol) == target:
                    moves[at][symbol] = copy
                    at = link[at]
        last = state
    return moves


def letter_classes(texts: list[str]) -> np.ndarray:
    """Class of every code point: letters of the sample by lower case, other letters, marks, the rest."""
    classes = np.full(0x110000, SPACE, np.uint8)
    letters = [c for c in range(0x110000) if chr(c).isalpha()]
    classes[letters] = OTHER
    classes[[c for c in range(0x300, 0x10000) if unicodedata.category(chr(c)) == "Mn"]] = DROP
    counts: dict[str, int] = {}
    for text in texts:
        for c in text:
            if c.isalpha():
                low = c.lower()
                counts[low] = counts.get(low, 0) + 1
    known = sorted(sorted(counts), key=counts.get, reverse=True)[: DROP - 2]  # the commonest, if over 253
    number = {c: i + 2 for i, c in enumerate(known)}
    for c in letters:
        if (low := chr(c).lower()) in number:
            classes[c] = number[low]
    return classes


class CrossParser:
    """Automata of all languages; picklable, so that it can be broadcast."""

    def __init__(self, texts: dict[str, list[str]], total_chars: int):
        self.languages = sorted(texts)
        self.classes = letter_classes([t for part in texts.values() for t in part])
        self.width = int(self.classes[self.classes < DROP].max()) + 2  # the last class pads blocks
        self.tables, self.bits = [], []
        share = total_chars // max(1, len(texts))
        for language in self.languages:
            each = max(1, share // max(1, len(texts[language])))
            symbols: list[int] = []
            rest = [self.symbols([t])[0] for t in texts[language]]
            for part in [s[:each] for s in rest] + [s[each:] for s in rest]:
                symbols += [SPACE, *part[: max(0, share - len(symbols))].tolist()]
            self.tables.append(self.table(suffix_automaton(symbols)))
            self.bits.append(np.log2(len(symbols) + 1))

    def table(self, moves: list[dict[int, int]]) -> np.ndarray:
        """Entry [state, class]: the next state times the width, plus PHRASE for each phrase ended."""
        width = self.width
        first = np.zeros(width, np.int32)
        for symbol, target in moves[0].items():
            first[symbol] = target * width
        table = np.tile(first | PHRASE, (len(moves), 1))
        # A character that the language lacks ends the phrase before it and is one of its own.
        table[:, first == 0] = np.where(np.arange(len(moves))[:, None] > 0, 2 * PHRASE, PHRASE)
        # Padding ends what phrase there is.
        table[:, width - 1] = np.where(np.arange(len(moves)) > 0, PHRASE, 0)
        states = np.repeat(np.arange(len(moves)), [len(m) for m in moves])
        symbols = np.fromiter((s for m in moves for s in m), np.int64, len(states))
        table[states, symbols] = np.fromiter((t for m in moves for t in m.values()), np.int64, len(states)) * width
        return table.astype(np.int32).ravel()

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Classes of the texts without marks and repeated gaps, their offsets, their letter counts."""
        points, offsets = code_points(texts)
        found = self.classes[points]
        letters = totals((found != SPACE) & (found != DROP), offsets)
        kept = found != DROP
        kept[1:] &= (found[1:] != SPACE) | (found[:-1] != SPACE)
        starts = offsets[:-1][offsets[:-1] < len(found)]
        kept[starts] |= found[starts] == SPACE
        return found[kept], np.concatenate([[0], np.cumsum(totals(kept, offsets))]), letters

    def predict(self, texts: list[str | None]) -> dict[str, list]:
        symbols, offsets, letters = self.symbols([t or "" for t in texts])
        lengths = np.diff(offsets)
        if not self.languages:
            return {"lang_pred": ["und"] * len(texts), "score": np.zeros(len(texts))}
        # Blocks as columns, so that one row holds the same position of all blocks.
        blocks = -(-lengths // BLOCK)
        starts = np.concatenate([[0], np.cumsum(blocks)])
        row_of = np.repeat(np.arange(len(texts)), lengths)
        within = np.arange(len(symbols)) - offsets[row_of]
        padded = np.full((BLOCK, int(starts[-1])), self.width - 1, np.int32)
        padded[within % BLOCK, starts[row_of] + within // BLOCK] = symbols
        bits = np.zeros((len(self.languages), len(texts)))
        for i, table in enumerate(self.tables):
            state = np.zeros(padded.shape[1], np.int32)
            phrases = np.zeros(padded.shape[1], np.int32)
            for row in padded:
                state += row
                entry = table.take(state)
                phrases += entry >> 28
                state = entry & (PHRASE - 1)
            bits[i] = totals(phrases + (state > 0), starts) * self.bits[i] / np.maximum(lengths, 1)
        best = bits.argmin(axis=0)
        score = 1 / np.exp2(-EVIDENCE * (bits - bits.min(axis=0))).sum(axis=0)
        known = letters > 0
        return {
            "lang_pred": [self.languages[b] if k else "und" for b, k in zip(best, known)],
            "score": np.where(known, score, 0.0),
        }


def train(
    docs: DataFrame,
    rows: int = 200,
    total_chars: int = 131_072,
    key: str = "doc_id",
    text: str = "text",
    label: str = "lang",
) -> CrossParser:
    """Automata from at most ``rows`` labelled documents a language and ``total_chars`` characters of
    them over all languages, in equal shares.  These two bound what the driver gathers."""
    texts: dict[str, list[str]] = {}
    given = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(label).alias("label"))
    chosen = sample(given, rows).select("label", F.substring("text", 1, total_chars).alias("start"), "key")
    for language, start, _ in chosen.orderBy("label", F.xxhash64("key"), "key", "start").toLocalIterator():
        if len(texts.setdefault(language, [])) < rows:  # keys may repeat
            texts[language].append(start)
    return CrossParser(texts, total_chars)


def identify(docs: DataFrame, model: CrossParser, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``key, lang_pred, score``.

    ``und`` with score 0 if the text is null or holds no letter, and everywhere if nothing was
    learned.  Languages that need equally many bits rank by name.  The score is the winner's share
    of ``2 ** (-EVIDENCE * bits per character)`` over all languages.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, lambda texts: shared.value.predict(texts), "lang_pred string, score double", key, text)


def keep_known(docs: DataFrame, model: CrossParser, text: str = "text") -> DataFrame:
    """The rows whose language the model can tell, with all their columns."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches):
        for batch in slices(batches, text):
            found = shared.value.predict(batch.column(at).to_pylist())["lang_pred"]
            yield batch.filter(pa.array([language != "und" for language in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
