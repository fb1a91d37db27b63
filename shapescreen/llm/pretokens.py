"""Splitting texts into the pieces that byte-pair tokenizers merge within, many texts at once.

Texts are cut by comparing the character classes of neighbours, with NumPy, and each piece gets a
64-bit hash, so that work on a piece is done once for all its occurrences.
"""

from __future__ import annotations

import unicodedata

import numpy as np

from shapescreen.llm.batches import code_points

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3

# Unicode's White_Space characters above U+0020, and English contractions.
WIDE_SPACES = [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """Class of every code point; made once a process."""
    if not _classes:
        first = {"L": LETTER, "N": NUMBER}
        table = np.array([first.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
        table[[*range(9, 14), 32, *WIDE_SPACES]] = SPACE
        _classes.append(table)
    return _classes[0]


def printed_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1
    characters stand for themselves, the other bytes, in order, for those from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}


class Pieces:
    """Pieces of all texts: ``starts`` and ``ends`` in ``joined``; text i has ``counts[i]`` of them."""

    def __init__(self, texts: list[str], starts_of):
        self.joined = "".join(texts)
        self.points, offsets = code_points(texts)
        size = len(self.points)
        begins = np.zeros(size + 1, bool)
        begins[offsets] = True
        kinds = classes()[self.points]
        before = np.empty(size, np.uint8)
        before[1:] = kinds[:-1]
        before[begins[:-1]] = 255
        starts, gaps = starts_of(self.points, kinds, before, begins)
        self._contract(starts, kinds, begins)
        stops = np.append(starts | gaps, True)
        at = np.flatnonzero(stops)
        nexts = np.append(at[1:], size)
        first = starts[at[:-1]]
        self.starts, self.ends = at[:-1][first], nexts[:-1][first]
        upto = np.concatenate([[0], np.cumsum(starts)])
        self.counts = upto[offsets[1:]] - upto[offsets[:-1]]

    def _contract(self, starts, kinds, begins) -> None:
        """An apostrophe that begins a piece takes the letters of a contraction with it."""
        marks = np.flatnonzero(starts[:-1] & (self.points[:-1] == ord("'")) & (kinds[1:] == LETTER) & ~begins[1:-1])
        for i in marks.tolist():
            for letters in CONTRACTIONS:
                end = i + 1 + len(letters)
                if self.joined.startswith(letters, i + 1) and not begins[i + 1 : end].any():
                    starts[i + 1] = False
                    if end < len(starts) and kinds[end] == LETTER:
                        starts[end] = True
                    break

    def hashes(self) -> np.ndarray:
        return span_hashes(self.points, self.starts, self.ends)


def span_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the code points and the length of each span, never 0.

    A polynomial in an odd factor: running sums over the whole slice give every span's part,
    which the inverse factor's power brings to the span's own start.
    """
    powers, inverses = _powers(len(points) + 1)
    chars = points.astype(np.uint64)
    chars += np.uint64(1)
    chars *= np.uint64(0xBF58476D1CE4E5B9)
    chars ^= chars >> np.uint64(29)
    chars *= powers[: len(chars)]
    sums = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum(chars, out=sums[1:])
    found = (sums[ends] - sums[starts]) * inverses[starts]
    found ^= found >> np.uint64(32)
    found += (ends - starts).astype(np.uint64)
    found *= np.uint64(0x94D049BB133111EB)
    found[found == 0] = 1
    return found


_factor_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's factor and of its inverse modulo 2^64; kept by the process."""
    if not _factor_powers or len(_factor_powers[0][0]) < size:
        factor = 0x9E3779B97F4A7C15
        rows = []
        for base in (factor, pow(factor, -1, 1 << 64)):
            row = np.full(max(size, 1 << 20), base, np.uint64)
            row[0] = 1
            rows.append(np.cumprod(row, out=row))
        _factor_powers[:] = [tuple(rows)]
    return _factor_powers[0]


def starts_with_spaces(points, kinds, before, begins):
    """One space belongs to the letters, numbers or signs after it; other white space stands alone."""
    space = kinds == SPACE
    nexts_word = np.append(~space[1:], False) & ~begins[1:]
    after_blank = np.zeros(len(points), bool)
    after_blank[1:] = points[:-1] == 32
    after_blank &= ~begins[:-1]
    changed = kinds != before
    starts = np.where(space, changed | nexts_word, changed & ~after_blank)
    return starts, np.zeros(len(points), bool)


def starts_without_spaces(points, kinds, before, begins):
    """White space is dropped and every number character is a piece of its own."""
    space = kinds == SPACE
    return ~space & ((kinds != before) | (kinds == NUMBER)), space


class Vocabulary:
    """Numbers the pieces that a worker meets, by hash, in a table with open addressing.

    ``make(words)`` is called with new pieces in the order of their numbers; ``forget()`` when the
    table is half full and numbering begins again.
    """

    def __init__(self, make, forget, bits: int = 21):
        self.make, self.forget, self.bits = make, forget, bits
        self._clear()

    def _clear(self) -> None:
        self.size = 0
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.numbers = np.zeros(1 << self.bits, np.int32)
        self.forget()

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the hashes, -1 where unknown."""
        slots = self._slots(hashes)
        keys = self.keys[slots]
        found = np.where(keys == hashes, self.numbers[slots], -1)
        left = np.flatnonzero((keys != hashes) & (keys != 0))
        while len(left):
            slots[left] = (slots[left] + 1) & (len(self.keys) - 1)
            keys = self.keys[slots[left]]
            same = keys == hashes[left]
            found[left[same]] = self.numbers[slots[left[same]]]
            left = left[~same & (keys != 0)]
        return found

    def _add(self, hashes: np.ndarray) -> None:
        """Number new hashes, all different."""
        numbers = np.arange(self.size, self.size + len(hashes), dtype=np.int32)
        self.size += len(hashes)
        slots = self._slots(hashes)
        left = np.arange(len(hashes))
        while len(left):
            free = left[self.keys[slots[left]] == 0]
            _, first = np.unique(slots[free], return_index=True)
            placed = free[first]
            self.keys[slots[placed]] = hashes[placed]
            self.numbers[slots[placed]] = numbers[placed]
            waiting = np.ones(len(hashes), bool)
            waiting[placed] = False
            left = left[waiting[left]]
            slots[left] = (slots[left] + 1) & (len(self.keys) - 1)

    def numbers_of(self, pieces: Pieces) -> np.ndarray:
        """The number of every piece."""
        hashes = pieces.hashes()
        found = self._find(hashes)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new, first = np.unique(hashes[missing], return_index=True)
            if self.size + len(new) > len(self.keys) // 2:
                # One slice holds fewer pieces than the table: SLICE_BYTES or one text.
                self._clear()
                while len(hashes) > len(self.keys) // 2:
                    self.bits += 1
                    self._clear()
                missing = np.arange(len(hashes))
                new, first = np.unique(hashes, return_index=True)
            first = missing[first]
            starts, ends = pieces.starts[first].tolist(), pieces.ends[first].tolist()
            self._add(new)
            self.make([pieces.joined[a:b] for a, b in zip(starts, ends)])
            found[missing] = self._find(hashes[missing])
        return found
