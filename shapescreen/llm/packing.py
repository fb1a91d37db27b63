"""Packing documents into sequences: best fit, then a local search by exchanges.

Tokens are counted where the text lies; only narrow rows (document, piece, length) travel.  Pieces
of full length are sequences already.  The others are dealt evenly, by hash, to cells of about
``cell_pieces``; a cell is packed alone by best fit in order of falling length.  Then moves,
one-for-one and two-for-one exchanges empty the least filled sequences: each shifts tokens into a
fuller sequence, so the sum of squared fills grows, which ends the search.  Sequences that stay
loose are taken apart and dealt anew to as many cells as their own pieces need, again and again as
long as that leaves fewer sequences and there is more than one cell to mix.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shapescreen.llm.batches import bound_batches, slices
from shapescreen.llm.pretokens import Pieces, Vocabulary, printed_bytes, starts_with_spaces
from shapescreen.sources.store import stage

#: Sequences under this share of the capacity are packed again with those of other cells.
LOOSE = 0.95
#: Slots, as a power of two, of the pieces a worker remembers; half of them are used, some 20 MB with the ids.
VOCABULARY_BITS = 19


def by_rank(definition: str) -> tiktoken.Encoding | None:
    """An encoder of single pieces by the same merges, which spares the offsets that ``tokenizers``
    keeps.  It needs merged tokens numbered in the order of the merges; else there is none."""
    model = json.loads(definition)["model"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merged = [model["vocab"].get(a + b, -1) for a, b in pairs]
    if merged != list(range(256, 256 + len(merged))) or len(model["vocab"]) != 256 + len(merged):
        return None
    printed = printed_bytes()
    ranks = {bytes(printed[c] for c in token): n for token, n in model["vocab"].items()}
    return tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})


class ByteTokens:
    """Token ids of texts by a byte-level tokenizer; pieces are tokenised once a worker."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
        self.tokenizer = Tokenizer.from_str(definition)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces = by_rank(definition)
        self.words = Vocabulary(self._make, self._forget, VOCABULARY_BITS)

    def _forget(self) -> None:
        self.flat, self.filled = np.zeros(1 << 16, np.uint32), 0
        self.offsets = np.zeros(1, np.int64)

    def _make(self, words: list[str]) -> None:
        if self.pieces:
            found = [self.pieces.encode_ordinary(w) for w in words]
        else:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        filled = self.filled + int(lengths.sum())
        if filled > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(filled, np.uint32)])
        self.flat[self.filled : filled] = np.fromiter(chain.from_iterable(found), np.uint32, filled - self.filled)
        self.offsets = np.concatenate([self.offsets, self.filled + np.cumsum(lengths)])
        self.filled = filled

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the n + 1 offsets of the texts in it."""
        # A special token's own string is rare and ends pieces by other rules.
        odd = {i for i, t in enumerate(texts) if any(s in t for s in self.special)}
        pieces = Pieces([t if i not in odd else "" for i, t in enumerate(texts)], starts_with_spaces)
        at = self.words.numbers_of(pieces)
        starts = self.offsets[at]
        lengths = self.offsets[at + 1] - starts
        ends = np.cumsum(lengths)
        starts -= ends - lengths
        ids = self.flat[np.arange(int(lengths.sum())) + np.repeat(starts, lengths)]
        offsets = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(pieces.counts)])]
        if odd:
            each = [ids[offsets[i] : offsets[i + 1]] for i in range(len(texts))]
            for i in odd:
                each[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32)
            ids = np.concatenate(each)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in each])])
        return ids, offsets


_tokens: dict[str, ByteTokens] = {}


def tokens_of(definition: str) -> ByteTokens:
    """The tokenizer of a definition, kept by the worker from task to task."""
    if definition not in _tokens:
        _tokens[definition] = ByteTokens(definition)
    return _tokens[definition]


def cut(length: int, capacity: int) -> list[int]:
    """Starts of the pieces of a document, and its end; all pieces but the first are full."""
    first = length % capacity or capacity
    return [0, *range(first, length + 1, capacity)]


def token_pieces(docs: DataFrame, definition: str, capacity: int, end_id: int, key: str, text: str) -> DataFrame:
    """One row per piece: ``key, piece, start, length, ids_crc32``."""
    kind = docs.schema[key].dataType.simpleString()
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(definition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(shared.value)
        for batch in slices(batches):
            ids, offsets = tokens.ids([t or "" for t in batch.column(1).to_pylist()])
            rows, pieces, starts, lengths, sums = [], [], [], [], []
            for row in range(batch.num_rows):
                own = np.append(ids[offsets[row] : offsets[row + 1]], np.uint32(end_id)).astype("<u4")
                edges = cut(len(own), capacity)
                for n, (a, b) in enumerate(zip(edges, edges[1:])):
                    rows.append(row)
                    pieces.append(n)
                    starts.append(a)
                    lengths.append(b - a)
                    sums.append(zlib.crc32(own[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(pieces, pa.int32()),
                    *(pa.array(x, pa.int64()) for x in (starts, lengths, sums)),
                ],
                [key, "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col(key), F.col(text).alias("text")).mapInArrow(
        run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long"
    )


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Items by bin: longest first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by room left
    rooms: list[int] = []  # sorted rooms for which there are bins
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        size = lengths[item]
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            b = with_room[room].pop()
            if not with_room[room]:
                rooms.pop(at)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(item)
        left = room - size
        if left:
            if not with_room[left]:
                insort(rooms, left)
            with_room[left].append(b)
    return bins


class Pairs:
    """Pairs of documents that share an underfull bin, for two-for-one exchanges.

    Pairs of equal lengths are alike, so a bin keeps one for each pair of lengths: at most a few
    thousand, since different lengths add up to the capacity soon.
    """

    def __init__(self, lengths: list[int]):
        self.lengths = lengths
        self.rows = np.zeros((4, 1024), np.int64)  # sum (0: gone), bin, one item, the other
        self.used = 0
        self.places: dict[int, slice] = {}

    def update(self, number: int, items: list[int]) -> None:
        """Replace the pairs of a bin."""
        if number in self.places:
            self.rows[0, self.places.pop(number)] = 0
        of_length: dict[int, list[int]] = {}
        for i in items:
            if len(same := of_length.setdefault(self.lengths[i], [])) < 2:
                same.append(i)
        kept = [i for same in of_length.values() for i in same]
        found = [
            (self.lengths[x] + self.lengths[y], number, x, y)
            for n, x in enumerate(kept)
            for y in kept[:n]
        ]
        if not found:
            return
        if self.used + len(found) > self.rows.shape[1]:
            live = self.rows[:, : self.used]
            live = live[:, live[0] > 0]
            self.rows = np.zeros((4, 2 * (live.shape[1] + len(found))), np.int64)
            self.rows[:, : live.shape[1]] = live
            self.used = live.shape[1]
            edges = np.flatnonzero(np.diff(live[1], prepend=-1, append=-1))
            self.places = {int(live[1, a]): slice(int(a), int(b)) for a, b in zip(edges, edges[1:])}
        place = slice(self.used, self.used + len(found))
        self.rows[:, place] = np.array(found).T
        self.places[number] = place
        self.used = place.stop

    def best(self, size: int, room: np.ndarray) -> tuple[int, int, int]:
        """The largest gain by giving ``size`` for a pair, and the pair; gain 0 if there is none."""
        sums, bins = self.rows[0, : self.used], self.rows[1, : self.used]
        gain = size - sums
        gain = np.where((sums > 0) & (gain > 0) & (gain <= room[bins]), gain, 0)
        if not len(gain) or not gain.max():
            return 0, -1, -1
        at = int(gain.argmax())
        return int(gain[at]), int(self.rows[2, at]), int(self.rows[3, at])


def exchange(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Empty bins by moves and exchanges between underfull ones while the squared fill grows.

    The least filled bin gives its items away: to the fullest bin with room, or for one or two
    shorter items of a fuller bin, by the largest gain.  A bin that nothing improves is left alone.
    The search ends when no bin is left to try or when the tokens need all bins that remain.
    """
    sizes = np.array(lengths, np.int64)
    least = -(-int(sizes.sum()) // capacity)
    if len(bins) <= least:
        return bins
    fill = np.array([sum(lengths[i] for i in b) for b in bins], np.int64)
    bin_of = np.full(len(lengths), -1, np.int64)
    pairs = Pairs(lengths)
    for b in np.flatnonzero(fill < capacity).tolist():
        bin_of[bins[b]] = b
        pairs.update(b, bins[b])
    items = np.flatnonzero(bin_of >= 0)
    alive = len(bins)
    waiting = fill < capacity

    def put(given: list[int], old: int, new: int, taken: list[int]) -> None:
        for moved, source, target in ((given, old, new), (taken, new, old)):
            for i in moved:
                bins[source].remove(i)
                bins[target].append(i)
                bin_of[i] = target
        shift = int(sizes[given].sum() - sizes[taken].sum())
        fill[old] -= shift
        fill[new] += shift
        pairs.update(old, bins[old])
        pairs.update(new, bins[new])

    while alive > least and waiting.any():
        source = int(np.argmin(np.where(waiting, fill, capacity + 1)))
        waiting[source] = False
        improved = True
        while improved and bins[source]:
            improved = False
            for item in sorted(bins[source], key=lambda i: -lengths[i]):
                size = lengths[item]
                # Only fuller bins, else the squared fill falls.
                room = np.where((fill >= max(1, fill[source])), capacity - fill, -1)
                room[source] = -1
                fits = np.flatnonzero(room >= size)
                if len(fits):
                    put([item], source, int(fits[np.argmin(room[fits])]), [])
                    improved = True
                    break
                gain = size - sizes[items]
                gain = np.where((gain > 0) & (gain <= room[bin_of[items]]), gain, 0)
                single = int(gain.argmax())
                double, x, y = pairs.best(size, room)
                if gain[single] > 0 and gain[single] >= double:
                    put([item], source, int(bin_of[items[single]]), [int(items[single])])
                elif double:
                    put([item], source, int(bin_of[x]), [x, y])
                else:
                    continue
                improved = True
                break
        alive -= not bins[source]
    return [b for b in bins if b]


def pack_cells(pieces: DataFrame, cells: int, capacity: int, base: int, deal: int = 0) -> DataFrame:
    """Pack the pieces of each cell, which are dealt otherwise for every ``deal``; adds
    ``sequence_id, offset, fill``.  Sequences of cell n are numbered from ``base + n << 32``."""
    schema = pieces.schema
    fields = [f for f in schema.fields if f.name not in ("sequence_id", "offset", "fill")]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    names = [f.name for f in fields]

    def run(cell: tuple, group: pa.Table) -> pa.Table:
        group = group.select(names)
        lengths = group.column("length").to_pylist()
        bins = exchange(best_fit(lengths, capacity), lengths, capacity)
        order, sequence, offset, fill = [], [], [], []
        for n, items in enumerate(bins):
            at = 0
            for i in items:
                order.append(i)
                sequence.append((base + cell[0].as_py() << 32) + n)
                offset.append(at)
                at += lengths[i]
            fill += [at] * len(items)
        group = group.take(pa.array(order, pa.int64()))
        for name, values in (("sequence_id", sequence), ("offset", offset), ("fill", fill)):
            group = group.append_column(name, pa.array(values, pa.int64()))
        return group

    dealt = pieces.select(*names).withColumn("cell", F.pmod(F.xxhash64("row", F.lit(deal)), F.lit(cells)))
    return dealt.groupBy("cell").applyInArrow(run, f"{ddl}, sequence_id long, offset long, fill long")


def _counts(packed: DataFrame) -> tuple[int, int]:
    """Pieces and sequences of a packed table."""
    n, sequences = packed.agg(F.count("*"), F.sum((F.col("offset") == 0).cast("long"))).first()
    return n, sequences or 0


def pack(
    docs: DataFrame,
    definition: str,
    capacity: int = 2048,
    end_id: int = 0,
    cell_pieces: int = 32_768,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per piece: ``key, piece, start, length, ids_crc32, sequence_id, offset``.

    ``definition`` is the tokenizer's JSON.  Null text is empty: its one piece holds the end id.
    Rows that repeat a key are packed as documents of their own.  A document of exactly
    ``capacity`` ids is one piece.  An empty table gives no rows.  ``cell_pieces`` is the mean
    number of pieces that one call packs, in every pass; cells multiply with the pieces to pack.
    """
    pieces = stage(
        token_pieces(docs, definition, capacity, end_id, key, text).withColumn("row", F.monotonically_increasing_id()),
        "token-pieces",
    )
    part = pieces.filter(F.col("length") < capacity)
    cells = max(1, -(-part.count() // cell_pieces))
    packed = [stage(pack_cells(part, cells, capacity, 0), "packed-cells")]
    used, deal = cells, 0
    while True:
        under = packed[-1].filter(F.col("fill") < LOOSE * capacity)
        n, before = _counts(under)
        if before < 2:
            break
        cells, deal = -(-n // cell_pieces), deal + 1
        again = stage(pack_cells(under, cells, capacity, used, deal), "packed-again")
        used += cells
        if _counts(again)[1] >= before:
            break
        packed[-1] = packed[-1].filter(F.col("fill") >= LOOSE * capacity)
        packed.append(again)
        if cells == 1:
            break
    whole = pieces.filter(F.col("length") == capacity).select(
        *pieces.columns,
        (F.lit(1 << 62) + F.col("row")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        F.col("length").alias("fill"),
    )
    return reduce(DataFrame.unionByName, packed, whole).select(key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
