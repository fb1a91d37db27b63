"""Spelling variants by finite-state composition.

The vocabulary, as an acceptor A, is composed with a transducer E that makes exactly one edit and with
A again: A o E o A accepts the pairs of words that differ by one inserted, deleted or replaced code
point.

1. One pass over the texts counts words; tasks add up what they see before the shuffle.
2. The composition is cut by its initial states.  A word's state is its shortest beginning that at
   most ``state_words`` words share.  Pairs that agree in that beginning have one state, and a task
   composes the minimised acceptor of the rest of its words: on the diagonal, where both words have
   read the same, every edit of E is tried, and behind the edit both sides must go on alike, which is
   an intersection of two states of one acceptor, known at once where the states are the same.
3. Pairs whose edit lies inside the shared beginnings, on the few letters above the states, are
   composed by Spark: behind the edit both sides are read whole, so such pairs meet on the word
   without the edited letter, at most one word for each letter.

No task gets more than ``state_words`` words of a state.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapescreen.llm.batches import bound_batches, slices
from shapescreen.sources.store import stage

#: Distinct words that a task holds before it hands its counts on, and bytes of a text it splits at once.
HELD, PIECE = 200_000, 1 << 20
#: Ends a word inside a state's name.
END = "\0"


def _letters() -> bytes:
    """Latin-1 bytes of words, with A-Z in lower case; all others divide words."""
    table = bytearray(b" " * 256)
    for c in range(256):
        if chr(c).isascii() and chr(c).isalpha() or c >= 0xC0:
            table[c] = c + 32 if 65 <= c <= 90 else c
    return bytes(table)


LETTERS = _letters()


def counted(text: str) -> Counter:
    """How often each run of letters occurs in a text, as Latin-1 bytes."""
    raw = text.encode("latin-1", "replace").translate(LETTERS)
    found, start = Counter(), 0
    while start < len(raw):
        end = raw.find(b" ", start + PIECE)
        end = len(raw) if end < 0 else end
        found.update(raw[start:end].split())
        start = end
    return found


def vocabulary(
    docs: DataFrame,
    shortest: int = 6,
    least: int = 5,
    slips: int | None = 199,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``word, n``: runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z in lower case.

    ``slips`` plants misspellings: with h, the crc32 of ``<key>:<run>``, a run whose h is divisible
    by ``slips`` loses its code point h % length (a null key counts as "null").  Words of at least
    ``shortest`` code points that occur ``least`` times are returned.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()

        def out() -> pa.RecordBatch:
            names = [w.decode("latin-1") for w in words]
            return pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"]
            )

        for batch in slices(batches):
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not body:
                    continue
                base = crc32(f"{'null' if name is None else name}:".encode())
                for w, n in counted(body).items():
                    if len(w) < shortest:
                        continue
                    if slips:
                        h = crc32(w if w.isascii() else w.decode("latin-1").encode(), base)
                        if h % slips == 0:
                            at = h % len(w)
                            w = w[:at] + w[at + 1 :]
                            if len(w) < shortest:
                                continue
                    words[w] += n
            if len(words) > HELD:
                yield out()
                words = Counter()
        if words:
            yield out()

    read = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return read.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def acceptor(words: list[str]) -> tuple[list[dict[str, int]], list[bool], int]:
    """Minimised acceptor of sorted distinct words: moves and finality by state, and the start.

    States are made final from the end of the last word upwards, and one that equals a known state is
    replaced by it, so no two states accept the same endings.
    """
    moves: list[dict[str, int]] = []
    final: list[bool] = []
    known: dict[tuple, int] = {}
    # The path of the last word: letters and, per node, moves so far and finality.
    path: list[tuple[dict[str, int], list[bool]]] = [({}, [False])]
    last = ""

    def settle(depth: int) -> None:
        while len(path) > depth + 1:
            own, ends = path.pop()
            name = (ends[0], *own.items())
            state = known.get(name)
            if state is None:
                state = known[name] = len(moves)
                moves.append(own)
                final.append(ends[0])
            path[-1][0][last[len(path) - 1]] = state

    for word in words:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        settle(common)
        path += [({}, [False]) for _ in word[common:]]
        path[-1][1][0] = True
        last = word
    settle(0)
    moves.append(path[0][0])
    final.append(path[0][1][0])
    return moves, final, len(moves) - 1


def composed(words: list[str], before: str = "") -> Iterator[tuple[int, int]]:
    """Places of the pairs of sorted distinct words that differ by one edit, each pair once.

    A state knows how many words it accepts, so a path through the acceptor gives the place of its
    word without spelling it.  A letter is inserted only where it differs from the letter before it
    (``before`` for the first), the first of the places that give the same word.
    """
    moves, final, start = acceptor(words)
    many: list[int] = []
    # By state: for each letter the next state and how many accepted words sort before it.
    onward: list[dict[str, tuple[int, int]]] = []
    for own, ends in zip(moves, final):
        so_far, steps = int(ends), {}
        for c in sorted(own):
            steps[c] = own[c], so_far
            so_far += many[own[c]]
        onward.append(steps)
        many.append(so_far)
    known: dict[tuple[int, int], bool] = {}

    def meet(p: int, q: int) -> bool:
        """Whether some ending is accepted from both states."""
        waiting = [(p, q)]
        while waiting:
            pair = waiting[-1]
            found = known.get(pair)
            if found is None:
                x, y = pair
                found = x == y or final[x] and final[y]
                if not found:
                    nexts = [(moves[x][c], moves[y][c]) for c in moves[x].keys() & moves[y].keys()]
                    found = any(known.get(n) for n in nexts)
                    unknown = None if found else next((n for n in nexts if n not in known), None)
                    if unknown:
                        waiting.append(unknown)
                        continue
                known[pair] = found
            waiting.pop()
        return known[p, q]

    def common(p: int, q: int, i: int, j: int) -> Iterator[tuple[int, int]]:
        """Places of the words that go on alike from both states, whose first words have places i and j."""
        waiting = [(p, q, i, j)] if meet(p, q) else []
        while waiting:
            p, q, i, j = waiting.pop()
            if p == q:
                for k in range(many[p]):
                    yield i + k, j + k
                continue
            if final[p] and final[q]:
                yield i, j
            for c in onward[p].keys() & onward[q].keys():
                (x, dx), (y, dy) = onward[p][c], onward[q][c]
                if meet(x, y):
                    waiting.append((x, y, i + dx, j + dy))

    diagonal = [(start, 0, before)]
    while diagonal:
        state, first, previous = diagonal.pop()
        letters = [(c, s, first + d) for c, (s, d) in onward[state].items()]
        for n, (a, p, i) in enumerate(letters):
            diagonal.append((p, i, a))
            for _, q, j in letters[n + 1 :]:
                yield from common(p, q, i, j)
            if a != previous:
                yield from common(state, p, first, i)


def states(words: DataFrame, state_words: int) -> DataFrame:
    """``word, n, depth, state``: the shortest beginning, of ``depth`` letters, of at most ``state_words``
    words.  A word that ends before its beginning is that short has END for a last letter."""
    found = words.withColumns({"depth": F.lit(0), "state": F.lit("")})
    while True:
        full = found.groupBy("state").count().filter(F.col("count") > state_words).select("state", F.lit(1).alias("deeper"))
        full = stage(full, "full-states")
        if full.isEmpty():
            return found
        deeper = F.col("depth") + F.coalesce("deeper", F.lit(0))
        found = stage(
            found.join(full, "state", "left").select(
                "word", "n", deeper.alias("depth"), F.substring(F.concat("word", F.lit(END)), F.lit(1), deeper).alias("state")
            ),
            "word-states",
        )


def near_words(words: DataFrame, state_words: int = 10_000) -> DataFrame:
    """``word, near, near_n`` for distinct words ``word, n``: both directions of every pair."""
    placed = states(words, state_words)

    def inside(group: pa.Table) -> pa.Table:
        depth, state = group.column("depth")[0].as_py(), group.column("state")[0].as_py()
        counts = dict(zip(group.column("word").to_pylist(), group.column("n").to_pylist()))
        # Letters of a state's name are read already; a word that ended in it has no rest.
        rests = sorted(w[depth:] for w in counts)
        head = state.removesuffix(END)
        names = pa.array([head + r for r in rests], pa.string())
        pairs = np.array(list(composed(rests, state[-1:])), np.int64).reshape(-1, 2)
        pairs = np.concatenate([pairs, pairs[:, ::-1]])
        many = np.array([counts[name] for name in names.to_pylist()], np.int64)
        return pa.table(
            {"word": names.take(pa.array(pairs[:, 0])), "near": names.take(pa.array(pairs[:, 1])), "near_n": many[pairs[:, 1]]}
        )

    below = placed.groupBy("state").applyInArrow(inside, "word string, near string, near_n long")
    # Above the states: a word without its letter `at`, and whole, as the shorter word of a pair.
    edits = placed.filter("depth > 0").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("depth") - 1)))
    letter = F.substring("word", F.col("at") + 1, F.lit(1))
    without = F.concat(F.substring("word", F.lit(1), F.col("at")), F.substring("word", F.col("at") + 2, F.length("word")))
    first = (F.col("at") == 0) | (letter != F.substring("word", F.col("at"), F.lit(1)))
    one = lambda letter, inserted: F.struct(F.col("word"), F.col("n"), letter.alias("letter"), inserted.alias("inserted"))
    gaps = edits.filter(F.col("at") < F.length("word")).select("at", without.alias("rest"), one(letter, first).alias("w"))
    wholes = edits.select("at", F.col("word").alias("rest"), one(F.lit(""), F.lit(True)).alias("w"))
    met = gaps.unionByName(wholes).groupBy("at", "rest").agg(F.collect_list("w").alias("words")).filter(F.size("words") > 1)
    above = (
        met.select("words", F.explode("words").alias("x"))
        .select("x", F.explode("words").alias("y"))
        .filter(
            (F.col("x.letter") != F.col("y.letter"))
            & ((F.col("x.letter") != "") | F.col("y.inserted"))
            & ((F.col("y.letter") != "") | F.col("x.inserted"))
        )
        .select(F.col("x.word").alias("word"), F.col("y.word").alias("near"), F.col("y.n").alias("near_n"))
    )
    return below.unionByName(above)


def group_variants(words: DataFrame, times: int = 5, state_words: int = 10_000) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for distinct words ``word, n``.

    A word's form is its near word of largest n (ties: the first in code-point order), if that n is
    at least ``times`` its own.  ``root`` follows forms to the last; their n grow by that factor, so
    there are few steps and no rings.  No words give no rows.
    """
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    known = near_words(words, state_words).groupBy("word").agg(best, F.count("*").alias("n_near"))
    large = -F.col("best.less") >= times * F.col("n")
    found = stage(
        words.join(known, "word", "left").select(
            "word",
            F.when(large, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(large, -F.col("best.less")).alias("form_n"),
        ),
        "variants",
    )
    # Every round doubles the steps that a root is away.
    roots = found.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = stage(roots.join(further, "root", "left"), "roots")
        roots = moved.select("word", F.coalesce("further", "root").alias("root"))
        if moved.filter("further is not null").isEmpty():
            break
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def variants(docs: DataFrame, state_words: int = 10_000, key: str = "doc_id", text: str = "text", **counting) -> DataFrame:
    """Spelling variants of the words of whole texts; null and empty texts have none, repeated rows
    count again, an empty table gives no rows, other columns are not looked at."""
    words = stage(vocabulary(docs, key=key, text=text, **counting), "vocabulary")
    return group_variants(words, state_words=state_words)
