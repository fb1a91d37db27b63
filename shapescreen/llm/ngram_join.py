"""Exact Jaccard join on word n-grams, rare-first, with prefix, length, positional and suffix filters.

1. A pass over the texts gives each document the size of its shingle set and a hash of the set.
   Equal sets are one set from here on.
2. A second pass sends every shingle hash, packed, to one of many ranges of hashes, where the number
   of sets that hold it is counted.  A shingle of one set can't link anything: it only counts as the
   rarest in its set's order.  The others go back to their sets.  Shingles that alone would fill a
   part of a range are broadcast and skip the ranges, so no range is hot: those with over
   ``1 / SHARES`` of all occurrences are told by the counts of all slices; where ranges are so many
   that rarer ones matter too, they are told by all counts of a sample of about ``SAMPLE``
   occurrences.  That only decides a shingle's rank in the order, never the result.
3. A set orders its shingles rare-first and posts its prefix: two sets with a Jaccard index of at
   least t share a shingle of their prefixes of ``n - ceil(t * n) + 1``.  A set whose unique
   shingles fill its prefix has no partner and is done.
4. In each posting list, split by bands of set size, all members are compared with two centres.
   Links contract lists: members that are connected already need no further comparison.  In lists
   that still hold several components, the members outside the largest one meet all members of
   other components.  A list of many near copies thus costs little more than its length, and no
   link between components is missed.
5. Candidates pass the length, positional and suffix filters and are verified once, by counting
   common shingles.

Only links that can't change the components are left out: the result is one component per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapescreen.llm import drops
from shapescreen.llm.batches import bound_batches, code_points, free_names, slices
from shapescreen.llm.components import components, salted_join
from shapescreen.llm.pretokens import span_hashes
from shapescreen.sources.store import discard, stage

#: Shingle occurrences counted in one range, and the least number of ranges.
RANGE_SIZE, RANGES = 2_000_000, 96
#: Shares above 1 / (HEAVY * ranges) of all occurrences count as heavy.
HEAVY = 4
#: Slices tell shares above 1 / SHARES; smaller ones are told by a sample, by so many occurrences at least.
SHARES, SAMPLE, TOLD = 3072, 50_000_000, 8
#: Groups of copies with over this share of the documents are told to the second pass.
COPIES = 0.001
#: Parts of the suffix filter, a power of two.
PARTS = 32
#: Rank of heavy shingles in the order; counts of others stay below.
MOST = (1 << 31) - 1


def shingle_sets(texts: list[str], words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted within a text, and the n + 1 offsets."""
    points, offsets = code_points(texts)
    points = np.where((points >= 65) & (points <= 90), points + np.uint32(32), points)
    gap = (points == 32) | ((points >= 9) & (points <= 13))
    begins = np.zeros(len(points) + 1, bool)
    begins[offsets] = True
    before = np.ones(len(points) + 1, bool)
    before[1:] = gap
    before |= begins
    after = np.ones(len(points) + 1, bool)
    after[:-1] = gap
    after |= begins
    starts = np.flatnonzero(~gap & before[:-1])
    ends = np.flatnonzero(~gap & after[1:]) + 1
    text_of = np.searchsorted(offsets, starts, "right") - 1
    count = np.bincount(text_of, minlength=len(texts))
    hashes = np.zeros(len(starts) + words, np.uint64)
    hashes[: len(starts)] = span_hashes(points, starts, ends)
    # Odd multipliers tell the places of a shingle apart; a text of few words is one shingle of them all.
    place = np.cumprod(np.full(words + 1, 0xD1342543DE82EF95, np.uint64))
    full = np.zeros(len(starts), np.uint64)
    size = np.minimum(count, words)[text_of]
    for k in range(words):
        full += np.where(k < size, hashes[k : k + len(starts)] * place[k], np.uint64(0))
    full += size.astype(np.uint64) * place[words]
    nth = np.arange(len(starts)) - (np.cumsum(count) - count)[text_of]
    valid = nth + size <= count[text_of]
    full, text_of = full[valid], text_of[valid]
    full ^= full >> np.uint64(31)
    full *= np.uint64(0x9FB21C651E98DF25)
    full ^= full >> np.uint64(28)
    order = np.argsort(full)
    order = order[np.argsort(text_of[order].astype(np.uint16 if len(texts) < 65536 else np.int64), kind="stable")]
    full, text_of = full[order], text_of[order]
    new = np.ones(len(full), bool)
    new[1:] = (full[1:] != full[:-1]) | (text_of[1:] != text_of[:-1])
    sizes = np.bincount(text_of[new], minlength=len(texts))
    return full[new], np.concatenate([[0], np.cumsum(sizes)])


def set_ids(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    mixed = hashes * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed ^= mixed >> np.uint64(33)
    mixed *= np.uint64(0x165667B19E3779F9)
    run = np.zeros(len(mixed) + 1, np.uint64)
    np.cumsum(mixed, out=run[1:])
    found = run[offsets[1:]] - run[offsets[:-1]] + np.diff(offsets).astype(np.uint64)
    found ^= found >> np.uint64(29)
    found *= np.uint64(0x94D049BB133111EB)
    return (found ^ (found >> np.uint64(32))).view(np.int64)


def measured(docs: DataFrame, words: int, share: int | None, key: str, text: str) -> DataFrame:
    """``key, n, sid`` of every document, and (``heavy``) the frequent shingles of every slice with
    their counts as ``sid, n``: those with over 1 / share of the slice's occurrences, or all."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, offsets = shingle_sets([t or "" for t in batch.column(1).to_pylist()], words)
            sids, sizes = set_ids(hashes, offsets), np.diff(offsets)
            _, first = np.unique(sids, return_index=True)
            once = np.zeros(len(sids), bool)
            once[first] = True
            own = hashes[np.repeat(once, sizes)]
            names, counts = np.unique(own, return_counts=True)
            heavy = counts > (max(1, len(own) // share) if share else 0)
            keys = pa.concat_arrays([batch.column(0), pa.nulls(int(heavy.sum()), batch.column(0).type)])
            yield pa.RecordBatch.from_arrays(
                [
                    keys,
                    pa.array(np.concatenate([sizes, counts[heavy]]).astype(np.int64)),
                    pa.array(np.concatenate([sids, names[heavy].view(np.int64)])),
                    pa.array(np.arange(len(keys)) >= len(sids)),
                ],
                [key, "n", "sid", "heavy"],
            )

    return docs.select(F.col(key), F.col(text).alias("text")).mapInArrow(
        run, f"`{key}` {kind}, n long, sid long, heavy boolean"
    )


def low_bytes(hashes: np.ndarray) -> bytes:
    """The lower six bytes of each hash."""
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def from_low_bytes(raw: bytes, lot: int) -> np.ndarray:
    """Hashes of one range from their lower six bytes, told apart from those of other ranges."""
    whole = np.zeros((len(raw) // 6, 8), np.uint8)
    whole[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return whole.view("<u8").ravel() | (np.uint64(lot & 0xFFFF) << np.uint64(48))


def packed_shingles(docs: DataFrame, words: int, ranges: int, heavy, copies, key: str, text: str) -> DataFrame:
    """Shingles of all sets, packed by range of hashes: set ids, set sizes, counts, hashes.

    Six bytes of a hash are enough beside its range.  Heavy shingles (sorted array) are packed
    apart, whole, in ranges of set ids.  ``copies``: the key that
    stands for each set with very many copies.
    """
    shared = docs.sparkSession.sparkContext.broadcast((heavy, copies))

    def rows(sids, sizes, hashes, counts, lot, common):
        """One row for each range; lots of the hashes ascend within a set."""
        set_of = np.repeat(np.arange(len(sids)), counts)
        order = np.argsort(lot, kind="stable")
        lot, set_of, hashes = lot[order], set_of[order], hashes[order]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(lot)) + 1, [len(lot)]])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if a < b:
                own, first = np.unique(set_of[a:b], return_index=True)
                yield {
                    "lot": int(lot[a]),
                    "common": common,
                    "sids": sids[own].tobytes(),
                    "sizes": sizes[own].astype("<i4").tobytes(),
                    "counts": np.diff(np.append(first, b - a)).astype("<i4").tobytes(),
                    "hashes": hashes[a:b].tobytes() if common else low_bytes(hashes[a:b]),
                }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, stays = shared.value
        hot = np.fromiter(stays, np.int64, len(stays))
        for batch in slices(batches):
            hashes, offsets = shingle_sets([t or "" for t in batch.column(1).to_pylist()], words)
            sids, sizes = set_ids(hashes, offsets), np.diff(offsets)
            _, first = np.unique(sids, return_index=True)
            kept = np.zeros(len(sids), bool)
            kept[first] = True
            for i in np.flatnonzero(np.isin(sids, hot)).tolist():
                kept[i] = batch.column(0)[i].as_py() == stays[int(sids[i])]
            hashes = hashes[np.repeat(kept, sizes)]
            sids, sizes = sids[kept], sizes[kept]
            frequent = np.zeros(len(hashes), bool)
            if len(common):
                frequent = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes
            run_of = np.repeat(np.arange(len(sids)), sizes)
            many = np.bincount(run_of[frequent], minlength=len(sids))
            found = []
            lot = ((hashes[~frequent] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
            found += rows(sids, sizes, hashes[~frequent], sizes - many, lot, False)
            if frequent.any():
                lot = np.repeat((sids.view(np.uint64) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32), many)
                found += rows(sids, sizes, hashes[frequent], many, lot.astype(np.int64), True)
            if found:
                yield pa.RecordBatch.from_pylist(found, PACKED)

    return docs.select(F.col(key), F.col(text).alias("text")).mapInArrow(
        run, "lot long, common boolean, sids binary, sizes binary, counts binary, hashes binary"
    )


PACKED = pa.schema(
    [
        ("lot", pa.int64()),
        ("common", pa.bool_()),
        *((name, pa.binary()) for name in ("sids", "sizes", "counts", "hashes")),
    ]
)


def shared_shingles(lot: pa.Table) -> pa.Table:
    """Of one range, the shingles that several sets hold: ``sid, n, df, h``."""
    parts = []
    for common in (False, True):
        own = lot.filter(pc.equal(lot.column("common"), common))
        raw = {c: b"".join(own.column(c).to_pylist()) for c in ("sids", "sizes", "counts", "hashes")}
        counts = np.frombuffer(raw["counts"], "<i4")
        sids = np.repeat(np.frombuffer(raw["sids"], np.int64), counts)
        sizes = np.repeat(np.frombuffer(raw["sizes"], "<i4"), counts)
        if common:
            hashes = np.frombuffer(raw["hashes"], np.uint64)
        else:
            hashes = from_low_bytes(raw["hashes"], own.column("lot")[0].as_py() if own.num_rows else 0)
        order = np.lexsort((sids, hashes))
        sids, sizes, hashes = sids[order], sizes[order], hashes[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (sids[1:] != sids[:-1])
        sids, sizes, hashes = sids[new], sizes[new], hashes[new]
        if common:
            df = np.full(len(hashes), MOST)
        else:
            starts = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, int)
            df = np.repeat(np.diff(np.append(starts, len(hashes))), np.diff(np.append(starts, len(hashes))))
        several = df > 1
        parts.append((sids[several], sizes[several], df[several], hashes[several].view(np.int64)))
    sids, sizes, df, hashes = (np.concatenate(x) for x in zip(*parts))
    return pa.table({"sid": sids, "n": sizes.astype(np.int32), "df": df.astype(np.int32), "h": hashes})


def enough(common, percent: int, x: str = "n_a", y: str = "n_b"):
    """100 * common >= percent * union."""
    return (100 + percent) * common >= percent * (F.col(x) + F.col(y))


def most_common(x: str, y: str):
    """Suffix filter: shingles fall into PARTS by hash, and no more are common than the smaller
    counts of each part add up to.  A set's unique shingles are not counted at all."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.least(a, b)), F.lit(0), lambda a, b: a + b)


def links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs ``a, b`` those that reach the threshold, by a full count of common shingles."""
    side = lambda c: sets.select(
        F.col("sid").alias(c), F.col("n").alias(f"n_{c}"), F.col("hashes").alias(f"hashes_{c}")
    )
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.filter(enough(F.size(F.array_intersect("hashes_a", "hashes_b")), percent)).select("a", "b")


def likely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs ``a, b`` those that pass the suffix filter."""
    side = lambda c: sets.select(
        F.col("sid").alias(c), F.col("n").alias(f"n_{c}"), F.col("parts").alias(f"parts_{c}")
    )
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.filter(enough(most_common("parts_a", "parts_b"), percent)).select("a", "b")


def near(percent: int, x: str, y: str):
    """Length and positional filter of two postings of one shingle."""
    n_x, n_y = F.col(f"{x}n"), F.col(f"{y}n")
    pos_x, pos_y = F.col(f"{x}pos"), F.col(f"{y}pos")
    most = F.least(pos_x, pos_y) + F.least(n_x - pos_x, n_y - pos_y)
    return (100 * F.least(n_x, n_y) >= percent * F.greatest(n_x, n_y)) & (
        (100 + percent) * most >= percent * (n_x + n_y)
    )


def heavy_shingles(docs, table, occurrences: int, ranges: int, words: int, key: str, text: str) -> np.ndarray:
    """Sorted hashes of the shingles with over 1 / (HEAVY * ranges) of all occurrences, and some near it.

    At most 2 * SHARES of them from the slices, and 2 * HEAVY * ranges or SAMPLE / TOLD from the sample.
    """
    told = lambda counts, least: counts.groupBy("sid").agg(F.sum("n").alias("n")).filter(F.col("n") > least).select("sid")
    names = told(table.filter("heavy"), occurrences / min(HEAVY * ranges, SHARES) / 2)
    if HEAVY * ranges > SHARES:
        nth = max(1, occurrences // SAMPLE)
        sample = docs.filter(F.pmod(F.xxhash64(text), F.lit(nth)) == 0)
        least = max(TOLD, occurrences / nth / (HEAVY * ranges))
        names = names.union(told(measured(sample, words, None, key, text).filter("heavy"), least)).distinct()
    found = names.toArrow().column("sid").to_numpy()
    return np.sort(found.astype(np.int64, copy=False).view(np.uint64))


def ordered(x, y):
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def cluster(
    docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per input row: ``key, n_shingles, component_id, sid, leads``.

    Documents link if ``100 * |A & B| >= percent * |A | B|`` for their sets of distinct word
    shingles; ``component_id`` is the smallest key that links reach.  Words are what white space
    divides, with A-Z in lower case; fewer than ``words`` of them are one shingle.  Null, empty and
    blank texts have no shingles and stand alone under their own key.  Rows that repeat a key or a
    text are linked like any other.  ``sid`` is a hash of the set (null: empty), and ``leads`` marks the
    set that has the component's smallest key.  A null key is reached but never the smallest, unless a
    component has no other.  Sets are compared by 64-bit hashes of their shingles.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    table = stage(measured(docs, words, SHARES, key, text), "shingle-counts")
    rows = table.filter(~F.col("heavy")).select(key, "n", "sid")
    sets = stage(
        rows.filter("n > 0").groupBy("sid", "n").agg(F.min(key).alias("first"), F.count("*").alias("copies")),
        "shingle-sets",
    )
    occurrences, documents = (x or 0 for x in sets.agg(F.sum("n"), F.sum("copies")).first())
    ranges = max(RANGES, -(-occurrences // RANGE_SIZE))
    common = heavy_shingles(docs, table, occurrences, ranges, words, key, text)
    hot = sets.filter(F.col("copies") > F.lit(max(1.0, COPIES * documents))).select("sid", "first")
    copies = {r[0]: r[1] for r in hot.collect()}  # at most 1 / COPIES

    entries = (
        packed_shingles(docs, words, ranges, common, copies, key, text)
        .groupBy("lot")
        .applyInArrow(shared_shingles, "sid long, n int, df int, h long")
    )
    own = (
        entries.groupBy("sid", "n")
        .agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("shared"))
        .withColumn("hashes", F.col("shared.h"))
        .withColumn("unique", F.col("n") - F.size("shared"))
        .withColumn("prefix", F.expr(f"n - ((n * {percent} + 99) div 100) + 1"))
        .filter("unique < prefix")
    )
    part = lambda number: F.size(F.filter("hashes", lambda h: h.bitwiseAND(PARTS - 1) == number))
    active = stage(
        own.select(
            "sid", "n", "unique", "prefix", "hashes", F.array(*(part(F.lit(i)) for i in range(PARTS))).alias("parts")
        ),
        "active-sets",
    )

    # Postings by size band; a set also shows itself in the band above its own.
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent * 1.01)))
    posts = stage(
        active.select(
            "sid",
            "n",
            F.posexplode(F.expr("slice(hashes, 1, int(prefix - unique))")).alias("at", "h"),
            "unique",
            band.alias("band"),
        )
        .withColumn("band", F.explode(F.array("band", F.col("band") + 1)))
        .select(
            "h", "band", "sid", "n", (F.col("unique") + F.col("at") + 1).alias("pos"), (F.col("band") == band).alias("own")
        ),
        "postings",
    )
    pick = lambda seed: F.min(
        F.when(F.col("own"), F.struct(F.xxhash64("sid", F.lit(seed)).alias("rank"), "sid", "n", "pos"))
    )
    centres = stage(
        posts.groupBy("h", "band")
        .agg(F.array(pick(1), pick(2)).alias("centres"), F.count("*").alias("size"))
        .filter((F.col("size") > 1) & F.col("centres")[0].isNotNull())
        .select("h", "band", "centres"),
        "centres",
    )
    stars = (
        posts.join(centres, ["h", "band"])
        .withColumn("c", F.explode("centres"))
        .select("sid", "n", "pos", F.col("c.sid").alias("c_sid"), F.col("c.n").alias("c_n"), F.col("c.pos").alias("c_pos"))
        .filter((F.col("sid") != F.col("c_sid")) & near(percent, "", "c_"))
        .select(*ordered("sid", "c_sid"))
        .distinct()
    )
    tried = stage(stars, "star-pairs")
    linked = stage(links(likely(tried, active, percent), active, percent), "star-links")

    labels = components(linked)
    bare = posts
    posts = stage(
        posts.join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn(
            "root", F.coalesce("root", "sid")
        ),
        "labelled-postings",
    )
    discard(bare, centres)
    by_root = posts.groupBy("h", "band", "root").agg(F.count("*").alias("size"), F.max("own").alias("own"))
    open_lists = stage(
        by_root.groupBy("h", "band")
        .agg(F.max(F.struct("size", "root"))["root"].alias("main"), F.count("*").alias("roots"), F.max("own").alias("own"))
        .filter("roots > 1 and own")
        .select("h", "band", "main"),
        "open-lists",
    )
    sketch = active.select("sid", "parts", F.expr("slice(hashes, 1, int(prefix - unique))").alias("posted"))
    left = stage(
        posts.join(open_lists, ["h", "band"]).withColumn("inner", F.col("root") == F.col("main")).join(sketch, "sid"),
        "open-postings",
    )
    columns = ("sid", "n", "pos", "own", "root", "inner", "parts", "posted")
    discard(posts, open_lists)
    x, y = (left.select("h", "band", *(F.col(c).alias(f"{side}_{c}") for c in columns)) for side in "xy")
    rest = (
        x.filter(~F.col("x_inner"))
        .join(y, ["h", "band"])
        .filter(
            (F.col("x_root") != F.col("y_root"))
            & (F.col("x_own") | F.col("y_own"))
            & (F.col("y_inner") | (F.col("x_sid") < F.col("y_sid")))
            & near(percent, "x_", "y_")
            & enough(most_common("x_parts", "y_parts"), percent, "x_n", "y_n")
            # A pair comes up once: at the rarest shingle that both have posted.
            & (F.get(F.array_intersect("x_posted", "y_posted"), F.lit(0)) == F.col("h"))
        )
        .select(*ordered("x_sid", "y_sid"))
        .join(tried, ["a", "b"], "left_anti")
    )
    others = stage(rest, "other-pairs")
    discard(left, tried)
    labels = components(linked.unionByName(links(others, active, percent)))
    discard(active, others, linked)

    rooted = stage(sets.join(labels.withColumnRenamed("node", "sid"), "sid", "left"), "rooted-sets")
    rank = F.struct(F.col("first").isNull().alias("last"), F.col("first").alias("low"), F.col("sid").alias("lead"))
    smallest = rooted.filter("root is not null").groupBy("root").agg(F.min(rank).alias("best"))
    named = stage(
        salted_join(rooted, smallest, "root", "left").select(
            "sid",
            F.coalesce("best.low", "first").alias("component_id"),
            F.coalesce(F.col("best.lead") == F.col("sid"), F.lit(True)).alias("leads"),
        ),
        "set-components",
    )
    columns = (key, F.col("n").alias("n_shingles"))
    found = rows.filter("n > 0").join(named, "sid").select(*columns, "component_id", "sid", "leads")
    alone = rows.filter("n = 0").select(
        *columns, F.col(key).alias("component_id"), F.lit(None).cast("long").alias("sid"), F.lit(True).alias("leads")
    )
    return found.unionByName(alone)


def with_set_ids(docs: DataFrame, name: str, words: int, text: str) -> DataFrame:
    """All columns and a hash of the shingle set, null where it is empty."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            hashes, offsets = shingle_sets([t or "" for t in texts], words)
            ids = pa.array(set_ids(hashes, offsets), mask=np.diff(offsets) == 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, name])

    return docs.mapInArrow(run, docs.withColumn(name, F.lit(None).cast("long")).schema)


def deduplicate(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, with all its columns: the one with the smallest key.

    Rows are told apart by key and set: a row whose key stands on another component's copy as well
    stays, and of rows that repeat both key and set one stays.  A null key is the largest.  Rows
    without shingles all stay.  Texts are shuffled only of rows that share a key, or its bit, with
    a dropped row.
    """
    own, other_key, other = free_names(docs, "sid", "other_key", "other_sid")
    found = cluster(docs, words, percent, key, text).filter("sid is not null")
    stays = F.col("leads") & F.col(key).eqNullSafe(F.col("component_id"))
    lots = stage(
        found.groupBy(F.col(key).alias(other_key), F.col("sid").alias(other))
        .agg(F.max(stays).alias("stays"), F.count("*").alias("times"))
        .filter(~F.col("stays") | (F.col("times") > 1)),
        "near-copies",
    )
    clean, rest = drops.split(docs, key, lots, other_key)
    # Both branches below read the few rows that may have to go.
    rest = stage(with_set_ids(rest, own, words, text), "maybe-copies")
    same = F.col(key).eqNullSafe(F.col(other_key)) & (F.col(own) == F.col(other))
    left = rest.join(lots.select(other_key, other), same, "left_anti")
    repeated = lots.filter("stays").select(other_key, other)
    if not repeated.isEmpty():
        left = left.unionByName(rest.join(repeated, same, "left_semi").dropDuplicates([key, own]))
    return clean.unionByName(left.drop(own))
