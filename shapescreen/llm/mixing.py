"""Mixing sources to target weights, by a multivariate-hypergeometric splitting tree.

1. Every source gets a target in words (``targets``): its weight's share, but at most a multiple of
   its size, the excess going to the others.
2. Documents are cut into blocks of at most ``block_words`` words.  The blocks of a source are
   permuted by a seeded hash, put in that order by one range shuffle and numbered.  A target is so
   many whole passes over them and the first words of one more; the last block is cut, so a source
   gives its target to the word.  This makes an exact quota of block draws.
3. The quotas of all sources are dealt to the output shards by a tree.  A node holds a row of shards
   and what each source gives to them; its left half gets a multivariate-hypergeometric share, as if
   so many of the node's draws were taken blindly, the right half the rest.  Quotas are kept
   exactly.  Sources are split in groups of at most ``GROUP``, groups of groups first, so no row of
   the tree grows with the number of sources.
4. The shards cut the permuted draws of a source into disjoint runs; a draw finds its run by cells of
   about a shard's length.  Each shard, bounded in blocks, is put in a random order of its own.

A source's rows meet only within a range or a cell.  Only DataFrame functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shapescreen.llm.merkle import divided
from shapescreen.llm.ranged import before_parts, in_ranges, numbered
from shapescreen.sources.store import stage

WORD = "[^\\x20\\x09-\\x0D]+"
#: Sources whose quotas a row of the tree holds.
GROUP = 64
#: Tries of a hypergeometric draw; one accepts with a chance of a fifth at least.
TRIES = 64


@dataclass
class Mix:
    """``blocks``: all blocks of all documents, ``row, key, size, source_size, target, nth, block, words,
    place`` and the order they are drawn in.  ``drawn``: the mix, ``shard, slot, row, key, start, words,
    turn``; a block drawn in several turns comes once for each."""

    blocks: DataFrame
    drawn: DataFrame


def held(value: Column, use) -> Column:
    """``use(value)``, with the value computed once."""
    return F.transform(F.array(value), use)[0]


def log_factorial(n: Column) -> Column:
    n = n.cast("double")
    series = (n + 0.5) * F.log(n) - n + 0.9189385332046727 + 1 / (12 * n) - 1 / (360 * n * n * n)
    return F.when(n <= 20, F.log(F.factorial(n.cast("int")).cast("double"))).otherwise(series)


def uniform(*key: Column) -> Column:
    """A number between 0 and 1, both excluded, from a hash of the key."""
    return (F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double") + 0.5) / float(1 << 53)


def hypergeometric(good: Column, pool: Column, taken: Column, *key: Column) -> Column:
    """How many of ``taken`` out of ``pool`` are among the ``good``: a seeded exact draw.

    Ratio of uniforms with the universal hat for this distribution; the first accepted of TRIES.
    """
    g, p, n = (c.cast("double") for c in (good, pool, taken))
    low, high = F.greatest(F.lit(0).cast("long"), taken - (pool - good)), F.least(good, taken)
    mean = n * g / p
    variance = F.when(p > 1, mean * (1 - g / p) * (p - n) / (p - 1)).otherwise(0.0)
    # Fixed values of the hat: 2 * sqrt(2 / e) and 3 - 2 * sqrt(3 / e).
    width = 1.7155277699214135 * F.sqrt(variance + 0.5) + 0.8989161620588988
    mode = F.floor((n + 1) * (g + 1) / (p + 2)).cast("long")

    def weight(k: Column) -> Column:
        return -(log_factorial(k) + log_factorial(good - k) + log_factorial(taken - k) + log_factorial(pool - good - taken + k))

    def tried(hat: Column) -> Column:
        tries = F.transform(
            F.sequence(F.lit(0), F.lit(TRIES - 1)),
            lambda i: held(
                uniform(*key, i),
                lambda u: F.struct(
                    u.alias("u"),
                    F.floor(mean + 0.5 + hat["width"] * (uniform(*key, -1 - i) - 0.5) / u).cast("long").alias("k"),
                ),
            ),
        )
        accepted = F.filter(
            tries, lambda t: F.when(t["k"].between(low, high), 2 * F.log(t["u"]) <= weight(t["k"]) - hat["top"])
        )
        return F.coalesce(F.get(accepted, F.lit(0))["k"], mode)

    drawn = held(F.struct(width.alias("width"), weight(mode).alias("top")), tried)
    return F.when(low == high, low).otherwise(drawn)


def shares(members: Column, taken: Column, *key: Column) -> Column:
    """What ``taken`` blind draws take of each member's quota, in the members' order."""
    zero = F.lit(0).cast("long")
    pool = F.aggregate(members, zero, lambda a, m: a + m["quota"])

    def one(so_far: Column, m: Column) -> Column:
        found = hypergeometric(m["quota"], so_far["pool"], so_far["left"], *key, m["member"])
        return held(
            found,
            lambda x: F.struct(
                (so_far["pool"] - m["quota"]).alias("pool"),
                (so_far["left"] - x).alias("left"),
                F.concat(so_far["shares"], F.array(x)).alias("shares"),
            ),
        )

    start = F.struct(pool.alias("pool"), taken.alias("left"), F.array().cast("array<long>").alias("shares"))
    return F.aggregate(members, start, one)["shares"]


def grown(tree: DataFrame, shards: int, seed: int) -> DataFrame:
    """``group, members array<member, quota>, shards array<shard, size>`` split to single shards.

    The sizes of a row add up to its quotas.
    """
    for _ in range((shards - 1).bit_length()):
        many = F.size("shards") > 1
        left = F.slice("shards", F.lit(1), F.greatest(F.lit(1), divided(F.size("shards").cast("long"), 2).cast("int")))
        right = F.slice("shards", F.size(left) + 1, F.size("shards"))
        taken = F.aggregate(left, F.lit(0).cast("long"), lambda a, s: a + s["size"])
        key = (F.lit(seed), F.col("group"), F.col("shards")[0]["shard"], F.size("shards"))
        split = tree.withColumn("left", F.when(many, shares(F.col("members"), taken, *key)))

        def part(row, of, own):
            quotas = F.zip_with("members", "left", lambda m, x: F.struct(m["member"].alias("member"), own(m, x).alias("quota")))
            return F.struct(F.filter(quotas, lambda m: m["quota"] > 0).alias("members"), of.alias("shards"))

        halves = F.array(part("l", left, lambda m, x: x), part("r", right, lambda m, x: m["quota"] - x))
        whole = F.array(F.struct("members", "shards"))
        tree = stage(
            split.select("group", F.explode(F.when(many, halves).otherwise(whole)).alias("node"))
            .select("group", "node.members", "node.shards")
            .repartition("group", F.col("shards")[0]["shard"]),
            "split-quotas",
        )
    return tree


def dealt(quotas: DataFrame, sources: int, draws: int, shards: int, seed: int) -> DataFrame:
    """``nth, shard, count``: the exact quotas ``nth, quota`` dealt to shards of equal size."""
    levels = 1
    while GROUP**levels < sources:
        levels += 1
    of = lambda level: divided(F.col("nth"), GROUP**level)
    number = F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))
    upto = lambda j: divided(j * F.lit(draws).cast("long"), shards)
    sizes = F.filter(
        F.transform(number, lambda j: F.struct(j.alias("shard"), (upto(j + 1) - upto(j)).alias("size"))),
        lambda s: s["size"] > 0,
    )
    rows = quotas.sparkSession.range(1).select(F.lit(0).cast("long").alias("group"), sizes.alias("shards"))
    for level in range(levels, 0, -1):
        members = (
            quotas.groupBy(of(level).alias("group"), of(level - 1).alias("member"))
            .agg(F.sum("quota").alias("quota"))
            .groupBy("group")
            .agg(F.sort_array(F.collect_list(F.struct("member", "quota"))).alias("members"))
        )
        leaves = grown(members.join(rows, "group"), shards, seed)
        counts = leaves.select(F.col("shards")[0]["shard"].alias("shard"), F.explode("members").alias("m")).select(
            F.col("m.member").alias("nth"), "shard", F.col("m.quota").alias("count")
        )
        rows = counts.groupBy(F.col("nth").alias("group")).agg(
            F.sort_array(F.collect_list(F.struct("shard", F.col("count").alias("size")))).alias("shards")
        )
    return counts


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """``target`` for sources ``nth, size``: together ``share`` of all sizes, by weight, but none above
    ``most`` times its size; what a source can't take goes to the others by weight."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int"))
    sources = sources.withColumn("weight", weight)
    total = sources.agg(F.sum("size")).first()[0] or 0
    level = None
    while True:
        # The level only rises, so whoever is above stays so.
        above = F.lit(False) if level is None else most * F.col("size") <= F.lit(level) * F.col("weight")
        given, weighing = sources.agg(
            F.sum(F.when(above, most * F.col("size")).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight")))
        ).first()
        if not weighing:
            break
        new = (share * total - given) / weighing
        if new == level:
            break
        level = new
    own = F.lit(float(level or 0)) * F.col("weight")
    return sources.withColumn("target", F.least(own, (most * F.col("size")).cast("double")))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: int = 2,
    block_words: int = 512,
    shard_blocks: int = 65_536,
    shards: int = 64,
    seed: int = 0,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> Mix:
    """Mix the sources of a table, to ``share`` of its words.

    Sources in the order of their code points, a null source last, have the weights in turn.  Each
    gives ``target`` words, rounded, of its documents; no word comes more than ``most`` times.
    There are at least ``shards`` shards, and more if they would hold over ``shard_blocks`` blocks.
    A text without words, null or empty, is in ``blocks`` with no words and never drawn; an empty
    table gives no rows.  The same seed gives the same mix on any partitioning; of rows that repeat
    key and text (null keys count as "null") it is not defined which one is drawn first.
    """
    rows = stage(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(key).alias("key"),
            F.struct(F.col(source).alias("source")).alias("name"),
            F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.xxhash64(text).alias("tie"),
        ),
        "sized-documents",
    )
    last = F.when(F.col("size") > 0, divided(F.col("size") - 1, block_words)).otherwise(0)
    drawn_by = F.md5(
        F.concat_ws(":", F.lit(seed), F.coalesce(F.col("key").cast("string"), F.lit("null")), "block").cast("binary")
    )
    order = ["name.source", "place", "key", "block", "tie", "row"]
    blocks = in_ranges(
        rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        .withColumn("words", F.least(F.lit(block_words).cast("long"), F.col("size") - F.col("block") * block_words))
        .withColumn("place", F.conv(F.substring(drawn_by, 1, 15), 16, 10).cast("long")),
        order,
        "ranged-blocks",
    )
    some = F.when(F.col("words") > 0, 1).otherwise(0)
    sources = numbered(
        blocks.groupBy("name").agg(F.sum("words").alias("size"), F.sum(some).alias("pieces")),
        [F.col("name.source").asc_nulls_last()],
        "mixed-sources",
    )
    sources = targets(stage(sources, "mixed-sources"), weights, share, most)
    draws = F.coalesce(F.floor(F.col("target") + 0.5).cast("long"), F.lit(0))
    turns = F.when(F.col("size") > 0, divided(draws, F.col("size"))).otherwise(0)
    count, about = sources.agg(F.count("*"), F.sum(turns * F.col("pieces") + F.col("pieces"))).first()
    shards = max(shards, -(-(about or 0) // shard_blocks))
    sources = (
        sources.withColumn("turns", turns)
        .withColumn("rest", draws - F.col("turns") * F.col("size"))
        # About the draws that a shard gets of the source: the length of its cells.
        .withColumn(
            "cell_size",
            F.greatest(
                F.lit(1).cast("long"),
                F.floor(
                    F.col("pieces") * (F.col("turns") + F.coalesce(F.col("rest") / F.nullif("size", F.lit(0)), F.lit(0.0))) / shards
                ).cast("long"),
            ),
        )
    )
    starts = before_parts(blocks, "name", {"words": F.col("words"), "pieces": some}).join(
        sources.withColumnRenamed("size", "source_size").drop("pieces"), "name"
    )
    running = Window.partitionBy("part", "name").orderBy(*order)
    earlier = running.rowsBetween(Window.unboundedPreceding, -1)
    placed = stage(
        blocks.withColumn("words_run", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
        .withColumn("pieces_run", F.coalesce(F.sum(some).over(earlier), F.lit(0)))
        .join(starts, ["part", "name"])
        .select(
            *("row", "key", "size", "source_size", "target", "nth", "block", "words", "place"),
            *("turns", "rest", "cell_size"),
            F.col("pieces_all").alias("pieces"),
            (F.col("words_before") + F.col("words_run")).alias("words_before"),
            (F.col("pieces_before") + F.col("pieces_run")).alias("piece"),
        ),
        "placed-blocks",
    )
    whole = F.col("turn") < F.col("turns")
    taken = (
        placed.filter("words > 0")
        .withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns"))))
        .filter(whole | (F.col("words_before") < F.col("rest")))
        .withColumn("number", F.col("turn") * F.col("pieces") + F.col("piece"))
        .withColumn("cell", divided(F.col("number"), F.col("cell_size")))
        .withColumn("words", F.when(whole, F.col("words")).otherwise(F.least("words", F.col("rest") - F.col("words_before"))))
    )
    quotas = stage(taken.groupBy("nth").agg(F.count("*").alias("quota")), "quotas")
    total = quotas.agg(F.sum("quota")).first()[0] or 0
    runs = dealt(quotas, count, total, shards, seed)
    upto = F.sum("count").over(Window.partitionBy("nth").orderBy("shard"))
    cells = (
        runs.withColumn("until", upto)
        .withColumn("since", F.col("until") - F.col("count"))
        .join(sources.select("nth", "cell_size"), "nth")
        .withColumn(
            "cell",
            F.explode(F.sequence(divided(F.col("since"), F.col("cell_size")), divided(F.col("until") - 1, F.col("cell_size")))),
        )
        .select("nth", "cell", "shard", "since", "until")
    )
    found = taken.join(cells, ["nth", "cell"]).filter("number >= since and number < until")
    shuffled = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "place", "turn"), "nth", "number")
    drawn = found.select(
        F.col("shard").cast("int").alias("shard"),
        (F.row_number().over(shuffled) - 1).cast("long").alias("slot"),
        "row",
        "key",
        (F.col("block") * block_words).alias("start"),
        "words",
        F.col("turn").cast("int").alias("turn"),
    )
    return Mix(placed, drawn)


def taken_words(found: Mix) -> DataFrame:
    """One row per document: ``key, size, source_size, target, taken``, the words that the mix has of it."""
    documents = found.blocks.groupBy("row").agg(
        *(F.first(c).alias(c) for c in ("key", "size", "source_size", "target"))
    )
    taken = found.drawn.groupBy("row").agg(F.sum("words").alias("taken"))
    return documents.join(taken, "row", "left").select(
        "key", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )
