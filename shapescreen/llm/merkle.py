"""A Merkle manifest of a table, with a proof for every row, by butterfly exchange.

1. Every row becomes a leaf where it lies.  Leaves, without texts, are put in order of source and key
   by one range shuffle and numbered within their source; a source may fill any number of ranges.
2. Aligned runs of ``fanout ** block_levels`` leaves form blocks, which hash their own subtrees.
3. Blocks then exchange subtree roots in rounds.  In each round the aligned groups of ``fanout``
   subtrees that share a parent swap roots, block by block: the blocks of equal rank in their
   subtrees meet, and a subtree of fewer blocks answers for the ranks it lacks.  Every block hashes
   the parent itself, so after a round all blocks below a node know it and the siblings on their way
   to it.  Rounds go up each source, then over the sources; nothing is passed down again.
4. Each block completes the proofs of its leaves from what it has heard.

A round moves one short row for each block and each missing rank, at most ``fanout`` times the blocks,
and no key of it holds more than ``fanout`` blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shapescreen.llm.ranged import before_parts, in_ranges, numbered
from shapescreen.sources.store import stage

#: What a leaf commits to, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts) -> Column:
    """Lowercase hex SHA-256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_hash(values: list[Column]) -> Column:
    """Hash of the values, each as ``-`` if null, else its byte count, ``:`` and itself."""
    texts = [v.cast("string") for v in values]
    named = [F.concat(F.octet_length(t).cast("string"), F.lit(":"), t) for t in texts]
    return digest(*(F.coalesce(n, F.lit("-")) for n in named))


def levels_above(count: Column, fanout: int) -> Column:
    """Levels between ``count`` nodes and the single one over them."""
    last = F.transform(F.sequence(F.lit(0), F.lit(62)), lambda k: F.pow(F.lit(float(fanout)), k) >= count)
    return (F.array_position(last, True) - 1).cast("int")


def divided(number: Column, by: int | Column) -> Column:
    """The floor of a quotient of longs."""
    by = F.lit(by).cast("long") if isinstance(by, int) else by
    return F.call_function("div", number, by)


def subtree(leaves: Column, levels: Column, fanout: int) -> Column:
    """All levels of a subtree, the leaves first: every ``fanout`` nodes in a row become their hash."""

    def up(found: Column, _: Column) -> Column:
        below = F.element_at(found, -1)
        parents = F.transform(
            F.sequence(F.lit(0), divided(F.size(below).cast("long") - 1, fanout).cast("int")),
            lambda i: digest(F.array_join(F.slice(below, i * fanout + 1, fanout), "")),
        )
        return F.concat(found, F.array(parents))

    steps = F.when(levels > 0, F.sequence(F.lit(1), levels)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.array(leaves), up)


def on_the_way(tree: Column, place: Column, fanout: int) -> Column:
    """``before, after`` for each level of a subtree: the siblings of a leaf's ancestor, joined."""

    def at(level: Column, k: Column) -> Column:
        # Inside a block numbers are small enough for an exact quotient of doubles.
        node = F.floor(place / F.round(F.pow(F.lit(float(fanout)), k))).cast("int")
        own = node % fanout
        return F.struct(
            F.array_join(F.slice(level, node - own + 1, own), "").alias("before"),
            F.array_join(F.slice(level, node + 2, F.lit(fanout - 1) - own), "").alias("after"),
        )

    return F.transform(F.slice(tree, 1, F.size(tree) - 1), at)


def folded(start: Column, way: Column) -> Column:
    """The root that a node and the siblings on its way give."""
    return F.aggregate(way, start, lambda node, s: digest(s["before"], node, s["after"]))


def exchange(blocks: DataFrame, fanout: int, keys: list[str], child: Column, rank: Column, size: Column, most: Column):
    """One round: blocks of children of one parent swap roots.

    ``keys`` name the forest a parent belongs to.  ``child`` numbers the subtrees of the forest,
    ``rank`` the blocks of a subtree, of which there are ``size``; ``most`` is the largest size
    among the children of a parent.
    """
    parent = divided(child, fanout)
    carried = F.struct(*(c for c in blocks.columns if c != "root"))
    sent = blocks.select(
        *keys,
        parent.alias("parent"),
        child.alias("child"),
        "root",
        rank.alias("rank"),
        carried.alias("block"),
        F.explode(F.sequence(rank, most - 1, size)).alias("at"),
    )
    # A block goes on itself only at its own rank; elsewhere it only answers.
    heard = sent.groupBy(*keys, "parent", "at").agg(
        F.sort_array(F.collect_list(F.struct("child", "root"))).alias("heard"),
        F.collect_list(F.when(F.col("at") == F.col("rank"), F.struct("child", "block"))).alias("met"),
    )
    own = F.col("met.child")
    beside = lambda keep: F.array_join(F.transform(F.filter("heard", keep), lambda h: h["root"]), "")
    return (
        heard.withColumn("met", F.explode("met"))
        .withColumn(
            "siblings",
            F.struct(
                beside(lambda h: h["child"] < own).alias("before"), beside(lambda h: h["child"] > own).alias("after")
            ),
        )
        .withColumn("root", digest(F.array_join("heard.root", "")))
        .select(
            *(F.col(f"met.block.{c}").alias(c) for c in blocks.columns if c not in ("root", "above")),
            "root",
            F.concat("met.block.above", F.array("siblings")).alias("above"),
        )
    )


def source_rounds(sources: DataFrame, fanout: int, count: int, levels: int) -> DataFrame:
    """``nth`` of each source with ``rounds``: for every level over the sources the first block of the
    source's subtree, the number of blocks in it and the largest such number under its parent."""
    found = sources.withColumn("rounds", F.array().cast("array<struct<first:long,size:long,most:long>>"))
    for level in range(levels):
        width = fanout**level
        of = found.withColumn("child", divided(F.col("nth"), width)).withColumn("parent", divided(F.col("nth"), width * fanout))
        sizes = of.groupBy("parent", "child").agg(F.min("first").alias("from"), F.sum("blocks").alias("size"))
        sizes = sizes.withColumn("most", F.max("size").over(Window.partitionBy("parent"))).drop("parent")
        one = F.struct(F.col("from").alias("first"), F.col("size"), F.col("most"))
        found = stage(
            of.join(sizes, "child").select(*sources.columns, F.concat("rounds", F.array(one)).alias("rounds")),
            "source-rounds",
        )
    return found


def manifest(
    docs: DataFrame,
    tampered: dict[str, Column] | None = None,
    fields: tuple[str, ...] = FIELDS,
    fanout: int = 3,
    block_levels: int = 7,
    key: str = "doc_id",
    source: str = "source",
) -> DataFrame:
    """One row per input row: ``key, source, leaf, subroot, root, proof, folded_root``.

    A leaf hashes ``fields``.  The leaves of a source ascend by key (null first; rows of equal key
    by leaf, and rows alike in both are interchangeable); while several nodes remain, every
    ``fanout`` in a row become the hash of their digests, the last run perhaps of fewer, even of one.
    What remains is the source's ``subroot``; the subroots, by source (null first, then by UTF-8
    bytes), give ``root`` in the same way.  ``proof`` joins the siblings from leaf to root, left to
    right.  ``tampered`` replaces columns by expressions: ``folded_root`` is what the leaf of the
    replaced row and the original siblings give, so it differs from ``root`` if a row has changed.
    An empty table gives no rows; columns other than the named ones are not looked at.
    """
    tampered = tampered or {}
    leaves = stage(
        docs.select(
            F.col(key).alias("key"),
            F.col(source).alias("source"),
            leaf_hash([F.col(f) for f in fields]).alias("leaf"),
            leaf_hash([tampered.get(f, F.col(f)) for f in fields]).alias("now"),
        ),
        "leaves",
    )
    order = ["source", "key", "leaf"]
    rows = in_ranges(leaves, order, "leaf-ranges")
    counts = rows.groupBy("source").agg(F.count("*").alias("leaves"))
    per_block = fanout**block_levels
    named = numbered(counts.withColumn("blocks", divided(F.col("leaves") - 1, per_block) + 1), ["source"], "sources")
    sources = stage(firsts(named), "numbered-sources")
    count, deepest = sources.agg(F.count("*"), F.max("leaves")).first()
    over_sources = levels_of(count, fanout)
    sources = source_rounds(sources, fanout, count, over_sources)

    # The parts of a source learn its number and size; a source's rows never meet on its name.
    starts = before_parts(rows.withColumn("source", F.struct("source")), "source", {"rows": F.lit(1)})
    starts = starts.select("part", F.col("source.source").alias("source"), "rows_before")
    starts = starts.join(sources.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    running = Window.partitionBy("part", "name").orderBy(*order)
    name = F.struct("source").alias("name")
    placed = (
        rows.select("*", name)
        .withColumn("own", F.row_number().over(running) - 1)
        .drop("source")
        .join(starts.select("part", name, "source", "nth", "leaves", "blocks", "first", "rounds", "rows_before"), ["part", "name"])
        .withColumn("at", F.col("rows_before") + F.col("own"))
        .withColumn("block", divided(F.col("at"), per_block))
    )
    # A block's facts come with its first leaf only.
    facts = F.struct("leaves", "blocks", "first", "rounds", "source")
    packed = stage(
        placed.groupBy("nth", "block")
        .agg(
            F.sort_array(F.collect_list(F.struct("at", "key", "leaf", "now"))).alias("rows"),
            F.first(F.when(F.col("at") % per_block == 0, facts), ignorenulls=True).alias("facts"),
        )
        .withColumn("levels", F.least(F.lit(block_levels), levels_above(F.col("facts.leaves"), fanout)))
        .withColumn("tree", subtree(F.col("rows.leaf"), F.col("levels"), fanout)),
        "leaf-blocks",
    )
    blocks = packed.select(
        "nth",
        "block",
        "facts.leaves",
        "facts.blocks",
        "facts.first",
        "facts.rounds",
        F.element_at(F.element_at("tree", -1), 1).alias("root"),
        F.array().cast("array<struct<before:string,after:string>>").alias("above"),
    )
    # Up the sources: those that are done wait.
    for level in range(block_levels, levels_of(deepest, fanout)):
        width = fanout ** (level - block_levels)
        goes = F.col("leaves") > fanout**level
        child = divided(F.col("block"), width)
        parent_first = divided(child, fanout) * fanout * width
        size = lambda begin: F.least(F.lit(width).cast("long"), F.col("blocks") - begin)
        risen = exchange(
            blocks.filter(goes), fanout, ["nth"], child, F.col("block") % width, size(child * width), size(parent_first)
        )
        blocks = stage(blocks.filter(~goes).unionByName(risen), "risen-blocks")
    blocks = blocks.withColumn("subroot", F.col("root"))
    # Over the sources.
    for level in range(over_sources):
        one = F.col("rounds")[level]
        number = F.col("first") + F.col("block")
        risen = exchange(
            blocks, fanout, [], divided(F.col("nth"), fanout**level), number - one["first"], one["size"], one["most"]
        )
        blocks = stage(risen, "risen-blocks")
    blocks = blocks.select("nth", "block", "subroot", "root", "above")

    def finish(row: Column) -> Column:
        way = F.concat(on_the_way(F.col("tree"), row["at"] % per_block, fanout), F.col("above"))
        return F.struct(
            row["key"].alias("key"),
            row["leaf"].alias("leaf"),
            F.array_join(F.transform(way, lambda s: F.concat(s["before"], s["after"])), "").alias("proof"),
            folded(row["now"], way).alias("folded_root"),
        )

    return (
        packed.join(blocks, ["nth", "block"])
        .select("facts.source", "subroot", "root", F.explode(F.transform("rows", finish)).alias("row"))
        .select(
            F.col("row.key").alias(key),
            F.col("source").alias(source),
            "row.leaf",
            "subroot",
            "root",
            "row.proof",
            "row.folded_root",
        )
    )


def levels_of(count: int | None, fanout: int) -> int:
    """As ``levels_above``, of a number."""
    levels = 0
    while fanout**levels < (count or 0):
        levels += 1
    return levels


def firsts(sources: DataFrame) -> DataFrame:
    """``first``: blocks of all sources before each one, by number of the source."""
    rows = in_ranges(sources, ["nth"], "source-ranges").withColumn("whole", F.lit(0))
    starts = before_parts(rows, "whole", {"blocks": F.col("blocks")}).select("part", "blocks_before")
    earlier = Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("own", F.coalesce(F.sum("blocks").over(earlier), F.lit(0)))
        .join(starts, "part")
        .select(*sources.columns, (F.col("blocks_before") + F.col("own")).alias("first"))
    )
