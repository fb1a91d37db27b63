"""Merkle manifest against a tree built in plain Python."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from shapescreen.llm import merkle
from shapescreen.llm.queries import op13_merkle


def _hash(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _leaf(row, text):
    values = (row.doc_id, row.source, row.lang, row.n_chars, text)
    return _hash("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def _tree(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([_hash("".join(levels[-1][i : i + fanout])) for i in range(0, len(levels[-1]), fanout)])
    return levels


def _way(levels, i, fanout):
    for level in levels[:-1]:
        start = i - i % fanout
        yield "".join(level[start:i]), "".join(level[i + 1 : start + fanout])
        i //= fanout


def expected(rows, fanout, changed):
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for own in by.values():
        own.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, _leaf(r, r.text)))
    trees = {s: _tree([_leaf(r, r.text) for r in by[s]], fanout) for s in names}
    top = _tree([trees[s][-1][0] for s in names], fanout)
    found = []
    for k, s in enumerate(names):
        for i, r in enumerate(by[s]):
            way = [*_way(trees[s], i, fanout), *_way(top, k, fanout)]
            node = _leaf(r, changed(r.text))
            for before, after in way:
                node = _hash(before + node + after)
            proof = "".join(b + a for b, a in way)
            found.append((r.doc_id, s, _leaf(r, r.text), trees[s][-1][0], top[-1][0], proof, node))
    return found


def _without_breaks(text):
    return text and text.replace("\n", "")


@pytest.mark.parametrize("fanout,levels", [(3, 7), (3, 1), (2, 2), (5, 1), (3, 0)])
def test_manifest_with_many_sources(spark, awkward, fanout, levels):
    # One source with a third of all rows, sources of one row, a source without name.
    rows = awkward.withColumn("nth", F.monotonically_increasing_id())
    more = spark.range(150).select(
        (F.col("id") + 100).alias("doc_id"),
        F.concat(F.lit("line\n"), F.col("id").cast("string")).alias("text"),
        F.lit("de").alias("lang"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 10 != 1, F.concat(F.lit("é"), F.col("id") % 23)).alias("source"),
        F.lit(5).cast("long").alias("n_chars"),
    )
    docs = rows.drop("nth").unionByName(more)
    got = merkle.manifest(
        docs, {"text": F.replace("text", F.lit("\n"), F.lit(""))}, fanout=fanout, block_levels=levels
    ).collect()
    assert Counter(tuple(r) for r in got) == Counter(expected(docs.collect(), fanout, _without_breaks))
    assert len({r.root for r in got}) == 1


def test_one_source_and_one_row(spark, awkward):
    few = awkward.filter("doc_id < 4")
    got = merkle.manifest(few, block_levels=1).collect()
    assert Counter(tuple(r) for r in got) == Counter(expected(few.collect(), 3, lambda t: t))
    one = merkle.manifest(awkward.filter("doc_id = 1")).collect()
    assert one[0].root == one[0].leaf == one[0].subroot == one[0].folded_root and one[0].proof == ""


def test_empty_and_clashing(spark, nothing, clashing):
    assert merkle.manifest(nothing).count() == 0
    plain = clashing.select("doc_id", "text", "lang", "source", "n_chars")
    assert sorted(map(str, merkle.manifest(clashing).collect())) == sorted(map(str, merkle.manifest(plain).collect()))


def test_query_tells_what_was_touched(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    found = op13_merkle(spark, folder).join(docs, "doc_id")
    touched = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.col("text").contains("\n")
    assert found.filter(F.col("verified") == touched).count() == 0
    assert found.filter("not verified").count() > 0
