"""Packing and byte-pair encoding against the tokenizers library."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shapescreen.llm import bpe, packing
from shapescreen.llm.queries import tokenizer_definition

BYTES, WORDS = "byte_bpe_50k.json", "word_bpe_49k.json"


def strange_texts():
    draw = random.Random(2)
    found = ["", "  ", "it's 'street we're 'LL  x\n\n y \t z", "a<|endoftext|>b 's <|startoftext|>x<|endoftext|>"]
    found += ["".join(draw.choice(" \n\t'streveml d1½é!.  ΣİÉnh漢😀") for _ in range(draw.randrange(60))) for _ in range(800)]
    found += ["".join(draw.choice("aeinsthr") for _ in range(draw.randrange(200))) for _ in range(100)]
    return found + ["a" * 3000, "!" * 99, "\x1c\x85a　b​c", "ΑΣ Σ İstanbul ſ ﬁ é"]


def test_byte_ids_equal_the_library():
    tokens = packing.ByteTokens(tokenizer_definition(BYTES))
    assert tokens.pieces is not None
    texts = strange_texts()
    ids, offsets = tokens.ids(texts)
    library = Tokenizer.from_file(public_tokenizers.path(BYTES))
    for i, text in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_word_ids_equal_the_library_and_decode():
    encoder = bpe.PairEncoder(tokenizer_definition(WORDS))
    library = Tokenizer.from_file(public_tokenizers.path(WORDS))
    texts = strange_texts()
    for text, (count, ids, decoded) in zip(texts, encoder.run(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)) and count == len(want), text
        assert decoded == library.decode(want, skip_special_tokens=False)


def test_vocabulary_forgets_and_goes_on():
    encoder = bpe.PairEncoder(tokenizer_definition(WORDS))
    texts = [f"word{i} {'x' * (i % 40)} y{i}" for i in range(400)]
    want = [ids for _, ids, _ in encoder.run(texts)]
    small = bpe.PairEncoder(tokenizer_definition(WORDS))
    small._start()
    small.words.bits = 5
    small.words._clear()
    assert [small.run([t])[0][1] for t in texts] == want


def test_encode_query_and_round_trip(spark, awkward):
    library = Tokenizer.from_file(public_tokenizers.path(WORDS))
    definition = tokenizer_definition(WORDS)
    want = sorted((library.encode(r.text or "", add_special_tokens=False).ids for r in awkward.collect()))
    rows = bpe.encode(awkward, definition)
    assert sorted(list(r.ids) for r in rows.collect()) == want
    texts = sorted(r.text for r in bpe.decode(rows, definition).collect())
    assert texts == sorted(library.decode(ids, skip_special_tokens=False) for ids in want)
    digests = sorted(r.ids_sha256 for r in bpe.encode_digests(awkward, definition).collect())
    assert digests == sorted(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() for ids in want)


def test_pack_awkward_documents(spark, clashing, nothing):
    definition = tokenizer_definition(BYTES)
    library = Tokenizer.from_file(public_tokenizers.path(BYTES))
    got = packing.pack(clashing, definition, capacity=512).collect()
    want = []
    for r in clashing.collect():
        ids = np.array(library.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        edges = packing.cut(len(ids), 512)
        want += [(r.doc_id, n, a, b - a, zlib.crc32(ids[a:b].tobytes())) for n, (a, b) in enumerate(zip(edges, edges[1:]))]
        assert all(b - a == 512 for a, b in zip(edges[1:], edges[2:])) and 0 < edges[1] <= 512
    key = lambda t: tuple(-1 if v is None else v for v in t)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    fills = defaultdict(list)
    for r in got:
        fills[r.sequence_id].append((r.offset, r.length))
    for parts in fills.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    assert len(fills) == -(-sum(r.length for r in got) // 512)
    assert packing.pack(nothing, definition).count() == 0


def test_cells_meet_again(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "repeat('a b c ', int(20 + id % 37)) AS text")
    got = packing.pack(docs, tokenizer_definition(BYTES), capacity=512, cell_pieces=20)
    tokens, sequences = got.agg({"length": "sum"}).first()[0], got.select("sequence_id").distinct().count()
    assert sequences <= -(-tokens // 512) * 1.15
    assert got.groupBy("sequence_id").agg({"length": "sum"}).filter("`sum(length)` > 512").count() == 0


def test_long_documents_never_meet_in_one_cell(spark):
    """All documents are over half a sequence, so that every sequence stays loose."""
    docs = spark.range(2000).selectExpr("id AS doc_id", "repeat('a b c ', int(90 + id % 40)) AS text")
    got = packing.pack(docs, tokenizer_definition(BYTES), capacity=512, cell_pieces=100).collect()
    assert len({r.sequence_id for r in got}) == len(got) == 2000
    assert max(Counter(r.sequence_id >> 32 for r in got).values()) < 200


def test_loose_pieces_meet_again_while_that_helps(spark):
    """Halves and rests that few cells can pair; no sequence number is used twice."""
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('a b c ', int(60 + pow(xxhash64(id) % 97, 2) % 97)) AS text")
    got = packing.pack(docs, tokenizer_definition(BYTES), capacity=512, cell_pieces=60).collect()
    assert sorted((r.doc_id, r.piece) for r in got) == sorted({(r.doc_id, r.piece) for r in got})
    fills = defaultdict(list)
    for r in got:
        fills[r.sequence_id].append((r.offset, r.length))
    for parts in fills.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) <= 512
    assert max(Counter(r.sequence_id >> 32 for r in got).values()) < 150


@pytest.mark.parametrize("seed", range(4))
def test_exchange_keeps_items_and_never_adds_bins(seed):
    draw = random.Random(seed)
    lengths = [draw.choice([700, 701, 690, 650, 660, 1000, 900, 1100, 30]) for _ in range(600)]
    first = packing.best_fit(lengths, 2048)
    fewer = packing.exchange([list(b) for b in first], lengths, 2048)
    assert sorted(i for b in fewer for i in b) == list(range(600))
    assert all(sum(lengths[i] for i in b) <= 2048 for b in fewer)
    assert len(fewer) < len(first)


def test_a_packing_worker_remembers_a_bounded_number_of_pieces():
    tokens = packing.ByteTokens(tokenizer_definition("byte_bpe_50k.json"))
    texts = [" ".join(f"{a}x{b}" for b in range(1000)) for a in "abcdefghijklmnopqrstuvwxyz" for _ in range(1)]
    texts += [t.upper() + " ." for t in texts] + [t.replace("x", "yz") for t in texts] + [t.replace("x", "q") for t in texts]
    for text in texts:
        ids, offsets = tokens.ids([text])
        assert ids.tolist() == tokens.tokenizer.encode(text, add_special_tokens=False).ids
    held = [tokens.words.keys, tokens.words.numbers, tokens.flat, tokens.offsets]
    assert sum(a.nbytes for a in held) < 16 << 20
