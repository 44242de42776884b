"""Packing: every token in one place, sequences full, neighbours alike; ids as the library gives them."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from aforo.llm import bpe, packing, queries
from aforo.llm.byteids import ByteEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.load(PATH)


def check(rows, expected, length):
    """``expected`` lists (id, tokens) of the documents. Returns the ids in order of the sequences."""
    by_sequence = {}
    for r in rows:
        assert r.length == len(r.ids) // 4 > 0
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    stream, order = [], []
    for s in sorted(by_sequence):
        pieces = sorted(by_sequence[s], key=lambda r: r.offset)
        at = 0
        for r in pieces:
            assert r.offset == at
            at += r.length
            stream.append(r)
        assert at == length or s == max(by_sequence) and at <= length
    documents, open_ = [], None
    for r in stream:
        if r.start == 0:
            assert open_ is None
            open_ = [r.doc_id, []]
            order.append(r.doc_id)
        assert r.doc_id == open_[0] and r.start == len(open_[1])
        open_[1] += np.frombuffer(r.ids, "<u4").tolist()
        if len(open_[1]) == r.doc_tokens:
            documents.append((open_[0], tuple(open_[1])))
            open_ = None
    assert open_ is None
    key = lambda d: (d[0] is not None, d[0] or 0, d[1])
    assert sorted(documents, key=key) == sorted(((i, tuple(t)) for i, t in expected), key=key)
    return order


def tokens(library, rows):
    return [(i, [*library.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in rows]


def test_every_token_once(frame, vocabulary, library):
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choice(["tide", "harbour", "noon", "<|endoftext|>", "ñandú", "9"]) for _ in range(rnd.randint(0, 90)))) for i in range(200)]
    rows += [(1, None), (2, ""), (None, "no id"), (None, "no id"), (7, rows[7][1]), (900, "x " * 9000), (901, "a" * 7000)]
    rows += [(1000 + i, "the very same text in many rows") for i in range(150)]
    for length in (64, 2048):
        got = packing.pack(frame(SCHEMA, rows), vocabulary, length).collect()
        check(got, tokens(library, rows), length)


def test_many_ranges(frame, vocabulary, library, monkeypatch):
    """Ranges of few tokens, a third of the rows in one place."""
    monkeypatch.setattr(packing, "TOKENS_PER_RANGE", 100)
    rows = [(i, "a hot text" if i % 3 == 0 else f"text {i} of its own, number {i * i}") for i in range(400)]
    got = packing.pack(frame(SCHEMA, rows), vocabulary, 128).collect()
    check(got, tokens(library, rows), 128)


def test_neighbours_are_alike(frame, vocabulary, library):
    """Along the curve, texts of one subject follow each other more often than by chance."""
    rnd = random.Random(4)
    subjects = [[f"{c}{w}" for w in ("ater", "ind", "olour", "ight", "able", "orn")] for c in "wbcrtm"]
    rows = [(i, " ".join(rnd.choice(subjects[i % 6]) for _ in range(80))) for i in range(600)]
    order = check(packing.pack(frame(SCHEMA, rows), vocabulary, 256).collect(), tokens(library, rows), 256)
    assert np.mean([a % 6 == b % 6 for a, b in zip(order, order[1:])]) > 0.8


@pytest.mark.parametrize(("dimensions", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve(dimensions, bits):
    """All points of a grid in an order in which each is one step from the next."""
    points = np.array(np.meshgrid(*[range(1 << bits)] * dimensions)).reshape(dimensions, -1).T
    keys = packing.hilbert_key(points, bits)
    assert sorted(keys) == list(range(len(points)))
    along = points[np.argsort(keys)]
    assert (np.abs(np.diff(along, axis=0)).sum(axis=1) == 1).all()


def test_ids_are_the_library_s(vocabulary, library):
    rnd = random.Random(1)
    letters = "aaab  \n\n\t't'sre<|endoftext|> é1２ ١\x1c\x85\xa0 　ñß中文🙂́‍'LLd.,!"
    encoder = ByteEncoder(vocabulary)
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    texts += [f"a{c}b {c}1  {c}{c}x {c}\n" for c in map(chr, [*range(1, 0x3400, 3), *range(0xF900, 0x11000, 5), *range(0x1F300, 0x1FB00, 7)])]
    texts += ["", " ", "a" * 50_000, " " * 50_000 + "x", "\n" * 50_000, "x<|endoftext|><|endoftext|> y"]
    for text in texts:
        assert encoder.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text[:40])


def test_empty_and_clashing_columns(frame, vocabulary, library):
    assert packing.pack(frame(SCHEMA, []), vocabulary).count() == 0
    rows = [(i, f"text {i}", i, "y", 1, 2) for i in range(5)]
    got = packing.pack(frame(f"{SCHEMA}, length int, ids string, _start int, sequence_id int", rows), vocabulary).collect()
    check(got, tokens(library, [r[:2] for r in rows]), 2048)


def test_query(spark, library):
    got = queries.QUERIES["op13_curve_packing"](spark, "/root/testdata/sf0.001")
    assert dict(got.dtypes) == {c: "string" if c == "text" else "bigint" for c in got.columns}
    documents = dict(tokens(library, spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()))
    rows = got.collect()
    assert sum(r.length for r in rows) == sum(map(len, documents.values()))
    for r in rows:
        ids = documents[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(documents[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
