import hashlib
import pickle
import random
import tracemalloc
import weakref

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from aforo.llm import bpe, common

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.load(PATH)


@pytest.fixture(scope="module")
def codec(vocabulary):
    return bpe.Codec(vocabulary)


def same(library, codec, text):
    expected = library.encode(text, add_special_tokens=False).ids
    ids, decoded = codec.round_trip(text)
    assert ([int(i) for i in ids.split(",")] if ids else []) == expected, repr(text)
    assert decoded == library.decode(expected, skip_special_tokens=False) == text


ALPHABET = "aaab  \n\n\t't'sre<|endoftext|> é1２ ١\x1c\x85\xa0 　ñß中文🙂́‍'LLd.,!"


def test_random_texts(library, codec):
    rnd = random.Random(1)
    for _ in range(4000):
        text = "".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 25)))
        same(library, codec, text if rnd.random() < 0.8 else f"{text[:5]}<|endoftext|>{text[5:]}")


def test_every_kind_of_character(library, codec):
    for code in [*range(1, 0x3400, 3), *range(0xF900, 0x11000, 5), *range(0x1F300, 0x1FB00, 7)]:
        if not 0xD800 <= code < 0xE000:
            c = chr(code)
            same(library, codec, f"a{c}b {c}1  {c}{c}x {c}\n")


@pytest.mark.parametrize("text", ["", " ", "  ", "\n", "a" * 5001, "ab" * 3000, "  " * 999 + "x", "é" * 3000, "the" * 2000, "<|endoftext|>" * 3])
def test_edges(library, codec, text):
    same(library, codec, text)


def test_documents(library, codec, spark):
    for row in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect():
        same(library, codec, row.text or "")


def naive_bpe(word, merges):
    """Merge the best-ranked pair, leftmost first, until none is left."""
    symbols, ranks = list(word), {(u, v): (r, w) for r, (u, v, w) in enumerate(merges)}
    while pairs := [(ranks[p][0], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]:
        _, i = min(pairs)
        symbols[i : i + 2] = [ranks[symbols[i], symbols[i + 1]][1]]
    return symbols


def test_automaton_of_random_merges():
    """Small vocabularies with all kinds of overlaps, also tokens that can never be read."""
    rnd = random.Random(7)
    for _ in range(60):
        tokens, merges = {0: b"a", 1: b"b", 2: b"c"}, []
        while len(merges) < 12:
            u, v = rnd.choice(list(tokens)), rnd.choice(list(tokens))
            if tokens[u] + tokens[v] not in tokens.values():
                merges.append((u, v, len(tokens)))
                tokens[len(tokens)] = tokens[u] + tokens[v]
        automaton = bpe.MergeAutomaton(bpe.Vocabulary(tokens, tuple(merges), {}))
        for _ in range(150):
            word = bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 14)))
            expected = naive_bpe([{97: 0, 98: 1, 99: 2}[c] for c in word], merges)
            assert automaton.read(word) == expected
            assert automaton.spell(expected) == word


def each(automaton, words):
    """What ``read_all`` finds, by word."""
    tokens, counts = automaton.read_all(words)
    ends = counts.cumsum().tolist()
    assert len(counts) == len(words) and (ends[-1] if ends else 0) == len(tokens)
    return [tokens[end - n : end].tolist() for end, n in zip(ends, counts.tolist())]


def test_words_side_by_side_of_random_merges():
    rnd = random.Random(8)
    for _ in range(40):
        tokens, merges = {0: b"a", 1: b"b", 2: b"c"}, []
        while len(merges) < 12:
            u, v = rnd.choice(list(tokens)), rnd.choice(list(tokens))
            if tokens[u] + tokens[v] not in tokens.values():
                merges.append((u, v, len(tokens)))
                tokens[len(tokens)] = tokens[u] + tokens[v]
        automaton = bpe.MergeAutomaton(bpe.Vocabulary(tokens, tuple(merges), {}))
        words = [bytes(rnd.choice(b"abc") for _ in range(rnd.randint(0, 14))) for _ in range(150)]
        assert each(automaton, words) == [naive_bpe([{97: 0, 98: 1, 99: 2}[c] for c in word], merges) for word in words]
        with pytest.raises(ValueError):
            automaton.read_all([b"ab", b"axb"])


@pytest.mark.parametrize("tries", [3, bpe.MOST_TRIES])
def test_words_side_by_side(vocabulary, monkeypatch, tries):
    """Rare words with steps back, words too long for that, and bytes that are no text."""
    monkeypatch.setattr(bpe, "MOST_TRIES", tries)
    rnd, automaton = random.Random(9), bpe.MergeAutomaton(vocabulary)
    parts = ["th", "on", "er", "ing", "tion", "é", "中", "1", " ", "-", "the", "an", "x", "\n", "."]
    words = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))).encode() for _ in range(3000)]
    words += [bytes(rnd.randrange(256) for _ in range(rnd.randint(0, 9))) for _ in range(2000)]
    words += [b"", b"a" * 255, b"a" * 256, b"a" * 257, b"ab" * 3000, b"\0", b"\xff" * 5]
    assert each(automaton, words) == [automaton.read(word) for word in words]
    assert each(automaton, []) == [] and each(automaton, [b""]) == [[]]


def test_rare_words_of_a_batch_are_read_together(library, vocabulary, monkeypatch):
    codec, rnd = bpe.Codec(vocabulary), random.Random(10)
    parts = ["th", "on", "er", "ing", "tion", "é", "an", "re", ", ", ". ", " ", "\n", "'s", "12"]
    texts = [" ".join("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 9))) for _ in range(60)) for _ in range(50)]
    monkeypatch.setattr(codec.automaton, "read", lambda word: pytest.fail(f"{word!r} was read alone"))
    for text, (ids, decoded) in zip(texts, codec.round_trips(texts), strict=True):
        assert [int(i) for i in ids.split(",")] == library.encode(text, add_special_tokens=False).ids
        assert decoded == text


def test_full_tables_lose_nothing(library, vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "PIECES_KEPT", 20)
    monkeypatch.setattr(bpe, "PIECES_AT_ONCE", 7)
    monkeypatch.setattr(bpe, "ARC_BITS", 3)
    codec, rnd = bpe.Codec(vocabulary), random.Random(11)
    for _ in range(60):
        texts = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 60))) for _ in range(rnd.randint(0, 4))]
        texts += ["", "<|endoftext|>", "y" * 90 + " z<|endoftext|>", *texts[:1]]
        for text, (ids, decoded) in zip(texts, codec.round_trips(texts), strict=True):
            assert ([int(i) for i in ids.split(",")] if ids else []) == library.encode(text, add_special_tokens=False).ids
            assert decoded == text


def test_memory_of_a_worker(vocabulary, monkeypatch):
    """Reading new words leaves the automaton as large as it is, and a remembered piece takes few bytes."""
    codec, rnd = bpe.Codec(vocabulary), random.Random(12)
    before = len(pickle.dumps(codec.automaton))
    pieces = ["".join(rnd.choices("etaoinshrdlu", k=9)) for _ in range(20_000)]
    tracemalloc.start()
    try:
        assert list(codec.round_trips([" ".join(["", *pieces])]))[0][1] == " ".join(["", *pieces])
        held = tracemalloc.get_traced_memory()[0] - sum(map(len, pieces))
    finally:
        tracemalloc.stop()
    assert len(pickle.dumps(codec.automaton)) == before
    # An object of the text with the piece, one with its ids, and their place in the table.
    assert held < 220 * len(set(pieces))


def test_a_batch_goes_before_the_next_comes(spark):
    class Table:
        sparkSession = spark

        @staticmethod
        def mapInArrow(run, schema):
            return run

    seen = []

    def made(i):
        batch = pa.RecordBatch.from_pydict({"x": [i] * 3000})
        seen.append(weakref.ref(batch))
        return batch

    def batches():
        for i in range(3):
            assert all(batch() is None for batch in seen)
            yield made(i)

    run = common.map_batches(Table, lambda batch: {"x": batch.column("x")}, common.fields(spark.createDataFrame([], "x long")))
    assert [x for part in run(batches()) for x in part.column("x").to_pylist()] == [0] * 3000 + [1] * 3000 + [2] * 3000


def test_frames(frame, vocabulary, library):
    rows = [(1, "Hello there", "t"), (1, "Hello there", "t"), (None, None, None), (3, "", ""), (4, "x" * 300_000 + " <|endoftext|>", "u")]
    df = frame("doc_id long, text string, token_ids string", rows)
    encoded = bpe.encode(df, vocabulary)
    assert encoded.columns == ["doc_id", "text", "token_ids"] and encoded.count() == 5
    for r in bpe.decode(encoded, vocabulary).collect():
        assert r.token_ids == library.encode(r.text or "", add_special_tokens=False).ids
        assert r.decoded == (r.text or "")
    for r in bpe.digest(df, vocabulary, carry=["doc_id", "text"]).collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.digest(df.limit(0), vocabulary).count() == 0


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        bpe.Vocabulary.load(public_tokenizers.path("word_bpe_49k.json"))
