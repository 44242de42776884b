import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from aforo.llm import tokencount

PATH = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = "aab  \n\t'ts<|endoftext|>É1 ١\x1c\x85\xa0　ñßΣ中🙂́‍LL"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def content():
    return tokencount.load_tokenizer(PATH)


@pytest.mark.parametrize("chunk, overlap", [(tokencount.CHUNK, tokencount.OVERLAP), (12, 3), (7, 1)])
def test_random_texts(library, content, chunk, overlap):
    rnd = random.Random(chunk)
    texts = []
    for _ in range(1500):
        text = "".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 60)))
        texts.append(text if rnd.random() < 0.8 else f"{text[:5]}<|endoftext|>{text[5:]}")
    expected = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert tokencount.Counter(content, chunk, overlap).counts(texts) == expected


@pytest.mark.parametrize("text", ["a" * 40_000, "ab1" * 9000 + " " + "x" * 20_000, "." * 50_000, " " * 40_000, "é́ " * 9000, "<|startoftext|>" * 3000])
def test_huge_texts(library, content, text):
    expected = len(library.encode(text, add_special_tokens=False).ids)
    assert tokencount.Counter(content).counts([text]) == [expected]
    assert tokencount.Counter(content, 1000, 10).counts([text]) == [expected]


def test_documents_in_small_chunks(library, content, spark):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    expected = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert tokencount.Counter(content).counts(texts) == expected
    assert tokencount.Counter(content, 300, 20).counts(texts) == expected


def test_frame(frame, content):
    rows = [(1, "one two", 5), (1, "one two", 5), (None, None, 5), (2, "", 5), (3, "word " * 2049, 5), (4, "ü" * 100_000, 5)]
    df = frame("doc_id long, text string, n_tokens int", rows)
    got = tokencount.count_tokens(df, content)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    found = {r.doc_id: tuple(r)[1:] for r in got.collect()}
    assert found[1] == (7, 2, False) and found[None] == found[2] == (0, 0, False) and found[3] == (10245, 2049, True)
    assert found[4][0] == 200_000 and got.count() == 6
    assert tokencount.count_tokens(df.limit(0), content).count() == 0


def test_other_tokenizers_are_refused():
    with pytest.raises((ValueError, KeyError)):
        tokencount.load_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
