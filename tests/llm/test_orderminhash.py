import hashlib
import random

import numpy as np
import pytest

from aforo.llm.orderminhash import OrderMinHash, compared_with_next, edited, fingerprints

METHOD = OrderMinHash()


def prose(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9))) for _ in range(n))


def likeness(a, b, method=METHOD):
    return method.likeness(method.signature(a), method.signature(b))


def test_numbering_and_order_by_hand():
    """The least k-mers by each sketch's ranking, numbered by occurrence, in text order."""
    text = "abcabcabcabxabc" * 3
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    kmers = METHOD._kmers(codes)
    plain = [text[i : i + METHOD.kmer] for i in range(len(text) - METHOD.kmer + 1)]
    for i, a in enumerate(plain):
        for j, b in enumerate(plain):
            assert (a == b) == bool(kmers[i] == kmers[j])
    numbered = METHOD._numbered(kmers)
    assert len(set(numbered.tolist())) == len(plain)
    # The same k-mer with the same number is the same element in another text.
    again = METHOD._numbered(METHOD._kmers(np.concatenate([codes[:1] + 50, codes])))
    assert set(numbered.tolist()) <= set(again.tolist())


def test_first_occurrences_are_alike_with_and_without_repeats():
    """A text without a repeated k-mer against the same text plus one repeated phrase."""
    text = "".join(map(chr, range(0x4E00, 0x4E00 + 2000)))
    longer = text + text[:20]
    once, more = (METHOD._numbered(METHOD._kmers(np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64))) for t in (text, longer))
    assert set(once.tolist()) < set(more.tolist()) and len(set(more.tolist())) == len(more)
    assert likeness(text, longer) > 0.8


def test_likeness_follows_edit_distance():
    rnd = random.Random(1)
    text = prose(rnd, 400)
    few = list(text)
    for i in rnd.sample(range(len(few)), 10):
        few[i] = "z"
    halves = text[len(text) // 2 :] + text[: len(text) // 2]
    assert likeness(text, text) == 1
    assert likeness(text, "".join(few)) > 0.6
    # The same k-mers in another order are less alike than to a set-based signature.
    sets = OrderMinHash(tuple_size=1, sketches=64)
    assert likeness(text, halves) < likeness(text, halves, sets) - 0.2
    assert likeness(text, prose(rnd, 400)) < 0.1


def test_estimate_for_one_k_mer_is_the_jaccard_similarity():
    rnd = random.Random(4)
    method = OrderMinHash(tuple_size=1, sketches=64)
    found = []
    for _ in range(40):
        text = prose(rnd, 120)
        found.append(likeness(text, text[: len(text) * 2 // 3], method))
    assert abs(np.mean(found) - 2 / 3) < 0.05


def test_short_texts():
    assert likeness("", "") == 1 and likeness("", "x") == 0 and likeness("abc", "abc") == 1 and likeness("abc", "abd") == 0
    assert METHOD.fingerprint(METHOD.signature("a")) != METHOD.fingerprint(METHOD.signature("aa"))
    assert set(METHOD.fingerprint(METHOD.signature(""))) == {"0"}


def test_long_texts_take_the_other_path():
    """Beyond 2**18 k-mers positions no longer fit beside the hash."""
    rnd = random.Random(9)
    text = prose(rnd, 60_000)
    assert len(text) > 1 << 18
    assert likeness(text, text[:-3] + "zzz") > 0.9


def expected(rows):
    """By brute force: the next document in descending order of the id."""
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for i, (key, text) in enumerate(ordered):
        text, following = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        assert changed == edited(text, following)
        signatures = [METHOD.signature(t) for t in (text, changed, following)]
        out.append(
            (key, len(text), hashlib.sha256(changed.encode()).hexdigest(), METHOD.fingerprint(signatures[0]), METHOD.fingerprint(signatures[1]),
             METHOD.likeness(signatures[0], signatures[1]), METHOD.likeness(signatures[0], signatures[2]))
        )
    return out


def order(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("per_range", [400, 10_000_000])
def test_against_brute_force(frame, per_range):
    rnd = random.Random(2)
    rows = [(i * 3, prose(rnd, rnd.choice([0, 1, 5, 40]))) for i in range(120)]
    rows += [(30, rows[10][1]), (33, None), (None, "no id"), (None, None), (36, "äöü€🙂" * 9)]
    got = compared_with_next(frame("doc_id long, text string", rows), chars_per_range=per_range)
    assert order(got.collect()) == order(expected(rows))


@pytest.mark.parametrize("rows", [[], [(1, "a single document")], [(5, None)], [(2, "x y z" * 9), (2, "x y z" * 9)]])
def test_few_rows(frame, rows):
    got = compared_with_next(frame("doc_id long, text string, near_next string", [(*r, "c") for r in rows]), chars_per_range=10)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert order(got.collect()) == order(expected(rows))


def test_fingerprints_of_equal_texts(frame):
    rows = [(1, "same " * 20, 0), (2, "same " * 20, 0), (3, None, 0), (4, "", 0)]
    got = {r.doc_id: r.fingerprint for r in fingerprints(frame("doc_id long, text string, fingerprint int", rows)).collect()}
    assert got[1] == got[2] == METHOD.fingerprint(METHOD.signature("same " * 20)) and got[3] == got[4]
