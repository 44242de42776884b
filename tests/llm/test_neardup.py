import random

import numpy as np
import pytest

from aforo.llm.components import components
from aforo.llm.neardup import BAND, BINS, bands, near_duplicates


def shingles(text, words):
    found = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    if len(found) < words:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + words]) for i in range(len(found) - words + 1)}


def brute_force(rows, words, percent):
    """n_shingles and least id in reach, by id."""
    sets = {d: shingles(t, words) for d, t in rows}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def edited(rnd, words, share):
    return " ".join(f"e{rnd.randrange(9999)}" if rnd.random() < share else w for w in words)


@pytest.mark.parametrize("words", [2, 5])
def test_against_brute_force(frame, words):
    """Groups of copies with edits about the threshold: chains, near misses and short texts."""
    rnd = random.Random(words)
    rows = []
    for group in range(25):
        base = [f"w{rnd.randrange(3000)}" for _ in range(rnd.choice([3, 8, 30, 200]))]
        for _ in range(rnd.randint(1, 7)):
            rows.append(edited(rnd, base, rnd.choice([0, 0.01, 0.03, 0.05, 0.08])))
        base = rows[-1].split()
    rows = list(enumerate(rows))
    rnd.shuffle(rows)
    got = near_duplicates(frame("doc_id long, text string", rows), words=words).collect()
    expected = brute_force(rows, words, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_bucket_whose_centre_is_linked_with_nobody(frame):
    """Many variants of one template, most pairs below the threshold: all links must still be found."""
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = list(enumerate(edited(rnd, base, 0.07) for _ in range(90)))
    got = near_duplicates(frame("doc_id long, text string", rows), words=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_force(rows, 2, 80)


def test_chain_in_one_component(frame):
    """Each text is like the next one only."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 6 : i * 6 + 60])) for i in range(50)]
    got = near_duplicates(frame("doc_id long, text string", rows), words=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_force(rows, 2, 80)


def test_hot_group_of_copies(frame):
    rows = [(i, "Hot text that MANY documents hold" if i % 3 == 0 else f"only {i} has this text") for i in range(600)]
    got = near_duplicates(frame("doc_id long, text string", rows)).collect()
    assert {r.component_id for r in got if r.doc_id % 3 == 0} == {0}
    assert sum(r.kept for r in got) == 401


def test_words_that_collide_in_every_polynomial(frame):
    """The Thue-Morse word and its complement; and letters in another order."""
    one = "".join("ab"[i.bit_count() % 2] for i in range(4096))
    other = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, one), (2, other), (3, f"x {one}"), (4, f"x {other}"), (5, "ab ba"), (6, "ba ab")]
    got = near_duplicates(frame("doc_id long, text string", rows), words=2).collect()
    assert all(r.kept and r.component_id == r.doc_id for r in got) and len(got) == 6


def test_letters_and_spaces(frame):
    """Only A-Z fold and only ASCII space parts words."""
    rows = [(1, "A B\tC\u000bd"), (2, " a b c D\n"), (3, "Ä b c d"), (4, "ä b c d"), (5, "a b c d"), (6, "a b c d\x1c")]
    got = {r.doc_id: r.component_id for r in near_duplicates(frame("doc_id long, text string", rows), words=2).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}


def test_nulls_empty_repeated_and_long(frame):
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(1, None), (2, ""), (3, " \n"), (None, "same text here"), (4, "same text here"), (4, "same text here"), (5, long), (6, long + " more")]
    got = near_duplicates(frame("doc_id long, text string, kept string", [(*r, "x") for r in rows]), words=2).collect()
    assert len(got) == 8
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got}
    assert found[1] == (0, 1, True) and found[2] == (0, 2, True) and found[3] == (0, 3, True)
    assert found[4] == (2, 4, True) and found[None] == (2, 4, False)
    assert found[5] == (199_999, 5, True) and found[6] == (200_000, 5, False)
    assert near_duplicates(frame("doc_id long, text string", [])).count() == 0


def test_densified_bands_collide_as_often_as_sets_are_alike():
    rnd = np.random.default_rng(5)
    for n in (10, 40, 1000):
        hits = []
        for _ in range(60):
            pool = rnd.integers(0, 1 << 63, n + n // 5, dtype=np.uint64) * np.uint64(2)
            one, other = np.sort(pool[: n + n // 10]), np.sort(pool[n // 10 :])
            both = bands([one, other])
            hits.append((both[0] == both[1]).mean())
        alike = len(np.intersect1d(one, other)) / len(np.union1d(one, other))
        assert both.shape == (2, BINS // BAND)
        assert abs(np.mean(hits) - alike**BAND) < 0.12


def test_components(spark):
    rnd = random.Random(2)
    links = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(100)] + [(7, 7)]
    root = {n: n for pair in links for n in pair}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.u: r.v for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: find(n) for n in root if find(n) != n}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
