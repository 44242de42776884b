import pytest

from aforo.llm.mixing import mix, mixed_documents, taken_words

SCHEMA = "doc_id long, text string, source string"


def targets(sizes, weights=(1, 2, 3), most=3):
    """Share by weight; what exceeds three times a source is shared again, until nothing does."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, found = sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not full:
            found.update({s: left * weight[s] / total for s in open_})
            break
        for s in full:
            found[s] = most * sizes[s]
            left -= most * sizes[s]
        open_ -= full
    return found


def documents(counts):
    """``counts``: words of the documents by source."""
    rows = [(source, n) for source, words in counts.items() for n in words]
    return [(i, " ".join(f"w{j}" for j in range(n)), source) for i, (source, n) in enumerate(rows)]


CASES = {
    "even": {"a": [10] * 30, "b": [7, 13] * 10, "c": [100], "d": [1] * 50},
    "one small source must stop": {"a": [500, 3, 1000], "b": [5], "c": [2, 2], None: [40] * 9},
    "one source": {"only": [3, 4, 5]},
    "code points, not letters": {"Z": [9] * 5, "a": [9] * 5, "é": [9] * 5, "": [9] * 5},
}


@pytest.mark.parametrize("block", [1, 7, 512])
@pytest.mark.parametrize("name", CASES)
def test_targets_and_taken_words(frame, name, block):
    rows = documents(CASES[name])
    got = taken_words(mix(frame(SCHEMA, rows), block_words=block, rows_per_bucket=5)).collect()
    assert len(got) == len(rows)
    sizes = {s: sum(w) for s, w in CASES[name].items()}
    expected = targets(sizes)
    for source in sizes:
        members = [r for r in got if r.source == source]
        assert {r.source_size for r in members} == {sizes[source]}
        assert all(r.target == pytest.approx(expected[source]) for r in members)
        assert abs(sum(r.taken for r in members) - expected[source]) <= 0.5
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)


def test_slots_are_equal_blocks_in_low_discrepancy_order(frame):
    rows = documents({"a": [10] * 60, "b": [10] * 60, "c": [10] * 60})
    mixed = mix(frame(SCHEMA, rows), block_words=20)
    words = {}
    for r in mixed.slots.collect():
        words.setdefault((r.slot, r["_rank"]), 0)
        words[r.slot, r["_rank"]] += r.end_word - r.first_word
    assert len({slot for slot, _ in words}) == len(words)
    # Only the last block of a source may be short.
    assert sum(1 for n in words.values() if n != 20) <= 3 and max(words.values()) == 20
    # Any stretch of the mix is near the targets: 1, 2 and 3 sixths.
    early = [rank for (_, rank), _ in sorted(words.items())][:30]
    assert [abs(early.count(r) - 30 * (r + 1) / 6) < 2.5 for r in range(3)] == [True] * 3


def test_same_mix_again(frame):
    rows = documents({"a": [5, 6, 7] * 9, "b": [3] * 40})
    one, other = (taken_words(mix(frame(SCHEMA, r, p), block_words=4)) for r, p in ((rows, 2), (rows[::-1], 5)))
    columns = ("doc_id", "size", "target", "taken")
    assert sorted(one.select(*columns).collect()) == sorted(other.select(*columns).collect())


def test_texts_are_cut_after_the_last_word_taken(frame):
    rows = [(i, f"  a{i}\n b{i}\tc{i}  d{i} ", "s" if i % 2 else "t") for i in range(20)]
    mixed = mix(frame(SCHEMA, rows), block_words=3)
    taken = {r.doc_id: r.taken for r in taken_words(mixed).collect()}
    found = {}
    for r in mixed_documents(mixed).collect():
        whole = rows[r.doc_id][1]
        assert whole.startswith(r.text)
        found[r.doc_id] = found.get(r.doc_id, 0) + len(r.text.split())
    assert found == {d: n for d, n in taken.items() if n}


def test_nulls_empty_texts_repeated_rows_and_clashing_columns(frame):
    rows = [(1, None, "a", 9), (2, "", "a", 9), (3, "x y", None, 9), (3, "x y", None, 9), (None, "z", "a", 9), (5, " \n ", "b", 9)]
    got = taken_words(mix(frame("doc_id long, text string, source string, size int", rows))).collect()
    assert len(got) == 6 and sum(r.taken for r in got) == 5
    assert {r.doc_id: r["size"] for r in got} == {1: 0, 2: 0, 3: 2, None: 1, 5: 0}


@pytest.mark.parametrize("rows", [[], [(1, None, "a"), (2, "", None)]])
def test_nothing_to_mix(frame, rows):
    mixed = mix(frame(SCHEMA, rows))
    assert [(r["size"], r.taken, r.target) for r in taken_words(mixed).collect()] == [(0, 0, 0.0)] * len(rows)
    assert mixed_documents(mixed).count() == 0


def test_very_long_text_and_hot_source(frame):
    rows = [(0, "w " * 300_000, "big"), *((i, "v w x", "big" if i % 3 else f"s{i}") for i in range(1, 200))]
    got = taken_words(mix(frame(SCHEMA, rows), rows_per_bucket=20)).collect()
    by_source = {}
    for r in got:
        by_source.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert all(abs(target - taken) <= 0.5 for target, taken in by_source.values())
