import pytest
from pyspark.sql import functions as F

from aforo.llm import sharding
from aforo.llm.sharding import shard_by_bytes, write_shards

SCHEMA = "doc_id long, text string"


def shards_of(rows):
    found = {}
    for r in rows:
        found.setdefault(r["shard"], []).append(r)
    return found


def check(rows, shards, largest=None):
    """Gapless slots, exact sizes, and shards that differ by no more than a document at each end."""
    for members in shards_of(rows).values():
        assert sorted(r["slot"] for r in members) == list(range(len(members)))
    for r in rows:
        assert r["size"] == len((r["text"] or "").encode()) + 1
    total = sum(r["size"] for r in rows)
    most = max(r["size"] for r in rows) if largest is None else largest
    for members in shards_of(rows).values():
        assert abs(sum(r["size"] for r in members) - total / shards) <= most + 0.01 * total / shards


def test_against_brute_force(frame):
    rows = [(i, "x" * (i * 37 % 101)) for i in range(500)]
    got = shard_by_bytes(frame(SCHEMA, rows), 8, rows_per_bucket=20).collect()
    assert sorted(r.doc_id for r in got) == list(range(500))
    check(got, 8)
    # Slots and shards follow one order of (hash of the text, hash of the id).
    keys = frame(SCHEMA, rows).select("doc_id", F.xxhash64("text").alias("h"), F.xxhash64("doc_id").alias("u")).collect()
    order = {r.doc_id: (r.h, r.u) for r in keys}
    placed = [order[r.doc_id] for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert placed == sorted(placed)


def test_hot_text_is_split(frame):
    """A third of all rows hold one text."""
    rows = [(i, "hot text " * 5 if i % 3 == 0 else f"text {i}" * 5) for i in range(3000)]
    got = shard_by_bytes(frame(SCHEMA, rows), 8, rows_per_bucket=100).collect()
    check(got, 8)
    assert sum(len({r.doc_id for r in s}) for s in shards_of(got).values()) == 3000
    assert len(shards_of(got)) == 8


@pytest.mark.parametrize("hot", ["hot text", "", None])
@pytest.mark.parametrize("per_bucket, shards", [(100, 2), (200, 1), (1000, 3)])
def test_hot_text_amid_others_meets_in_no_bucket(frame, monkeypatch, hot, per_bucket, shards):
    """Half of all rows hold one text, other texts share its cell."""
    buckets = []

    def seen(df, group, bucket, *rest):
        buckets.append(df.groupBy(*group, *bucket).count().agg(F.max("count")).first()[0])
        return running_sum(df, group, bucket, *rest)

    running_sum = sharding.running_sum
    monkeypatch.setattr(sharding, "running_sum", seen)
    rows = [(i, hot if i % 2 else f"text {i}") for i in range(6000)]
    df = frame(SCHEMA, rows)
    got = shard_by_bytes(df, shards, rows_per_bucket=per_bucket).collect()
    assert buckets[0] <= 2 * per_bucket
    check(got, shards)
    keys = {r.doc_id: (r.h, r.u) for r in df.select("doc_id", F.xxhash64("text").alias("h"), F.xxhash64("doc_id").alias("u")).collect()}
    placed = [keys[r.doc_id] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert placed == sorted(placed) and len(placed) == 6000


def test_equal_texts_stay_together_where_they_can(frame):
    rows = [(i, f"text {i // 4} " * 40) for i in range(4000)]
    got = shard_by_bytes(frame(SCHEMA, rows), 8).collect()
    places = {}
    for r in got:
        places.setdefault(r.text, set()).add(r.shard)
    assert all(len(s) == 1 for s in places.values())
    check(got, 8)


def test_same_result_again(frame):
    rows = [(i, f"t{i % 50}") for i in range(300)]
    one = shard_by_bytes(frame(SCHEMA, rows, 2), 4, rows_per_bucket=30).collect()
    other = shard_by_bytes(frame(SCHEMA, rows[::-1], 5), 4, rows_per_bucket=30).collect()
    assert sorted(one) == sorted(other)


def test_nulls_empty_and_repeated_rows(frame):
    rows = [(1, None), (2, ""), (None, "a"), (3, "b"), (3, "b"), (None, None), (None, None)]
    got = shard_by_bytes(frame(SCHEMA, rows), 2).collect()
    assert len(got) == 7 and sum(r["size"] for r in got) == 10
    check(got, 2)


@pytest.mark.parametrize("rows", [[], [(1, "only")]])
def test_few_rows(frame, rows):
    got = shard_by_bytes(frame(SCHEMA, rows), 8).collect()
    assert len(got) == len(rows) and all(0 <= r["shard"] < 8 for r in got)


def test_very_long_text(frame):
    rows = [(0, "z" * 2_000_000), *((i, "s") for i in range(1, 200))]
    got = shard_by_bytes(frame(SCHEMA, rows), 4).collect()
    assert len(got) == 200
    check(got, 4)


def test_clashing_columns_and_files(frame, spark, tmp_path):
    df = frame("doc_id long, text string, size string, shard string, `a.b` int", [(i, "x" * i, "s", "t", i) for i in range(40)])
    got = shard_by_bytes(df, 4)
    assert got.columns == ["doc_id", "text", "a.b", "size", "shard", "slot"]
    write_shards(got, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 40 and back.select("shard").distinct().count() == 4
