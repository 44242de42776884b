"""Near-duplicate documents by one-permutation hashing with optimal densification.

A document's word shingles are hashed once. The hash range is cut into bins, each bin keeps its least
hash, and an empty bin takes the value of the first filled one in a random order of its own. Bands
of bins make buckets. Documents with the same set are one class, for which only one set enters the buckets.

In a bucket, candidates are not all pairs but a star around one class, and every candidate is
confirmed on the full sets. A star finds no link between two classes of which neither is its centre. So
where confirmed links leave several components in a bucket, its classes are matched exactly: in an
order that puts rare shingles first, two similar sets have one of their first few in common, and pairs that do, in
different components, are confirmed too. No bucket is capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aforo.llm.common import fields, kept_by_worker, map_batches
from aforo.llm.components import components
from aforo.sources.scratch import stored

#: Bins (a power of two), and bins in a band. At a similarity of 0.8 all 51 bands miss once in 10**8.
BINS = 256
BAND = 5
SHINGLE_WORDS = 5
#: Links have at least so many shingles in common, in percent of their union.
PERCENT = 80
#: Slots of the filter that spares texts without candidates the join.
FILTER_SLOTS = 1 << 20
#: Counters for how common shingles are: 2 to this power, whatever the number of documents.
COUNTER_BITS = 20

#: Bytes of text that are hashed together; each takes some 50 bytes meanwhile.
SLICE = 1 << 18

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_random = np.random.default_rng(20240607)
_LETTERS = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
# A-Z count as a-z.
_LETTERS[65:91] = _LETTERS[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
# For each bin, the order in which it looks for a filled one.
_DETOURS = np.array([_random.permutation(BINS) for _ in range(BINS)])


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Shingle sets as sorted distinct 64-bit hashes.

    A word's hash adds up a number for each letter at its place, mixed of both. A polynomial in the place
    would do with one product, but modulo a power of two some long words collide in every base.
    """

    def __init__(self, words: int):
        self._words = words

    def sets(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The set of each text; a NULL text, or one without words, has none."""
        group: list[bytes] = []
        size = 0
        for text in texts:
            group.append((text or "").encode("utf-8", "surrogatepass"))
            size += len(group[-1]) + 1
            if size >= SLICE:
                yield from self._slice(group)
                group, size = [], 0
        if group:
            yield from self._slice(group)

    def _slice(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        blank = _SPACE[raw]
        edge = np.diff(np.concatenate([[True], blank]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        letters = raw[~blank]
        sizes = ends - starts
        upto = np.cumsum(sizes)
        places = np.arange(len(letters)) - np.repeat(upto - sizes, sizes)
        words = _mixed(np.add.reduceat(_mixed(_LETTERS[letters] + places.astype(np.uint64) * np.uint64(_BASE)), upto - sizes)) if len(starts) else letters.astype(np.uint64)
        # The first word of each text.
        lengths = np.array([len(t) + 1 for t in texts])
        first = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))
        k = self._words
        rolled = np.zeros(max(0, len(words) - k + 1), dtype=np.uint64)
        for j in range(k):
            rolled = rolled * np.uint64(_BASE) + words[j : j + len(rolled)]
        rolled = _mixed(rolled)
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= k:
                found = np.sort(rolled[a : b - k + 1])
                yield found[np.concatenate([[True], found[1:] != found[:-1]])]
            elif b > a:
                whole = int(b - a)
                for word in words[a:b].tolist():
                    whole = (whole * _BASE + word) & _MASK
                yield _mixed(np.array([whole], dtype=np.uint64))
            else:
                yield rolled[:0]


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """Bucket keys of non-empty sets: one row per set, one column per band."""
    signature = np.zeros((len(sets), BINS), dtype=np.uint64)
    filled = np.zeros((len(sets), BINS), dtype=bool)
    shift = np.uint64(64 - BINS.bit_length() + 1)
    for i, found in enumerate(sets):
        # The set is sorted, so a bin's least hash is its first.
        place = (found >> shift).astype(np.int64)
        first = np.concatenate([[True], place[1:] != place[:-1]])
        signature[i, place[first]] = found[first]
        filled[i, place[first]] = True
    for i in np.flatnonzero(~filled.all(axis=1)):
        empty = np.flatnonzero(~filled[i])
        detours = _DETOURS[empty]
        source = detours[np.arange(len(empty)), filled[i][detours].argmax(axis=1)]
        signature[i, empty] = signature[i, source]
    usable = BINS // BAND * BAND
    grouped = signature[:, :usable].reshape(len(sets), BINS // BAND, BAND)
    keys = np.arange(grouped.shape[1], dtype=np.uint64)[None, :] + np.uint64(1)
    for j in range(BAND):
        keys = _mixed(keys * np.uint64(_BASE) + grouped[:, :, j])
    return keys


def _shingler(words: int) -> Shingler:
    return kept_by_worker(("neardup", words), lambda: Shingler(words))


def _digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def signatures(df: DataFrame, words: int, text: str, key: str) -> DataFrame:
    """``key``, ``n_shingles``, ``node`` (digest of the set, NULL when empty) and ``bands`` of each row."""
    given = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("_text"))

    def run(batch):
        counts, nodes, keys = [], [], []
        group: list[np.ndarray] = []

        def flush() -> None:
            rows = iter(bands([s for s in group if len(s)]).view(np.int64))
            keys.extend(next(rows) if len(s) else None for s in group)
            group.clear()

        for found in _shingler(words).sets(batch.column("_text").to_pylist()):
            counts.append(len(found))
            nodes.append(_digest(found) if len(found) else None)
            group.append(found)
            if len(group) == 256:
                flush()
        flush()
        return {"key": batch.column("key"), "n_shingles": counts, "node": nodes, "bands": keys}

    schema = fields(given, ["_text"], n_shingles="long", node="binary", bands="array<long>")
    return map_batches(given, run, schema)


def _candidate_sets(df: DataFrame, classes: DataFrame, wanted: DataFrame, words: int, text: str, key: str) -> DataFrame:
    """``id``, ``set`` (its hashes as bytes) and ``counts`` (hashes by their leading byte) of the wanted classes.

    Texts do not move: a table of ``FILTER_SLOTS`` bits, whatever the number of classes, tells the scan which
    rows may be wanted, and only their sets go into the join.
    """
    chosen = classes.join(wanted, "id", "left_semi").select("id", "node", "label")
    slot = F.pmod(F.xxhash64("label"), F.lit(FILTER_SLOTS))
    used = np.zeros(FILTER_SLOTS, dtype=bool)
    used[chosen.select(slot.alias("slot")).distinct().toArrow()["slot"].to_numpy()] = True
    given = df.select(F.col(f"`{key}`").alias("label"), F.col(f"`{text}`").alias("_text")).withColumn("_slot", slot)

    def run(batch):
        maybe = batch.filter(pa.array(used[batch.column("_slot").to_numpy(zero_copy_only=False)]))
        sets = list(_shingler(words).sets(maybe.column("_text").to_pylist()))
        full = [i for i, s in enumerate(sets) if len(s)]
        out = {"label": maybe.column("label").take(pa.array(full, pa.int64()))}
        out |= {"node": [_digest(sets[i]) for i in full], "set": [sets[i].tobytes() for i in full]}
        return out | {"counts": [_counts(sets[i]) for i in full]}

    found = map_batches(given, run, fields(given, ["_text", "_slot"], node="binary", set="binary", counts="binary"))
    same = found["label"].eqNullSafe(chosen["label"]) & (found["node"] == chosen["node"])
    # An id that stands for several texts brings them all; the digest tells which is meant.
    return found.join(chosen, same).select("id", "set", "counts").dropDuplicates(["id"])


def _counts(found: np.ndarray) -> bytes:
    """Hashes by leading byte; empty, which bounds nothing, if they do not fit into 16 bits."""
    counts = np.bincount((found >> np.uint64(56)).astype(np.int64), minlength=256)
    return counts.astype(np.uint16).tobytes() if counts.max() < 1 << 16 else b""


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) whose sets are similar enough.

    Counts by leading byte bound what two sets can share; the sets themselves join only pairs that pass.
    """
    ends = T.StructType([T.StructField(c, pairs.schema[c].dataType) for c in ("a", "b")])

    def passing(enough):
        def run(batch):
            links = []
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "_a", "_b"))):
                if enough(x, y):
                    links.append((a, b))
            return {"a": [p[0] for p in links], "b": [p[1] for p in links]}

        return run

    def with_both(rows: DataFrame, column: str) -> DataFrame:
        one = sets.select(F.col("id").alias("a"), F.col(column).alias("_a"))
        other = sets.select(F.col("id").alias("b"), F.col(column).alias("_b"))
        return rows.select("a", "b").join(other, "b").join(one, "a").select("a", "b", "_a", "_b")

    def may_be(x: bytes, y: bytes) -> bool:
        if not x or not y:
            return True
        p, q = np.frombuffer(x, np.uint16).astype(np.int64), np.frombuffer(y, np.uint16).astype(np.int64)
        common = int(np.minimum(p, q).sum())
        return 100 * common >= percent * (int(p.sum()) + int(q.sum()) - common)

    def are(x: bytes, y: bytes) -> bool:
        both = np.sort(np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)]))
        common = int((both[1:] == both[:-1]).sum())
        return 100 * common >= percent * (len(both) - common)

    likely = map_batches(with_both(pairs, "counts"), passing(may_be), ends)
    return map_batches(with_both(likely, "set"), passing(are), ends)


def near_duplicates(
    df: DataFrame,
    words: int = SHINGLE_WORDS,
    percent: int = PERCENT,
    text: str = "text",
    key: str = "doc_id",
    scratch: str | None = None,
) -> DataFrame:
    """``key``, ``n_shingles``, ``component_id``, ``kept`` for every row.

    Words are what stands between ASCII white space, A-Z lower-cased; the set holds all runs of
    ``words`` words, or the whole sequence of a shorter text. Rows whose sets have at least ``percent``
    percent of their union in common are linked, and ``component_id`` is the least id within reach. A NULL
    text, or one without words, has an empty set and its own id. ``kept`` says that the row's id is the
    component's; rows that repeat an id are alike in that. NULL ids count as larger than all others.
    An empty table gives an empty result; columns besides text and key are not looked at.
    """
    spark = df.sparkSession
    rows = stored(signatures(df, words, text, key), "neardup-rows", scratch)
    classes = (
        rows.filter("node IS NOT NULL")
        .groupBy("node")
        .agg(F.min("key").alias("label"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
        .withColumn("id", F.monotonically_increasing_id())
    )
    classes = stored(classes, "neardup-classes", scratch)
    buckets = classes.select("id", F.explode("bands").alias("bucket"))
    stars = buckets.groupBy("bucket").agg(F.min("id").alias("centre"))
    edges = stored(buckets.join(stars, "bucket").filter("id != centre"), "neardup-edges", scratch)

    sizes = classes.select("id", "n")
    centres = classes.select(F.col("id").alias("centre"), F.col("n").alias("_n"))
    similar = F.least("n", "_n") * 100 >= F.greatest("n", "_n") * percent
    pairs = edges.groupBy("centre", "id").agg(F.count(F.lit(1)).alias("buckets")).join(sizes, "id").join(centres, "centre").filter(similar)
    pairs = stored(pairs.select(F.col("centre").alias("a"), F.col("id").alias("b"), "buckets"), "neardup-pairs", scratch)
    ends = edges.select("id").union(edges.select("centre")).distinct()
    sets = stored(_candidate_sets(df, classes, ends, words, text, key), "neardup-sets", scratch)

    # The strongest candidate of each class first: it connects most, and spares the others their test.
    best = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("buckets"), "a")) == 1
    first = pairs.withColumn("_best", best).filter("_best").select("a", "b")
    tree = components(_confirmed(first, sets, percent), scratch)
    tree = _joined(tree, _confirmed(_across(pairs.join(first, ["a", "b"], "left_anti"), tree), sets, percent), scratch)

    still = stored(_open_classes(edges, tree), "neardup-open", scratch)
    if not still.isEmpty():
        more = _prefix_pairs(still.join(sets, "id"), percent, scratch).join(pairs, ["a", "b"], "left_anti")
        tree = _joined(tree, _confirmed(stored(more, "neardup-pairs", scratch), sets, percent), scratch)

    belongs = classes.select("id", "node", "label").join(tree.select(F.col("u").alias("id"), F.col("v").alias("root")), "id", "left")
    belongs = stored(belongs.select("node", "label", F.coalesce("root", "id").alias("root")), "neardup-tree", scratch)
    least = belongs.groupBy("root").agg(F.min("label").alias("component"))
    labelled = belongs.join(least, "root").select("node", "component")
    component = F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("component"))
    return rows.join(labelled, "node", "left").select(
        F.col("key").alias(key),
        "n_shingles",
        component.alias("component_id"),
        F.col("key").eqNullSafe(component).alias("kept"),
    )


def _joined(tree: DataFrame, links: DataFrame, scratch: str | None) -> DataFrame:
    """The components after further links."""
    found = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "neardup-links", scratch)
    return tree if found.isEmpty() else components(tree.unionByName(found), scratch)


def _root(rows: DataFrame, tree: DataFrame, node: str, name: str) -> DataFrame:
    """Add the root of a column's component."""
    known = tree.select(F.col("u").alias(node), F.col("v").alias("_root"))
    return rows.join(known, node, "left").withColumn(name, F.coalesce("_root", node)).drop("_root")


def _across(pairs: DataFrame, tree: DataFrame) -> DataFrame:
    """The pairs that lie in different components."""
    return _root(_root(pairs, tree, "a", "_ra"), tree, "b", "_rb").filter("_ra != _rb").select("a", "b")


def _open_classes(edges: DataFrame, tree: DataFrame) -> DataFrame:
    """``id`` and ``root`` of the classes in buckets that hold more than one component."""
    rooted = _root(_root(edges, tree, "id", "root"), tree, "centre", "centre_root")
    mixed = rooted.filter("root != centre_root").select("bucket").distinct()
    inside = rooted.join(mixed, "bucket", "left_semi")
    return inside.select("id", "root").union(inside.select("centre", "centre_root")).distinct()


def _prefix_pairs(rows: DataFrame, percent: int, scratch: str | None) -> DataFrame:
    """All pairs (``a``, ``b``) of different components that can be similar enough, from ``id``, ``root``, ``set``.

    Similar sets share so much that, in any common order of shingles, they have one in common among the first
    ``n - ceil(percent * n / 100) + 1`` of each, and from the first such one on enough is left of both. The
    order is by how common a shingle is, as counted in a fixed number of counters: ties and shared counters
    make it coarser, never wrong.
    """
    shift = np.uint64(64 - COUNTER_BITS)

    def count(batch):
        found = np.zeros(1 << COUNTER_BITS, dtype=np.int64)
        for blob in batch.column("set").to_pylist():
            np.add.at(found, (_mixed(np.frombuffer(blob, np.uint64)) >> shift).astype(np.int64), 1)
        used = np.flatnonzero(found)
        return {"counter": used, "n": found[used]}

    counted = map_batches(rows.select("set"), count, T.StructType([T.StructField(c, T.LongType()) for c in ("counter", "n")]))
    common = np.zeros(1 << COUNTER_BITS, dtype=np.int64)
    # So many numbers at most come to the driver and go to the workers.
    totals = counted.groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    common[totals["counter"].to_numpy()] = totals["n"].to_numpy()

    def prefix(batch):
        firsts, sizes = [], []
        for blob in batch.column("set").to_pylist():
            found = np.frombuffer(blob, np.uint64)
            order = np.lexsort((found, common[(_mixed(found) >> shift).astype(np.int64)]))
            sizes.append(len(found))
            firsts.append(found[order[: len(found) - -(-percent * len(found) // 100) + 1]].view(np.int64))
        lengths = [len(f) for f in firsts]
        repeated = {c: np.repeat(batch.column(c).to_numpy(), lengths) for c in ("id", "root")}
        place = np.concatenate([np.arange(n) for n in lengths])
        return {"shingle": np.concatenate(firsts), **repeated, "n": np.repeat(sizes, lengths), "place": place}

    kinds = T.StructType([T.StructField(c, T.LongType()) for c in ("shingle", "id", "root", "n", "place")])
    firsts = stored(map_batches(rows.select("id", "root", "set"), prefix, kinds), "neardup-prefix", scratch)
    one, other = (firsts.select(*(F.col(c).alias(f"{c}{i}") for c in firsts.columns)) for i in (1, 2))
    left = F.least(F.col("n1") - F.col("place1"), F.col("n2") - F.col("place2"))
    enough = left * (100 + percent) >= percent * (F.col("n1") + F.col("n2"))
    met = one.join(other, F.col("shingle1") == F.col("shingle2")).filter((F.col("id1") < F.col("id2")) & (F.col("root1") != F.col("root2")) & enough)
    return met.select(F.col("id1").alias("a"), F.col("id2").alias("b")).distinct()
