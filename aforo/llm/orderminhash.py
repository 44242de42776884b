"""Order MinHash: signatures of texts that are sensitive to edit distance.

A text's k-mers are numbered by occurrence, so that equal ones differ. Each sketch ranks them by a hash
of its own, takes the least few, puts these back into text order and hashes the tuple. Two texts agree on
a sketch if they share those k-mers and have them in the same order; likeness is the share of
sketches that agree.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from aforo.llm.common import fields, importable, map_batches

#: Characters of a k-mer, k-mers of a sketch, and sketches of a fingerprint.
KMER = 8
TUPLE = 2
SKETCHES = 32
#: Characters that one range of the ordered documents is meant to hold, and the most ranges. A range is
#: sorted with spilling and streamed, so larger ones cost time, not memory.
CHARS_PER_RANGE = 24_000_000
MOST_RANGES = 4096

_BASE = 0x9E3779B97F4A7C15
_random = np.random.default_rng(20190715)
_FACTORS = _random.integers(0, 1 << 31, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POSITION_BITS = 18


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class OrderMinHash:
    """Parameters of the fingerprint: characters of a k-mer, k-mers in a tuple, sketches (at most 64)."""

    kmer: int = KMER
    tuple_size: int = TUPLE
    sketches: int = SKETCHES

    def signature(self, text: str) -> np.ndarray:
        """One 32-bit number per sketch. Texts shorter than a k-mer are one k-mer, the empty text is zeros."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        if not len(codes):
            return np.zeros(self.sketches, dtype=np.uint32)
        kmers = self._numbered(self._kmers(codes))
        # Sketches rank by the upper half of a product; 32 bits keep that fast.
        keys = (kmers >> np.uint64(32)).astype(np.uint32)
        count = min(self.tuple_size, len(keys))
        factors = _FACTORS[: self.sketches].astype(np.uint32)
        chosen = np.empty((self.sketches, count), dtype=np.int64)
        # Few enough survive this bound to be sorted, and nearly always enough.
        bound = np.uint32(min(0xFFFFFFFF, (1 << 32) // len(keys) * 8 * count))
        for s, factor in enumerate(factors):
            # The keys are spread evenly, and so are their products with an odd number.
            ranks = keys * factor
            near = (ranks <= bound).nonzero()[0]
            if len(near) < count:
                near = np.arange(len(ranks))
            least = near[ranks[near].argsort(kind="stable")[:count]]
            least.sort()
            chosen[s] = least
        out = np.arange(1, self.sketches + 1, dtype=np.uint64)
        for place in chosen.T:
            out = _mixed(out * np.uint64(_BASE) + kmers[place])
        return np.maximum((out >> np.uint64(32)).astype(np.uint32), np.uint32(1))

    def _kmers(self, codes: np.ndarray) -> np.ndarray:
        """A hash of each run of ``kmer`` characters, built from runs of doubled length."""
        if len(codes) < self.kmer:
            codes = np.concatenate([codes, np.full(self.kmer - len(codes), 0x110000, dtype=np.uint64)])
        n = len(codes) - self.kmer + 1
        found, done, base = np.zeros(n, dtype=np.uint64), 0, _BASE
        run, length = codes + np.uint64(1), 1
        while done < self.kmer:
            if (self.kmer - done) & length:
                found = found * np.uint64(pow(_BASE, length, 1 << 64)) + run[done : done + n]
                done += length
            if done < self.kmer:
                run = run[: len(run) - length] * np.uint64(base) + run[length:]
                base, length = base * base & 0xFFFFFFFFFFFFFFFF, 2 * length
        return found

    @staticmethod
    def _numbered(kmers: np.ndarray) -> np.ndarray:
        """Hashes of the k-mers together with how often each has occurred before.

        A first occurrence has the hash of its k-mer alone, whether or not others of the text are repeated.
        """
        n = len(kmers)
        spread = _mixed(kmers)
        if n < 1 << _POSITION_BITS:
            # Position in the low bits: one sort brings equal k-mers together in text order.
            low = np.uint64((1 << _POSITION_BITS) - 1)
            ordered = np.sort((spread & ~low) | np.arange(n, dtype=np.uint64))
            place, ordered = (ordered & low).astype(np.int64), ordered & ~low
        else:
            place = np.argsort(spread, kind="stable")
            ordered = spread[place]
        same = ordered[1:] == ordered[:-1]
        if not same.any():
            return spread
        begins = np.concatenate([[True], ~same])
        number = np.arange(n) - np.maximum.accumulate(np.where(begins, np.arange(n), 0))
        again = place[~begins]
        spread[again] = _mixed(spread[again] + number[~begins].astype(np.uint64) * np.uint64(_BASE))
        return spread

    def fingerprint(self, signature: np.ndarray) -> str:
        return signature.astype(">u4").tobytes().hex()

    @staticmethod
    def likeness(one: np.ndarray, other: np.ndarray) -> float:
        return float(np.mean(one == other))


def fingerprints(df: DataFrame, text: str = "text", method: OrderMinHash = OrderMinHash()) -> DataFrame:
    """The rows with ``fingerprint`` of their whole text; NULL counts as empty. No row moves."""
    kept = [c for c in df.columns if c != "fingerprint"]
    given = df.select(*(f"`{c}`" for c in kept))

    def run(batch):
        found = [method.fingerprint(method.signature(t or "")) for t in batch.column(text).to_pylist()]
        return {c: batch.column(c) for c in kept} | {"fingerprint": found}

    return map_batches(given, run, fields(given, fingerprint="string"))


def edited(text: str, following: str) -> str:
    """The text with its second half replaced by the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compared_with_next(
    df: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    method: OrderMinHash = OrderMinHash(),
    chars_per_range: int = CHARS_PER_RANGE,
) -> DataFrame:
    """Fingerprint each text, its edited text and the likeness of both, and that to the next document.

    Gives ``key``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``,
    ``near_next``. The next document is the one with the next smaller key, after the last one the first;
    NULL keys come last, rows of one key go by their text; a single row is its own next. NULL texts count as
    empty: they have the fingerprint of the empty text, which is like itself only. Columns besides text and
    key are not looked at, and an empty table gives an empty result.

    The texts move once: into ranges of keys, found from the keys alone. The first row of a range is also
    lent to the range before, whose last row needs it.
    """
    importable(df.sparkSession)
    given = df.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    cuts = _cuts(given, chars_per_range)
    ranged = given.withColumn("range", F.when(F.col("key").isNull(), F.lit(len(cuts))).otherwise(_range_of(F.col("key"), cuts, 0)))
    # One row per range: its first key, and the range before, round the end.
    firsts = ranged.groupBy("range").agg(F.max("key").alias("key")).orderBy("range").collect()
    lent = df.sparkSession.createDataFrame(
        [(f.key, firsts[i - 1].range) for i, f in enumerate(firsts)], fields(given, ["text"], to="int")
    )
    # At most MOST_RANGES rows.
    rows = ranged.join(F.broadcast(lent), ranged["key"].eqNullSafe(lent["key"]), "left").select(ranged["key"], "text", "range", "to")
    own = F.struct(F.col("range"), F.lit(False).alias("lent"))
    loan = F.struct(F.col("to").alias("range"), F.lit(True).alias("lent"))
    placed = rows.select("key", "text", F.inline(F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, loan))))
    order = ["range", "lent", F.col("key").desc_nulls_last(), "text"]
    ordered = placed.repartitionById(len(cuts) + 1, F.col("range")).sortWithinPartitions(*order)

    schema = fields(
        given,
        ["text"],
        n_chars="long",
        edited_sha256="string",
        fingerprint="string",
        edited_fingerprint="string",
        near_edited="double",
        near_next="double",
    )
    arrow = to_arrow_schema(schema)

    def run(batches):
        waiting = None  # the row that still lacks its next one: its range, key, text and signature
        for batch in batches:
            out = []
            for number, key_, text_, is_lent in zip(*(batch.column(c).to_pylist() for c in ("range", "key", "text", "lent"))):
                if waiting is None and is_lent:
                    continue  # a repeated loan
                signature = method.signature(text_)
                if waiting is not None:
                    if waiting[0] != number:
                        raise RuntimeError("a range lacks the first row of the next one")
                    out.append(_comparison(method, *waiting[1:], text_, signature))
                waiting = None if is_lent else (number, key_, text_, signature)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow.types)], schema=arrow)

    return ordered.mapInArrow(run, schema).withColumnRenamed("key", key)


def _cuts(given: DataFrame, chars_per_range: int) -> list:
    """Keys that cut the rows, largest key first, into ranges of about ``chars_per_range`` characters."""
    chars = given.agg(F.sum(F.length("text"))).first()[0] or 0
    ranges = min(MOST_RANGES, chars // chars_per_range)
    if ranges < 2:
        return []
    shares = [i / ranges for i in range(1, ranges)]
    found = given.agg(F.percentile_approx("key", shares, 100 * ranges)).first()[0] or []
    return sorted(set(found), reverse=True)


def _range_of(key: Column, cuts: list, first: int) -> Column:
    """How many cuts lie at or above the key, by halving."""
    if not cuts:
        return F.lit(first)
    middle = len(cuts) // 2
    above = _range_of(key, cuts[:middle], first)
    below = _range_of(key, cuts[middle + 1 :], first + middle + 1)
    return F.when(key > F.lit(cuts[middle]), above).otherwise(below)


def _comparison(method: OrderMinHash, key, text: str, signature: np.ndarray, following: str, next_signature: np.ndarray) -> tuple:
    changed = edited(text, following)
    changed_signature = method.signature(changed)
    return (
        key,
        len(text),
        hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
        method.fingerprint(signature),
        method.fingerprint(changed_signature),
        method.likeness(signature, changed_signature),
        method.likeness(signature, next_signature),
    )
