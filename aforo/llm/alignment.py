"""Tokens of two tokenizers aligned by the bytes that they cover.

Both tokenizers spell the same bytes, so each is a rising list of token ends. Merging the two lists in order
cuts the bytes into stretches in which one token of either covers the other: the overlaps. Where both have a token
end, a group of tokens closes, and the two tokens that end there are linked.

The merge is divided by merge paths: on evenly spaced diagonals of the grid of the two lists, a binary search
finds how many ends of either come first. What lies between two diagonals is a piece of equal work
that needs nothing of the others, whatever the lengths of the texts. Pieces emit their overlaps; a group that
is open at the edge of a piece is stitched to what the next one begins with.

How often two tokens are linked in the whole corpus is counted by Spark. Counts of few different pairs are sent to
the tasks; of more, the pairs are joined, the frequent ones, whose number is bounded, apart from the others.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aforo.llm.bpe import Vocabulary
from aforo.llm.byteids import ByteEncoder
from aforo.llm.common import fields, importable, kept_by_worker, map_batches, slices
from aforo.sources.scratch import stored

#: Ends in a piece of the merge.
PIECE = 1 << 16
#: Characters from which a text goes to the second tokenizer in parts.
PART = 1 << 15
#: Different pairs whose counts are sent to the tasks, 16 bytes each.
MOST_PAIRS = 2_000_000
#: A pair with a larger share of all links than one in so many is joined apart; there are no more such pairs than this.
FREQUENT = 10_000
#: Pairs that a task adds up before it hands them on.
PAIRS_AT_ONCE = 2_000_000

# Fixed value: how the second vocabulary writes a space.
_SPACE = "▁"


# --- Tokens ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Pieces:
    """A sentencepiece model as it is stored in its file, and the bytes of its pieces by id."""

    model: bytes
    spelled: tuple[bytes, ...]

    @staticmethod
    def load(path: str) -> Pieces:
        """Read on the driver and shipped. A piece that goes on after a space inside would forbid cutting long texts."""
        with open(path, "rb") as file:
            model = file.read()
        processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        spelled = []
        for i in range(processor.get_piece_size()):
            piece = processor.id_to_piece(i)
            if re.search(f"[^{_SPACE}]{_SPACE}", piece):
                raise ValueError(f"{path} has a piece that a space does not begin")
            spelled.append(bytes([int(piece[3:-1], 16)]) if processor.is_byte(i) else piece.replace(_SPACE, " ").encode())
        return Pieces(model, tuple(spelled))


class _Tokens:
    """Bytes of tokens by id."""

    def __init__(self, spelled: dict[int, bytes]):
        self.spelled = [spelled.get(i, b"") for i in range(max(spelled) + 1)]
        self.lengths = np.array([len(s) for s in self.spelled], dtype=np.int64)

    def spells(self, ids: np.ndarray, expected: bytes) -> bool:
        return int(self.lengths[ids].sum()) == len(expected) and b"".join(map(self.spelled.__getitem__, ids.tolist())) == expected


class Tokenizers:
    """Both tokenizers; one pair per worker."""

    # Between a character and a word: no token of the second reaches across, and each part begins with a space.
    _CUT = re.compile(r"(?<=[^ ]) (?=[^ ])")

    def __init__(self, vocabulary: Vocabulary, pieces: Pieces):
        self._first = ByteEncoder(vocabulary, special=False)
        self._second = sentencepiece.SentencePieceProcessor(model_proto=pieces.model)
        self.first = _Tokens(vocabulary.tokens)
        self.second = _Tokens(dict(enumerate(pieces.spelled)))

    def parts(self, text: str) -> list[str]:
        """The text in parts for the second tokenizer, which puts a space before each."""
        parts, begin = [], 0
        while len(text) - begin > PART and (cut := self._CUT.search(text, begin + PART)):
            parts.append(text[begin : cut.start()])
            begin = cut.end()
        return [*parts, text[begin:]]

    def ids(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both; none where the bytes of one of them are not a space and the text."""
        none = np.empty(0, dtype=np.int64)
        if not text:
            return none, none
        expected = b" " + text.encode("utf-8", "surrogatepass")
        second = np.array([i for ids in self._second.encode(self.parts(text), num_threads=1) for i in ids], dtype=np.int64)
        if not self.second.spells(second, expected):
            return none, none
        first = self._first.ids(f" {text}").astype(np.int64)
        return (first, second) if self.first.spells(first, expected) else (none, none)


# --- The merge ------------------------------------------------------------------------------------


def crossing(x: np.ndarray, y: np.ndarray, diagonal: int) -> tuple[int, int]:
    """How many of the first ``diagonal`` ends come from either list; equal ends are not parted."""
    low, high = max(0, diagonal - len(y)), min(diagonal, len(x))
    while low < high:
        middle = (low + high) // 2
        if x[middle] <= y[diagonal - middle - 1]:
            low = middle + 1
        else:
            high = middle
    other = diagonal - low
    return low, other + int(low > 0 and other < len(y) and x[low - 1] == y[other])


def merged_piece(x: np.ndarray, y: np.ndarray, begin: tuple[int, int], end: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlaps that end in the piece: the positions of both tokens, and whether both end there."""
    one, other = x[begin[0] : end[0]], y[begin[1] : end[1]]
    ends = np.concatenate([one, other])
    ends.sort(kind="stable")
    ends = ends[np.concatenate([[True], ends[1:] != ends[:-1]])] if len(ends) else ends
    a, b = np.searchsorted(one, ends), np.searchsorted(other, ends)
    closes = np.zeros(len(ends), dtype=bool)
    inside = (a < len(one)) & (b < len(other))
    closes[inside] = one[a[inside]] == other[b[inside]]
    return a + begin[0], b + begin[1], closes


@dataclass(frozen=True)
class Aligned:
    """The overlaps of two token lists, and the positions of the tokens that end each group."""

    a: np.ndarray
    b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray


def align_ends(x: np.ndarray, y: np.ndarray, piece: int = PIECE) -> Aligned:
    """Overlaps and groups of two rising lists of ends that share the last."""
    total = len(x) + len(y)
    corners = [crossing(x, y, min(d, total)) for d in range(0, total + piece, piece)]
    pieces = [merged_piece(x, y, begin, end) for begin, end in zip(corners, corners[1:])]
    a, b, closes = (np.concatenate([p[i] for p in pieces]) if pieces else np.empty(0, np.int64) for i in range(3))
    # A group goes on until one closes, in whichever piece that is.
    closing = np.flatnonzero(closes)
    return Aligned(a, b, a[closing], b[closing])


@dataclass(frozen=True)
class Batch:
    """Texts one after the other: ids of both, where each text's tokens and groups begin, and their alignment."""

    first: np.ndarray
    second: np.ndarray
    first_at: np.ndarray
    second_at: np.ndarray
    group_at: np.ndarray
    aligned: Aligned

    @property
    def pairs(self) -> np.ndarray:
        """The ids of each link, the first in the upper 32 bits."""
        return self.first[self.aligned.group_a] << 32 | self.second[self.aligned.group_b]


def _joined(lists: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.empty(0, np.int64), *lists]), np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)


def align_texts(tokenizers: Tokenizers, texts: Sequence[str | None]) -> Batch:
    """All texts as one merge: a text's end is an end of both, so no group reaches into the next."""
    both = [tokenizers.ids(t) for t in texts]
    (first, first_at), (second, second_at) = (_joined([ids[i] for ids in both]) for i in (0, 1))
    x, y = np.cumsum(tokenizers.first.lengths[first]), np.cumsum(tokenizers.second.lengths[second])
    aligned = align_ends(x, y)
    return Batch(first, second, first_at, second_at, np.searchsorted(aligned.group_a, first_at), aligned)


class _Writer:
    """Groups as text: ids with what follows them, by id and place in the group."""

    def __init__(self, first: int, second: int):
        ends = [[f"{i},", f"{i}|"] for i in range(first)], [[f"{i},", f"{i};"] for i in range(second)]
        self._first, self._second = (np.array(e, dtype=object).ravel() for e in ends)

    def digests(self, batch: Batch) -> list[str]:
        """SHA-256 of ``a1,a2|b1;a3|b2,b3`` for each text; empty without tokens."""
        a, b = batch.aligned.group_a, batch.aligned.group_b
        last_a, last_b = np.zeros(len(batch.first), np.int64), np.zeros(len(batch.second), np.int64)
        last_a[a] = last_b[b] = 1
        # A token stands behind the tokens of its own list and those of the other's groups before (or up to) its own.
        group_of_a, group_of_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        before_b, upto_a = np.concatenate([[0], b + 1]), a + 1
        written = np.empty(len(batch.first) + len(batch.second), dtype=object)
        written[np.arange(len(batch.first)) + before_b[group_of_a]] = self._first[batch.first * 2 + last_a]
        written[np.arange(len(batch.second)) + upto_a[group_of_b]] = self._second[batch.second * 2 + last_b]
        edges = batch.first_at + batch.second_at
        texts = ("".join(written[i:j].tolist())[:-1] for i, j in zip(edges, edges[1:]))
        return [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts]


class _Worker:
    def __init__(self, vocabulary: Vocabulary, pieces: Pieces):
        self.tokenizers = Tokenizers(vocabulary, pieces)
        self.writer = _Writer(len(self.tokenizers.first.spelled), len(self.tokenizers.second.spelled))


def _worker(vocabulary: Vocabulary, pieces: Pieces) -> _Worker:
    return kept_by_worker(("alignment", hash(vocabulary.merges), hash(pieces.model)), lambda: _Worker(vocabulary, pieces))


# --- Spark ----------------------------------------------------------------------------------------


def align(df: DataFrame, vocabulary: Vocabulary, pieces: Pieces, text: str = "text") -> DataFrame:
    """The rows with ``a_ids`` and ``b_ids``, and, as positions in these counted from 0, ``overlap_a`` and ``overlap_b``
    (the tokens of each overlap, in order) and ``group_a`` and ``group_b`` (the last tokens of each group).

    A text that is NULL or empty, or that one of the tokenizers does not give back, has empty lists. Rows are
    aligned each, also repeated ones; columns of these names are replaced, others but the text carried along.
    An empty table gives an empty result. Texts of any length are read whole. No row moves.
    """
    names = ("a_ids", "b_ids", "overlap_a", "overlap_b", "group_a", "group_b")
    kept = [c for c in df.columns if c not in names and c != text]
    given = df.select(*(f"`{c}`" for c in kept), df[f"`{text}`"].alias("_text"))

    def run(batch):
        found = align_texts(_worker(vocabulary, pieces).tokenizers, batch.column("_text").to_pylist())
        first_at, second_at, aligned = found.first_at, found.second_at, found.aligned
        overlap_at = np.searchsorted(aligned.a, first_at)
        columns = [
            (found.first, first_at, None),
            (found.second, second_at, None),
            (aligned.a, overlap_at, first_at),
            (aligned.b, overlap_at, second_at),
            (aligned.group_a, found.group_at, first_at),
            (aligned.group_b, found.group_at, second_at),
        ]
        out = {c: batch.column(c) for c in kept}
        for name, (values, at, origin) in zip(names, columns):
            if origin is not None:
                values = values - np.repeat(origin[:-1], np.diff(at))
            out[name] = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.astype(np.int32)))
        return out

    return map_batches(given, run, fields(given, ["_text"], **dict.fromkeys(names, "array<int>")))


def _linked(df: DataFrame, vocabulary: Vocabulary, pieces: Pieces) -> DataFrame:
    """Sizes and digest of each row, and ``_pairs`` and ``_times``: its different pairs and how often each is linked."""
    kinds = {"n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups_sha256": "string"}
    kinds |= {"_pairs": "array<long>", "_times": "array<int>"}

    def run(batch):
        worker = _worker(vocabulary, pieces)
        found = align_texts(worker.tokenizers, batch.column("_text").to_pylist())
        groups = np.diff(found.group_at)
        out = {"_key": batch.column("_key"), "n_a": np.diff(found.first_at), "n_b": np.diff(found.second_at), "n_groups": groups, "n_links": groups}
        pairs, at = found.pairs, found.group_at
        counted = [np.unique(pairs[i:j], return_counts=True) for i, j in zip(at, at[1:])]
        out |= {"groups_sha256": worker.writer.digests(found), "_pairs": [c[0] for c in counted], "_times": [c[1].astype(np.int32) for c in counted]}
        return out

    return map_batches(df, run, fields(df, ["_text"], **kinds))


def _added(pairs: Sequence[np.ndarray], times: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs in order, and the sums of their times."""
    all_pairs, all_times = np.concatenate(pairs), np.concatenate(times)
    order = np.argsort(all_pairs, kind="stable")
    all_pairs, all_times = all_pairs[order], all_times[order]
    starts = np.flatnonzero(np.concatenate([[True], all_pairs[1:] != all_pairs[:-1]])) if len(all_pairs) else np.empty(0, np.int64)
    return all_pairs[starts], np.add.reduceat(all_times, starts) if len(starts) else all_times


def pair_counts(linked: DataFrame) -> DataFrame:
    """``pair``, ``n`` (its links in all rows) and ``best`` (whether no pair of the same second id has more)."""
    importable(linked.sparkSession)
    arrow = pa.schema([("pair", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, times, held = [], [], 0
        for batch in batches:
            for part in slices(batch):
                pairs.append(part.column("_pairs").flatten().to_numpy())
                times.append(part.column("_times").flatten().to_numpy().astype(np.int64))
                held += len(pairs[-1])
                if held > PAIRS_AT_ONCE:
                    pairs, times = ([x] for x in _added(pairs, times))
                    held = len(pairs[0])
                    if held > PAIRS_AT_ONCE // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(times[0])], schema=arrow)
                        pairs, times, held = [], [], 0
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _added(pairs, times)], schema=arrow)

    schema = T.StructType([T.StructField("pair", T.LongType()), T.StructField("n", T.LongType())])
    counts = linked.select("_pairs", "_times").mapInArrow(run, schema).groupBy("pair").agg(F.sum("n").alias("n"))
    second = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    # As many rows as the second vocabulary has ids.
    most = counts.groupBy(second.alias("_second")).agg(F.max("n").alias("_most"))
    return counts.join(most, second == F.col("_second")).select("pair", "n", (F.col("n") == F.col("_most")).alias("best"))


def _sums_by_lookup(linked: DataFrame, counts: DataFrame) -> DataFrame:
    """``n_best`` and ``count_sum`` of each row from the whole table of counts, sent to the tasks."""
    table = counts.orderBy("pair").toArrow()
    known, n = table["pair"].to_numpy(), table["n"].to_numpy()
    best = table["best"].to_numpy().astype(np.int64)
    kept = [c for c in linked.columns if c not in ("_pairs", "_times")]

    def run(batch):
        pairs, times = batch.column("_pairs"), batch.column("_times").flatten().to_numpy().astype(np.int64)
        at = np.concatenate([[0], np.cumsum(pairs.value_lengths().to_numpy())])
        place = np.searchsorted(known, pairs.flatten().to_numpy())

        def sums(values):
            upto = np.concatenate([[0], np.cumsum(values)])
            return upto[at[1:]] - upto[at[:-1]]

        return {c: batch.column(c) for c in kept} | {"n_best": sums(times * best[place]), "count_sum": sums(times * n[place])}

    return map_batches(linked, run, fields(linked, ["_pairs", "_times"], n_best="long", count_sum="long"))


def _sums_by_join(linked: DataFrame, counts: DataFrame, scratch: str | None) -> DataFrame:
    """The same by joins, for any number of pairs.

    A frequent pair is in many rows, which a join on it would bring to one task; these pairs, at most ``FREQUENT``,
    are broadcast. Of the others none has more than its share of the links.
    """
    rows = stored(linked.withColumn("_row", F.monotonically_increasing_id()), "alignment-rows", scratch)
    links = counts.agg(F.sum("n").alias("n")).collect()[0].n or 0
    frequent = counts.filter(F.col("n") * FREQUENT > links)
    each = rows.select("_row", F.inline(F.arrays_zip("_pairs", "_times"))).select("_row", F.col("_pairs").alias("pair"), F.col("_times").alias("times"))
    looked_up = each.join(F.broadcast(frequent), "pair", "left")
    rest = looked_up.filter("n IS NULL").select("pair", "_row", "times").join(counts, "pair")
    found = looked_up.filter("n IS NOT NULL").unionByName(rest)
    sums = found.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    joined = rows.drop("_pairs", "_times").join(sums, "_row", "left").drop("_row")
    return joined.withColumns({"n_best": F.coalesce("n_best", zero), "count_sum": F.coalesce("count_sum", zero)})


def link_counts(
    df: DataFrame,
    vocabulary: Vocabulary,
    pieces: Pieces,
    text: str = "text",
    key: str = "doc_id",
    most_pairs: int = MOST_PAIRS,
    scratch: str | None = None,
) -> DataFrame:
    """``key``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256`` for every row.

    ``text`` after a space is aligned as by ``align``. A link is a pair of tokens that end together, one for each
    group. A pair of ids counts as often as it is linked in all rows, repeated ones included; ``n_best`` is the number of the
    row's links whose count is the highest of their second id, ties included, ``count_sum`` the sum of their
    counts. ``groups_sha256`` is over ``a1,a2|b1;a3|b2,b3`` with the ids of each group.

    A text that is NULL or empty, or not given back by one of the tokenizers, has zeros and an empty digest. NULL
    and repeated ids keep their rows; an empty table gives an empty result; other columns are not looked at.
    """
    given = df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    linked = stored(_linked(given, vocabulary, pieces), "alignment", scratch)
    counts = stored(pair_counts(linked), "alignment-pairs", scratch)
    few = counts.limit(most_pairs + 1).count() <= most_pairs
    found = _sums_by_lookup(linked, counts) if few else _sums_by_join(linked, counts, scratch)
    columns = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return found.select(F.col("_key").alias(key), *columns)
