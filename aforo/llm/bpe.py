"""Byte-level BPE as a deterministic automaton over tokens.

The automaton accepts, for every word, exactly the token sequence that BPE gives. It starts as
one state that reads any byte and takes one gadget per merge, in order. The gadget of u + v -> w gives
w an arc wherever u and then v could be read, and forbids v right after u. A state is therefore
known by the token read last, and what it forbids follows from the gadgets:

* after w the automaton is where v led, so w forbids what v forbade when w was made;
* w is forbidden wherever u was forbidden when w was made;
* v is forbidden after u from the merge on. With u = v, w is too: the left pair merges first.

The sets of forbidden tokens are kept in that form (parents and time of making), which is linear in
the merges and does not grow, and arcs are looked up through a table that remembers them.

The tokens that may come next are compiled into the table of a trie. Words that a batch meets for the first
time are read side by side, one arc of each at a time. Long ones, and those that need many tries, are read
one by one.
"""

from __future__ import annotations

import hashlib
import json
import pickle
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from aforo.llm.common import fields, kept_by_worker, map_batches

# Fixed value: how byte-level BPE cuts text into words.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Entries of the tables that workers keep of what they have met. A full table of pieces is set aside, for those
#: met again to return from, until the next is full; a full table of arcs starts anew.
PIECES_KEPT = 100_000
ARCS_KEPT = 500_000
#: Bits of the number of arcs kept for words that are read side by side; a new one takes the place of an old one.
ARC_BITS = 21
#: Pieces that are read side by side, and characters of the longest of them.
PIECES_AT_ONCE = 5_000
LONGEST_PIECE = 64
#: Arcs that are tried for a word before it is read alone, where dead ends are remembered.
MOST_TRIES = 512

NEVER = 1 << 60
START = -1
NO_BYTE = 256  # behind each word


def byte_characters() -> dict[str, int]:
    """The characters by which vocabulary files write bytes: printable ones as they are, others from U+0100 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass(frozen=True)
class Vocabulary:
    """Token bytes by id, merges as pairs of ids with the id they make, and special strings."""

    tokens: dict[int, bytes]
    merges: tuple[tuple[int, int, int], ...]
    special: dict[str, int]

    @staticmethod
    def load(path: str) -> Vocabulary:
        """Read a byte-level tokenizer file of the tokenizers library. Called on the driver; the result is shipped."""
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model, pre = content["model"], content["pre_tokenizer"]
        simple = pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]
        if not simple or content["normalizer"] is not None or model["type"] != "BPE" or model["ignore_merges"]:
            raise ValueError(f"{path} is no plain byte-level BPE")
        added = content["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"{path} has added tokens that take in their surroundings")
        ids, byte = model["vocab"], byte_characters()
        special = {t["content"]: t["id"] for t in added}
        tokens = {i: bytes(byte[c] for c in t) for t, i in ids.items() if t not in special}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        return Vocabulary(tokens, tuple((ids[u], ids[v], ids[u + v]) for u, v in pairs), special)


class MergeAutomaton:
    """States are the tokens read last; ``START`` forbids nothing."""

    def __init__(self, vocabulary: Vocabulary):
        self.labels = dict(vocabulary.tokens)
        span = self._span = max(self.labels) + 1
        # By token: its parts, -1 for none, and the merge that makes it.
        self._parts: tuple[list[int], list[int]] = ([-1] * span, [-1] * span)
        self._made = [NEVER] * span
        # By two tokens as one number, which is smaller than a pair.
        self._merged: dict[int, int] = {}
        self._arcs: dict[int, bool] = {}
        dead = set()
        for rank, (u, v, w) in enumerate(vocabulary.merges):
            if self._made[w] != NEVER:
                raise ValueError(f"two merges make token {w}")
            if u in dead or v in dead or self._forbidden(u, v):
                dead.add(w)  # never read: its parts cannot follow each other
            self._gadget(rank, u, v, w)
        self._ids = {label: i for i, label in self.labels.items() if i not in dead and (len(label) == 1 or self._made[i] != NEVER)}
        self._lengths = self._candidate_lengths()
        self._compile()

    def _compile(self) -> None:
        """The trie of the tokens that can be read: nodes by depth and then bytes, so that a child's number is
        the place of its edge among all edges, and the first two bytes' nodes in a table of their own."""
        nodes = sorted({label[:n] for label in self._ids for n in range(1, len(label) + 1)}, key=lambda p: (len(p), p))
        number = {p: i for i, p in enumerate(nodes)}
        parents = [number.get(p[:-1], -1) for p in nodes]
        longest: list[int] = []  # token among the prefixes of a node, itself included
        for node, parent in zip(nodes, parents, strict=True):
            longest.append(self._ids.get(node, longest[parent] if parent >= 0 else -1))
        self._longest_token = np.array(longest, np.int64)
        self._size, self._shorter = np.zeros(self._span, np.int64), np.full(self._span, -1, np.int64)
        for label, token in self._ids.items():
            self._size[token] = len(label)
            parent = parents[number[label]]
            self._shorter[token] = longest[parent] if parent >= 0 else -1
        ends = np.array([p[-1] for p in nodes], np.int64)
        above = np.array(parents, np.int64)
        self._edges = above * (NO_BYTE + 1) + ends  # rising, the roots' being below 0
        depth = np.array([len(p) for p in nodes], np.int64)
        self._two = np.full((256, NO_BYTE + 1), -1, np.int64)
        self._two[ends[depth == 1]] = np.flatnonzero(depth == 1)[:, None]
        second = np.flatnonzero(depth == 2)
        self._two[ends[above[second]], ends[second]] = second
        self._deep = int((depth == 1).sum())  # nodes from here on have two bytes or more
        self._arcs_kept = np.full(1 << ARC_BITS, -1, np.int64)

    def _candidate_lengths(self) -> dict[bytes, tuple[int, ...]]:
        """By the next bytes, up to four of them: the lengths of the tokens that may come, longest first."""
        found: dict[bytes, set[int]] = {}
        for label in self._ids:
            found.setdefault(label[:4], set()).add(len(label))
        for start in sorted(found, key=len):
            found[start].update(*(found.get(start[:n], ()) for n in (1, 2, 3)))
        return {start: tuple(sorted(lengths, reverse=True)) for start, lengths in found.items()}

    def _gadget(self, rank: int, u: int, v: int, w: int) -> None:
        self._parts[0][w], self._parts[1][w] = u, v
        self._made[w] = rank
        self._merged[u * self._span + v] = rank

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The symbols that stood at the token's left (0) or right (1) end, and until which merge."""
        part, made, until, spine = self._parts[side], self._made, NEVER, []
        while token >= 0:
            spine.append((token, until))
            token, until = part[token], made[token]
        return spine

    def _forbidden(self, last: int, token: int) -> bool:
        merged, span, starts = self._merged.get, self._span, self._spine(token, 0)
        for end, end_until in self._spine(last, 1):
            for start, start_until in starts:
                # At the same merge the pair further left goes first.
                if (rank := merged(end * span + start)) is not None and rank < end_until and rank <= start_until:
                    return True
        return False

    def arc(self, state: int, token: int) -> bool:
        """Whether ``token`` can be read in ``state``."""
        if state == START:
            return True
        found = self._arcs.get(state << 32 | token)
        if found is None:
            if len(self._arcs) >= ARCS_KEPT:
                self._arcs.clear()
            found = self._arcs[state << 32 | token] = not self._forbidden(state, token)
        return found

    def read(self, word: bytes) -> list[int]:
        """The arcs of the one accepted path that spells ``word``: longest first, stepping back from dead ends."""
        whole = self._ids.get(word)
        if whole is not None:
            return [whole]
        ids, arcs, lengths, n = self._ids, self._arcs, self._lengths, len(word)
        path: list[int] = []
        ends = [0]
        state, at, dead_ends = START, 0, None
        while at < n:
            for length in lengths.get(word[at : at + 4]) or lengths.get(word[at : at + 3]) or lengths.get(word[at : at + 2]) or (1,):
                end = at + length
                if end > n:
                    continue
                token = ids.get(word[at:end])
                if token is None or dead_ends and (end, token) in dead_ends:
                    continue
                open_ = arcs.get(state << 32 | token)
                if open_ or open_ is None and self.arc(state, token):
                    path.append(token)
                    ends.append(end)
                    state, at = token, end
                    break
            else:
                if not path:
                    raise ValueError(f"no path for {word!r}")
                dead_ends = dead_ends or set()
                dead_ends.add((ends.pop(), path.pop()))
                at, state = ends[-1], path[-1] if path else START
        return path

    def read_all(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """What ``read`` gives for each word: all tokens in order, and how many of them each word has."""
        n, sizes = len(words), np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        data = np.frombuffer(b"\0".join([*words, b""]), np.uint8).astype(np.int64)
        data[ends] = NO_BYTE
        apart = sizes > 4 * LONGEST_PIECE
        live = np.flatnonzero((sizes > 0) & ~apart)
        path, counts = np.zeros((n, sizes[live].max(initial=0)), np.int32), np.zeros(n, np.int64)
        at, depth = (ends - sizes)[live], np.zeros(live.size, np.int64)
        token = self._longest(data, at)
        for _ in range(MOST_TRIES):
            # An open arc is taken. Where it is closed the next shorter token comes, after the last of them a step back.
            open_ = token >= 0
            asked = np.flatnonzero(open_ & (depth > 0))  # the start forbids nothing
            open_[asked] = self._open(path[live[asked], depth[asked] - 1].astype(np.int64), token[asked])
            on, closed = np.flatnonzero(open_), np.flatnonzero(~open_)
            path[live[on], depth[on]] = token[on]
            depth[on] += 1
            at[on] += self._size[token[on]]
            token[closed] = np.where(token[closed] >= 0, self._shorter[token[closed]], -1)
            back = closed[(token[closed] < 0) & (depth[closed] > 0)]
            depth[back] -= 1
            last = path[live[back], depth[back]]
            at[back] -= self._size[last]
            token[back] = self._shorter[last]
            ended = data[at] == NO_BYTE
            counts[live[ended]] = depth[ended]
            on = on[~ended[on]]
            token[on] = self._longest(data, at[on])
            more = ~ended & ((token >= 0) | (depth > 0))
            apart[live[~ended & ~more]] = True
            live, at, depth, token = live[more], at[more], depth[more], token[more]
            if not live.size:
                break
        apart[live] = True
        alone = {i: self.read(words[i]) for i in np.flatnonzero(apart).tolist()}
        word, step = np.nonzero(np.arange(path.shape[1]) < counts[:, None])
        for i, tokens in alone.items():
            counts[i] = len(tokens)
        starts = np.cumsum(counts) - counts
        found = np.empty(int(counts.sum()), np.int64)
        found[starts[word] + step] = path[word, step]
        for i, tokens in alone.items():
            found[starts[i] : starts[i] + len(tokens)] = tokens
        return found, counts

    def _longest(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The longest token at each place, -1 for none."""
        node = self._two[data[at], data[at + 1]]
        live = np.flatnonzero(node >= self._deep)
        at, inner = at[live] + 2, node[live]
        while live.size:
            edge = inner * (NO_BYTE + 1) + data[at]
            child = np.searchsorted(self._edges, edge)
            child[child == self._edges.size] = 0
            on = self._edges[child] == edge
            live, inner, at = live[on], child[on], at[on] + 1
            node[live] = inner
        return np.where(node >= 0, self._longest_token[node], -1)

    def _open(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """``arc`` for each pair."""
        arcs = states * self._span + tokens
        slots = ((arcs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - ARC_BITS)).astype(np.int64)
        kept = self._arcs_kept[slots]
        new = np.flatnonzero(kept >> 1 != arcs)
        if new.size:
            asked, places = np.unique(arcs[new], return_inverse=True)
            answers = [not self._forbidden(*divmod(arc, self._span)) for arc in asked.tolist()]
            kept[new] = (asked << 1 | np.array(answers, np.int64))[places]
            self._arcs_kept[slots[new]] = kept[new]
        return kept & 1 == 1

    def spell(self, ids: Sequence[int]) -> bytes:
        """The labels of the arcs, one after the other."""
        return b"".join([self.labels[i] for i in ids])


class _Pieces:
    """Ids, joined by commas, of pieces met so far, by their text without the leading space."""

    def __init__(self, codec: Codec, prefix: str):
        self._codec, self._prefix = codec, prefix
        self._aside: dict[str, str] = {}
        self._known: dict[str, str] = {}

    def of(self, wanted: set[str]) -> dict[str, str]:
        """A table that holds all wanted pieces, and others."""
        missing = [p for p in wanted if p not in self._known]
        if len(self._known) + len(missing) > PIECES_KEPT:
            self._aside, self._known = self._known, {}
            missing = list(wanted)
        known, aside = self._known, self._aside
        known.update((p, aside[p]) for p in missing if p in aside)
        new = [p for p in missing if p not in known]
        for i in range(0, len(new), PIECES_AT_ONCE):
            some = new[i : i + PIECES_AT_ONCE]
            known.update(zip(some, self._codec.read(some, self._prefix), strict=True))
        return known


class Codec:
    """Encodes and decodes whole texts."""

    # A space before a character that is no white space begins a word whatever stands before it.
    _LOOSE_SPACE = re.compile(r" (?!\S)")
    _CUT = re.compile(r" (?=\S)")

    def __init__(self, vocabulary: Vocabulary):
        self.automaton = MergeAutomaton(vocabulary)
        self._special = dict(vocabulary.special)
        self.automaton.labels.update({i: s.encode() for s, i in self._special.items()})
        by_length = sorted(self._special, key=len, reverse=True)
        self._special_split = re.compile(f"({'|'.join(map(re.escape, by_length))})") if by_length else None
        self._words = regex.compile(WORD_SPLIT)
        span = range(max(self.automaton.labels) + 1)
        self._names = pa.array(map(str, span), pa.string())
        self._labels = pa.array([self.automaton.labels.get(i, b"") for i in span], pa.binary())
        self._first, self._later = _Pieces(self, ""), _Pieces(self, " ")

    def ids(self, text: str) -> list[int]:
        """Token ids of a text; special strings in it become their tokens."""
        found: list[int] = []
        for part in self._special_split.split(text) if self._special_split else [text]:
            if part in self._special:
                found.append(self._special[part])
            else:
                for word in self._split(part):
                    found += self.automaton.read(word.encode("utf-8", "surrogatepass"))
        return found

    def _split(self, text: str) -> list[str]:
        """The words of byte-level BPE. Letters alone, after a space or not, are one word."""
        if text.isalpha() or text[:1] == " " and text[1:].isalpha():
            return [text]
        return self._words.findall(text)

    def read(self, pieces: Sequence[str], prefix: str) -> list[str]:
        """Ids joined by commas of each piece after ``prefix``. Long pieces and special strings are read one by one."""
        special = self._special_split.search if self._special_split else lambda text: None
        none = special("\n".join(pieces)) is None
        alone = [i for i, p in enumerate(pieces) if len(p) > LONGEST_PIECE or not none and special(p)]
        together = list(pieces)
        for i in alone:
            together[i] = ""
        findall = self._words.findall
        words = [[prefix + p] if p.isalpha() else findall(prefix + p) if p else () for p in together]
        tokens, counts = self.automaton.read_all([w.encode("utf-8", "surrogatepass") for ws in words for w in ws])
        ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum([0, *map(len, words)])]
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), self._names.take(pa.array(tokens))), ",")
        _, cuts, content = joined.buffers()
        cuts, whole = np.frombuffer(cuts, np.int32)[: len(ends)].tolist(), str(content, "ascii")
        found = [whole[i:j] for i, j in zip(cuts, cuts[1:])]
        for i in alone:
            found[i] = ",".join(map(str, self.ids(prefix + pieces[i])))
        return found

    def _cut(self, text: str) -> list[str]:
        """Pieces that make up the text with a space before each but the first, and can be encoded one by one."""
        return self._CUT.split(text) if self._LOOSE_SPACE.search(text) else text.split(" ")

    def encoded(self, texts: Sequence[str]) -> list[str]:
        """For each text its ids joined by commas."""
        cut = [self._cut(t) for t in texts]
        first = self._first.of({pieces[0] for pieces in cut if pieces[0]})
        later = self._later.of(set().union(*(pieces[1:] for pieces in cut)))
        found = []
        for start, *rest in cut:
            ids = [later[p] for p in rest]
            found.append(",".join([first[start], *ids] if start else ids))
        return found

    def decoded(self, encoded: Sequence[str]) -> list[str]:
        """The texts that ids joined by commas decode to."""
        ids = pc.split_pattern(pa.array([e for e in encoded if e], pa.large_string()), ",")
        labels = pa.ListArray.from_arrays(ids.offsets, self._labels.take(ids.flatten().cast(pa.int32())))
        texts = iter(pc.binary_join(labels, b"").to_pylist())
        return [next(texts).decode("utf-8", "replace") if e else "" for e in encoded]

    def round_trips(self, texts: Sequence[str]) -> Iterator[tuple[str, str]]:
        """For each text its ids joined by commas, and the text they decode to."""
        encoded = self.encoded(texts)
        return zip(encoded, self.decoded(encoded), strict=True)

    def round_trip(self, text: str) -> tuple[str, str]:
        """Ids joined by commas, and the text they decode to."""
        return next(iter(self.round_trips([text])))


def _codec(vocabulary: Vocabulary) -> Callable[[], Codec]:
    """One automaton per worker. The vocabulary travels packed and is unpacked for that alone, not by every task."""
    packed = pickle.dumps(vocabulary)
    key = ("bpe", hashlib.sha256(packed).hexdigest())
    return lambda: kept_by_worker(key, lambda: Codec(pickle.loads(packed)))


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """The rows with ``token_ids``: all ids of the whole text. NULL counts as empty, which has none.

    Equal rows are encoded each. A column ``token_ids`` is replaced, others are carried along. No row
    moves, and a text of any length is read through once.
    """
    return _mapped(df, vocabulary, text, "token_ids", "array<int>", _encode_column)


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "token_ids") -> DataFrame:
    """The rows with ``decoded``, the text spelled by the ids. NULL ids give NULL, unknown ids nothing."""
    return _mapped(df, vocabulary, ids, "decoded", "string", _decode_column)


def digest(df: DataFrame, vocabulary: Vocabulary, text: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``carry``, ``n_tokens``, and SHA-256 of the ids joined by commas and of the decoded text, in hex.

    The same as ``encode`` and then ``decode``, without the ids leaving the worker. NULL counts as empty.
    """
    given = df.select(*(f"`{c}`" for c in carry), df[f"`{text}`"].alias("_text"))
    schema = fields(given, ["_text"], n_tokens="long", ids_sha256="string", decoded_sha256="string")
    codec = _codec(vocabulary)

    def run(batch):
        counts, id_digests, text_digests = [], [], []
        for ids, decoded in codec().round_trips([t or "" for t in batch.column("_text").to_pylist()]):
            counts.append(ids.count(",") + 1 if ids else 0)
            id_digests.append(hashlib.sha256(ids.encode()).hexdigest())
            text_digests.append(hashlib.sha256(decoded.encode()).hexdigest())
        out = {c: batch.column(c) for c in carry}
        return out | {"n_tokens": counts, "ids_sha256": id_digests, "decoded_sha256": text_digests}

    return map_batches(given, run, schema)


def _encode_column(codec: Codec, texts: list) -> list:
    return [[int(i) for i in ids.split(",")] if ids else [] for ids in codec.encoded([t or "" for t in texts])]


def _decode_column(codec: Codec, rows: list) -> list:
    known = codec.automaton.labels
    return [None if ids is None else b"".join([known.get(i, b"") for i in ids]).decode("utf-8", "replace") for ids in rows]


def _mapped(df: DataFrame, vocabulary: Vocabulary, column: str, name: str, kind: str, function) -> DataFrame:
    kept = [c for c in df.columns if c != name]
    given = df.select(*(f"`{c}`" for c in kept), df[f"`{column}`"].alias("_input"))
    codec = _codec(vocabulary)

    def run(batch):
        out = {c: batch.column(c) for c in kept}
        return out | {name: function(codec(), batch.column("_input").to_pylist())}

    return map_batches(given, run, fields(given, ["_input"], **{name: kind}))
