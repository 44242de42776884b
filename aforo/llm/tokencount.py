"""Exact token counts of whole texts, huge ones by overlapping chunks that are spliced.

Ordinary texts are one chunk. A huge text is cut into overlapping chunks, each encoded with offsets. Two
neighbours are spliced at a boundary that both show and that is proven stable: a white-space character
which no token of either touches. This tokenizer drops white space before merging and its words,
special strings and normal forms never reach across it, so what is left of it cannot change what is
right of it. Where the overlap has no such boundary it is widened, in the end to the rest of the text.

Within a chunk the same boundary makes the pieces between white space independent, and a worker counts a
piece that it has met before from memory.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from aforo.llm.common import fields, kept_by_worker, map_batches

#: Characters of a chunk, and by how many neighbours overlap at first.
CHUNK = 16_384
OVERLAP = 512
#: Entries of the table of pieces that a worker keeps; a full one starts anew.
PIECES_KEPT = 600_000
#: Texts that are looked at together, and pieces that are encoded together.
TEXTS_AT_ONCE = 64
PIECES_AT_ONCE = 2048

# Fixed value: characters that every part of the tokenizer takes for white space.
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_STABLE_SPLITS = {"'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}


def load_tokenizer(path: str) -> str:
    """The tokenizer file's content, checked for what the splice rests on. Read on the driver and shipped."""
    with open(path, encoding="utf-8") as file:
        content = file.read()
    parsed = json.loads(content)
    steps = parsed["pre_tokenizer"].get("pretokenizers", [])
    drops = bool(steps) and steps[0].get("type") == "Split" and steps[0]["behavior"] == "Removed" and steps[0]["invert"]
    if not drops or steps[0]["pattern"].get("Regex") not in _STABLE_SPLITS:
        raise ValueError(f"{path} does not drop white space between words")
    for added in parsed["added_tokens"]:
        if _SPACE.search(added["content"]) or added["lstrip"] or added["rstrip"] or added["single_word"]:
            raise ValueError(f"{path} has added tokens that reach across white space")
    return content


class Counter:
    """Counts tokens with one tokenizer; one per worker."""

    def __init__(self, tokenizer: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        self._tokenizer = Tokenizer.from_str(tokenizer)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._chunk, self._overlap = chunk, overlap
        self._known: dict[bytes, int] = {}

    def counts(self, texts: Sequence[str]) -> list[int]:
        """Tokens of each text."""
        found: list[int] = []
        for i in range(0, len(texts), TEXTS_AT_ONCE):
            found += self._counts(texts[i : i + TEXTS_AT_ONCE])
        return found

    def _counts(self, texts: Sequence[str]) -> list[int]:
        pieces = [t.encode("utf-8", "surrogatepass").split() if len(t) <= self._chunk else [] for t in texts]
        if len(self._known) > PIECES_KEPT:
            self._known.clear()
        known = self._known
        missing = list({p for ps in pieces for p in ps if p not in known})
        for i in range(0, len(missing), PIECES_AT_ONCE):
            some = missing[i : i + PIECES_AT_ONCE]
            encoded = self._tokenizer.encode_batch_fast([p.decode("utf-8", "replace") for p in some], add_special_tokens=False)
            known.update(zip(some, map(len, encoded), strict=True))
        return [sum([known[p] for p in ps]) if len(t) <= self._chunk else self.spliced(t) for t, ps in zip(texts, pieces, strict=True)]

    def spliced(self, text: str) -> int:
        """Tokens of a huge text, chunk after chunk: no more than a chunk and its widening is encoded at once."""
        total, start, size = 0, 0, len(text)
        end, offsets = self._encode(text, 0, self._chunk)
        while end < size:
            overlap = self._overlap
            while True:
                begin = max(start, end - overlap)
                next_end, following = self._encode(text, begin, begin + self._chunk + overlap)
                at = self._stable_boundary(text, begin, end, offsets, following)
                if at is not None:
                    break
                if begin > start:
                    overlap *= 2
                    continue
                # Nothing stable in the whole chunk: it grows on.
                end, offsets = self._encode(text, start, end + 2 * (end - start))
                if end == size:
                    return total + len(offsets)
                overlap = self._overlap
            total += sum(1 for _, stop in offsets if stop <= at)
            start, end = at, next_end
            offsets = [o for o in following if o[0] >= at]
        return total + len(offsets)

    def _encode(self, text: str, begin: int, end: int) -> tuple[int, list[tuple[int, int]]]:
        """The chunk's end and its tokens' offsets in the whole text."""
        end = min(end, len(text))
        found = self._tokenizer.encode(text[begin:end], add_special_tokens=False).offsets
        return end, [(a + begin, b + begin) for a, b in found]

    @staticmethod
    def _stable_boundary(text: str, begin: int, end: int, left: list, right: list) -> int | None:
        """The last white space of the overlap around which both chunks show the same tokens."""
        left_ends, right_ends = {b for _, b in left}, {b for _, b in right}
        for match in reversed(list(_SPACE.finditer(text, begin, end))):
            at = match.start()
            if at == begin or at + 1 >= end:
                continue  # a cut edge is no evidence
            before = text[begin:at].rstrip("\x20\t\n\v\f\r")
            last = begin + len(before)
            crossed = any(a < at < b for a, b in left) or any(a < at < b for a, b in right)
            if not crossed and (not before or (last in left_ends) == (last in right_ends)):
                return at
        return None


def _counter(tokenizer: str) -> Counter:
    # Spark runs a worker per core; threads of their own would only add memory.
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return kept_by_worker(("tokencount", hash(tokenizer)), lambda: Counter(tokenizer))


def count_tokens(df: DataFrame, tokenizer: str, text: str = "text", limit: int = 2048) -> DataFrame:
    """The rows with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more tokens than ``limit``).

    NULL counts as empty, which has no tokens. Equal rows count each, an empty table gives an empty
    result; columns of these names are replaced, others but the text are carried along. No row moves.
    """
    names = {"n_bytes": "long", "n_tokens": "long", "over_limit": "boolean"}
    kept = [c for c in df.columns if c not in names and c != text]
    given = df.select(*(f"`{c}`" for c in kept), df[f"`{text}`"].alias("_text"))

    def run(batch):
        texts = [t or "" for t in batch.column("_text").to_pylist()]
        counts = _counter(tokenizer).counts(texts)
        sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
        out = {c: batch.column(c) for c in kept}
        return out | {"n_bytes": sizes, "n_tokens": counts, "over_limit": [n > limit for n in counts]}

    return map_batches(given, run, fields(given, ["_text"], **names))
