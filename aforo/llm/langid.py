"""Language of a text by known words first, then by ever shorter character n-grams.

A known word scores each language by the logarithm of its relative frequency there. A word that no
language knows is scored by its n-grams of five characters, if one of them is known; else by those of
four, and so on down to single characters, at a discount per step. The counts are taken by Spark
from a sample of the labelled rows with a documented bound, and everything in the sample is kept.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aforo.llm.common import fields, kept_by_worker, map_batches
from aforo.sources.scratch import stored

#: Characters of labelled text that are learned from, shared evenly by all languages; a language with more is
#: thinned by a hash of the id, whole rows at a time. Bounds what reaches the driver and the workers.
LEARNED_CHARACTERS = 6_000_000
#: Labels beyond this number are an error: such a column holds something else than languages.
MOST_LANGUAGES = 10_000
LONGEST_GRAM = 5
#: What a step down to shorter n-grams costs, as a factor of the difference between languages.
DISCOUNT = 0.7
#: Entries of the table of pieces of text that a worker keeps, and bytes of their scores; a full one starts anew.
PIECES_KEPT = 200_000
SCORES_KEPT = 32 << 20

UNKNOWN = "und"

# Letters with the marks that belong to them, as Spark's and Python's expressions both read it.
WORD = r"\p{L}[\p{L}\p{M}]*"
# Marks that part words as white space does, and often stand next to them.
_STOPS = ".,;:!?\"()"


@dataclass(frozen=True)
class Entries:
    """Words, or n-grams, by name; ``lines`` has them one a line. The languages that know one, and by how much its
    logarithm exceeds that of an unseen entry there, stand from ``begins`` on; ``unseen`` has a row for each length and
    a column per language."""

    lines: str = field(repr=False)
    begins: np.ndarray = field(repr=False)
    places: np.ndarray = field(repr=False)
    gains: np.ndarray = field(repr=False)
    unseen: np.ndarray = field(repr=False)

    @property
    def names(self) -> list[str]:
        return self.lines.split("\n") if self.lines else []

    def scores(self, entries: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        """``n`` rows with a column per language: the gains of each entry added to its row."""
        columns = self.unseen.shape[1]
        many = self.begins[entries + 1] - self.begins[entries]
        at = np.repeat(self.begins[entries] - np.cumsum(many) + many, many) + np.arange(many.sum())
        cells = np.repeat(rows, many) * columns + self.places[at]
        return np.bincount(cells, self.gains[at], n * columns).astype(float).reshape(n, columns)


@dataclass(frozen=True)
class Model:
    """Languages in order, and what is known of words and of n-grams."""

    languages: tuple[str, ...]
    words: Entries
    grams: Entries


def held_out(key: Column) -> Column:
    """Whether the CRC-32 of the id as text leaves 1 when divided by 3; false for a NULL id."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def labelled(df: DataFrame, text: str, lang: str, key: str, characters: int = LEARNED_CHARACTERS) -> DataFrame:
    """``lang``, ``text`` and nothing else of the rows to learn from, about ``characters`` of text in all at most.

    These are the rows with text, language and id that are not held out. Any label counts, ``und`` too.
    """
    known = df.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"), F.col(f"`{key}`").alias("_key"))
    known = known.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("_key").isNotNull() & ~held_out(F.col("_key")))
    sizes = known.groupBy("lang").agg(F.sum(F.char_length("text")).alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"{lang} has more than {MOST_LANGUAGES} labels")
    thinned = {r.lang: characters / len(sizes) / r.n for r in sizes if r.n * len(sizes) > characters}
    if not thinned:
        return known.select("lang", "text")
    # One row per language, of which there are not many; shares of the range of a 53-bit hash.
    entries = F.array(*(F.struct(F.lit(name).alias("lang"), F.lit(share).alias("_share")) for name, share in thinned.items()))
    shares = df.sparkSession.range(1).select(F.inline(entries))
    chosen = F.shiftrightunsigned(F.xxhash64("_key"), 11) < F.coalesce("_share", F.lit(1.0)) * float(1 << 53)
    return known.join(F.broadcast(shares), "lang", "left").filter(chosen).select("lang", "text")


def train(
    df: DataFrame,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    characters: int = LEARNED_CHARACTERS,
    scratch: str | None = None,
) -> Model:
    """Count all words and n-grams of the labelled rows by language. Every label is learned.

    Without any labelled row the model has no languages, and all texts are ``und``.
    """
    words = (
        labelled(df, text, lang, key, characters)
        .select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("x"))
        .groupBy("lang", "x")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    words = stored(words, "langid-words", scratch)
    marked = F.concat(F.lit("^"), F.col("x"), F.lit("$"))

    def of_length(n: int) -> Column:
        begins = F.sequence(F.lit(1), F.length(marked) - n + 1)
        # A lambda of one parameter: Spark would hand a second one the index.
        parts = F.transform(begins, lambda begin: F.substring(marked, begin, F.lit(n)))
        return F.when(F.length(marked) >= n, parts).otherwise(F.array().cast("array<string>"))

    one_length = [of_length(n) for n in range(1, LONGEST_GRAM + 1)]
    grams = words.select("lang", "n", F.explode(F.concat(*one_length)).alias("x")).groupBy("lang", "x").agg(F.sum("n").alias("n"))
    counted = words.withColumn("size", F.lit(0)).toArrow()
    languages = tuple(sorted(counted["lang"].unique().to_pylist()))
    return Model(languages, _entries(counted, languages, 1), _entries(grams.withColumn("size", F.char_length("x")).toArrow(), languages, LONGEST_GRAM + 1))


def _entries(counted: pa.Table, languages: tuple[str, ...], sizes: int) -> Entries:
    """The logs of frequencies relative to entries of the same length, smoothed by a half."""
    codes = counted["x"].combine_chunks().dictionary_encode()
    names, entry = codes.dictionary.to_pylist(), codes.indices.to_numpy().astype(np.int64)
    by_name = {language: i for i, language in enumerate(languages)}
    place = np.array([by_name[v] for v in counted["lang"].to_pylist()], dtype=np.int64)
    n, size = (counted[c].to_numpy().astype(np.int64) for c in ("n", "size"))
    totals = np.bincount(size * len(languages) + place, n, sizes * len(languages)).reshape(sizes, len(languages))
    size_of = np.zeros(len(names), dtype=np.int64)
    size_of[entry] = size
    smoothed = totals + 0.5 * np.bincount(size_of, minlength=sizes)[:, None]
    unseen = np.log(0.5 / np.maximum(smoothed, 0.5))
    order = np.argsort(entry, kind="stable")
    begins = np.concatenate([[0], np.cumsum(np.bincount(entry, minlength=len(names)))]).astype(np.int64)
    return Entries("\n".join(names), begins, place[order].astype(np.int32), np.log((n[order] + 0.5) / 0.5), unseen)


class Scorer:
    """Scores texts with one model; one per worker."""

    _WORD = regex.compile(WORD)
    #: Row of the pieces that hold no letter.
    _NOTHING = 0

    def __init__(self, model: Model):
        self._model = model
        self._words = {w: i for i, w in enumerate(model.words.names)}
        self._grams = {g: i for i, g in enumerate(model.grams.names)}
        self._kept = min(PIECES_KEPT, SCORES_KEPT // (8 * max(1, len(model.languages))))
        self._forget()

    def _forget(self) -> None:
        self._pieces: dict[str, int] = {}
        self._table = np.zeros((1, len(self._model.languages)))

    def _learn(self, pieces: list[str]) -> None:
        """Rows for new pieces of text between white space: the sums of their words' scores."""
        first = len(self._table)
        rows, words = [], []
        n = 0
        for piece in pieces:
            found = [piece] if piece.isascii() and piece.isalpha() else self._WORD.findall(piece)
            if found:
                self._pieces[piece] = first + n
                words += found
                rows += [n] * len(found)
                n += 1
            else:
                self._pieces[piece] = self._NOTHING
        scores = np.zeros((n, len(self._model.languages)))
        np.add.at(scores, np.array(rows, dtype=np.int64), self.word_scores(words))
        self._table = np.concatenate([self._table, scores])

    def word_scores(self, words: Sequence[str]) -> np.ndarray:
        """A row for each word: by the word if it is known, else by the longest n-grams that are."""
        model, get = self._model, self._words.get
        known = np.array([get(w, -1) for w in words], dtype=np.int64)
        at = np.flatnonzero(known >= 0)
        scores = model.words.scores(known[at], at, len(words))
        scores[at] += model.words.unseen[0]

        get = self._grams.get
        rows, sizes, many, grams = [], [], [], []
        for i in np.flatnonzero(known < 0).tolist():
            marked = f"^{words[i]}$"
            for size in range(LONGEST_GRAM, 0, -1):
                found = [g for j in range(len(marked) - size + 1) if (g := get(marked[j : j + size])) is not None]
                if found:
                    rows.append(i)
                    sizes.append(size)
                    many.append(len(found))
                    grams += found
                    break
        if rows:
            sizes, many = np.array(sizes), np.array(many)
            means = model.grams.scores(np.array(grams), np.repeat(np.arange(len(rows)), many), len(rows)) / many[:, None]
            means += model.grams.unseen[sizes]
            means -= means.mean(axis=1, keepdims=True)
            scores[rows] = means * (DISCOUNT ** (LONGEST_GRAM - sizes + 1))[:, None]
        return scores

    def predict(self, texts: Sequence[str | None]) -> list[tuple[str, float]]:
        """For each text the language and its share of the probability over all learned languages."""
        if not self._model.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        pieces = [self._split(t) if t else [] for t in texts]
        if len(self._pieces) > self._kept:
            self._forget()
        self._learn(list(set().union(*pieces).difference(self._pieces)))
        return [self._predicted(p) for p in pieces]

    @staticmethod
    def _split(text: str) -> list[str]:
        """Pieces in lower case; no word reaches from one into the next."""
        text = text.lower()
        for stop in _STOPS:
            text = text.replace(stop, " ")
        return text.split()

    def _predicted(self, pieces: list[str]) -> tuple[str, float]:
        rows = np.fromiter(map(self._pieces.__getitem__, pieces), np.int64, len(pieces))
        if not rows.any():
            return UNKNOWN, 0.0
        sums = self._table[rows].sum(axis=0)
        best = int(np.argmax(sums))
        return self._model.languages[best], float(1.0 / np.exp(np.minimum(sums - sums[best], 0.0)).sum())


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows with ``lang_pred`` and ``score`` (0 to 1), from the whole text alone.

    A NULL or empty text, or one without a letter, is ``und`` with score 0. Equal texts score alike; of
    tied languages the first in order wins. Columns of these names are replaced, others carried along.
    """
    names = {"lang_pred": "string", "score": "double"}
    kept = [c for c in df.columns if c not in names]
    given = df.select(*(f"`{c}`" for c in kept))

    def run(batch):
        scorer = kept_by_worker(("langid", model.languages, hash(model.words.lines), hash(model.words.gains.tobytes())), lambda: Scorer(model))
        found = scorer.predict(batch.column(text).to_pylist())
        out = {c: batch.column(c) for c in kept}
        return out | {"lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

    return map_batches(given, run, fields(given, **names))
