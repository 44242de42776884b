"""Licence scans: runs of words compared to templates by the Dice coefficient over word bigrams.

Texts are normalised to lower-case words and numbers. Every run of words is a candidate, wherever its lines
break, in two readings of the text: with all its words, and with copyright statements passed over. A template is
compared only with texts that hold one of its telling words (so few of its bigrams may be missing that a match must
hold one of a small set, for which the rarest are chosen) and enough of its bigrams. A best run begins and
ends with bigrams of the template that it holds once, and has few others: all that the search relies on.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, insort
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from aforo.llm.common import fields, map_batches
from aforo.llm.license_texts import templates

#: Least Dice coefficient of a match.
THRESHOLD = 0.9

_WORDS = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
_COPYRIGHT = re.compile(r"\s*(?:copyright\s*(?:\(c\)|©|[0-9]{4})|\(c\)|©)", re.IGNORECASE)
# A full stop ends the sentence after a word of three letters or more that is no abbreviation.
_STATEMENT = re.compile(
    r"(?:^[^\S\n]*(?:\(c\)|©)|\bcopyright\s*(?:\(c\)|©|[0-9]{4})|(?:\(c\)|©)\s*[0-9]{4})"
    r".*?(?:$|(?<=\w\w\w)(?<!\binc)(?<!\bltd)(?<!\bcorp)\.(?=\s)(?:\s*all rights reserved\.?)?)",
    re.IGNORECASE | re.MULTILINE,
)


def words_of(line: str) -> list[str]:
    """The normalised words of a line."""
    return _WORDS.findall(line.lower())


def bigrams(words: Sequence[str]) -> set[tuple[str, str]]:
    """Distinct neighbouring words; a single word is paired with nothing."""
    return set(zip(words, words[1:])) or {(w, "") for w in words}


def dice(one: set, other: set) -> float:
    return 2 * len(one & other) / (len(one) + len(other)) if one and other else 0.0


@dataclass(frozen=True)
class _Template:
    name: str
    bigrams: frozenset
    least: int  # bounds of a run's distinct bigrams
    most: int
    extra: int  # most distinct bigrams of a run that are not the template's
    telling: frozenset  # words of which a match has at least one


@dataclass(frozen=True)
class Match:
    license: str
    dice: float
    first_line: int
    last_line: int


@dataclass(frozen=True)
class _Run:
    """Words of a text, by their numbers, that match a template."""

    template: _Template
    dice: float
    weight: int  # bigrams in common less those on one side only
    first: int
    last: int


def _apart(runs: list[_Run]) -> list[_Run]:
    """The runs in the given order, without those that overlap an earlier one."""
    taken: list[tuple[int, int]] = []
    chosen = []
    for run in runs:
        at = bisect_left(taken, (run.first, run.first))
        if (at == 0 or taken[at - 1][1] < run.first) and (at == len(taken) or run.last < taken[at][0]):
            insort(taken, (run.first, run.last))
            chosen.append(run)
    return chosen


class Scanner:
    """Finds the templates in texts."""

    def __init__(self, texts: Sequence[tuple[str, str]], threshold: float = THRESHOLD):
        self._threshold = threshold
        parsed = {(name, frozenset(bigrams(words_of(text)))) for name, text in texts}
        spread: dict[str, int] = {}
        for _, grams in parsed:
            for word in {w for g in grams for w in g}:
                spread[word] = spread.get(word, 0) + 1
        self._templates = sorted((self._template(name, grams, spread) for name, grams in parsed), key=lambda t: (t.name, sorted(t.bigrams)))
        self._by_word: dict[str, list[_Template]] = {}
        for template in self._templates:
            for word in template.telling:
                self._by_word.setdefault(word, []).append(template)
        self._telling = frozenset(self._by_word)
        self._by_gram: dict[tuple[str, str], list[_Template]] = {}
        for template in self._templates:
            for gram in template.bigrams:
                self._by_gram.setdefault(gram, []).append(template)
        self._grams = frozenset(self._by_gram)

    def _template(self, name: str, grams: frozenset, spread: dict[str, int]) -> _Template:
        share = self._threshold / (2 - self._threshold)
        least, most = math.ceil(share * len(grams) - 1e-9), math.floor(len(grams) / share + 1e-9)

        def word(gram: tuple[str, str]) -> str:
            # The word that ordinary text is least likely to hold: in no other template, then the longer.
            return max(gram, key=lambda w: (len(w) > 0, len(w), -spread.get(w, 0), w))

        # With fewer than `least` bigrams in common there is no match: one of any len - least + 1 must be there.
        kept = sorted(grams, key=lambda g: (-len(word(g)), g))[: len(grams) - least + 1]
        extra = math.floor(len(grams) * (2 / self._threshold - 2) + 1e-9)
        return _Template(name, grams, least, most, extra, frozenset(word(g) for g in kept))

    def matches(self, text: str | None) -> list[Match]:
        """Matches of whole lines that do not overlap, best first taken, in text order. Lines count from 0.

        Lines that begin with a copyright statement are passed over.
        """
        if not text or self._telling.isdisjoint(_WORDS.findall(text.lower())):
            return []
        lines = [[] if _COPYRIGHT.match(line) else words_of(line) for line in text.split("\n")]
        found = [m for i, line in enumerate(lines) for t in self._called(line) for m in self._around(t, lines, i)]
        chosen: list[Match] = []
        for m in sorted(set(found), key=lambda m: (-m.dice, m.first_line - m.last_line, m.first_line, m.license)):
            if all(m.last_line < c.first_line or c.last_line < m.first_line for c in chosen):
                chosen.append(m)
        return sorted(chosen, key=lambda m: m.first_line)

    def _called(self, line: list[str]) -> list[_Template]:
        """The templates that have a telling word in the line."""
        return list({id(t): t for w in self._telling.intersection(line) for t in self._by_word[w]}.values())

    def _around(self, template: _Template, lines: list[list[str]], i: int) -> list[Match]:
        """The best matching run with line ``i`` as its first telling line, if any."""
        best: Match | None = None
        for first in range(i, -1, -1):
            if first < i and not template.telling.isdisjoint(lines[first]):
                break  # found from that line
            words = [w for line in lines[first : i + 1] for w in line]
            if len(bigrams(words)) > template.most:
                break
            if not lines[first]:
                continue  # a run begins and ends with words
            for last in range(i, len(lines)):
                if last > i:
                    words = words + lines[last]
                grams = bigrams(words)
                if len(grams) > template.most:
                    break
                if len(grams) >= template.least and lines[last]:
                    score = dice(grams, template.bigrams)
                    if score >= self._threshold and (best is None or score > best.dice):
                        best = Match(template.name, score, first, last)
        return [best] if best else []

    def word_matches(self, text: str | None) -> list[Match]:
        """Matches of any runs of words that do not overlap, in text order, with the lines that hold them.

        Of overlapping runs of one template the best by Dice counts, of those of several the one with the most
        bigrams in common, less those that differ: so a header stands before the notice that it begins with.
        """
        if not text:
            return []
        words = _WORDS.findall(text.lower())
        if self._telling.isdisjoint(words):
            return []
        found = self._runs(words, range(len(words)))
        lines = text.split("\n")
        if _STATEMENT.search(text):
            found += self._runs(*self._without_statements(lines))
        if not found:
            return []
        found.sort(key=lambda r: (-r.dice, r.first - r.last, r.first))
        by_template: dict[int, list[_Run]] = {}
        for run in found:
            by_template.setdefault(id(run.template), []).append(run)
        best = [run for runs in by_template.values() for run in _apart(runs)]
        best.sort(key=lambda r: (-r.weight, -r.dice, r.first - r.last, r.first, r.template.name))
        line_of = [i for i, line in enumerate(lines) for _ in words_of(line)]
        chosen = sorted(_apart(best), key=lambda r: r.first)
        return [Match(r.template.name, r.dice, line_of[r.first], line_of[r.last]) for r in chosen]

    def _without_statements(self, lines: list[str]) -> tuple[list[str], list[int]]:
        """The words outside copyright statements, and their numbers among all words."""
        words, numbers, before = [], [], 0
        for line in map(str.lower, lines):
            spans = [m.span() for m in _STATEMENT.finditer(line)]
            for m in _WORDS.finditer(line):
                if not any(begin <= m.start() < end for begin, end in spans):
                    words.append(m.group())
                    numbers.append(before)
                before += 1
        return words, numbers

    def _runs(self, words: Sequence[str], numbers: Sequence[int]) -> list[_Run]:
        """For each template and each first bigram, the best matching run, if any."""
        grams = list(zip(words, words[1:])) or [(w, "") for w in words]
        shared: dict[int, list] = {}
        for gram in self._grams.intersection(grams):
            for template in self._by_gram[gram]:
                shared.setdefault(id(template), [template, 0])[1] += 1
        near = [template for template, count in shared.values() if count >= template.least]
        if not near:
            return []
        places = [i for i, gram in enumerate(grams) if gram in self._grams]
        runs = []
        for template in near:
            hits = [i for i in places if grams[i] in template.bigrams]
            for first in hits[: len(hits) - template.least + 1]:
                if run := self._from(template, grams, first, numbers):
                    runs.append(run)
        return runs

    def _from(self, template: _Template, grams: list, first: int, numbers: Sequence[int]) -> _Run | None:
        """The best matching run that begins with the bigram at ``first``, if any."""
        seen, common, best = set(), 0, None
        for last in range(first, len(grams)):
            gram = grams[last]
            if gram in seen:
                if gram == grams[first]:
                    break  # as good without its first word
                continue
            seen.add(gram)
            if gram not in template.bigrams:
                if len(seen) - common > template.extra:
                    break
                continue
            common += 1
            sizes = len(seen) + len(template.bigrams)
            score = 2 * common / sizes
            if score >= self._threshold and (best is None or score > best.dice):
                end = min(last + 1, len(numbers) - 1)
                best = _Run(template, score, 3 * common - sizes, numbers[first], numbers[end])
        return best


_scanners: dict[float, Scanner] = {}


def scan(df: DataFrame, text: str = "text", threshold: float = THRESHOLD, whole_lines: bool = False) -> DataFrame:
    """The rows with ``n_lines`` and ``matches``: array of (license, dice, first_line, last_line).

    Whole texts are scanned; matches of one text do not overlap. Any run of words can match, on request only runs of
    ``whole_lines``. A NULL or empty text has no matches, and
    no lines if NULL. Equal rows are scanned alike; an empty table gives an empty result. Columns of these names
    are replaced, others carried along. No row moves.
    """
    names = {"n_lines": "long", "matches": "array<struct<license: string, dice: double, first_line: int, last_line: int>>"}
    kept = [c for c in df.columns if c not in names]
    given = df.select(*(f"`{c}`" for c in kept))

    def run(batch):
        if threshold not in _scanners:
            _scanners[threshold] = Scanner(templates(), threshold)
        texts = batch.column(text).to_pylist()
        matches = _scanners[threshold].matches if whole_lines else _scanners[threshold].word_matches
        found = [[vars(m) for m in matches(t)] for t in texts]
        out = {c: batch.column(c) for c in kept}
        return out | {"n_lines": [0 if t is None else t.count("\n") + 1 for t in texts], "matches": found}

    return map_batches(given, run, fields(given, **names))
