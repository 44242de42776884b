import random
import time

import pytest

from aforo.llm.license_texts import NAMES, TEXTS, templates
from aforo.llm.licenses import _COPYRIGHT, Scanner, bigrams, dice, scan, words_of


@pytest.fixture(scope="module")
def scanner():
    return Scanner(templates())


def brute_force(text, threshold=0.9):
    """The best Dice coefficient of any run of lines with any template, without pruning."""
    lines = [[] if _COPYRIGHT.match(line) else words_of(line) for line in text.split("\n")]
    sets = [(name, bigrams(words_of(t))) for name, t in templates()]
    best = 0.0
    for first in range(len(lines)):
        for last in range(first, len(lines)):
            words = [w for line in lines[first : last + 1] for w in line]
            if words and lines[first] and lines[last]:
                grams = bigrams(words)
                best = max([best, *(d for _, t in sets if (d := dice(grams, t)) >= threshold)])
    return best


def test_templates_find_themselves(scanner):
    for name, text in templates():
        found = scanner.matches(f"Some prose before.\n\n{text}\n\nAnd after it.")
        assert [m.license for m in found] == [name] and found[0].dice == 1.0


def test_pruning_loses_nothing(scanner):
    """Edited templates, cut, broken anew and mixed with prose, against all runs and all templates."""
    rnd = random.Random(5)
    for _ in range(120):
        name, text = rnd.choice(templates())
        words = [w if rnd.random() > 0.03 else rnd.choice(["foo", "license", ""]) for w in text.split()]
        for _ in range(rnd.randint(0, 3)):
            words.insert(rnd.randrange(len(words) + 1), "\n")
        document = "\n".join(["lorem ipsum dolor", " ".join(words), "Copyright (c) 2020 Someone", "sit amet"])
        found = scanner.matches(document)
        assert max((m.dice for m in found), default=0.0) == pytest.approx(brute_force(document))


def test_copyright_lines_are_passed_over(scanner):
    document = "Copyright (c) 2021 A. Person\n" + TEXTS["MIT"].replace("Software.\n", "Software.\n(c) 2022 B\n")
    assert [(m.license, m.dice) for m in scanner.matches(document)] == [("MIT", 1.0)]


def test_lines_of_a_text(scanner):
    document = "x y z\nReleased under the MIT License.\n\nLicensed under CC BY-NC 4.0.\nlast"
    assert [(m.license, m.first_line, m.last_line) for m in scanner.matches(document)] == [("MIT", 1, 1), ("CC-BY-NC-4.0", 3, 3)]


def test_letters_that_grow_in_lower_case(scanner):
    """``İ`` becomes two characters, at which a word breaks: words are counted alike with and without statements."""
    before = "\n".join(["İstanbul " * 10] * 5)
    document = f"{before}\nCopyright (c) 2021 A. Person\n{TEXTS['MIT']}"
    found = scanner.word_matches(document)
    assert [(m.license, m.dice, m.last_line) for m in found] == [("MIT", 1.0, document.rstrip().count("\n"))]
    assert found[0].first_line == 6


def test_unlike_texts(scanner):
    assert scanner.matches("The license of this software is a general permission of any version.") == []
    assert scanner.matches("license " * 5000) == []


def test_frame(frame):
    rows = [(1, None, 1), (2, "", 1), (3, "Released under the MIT License.", 1), (3, "Released under the MIT License.", 1), (None, "w " * 300_000, 1)]
    df = frame("doc_id long, text string, matches int", rows)
    got = scan(df)
    assert got.columns == ["doc_id", "text", "n_lines", "matches"]
    found = {r.doc_id: (r.n_lines, [m.license for m in r.matches]) for r in got.collect()}
    assert found == {1: (0, []), 2: (1, []), 3: (1, ["MIT"]), None: (1, [])}
    assert got.count() == 5 and scan(df.limit(0)).count() == 0


def best_run(text, sets):
    """The best Dice coefficient of any run of words with any template, without pruning."""
    words, best = words_of(text), 0.0
    for first in range(len(words)):
        for last in range(first + 1, len(words)):
            grams = bigrams(words[first : last + 1])
            best = max([best, *(d for t in sets if (d := dice(grams, t)) >= 0.9)])
    return best


def test_pruning_of_word_runs_loses_nothing():
    """Edited notices amid prose, cut by few or no line breaks, against all runs of words."""
    rnd = random.Random(6)
    texts = [t for t in templates() if t[0] not in TEXTS or len(t[1].split()) < 30][::5] + [("MPL-2.0", TEXTS["MPL-2.0"])]
    scanner, sets = Scanner(texts), [bigrams(words_of(t)) for _, t in texts]
    for _ in range(60):
        words = [w if rnd.random() > 0.04 else rnd.choice(["foo", "license"]) for w in rnd.choice(texts)[1].split()]
        words.insert(rnd.randrange(len(words) + 1), rnd.choice(["", "\n"]))
        document = " ".join(["lorem the license under", *words, "under the sit amet"])
        found = scanner.word_matches(document)
        assert max((m.dice for m in found), default=0.0) == pytest.approx(best_run(document, sets))


def test_notices_and_texts_amid_other_words(scanner, frame):
    mit = TEXTS["MIT"].replace("\n", " ")
    texts = [
        "The river was high. Licensed under CC BY 4.0. The house was old.",
        "Copyright 2020 X. Released under the MIT License.",
        "Copyright 2020 Some Body Released under the MIT License.",
        f"The river was high. MIT License Copyright (c) 2020 Jane Doe {mit} The house was old.",
        "x\nBefore it. Released under\nthe MIT License. Licensed under CC BY-NC 4.0. After it.",
        TEXTS["MIT"].replace("Software.\n", "Software.\nCopyright (c) 2022 Some Body. All rights reserved.\n"),
        "Prose. " + TEXTS["Apache-2.0"].replace("either express", "whether express").replace("\n", " "),
    ]
    found = {r.i: [(m.license, m.first_line, m.last_line) for m in r.matches] for r in scan(frame("i int, text string", list(enumerate(texts)))).collect()}
    assert found[0] == [("CC-BY-4.0", 0, 0)] and found[1] == found[2] == found[3] == [("MIT", 0, 0)]
    assert found[4] == [("MIT", 1, 2), ("CC-BY-NC-4.0", 2, 2)] and [m[0] for m in found[5]] == ["MIT"]
    assert found[6] == [("Apache-2.0", 0, 0)]
    assert [m.dice for m in scanner.word_matches(texts[5])] == [1.0]


def test_word_runs_of_unlike_and_repeated_texts(scanner):
    assert scanner.word_matches(None) == [] and scanner.word_matches("license " * 5000 + "under the " * 5000) == []
    assert len(scanner.word_matches("Released under the MIT License. " * 3000)) == 3000
    for name, text in templates():
        assert [(m.license, m.dice) for m in scanner.word_matches(f"Some prose before. {text} And after it.")] == [(name, 1.0)]


def test_every_licence_is_found_by_its_own_text(scanner):
    """Full texts and headers in their usual wordings, none of which the nearest other licence may claim."""
    assert {name for name, text in templates() if len(bigrams(words_of(text))) > 20} == set(NAMES)
    gnu = TEXTS["GPL-3.0"].replace("GNU\nGeneral", "GNU General")
    texts = [
        *TEXTS.items(),
        ("GPL-2.0", gnu.replace("version 3", "version 2")),
        ("LGPL-2.1", gnu.replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1")),
        ("LGPL-3.0", gnu.replace("GNU General", "GNU Lesser General")),
        ("AGPL-3.0", gnu.replace("GNU General", "GNU Affero General")),
    ]
    for name, text in texts:
        for worded in (text, text.replace("useful", "helpful").replace("any", "every")):
            assert [m.license for m in scanner.word_matches(f"Some prose. {worded} And more.")] == [name]
            assert [m.license for m in scanner.matches(f"Some prose.\n{worded}\nAnd more.")] == [name]


def test_a_hundred_thousand_blank_lines(frame):
    """They cost no more than other lines, before and behind a notice."""
    begun = time.monotonic()
    text = "\n" * 100_000 + "Licensed under the MIT License.\n" + " \n" * 100_000
    got = scan(frame("doc_id long, text string", [(1, text), (2, "Licensed under the MIT License.")])).collect()
    assert [[m.license for m in r.matches] for r in got] == [["MIT"], ["MIT"]]
    assert time.monotonic() - begun < 60
