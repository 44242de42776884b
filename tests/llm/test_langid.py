import math
import random
import zlib
from collections import Counter

import pytest
import regex

from aforo.llm import langid

VOCABULARY = {
    "en": "the of and to in that was his with for house water green morning".split(),
    "de": "der die und das nicht von mit sich auch haus wasser grün morgen über".split(),
    "fr": "le la les et des que dans pour elle maison eau vert matin été".split(),
}
SCHEMA = "doc_id long, text string, lang string"


def known(entries):
    """Gains of each entry by language."""
    return {
        name: dict(zip(entries.places[i:j].tolist(), entries.gains[i:j].tolist()))
        for name, i, j in zip(entries.names, entries.begins, entries.begins[1:])
    }


def documents(n=300, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rnd.choice(list(VOCABULARY))
        rows.append((i, " ".join(rnd.choice(VOCABULARY[lang]) for _ in range(rnd.randint(4, 30))), lang))
    return rows


def out_of_training(key):
    return zlib.crc32(str(key).encode()) % 3 == 1


def test_held_out_accuracy(frame):
    df = frame(SCHEMA, documents())
    got = langid.identify(df.withColumn("held", langid.held_out(df["doc_id"])), langid.train(df)).collect()
    assert all(r.held == out_of_training(r.doc_id) for r in got)
    held = [r for r in got if r.held]
    assert len(held) > 50 and all(r.lang == r.lang_pred and 0 < r.score <= 1 for r in held)


def test_held_out_rows_and_null_labels_teach_nothing(frame):
    """Their labels are wrong here, and one language is theirs alone."""
    rows = [(i, t, "xx" if out_of_training(i) else (None if i % 5 == 0 else lang)) for i, t, lang in documents()]
    model = langid.train(frame(SCHEMA, rows))
    assert model.languages == ("de", "en", "fr")
    same = langid.train(frame(SCHEMA, [r for r in rows if r[2] not in ("xx", None)]))
    for one, other in ((same.words, model.words), (same.grams, model.grams)):
        assert known(one) == known(other) and (one.unseen == other.unseen).all()


def test_words_first_then_shorter_n_grams(frame):
    scorer = langid.Scorer(langid.train(frame(SCHEMA, documents())))
    found = scorer.predict(["water", "wasserhaus", "maisonnettes", "ζζζ"])
    assert [f[0] for f in found[:3]] == ["en", "de", "fr"]
    # Nothing known but where a word begins and ends: all languages nearly alike.
    assert found[3][1] == pytest.approx(1 / 3, abs=0.02)


def test_scores_by_hand(frame):
    """Two languages, one word each: the frequencies are smoothed by a half."""
    rows = [(i, "aa aa bb" if i % 2 else "bb cc", "x" if i % 2 else "y") for i in range(40) if not out_of_training(i)]
    model = langid.train(frame(SCHEMA, rows))
    n = {"x": sum(1 for r in rows if r[2] == "x"), "y": sum(1 for r in rows if r[2] == "y")}
    expected = [(2 * n["x"] + 0.5) / (3 * n["x"] + 1.5), 0.5 / (2 * n["y"] + 1.5)]
    assert langid.Scorer(model).word_scores(["aa"])[0].tolist() == pytest.approx([math.log(e) for e in expected], rel=1e-9)


def test_text_per_language_is_bounded(frame):
    df = frame(SCHEMA, documents(900))
    kept = langid.labelled(df, "text", "lang", "doc_id", 15_000).selectExpr("lang", "char_length(text) AS n").groupBy("lang").sum("n").collect()
    assert len(kept) == 3 and all(3000 <= r[1] <= 7500 for r in kept)


def test_too_many_labels(frame, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 2)
    with pytest.raises(ValueError):
        langid.train(frame(SCHEMA, documents(50)))


def brute_force(rows, texts):
    """Predictions from plain counts: words, else n-grams of the longest length known."""
    counts = {}
    for key, text, lang in rows:
        if key is not None and lang is not None and text and not out_of_training(key):
            for word in regex.findall(langid.WORD, text.lower()):
                counts.setdefault(lang, Counter())[word] += 1
    languages = sorted(counts)
    tables = [{lang: c for lang, c in counts.items()}]
    for size in range(1, langid.LONGEST_GRAM + 1):
        table = {lang: Counter() for lang in languages}
        for lang, words in counts.items():
            for word, n in words.items():
                marked = f"^{word}$"
                for i in range(len(marked) - size + 1):
                    table[lang][marked[i : i + size]] += n
        tables.append(table)
    names = [{x for c in t.values() for x in c} for t in tables]

    def log(size, x, lang):
        table = tables[size][lang]
        return math.log((table[x] + 0.5) / (sum(table.values()) + 0.5 * len(names[size])))

    def scores(word):
        if word in names[0]:
            return [log(0, word, lang) for lang in languages]
        marked = f"^{word}$"
        for size in range(langid.LONGEST_GRAM, 0, -1):
            found = [x for i in range(len(marked) - size + 1) if (x := marked[i : i + size]) in names[size]]
            if found:
                means = [sum(log(size, x, lang) for x in found) / len(found) for lang in languages]
                middle = sum(means) / len(means)
                return [(m - middle) * langid.DISCOUNT ** (langid.LONGEST_GRAM - size + 1) for m in means]
        return [0.0] * len(languages)

    predictions = []
    for text in texts:
        words = regex.findall(langid.WORD, (text or "").lower())
        if not words:
            predictions.append(("und", 0.0))
            continue
        sums = [sum(s) for s in zip(*map(scores, words))]
        best = max(range(len(sums)), key=lambda i: (sums[i], -i))
        predictions.append((languages[best], 1 / sum(math.exp(s - sums[best]) for s in sums)))
    return predictions


@pytest.mark.parametrize("kept", [langid.PIECES_KEPT, 20])
def test_against_brute_force(frame, monkeypatch, kept):
    """Known and unknown words, punctuation, marks, all lengths of n-grams; also where a worker keeps few pieces."""
    monkeypatch.setattr(langid, "PIECES_KEPT", kept)
    rnd = random.Random(8)
    rows = [(i, t, "und" if i % 17 == 0 else lang) for i, t, lang in documents(150)] + [(500, None, "en"), (None, "lost water", "en")]
    texts = [t for _, t, _ in rows] + ["", "123", "Water, wasser; l'eau", "e\u0301te\u0301", "x", "qqq zzz", "morgens MORGEN maisons"]
    texts += ["".join(rnd.choice("watershmoinleé .,") for _ in range(rnd.randint(1, 40))) for _ in range(150)]
    model = langid.train(frame(SCHEMA, rows))
    assert model.languages == ("de", "en", "fr", "und")
    scorer = langid.Scorer(model)
    got = [p for i in range(0, len(texts), 30) for p in scorer.predict(texts[i : i + 30])]
    expected = brute_force(rows, texts)
    assert [lang for lang, _ in got] == [lang for lang, _ in expected]
    assert [s for _, s in got] == pytest.approx([s for _, s in expected], rel=1e-6)


def test_ties_go_to_the_first(frame):
    """Both languages have the same texts."""
    keys = [i for i in range(60) if not out_of_training(i)][:30]
    rows = [(key, f"same words {i // 2}", "yx"[i % 2]) for i, key in enumerate(keys)]
    scorer = langid.Scorer(langid.train(frame(SCHEMA, rows)))
    assert scorer.predict(["same words", "unseen", "w"]) == [("x", pytest.approx(0.5))] * 3


def test_nulls_empty_long_and_clashing_columns(frame):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !? 45", "en"), (None, "the water of the house", None), (5, "der und " * 200_000, "de"), (5, "der und", "de")]
    df = frame(SCHEMA, documents() + rows).selectExpr("*", "1 AS score", "'q' AS lang_pred")
    got = langid.identify(df, langid.train(df))
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    found = {r.text: r for r in got.collect()}
    for text in (None, "", "123 !? 45"):
        assert (found[text].lang_pred, found[text].score) == ("und", 0.0)
    assert found["the water of the house"].lang_pred == "en" and found["der und"].lang_pred == "de"
    assert found["der und " * 200_000].lang_pred == "de"


@pytest.mark.parametrize("rows", [[], [(1, "text without a label", None)]])
def test_nothing_to_learn_from(frame, rows):
    df = frame(SCHEMA, rows)
    assert [r.lang_pred for r in langid.identify(df, langid.train(df)).collect()] == ["und"] * len(rows)


def test_every_label_is_learned(frame):
    """More than 200 languages, the rarest of which has one row."""
    keys = [i for i in range(2000) if not out_of_training(i)]
    letters = "abcdefghijklmnop"
    names = [x + y for x in letters for y in letters][:220]
    rows = [(key, names[i % 219] * 4, names[i % 219]) for i, key in enumerate(keys[:438])] + [(keys[438], "zzzyzzz", names[219])]
    model = langid.train(frame(SCHEMA, rows))
    assert model.languages == tuple(sorted(names))
    assert langid.Scorer(model).predict(["zzzyzzz"])[0][0] == names[219]
    # All words of all languages are known, whatever their number.
    assert sorted(model.words.names) == sorted({r[1] for r in rows})
