"""The stages one by one on small tables, and the whole, against brute force."""

import hashlib

import public_tokenizers
import pytest
from test_mixing import targets
from test_neardup import brute_force
from tokenizers import Tokenizer

import corpus_pipeline as pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def document(i, text, lang="en", source="a"):
    return (i, text, lang, source, None if text is None else len(text))


def test_shape():
    assert [name for name, _ in pipeline.STAGES] == ["language", "near_dedup", "mix_sources", "encode"]


def test_language_drops_what_has_none(spark, frame):
    rows = [document(i, f"the house of the water number {i}") for i in range(30)]
    rows += [document(100, None), document(101, "123 456"), document(102, ""), document(103, "the unlabelled water", None)]
    got = pipeline.language(spark, frame(SCHEMA, rows), "").collect()
    assert sorted(r.doc_id for r in got) == [*range(30), 103]
    assert {r.lang for r in got} == {"en"} and list(got[0].asDict()) == list(pipeline.COLUMNS)


def test_language_keeps_texts_where_nothing_can_be_learned(spark, frame):
    rows = [document(i, f"the house number {i}", None) for i in range(5)] + [document(100, None, None), document(101, "123", None), document(102, "", None)]
    got = pipeline.language(spark, frame(SCHEMA, rows), "").collect()
    assert sorted((r.doc_id, r.lang) for r in got) == [(i, "und") for i in range(5)]


def test_one_of_each_group_stays(spark, frame):
    base = " ".join(f"w{i}" for i in range(100))
    rows = [document(5, base), document(3, base + " more"), document(9, base.upper()), document(7, "something else entirely here now")]
    rows += [document(7, "something else entirely here now"), document(8, ""), document(2, None)]
    got = pipeline.near_dedup(spark, frame(SCHEMA, rows), "").collect()
    assert sorted(r.doc_id for r in got) == [2, 3, 7, 8]


def test_an_id_with_several_texts(spark, frame):
    """Each text is judged for itself; of rows that repeat id and text the least stays, whatever the order."""
    base = " ".join(f"w{i}" for i in range(40))
    rows = [document(1, base), document(2, base), document(2, "other words"), document(2, "other words", "de", "b"), document(2, "other words", None)]
    rows += [document(None, base), document(None, "lone words"), document(3, None), document(3, "")]
    for order in (rows, rows[::-1]):
        got = pipeline.near_dedup(spark, frame(f"{SCHEMA}, node string, kept int", [(*r, "x", 1) for r in order]), "").collect()
        assert sorted(map(str, got)) == sorted(
            f"Row(doc_id={i}, text={t!r}, lang={lang!r}, source='a', n_chars={None if t is None else len(t)})"
            for i, t, lang in [(1, base, "en"), (2, "other words", None), (None, "lone words", "en"), (3, None, "en"), (3, "", "en")]
        )


def test_the_model_fills_labels_to_the_end(spark, frame):
    rows = [document(i, f"the house of the water number {i}") for i in range(30)] + [document(100 + i, f"das haus am wasser {i}", "de") for i in range(30)]
    rows += [document(200, "the water", None), document(201, "das wasser", None)]
    docs = frame(SCHEMA, rows)
    found = {r.doc_id: r.lang for r in pipeline.encode(spark, pipeline.language(spark, docs, ""), "").collect()}
    assert found[200] == "en" and found[201] == "de" and len(found) == 62


def test_clashing_columns_and_long_texts(spark, frame):
    long = "long words " * 60_000
    rows = [(*document(i, t), "x", 7, 0.5) for i, t in enumerate([long, "few words", None, ""])]
    docs = frame(f"{SCHEMA}, lang_pred string, size int, score double", rows)
    for name, stage in pipeline.STAGES[:-1]:
        got = stage(spark, docs, "")
        assert got.columns == list(pipeline.COLUMNS)
        assert any(r.text and len(r.text) > 400_000 for r in got.collect()) or name == "mix_sources"
    assert {r.n_tokens for r in pipeline.encode(spark, docs, "").collect()} >= {0, 2}


def test_mix_takes_effect(spark, frame):
    rows = [document(i, f"one two three {i}", "en", "ab"[i % 2]) for i in range(60)]
    got = pipeline.mix_sources(spark, frame(SCHEMA, rows), "").collect()
    words = {s: sum(len(r.text.split()) for r in got if r.source == s) for s in "ab"}
    assert words == {s: pytest.approx(t, abs=1) for s, t in targets({"a": 120, "b": 120}).items()}
    assert all(r.n_chars == len(r.text) and rows[r.doc_id][1].startswith(r.text) for r in got)


@pytest.mark.parametrize("rows", [[], [document(1, None)]])
def test_stages_of_nothing(spark, frame, rows):
    for name, stage in pipeline.STAGES:
        assert stage(spark, frame(SCHEMA, rows), "").count() == (len(rows) if name in ("near_dedup", "encode") else 0)


def test_run_over_a_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    lettered = [r for r in docs if r.text and any(c.isalpha() for c in r.text)]
    groups = brute_force([(r.doc_id, r.text) for r in lettered], 5, 80)
    kept = {r.doc_id: r for r in lettered if groups[r.doc_id][1] == r.doc_id}
    sizes = {}
    for r in kept.values():
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.encode().split())
    library = Tokenizer.from_file(public_tokenizers.path(pipeline.BPE_FILE))
    whole = {}
    for r in kept.values():
        ids = library.encode(r.text, add_special_tokens=False).ids
        whole[r.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())
    got = pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in got} <= set(kept)
    labels = {r.doc_id: r.lang for r in docs}
    assert all(r.lang and r.lang == (labels[r.doc_id] or r.lang) for r in got)
    # Each source's last document may be cut; all other takes are whole.
    cut = [r for r in got if tuple(r)[2:] != whole[r.doc_id]]
    assert len(cut) <= len(sizes)
    words = {}
    for r in got:
        if tuple(r)[2:] == whole[r.doc_id]:
            source = kept[r.doc_id].source
            words[source] = words.get(source, 0) + len(kept[r.doc_id].text.encode().split())
    longest = max(len(r.text.encode().split()) for r in kept.values())
    for source, target in targets(sizes).items():
        assert target - longest <= words.get(source, 0) <= target + 1
