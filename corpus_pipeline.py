"""From documents to token counts: language, near-duplicates, source mix, BPE.

Every stage takes (spark, docs, sf_dir) and works on all documents that the stage before has kept. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aforo.llm import bpe, langid, mixing, neardup
from aforo.sources.scratch import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
BPE_FILE = "byte_bpe_50k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents without a language; those without a label get the predicted one, which stays to the end.

    Where no label can be learned from, every text with a letter has a language, which stays ``und`` if not labelled.
    Texts that are NULL or empty, or hold no letter, have none and go. Of equally likely languages the first in
    order is taken; repeated rows are judged each and alike; texts of any length are read whole. Of no rows there
    are none; columns besides those of ``documents`` are left out.
    """
    docs = docs.select(*COLUMNS)
    model = langid.train(docs)
    has_one = F.col("lang_pred") != langid.UNKNOWN if model.languages else F.col("text").rlike(langid.WORD)
    found = langid.identify(docs, model).filter(has_one)
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group: five words, similarity 0.8, the least id.

    A document is an id with a text: rows that repeat both are one, of which the least language, source and
    length stay, and an id's other texts are judged for themselves. NULL ids come after all others. Texts that are
    NULL or empty, or hold no word, are alike with nothing and stay; equal texts under one id are no tie, and
    equal texts under several leave the least id. Of no rows there are none; columns besides those of
    ``documents`` are left out.
    """
    docs = docs.select(*COLUMNS)
    document = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.sha2("text", 256).alias("digest"))
    kept = neardup.near_duplicates(docs.select(document.alias("_document"), "text"), key="_document").filter("kept")
    kept = kept.select("_document").distinct()
    rest = F.struct("lang", "source", "n_chars", "text")
    found = docs.withColumn("_document", document).join(kept, "_document", "left_semi").groupBy("_document").agg(F.min(rest).alias("_rest"))
    return found.select("_document.doc_id", "_rest.*").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document and time that the mix takes it; the last take of a source ends with its target's last word.

    ``n_chars`` is that of the text as taken. Sources go by code point, NULL last; documents without words are
    never taken. Repeated rows are documents each, and ties in a source's order are rows alike in id and size, of
    which it does not matter which comes first. Texts of any length are taken whole, but for a last one. Of no rows
    there are none; columns besides those of ``documents`` are left out.
    """
    mixed = mixing.mixed_documents(mixing.mix(docs.select(*COLUMNS)))
    return mixed.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language and tokens of each row, and digests of its ids and of the text that they decode to.

    A NULL text counts as empty, which has no tokens. Repeated rows are encoded each, so there are no ties; texts of
    any length are read whole. Of no rows there are none; other columns are left out.
    """
    vocabulary = bpe.Vocabulary.load(public_tokenizers.path(BPE_FILE))
    return bpe.digest(docs.select("doc_id", "lang", "text"), vocabulary, carry=("doc_id", "lang"))


STAGES = [("language", language), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("encode", encode)]

# A language model and banded hashes have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *stages, (_, last) = STAGES
    for name, stage in stages:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return last(spark, docs, sf_dir)
