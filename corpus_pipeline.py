"""The corpus pipeline: quality rules, language, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps with the columns of ``documents``; the last
returns the packed pieces. ``STAGES`` may be run with a written table between two stages, or in one go by ``run``.

For all stages: columns of ``docs`` besides those of ``documents`` are left out; an empty table gives an empty one; repeated
rows are judged each, but for near duplicates, where one stays; texts are read whole, however long. Nulls in ``lang``,
``source`` and ``n_chars`` are carried. What null texts and ids do is said at each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetra.llm import jaccard_join, lang_id, rule_ledger, substring_dedup, vector_packing
from kinetra.llm.shared import written

#: Near duplicates share four fifths of their five-word shingles; a passage of 50 words is a repeated one.
SHINGLE, PERCENT, PASSAGE = 5, 80, 50
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that pass the policy ``corpus-1``; short documents are not rejected as such.

    A null or empty text breaks none of its rules and stays; a null id stays null.
    """
    ledger = rule_ledger.with_ledger(docs.select(*COLUMNS), out="_ledger")
    return ledger.where(rule_ledger.passes("corpus-1", F.col("_ledger.bits"))).drop("_ledger")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised, by a model learned from a sample of the labelled ones.

    A text that is null or has no letter goes; a null id stays null. Without labelled documents none is recognised and all go.
    """
    named = lang_id.with_language(docs.select(*COLUMNS), lang_id.train(docs), out="_language")
    return named.where("_language.accepted").drop("_language")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates: the one with the smallest id.

    Rows that share an id are one document, of which one text stays. Documents without words are alone in their class, those
    without an id in none; both stay.
    """
    found = written(jaccard_join.classes(docs, SHINGLE, PERCENT).withColumn("copy", F.col("component_id") != F.col("doc_id")))
    h1, h2 = jaccard_join.text_hashes(F.col("text"))
    copies = written(found.where("copy").select(F.col("doc_id").alias("gone"), "h1", "h2").distinct())
    rows = docs.select(*COLUMNS)
    same = (F.col("doc_id") == F.col("gone")) & (h1 == F.col("h1")) & (h2 == F.col("h2"))
    kept = rows.join(F.broadcast(copies) if copies.count() <= jaccard_join.BROADCAST_IDS else copies, same, "left_anti")
    own = F.struct("h1", "h2")
    repeated = found.where("not copy").groupBy(F.col("doc_id").alias("twice")).agg(F.min(own).alias("first"), F.count("*").alias("n")).where("n > 1")
    repeated = written(repeated)
    if repeated.isEmpty():
        return kept
    first = (F.col("doc_id") == F.col("twice")) & (h1 == F.col("first.h1")) & (h2 == F.col("first.h2"))
    again = kept.join(repeated, first).select(*COLUMNS).dropDuplicates(["doc_id"])
    return kept.join(repeated, F.col("doc_id") == F.col("twice"), "left_anti").unionByName(again)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out passages that an earlier document holds; documents without any stay as they are.

    A null text stays null; a document without an id is no source and loses nothing. ``n_chars`` follows the text.
    """
    parsed = substring_dedup.dedup(docs, PASSAGE, carry=["lang", "source", "n_chars"], as_is=True)
    length = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("carried.n_chars"))
    return parsed.select("doc_id", F.col("kept_text").alias("text"), "carried.lang", "carried.source", length.alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences of at most 2048, 12 segments and 1984 tokens that bear loss; a null text is its end token alone."""
    return vector_packing.pack_limited(docs, TOKENIZER)


STAGES = [
    ("quality_rules", quality_rules),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", packing),
]

#: The stages' models and closures are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, with lineage cut between them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = docs if k == len(STAGES) - 1 else written(docs)
    return docs
