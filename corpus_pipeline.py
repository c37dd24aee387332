"""A training-corpus pipeline over ``documents``: five stages of the ``llm`` operators.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and returns
a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm import langid, near_dup, packing, suffix_dedup, toxicity
from stemma.llm._spark import held_out, stored, table, unused
from stemma.llm._superkmers import NO_ID


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the PU classifiers score below one half.

    A null or empty text scores the classifiers' bias; without confirmed positives all rows stay; equal rows
    share their fate; an empty table gives an empty one.
    """
    labels = table(spark, sf_dir, "labels").where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    seen = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    weights = toxicity.fit(docs.where(~held_out(F.col("doc_id"))), seen.where("toxic = 1"), toxicity.class_prior(seen))
    score = unused(docs, "_toxicity")
    scored = toxicity.score(docs, weights, keep=tuple(docs.columns), out=score)
    return scored.where(F.col(score) < 0.5).select(docs.columns)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that lie nearer to a language's profile than a text that shares nothing with it.

    ``und`` (null texts and those without a letter) and scores of 0 go; without any profile all rows stay;
    equal rows share their fate; an empty table gives an empty one.
    """
    profiles = stored(langid.profiles(docs.where(~held_out(F.col("doc_id")))), "profiles")
    if profiles.isEmpty():
        return docs
    lang, score = unused(docs, "_lang_pred"), unused(docs, "_lang_score")
    found = langid.identify(docs, profiles, keep=tuple(docs.columns), out=(lang, score))
    return found.where((F.col(lang) != "und") & (F.col(score) > 0)).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group that links of similarity 0.8 or more hold together.

    Of rows equal in id and text one stays, of other rows that share the least id all; a null id is greater
    than any other; null and empty texts are linked with nothing; an empty table gives an empty one.
    """
    key, text_hash = unused(docs, "_id"), unused(docs, "_hash")
    known = {key: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), text_hash: F.xxhash64(F.coalesce("text", F.lit("")))}
    kept = near_dup.near_duplicates(docs, threshold=0.8).where("kept").select(known[key].alias(key), F.col("text_hash").alias(text_hash))
    # the same keys serve the join and the choice of one of equal rows, so texts are shuffled once
    return docs.withColumns(known).join(kept, [key, text_hash], "left_semi").dropDuplicates([key, text_hash]).select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every substring of 200 bytes or more that occurs twice; ``n_chars`` follows the text.

    All rows stay, with what is left of their texts; null texts stay null; an empty table gives an empty one.
    """
    return suffix_dedup.clean_texts(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of what is left into sequences of at most 2048.

    A null or empty text is its end token alone; equal rows are packed one by one; an empty table gives no rows.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("packing", pack),
]

#: Trained models and the sketch search have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``, storing each but the last in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
