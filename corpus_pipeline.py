"""From raw documents to token ids: each stage takes what the one before it kept.

Every stage function has (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of the docs given, also those that have the name of a column an operator adds.

Defined results, in every stage: an empty table gives an empty one; a null text counts as empty and
stays null; texts are read whole. The quality rules reject null and empty texts and treat repeated rows
alike. The n-gram join keeps rows without words and one row of each group of copies, repeated
rows included. The secret scan keeps all rows. Mixing draws repeated rows alike, and null ids and sources
are values like others. Encoding keeps all rows; a null or empty text has no ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.llm import bpe, mixing, ngram_join, quality, secrets
from barloom.llm.common import read, replace_column, store, unstore

#: Near copies share 80 percent of their five-word shingles.
NEAR_WORDS, NEAR_PERCENT = 5, 80
MIX_ALPHA, MIX_SEED = 0.7, 17


def own_columns(docs: DataFrame, step: Callable[[DataFrame], DataFrame], *used: str) -> DataFrame:
    """``step`` over ``docs``, whose columns other than those ``used`` go by plain numbered names meanwhile, so
    that none of them meets a column of the step; the result has the columns of ``docs``."""
    inside = [c if c in used else f"own_{k}" for k, c in enumerate(docs.columns)]
    out = step(docs.toDF(*inside))
    return out.select(*[F.col(a).alias(b) for a, b in zip(inside, docs.columns)])


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; the field is fitted on the labelled ones among
    all documents."""
    field = quality.fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return own_columns(docs, lambda d: quality.apply_rules(d, field).filter("kept"), "text")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return own_columns(docs, lambda d: ngram_join.representatives(d, NEAR_WORDS, NEAR_PERCENT), "doc_id", "text")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and ``n_chars`` counted anew where a text
    has changed."""
    length = F.when(F.size("secrets") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return own_columns(docs, lambda d: replace_column(secrets.redact(secrets.scan(d)), "n_chars", length),
                       "doc_id", "text", "n_chars")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents repeated or left out by draw, and shuffled."""
    return own_columns(docs, lambda d: mixing.mix(d, alpha=MIX_ALPHA, seed=MIX_SEED), "doc_id", "source", "text")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, checked by decoding: a text that came back changed would stop
    the job."""
    rows = bpe.decode(bpe.encode(docs.select("doc_id", "source", "text")))
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    ids = F.when(same, F.col("ids")).otherwise(
        F.raise_error(F.lit("decoding did not give the text back")).cast("array<int>"))
    return rows.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids"))


STAGES = [("quality rules", good), ("n-gram jaccard join", distinct), ("secret scan", without_secrets),
          ("mixing", mixed), ("byte-level bpe", tokens)]

#: The quality rules and the near copies are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage over what the others kept. A stage's table goes once the next one is written."""
    docs, before = read(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = store(docs, f"stage{k}")
            if before is not None:
                unstore(before)
            before = docs
    return docs
