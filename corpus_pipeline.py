"""A training corpus from raw documents: filter, deduplicate, mix, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet and reads
it again for the next one. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.llm import bpe, minhash, mixing, repeats, toxicity
from cohortlake.llm.queries import held_out, table
from cohortlake.llm.stage import Scratch

#: No source is repeated more often than this; every document is taken at least once.
MOST_EPOCHS = 1.2
#: Similarity in percent from which texts are near duplicates of each other.
NEAR_PERCENT = 80
#: Passages of so many words that occur more than once are cut, and strings of so many bytes.
REPEATED_WORDS, REPEATED_BYTES = 51, 400


#: The columns that stages read; all others are passed on as they are.
READ = ("doc_id", "text", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keeping_columns(stage: Stage) -> Stage:
    """The stage with docs' further columns under names that no operator uses, and back under their own after it."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [c if c in READ else f"__column{i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*names), sf_dir).select(*names).toDF(*docs.columns)

    return run_stage


@keeping_columns
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a toxicity below 0.5, by a model of the labelled rows that aren't held out."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(~held_out()))
    scored = toxicity.score(docs.withColumn("__id", F.col("doc_id")), model, id_col="__id", carry=docs.columns)
    return scored.filter("score < 0.5")


@keeping_columns
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the smallest doc_id; rows without a doc_id stay."""
    kept = minhash.near_duplicates(docs, percent=NEAR_PERCENT).filter("kept").select("doc_id").distinct()
    chosen = docs.join(kept.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return chosen.unionByName(docs.filter("doc_id IS NULL"))


@keeping_columns
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the passages of over 50 words and the strings of 400 bytes that occur more than once; n_chars, where there is one, is counted anew."""
    cut = repeats.remove_repeats(docs.withColumn("__id", F.col("doc_id")), id_col="__id", length=REPEATED_BYTES, words=REPEATED_WORDS, carry=[c for c in docs.columns if c != "text"], whole_characters=True)
    text = cut.withColumn("text", F.col("kept").cast("string"))
    return text.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else text


@keeping_columns
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, and those of small sources again so that shares even out as far as MOST_EPOCHS allows."""
    return mixing.realise(mixing.mix(docs, most_epochs=MOST_EPOCHS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text: doc_id, n_tokens, ids (little-endian unsigned 32-bit)."""
    ids = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return ids.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("mixing", mix_sources),
    ("bpe", encode),
]
#: Toxicity is learned and BPE merges are iterative: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
