"""The corpus pipeline: classify, drop near-duplicates, cut repeats, mix, pack.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept.
All but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.best_fit_packing import pack
from tributary.llm.curriculum_mix import mixture
from tributary.llm.prob_minhash import one_of_each
from tributary.llm.site_quality import quality
from tributary.llm.storage import table, written
from tributary.llm.substring_dedup import substring_dedup

#: SQL can't express the hashes, the fit, the packing plan or the tokenizer; see tests/llm.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    scored = quality(docs, table(spark, sf_dir, "labels"), carry=True)
    return scored.where("keep").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-word windows that an earlier document has; texts that lose nothing are unchanged.

    n_chars follows the text.
    """
    cut = substring_dedup(docs)
    kept = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        kept["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("c_n_chars"))
    return cut.select(*[kept.get(c, F.col(f"`c_{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training stream at the target weights: documents by position, some several times."""
    return mixture(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 4096: a row per piece with its sequence and place."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("mixing to target weights", mix),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
