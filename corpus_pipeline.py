"""Corpus pipeline: from documents to the tokens of a deduplicated, weighted mix.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; the driver
of the pipeline writes its result as Parquet and reads it again as the next stage's docs.

1. language: rows whose language can't be told (no text, no letters, or no labelled row at all) go.
2. exact: of equal texts (A-Z lower-cased) one row stays, that of the largest doc_id.
3. near: of near-duplicate components one row stays, that of the least doc_id. Links are those of
   op7_minhash, 2-word shingles at 0.8.
4. mix: sources are brought to their target weights; rows repeat where a source is short.
5. tokens: byte-level BPE ids, with the digests of the ids and of what they decode to.

Results for odd rows. Stages decide on rows, by doc_id and text together, so rows that repeat a doc_id
are documents each and none goes along with another. A null doc_id is the least in exact and the last
in near. Of rows repeated as a whole exact leaves one; so does near, but for rows without words, which
it leaves alone. mix takes repeated rows alike. Empty tables pass through all stages. Columns may have
any names; all but the last stage return those they got, in their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lotwise.llm import bpe, exact_dedup, langid, minhash, mixing
from lotwise.llm.common import outlive, scratch, stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.drop_unidentified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs)


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("tokens", tokens)]

#: Language identification and tokens have no SQL form; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch():  # what a stage stores on its way goes when its result is stored
            docs = outlive(stored(stage(spark, docs, sf_dir), name))
    return STAGES[-1][1](spark, docs, sf_dir)
