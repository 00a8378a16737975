"""The corpus pipeline: quality rules, line dedup, near-duplicates, source mixing, tokens.

Each stage works on all that the one before it kept. Its result is written as Parquet in the shared folder and read
again as the next stage's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from veriloom.llm.common import save, table
from veriloom.llm.cube_mixing import mix_documents
from veriloom.llm.kn_quality import quality_filter
from veriloom.llm.line_dedup import drop_repeated_lines
from veriloom.llm.lsh_forest import drop_near_duplicates
from veriloom.llm.rank_bpe import bpe

TOKENIZER = "word_bpe_49k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie in their language's perplexity band."""
    return quality_filter(docs, files=True)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that came before; those of which no word is left go."""
    return drop_repeated_lines(docs, most=1)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, linked where they share 80 in 100 shingles or more (the 85 of query op6 is its own)."""
    return drop_near_duplicates(docs, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and lang of each taken document with its token ids, their number and digests."""
    return bpe(docs, public_tokenizers.path(TOKENIZER), ids=True, keep=("doc_id", "source", "lang"))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix), ("tokens", tokens)]

#: SQL can't express the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
