"""A corpus pipeline of five stages over the operators of sparkmail.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it to the shared folder as Parquet and gives
what it reads back to the next one. All stages but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkmail.llm import bpe, mixing, quality, secret_scan, simhash
from sparkmail.llm.common import stage, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least 0.7."""
    stats = stage(quality.statistics(docs), "pipeline-statistics")
    model = quality.fit(stats, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates: 3-word shingles, 3 differing bits at most."""
    return simhash.keep_first(docs, width=3, radius=3)


def secret_mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked."""
    return secret_scan.mask(docs, secret_scan.fit_by_rule(docs))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.take(docs)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each taken copy, with hashes of the ids and of the text decoded from them."""
    return bpe.encode(docs, with_ids=True)


STAGES = [
    ("quality classifier", quality_filter),
    ("SimHash near-dedup", simhash_dedup),
    ("secret scans", secret_mask),
    ("mixing sources to target weights", source_mix),
    ("BPE encoding and decoding", bpe_encode),
]

#: The classifier, the forest, the rounding and the vocabulary have no SQL form; tests compare the stages with plain models.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
