"""Summary documents and the dataset spec that lists pinned senders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SUMMARY_SCHEMA = (
    "total_messages bigint, generated_at_unix bigint, "
    "senders array<struct<sender: string, mails_sent: bigint>>"
)
SPEC_SCHEMA = (
    "total_messages_min bigint, distinct_senders bigint, "
    "top_senders array<struct<sender: string, mails_sent: bigint, category: string>>, "
    "categories array<struct<key: string, sender_count: bigint, total_messages: bigint>>"
)


def read_summary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(document head, sender rows) of summary documents, one per file."""
    docs = spark.read.schema(SUMMARY_SCHEMA).option("multiLine", True).json(path)
    head = docs.select("total_messages", "generated_at_unix")
    return head, docs.select(F.inline("senders"))


def read_spec(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(limits, categories, pinned senders) of a dataset spec."""
    docs = spark.read.schema(SPEC_SCHEMA).option("multiLine", True).json(path)
    return (
        docs.select("total_messages_min", "distinct_senders"),
        docs.select(F.inline("categories")),
        docs.select(F.inline("top_senders")),
    )
