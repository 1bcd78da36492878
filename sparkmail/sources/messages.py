"""Landed message documents (JSON lines), full or metadata-only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkmail.functions.identity import (
    clean_sender, header_value, normalize_message_id, pick_sender,
)
from sparkmail.schemas import MESSAGE_SCHEMA

# The headers a metadata-only fetch asks for.
METADATA_HEADERS = ["Message-ID", "From", "Return-Path"]


def _located(documents: DataFrame) -> DataFrame:
    """Add `landed`, the page file and block a document was read from."""
    return documents.select("*", F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
    ).alias("landed"))


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Documents with only the fields the statistics need, and their place."""
    return _located(spark.read.schema(MESSAGE_SCHEMA).json(path))


def stream_messages(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(MESSAGE_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _located(reader.json(path))


def metadata_only(documents: DataFrame) -> DataFrame:
    """Documents cut down to the three headers of a metadata fetch."""
    wanted = [h.lower() for h in METADATA_HEADERS]
    headers = F.filter("payload.headers", lambda h: F.lower(h["name"]).isin(wanted))
    return documents.select("id", F.struct(headers.alias("headers")).alias("payload"))


def message_fields(documents: DataFrame, seq: Column | None = None) -> DataFrame:
    """Ledger input of message documents. `seq` says which of several copies
    comes first; it defaults to the order of landing, or to the message id for
    documents that were not read from files."""
    if seq is None and "landed" in documents.columns:
        seq = F.struct("landed.file", "landed.block", F.monotonically_increasing_id().alias("row"))
    elif seq is None:
        seq = F.col("id")
    headers = F.col("payload.headers")
    sender = pick_sender(header_value(headers, "From"), header_value(headers, "Return-Path"))
    return documents.select(
        seq.alias("seq"),
        F.col("id").alias("mail_id"),
        normalize_message_id(header_value(headers, "Message-ID")).alias("rfc_message_id"),
        clean_sender(sender).alias("sender"),
    )
