"""mbox archives as splittable text scans, batch and streaming.

The scan frames messages with `lineSep="\\nFrom "`: big files split across
tasks and every record is one message. parse_records() drops the bodies, so
everything after it moves only a few header values per message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from sparkmail.functions.identity import (
    clean_sender, mid_key, normalize_message_id, pick_sender,
)
from sparkmail.functions.mbox_headers import parse_headers

# Fixed value: what begins a message.
SEPARATOR = "From "
RECORD_SEPARATOR = "\n" + SEPARATOR


def _located(records: DataFrame) -> DataFrame:
    return records.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("file_size"),
        F.unix_seconds(F.col("_metadata.file_modification_time")).alias("file_mtime"),
        F.col("_metadata.file_block_start").alias("block_start"),
        "value",
    )


def read_mbox(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per record: file facts, input block, raw text."""
    return _located(spark.read.option("lineSep", RECORD_SEPARATOR).text(path))


def stream_mbox(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The unbounded form of read_mbox over a folder that gains files.

    Files are tracked by path: land a new export under a new name.
    """
    reader = spark.readStream.option("lineSep", RECORD_SEPARATOR)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _located(reader.text(path))


def parse_records(records: DataFrame) -> DataFrame:
    """Headers and sizes of each record; the text itself ends here.

    `rid` keeps the order of the records inside their input block.
    """
    # A blank line is empty or one carriage return.
    has_text = F.when(F.ltrim(F.col("value"), F.lit("\r\n")) != "", True).otherwise(
        F.contains(F.col("value"), F.lit("\r\r"))
    )
    return records.select(
        "file", "file_size", "file_mtime", "block_start",
        F.monotonically_increasing_id().alias("rid"),
        F.octet_length("value").cast("long").alias("nbytes"),
        F.startswith(F.col("value"), F.lit(SEPARATOR)).alias("has_separator"),
        has_text.alias("has_text"),
        F.md5("value").alias("content_hash"),
        parse_headers(F.col("value")).alias("h"),
    ).select("*", "h.*").drop("h")


def with_offsets(parsed: DataFrame) -> DataFrame:
    """Absolute start_offset and end_offset of each message in its file, and
    `is_mbox`: whether the file begins with a separator.

    Two levels: a running sum inside each input block, and the bytes of the
    earlier blocks of the same file. No task sees more than one block of
    records, or one row per block of a file, so one huge file spreads out.
    """
    # Each record but the first of its file is preceded by one separator.
    span = F.col("nbytes") + len(RECORD_SEPARATOR)
    blocks = parsed.groupBy("file", "block_start").agg(
        F.sum(span).alias("block_bytes"), F.min_by("has_separator", "rid").alias("begins_well")
    )
    in_order = W.partitionBy("file").orderBy("block_start")
    bases = blocks.select(
        "file", "block_start",
        F.coalesce(
            F.sum("block_bytes").over(in_order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ).alias("base"),
        F.first("begins_well").over(in_order).alias("is_mbox"),
    )
    before = W.partitionBy("file", "block_start").orderBy("rid").rowsBetween(W.unboundedPreceding, -1)
    within = F.coalesce(F.sum(span).over(before), F.lit(0))
    text_start = F.col("base") + F.col("within")
    located = (
        parsed.withColumn("within", within)
        .join(bases, ["file", "block_start"])
        .withColumn(
            "start_offset",
            F.when(text_start == 0, F.lit(0).cast("long")).otherwise(text_start - len(SEPARATOR)),
        )
        # The line end before the next separator belongs to this message; the
        # last one of a file may have none.
        .withColumn("end_offset", text_start + F.col("nbytes")
                    + F.when(text_start + F.col("nbytes") < F.col("file_size"), 1).otherwise(0))
        # Bytes after the text: none, a separator, or a separator and nothing.
        .withColumn("ends_bare", F.col("file_size") - text_start - F.col("nbytes") == len(RECORD_SEPARATOR))
        .drop("within", "base")
    )
    return _with_bare_separator(located, parsed.columns).select(
        *parsed.columns, "is_mbox", "start_offset", "end_offset"
    )


def _with_bare_separator(located: DataFrame, columns: list[str]) -> DataFrame:
    """Add the empty message of a file cut off right after a separator, for
    which the scan has no record."""
    kinds = dict(located.dtypes)
    empty = {
        "file": F.col("file"), "file_size": F.col("file_size"), "file_mtime": F.col("file_mtime"),
        "block_start": F.col("block_start"), "rid": F.col("rid") + 1, "nbytes": F.lit(0),
        "has_separator": F.lit(False), "has_text": F.lit(False), "bad": F.lit(False), "is_mbox": F.col("is_mbox"),
        "start_offset": F.col("file_size") - len(SEPARATOR), "end_offset": F.col("file_size"),
    }
    names = [*columns, "is_mbox", "start_offset", "end_offset"]
    row = F.struct(*names)
    extra = F.struct(*[empty.get(n, F.lit(None)).cast(kinds[n]).alias(n) for n in names])
    return located.select(
        F.inline(F.when(F.col("ends_bare"), F.array(row, extra)).otherwise(F.array(row)))
    )


def with_status(located: DataFrame) -> DataFrame:
    """status: message, malformed, junk (text before the first separator) or blank."""
    before_first = (F.col("start_offset") == 0) & ~F.col("is_mbox")
    return located.withColumn(
        "status",
        F.when(before_first & F.col("has_text"), "junk")
        .when(before_first, "blank")
        .when(F.col("bad"), "malformed")
        .otherwise("message"),
    )


def split_valid_files(located: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of files that begin with a separator, the other files)."""
    return located.filter("is_mbox"), located.filter(~F.col("is_mbox")).select("file").distinct()


def fingerprints(located: DataFrame) -> DataFrame:
    """file → `size:mtime:hash` over every record and its place.

    Records do not depend on how the file was split, so neither does the hash:
    60 bits of each record's MD5, combined in any order.
    """
    record = F.md5(F.concat_ws(":", "start_offset", "content_hash"))
    bits = F.conv(F.substring(record, 1, 15), 16, 10).cast("long")
    return located.groupBy("file", "file_size", "file_mtime").agg(F.bit_xor(bits).alias("h")).select(
        "file", F.concat_ws(":", "file_size", "file_mtime", F.lower(F.hex("h"))).alias("fingerprint")
    )


def resume_offsets(fingerprints_: DataFrame, runs: DataFrame, run_id: int) -> DataFrame:
    """file → offset to continue run `run_id` at; 0 when the file changed."""
    run = runs.filter(F.col("run_id") == run_id).select("source", "mbox_fingerprint", "bytes_done").first()
    if run is None:
        raise ValueError(f"unknown run: {run_id}")
    if run["source"] != "mbox":
        raise ValueError(f"only mbox imports resume by offset; run {run_id} came from {run['source']}")
    recorded = F.lit(run["mbox_fingerprint"]).cast("string")
    offset = F.lit(run["bytes_done"]).cast("long")
    return fingerprints_.select(
        "file",
        F.when((F.col("fingerprint") == recorded) & (offset > 0), offset)
        .otherwise(F.lit(0).cast("long")).alias("resume_offset"),
    )


def resume_from(located: DataFrame, offsets: DataFrame) -> DataFrame:
    """Messages at or after the resume offset of their file."""
    return located.join(offsets, "file").filter(F.col("start_offset") >= F.col("resume_offset")).drop("resume_offset")


def import_batch(messages: DataFrame, seq: Column | None = None) -> DataFrame:
    """Ledger input of parsed messages; malformed and id-less ones stay out."""
    order = F.struct("file", "block_start", "rid") if seq is None else seq
    good = messages.filter(~F.col("bad") & F.col("message_id").isNotNull())
    return good.select(
        order.alias("seq"),
        mid_key(F.col("message_id")).alias("mail_id"),
        normalize_message_id(F.col("message_id")).alias("rfc_message_id"),
        clean_sender(pick_sender(F.col("from_"), F.col("return_path"))).alias("sender"),
    )


def _listing(spark: SparkSession, path: str) -> DataFrame:
    """path and length of the files under `path`; their content is not read."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def _bare(path: Column) -> Column:
    """A path without its scheme and host, which listings spell in several ways."""
    return F.regexp_replace(path, r"^[a-z0-9+.-]+:/+(?=/)|^file:(?=/)", "")


def archive_bytes(spark: SparkSession, path: str, without: DataFrame | None = None) -> int:
    """Total size of the files under `path`, but for the paths in `without`."""
    files = _listing(spark, path).withColumn("bare", _bare(F.col("path")))
    if without is not None:
        files = files.join(without.select(_bare(F.col("path")).alias("bare")).distinct(), "bare", "left_anti")
    return files.agg(F.sum("length")).first()[0] or 0


def import_counts(messages: DataFrame) -> DataFrame:
    """One row: messages parsed, and regions skipped (junk, malformed or
    without id), of rows with a status."""
    status = F.col("status")
    return messages.agg(
        F.count_if(status == "message").alias("messages_seen"),
        F.count_if(status.isin("junk", "malformed") | ((status == "message") & F.col("message_id").isNull()))
        .alias("skipped"),
    )
