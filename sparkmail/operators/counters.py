"""Per-sender counters: increments, clamped decrements, run totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def sender_counts(counted: DataFrame) -> DataFrame:
    return counted.groupBy("sender").agg(F.count("*").alias("n"))


def increments(new_rows: DataFrame) -> DataFrame:
    return sender_counts(new_rows.filter("counted"))


def decrements(repaired: DataFrame) -> DataFrame:
    return sender_counts(repaired.filter("duplicate"))


def newest(rows: DataFrame) -> DataFrame:
    """sender, mails_sent: the row of each sender's newest epoch."""
    return rows.groupBy("sender").agg(F.max_by("mails_sent", "epoch").alias("mails_sent"))


def _side_by_side(senders: DataFrame, deltas: DataFrame) -> DataFrame:
    """sender, mails_sent, n: both sides are unique per sender, so one hash
    aggregation over their union lines them up."""
    none = F.lit(None).cast("long")
    both = senders.select("sender", "mails_sent", none.alias("n")).unionByName(
        deltas.select("sender", none.alias("mails_sent"), "n")
    )
    return both.groupBy("sender").agg(
        F.sum("mails_sent").alias("mails_sent"), F.sum("n").alias("n"),
        F.count_if(F.col("n").isNull()).alias("stored"),
    )


def add_counts(senders: DataFrame, deltas: DataFrame) -> DataFrame:
    """Counters after increments; a missing or negative one counts from 0."""
    start = F.greatest(F.coalesce("mails_sent", F.lit(0).cast("long")), F.lit(0).cast("long"))
    return _side_by_side(senders, deltas).select(
        "sender",
        F.when(F.col("n").isNotNull(), start + F.col("n")).otherwise(F.col("mails_sent")).alias("mails_sent"),
    )


def take_back(senders: DataFrame, deltas: DataFrame) -> DataFrame:
    """Counters after decrements, never below 0; others stay as they are."""
    lowered = F.greatest(F.col("mails_sent") - F.col("n"), F.lit(0).cast("long"))
    return _side_by_side(senders, deltas).filter(F.col("stored") > 0).select(
        "sender",
        F.when((F.col("mails_sent") > 0) & F.col("n").isNotNull(), lowered)
        .otherwise(F.col("mails_sent")).alias("mails_sent"),
    )


def run_counters(ledger: DataFrame, input_rows: DataFrame) -> DataFrame:
    """run_id, messages_seen (handed in) and messages_new (counted)."""
    seen = input_rows.select("run_id", F.lit(1).alias("seen"), F.lit(0).alias("new"))
    new = ledger.select("run_id", F.lit(0).alias("seen"), F.col("counted").cast("int").alias("new"))
    return seen.unionByName(new).groupBy("run_id").agg(
        F.sum("seen").alias("messages_seen"), F.sum("new").alias("messages_new")
    )
