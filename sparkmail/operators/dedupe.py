"""Exactly-once counting within and across sources.

Set-based form of "insert unless seen, count unless another row has the same
Message-ID". Every grouping is a partial aggregation, so a key that holds a
third of all rows shrinks to one row per map task before it is shuffled, and
every join is between sides that are unique on the join key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def first_per_key(df: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """The row with the smallest `seq` of each key."""
    rest = [c for c in df.columns if c != key]
    first = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(seq)).alias("r"))
    return first.select(key, "r.*")


def unseen(listing: DataFrame, seen: DataFrame) -> DataFrame:
    """Listed messages whose mail_id is not recorded yet: the fetch work list."""
    return listing.join(seen.select("mail_id").distinct(), "mail_id", "left_anti")


def known_ids(seen: DataFrame) -> DataFrame:
    """Distinct recorded Message-IDs; '' and NULL stand for none."""
    return seen.select("rfc_message_id").filter(F.col("rfc_message_id") != "").distinct()


def holders(rows: DataFrame) -> DataFrame:
    """rfc_message_id and the mail_id of the first row that has it; rows without an id are not in the result."""
    return first_per_key(
        rows.filter(F.col("rfc_message_id").isNotNull()).select("rfc_message_id", "seq", "mail_id"), "rfc_message_id")


def first_holders(rows: DataFrame, known: DataFrame) -> DataFrame:
    """mail_id of the row that may keep the count of its Message-ID.

    The first row per id, unless the id was recorded before. Rows without an
    id are not in the result.
    """
    return holders(rows).join(known, "rfc_message_id", "left_anti").select("mail_id")


def flag_counted(fresh: DataFrame, holds: DataFrame) -> DataFrame:
    """Rows to record with `counted`: they have no Message-ID, or hold theirs (a row in `holds`)."""
    return fresh.join(holds, "mail_id", "left").select(
        *fresh.columns,
        (F.col("rfc_message_id").isNull() | F.coalesce("holds", F.lit(False))).alias("counted"),
    )


def flag_repairs(applied: DataFrame, holds: DataFrame) -> DataFrame:
    """Repairs with `duplicate`: they have a Message-ID and do not hold it. '' stands for "has none"."""
    return applied.join(holds, "mail_id", "left").select(
        "mail_id",
        F.coalesce("rfc_message_id", F.lit("")).alias("rfc_message_id"),
        "sender",
        (F.col("rfc_message_id").isNotNull() & F.col("holds").isNull()).alias("duplicate"),
    )


def new_rows(batch: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows of `batch` to record, each flagged `counted`.

    A new row is always recorded; it counts for its sender unless another
    row, recorded or earlier in the batch, has its Message-ID.
    """
    # A listing may be replayed whole: drop copies first, then what is known.
    fresh = first_per_key(batch, "mail_id").join(seen.select("mail_id"), "mail_id", "left_anti")
    holds = first_holders(fresh, known_ids(seen)).withColumn("holds", F.lit(True))
    return flag_counted(fresh.select(*batch.columns), holds)


def dedupe_stored(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """Collapse repeated mail_ids of an old store to their first row."""
    return first_per_key(rows, "mail_id", seq)


def repair_rows(fetched: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows of `fetched` that repair a recorded row whose id was unknown.

    rfc_message_id becomes the id or '' for "has none"; `duplicate` marks rows
    whose message another recorded row has already, so that one count of the
    sender is taken back.
    """
    pending = seen.filter(F.col("rfc_message_id").isNull()).select("mail_id")
    applied = first_per_key(fetched, "mail_id").join(pending, "mail_id", "left_semi")
    holds = first_holders(applied, known_ids(seen)).withColumn("holds", F.lit(True))
    return flag_repairs(applied, holds)


def repair_outcome(fetched: DataFrame, repaired: DataFrame) -> DataFrame:
    """One row: examined, populated, missing_id, decremented, already_done."""
    has_id = F.col("rfc_message_id") != ""
    stacked = fetched.select(F.lit(1).alias("examined"), *[
        F.lit(0).alias(c) for c in ("populated", "missing_id", "decremented")
    ]).unionByName(repaired.select(
        F.lit(0).alias("examined"), has_id.cast("int").alias("populated"),
        (~has_id).cast("int").alias("missing_id"), F.col("duplicate").cast("int").alias("decremented"),
    ))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long"))
    return stacked.agg(
        total("examined").alias("examined"),
        total("populated").alias("populated"),
        total("missing_id").alias("missing_id"),
        total("decremented").alias("decremented"),
        (total("examined") - total("populated") - total("missing_id")).alias("already_done"),
    )


def apply_repairs(seen: DataFrame, repaired: DataFrame) -> DataFrame:
    """Recorded rows with the repaired ids filled in; known ids stay."""
    fixes = repaired.select("mail_id", F.col("rfc_message_id").alias("fixed"))
    return seen.join(fixes, "mail_id", "left").select(
        *[c for c in seen.columns if c != "rfc_message_id"],
        F.coalesce("rfc_message_id", "fixed").alias("rfc_message_id"),
    ).select(*seen.columns)
