"""Reads over the statistics: ranked senders, tiles, pages, quality, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkmail.functions.identity import embedded_message_id, is_mid_key
from sparkmail.functions.text import trim
from sparkmail.operators.ordered import with_position
from sparkmail.operators.rates import active_progress
from sparkmail.schemas import PUBLIC_RUN_COLUMNS, TERMINAL_STATES

# Page sizes, repair batch size, domains a demo set may use.
PAGE_SIZES, DEFAULT_PAGE_SIZE = (25, 50, 100, 500), 50
REPAIR_BATCH = 500
# Ranks per folder of a stored order: a multiple of all page sizes, so that a
# page lies in one folder.
SLAB = 100_000
RESERVED_SUFFIXES = (".example", "example.com", "example.net", "example.org")


def by_rank() -> list[Column]:
    """Most mails first; equal counts by address."""
    return [F.desc("mails_sent"), F.asc("sender")]


def total_messages(seen: DataFrame) -> DataFrame:
    return seen.agg(F.countDistinct("mail_id").alias("total_messages"))


def stored_count(count: Column) -> Column:
    """A stored counter as a number: the integer it begins with, else 0; one
    that is too long becomes the largest or smallest."""
    digits = F.regexp_extract(count.cast("string"), r"^[\t\n\x0b\f\r ]*([+-]?[0-9]+)", 1)
    limit = F.when(F.startswith(digits, F.lit("-")), F.lit(-(2**63)).cast("long")).otherwise(F.lit(2**63 - 1).cast("long"))
    return F.when(digits == "", F.lit(0).cast("long")).otherwise(F.coalesce(digits.try_cast("long"), limit))


def summary_senders(senders: DataFrame) -> DataFrame:
    """One row per sender; NULL senders merge with ''."""
    return senders.groupBy(
        F.coalesce(F.col("sender").cast("string"), F.lit("")).alias("sender")
    ).agg(
        F.sum(stored_count(F.col("mails_sent"))).alias("mails_sent")
    )


def visible(ranked: DataFrame, hidden: DataFrame) -> DataFrame:
    return ranked.join(hidden.select("sender"), "sender", "left_anti")


def listed(ranked: DataFrame, hidden: DataFrame, show_hidden: bool = False) -> DataFrame:
    """What the list shows: hidden senders only with the toggle on."""
    return ranked if show_hidden else visible(ranked, hidden)


def tiles(seen: DataFrame, ranked: DataFrame, hidden: DataFrame) -> DataFrame:
    """One row: messages without hidden senders, visible senders, top sender."""
    flags = hidden.select("sender").distinct().withColumn("hides", F.lit(True))
    shown = F.col("hides").isNull()
    return ranked.join(flags, "sender", "left").agg(
        F.coalesce(F.sum(F.when(~shown, F.col("mails_sent"))), F.lit(0).cast("long")).alias("hidden_messages"),
        F.count_if(shown).alias("distinct_senders"),
        F.min_by("sender", F.when(shown, F.struct(-F.col("mails_sent"), "sender"))).alias("top_sender"),
    ).select(
        F.greatest(total_messages(seen).scalar() - F.col("hidden_messages"), F.lit(0).cast("long"))
        .alias("total_messages"),
        "distinct_senders", "top_sender",
    )


def search(ranked: DataFrame, query: str) -> DataFrame:
    """Senders that contain the query, without case; no query lists all."""
    wanted = F.lower(trim(F.lit(query)))
    return ranked.filter((wanted == "") | F.contains(F.lower("sender"), wanted))


def hidden_count(ranked: DataFrame, hidden: DataFrame) -> Column:
    """How many ranked senders the list leaves out, for page()."""
    return ranked.join(hidden.select("sender").distinct(), "sender", "left_semi").agg(F.count("*").alias("n")).scalar()


def page(
    ranked: DataFrame, page: int = 1, size: int = DEFAULT_PAGE_SIZE, hidden: Column | int = 0,
) -> DataFrame:
    """Rows of one page with its number, page count, listed and hidden senders.

    The page number is moved into range; other sizes fall back to 50. Places
    and the number of listed senders come from one sort.
    """
    size = size if size in PAGE_SIZES else DEFAULT_PAGE_SIZE
    wanted = F.lit(max(1, page)).cast("long")
    placed = with_position(ranked, *by_rank(), total="listed").withColumn("pages", F.ceil(F.col("listed") / size))
    return placed.withColumn("page", F.least(wanted, "pages")).filter(
        F.floor(F.col("position") / size) + 1 == F.col("page")
    ).select(
        "page", "pages", "listed", (F.lit(hidden) if isinstance(hidden, int) else hidden).cast("long").alias("hidden"),
        (F.col("position") + 1).cast("long").alias("rank"), "sender", "mails_sent",
    )


def store_order(ranked: DataFrame, path: str, slab: int = SLAB) -> None:
    """Write senders by rank under `path`: rows in a folder per `slab` ranks,
    and one row with their number. Sorted once for any number of pages."""
    placed = with_position(ranked, *by_rank()).withColumn("slab", F.floor(F.col("position") / slab))
    # Rows of a slab are neighbours in the sort; each task writes few folders.
    placed.select("slab", (F.col("position") + 1).alias("rank"), "sender", "mails_sent") \
        .write.mode("overwrite").partitionBy("slab").parquet(f"{path}/rows")
    ranked.sparkSession.read.schema(_ORDER).parquet(f"{path}/rows").agg(F.count("*").alias("listed")).select(
        "listed", F.lit(slab).cast("long").alias("slab_size")
    ).write.mode("overwrite").parquet(f"{path}/total")


_ORDER = "slab long, rank long, sender string, mails_sent long"


def stored_page(
    spark: SparkSession, path: str, page: int = 1, size: int = DEFAULT_PAGE_SIZE, hidden: Column | int = 0,
) -> DataFrame:
    """page() of what store_order() wrote. It reads one row and one folder and
    sorts nothing; a page number outside the range is moved into it."""
    size = size if size in PAGE_SIZES else DEFAULT_PAGE_SIZE
    listed, slab = spark.read.schema("listed long, slab_size long").parquet(f"{path}/total").first()
    if slab % size:
        raise ValueError(f"pages of {size} cross folders of {slab} ranks")
    pages = -(-listed // size)
    number = min(max(1, page), pages)
    first = max(0, number - 1) * size
    rows = spark.read.schema(_ORDER).parquet(f"{path}/rows")
    return rows.filter((F.col("slab") == first // slab) & F.col("rank").between(first + 1, first + size)).select(
        F.lit(number).cast("long").alias("page"), F.lit(pages).cast("long").alias("pages"),
        F.lit(listed).cast("long").alias("listed"),
        (F.lit(hidden) if isinstance(hidden, int) else hidden).cast("long").alias("hidden"), "rank", "sender", "mails_sent",
    )


def document_rows(seen: DataFrame, ranked: DataFrame, generated_at_unix: int) -> DataFrame:
    """The summary document as JSON lines: one head, then one line per sender.

    The list has no bound, so it stays a table; sort by (part, mails_sent
    descending, sender) to read it in rank order.
    """
    head = total_messages(seen).select(
        F.lit(0).alias("part"), F.lit(None).cast("string").alias("sender"),
        F.lit(None).cast("long").alias("mails_sent"),
        F.to_json(F.struct("total_messages", F.lit(generated_at_unix).cast("long").alias("generated_at_unix")))
        .alias("line"),
    )
    rows = ranked.select(
        F.lit(1).alias("part"), "sender", "mails_sent",
        F.to_json(F.struct("sender", "mails_sent")).alias("line"),
    )
    return head.unionByName(rows)


def write_document(rows: DataFrame, path: str) -> None:
    """Write document_rows() as text, in order from file to file."""
    rows.orderBy("part", *by_rank()).select("line").write.mode("overwrite").text(path)


def quality(ranked: DataFrame, expected_total: Column, minimum_total: int, expected_senders: Column) -> DataFrame:
    """One row of checks on a sender list (sender, mails_sent)."""
    domain = F.regexp_extract("sender", r"(?s)^[^@]*@(.*)\z", 1)
    reserved = F.lit(False)
    for suffix in RESERVED_SUFFIXES:
        reserved = reserved | F.endswith(domain, F.lit(suffix))
    per_sender = ranked.groupBy(F.coalesce("sender", F.lit("")).alias("sender")).agg(
        F.count("*").alias("copies"), F.sum("mails_sent").alias("mails_sent")
    )
    facts = per_sender.agg(
        F.coalesce(F.sum("mails_sent"), F.lit(0).cast("long")).alias("total"),
        F.coalesce(F.sum("copies"), F.lit(0).cast("long")).alias("sender_rows"),
        F.count_if(F.col("copies") > 1).alias("duplicated_senders"),
        F.count_if(~reserved).alias("outside_reserved_domains"),
    )
    return facts.select(
        "*",
        (F.col("total") == expected_total).alias("total_conserved"),
        (F.col("total") >= minimum_total).alias("total_large_enough"),
        (F.col("sender_rows") == expected_senders).alias("sender_count_ok"),
    )


def category_budget(categories: DataFrame, heroes: DataFrame) -> DataFrame:
    """Senders and messages of each category that pinned senders leave over."""
    pinned = heroes.groupBy("category").agg(
        F.count("*").alias("hero_count"), F.sum("mails_sent").alias("hero_messages")
    ).withColumnRenamed("category", "key")
    zero = F.lit(0).cast("long")
    return categories.join(pinned, "key", "left").select(
        "key",
        (F.col("sender_count") - F.coalesce("hero_count", zero)).alias("tail_count"),
        (F.col("total_messages") - F.coalesce("hero_messages", zero)).alias("tail_budget"),
    )


def unrepaired(seen: DataFrame) -> DataFrame:
    """Scanned rows whose Message-ID is not known yet."""
    return seen.filter(F.col("rfc_message_id").isNull() & ~is_mid_key(F.col("mail_id")))


def mixed_sources(seen: DataFrame) -> DataFrame:
    """One row: whether counts may hold cross-source doubles, and how many
    scanned rows a repair would look at."""
    mid = is_mid_key(F.col("mail_id"))
    facts = seen.agg(
        F.coalesce(F.bool_or(mid), F.lit(False)).alias("has_mid"),
        F.coalesce(F.bool_or(~mid), F.lit(False)).alias("has_bare"),
        F.count_if(~mid & F.col("rfc_message_id").isNull()).alias("n"),
    )
    mixed = F.col("has_mid") & F.col("has_bare") & (F.col("n") > 0)
    return facts.select(
        mixed.alias("mixed_unrepaired"),
        F.when(mixed, F.col("n")).otherwise(F.lit(0).cast("long")).alias("unrepaired_count"),
    )


def repair_batches(seen: DataFrame, size: int = REPAIR_BATCH) -> DataFrame:
    """The repair work list in mail_id order, numbered in batches of `size`."""
    pending = unrepaired(seen).filter(F.col("mail_id") > "").select("mail_id")
    return with_position(pending, F.col("mail_id")).select(
        "mail_id", F.floor(F.col("position") / size).alias("batch_no")
    )


def populate_embedded(seen: DataFrame) -> DataFrame:
    """Fill the id of import rows that were stored without it."""
    return seen.withColumn(
        "rfc_message_id", embedded_message_id(F.col("mail_id"), F.col("rfc_message_id"))
    )


def status(
    db: str | Column, now_unix: int, seen: DataFrame, active: DataFrame, last: DataFrame, samples: DataFrame,
) -> DataFrame:
    """One row: readiness, mixed-source state, the two runs of note as JSON,
    and how fast the active one moves and how long it will take."""
    def document(runs: DataFrame) -> Column:
        return runs.select(F.to_json(F.struct(*[c for c in PUBLIC_RUN_COLUMNS if c in runs.columns]))).scalar()

    moving = active_progress(active, samples)
    return mixed_sources(seen).select(
        (F.lit(db) if isinstance(db, str) else db).alias("db"), F.lit(now_unix).cast("long").alias("now_unix"), "*",
        document(active).alias("active_run"), document(last).alias("last_run"),
        moving.select("rate_per_sec").scalar().alias("rate_per_sec"),
        moving.select("eta_seconds").scalar().alias("eta_seconds"),
    )


def readiness(seen: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """One row: empty or ready, and whether to show the setup view, which
    waits while a run is active. A store that does not exist has no tables;
    see StatsStore.readiness()."""
    terminal = F.lit(True) if runs is None else F.coalesce(
        runs.agg(F.bool_and(F.col("state").isin(TERMINAL_STATES))).scalar(), F.lit(True)
    )
    return seen.agg(F.count("mail_id").alias("n")).select(
        F.when(F.col("n") > 0, "ready").otherwise("empty").alias("db"),
        ((F.col("n") == 0) & terminal).alias("onboard"),
    )
