"""Rate and ETA of runs from their progress samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sparkmail.operators.ordered import tile_carry, tile_of

# The rate window, and the span below which no rate is given.
WINDOW_US = 30_000_000
MIN_SPAN_S = 0.5


def _rates(samples: DataFrame, key: str) -> DataFrame:
    """Add the two rates to samples (key, t_us, run_id, messages_seen,
    bytes_done, ...) with one sample per instant of a key.

    Each 30-second tile is windowed with the tile before it, so a key with
    most of the samples still spreads over many tasks. Only the first sample
    after a gap looks further back; that one travels with the tile. A sample
    of another run ends the window.

    The start of a sample's window is a row of its own, a probe: going back in
    time, the sample passed last before the probe is the oldest of the window.
    So every window only grows by one row at a time, however dense the samples.
    """
    sample = F.struct("t_us", "messages_seen", "bytes_done", "run_id")
    carry = tile_carry(samples, [key], "t_us", sample, WINDOW_US).withColumnRenamed("tile", "frame")

    own = tile_of("t_us", WINDOW_US)
    tiled = samples.withColumn("own", own).withColumn(
        "frame", F.explode(F.array(F.col("own"), F.col("own") + 1))
    )
    in_order = W.partitionBy(key, "frame").orderBy("t_us")
    same_run = lambda c: F.col("run_id").eqNullSafe(F.col(f"{c}.run_id")) & F.col(c).isNotNull()
    rows = tiled.withColumn("before", F.lag(sample).over(in_order))
    # The first sample since the run changed; a run's own samples never do.
    begun = F.last(F.when(~same_run("before"), sample), ignorenulls=True).over(
        in_order.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("begun", begun if key != "run_id" else F.lit(None).cast(samples.select(sample).schema[0].dataType))
    mine = F.col("frame") == F.col("own")
    back = F.struct(F.lit(True).alias("probe"), (F.col("t_us") - WINDOW_US).alias("at"))
    here = F.struct(F.lit(False).alias("probe"), F.col("t_us").alias("at"))
    both = rows.withColumn("row", F.explode(F.array_compact(F.array(here, F.when(mine, back))))) \
        .select(*rows.columns, "row.probe", "row.at")
    backwards = W.partitionBy(key, "frame").orderBy(F.desc("at"), "probe").rowsBetween(W.unboundedPreceding, 0)
    inside = F.last(F.when(~F.col("probe"), sample), ignorenulls=True).over(backwards)
    framed = (
        both.withColumn("inside", inside)
        .filter("probe")
        .withColumn("first", F.when(F.col("begun.t_us") > F.col("inside.t_us"), F.col("begun")).otherwise(F.col("inside")))
        .join(carry, [key, "frame"])
        .withColumn("previous", F.coalesce("before", "carry"))
        .withColumn("oldest", F.when(
            same_run("previous"),
            # The window holds another sample when it holds the one before.
            F.when(F.col("t_us") - F.col("previous.t_us") <= WINDOW_US, F.col("first")).otherwise(F.col("previous")),
        ))
    )
    span = (F.col("t_us") - F.col("oldest.t_us")) / 1_000_000

    def per_second(counter: str) -> Column:
        moved = F.col(counter) - F.col(f"oldest.{counter}")
        return F.when((span >= MIN_SPAN_S) & moved.isNotNull(), F.greatest(moved, F.lit(0)) / span)

    return framed.select(
        *samples.columns,
        per_second("messages_seen").alias("messages_per_sec"),
        per_second("bytes_done").alias("bytes_per_sec"),
    )


def sliding_rate(samples: DataFrame) -> DataFrame:
    """Messages and bytes per second at each sample of a run (run_id, t_us,
    messages_seen, bytes_done, ...), measured from the oldest sample of the
    last 30 seconds, or from the one before when that window holds no other.
    """
    others = [c for c in samples.columns if c not in ("run_id", "t_us")]
    # Counters only grow, so the largest of one instant is the latest.
    return _rates(samples.groupBy("run_id", "t_us").agg(*[F.max(c).alias(c) for c in others]), "run_id")


def observed_rate(observations: DataFrame) -> DataFrame:
    """Rates as each viewer sees them (viewer, t_us, run_id, messages_seen,
    bytes_done): the window starts over whenever the active run changes or
    there is none (run_id NULL)."""
    return _rates(observations, "viewer").filter(F.col("run_id").isNotNull())


def displayed_rate(per_sec: Column) -> Column:
    return F.round(per_sec, 1)


def eta_seconds(run) -> Column:
    """Seconds left: by bytes while bytes move, else by the estimate."""
    def left(total, done, rate):
        return F.ceil(F.greatest(total - done, F.lit(0)) / rate)

    return F.when(
        (run["bytes_per_sec"] > 0) & run["bytes_total"].isNotNull() & run["bytes_done"].isNotNull(),
        left(run["bytes_total"], run["bytes_done"], run["bytes_per_sec"]),
    ).when(
        (run["messages_per_sec"] > 0) & run["total_estimate"].isNotNull(),
        left(run["total_estimate"], run["messages_seen"], run["messages_per_sec"]),
    )


def active_progress(active: DataFrame, samples: DataFrame) -> DataFrame:
    """rate_per_sec and eta_seconds of the active run (one row, or none) from
    its samples (run_id, t_us, messages_seen, bytes_done)."""
    own = samples.join(active.select("run_id"), "run_id", "left_semi")
    latest = sliding_rate(own).groupBy("run_id").agg(
        F.max_by(F.struct("messages_per_sec", "bytes_per_sec"), "t_us").alias("latest"))
    run = active.join(latest, "run_id", "left").select("*", "latest.*")
    return run.select(
        "run_id", displayed_rate(F.col("messages_per_sec")).alias("rate_per_sec"), eta_seconds(run).alias("eta_seconds"))
