"""Ordered operations that stay distributed when one key holds most rows.

A plain window puts a whole key into one task. Here the order column is cut
into tiles: windows run inside one tile of one key, and what crosses a tile
edge travels as one row per tile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from sparkmail.session import cut_lineage

# Tiles per second-level group: a group's window sees at most this many rows.
TILES_PER_GROUP = 4096


def _before(*partition: str, by: str, end: int = -1):
    return W.partitionBy(*partition).orderBy(by).rowsBetween(W.unboundedPreceding, end)


def tile_of(order: str, tile: int) -> Column:
    return F.floor(F.col(order) / tile)


def tile_carry(df: DataFrame, keys: list[str], order: str, value: Column, tile: int) -> DataFrame:
    """(keys, tile, carry): the last non-null `value` before each tile in use.

    `order` is a LONG, `tile` its span per tile. A first pass leaves one row
    per tile, a second one row per group of tiles, so that no window holds
    all tiles of a key.
    """
    last = lambda c: F.last(c, ignorenulls=True)
    rows = df.select(*keys, order, value.alias("value"), tile_of(order, tile).alias("tile"))
    at = F.when(F.col("value").isNotNull(), F.col(order))
    if isinstance(rows.schema["value"].dataType, T.StructType):
        # Field by field, numbers stay in a hash aggregation; a struct would
        # be sorted.
        names = rows.schema["value"].dataType.names
        found = [F.max(at).alias("__at"), *[F.max_by(F.col("value")[n], at).alias(f"__{n}") for n in names]]
        tail = F.when(F.col("__at").isNotNull(), F.struct(*[F.col(f"__{n}").alias(n) for n in names]))
    else:
        found, tail = [F.max_by("value", at).alias("tail")], F.col("tail")
    tails = rows.groupBy(*keys, "tile").agg(*found).select(
        *keys, "tile", F.floor(F.col("tile") / TILES_PER_GROUP).alias("group"), tail.alias("tail")
    )
    groups = tails.groupBy(*keys, "group").agg(
        F.max_by("tail", F.when(F.col("tail").isNotNull(), F.col("tile"))).alias("group_tail")
    ).select(*keys, "group", last("group_tail").over(_before(*keys, by="group")).alias("group_carry"))
    return (
        tails.withColumn("carry", last("tail").over(_before(*keys, "group", by="tile")))
        .join(groups, [*keys, "group"])
        .select(*keys, "tile", F.coalesce("carry", "group_carry").alias("carry"))
    )


def carry_last(
    df: DataFrame, keys: list[str], order: str, value: Column, name: str, tile: int,
    inclusive: bool = False,
) -> DataFrame:
    """Add the last non-null `value` before each row of its key, by `order`.

    `order` is a LONG that is unique within a key, `tile` its span per tile.
    With `inclusive` the row's own value counts too.
    """
    local = F.last(value, ignorenulls=True).over(
        _before(*keys, "tile", by=order, end=0 if inclusive else -1)
    )
    return (
        df.withColumn("tile", tile_of(order, tile)).withColumn("__local", local)
        .join(tile_carry(df, keys, order, value, tile), [*keys, "tile"])
        .withColumn(name, F.coalesce("__local", "carry"))
        .drop("tile", "__local", "carry")
    )


def carry_by_volume(df: DataFrame, keys: list[str], order: str, value: Column, name: str) -> DataFrame:
    """carry_last() over tiles of equal volume, however dense the order column.

    Tiles are range partitions of (keys, order), cut at quantiles that Spark
    samples, so a key with all its rows in one instant's neighbourhood spreads
    over all tasks. Kept by a checkpoint, as the tile numbers must not change;
    one row per key and tile carries state on. NULL keys are a key.
    """
    placed = cut_lineage(
        df.withColumn("__value", value).repartitionByRange(*keys, order).withColumn("__tile", F.spark_partition_id())
    )
    at = F.when(F.col("__value").isNotNull(), F.col(order))
    tails = placed.groupBy(*keys, "__tile").agg(F.max_by("__value", at).alias("__tail"))
    carries = tails.select(
        *[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)], F.col("__tile").alias("__of"),
        F.last("__tail", ignorenulls=True).over(_before(*keys, by="__tile")).alias("__carry"),
    )
    same = F.col("__tile") == F.col("__of")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__key{i}"))
    local = F.last("__value", ignorenulls=True).over(_before("__tile", *keys, by=order))
    return placed.withColumn("__local", local).join(carries, same).select(
        *df.columns, F.coalesce("__local", "__carry").alias(name)
    )


def with_position(df: DataFrame, *order: Column, total: str | None = None) -> DataFrame:
    """Add `position`, the 0-based place of each row in the global order, and
    the number of all rows as column `total`, if named.

    One range-partitioned sort, kept by a checkpoint so that the places are
    computed from the same partitions the counts came from. `order` must be
    total, or equal rows take either place.
    """
    rid = F.monotonically_increasing_id()
    ordered = cut_lineage(df.orderBy(*order).select(
        "*",
        F.spark_partition_id().alias("__part"),
        # The low 33 bits number the rows inside a partition.
        rid.bitwiseAND(F.lit((1 << 33) - 1)).alias("__place"),
    ))
    # One row per partition of the sort.
    counts = ordered.groupBy("__part").agg(F.count("*").alias("n"))
    earlier = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy("__part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    offsets = counts.select(
        "__part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__offset"),
        *([F.sum("n").over(everything).alias(total)] if total else []),
    )
    return (
        ordered.join(F.broadcast(offsets), "__part")
        .withColumn("position", F.col("__offset") + F.col("__place"))
        .drop("__part", "__place", "__offset")
    )


# Parts of a key that are trimmed on their own before the key is ranked.
RANK_PARTS = 64


def newest_per_key(df: DataFrame, key: str, order: str, limit: int) -> DataFrame:
    """The `limit` last rows of each key; `order` is unique within a key.

    Only (key, order) is ranked, first within parts of a key and then among
    what the parts keep, so a hot key sends few and small rows to one task.
    The other columns are fetched for the rows that stay.
    """
    def newest(rows: DataFrame, *part: str) -> DataFrame:
        window = W.partitionBy(key, *part).orderBy(F.col(order).desc())
        return rows.withColumn("__rank", F.row_number().over(window)).filter(F.col("__rank") <= limit).drop("__rank")

    parts = df.select(key, order, F.pmod(F.xxhash64(order), F.lit(RANK_PARTS)).alias("__part"))
    return df.join(newest(newest(parts, "__part").drop("__part")), [key, order], "left_semi")
