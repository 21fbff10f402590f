"""Sorting, positions and prefix sums that stay distributed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

from lodeplane.plans.storage import cut


def positions(df: DataFrame, *keys: str | Column, name: str = "pos") -> DataFrame:
    """Adds each row's place, from 0, in the order of the keys (the last of which should make it total).

    A range-partitioned sort numbers the rows of each partition; only the partitions' counts meet in one task.
    """
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    mark = F.monotonically_increasing_id()
    sorted_ = cut(df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_mark", mark))
    part, row = F.shiftright("_mark", 33), F.col("_mark").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted_.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # one row per partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offset = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return sorted_.withColumn("_part", part).join(F.broadcast(offset), "_part").withColumn(name, F.col("_off") + row).drop("_mark", "_part", "_off")


def argsort(df: DataFrame, key: str = "key", id_col: str = "id") -> DataFrame:
    """(pos, id): ids by ascending key, equal keys by id. Null keys come first, NaN last. Other columns are carried along."""
    return positions(df, key, id_col)


#: Types whose quantiles Spark approximates.
_ORDERED = (NumericType, DateType, TimestampType, TimestampNTZType)


def prefix_sums(df: DataFrame, order: str, value: str, name: str = "offset") -> DataFrame:
    """Adds the sum of `value` over all earlier rows in the order of `order`, nulls first.

    Rows are dealt into ranges of the order by its approximate quantiles: one pass for these, one for the ranges' sums, and
    one shuffle, in which each range is summed by itself. Sums of earlier ranges come by broadcast, one row per range.
    """
    ranges = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if isinstance(df.schema[order].dataType, _ORDERED):
        cuts = df.agg(F.percentile_approx(order, [k / ranges for k in range(1, ranges)], 10 * ranges).alias("q")).first().q or []
        cuts = sorted(set(cuts))
        bounds = F.array(*(F.lit(c) for c in cuts)).cast(f"array<{df.schema[order].dataType.simpleString()}>")
        part = F.when(F.col(order).isNull(), -1).otherwise(F.size(F.filter(bounds, lambda c: c < F.col(order)))) if cuts else F.lit(0)
        dealt = df.withColumn("_part", part)
    else:
        # other types are sorted into ranges first
        dealt = cut(df.repartitionByRange(order).withColumn("_part", F.shiftright(F.monotonically_increasing_id(), 33)))
    sums = dealt.groupBy("_part").agg(F.sum(value).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offset = sums.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(F.broadcast(offset), "_part").withColumn(name, F.col("_off") + F.col("_in")).drop("_part", "_off", "_in")
