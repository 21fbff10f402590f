"""Bounding boxes and the grid pyramid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeplane.functions import relative, side


def bounds(points: DataFrame) -> DataFrame:
    """One row: xmin, xmax, ymin, ymax. Rows with a null or NaN coordinate are not counted."""
    x, y = F.nanvl("x", F.lit(None)), F.nanvl("y", F.lit(None))
    return points.agg(F.min(x).alias("xmin"), F.max(x).alias("xmax"), F.min(y).alias("ymin"), F.max(y).alias("ymax"))


def relative_positions(points: DataFrame, box: DataFrame | None = None) -> DataFrame:
    """points with rx and ry in the square around the box (one row, so it is broadcast), and that square's side."""
    box = bounds(points) if box is None else box
    return points.crossJoin(F.broadcast(box)).withColumn("side", side()).withColumn("rx", relative("x", "xmin", "xmax", F.col("side"))).withColumn("ry", relative("y", "ymin", "ymax", F.col("side"))).drop("xmin", "xmax", "ymin", "ymax")


def cell(v: Column, level: Column | int) -> Column:
    """Column or row of a relative coordinate at a level of 2^(level + 1) cells a side."""
    level = F.lit(level) if isinstance(level, int) else level
    return F.floor(v * F.pow(F.lit(2.0), level + 1)).cast("int")


def level_side(level: int) -> int:
    return 1 << (level + 1)


def level_row(level: int) -> int:
    """First row of a level where all levels are stacked in one array."""
    return (1 << (level + 1)) - 2


def stack_width(depth: int) -> int:
    return 1 << depth


def stack_height(depth: int) -> int:
    return (1 << (depth + 1)) - 2


def pyramid(points: DataFrame, depth: int, box: DataFrame | None = None) -> DataFrame:
    """cells(level, cx, cy, sx, sy, mass, cnt): sums of x*mass, y*mass and mass, and points, of each occupied cell.

    The points are aggregated once, at the finest level; each coarser cell is summed from finest cells, of which there are
    at most as many as points and at most 4^depth.
    """
    at = relative_positions(points, box)
    fine = at.groupBy(cell(F.col("rx"), depth - 1).alias("fx"), cell(F.col("ry"), depth - 1).alias("fy")).agg(
        F.sum(F.col("x") * F.col("mass")).alias("sx"), F.sum(F.col("y") * F.col("mass")).alias("sy"), F.sum("mass").alias("mass"), F.count(F.lit(1)).alias("cnt")
    )
    up = fine.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))))
    shift = F.pow(F.lit(2.0), F.lit(depth - 1) - F.col("level"))
    coarse = lambda c: F.floor(F.col(c) / shift).cast("int")
    return up.groupBy("level", coarse("fx").alias("cx"), coarse("fy").alias("cy")).agg(*(F.sum(c).alias(c) for c in ("sx", "sy", "mass", "cnt")))


def dense_level(cells: DataFrame, level: int) -> DataFrame:
    """All cells of a level, row by row; empty ones with zeros."""
    g = level_side(level)
    grid = cells.sparkSession.range(g * g).select((F.col("id") % g).cast("int").alias("cx"), F.floor(F.col("id") / g).cast("int").alias("cy"))
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("sx", "sy", "mass")]
    return grid.join(cells.where(F.col("level") == level).drop("level"), ["cx", "cy"], "left").select("cx", "cy", *zero, F.coalesce("cnt", F.lit(0)).alias("cnt"))


def interactions(cells: DataFrame, depth: int, ring: int) -> DataFrame:
    """For each occupied cell, the cells of its level that its points feel there.

    (level, cx, cy, ox, oy, sx, sy, mass, cnt). These are the children of the parent's neighbourhood of `ring` cells, less
    the cell's own neighbourhood, which finer levels resolve; the finest level has that neighbourhood too, and the own cell.
    Every pair of points meets at one level: an equi join on generated cell keys instead of a theta join.
    """
    first = lambda c: (F.floor(F.col(c) / 2).cast("int") - ring) * 2
    top = F.pow(F.lit(2.0), F.col("level") + 1).cast("int") - 1
    around = lambda c: F.sequence(F.greatest(first(c), F.lit(0)), F.least(first(c) + 4 * ring + 1, top))
    want = cells.select("level", "cx", "cy").withColumn("ox", F.explode(around("cx"))).withColumn("oy", F.explode(around("cy")))
    near = (F.abs(F.col("ox") - F.col("cx")) <= ring) & (F.abs(F.col("oy") - F.col("cy")) <= ring)
    want = want.where((F.col("level") == depth - 1) | ~near)
    return want.join(cells.withColumnRenamed("cx", "ox").withColumnRenamed("cy", "oy"), ["level", "ox", "oy"])


def at_levels(points: DataFrame, first: int, depth: int, box: DataFrame | None = None) -> DataFrame:
    """Each point once per level from `first` to below depth, with its cell there."""
    at = relative_positions(points, box).withColumn("level", F.explode(F.sequence(F.lit(first), F.lit(depth - 1))))
    return at.withColumn("cx", cell(F.col("rx"), F.col("level"))).withColumn("cy", cell(F.col("ry"), F.col("level")))
