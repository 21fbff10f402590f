"""Nearest neighbours, outliers, and checks that give the rows that break a rule."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeplane.plans.storage import all_pairs, cut


#: Positions up to which all pairs are compared; positions of a cell from which on it is split; halvings of the box's side, at most.
ALL_PAIRS, CROWD, FINEST = 2_000, 64, 28


def nearest_distances(points: DataFrame) -> DataFrame:
    """(id, nearest): distance to the nearest other point; infinite for a single one.

    Positions are compared, each once, whatever the number of points there. A position looks at the nine cells around it,
    first in the coarsest grid where its own cell holds at most CROWD positions (two on average where they lie evenly). What
    it finds within a cell's side is the nearest; else it looks on in the grid of twice that side. Coordinates that are no
    finite numbers lie in no cell and are compared with all positions.
    """
    points = points.select("id", "x", "y")
    at = cut(points.where("id is not null and x is not null and y is not null").groupBy("x", "y").agg(F.min("id").alias("id"), F.max("id").alias("last")))
    finite = (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    box = at.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~finite, 1)).alias("odd"), *(f(F.when(finite, F.col(c))).alias(f"{c}{k}") for c in ("x", "y") for k, f in enumerate((F.min, F.max)))).first()
    wide = max(box.x1 - box.x0, box.y1 - box.y0) if box.n > box.odd else 0.0
    if box.n <= ALL_PAIRS or not 1e-290 < wide < 1e150:
        near = _beside_all(at, at)
    else:
        near = _in_cells(at.where(finite), box.n - box.odd, box.x0, box.y0, wide)
        if box.odd:
            near = near.where("d2 is not null").unionByName(_beside_all(at.where(~finite), at)).unionByName(_beside_all(near.where("d2 is null").drop("d2"), at))
    own = points.join(near.select("x", "y", "d2"), ["x", "y"]).groupBy("id").agg(F.min("d2").alias("d2"))
    return points.select("id").join(own, "id", "left").select("id", F.coalesce(F.sqrt("d2"), F.lit(float("inf"))).alias("nearest"))


def _least(pairs: DataFrame) -> DataFrame:
    """Positions (x, y, id, last: their least and greatest id) with the least d2 of their pairs that are of two ids, null if none is."""
    d2 = (F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy"))
    two = F.least("id", "oid") != F.greatest("last", "olast")
    return pairs.groupBy("x", "y", "id", "last").agg(F.min(F.when(two, d2)).alias("d2"))


def _others(at: DataFrame) -> DataFrame:
    return at.select(F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("id").alias("oid"), F.col("last").alias("olast"))


def _beside_all(some: DataFrame, at: DataFrame) -> DataFrame:
    return _least(all_pairs(some, _others(at)))


def _in_cells(at: DataFrame, n: int, x0: float, y0: float, wide: float) -> DataFrame:
    """_least() of finite positions. Those that have no other position within a cell's side are few in a cell of the next grid."""

    def celled(df: DataFrame, level: int, x: str = "x", y: str = "y") -> DataFrame:
        number = lambda c, low: F.floor((F.col(c) - F.lit(low)) * F.lit(2.0**level / wide)).cast("long")
        return df.withColumn("cx", number(x, x0)).withColumn("cy", number(y, y0))

    level, rest, first = min(FINEST, max(1, math.ceil(math.log(n / 2, 4)))), at, {}
    while level < FINEST:
        here = celled(rest, level)
        crowded = cut(here.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > CROWD).select("cx", "cy"))
        if crowded.isEmpty():
            break
        first[level] = here.join(crowded, ["cx", "cy"], "left_anti").drop("cx", "cy")
        rest = cut(here.join(crowded, ["cx", "cy"], "left_semi").drop("cx", "cy"))
        level += 1
    first[level] = rest

    found, left = [], None
    around = F.sequence(F.lit(-1), F.lit(1))
    for level in range(level, -1, -1):
        some = [x for x in (left, first.pop(level, None)) if x is not None]
        if some:
            here = celled(some[0] if len(some) == 1 else some[0].unionByName(some[1]), level)
            here = here.withColumn("i", F.explode(around)).withColumn("j", F.explode(around)).select("x", "y", "id", "last", (F.col("cx") + F.col("i")).alias("cx"), (F.col("cy") + F.col("j")).alias("cy"))
            looked = cut(_least(here.join(celled(_others(at), level, "ox", "oy"), ["cx", "cy"])))
            # a little less than the side, as cells are told by rounded numbers
            near = F.coalesce(F.col("d2") <= (0.999 * wide / 2.0**level) ** 2, F.lit(False)) | F.lit(level == 0)
            found.append(looked.where(near))
            left = looked.where(~near).drop("d2")
            left = None if left.isEmpty() else left
        if left is None and not first:
            break
    return reduce(DataFrame.unionByName, found)


def halos(points: DataFrame, multiplier: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(statistics, outliers): points farther from their nearest neighbour than `multiplier` times the mean.

    statistics is one row (mean_nearest, threshold, halo_count); no points give no mean and count 0.
    """
    d = nearest_distances(points)
    stats = d.agg(F.avg("nearest").alias("mean_nearest")).withColumn("threshold", F.col("mean_nearest") * multiplier)
    far = d.crossJoin(F.broadcast(stats)).where(F.col("nearest") > F.col("threshold")).select("id", "nearest")
    counted = stats.crossJoin(F.broadcast(far.agg(F.count(F.lit(1)).alias("halo_count"))))
    return counted, far


def bad_centroids(centroids: DataFrame, k: int) -> DataFrame:
    """Centroids with a missing, infinite or NaN number, a negative count, or a number outside 0 to k - 1."""
    wrong = F.lit(False)
    for c in ("x", "y", "mass"):
        v = F.col(c)
        wrong = wrong | v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return centroids.where(wrong | (F.col("cnt") < 0) | ~F.col("cid").between(0, k - 1))


def bad_assignments(points: DataFrame, assigned: DataFrame, k: int) -> DataFrame:
    """Points without a cluster, with several, or with one outside 0 to k - 1."""
    per = assigned.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("cid").alias("low"), F.max("cid").alias("high"))
    return points.select("id").join(per, "id", "full").where(F.col("n").isNull() | (F.col("n") != 1) | (F.col("low") < 0) | (F.col("high") >= k))


def bad_offsets(offsets: DataFrame, n: int) -> DataFrame:
    """Clusters whose range leaves 0 to n, and one row of cid -1 if the counts don't sum to n."""
    out = offsets.where((F.col("offset") < 0) | (F.col("cnt") < 0) | (F.col("offset") + F.col("cnt") > n))
    total = offsets.agg(F.coalesce(F.sum("cnt"), F.lit(0)).cast("long").alias("cnt")).where(F.col("cnt") != n).select(F.lit(-1).alias("cid"), "cnt", F.lit(0).cast("long").alias("offset"))
    return out.unionByName(total)


def bad_ranges(sorted_points: DataFrame, offsets: DataFrame) -> DataFrame:
    """Sorted points that lie outside of their cluster's range."""
    return sorted_points.join(offsets, "cid", "left").where(F.col("offset").isNull() | (F.col("pos") < F.col("offset")) | (F.col("pos") >= F.col("offset") + F.col("cnt")))


def not_a_permutation(points: DataFrame, sorted_points: DataFrame) -> DataFrame:
    """Ids that are not in both exactly once, and positions taken twice (as id null)."""
    per = points.select("id", F.lit(1).alias("a"), F.lit(0).alias("b")).union(sorted_points.select("id", F.lit(0), F.lit(1))).groupBy("id").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    twice = sorted_points.groupBy("pos").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return per.where("a != 1 or b != 1").select("id").union(twice.select(F.lit(None).cast("long")))


def conservation(cells: DataFrame) -> DataFrame:
    """Mass, points and barycentre of each level: the same on all."""
    return cells.groupBy("level").agg(F.sum("mass").alias("mass"), F.sum("cnt").cast("long").alias("cnt"), (F.sum("sx") / F.sum("mass")).alias("bx"), (F.sum("sy") / F.sum("mass")).alias("by"))
