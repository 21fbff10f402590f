"""k-means on 2-D points."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodeplane.operators.ordering import positions
from lodeplane.plans.storage import BROADCAST_ROWS, cut
from lodeplane.settings import check_centroids

#: Centroids up to which a row compares itself with an array of all; more are put in boxes.
ARRAY_CENTROIDS = 512


@dataclass
class Clustering:
    """centroids(cid, x, y, mass, cnt) after the last update; assign(id, cid), which the last update used."""

    centroids: DataFrame
    assign: DataFrame


def seeds(points: DataFrame, n: int, k: int, iteration: int = 0, ordinal: str = "id") -> DataFrame:
    """k first centroids, each a point of its stretch of the ordinals, chosen by a hash of iteration and centroid."""
    check_centroids(k, n)
    stride = max(n // k, 1)
    v = F.sin(F.lit(float(iteration)) * F.lit(73.0) + F.col("cid") * F.lit(37.0)) * F.lit(43758.5453123)
    want = points.sparkSession.range(k).select(F.col("id").cast("int").alias("cid")).withColumn("ord", (F.col("cid") * F.lit(stride) + F.floor((v - F.floor(v)) * F.lit(float(stride))).cast("long")) % F.lit(n).cast("long"))
    return want.join(points.select(F.col(ordinal).alias("ord"), "x", "y"), "ord").select("cid", "x", "y", F.lit(0.0).alias("mass"), F.lit(0).cast("long").alias("cnt"))


def assign(points: DataFrame, centroids: DataFrame, k: int) -> DataFrame:
    """(id, cid): the nearest centroid of each point, the lowest cid among equals."""
    return placed(points, centroids, k).select("id", "cid")


def placed(points: DataFrame, centroids: DataFrame, k: int) -> DataFrame:
    """(id, x, y, mass, cid): the points with their nearest centroid, without a shuffle.

    Up to ARRAY_CENTROIDS centroids a point compares itself with an array of all. More are dealt into boxes of about the
    square root of their number, by strips of x and then by y; a point passes over boxes that lie farther than the nearest
    centroid so far. Of more than BROADCAST_ROWS centroids, a pass takes a share of at most so many.
    """
    here = points.select("id", F.col("x").alias("px"), F.col("y").alias("py"), F.col("mass").alias("pm"))
    point = ["id", F.col("px").alias("x"), F.col("py").alias("y"), F.col("pm").alias("mass")]
    if k <= ARRAY_CENTROIDS:
        every = centroids.agg(F.collect_list(F.struct("cid", "x", "y")).alias("cs"))  # k entries, at most ARRAY_CENTROIDS
        return here.crossJoin(F.broadcast(every)).select(*point, _nearest(F.col("cs"))["cid"].alias("cid"))
    shares = -(-k // BROADCAST_ROWS)
    best = here.withColumn("best", F.lit(None).cast("struct<d: double, cid: int>"))
    for n in range(shares):
        some = centroids if shares == 1 else centroids.where(F.pmod("cid", F.lit(shares)) == n)
        near = best.crossJoin(F.broadcast(_boxes(some, -(-k // shares)))).withColumn("best", _nearest_of_boxes(F.col("boxes"), F.col("best"))).drop("boxes")
        best = near if n == shares - 1 else cut(near)
    return best.select(*point, F.col("best.cid").alias("cid"))


def _nearest(cs: Column) -> Column:
    """(d, cid) of the nearest of an array of centroids to (px, py), the lowest cid among equals."""
    return F.array_min(F.transform(cs, lambda c: F.struct(((F.col("px") - c["x"]) * (F.col("px") - c["x"]) + (F.col("py") - c["y"]) * (F.col("py") - c["y"])).alias("d"), c["cid"].alias("cid"))))


def _boxes(centroids: DataFrame, k: int) -> DataFrame:
    """One row with an array boxes(x0, x1, y0, y1, cs) of at most BROADCAST_ROWS centroids. A missing coordinate makes its side NaN."""
    strips = max(1, round(k**0.25))
    dealt = centroids.select("cid", "x", "y").withColumn("_strip", F.ntile(strips).over(Window.orderBy("x", "cid")))
    dealt = dealt.withColumn("_box", F.ntile(strips).over(Window.partitionBy("_strip").orderBy("y", "cid")))
    sides = [f(F.coalesce(c, F.lit(float("nan")))).alias(c + n) for c in ("x", "y") for f, n in ((F.min, "0"), (F.max, "1"))]
    boxes = dealt.groupBy("_strip", "_box").agg(*sides, F.collect_list(F.struct("cid", "x", "y")).alias("cs"))
    return boxes.agg(F.collect_list(F.struct("x0", "x1", "y0", "y1", "cs")).alias("boxes"))


def _nearest_of_boxes(boxes: Column, best: Column) -> Column:
    """The least of `best` and _nearest() of the centroids in all boxes, which are taken by their distance.

    A box is passed over if its distance is greater than the least so far: it is worked out by the same operations as a
    centroid's, each of which is monotonic, so rounding loses no centroid. One that is no number passes over nothing.
    """
    zero = F.lit(0.0)

    def far(b: Column) -> Column:
        x, y = (F.greatest(b[c + "0"] - F.col("p" + c), F.col("p" + c) - b[c + "1"], zero) for c in ("x", "y"))
        return F.nanvl(x * x + y * y, zero)

    order = F.array_sort(F.transform(boxes, lambda b, i: F.struct(far(b).alias("far"), i.alias("i"))))
    return F.aggregate(order, best, lambda s, n: F.when(s.isNotNull() & (n["far"] > s["d"]), s).otherwise(F.least(s, _nearest(F.get(boxes, n["i"])["cs"]))))


def update(points: DataFrame, assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """Mean position, summed mass and count of each cluster; one without points keeps its place, with mass and count 0."""
    return means(points.join(assigned, "id"), centroids)


def means(at: DataFrame, centroids: DataFrame) -> DataFrame:
    """update() of points that carry their cluster (of placed()): partial sums per task, then k rows."""
    new = at.groupBy("cid").agg(F.avg("x").alias("nx"), F.avg("y").alias("ny"), F.sum("mass").alias("nm"), F.count(F.lit(1)).alias("nc"))
    return centroids.select("cid", "x", "y").join(new, "cid", "left").select(
        "cid", F.coalesce("nx", "x").alias("x"), F.coalesce("ny", "y").alias("y"), F.coalesce("nm", F.lit(0.0)).alias("mass"), F.coalesce("nc", F.lit(0)).cast("long").alias("cnt")
    )


def kmeans(points: DataFrame, n: int, k: int, steps: int, start: DataFrame | None = None, iteration: int = 0, ordinal: str = "id", cut_steps: bool = True) -> Clustering:
    """steps x (assign, update) from `start`, or from seeds. Each step's centroids are checkpointed: k rows."""
    check_centroids(k, n)
    if steps < 1:
        raise ValueError(f"Invalid steps: {steps}. Must be 1 or more.")
    c = seeds(points, n, k, iteration, ordinal) if start is None else start
    for _ in range(steps):
        a = placed(points, c, k)
        c = means(a, c)
        c = cut(c) if cut_steps else c
    return Clustering(c, a.select("id", "cid"))


def offsets(centroids: DataFrame) -> DataFrame:
    """(cid, cnt, offset): where each cluster's points begin among the points sorted by cluster. k rows, so one task."""
    before = Window.orderBy("cid").rowsBetween(Window.unboundedPreceding, -1)
    return centroids.select("cid", "cnt", F.coalesce(F.sum("cnt").over(before), F.lit(0)).cast("long").alias("offset"))


def sorted_points(assigned: DataFrame) -> DataFrame:
    """(pos, id, cid): points sorted by cluster, then id."""
    return positions(assigned.select("id", "cid"), "cid", "id")
