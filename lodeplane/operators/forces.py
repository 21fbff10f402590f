"""Forces on nodes: repulsion of four kinds, gravity, attraction of eight. Each gives (id, fx, fy)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeplane.operators.points import at_levels, bounds, interactions, pyramid
from lodeplane.plans.storage import BROADCAST_ROWS, all_pairs, within

#: Turn by which coincident points are moved apart, times their ordinal: the golden angle.
GOLDEN = 2.399963229728653
COLLISION = 100.0
#: Shares of the square's side below which a node counts as lying on a barycentre, whose sums leave such traces.
TOUCH = 1e-9


def _summed(pairs: DataFrame, factor: Column) -> DataFrame:
    return pairs.select("id", (F.col("ddx") * factor).alias("fx"), (F.col("ddy") * factor).alias("fy")).groupBy("id").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))


def _apart(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("ddx", F.col("x") - F.col("ox")).withColumn("ddy", F.col("y") - F.col("oy")).withColumn("d2", F.col("ddx") * F.col("ddx") + F.col("ddy") * F.col("ddy"))


def _others(state: DataFrame, *more: str | Column) -> DataFrame:
    return state.select(F.col("id").alias("oid"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("mass").alias("om"), F.col("size").alias("os"), *more)


def _linear(scaling: float) -> Column:
    """scaling * m * m' / d^2 on the difference, so the force falls as 1 / d; none between coincident points."""
    return F.when(F.col("d2") > 0, F.lit(scaling) * F.col("mass") * F.col("om") / F.col("d2")).otherwise(0.0)


def _sized(scaling: float) -> Column:
    """The same by the distance between the rims; overlapping nodes repel at full strength, touching ones not."""
    d = F.sqrt("d2") - F.col("size") - F.col("os")
    return F.when(d > 0, F.lit(scaling) * F.col("mass") * F.col("om") / (d * d)).when(d < 0, F.lit(COLLISION * scaling) * F.col("mass") * F.col("om")).otherwise(0.0)


def repulsion_all_pairs(state: DataFrame, scaling: float = 1.0, adjust_sizes: bool = False) -> DataFrame:
    """Exact: every other node. Quadratic in the nodes."""
    pairs = _apart(all_pairs(state.select("id", "x", "y", "mass", "size"), _others(state), F.col("id") != F.col("oid")))
    return _summed(pairs, _sized(scaling) if adjust_sizes else _linear(scaling))


def _centroids(centroids: DataFrame) -> DataFrame:
    return centroids.select(F.col("cid").alias("ocid"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("mass").alias("om"))


def repulsion_centroids(state: DataFrame, centroids: DataFrame, scaling: float = 1.0) -> DataFrame:
    """From every centroid as one heavy node, the own one included. Sizes are not looked at."""
    return _summed(_apart(all_pairs(state.select("id", "x", "y", "mass"), _centroids(centroids))), _linear(scaling))


def repulsion_grouped(state: DataFrame, centroids: DataFrame, assigned: DataFrame, scaling: float = 1.0, adjust_sizes: bool = False) -> DataFrame:
    """From the other centroids, and from the nodes of the own cluster one by one: blocks of the cluster meet, so no cluster is one task."""
    own = state.join(assigned.select("id", "cid"), "id")
    far = _apart(all_pairs(own.select("id", "x", "y", "mass", "cid"), _centroids(centroids), F.col("cid") != F.col("ocid")))
    near = within(own.select("id", "x", "y", "mass", "size", "cid"), _others(own, F.col("cid").alias("ocid")), "cid", "ocid").where(F.col("id") != F.col("oid"))
    both = _summed(far, _linear(scaling)).union(_summed(_apart(near), _sized(scaling) if adjust_sizes else _linear(scaling)))
    return both.groupBy("id").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))


def coarse_levels(depth: int, ring: int) -> int:
    """Levels whose interaction lists have BROADCAST_ROWS rows at most, together: every cell with all cells of its list."""
    rows = 0
    for level in range(depth):
        rows += 4 ** (level + 1) * (4 * ring + 2) ** 2
        if rows > BROADCAST_ROWS:
            return level
    return depth


def _felt(state: DataFrame, depth: int, ring: int) -> DataFrame:
    """Each node with the cells it feels; on the finest level without itself in its own cell.

    Of coarse levels, where few cells hold all nodes, the lists are broadcast: at most BROADCAST_ROWS rows by the number of
    cells a level can have, whatever the nodes. Only on finer levels are nodes shuffled by their cells.
    """
    found = bounds(state)
    box = state.sparkSession.createDataFrame(found.collect(), found.schema)  # one row, worked out once
    cells = pyramid(state, depth, box)
    lists = interactions(cells, depth, ring).withColumnRenamed("mass", "cm")
    nodes = state.select("id", "x", "y", "mass")
    coarse = coarse_levels(depth, ring)
    rows = at_levels(nodes, 0, coarse, box).join(F.broadcast(lists.where(F.col("level") < coarse)), ["level", "cx", "cy"])
    if coarse < depth:
        rows = rows.unionByName(at_levels(nodes, coarse, depth, box).join(lists.where(F.col("level") >= coarse), ["level", "cx", "cy"]))
    own = (F.col("level") == depth - 1) & (F.col("cx") == F.col("ox")) & (F.col("cy") == F.col("oy"))
    less = lambda c, v: F.when(own, F.col(c) - v).otherwise(F.col(c)).alias(c)
    return rows.select("id", "x", "y", "mass", "side", "level", less("sx", F.col("x") * F.col("mass")), less("sy", F.col("y") * F.col("mass")), less("cm", F.col("mass")), less("cnt", F.lit(1))).where("cnt > 0 and cm > 0")


def coverage(state: DataFrame, depth: int, ring: int) -> DataFrame:
    """(id, felt): points in the cells that each node feels, itself excluded; all others, once each."""
    return _felt(state, depth, ring).groupBy("id").agg(F.sum("cnt").cast("long").alias("felt"))


def repulsion_quad_tree(state: DataFrame, depth: int, ring: int = 1, scaling: float = 1.0) -> DataFrame:
    """From the barycentres of the cells of the pyramid. A node on a barycentre is pushed by a hundredth of a cell, in a turn
    that its id gives. Sizes are not looked at."""
    f = _felt(state, depth, ring)
    dx, dy = F.col("x") - F.col("sx") / F.col("cm"), F.col("y") - F.col("sy") / F.col("cm")
    away = F.col("side") / F.pow(F.lit(2.0), F.col("level") + 1) * 0.01
    turn = F.col("id").cast("double") * GOLDEN
    f = f.withColumn("bx", dx).withColumn("by", dy).withColumn("on", F.col("bx") * F.col("bx") + F.col("by") * F.col("by") <= F.col("side") * F.col("side") * (TOUCH * TOUCH))
    f = f.withColumn("ddx", F.when(F.col("on"), F.cos(turn) * away).otherwise(F.col("bx"))).withColumn("ddy", F.when(F.col("on"), F.sin(turn) * away).otherwise(F.col("by")))
    return _summed(f, F.lit(scaling) * F.col("mass") * F.col("cm") / (F.col("ddx") * F.col("ddx") + F.col("ddy") * F.col("ddy")))


def gravity(state: DataFrame, strength: float = 1.0, strong: bool = False) -> DataFrame:
    """Towards the origin; strong gravity grows with the distance. No shuffle."""
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    factor = F.when(r > 0, F.col("mass") * strength / (F.lit(1.0) if strong else r)).otherwise(0.0)
    return state.select("id", (F.lit(0.0) - F.col("x") * factor).alias("fx"), (F.lit(0.0) - F.col("y") * factor).alias("fy"))


def attraction(state: DataFrame, adj: DataFrame, lin_log: bool = False, outbound: bool = False, adjust_sizes: bool = False, influence: float = 1.0, mean_mass: float | None = None) -> DataFrame:
    """Along the edges: linear or logarithmic in the distance, or divided by the own mass (and times the mean mass)."""
    if outbound and mean_mass is None:
        mean_mass = state.agg(F.avg("mass")).first()[0] or 1.0
    e = adj.join(state.select("id", "x", "y", "mass", "size"), "id").join(_others(state).withColumnRenamed("oid", "other"), "other")
    e = _apart(e)
    d = F.sqrt("d2")
    d = d - F.col("size") - F.col("os") if adjust_sizes else d
    w = F.col("weight") if influence == 1 else F.pow("weight", F.lit(float(influence)))
    pull = F.lit(0.0) - F.lit(mean_mass if outbound else 1.0) * w
    if outbound:
        pull = pull / F.col("mass")
    if lin_log:
        factor = F.when(d > 0, pull * F.log(1.0 + d) / d).otherwise(0.0)
    else:
        factor = F.when(d > 0, pull).otherwise(0.0) if adjust_sizes else pull
    return _summed(e, factor)


def total(*families: DataFrame) -> DataFrame:
    """The sum of several forces: one shuffle for all."""
    every = families[0]
    for f in families[1:]:
        every = every.unionByName(f)
    return every.groupBy("id").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))
