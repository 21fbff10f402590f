"""First positions, sizes, and the largest component."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeplane.functions import uniform
from lodeplane.operators.graphs import adjacency, degrees
from lodeplane.plans.storage import cut


def circular(nodes: DataFrame, n: int, scale: float = 1.0, ordinal: str = "id") -> DataFrame:
    """Nodes on a circle by their ordinal."""
    turn = F.col(ordinal).cast("double") * (2.0 * math.pi) / float(n)
    return nodes.withColumn("x", F.cos(turn) * scale).withColumn("y", F.sin(turn) * scale)


def random(nodes: DataFrame, scale: float = 1.0, seed: int = 1, center: float = 0.0, ordinal: str = "id") -> DataFrame:
    """Nodes in a square around the centre; each number follows from seed and ordinal."""
    at = lambda j: (uniform(seed, F.col(ordinal) * 2 + j) - 0.5) * scale + center
    return nodes.withColumn("x", at(0)).withColumn("y", at(1))


def size_by_degree(nodes: DataFrame, edges: DataFrame, factor: float = 5.0) -> DataFrame:
    """Node size: degree / 3 x factor."""
    d = degrees(nodes, adjacency(edges))
    return nodes.drop("size").join(d, "id").withColumn("size", F.col("cnt") / 3.0 * factor).drop("cnt")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id that each node reaches. Least neighbours are passed on, then labels jump to their label's label."""
    adj = cut(adjacency(edges).select("id", "other").distinct())  # each round reads it
    label = cut(nodes.select("id", F.col("id").alias("component")))
    while True:
        near = adj.join(label.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("component").alias("least"))
        step = label.join(near, "id", "left").select("id", "component", F.least("component", F.coalesce("least", "component")).alias("next"))
        jump = label.select(F.col("id").alias("next"), F.col("component").alias("beyond"))
        step = cut(step.join(jump, "next").select("id", "component", F.least("next", "beyond").alias("next")))
        label = step.select("id", F.col("next").alias("component"))
        if not step.where("component != next").limit(1).count():
            return label


def largest_component(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the component with most nodes, of equal ones that with the least id."""
    label = components(nodes, edges)
    best = label.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
    ids = label.join(F.broadcast(best), "component").select("id")  # one row
    kept = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return nodes.join(ids, "id", "left_semi"), kept


def communities(nodes: DataFrame, edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, community): label propagation, each node taking the heaviest label around it and its own, the least among equals.

    An approximation of modularity clustering. Weights are summed to 9 digits, so ties don't hang on the order; rounds are synchronous and end when no label changes.
    """
    adj = cut(adjacency(edges))
    own = F.lit(1e-6)
    label = cut(nodes.select("id", F.col("id").alias("community")))
    for _ in range(rounds):
        votes = adj.join(label.withColumnRenamed("id", "other"), "other").select("id", "community", "weight").union(label.select("id", "community", own))
        best = votes.groupBy("id", "community").agg(F.round(F.sum("weight"), 9).alias("w")).groupBy("id").agg(F.max(F.struct("w", (F.lit(0) - F.col("community")).alias("c"))).alias("b"))
        new = cut(best.select("id", (F.lit(0) - F.col("b.c")).alias("next")).join(label, "id"))
        label = new.select("id", F.col("next").alias("community"))
        if not new.where("next != community").limit(1).count():
            break
    return label


def packed_circles(nodes: DataFrame, community: DataFrame, scale: float = 1.0) -> DataFrame:
    """Nodes on a sunflower spiral around their community's centre, communities on a larger one by size.

    Community sizes are ranked over one row per community; inside a community each node's place is its rank by id.
    """
    from lodeplane.operators.ordering import positions

    c = community.groupBy("community").agg(F.count(F.lit(1)).alias("n"))
    c = positions(c, F.desc("n"), "community", name="rank")
    first = positions(community, "community", "id", name="at")
    start = first.groupBy("community").agg(F.min("at").alias("start"))
    here = first.join(start, "community").join(c, "community")
    golden = 2.399963229728653
    k, r = F.col("at") - F.col("start"), F.col("rank")
    spiral = lambda f, i, s: f(i * golden) * F.sqrt(i.cast("double")) * s
    reach = F.sqrt(F.lit(1.0) * here["n"])
    at = here.select("id", (spiral(F.cos, r, 3.0) * reach + spiral(F.cos, k, 1.0)).alias("x"), (spiral(F.sin, r, 3.0) * reach + spiral(F.sin, k, 1.0)).alias("y"))
    return nodes.drop("x", "y").join(at.select("id", (F.col("x") * scale).alias("x"), (F.col("y") * scale).alias("y")), "id")
