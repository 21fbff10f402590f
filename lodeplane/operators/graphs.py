"""Adjacency, masses and degrees of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeplane.operators.ordering import positions, prefix_sums


def index_nodes(nodes: DataFrame, key: str) -> DataFrame:
    """Adds a dense ordinal id in the order of the nodes' keys."""
    return positions(nodes, key, name="id")


def index_edges(edges: DataFrame, indexed: DataFrame, key: str) -> DataFrame:
    """Edges between keys as edges between ordinals; an edge with an unknown end is left out."""
    a = indexed.select(F.col(key).alias("src"), F.col("id").alias("_a"))
    b = indexed.select(F.col(key).alias("dst"), F.col("id").alias("_b"))
    return edges.join(a, "src").join(b, "dst").select(F.col("_a").alias("src"), F.col("_b").alias("dst"), "weight")


def adjacency(edges: DataFrame) -> DataFrame:
    """(id, other, weight): each edge from both its ends, parallel edges kept, a loop twice. One pass, no shuffle."""
    ends = F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("id"), F.col("src").alias("other")))
    return edges.select(F.explode(ends).alias("e"), "weight").select("e.id", "e.other", "weight")


def masses(nodes: DataFrame, adj: DataFrame) -> DataFrame:
    """nodes with mass: 1 and the weights of all incident edges."""
    w = adj.groupBy("id").agg(F.sum("weight").alias("_w"))
    return nodes.join(w, "id", "left").withColumn("mass", 1.0 + F.coalesce("_w", F.lit(0.0))).drop("_w")


def mean_mass(state: DataFrame) -> DataFrame:
    return state.agg(F.avg("mass").alias("mean_mass"))


def degrees(nodes: DataFrame, adj: DataFrame) -> DataFrame:
    """(id, cnt): neighbours of each node, loops twice."""
    d = adj.groupBy("id").agg(F.count(F.lit(1)).alias("cnt"))
    return nodes.select("id").join(d, "id", "left").select("id", F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))


def degree_offsets(nodes: DataFrame, adj: DataFrame) -> DataFrame:
    """(id, cnt, offset): where each node's neighbours begin in an array of all, in id order."""
    return prefix_sums(degrees(nodes, adj), "id", "cnt")


def neighbour_lists(nodes: DataFrame, adj: DataFrame) -> DataFrame:
    """degree_offsets with the neighbours themselves, sorted. A list is as long as its node's degree: for export, not for joins."""
    lists = adj.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("other", "weight"))).alias("neighbours"))
    return degree_offsets(nodes, adj).join(lists, "id", "left")


def initial_state(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state, adjacency) of a graph before its first iteration. Edges with an end that is no node are left out."""
    ids = nodes.select("id")
    known = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    adj = adjacency(known)
    size = F.col("size") if "size" in nodes.columns else F.lit(0.0)
    state = masses(nodes.select("id", "x", "y", size.alias("size")), adj)
    return state.select("id", "x", "y", "mass", "size", F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(1.0).alias("convergence")), adj


def write_back(nodes: DataFrame, state: DataFrame) -> DataFrame:
    """nodes with the positions of state, other attributes untouched."""
    at = state.select("id", F.col("x").alias("_x"), F.col("y").alias("_y"))
    out = nodes.join(at, "id", "left")
    return out.select(*(F.coalesce(f"_{c}", c).alias(c) if c in ("x", "y") else F.col(c) for c in nodes.columns))
