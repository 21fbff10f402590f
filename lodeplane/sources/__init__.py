"""Graphs and points from tables, JSON files and generators."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeplane.functions import one_if_missing, uniform
from lodeplane.workers import reach


@dataclass
class Graph:
    """nodes(id, x, y, size, ...) and edges(src, dst, weight)."""

    nodes: DataFrame
    edges: DataFrame


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reach(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan_nodes(df: DataFrame, id_col: str = "id", x: Column | None = None, y: Column | None = None, size: Column | None = None) -> DataFrame:
    """id, x, y, size as the layout reads them. Rows without an id are left out; a missing coordinate or size is NaN."""
    pick = lambda c, name: F.coalesce((c if c is not None else F.col(name) if name in df.columns else F.lit(None)).cast("double"), F.lit(float("nan"))).alias(name)
    return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), pick(x, "x"), pick(y, "y"), pick(size, "size"))


def scan_edges(df: DataFrame, src: str = "src", dst: str = "dst", weight: Column | str | None = "weight") -> DataFrame:
    """src, dst, weight; a missing, null, zero or NaN weight is 1. weight: a column, its name, or None for 1."""
    w = F.lit(1.0) if weight is None or isinstance(weight, str) and weight not in df.columns else one_if_missing(F.col(weight) if isinstance(weight, str) else weight)
    return df.select(F.col(src).alias("src"), F.col(dst).alias("dst"), w.alias("weight"))


def load_points(df: DataFrame) -> DataFrame:
    """id, x, y, mass; a missing, null or zero mass is 1."""
    mass = one_if_missing(F.col("mass")) if "mass" in df.columns else F.lit(1.0)
    return df.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), mass.alias("mass"))


def read_json_graph(spark: SparkSession, path: str) -> Graph:
    """A serialized graph: {"nodes": [{"key", "attributes": {x, y, size}}], "edges": [{"source", "target", "attributes": {weight}}]}."""
    schema = (
        "nodes array<struct<key: string, attributes: struct<x: double, y: double, size: double>>>, "
        "edges array<struct<source: string, target: string, attributes: struct<weight: double>>>"
    )
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    nodes = doc.select(F.explode("nodes").alias("n")).select(F.col("n.key").alias("id"), F.col("n.attributes.x").alias("x"), F.col("n.attributes.y").alias("y"), F.col("n.attributes.size").alias("size"))
    edges = doc.select(F.explode("edges").alias("e")).select(F.col("e.source").alias("src"), F.col("e.target").alias("dst"), one_if_missing(F.col("e.attributes.weight")).alias("weight"))
    return Graph(nodes, edges)


def spread_positions(df: DataFrame, seed: int = 42, id_col: str = "id") -> DataFrame:
    """x and y by an integer rule of the id: between -100 and 100, equal for ids that are 10,000 apart."""
    at = lambda k: F.round(((F.lit(seed) + F.lit(k) * F.col(id_col)) % 10000).cast("double") / 50.0 - 100.0, 2)
    return df.withColumn("x", at(13)).withColumn("y", at(17))


def trade_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers and suppliers (ids from 1,000,000 on); an edge for each pair that traded, weighted by its line items."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("id"))
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1_000_000).cast("long").alias("id"))
    nodes = spread_positions(c.union(s)).withColumn("size", (F.col("id") % 5).cast("double"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("long").alias("src"))
    i = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") + 1_000_000).cast("long").alias("dst"))
    edges = o.join(i, o.o_orderkey == i.l_orderkey).groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return Graph(nodes, edges)


def nation_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Nations; an edge for each pair of customer's and supplier's nation that traded, loops among them."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    nodes = spread_positions(n).withColumn("size", (F.col("id") % 5).cast("double"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    i = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("src"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("dst"))
    edges = o.join(i, o.o_orderkey == i.l_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return Graph(nodes, edges.groupBy("src", "dst").agg((F.count(F.lit(1)) / 100.0).alias("weight")))


def event_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Users and event types; node keys are strings."""
    e = table(spark, sf_dir, "events").where("user_id is not null and event_type is not null").select(F.concat(F.lit("u"), "user_id").alias("src"), F.col("event_type").alias("dst"))
    edges = e.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    nodes = edges.select(F.col("src").alias("key")).union(edges.select(F.col("dst").alias("key"))).distinct()
    return Graph(nodes, edges)


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two components of each vector, of mass 1."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), F.lit(1.0).alias("mass"))


def clustered_graph(spark: SparkSession, order: int, size: int, clusters: int, density: float = 0.5, seed: int = 1, size_factor: float = 1.0, scale: float = 1000.0) -> Graph:
    """A random graph of `order` nodes and `size` edges; a share `density` of the edges stays inside a cluster.

    Every number is a function of seed and row, so any partitioning gives the same graph. Node size is degree / 3 x size_factor.
    """
    if order < 1 or clusters < 1:
        raise ValueError("order and clusters must be 1 or more")
    n, k = F.lit(order).cast("long"), F.lit(clusters).cast("long")
    nodes = spark.range(order).select("id", (F.col("id") % k).cast("int").alias("cluster"), ((uniform(seed, F.col("id") * 2) - 0.5) * scale).alias("x"), ((uniform(seed, F.col("id") * 2 + 1) - 0.5) * scale).alias("y"))
    e = spark.range(size)
    draw = lambda j: uniform(seed + 1, F.col("id") * 4 + j)
    src = F.floor(draw(0) * order).cast("long")
    members = F.floor((n - 1 - src % k) / k).cast("long") + 1  # of src's cluster
    inside = src % k + k * F.floor(draw(2) * members).cast("long")
    edges = e.select(src.alias("src"), F.when(draw(1) < density, inside).otherwise(F.floor(draw(3) * order).cast("long")).alias("dst"), F.lit(1.0).alias("weight"))
    degree = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    nodes = nodes.join(degree, "id", "left").withColumn("size", F.coalesce("degree", F.lit(0)) / 3.0 * size_factor).drop("degree")
    return Graph(nodes, edges)


def parse_parameters(text: str, defaults):
    """A dataclass from `key=value&key=value` over its defaults: numbers, true/false (anything but "false" is true), words."""
    given = dict(part.split("=", 1) for part in text.lstrip("#?").split("&") if "=" in part)
    out = {}
    for f in fields(defaults):
        old = getattr(defaults, f.name)
        if f.name in given and isinstance(old, (bool, int, float, str)):
            v = given[f.name]
            out[f.name] = v != "false" if isinstance(old, bool) else type(old)(v)
    return type(defaults)(**{**{f.name: getattr(defaults, f.name) for f in fields(defaults)}, **out})
