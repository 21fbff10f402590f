"""Registered queries over the supplied tables: one per operator. Doubles are rounded to 6 digits."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeplane.api import ArgSort, KMeans
from lodeplane.functions import grid_side, next_pow2, uniform
from lodeplane.operators import clusters, diagnostics, forces, graphs, ordering, placement, points
from lodeplane.operators.kernel import RowKernel, wire
from lodeplane.operators.motion import move
from lodeplane.plans.layout import Context, Layout, step
from lodeplane.plans.storage import cut, shared_dir
from lodeplane.settings import Clusters, QuadTree, Settings, default_centroids, default_depth
from lodeplane.sources import clustered_graph, embedding_points, event_graph, load_points, nation_graph, parse_parameters, read_json_graph, scan_edges, spread_positions, table, trade_graph
from lodeplane.streaming import AsyncRead


#: Fixed sizes of the SQL-checked queries, so that SQL can state them without knowing the number of nodes.
DEPTH, RING, K, STEPS = 5, 1, 16, 3
#: Outliers are so many times as far from their neighbours as points are on average; centroids of the query with many.
HALO, MANY = 2.0, 600
#: Repulsions reach 10^9, of which a double keeps no more digits whatever the order of its sum.
FORCE_DIGITS = 2


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many digits, without a negative zero."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def trade(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    g = trade_graph(spark, sf_dir)
    return graphs.initial_state(g.nodes, g.edges)


def settled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The same as checkpoints, as the layout keeps them, for plans that read the state several times."""
    state, adj = trade(spark, sf_dir)
    return cut(state), cut(adj)


def trade_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as points numbered 0 to n - 1, of mass 1 to 3."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("id"))
    return spread_positions(c).withColumn("mass", (1 + F.col("id") % 3).cast("double"))


def part_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_positions(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"), F.col("p_size").cast("double").alias("size"))).withColumn("mass", F.lit(1.0))


def graph_nodes_indexed(spark, d):
    return graphs.index_nodes(event_graph(spark, d).nodes, "key").select("id", "key")


def edges_weight_default(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_discount")).alias("weight"))
    e = scan_edges(e)
    return tidy(e.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight")))


def edges_indexed(spark, d):
    g = event_graph(spark, d)
    return graphs.index_edges(g.edges, graphs.index_nodes(g.nodes, "key"), "key")


def adjacency_symmetrized(spark, d):
    return trade(spark, d)[1]


def node_mass(spark, d):
    return trade(spark, d)[0].select("id", "mass")


def mass_mean(spark, d):
    return tidy(graphs.mean_mass(trade(spark, d)[0]))


def degree_offsets(spark, d):
    s, adj = trade(spark, d)
    return graphs.degree_offsets(s, adj)


def degree_max(spark, d):
    s, adj = trade(spark, d)
    return graphs.degrees(s, adj).agg(F.max("cnt").alias("max_degree"))


def bounding_box(spark, d):
    return points.bounds(trade_points(spark, d))


def bounding_box_embeddings(spark, d):
    return tidy(points.bounds(embedding_points(spark, d)))


def relative_positions(spark, d):
    return tidy(points.relative_positions(trade_points(spark, d)).select("id", "rx", "ry"))


def quadtree_cells(spark, d):
    return tidy(points.pyramid(trade_points(spark, d), DEPTH))


def quadtree_level_dense(spark, d):
    return tidy(points.dense_level(points.pyramid(trade_points(spark, d), DEPTH), 3))


def quadtree_conservation(spark, d):
    return tidy(diagnostics.conservation(points.pyramid(trade_points(spark, d), DEPTH)))


def quadtree_interactions(spark, d):
    return forces.coverage(trade_points(spark, d).withColumn("size", F.lit(0.0)), DEPTH, RING)


def repulsion_quadtree(spark, d):
    return tidy(forces.repulsion_quad_tree(cut(trade(spark, d)[0]), DEPTH, RING), FORCE_DIGITS)


def repulsion_quadtree_fine(spark, d):
    return tidy(forces.repulsion_quad_tree(cut(trade(spark, d)[0]), DEPTH, 2), FORCE_DIGITS)


def n_of(df: DataFrame) -> int:
    return df.count()


def kmeans_seed(spark, d):
    p = trade_points(spark, d)
    return tidy(clusters.seeds(p, n_of(p), K, 7))


def kmeans_assign(spark, d):
    p = trade_points(spark, d)
    return clusters.assign(p, clusters.seeds(p, n_of(p), K), K)


def kmeans_update(spark, d):
    p = trade_points(spark, d)
    return tidy(clusters.kmeans(p, n_of(p), K, 1).centroids)


def kmeans_steps3(spark, d):
    """Over embeddings: on a lattice, equal distances to two centroids would hang on the order of sums."""
    p = _ordered(embedding_points(spark, d))
    return tidy(clusters.kmeans(p, n_of(p), K, STEPS, ordinal="ord").centroids)


def kmeans_empty_cluster(spark, d):
    p = trade_points(spark, d)
    far = spark.createDataFrame([(0, 0.0, 0.0), (1, 50.0, 50.0), (2, 1e6, 1e6)], "cid int, x double, y double")
    return tidy(clusters.update(p, clusters.assign(p, far, 3), far))


def kmeans_sorted_nodes(spark, d):
    p = trade_points(spark, d)
    return clusters.sorted_points(clusters.assign(p, clusters.seeds(p, n_of(p), K), K))


def kmeans_offsets(spark, d):
    p = trade_points(spark, d)
    return clusters.offsets(clusters.kmeans(p, n_of(p), K, 1).centroids)


def argsort(spark, d):
    return ordering.argsort(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("key"))).select("pos", "id")


def prefix_sum(spark, d):
    return ordering.prefix_sums(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("size")), "id", "size")


def permutation_check(spark, d):
    p = trade_points(spark, d)
    order = clusters.sorted_points(clusters.assign(p, clusters.seeds(p, n_of(p), K), K))
    return diagnostics.not_a_permutation(p, order).agg(F.count(F.lit(1)).alias("violations"))


def repulsion_allpairs(spark, d):
    return tidy(forces.repulsion_all_pairs(cut(trade(spark, d)[0])), FORCE_DIGITS)


def repulsion_allpairs_sizes(spark, d):
    return tidy(forces.repulsion_all_pairs(cut(trade(spark, d)[0]), adjust_sizes=True), FORCE_DIGITS)


def _ordered(state: DataFrame) -> DataFrame:
    return ordering.positions(state, "id", name="ord")


def _clustered(state: DataFrame) -> clusters.Clustering:
    """Clusters of one step, with centroids to 3 digits: whether a node lies on its centroid mustn't hang on the order of sums."""
    p = _ordered(state.select("id", "x", "y", "mass"))
    c = clusters.kmeans(p, n_of(p), K, 1, ordinal="ord")
    return clusters.Clustering(c.centroids.withColumn("x", F.round("x", 3)).withColumn("y", F.round("y", 3)), c.assign)


def repulsion_kmeans(spark, d):
    s = cut(trade(spark, d)[0])
    return tidy(forces.repulsion_centroids(s, _clustered(s).centroids), FORCE_DIGITS)


def repulsion_kmeans_grouped(spark, d):
    s = cut(trade(spark, d)[0])
    c = _clustered(s)
    return tidy(forces.repulsion_grouped(s, c.centroids, c.assign), FORCE_DIGITS)


def repulsion_kmeans_grouped_sizes(spark, d):
    s = cut(trade(spark, d)[0])
    c = _clustered(s)
    return tidy(forces.repulsion_grouped(s, c.centroids, c.assign, adjust_sizes=True), FORCE_DIGITS)


def gravity(spark, d):
    return tidy(forces.gravity(trade(spark, d)[0], 0.2))


def gravity_strong(spark, d):
    return tidy(forces.gravity(trade(spark, d)[0], 0.2, strong=True))


def _attraction(**kind) -> Callable:
    def query(spark, d):
        s, adj = trade(spark, d)
        return tidy(forces.attraction(s, adj, **kind))

    return query


def _moved(adjust_sizes: bool) -> Callable:
    def query(spark, d):
        s, adj = trade(spark, d)
        f = forces.total(forces.gravity(s), forces.attraction(s, adj))
        return tidy(move(s, f, max_force=10.0, slow_down=2.0, adjust_sizes=adjust_sizes)).drop("mass", "size")

    return query


def _step(settings: Settings) -> Callable:
    def query(spark, d):
        s, adj = settled(spark, d)
        found = _clustered(s) if isinstance(settings.repulsion, Clusters) else None
        n = n_of(s)
        mean = graphs.mean_mass(s).first()[0] if settings.outbound_attraction else 1.0
        return tidy(step(s, Context(adj, n, mean), settings, found)).drop("mass", "size")

    return query


def layout_3_iterations(spark, d):
    """Over all nodes; to 3 digits, as the order of sums shows in the last ones after several iterations."""
    g = trade_graph(spark, d)
    layout = Layout(g.nodes, g.edges)
    layout.read()
    for _ in range(3):
        layout.iterate()
    return tidy(layout.state, 3).drop("size")


def layout_set_between(spark, d):
    """Two iterations, then another gravity and scaling for a third."""
    g = nation_graph(spark, d)
    layout = Layout(g.nodes, g.edges)
    layout.read()
    for k in range(3):
        if k == 2:
            layout.set(gravity=0.2, scaling_ratio=2.0)
        layout.iterate()
    return tidy(layout.state).drop("size")


def nearest_neighbor_distance(spark, d):
    return tidy(diagnostics.nearest_distances(part_points(spark, d)))


def empty_halos(spark, d):
    return tidy(diagnostics.halos(embedding_points(spark, d), HALO)[0])


def empty_halo_points(spark, d):
    return tidy(diagnostics.halos(embedding_points(spark, d), HALO)[1])


def _violations(**checks: DataFrame) -> DataFrame:
    out = None
    for name, rows in sorted(checks.items()):
        row = rows.agg(F.lit(name).alias("rule"), F.count(F.lit(1)).alias("violations"))
        out = row if out is None else out.unionByName(row)
    return out


def validate_kmeans(spark, d):
    p = trade_points(spark, d)
    n = n_of(p)
    c = clusters.kmeans(p, n, K, 2)
    return _violations(centroids=diagnostics.bad_centroids(c.centroids, K), assignments=diagnostics.bad_assignments(p, c.assign, K))


def validate_grouped(spark, d):
    p = trade_points(spark, d)
    n = n_of(p)
    c = clusters.kmeans(p, n, K, 2)
    off, order = clusters.offsets(c.centroids), clusters.sorted_points(c.assign)
    return _violations(offsets=diagnostics.bad_offsets(off, n), ranges=diagnostics.bad_ranges(order, off), order=diagnostics.not_a_permutation(p, order))


def row_kernel(spark, d):
    def fn(batch: pd.DataFrame, tables: dict, scale: float) -> pd.DataFrame:
        box = tables["box"].iloc[0]
        return pd.DataFrame({"id": batch.id, "u": ((batch.x - box.xmin) * scale).round(6), "v": ((batch.y - box.ymin) * scale).round(6)})

    p = trade_points(spark, d)
    return RowKernel(fn, "id long, u double, v double", {"box": points.bounds(p)}, scale=0.5).compute(p.select("id", "x", "y"))


def largest_component(spark, d):
    g = trade_graph(spark, d)
    return placement.largest_component(g.nodes, g.edges)[0].select("id")


def components(spark, d):
    g = trade_graph(spark, d)
    return placement.components(g.nodes, g.edges)


def circular_layout(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    return tidy(placement.circular(n, n_of(n), 5000.0))


def random_layout(spark, d):
    n = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("id"))
    return tidy(placement.random(n, 5000.0, 42))


def size_by_degree(spark, d):
    g = trade_graph(spark, d)
    return tidy(placement.size_by_degree(g.nodes, g.edges).select("id", "size"))


def prng(spark, d):
    return spark.range(1000).select(F.col("id").alias("k"), (F.round(uniform(12345, F.col("id")), 9) + 0.0).alias("u"))


def clustered_graph_stats(spark, d):
    g = clustered_graph(spark, 1000, 5000, 5, 0.7, 42)
    return g.edges.agg(F.count(F.lit(1)).alias("edges"), F.sum((F.col("src") % 5 == F.col("dst") % 5).cast("long")).alias("inside"), F.max("src").alias("most"), F.max("dst").alias("most_dst"))


def community_labels(spark, d):
    g = trade_graph(spark, d)
    return placement.communities(g.nodes, g.edges)


def packed_communities(spark, d):
    g = trade_graph(spark, d)
    return tidy(placement.packed_circles(g.nodes.select("id", "size", "x", "y"), placement.communities(g.nodes, g.edges), 100.0))


def write_back(spark, d):
    g = trade_graph(spark, d)
    state = placement.circular(g.nodes.select("id"), n_of(g.nodes), 10.0)
    return tidy(graphs.write_back(g.nodes, state))


def neighbour_lists(spark, d):
    s, adj = settled(spark, d)
    n = F.col("neighbours")
    total = F.aggregate(n, F.lit(0.0), lambda a, x: a + x["weight"] * (x["other"] % 1000))
    return graphs.neighbour_lists(s, adj).select("id", "cnt", "offset", F.coalesce(F.size(n), F.lit(0)).cast("long").alias("listed"), n[0]["other"].alias("first"), F.element_at(n, -1)["other"].alias("last"), total.alias("total"))


def layout_run_snapshots(spark, d):
    """Rows (iterations, nodes) of each snapshot of a run of 4 iterations in frames of 2."""
    from lodeplane.streaming import ForceLayout

    g, seen = trade_graph(spark, d), []
    run = ForceLayout(g.nodes, g.edges, Settings(repulsion=QuadTree(3), iterations_per_frame=2, sync_interval=0.0), lambda nodes, i: seen.append((i, nodes.count())))
    run.start(4)
    run.wait()
    return spark.createDataFrame(seen, "iterations long, nodes long")


def layout_run_state(spark, d):
    """What a run says of itself: while it has an endless run under way, after stop(), and after a run of 3 iterations."""
    from lodeplane.streaming import ForceLayout

    g = nation_graph(spark, d)
    run = ForceLayout(g.nodes, g.edges, Settings(iterations_per_frame=1))
    run.start()
    rows = [("endless", run.is_running(), run.total_iterations() >= 1)]
    run.stop()
    rows.append(("stopped", run.is_running(), run.total_iterations() >= 1))
    before = run.total_iterations()
    run.start(3)
    run.wait()
    rows.append(("finished", run.is_running(), run.total_iterations() == before + 3 and run.metrics.iterations == before + 3 and run.metrics.per_second > 0))
    return spark.createDataFrame(rows, "moment string, running boolean, counted boolean")


def point_load(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id"), F.col("p_size").alias("x"), F.col("p_retailprice").alias("y"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_partkey") % 5).alias("mass"))
    return tidy(load_points(p))


def json_graph(spark, d):
    """The nations' graph written as one JSON document and read back: nodes with their edges' number and weight."""
    g = nation_graph(spark, d)
    key = lambda c: F.col(c).cast("string")
    nodes = g.nodes.agg(F.collect_list(F.struct(key("id").alias("key"), F.struct("x", "y", "size").alias("attributes"))).alias("nodes"))
    edges = g.edges.agg(F.collect_list(F.struct(key("src").alias("source"), key("dst").alias("target"), F.struct("weight").alias("attributes"))).alias("edges"))
    path = f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}"
    nodes.crossJoin(edges).write.json(path)  # the document: one row
    back = read_json_graph(spark, path)
    out = back.edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("edges"), F.sum("weight").alias("weight"))
    return tidy(back.nodes.join(out, "id", "left"))


def clustered_graph_nodes(spark, d):
    return tidy(clustered_graph(spark, 1000, 5000, 5, 0.7, 42, 2.0, 500.0).nodes)


def sizing(spark, d):
    """Grid sides, powers of two, default depths and centroids by the number of rows."""
    rows = [(n, grid_side(n), next_pow2(n), default_depth(n), default_centroids(n)) for n in range(1, 3000)]
    return spark.createDataFrame(rows, "n long, side long, pow2 long, depth long, centroids long")


def level_arithmetic(spark, d):
    rows = [(k, points.level_side(k), points.level_row(k), points.stack_width(k + 1), points.stack_height(k + 1)) for k in range(12)]
    return spark.createDataFrame(rows, "level long, side long, first long, width long, height long")


def parameters(spark, d):
    """Settings read from the text of a link."""
    s = parse_parameters("?gravity=0.2&lin_log=true&iterations_per_frame=25&adjust_sizes=false&unknown=1&debug", Settings())
    return spark.createDataFrame([(k, float(getattr(s, k))) for k in ("gravity", "lin_log", "iterations_per_frame", "adjust_sizes", "scaling_ratio", "max_force")], "name string, value double")


def argsort_payload(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("key"), F.col("o_custkey").alias("customer"))
    return ordering.argsort(o).select("pos", "id", "customer")


def argsort_read(spark, d):
    sort = ArgSort()
    sort.set_data(table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_acctbal").cast("double").alias("key")), too_high=1e9)
    sort.sort()
    return spark.createDataFrame(list(enumerate(sort.values())), "pos long, id long")


def async_read(spark, d):
    """A read in another thread: under way, a second one is refused."""
    read = AsyncRead()
    began, again = read.start(points.bounds(trade_points(spark, d))), read.start(spark.range(1))
    while (got := read.poll()) is None:
        time.sleep(0.01)
    return spark.createDataFrame([(*(float(got.column(c)[0].as_py()) for c in ("xmin", "xmax", "ymin", "ymax")), began, again)], "xmin double, xmax double, ymin double, ymax double, began boolean, again boolean")


def kmeans_reinitialized(spark, d):
    """Two steps, then one from other seeds."""
    km = KMeans(K)
    km.set_nodes(embedding_points(spark, d))
    km.compute(2)
    return tidy(km.compute(1, reinitialize=True, iteration=5))


def kmeans_assign_many(spark, d):
    """More centroids than are compared as one array: orders as points."""
    p = _ordered(spread_positions(table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("id"))).withColumn("mass", F.lit(1.0)))
    return clusters.assign(p, clusters.seeds(p, n_of(p), MANY, 0, "ord"), MANY)


def kernel_wired(spark, d):
    """Two kernels by name: the second reads what the first made of the bounding box."""

    def centre(batch: pd.DataFrame, tables: dict) -> pd.DataFrame:
        return pd.DataFrame({"cx": (batch.xmin + batch.xmax) / 2, "cy": (batch.ymin + batch.ymax) / 2})

    def away(batch: pd.DataFrame, tables: dict, scale: float) -> pd.DataFrame:
        c = tables["centre"].iloc[0]
        return pd.DataFrame({"id": batch.id, "u": ((batch.x - c.cx) * scale).round(6), "v": ((batch.y - c.cy) * scale).round(6)})

    p = trade_points(spark, d)
    box = points.bounds(p)
    first = RowKernel(centre, "cx double, cy double")
    second = RowKernel(away, "id long, u double, v double", {"centre": spark.createDataFrame([(0.0, 0.0)], "cx double, cy double")}, scale=2.0)
    return wire({"centre": (first, box), "away": (second, p.select("id", "x", "y"))})["away"]


def row_kernel_joined(spark, d):
    """A kernel that reads, of a table of any size, the row of its own row's key."""

    def fn(batch: pd.DataFrame, tables: dict) -> pd.DataFrame:
        return pd.DataFrame({"id": batch.o_orderkey, "u": (batch.o_totalprice - batch.customer_c_acctbal).round(2)})

    o, c = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("double").alias("o_totalprice")), table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").cast("double").alias("c_acctbal"))
    return tidy(RowKernel(fn, "id long, u double", lookups={"customer": (c, "o_custkey")}).compute(o), 2)


def validate_planted(spark, d):
    """Rows that break a rule, of inputs that break them by a rule of their ids."""
    p = trade_points(spark, d)
    n = n_of(p)
    c = clusters.kmeans(p, n, K, 1)
    x = F.when(F.col("cid") % 4 == 1, F.lit(float("nan"))).when(F.col("cid") % 4 == 2, F.lit(float("inf"))).otherwise(F.col("x"))
    centroids = c.centroids.withColumn("x", x).withColumn("cnt", F.when(F.col("cid") == 4, -1).otherwise(F.col("cnt"))).withColumn("cid", F.when(F.col("cid") == 8, K).otherwise(F.col("cid")))
    a = c.assign.where("id % 7 != 3")
    a = a.withColumn("cid", F.when(F.col("id") % 11 == 5, K).otherwise(F.col("cid"))).union(a.where("id % 5 = 0"))
    order, off = clusters.sorted_points(c.assign), clusters.offsets(c.centroids)
    moved = off.withColumn("offset", F.when(F.col("cid") == 0, -1).when(F.col("cid") == K - 1, n).otherwise(F.col("offset")))
    swapped = order.withColumn("pos", F.lit(n - 1).cast("long") - F.col("pos"))
    broken = order.withColumn("id", F.when(F.col("id") % 6 == 2, F.col("id") + 1).otherwise(F.col("id"))).withColumn("pos", F.when(F.col("pos") % 9 == 4, F.col("pos") + 1).otherwise(F.col("pos")))
    return _violations(centroids=diagnostics.bad_centroids(centroids, K), assignments=diagnostics.bad_assignments(p, a, K), offsets=diagnostics.bad_offsets(moved, n), counts=diagnostics.bad_offsets(off, n + 1), ranges=diagnostics.bad_ranges(swapped, off), order=diagnostics.not_a_permutation(p, broken))


ATTRACTION = {
    f"attraction_{'linlog' if lin else 'linear'}{'_dist' if out else ''}{'_sizes' if sizes else ''}": dict(lin_log=lin, outbound=out, adjust_sizes=sizes)
    for lin in (False, True) for out in (False, True) for sizes in (False, True)
}

STEPS_OF = {
    "layout_step_allpairs": Settings(),
    "layout_step_allpairs_sizes": Settings(adjust_sizes=True),
    "layout_step_linlog_strong": Settings(lin_log=True, strong_gravity=True, gravity=0.2),
    "layout_step_outbound": Settings(outbound_attraction=True, scaling_ratio=2.0),
    "layout_step_quadtree": Settings(repulsion=QuadTree(DEPTH, 1.0)),
    "layout_step_kmeans": Settings(repulsion=Clusters(K, 1)),
    "layout_step_kmeans_grouped": Settings(repulsion=Clusters(K, 1, node_to_node=True)),
}

_PLAIN = [
    graph_nodes_indexed, edges_weight_default, edges_indexed, adjacency_symmetrized, node_mass, mass_mean, degree_offsets, degree_max, bounding_box, bounding_box_embeddings,
    relative_positions, quadtree_cells, quadtree_level_dense, quadtree_conservation, quadtree_interactions, repulsion_quadtree, repulsion_quadtree_fine, kmeans_seed, kmeans_assign, kmeans_update,
    kmeans_steps3, kmeans_empty_cluster, kmeans_sorted_nodes, kmeans_offsets, argsort, prefix_sum, permutation_check, repulsion_allpairs, repulsion_allpairs_sizes, repulsion_kmeans,
    repulsion_kmeans_grouped, repulsion_kmeans_grouped_sizes, gravity, gravity_strong, layout_3_iterations, nearest_neighbor_distance, empty_halos, empty_halo_points, validate_kmeans, validate_grouped,
    row_kernel, largest_component, components, circular_layout, random_layout, size_by_degree, prng, clustered_graph_stats, community_labels, packed_communities, write_back, neighbour_lists, layout_run_snapshots,
    layout_set_between, layout_run_state, point_load, json_graph, clustered_graph_nodes, sizing, level_arithmetic, parameters, argsort_payload, argsort_read, async_read, kmeans_reinitialized, kmeans_assign_many,
    kernel_wired, row_kernel_joined, validate_planted,
]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{f.__name__: f for f in _PLAIN},
    **{name: _attraction(**kind) for name, kind in ATTRACTION.items()},
    "force_clamp_speed": _moved(False),
    "speed_sizes": _moved(True),
    **{name: _step(s) for name, s in STEPS_OF.items()},
}

