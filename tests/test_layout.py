"""One iteration for every combination of settings against plain Python, and the control of runs."""

import itertools
import json
import math

import numpy as np
import pandas as pd
import pytest

from lodeplane.api import AsyncRead, ForceLayout, RowKernel
from lodeplane.operators import forces, graphs
from lodeplane.operators.placement import communities, components, largest_component
from lodeplane.plans import storage
from lodeplane.plans.layout import Layout
from lodeplane.settings import AllPairs, Clusters, QuadTree, Settings
from lodeplane.sources import clustered_graph, parse_parameters, read_json_graph, scan_edges, scan_nodes

NODES = [(i, ((42 + 1300 * i) % 997) / 5 - 100, ((42 + 1700 * i) % 991) / 5 - 100, float(i % 4) * 9) for i in range(12)] + [(12, 0.0, 0.0, 1.0), (13, 5.0, 5.0, 1.0), (14, 5.0, 5.0, 1.0)]
EDGES = [(i, (i * 5 + 3) % 15, w) for i, w in enumerate([1.0, 2.0, None, 0.0, 0.5, 3.0, 1.0, 1.5])] + [(2, 2, 2.0), (0, 3, 1.0), (0, 3, 1.0), (4, 99, 7.0)]


@pytest.fixture(scope="module")
def graph(spark):
    return spark.createDataFrame(NODES, "id long, x double, y double, size double").cache(), scan_edges(spark.createDataFrame(EDGES, "src long, dst long, weight double")).cache()


def expected(s: Settings, assigned=None, centroids=None, cells=None):
    n = len(NODES)
    w = [(a, b, 1.0 if not c else c) for a, b, c in EDGES if b < n]
    mass = [1.0] * n
    for a, b, c in w:
        mass[a] += c
        mass[b] += c
    mean, out = sum(mass) / n, []
    for i, x, y, size in NODES:
        fx = fy = 0.0

        def push(ox, oy, om, os=None):
            nonlocal fx, fy
            dx, dy = x - ox, y - oy
            d2 = dx * dx + dy * dy
            f = s.scaling_ratio * mass[i] * om / d2 if d2 > 0 else 0
            if os is not None and s.adjust_sizes:
                d = math.sqrt(d2) - size - os
                f = s.scaling_ratio * mass[i] * om / (d * d) if d > 0 else 100 * s.scaling_ratio * mass[i] * om if d < 0 else 0
            fx, fy = fx + dx * f, fy + dy * f

        if isinstance(s.repulsion, AllPairs):
            for j, ox, oy, os in NODES:
                if j != i:
                    push(ox, oy, mass[j], os)
        elif isinstance(s.repulsion, Clusters):
            for c, (cx, cy, cm) in centroids.items():
                if not s.repulsion.node_to_node or c != assigned[i]:
                    push(cx, cy, cm)
            if s.repulsion.node_to_node:
                for j, ox, oy, os in NODES:
                    if j != i and assigned[j] == assigned[i]:
                        push(ox, oy, mass[j], os)
        r = math.hypot(x, y)
        if r > 0:
            g = mass[i] * s.gravity / (1 if s.strong_gravity else r)
            fx, fy = fx - x * g, fy - y * g
        for a, b, c in w:
            for me, other in ((a, b), (b, a)):
                if me == i:
                    _, ox, oy, os = NODES[other]
                    dx, dy = x - ox, y - oy
                    d = math.hypot(dx, dy) - (size + os if s.adjust_sizes else 0)
                    k = -(mean if s.outbound_attraction else 1) * c**s.edge_weight_influence / (mass[i] if s.outbound_attraction else 1)
                    f = (k * math.log(1 + d) / d if d > 0 else 0) if s.lin_log else (k if d > 0 or not s.adjust_sizes else 0)
                    fx, fy = fx + dx * f, fy + dy * f
        f = math.hypot(fx, fy)
        k = s.max_force / f if f > s.max_force else 1
        nx, ny = fx * k, fy * k
        steady = 1 / (1 + math.sqrt(mass[i] * math.hypot(nx, ny)))
        speed = (0.1 if s.adjust_sizes else 1) * math.log(1 + math.hypot(nx, ny) / 2) * steady
        conv = 1.0 if s.adjust_sizes else min(1, math.sqrt(speed * f * f * steady))
        out.append((x + nx * speed / s.slow_down, y + ny * speed / s.slow_down, conv))
    return out


@pytest.mark.parametrize("flags", [*itertools.product([False, True], repeat=4)])
@pytest.mark.parametrize("kind", ["all", "centroids", "grouped"])
def test_step(graph, flags, kind):
    lin, sizes, strong, out = flags
    rep = {"all": AllPairs(), "centroids": Clusters(3, 2), "grouped": Clusters(3, 2, node_to_node=True)}[kind]
    s = Settings(lin, sizes, strong, out, rep, scaling_ratio=1.5, gravity=0.3, slow_down=2.0, edge_weight_influence=0.5)
    layout = Layout(*graph, s)
    layout.read()
    layout.iterate()
    assigned = centroids = None
    if layout.found:
        assigned = {r.id: r.cid for r in layout.found.assign.collect()}
        centroids = {r.cid: (r.x, r.y, r.mass) for r in layout.found.centroids.collect()}
    got = [(r.x, r.y, r.convergence) for r in layout.state.orderBy("id").collect()]
    for a, b in zip(got, expected(s, assigned, centroids), strict=True):
        assert a == pytest.approx(b, rel=1e-6, abs=1e-6)


@pytest.mark.parametrize(("depth", "ring"), [(3, 1), (3, 4), (6, 1), (6, 2)])
def test_cells_cover_all_others_once(spark, depth, ring):
    g = clustered_graph(spark, 300, 10, 3)
    state = g.nodes.withColumnRenamed("size", "s").selectExpr("id", "x", "y", "1.0D as mass", "s as size")
    assert {r.felt for r in forces.coverage(state, depth, ring).collect()} == {299}


def test_quad_tree_is_near_all_pairs(spark):
    state = clustered_graph(spark, 400, 10, 3).nodes.selectExpr("id", "x", "y", "1.0D as mass", "size")
    a = forces.repulsion_all_pairs(state).orderBy("id").toPandas()
    b = forces.repulsion_quad_tree(state, 6, 2).orderBy("id").toPandas()
    err = np.hypot(a.fx - b.fx, a.fy - b.fy) / np.hypot(a.fx, a.fy)
    assert err.median() < 0.02
    assert abs(a.fx.sum()) < 1e-6 and abs(a.fy.sum()) < 1e-6  # equal and opposite


def test_blocks_give_what_a_broadcast_gives(spark, graph, monkeypatch):
    state, _ = graphs.initial_state(*graph)
    a = forces.repulsion_all_pairs(state).orderBy("id").collect()
    monkeypatch.setattr(storage, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(storage, "BLOCK_ROWS", 4)
    b = forces.repulsion_all_pairs(state).orderBy("id").collect()
    for x, y in zip(a, b, strict=True):
        assert tuple(x) == pytest.approx(tuple(y))


def test_runs(graph):
    seen = []
    run = ForceLayout(*graph, Settings(iterations_per_frame=2, sync_interval=0.0, repulsion=QuadTree(3)), lambda nodes, i: seen.append(i))
    out = run.run()
    assert run.total_iterations() == 2 and not run.is_running() and out.count() == len(NODES) and out.columns == graph[0].columns
    run.start(3)
    run.wait()
    assert run.total_iterations() == 5 and seen[-1] == 5 and run.metrics.iterations == 5 and run.metrics.per_second > 0
    run.start(0)
    assert not run.is_running() and run.total_iterations() == 5
    run.start(-1)
    assert run.is_running()
    run.stop()
    assert not run.is_running() and run.total_iterations() >= 7
    assert run.quad_tree().count()
    for call in (run.kmeans, run.grouped_kmeans):
        with pytest.raises(RuntimeError):
            call()
    run.layout.set(gravity=2.0)
    with pytest.raises(ValueError):
        run.layout.set(debug=True)


def test_cluster_refresh(graph):
    layout = Layout(*graph, Settings(repulsion=Clusters(3, 1, update_interval=2), debug=True))
    layout.read()
    layout.iterate()
    first = layout.found
    layout.iterate()
    assert layout.found is first
    layout.iterate()
    assert layout.found is not first
    with pytest.raises(ValueError, match="Invalid centroidsCount"):
        Layout(*graph, Settings(repulsion=Clusters(99)))
    for bad in (dict(centroids=0), dict(steps=0), dict(update_interval=0)):
        with pytest.raises(ValueError):
            Clusters(**bad)


def test_async_read(spark):
    r = AsyncRead()
    assert r.poll() is None and r.start(spark.range(5)) and not r.start(spark.range(5))
    while (t := r.poll()) is None:
        pass
    assert t.num_rows == 5
    r.cancel()


def test_row_kernel(spark):
    k = RowKernel(lambda b, t, s: pd.DataFrame({"v": b.id * s + len(t["all"])}), "v double", {"all": spark.range(3)}, debug=True, s=2.0)
    assert sorted(r.v for r in k.compute(spark.range(3)).collect()) == [3.0, 5.0, 7.0]
    with pytest.raises(ValueError, match="Size mismatch"):
        k.bind(all=spark.range(4))
    with pytest.raises(ValueError, match="Invalid uniform"):
        RowKernel(lambda b, t: b, "v double", s="text")


def test_sources(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"nodes": [{"key": "a", "attributes": {"x": 1, "y": 2, "size": 3}}, {"key": "b", "attributes": {}}], "edges": [{"source": "a", "target": "b", "attributes": {"weight": 0}}]}))
    g = read_json_graph(spark, str(tmp_path / "g.json"))
    assert g.nodes.count() == 2 and g.edges.first().weight == 1.0
    assert math.isnan(scan_nodes(g.nodes).where("id = 'b'").first().x)
    indexed = graphs.index_nodes(g.nodes, "id2") if "id2" in g.nodes.columns else graphs.index_nodes(g.nodes.withColumnRenamed("id", "key"), "key")
    assert [r.id for r in indexed.orderBy("key").collect()] == [0, 1]
    assert parse_parameters("#lin_log=true&gravity=0.5&iterations_per_frame=3&debug=false", Settings()) == Settings(lin_log=True, gravity=0.5, iterations_per_frame=3)
    one, two = (clustered_graph(spark, 50, 200, 4, 1.0, 9) for _ in range(2))
    assert one.edges.collect() == two.edges.collect() and not one.edges.where("src % 4 != dst % 4").count()


def test_components(spark):
    nodes = spark.createDataFrame([(i,) for i in range(9)], "id long")
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (5, 6, 1.0), (2, 3, 1.0), (8, 8, 1.0)], "src long, dst long, weight double")
    assert {r.id: r.component for r in components(nodes, edges).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5, 6: 5, 7: 7, 8: 8}
    n, e = largest_component(nodes, edges)
    assert sorted(r.id for r in n.collect()) == [0, 1, 2, 3] and e.count() == 3
    assert communities(nodes, edges).count() == 9


def test_empty_graph(spark):
    nodes, edges = spark.createDataFrame([], "id long, x double, y double, size double"), spark.createDataFrame([], "src long, dst long, weight double")
    layout = Layout(nodes, edges)
    layout.read()
    layout.iterate()
    assert layout.state.count() == 0


def test_blocks_of_a_key_give_the_plain_join(spark):
    from lodeplane.plans.storage import within

    left = spark.createDataFrame([(k, k % 3 and k % 7) for k in range(300)], "id long, key long")
    right = spark.createDataFrame([(k, k % 2 and k % 7) for k in range(200)], "oid long, other long")
    got = within(left, right, "key", "other", block=20)
    want = left.join(right, left.key == right.other)
    assert sorted(map(tuple, got.select("id", "key", "oid", "other").collect())) == sorted(map(tuple, want.select("id", "key", "oid", "other").collect()))


def test_fine_levels_are_joined_by_cell(spark, monkeypatch):
    """With no level broadcast, or all, forces are the same; the bound keeps broadcasts to BROADCAST_ROWS rows."""
    from lodeplane.operators import forces
    from lodeplane.plans.storage import BROADCAST_ROWS

    assert forces.coarse_levels(12, 1) < 12 and sum(4 ** (k + 1) * 36 for k in range(forces.coarse_levels(12, 1))) <= BROADCAST_ROWS
    state = spark.createDataFrame([(k, (k * 37 % 101) / 3.0, (k * 53 % 89) / 7.0, 1.0 + k % 3, 0.0) for k in range(200)], "id long, x double, y double, mass double, size double").cache()
    found = []
    for coarse in (0, 3, 6):
        monkeypatch.setattr(forces, "coarse_levels", lambda depth, ring, c=coarse: c)
        found.append({r.id: (round(r.fx, 6), round(r.fy, 6)) for r in forces.repulsion_quad_tree(state, 6).collect()})
        assert forces.coverage(state, 6, 1).where("felt != 199").count() == 0
    assert found[0] == found[1] == found[2]


def test_errors_of_a_run_reach_the_caller(spark):
    import time

    from lodeplane.sources import clustered_graph
    from lodeplane.streaming import ForceLayout

    g = clustered_graph(spark, 20, 40, 2)
    run = ForceLayout(g.nodes, g.edges, Settings(iterations_per_frame=1))
    plain, calls = run.layout.iterate, []

    def failing():
        calls.append(1)
        if len(calls) > 1:
            raise OSError("lost")
        plain()

    run.layout.iterate = failing
    run.start(3)
    with pytest.raises(OSError, match="lost"):
        run.wait()
    assert not run.is_running()
    run.stop()  # the error was told once

    def slow(nodes, i):
        time.sleep(0.2)
        raise KeyError("snapshot")

    shown = ForceLayout(g.nodes, g.edges, Settings(iterations_per_frame=1, sync_interval=0.0), slow)
    with pytest.raises(KeyError, match="snapshot"):
        shown.start(2)
        shown.wait()
    assert not shown.is_running()


def test_accessors_name_the_mode(spark):
    from lodeplane.streaming import ForceLayout

    empty = spark.createDataFrame([], "id long, x double, y double"), spark.createDataFrame([], "src long, dst long, weight double")
    run = ForceLayout(*empty)
    for name, text in (("kmeans", "k-means"), ("grouped_kmeans", "node_to_node"), ("quad_tree", "quad-tree")):
        with pytest.raises(RuntimeError, match=f"not initialized.*{text}"):
            getattr(run, name)()


def test_kernels_are_wired_by_name(spark):
    import pandas as pd

    from lodeplane.operators.kernel import RowKernel, wire

    rows = spark.createDataFrame([(k, float(k)) for k in range(4)], "id long, v double")
    twice = RowKernel(lambda b, t: pd.DataFrame({"id": b.id, "v": b.v * 2}), "id long, v double")
    total = RowKernel(lambda b, t: pd.DataFrame({"id": b.id, "s": b.v + t["twice"].v.sum()}), "id long, s double", {"twice": rows})
    got = wire({"twice": (twice, rows), "total": (total, rows)})["total"]
    assert {r.id: r.s for r in got.collect()} == {k: k + 12.0 for k in range(4)}
    short = RowKernel(total.fn, total.outputs, {"twice": rows.limit(3)})
    with pytest.raises(ValueError, match='Cannot bind output table "twice" from "twice" to "total": Size mismatch'):
        wire({"twice": (twice, rows), "total": (short, rows)})
    shared = RowKernel(total.fn, total.outputs, {"data": rows})
    with pytest.raises(ValueError, match='Cannot bind data table "data" from "a" to "b": Size mismatch'):
        wire({"a": (shared, rows), "b": (RowKernel(total.fn, total.outputs, {"data": rows.limit(2)}), rows)})
    with pytest.raises(ValueError, match="several rows"):
        RowKernel(twice.fn, twice.outputs, lookups={"x": (rows.union(rows), "id")}).compute(rows)


def test_prefix_sums_have_one_shuffle_of_rows(spark):
    from lodeplane.operators.ordering import prefix_sums

    df = spark.createDataFrame([(k * 7919 % 1000, k % 5) for k in range(1000)] + [(None, 3)], "id long, size long")
    got = prefix_sums(df, "id", "size")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Window") >= 1
    plan = got._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning(_part") <= 2 and "rangepartitioning" not in plan
    rows = sorted(got.collect(), key=lambda r: (r.id is not None, r.id))
    run = 0
    for r in rows:
        assert r.offset == run
        run += r.size
    names = prefix_sums(df.selectExpr("lpad(cast(id as string), 4, '0') as id", "size").where("id is not null"), "id", "size")
    assert max(r.offset + r.size for r in names.collect()) == sum(k % 5 for k in range(1000))


def test_kmeans_steps_shuffle_no_points(spark):
    """A step is a map and an aggregate: no exchange or join by a point's id."""
    from lodeplane.operators import clusters

    points = spark.range(500).selectExpr("id", "cast(id * 37 % 101 as double) as x", "cast(id * 53 % 89 as double) as y", "1.0D as mass").cache()
    start = spark.createDataFrame([(k, 20.0 * k, 15.0 * k, 0.0, 0) for k in range(5)], "cid int, x double, y double, mass double, cnt long")
    found = clusters.kmeans(points, 500, 5, 2, start, cut_steps=False)
    plan = found.centroids._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" not in plan and "hashpartitioning(cid" in plan
    assert found.centroids.agg({"cnt": "sum"}).first()[0] == 500
