"""Bounding boxes, the pyramid, sorting and k-means against plain Python."""

import math
import random

import pytest

from lodeplane.api import ArgSort, Boundaries, GridPyramid, GroupedKMeans, KMeans
from lodeplane.functions import grid_side, next_pow2
from lodeplane.operators import clusters, diagnostics
from lodeplane.operators import points as P
from lodeplane.settings import QuadTree, default_depth


def some_points(n, seed, mass=False):
    return [(((seed + 13 * i) % 10000) / 50 - 100, ((seed + 17 * i) % 10000) / 50 - 100, *((1 + i % 3,) if mass else ())) for i in range(n)]


@pytest.mark.parametrize("n", [1, 3, 10, 17, 1000, 5000])
def test_boundaries(spark, n):
    pts = some_points(n, 42)
    b = Boundaries()
    b.set_nodes(pts, spark)
    b.compute()
    xs, ys = [p[0] for p in pts], [p[1] for p in pts]
    assert b.get() == pytest.approx((min(xs), max(xs), min(ys), max(ys)))


def test_boundaries_of_few_and_again(spark):
    b = Boundaries()
    b.set_nodes([(10, 20), (15, 25), (30, 22), (12, 40), (18, 35)], spark)
    b.compute()
    assert b.get() == (10, 30, 20, 40)
    b.set_nodes([(x * 2 + 1000, y * 3 - 500) for x, y in some_points(100, 42)], spark)
    b.compute()
    assert b.get()[0] > 700


def test_boundaries_leave_out_nan(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0), (1, float("nan"), 5.0), (2, None, 3.0)], "id long, x double, y double")
    assert tuple(P.bounds(df).first()) == (1.0, 1.0, 2.0, 5.0)


@pytest.mark.parametrize("n", [10, 1000])
@pytest.mark.parametrize("depth", [1, 3, 5])
def test_pyramid_cell_by_cell(spark, n, depth):
    pts = some_points(n, 42, mass=True)
    tree = GridPyramid(depth)
    tree.set_nodes(pts, spark)
    tree.compute()
    x0, x1, y0, y1 = tree.boundaries()
    side = max(x1 - x0, y1 - y0, 1e-6)
    for level in range(depth):
        g = P.level_side(level)
        want = [[0.0, 0.0, 0.0, 0] for _ in range(g * g)]
        for x, y, m in pts:
            rx, ry = (min(max((v - c) / side + 0.5, 0), 0.999999) for v, c in ((x, (x0 + x1) / 2), (y, (y0 + y1) / 2)))
            c = want[math.floor(ry * g) * g + math.floor(rx * g)]
            c[0] += x * m
            c[1] += y * m
            c[2] += m
            c[3] += 1
        got = [[r.sx, r.sy, r.mass, r.cnt] for r in tree.level(level)]
        for a, b in zip(got, want, strict=True):
            assert a == pytest.approx(b)


def test_sizes_of_levels():
    assert [P.level_side(k) for k in range(3)] == [2, 4, 8]
    assert [P.level_row(k) for k in range(3)] == [0, 2, 6]
    assert (P.stack_width(3), P.stack_height(3)) == (8, 14)
    assert [default_depth(n) for n in (1, 1500, 15000, 10**9)] == [3, 6, 7, 11]
    assert [next_pow2(n) for n in (1, 2, 3, 16, 17)] == [1, 2, 4, 16, 32]
    assert [grid_side(n) for n in (1, 4, 5, 9, 10)] == [1, 2, 3, 3, 4]
    for bad in (0, 13, 2.5):
        with pytest.raises(ValueError):
            QuadTree(bad)
    with pytest.raises(ValueError):
        QuadTree(3, 0.1)


@pytest.mark.parametrize("n", [16, 25, 30, 32, 1000])
def test_argsort(spark, n):
    keys = [(n - i) * 5.0 for i in range(n)]
    s = ArgSort()
    s.set_data(keys, 10 * n, spark)
    s.sort()
    assert s.values() == list(range(n - 1, -1, -1))
    random.Random(n).shuffle(keys)
    s.set_data(keys, spark=spark)
    s.sort()
    assert s.values() == sorted(range(n), key=lambda i: keys[i])
    with pytest.raises(ValueError):
        s.set_data(keys, 1.0, spark)


def groups(n, c, seed=42):
    out = []
    for g in range(c):
        cx, cy = (2 * g / c - 1) * 100, (2 * ((7 * g) % c) / c - 1) * 100
        size = n // c if g < c - 1 else n - (n // c) * (c - 1)
        for i in range(size):
            a, r = ((seed + 100 * g + i) * math.e) % (2 * math.pi), ((seed + 13 * i + 17 * g) % 1000) / 1000 * 5
            out.append((cx + math.cos(a) * r, cy + math.sin(a) * r, g))
    return out


@pytest.mark.parametrize(("n", "c", "steps"), [(10, 2, 1), (10, 3, 2), (1000, 2, 3)])
def test_kmeans_finds_groups(spark, n, c, steps):
    pts = groups(n, c)
    k = KMeans(c, debug=True)
    k.set_nodes([p[:2] for p in pts], spark)
    k.initialize()
    k.compute(steps)
    found = {}
    for r in k.assigned.collect():
        found.setdefault(r.cid, set()).add(r.id)
    want = {}
    for i, p in enumerate(pts):
        want.setdefault(p[2], set()).add(i)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("n", [10, 1000])
def test_single_centroid_is_the_mean(spark, n):
    pts = some_points(n, 123)
    k = KMeans(1)
    k.set_nodes(pts, spark)
    c = k.compute(2).first()
    assert (c.x, c.y) == pytest.approx((sum(p[0] for p in pts) / n, sum(p[1] for p in pts) / n))


def test_as_many_centroids_as_points(spark):
    pts = some_points(10, 456)
    k = KMeans(10)
    k.set_nodes(pts, spark)
    k.compute(1)
    assert sorted((round(r.x, 6), round(r.y, 6)) for r in k.centroids.collect()) == sorted((round(x, 6), round(y, 6)) for x, y in pts)


@pytest.mark.parametrize(("n", "k", "text"), [(5, 10, "Cannot have more centroids than nodes (5)."), (10, 0, "Must be greater than 0."), (10, -5, "Must be greater than 0.")])
def test_bad_counts(spark, n, k, text):
    m = KMeans(k)
    m.set_nodes(some_points(n, 1), spark)
    with pytest.raises(ValueError, match=f"Invalid centroidsCount: {k}. ") as e:
        m.initialize()
    assert text in str(e.value)


def test_grouped(spark):
    k = GroupedKMeans(3, debug=True)
    k.set_nodes([(-20, 0), (-21, 0), (-19, 1), (-20, 2), (0, 0), (1, 0), (0, 1), (1, 1), (2, 0), (20, 0), (21, 0), (20, 1)], spark)
    k.compute(5)
    off = {r.cid: (r.cnt, r.offset) for r in k.offsets.collect()}
    assert sum(c for c, _ in off.values()) == 12 and all(c > 0 for c, _ in off.values())
    order = k.sorted.orderBy("pos").collect()
    assert sorted(r.id for r in order) == list(range(12)) and [r.cid for r in order] == sorted(r.cid for r in order)
    for r in order:
        assert off[r.cid][1] <= r.pos < sum(off[r.cid])
    assert k.debug_view("sorted") is k.sorted
    with pytest.raises(RuntimeError):
        GroupedKMeans(3).debug_view("sorted")
    assert GroupedKMeans(0).count is None


def test_many_centroids_against_plain_python_without_a_shuffle(spark, monkeypatch):
    r = random.Random(9)
    pts = [(i, round(r.uniform(-5, 5), 1), round(r.uniform(-5, 5), 1), 1.0) for i in range(300)] + [(300, float("nan"), 1.0, 1.0), (301, 900.0, -900.0, 1.0)]
    cs = [(k, round(r.uniform(-5, 5), 1), round(r.uniform(-5, 5), 1)) for k in range(600)]
    points, centroids = spark.createDataFrame(pts, "id long, x double, y double, mass double"), spark.createDataFrame(cs, "cid int, x double, y double")
    got = clusters.assign(points, centroids, 600)
    want = {i: min(((x - a) * (x - a) + (y - b) * (y - b), c) for c, a, b in cs)[1] if x == x else 0 for i, x, y, _ in pts}
    assert {r.id: r.cid for r in got.collect()} == want
    # no plan of pairs that are sorted by point: that took disk for all of them
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" not in plan
    monkeypatch.setattr(clusters, "BROADCAST_ROWS", 250)
    assert {r.id: r.cid for r in clusters.assign(points, centroids, 600).collect()} == want


def test_nearest_by_cells_against_plain_python(spark, monkeypatch):
    """Even points, a crowd, far ones, points of one place; and coordinates that are no finite numbers."""
    r = random.Random(5)
    pts = [(r.uniform(-1, 1), r.uniform(-1, 1)) for _ in range(100)] + [(3 + r.uniform(-1, 1) / 100, 5 + r.uniform(-1, 1) / 100) for _ in range(100)] + [(30.0, 30.0), (30.0, 31.0)] + [(7.0, 7.0)] * 3
    want = {i: min(math.sqrt((x - a) * (x - a) + (y - b) * (y - b)) for j, (a, b) in enumerate(pts) if i != j) for i, (x, y) in enumerate(pts)}
    odd = [(900, float("nan"), 0.0), (901, float("inf"), 0.0), (902, None, 0.0)]
    seen = []
    monkeypatch.setattr(diagnostics, "ALL_PAIRS", 10)
    monkeypatch.setattr(diagnostics, "all_pairs", lambda left, right, f=diagnostics.all_pairs: seen.append(left.count()) or f(left, right))
    got = diagnostics.nearest_distances(spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(pts)] + odd, "id long, x double, y double"))
    got = {r.id: r.nearest for r in got.collect()}
    # pairs of all points are never made: only of those outside of the cells
    assert seen and max(seen) <= 2
    assert math.isnan(got.pop(900)) and got.pop(901) == got.pop(902) == math.inf
    assert got == want
