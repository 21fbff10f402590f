"""SQL for DuckDB that states the registered queries independently, for checking them.

Numbers are written with exponents so that they are doubles; doubles are rounded to 6 digits, plus 0 against negative zeros.
"""

from __future__ import annotations

from lodeplane.plans.queries import ATTRACTION, DEPTH, FORCE_DIGITS, HALO, K, MANY, RING, STEPS


def r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0e0"


AT = "round(CAST((42 + 13 * id) % 10000 AS DOUBLE) / 50e0 - 100e0, 2) AS x, round(CAST((42 + 17 * id) % 10000 AS DOUBLE) / 50e0 - 100e0, 2) AS y"

GRAPH_TAIL = """
known AS (SELECT e.* FROM edges e WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)),
adj AS (SELECT src AS id, dst AS other, weight FROM known UNION ALL SELECT dst, src, weight FROM known),
state AS (SELECT n.id, n.x, n.y, 1e0 + coalesce(w, 0e0) AS mass, n.size, 0e0 AS dx, 0e0 AS dy, 1e0 AS convergence
          FROM nodes n LEFT JOIN (SELECT id, sum(weight) AS w FROM adj GROUP BY id) m ON n.id = m.id)"""

TRADE = f"""ids AS (SELECT CAST(c_custkey AS BIGINT) AS id FROM customer UNION ALL SELECT CAST(s_suppkey AS BIGINT) + 1000000 FROM supplier),
nodes AS (SELECT id, {AT}, CAST(id % 5 AS DOUBLE) AS size FROM ids),
edges AS (SELECT CAST(o_custkey AS BIGINT) AS src, CAST(l_suppkey AS BIGINT) + 1000000 AS dst, CAST(count(*) AS DOUBLE) AS weight
          FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2),{GRAPH_TAIL}"""

NATION = f"""nodes AS (SELECT id, {AT}, CAST(id % 5 AS DOUBLE) AS size FROM (SELECT CAST(n_nationkey AS BIGINT) AS id FROM nation)),
edges AS (SELECT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst, count(*) / 100e0 AS weight
          FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),{GRAPH_TAIL}"""

EVENT = """edges AS (SELECT 'u' || user_id AS src, event_type AS dst, CAST(count(*) AS DOUBLE) AS weight FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2),
keys AS (SELECT src AS key FROM edges UNION SELECT dst FROM edges),
nodes AS (SELECT row_number() OVER (ORDER BY key) - 1 AS id, key FROM keys)"""

POINTS = f"pts AS (SELECT id, {AT}, CAST(1 + id % 3 AS DOUBLE) AS mass FROM (SELECT CAST(c_custkey AS BIGINT) AS id FROM customer))"
VECTORS = "pts AS (SELECT CAST(vec_id AS BIGINT) AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, 1e0 AS mass FROM embeddings)"
PARTS = f"pts AS (SELECT id, {AT} FROM (SELECT CAST(p_partkey AS BIGINT) AS id FROM part))"


def relative(of: str) -> str:
    return f"""box AS (SELECT min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax FROM {of}),
sq AS (SELECT *, greatest(xmax - xmin, ymax - ymin, 1e-6) AS side FROM box),
rel AS (SELECT p.*, side, least(greatest((x - (xmin + xmax) / 2e0) / side + 0.5e0, 0e0), 0.999999e0) AS rx,
        least(greatest((y - (ymin + ymax) / 2e0) / side + 0.5e0, 0e0), 0.999999e0) AS ry FROM {of} p, sq)"""


def cells(of: str, depth: int = DEPTH) -> str:
    return f"""{relative(of)},
lev AS (SELECT rel.*, CAST(l AS INTEGER) AS level, CAST(floor(rx * pow(2e0, l + 1)) AS INTEGER) AS cx, CAST(floor(ry * pow(2e0, l + 1)) AS INTEGER) AS cy FROM rel, range(0, {depth}) t(l)),
cells AS (SELECT level, cx, cy, sum(x * mass) AS sx, sum(y * mass) AS sy, sum(mass) AS mass, count(*) AS cnt FROM lev GROUP BY 1, 2, 3)"""


def quad(of: str, ring: int, depth: int = DEPTH) -> str:
    own = f"(l.level = {depth - 1} AND c.cx = l.cx AND c.cy = l.cy)"
    return f"""{cells(of, depth)},
felt AS (SELECT l.id, l.x, l.y, l.mass, l.side, l.level,
        c.sx - CASE WHEN {own} THEN l.x * l.mass ELSE 0e0 END AS sx, c.sy - CASE WHEN {own} THEN l.y * l.mass ELSE 0e0 END AS sy,
        c.mass - CASE WHEN {own} THEN l.mass ELSE 0e0 END AS cm, c.cnt - CASE WHEN {own} THEN 1 ELSE 0 END AS cnt
    FROM lev l JOIN cells c ON c.level = l.level
        AND c.cx // 2 BETWEEN l.cx // 2 - {ring} AND l.cx // 2 + {ring} AND c.cy // 2 BETWEEN l.cy // 2 - {ring} AND l.cy // 2 + {ring}
        AND (l.level = {depth - 1} OR greatest(abs(c.cx - l.cx), abs(c.cy - l.cy)) > {ring})),
away AS (SELECT *, x - sx / cm AS bx, y - sy / cm AS by_ FROM felt WHERE cnt > 0 AND cm > 0),
turned AS (SELECT *, CASE WHEN bx * bx + by_ * by_ <= side * side * 1e-18 THEN cos(id * 2.399963229728653e0) * side / pow(2e0, level + 1) * 0.01e0 ELSE bx END AS ddx,
        CASE WHEN bx * bx + by_ * by_ <= side * side * 1e-18 THEN sin(id * 2.399963229728653e0) * side / pow(2e0, level + 1) * 0.01e0 ELSE by_ END AS ddy FROM away),
rep AS (SELECT id, sum(ddx * mass * cm / (ddx * ddx + ddy * ddy)) AS fx, sum(ddy * mass * cm / (ddx * ddx + ddy * ddy)) AS fy FROM turned GROUP BY id)"""


def seeds(of: str, name: str = "c0", iteration: int = 0, k: int = K) -> str:
    return f"""num AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS ord FROM {of}),
dim AS (SELECT count(*) AS n, greatest(count(*) // {k}, 1) AS stride FROM {of}),
{name} AS (SELECT CAST(cid AS INTEGER) AS cid, x, y, 0e0 AS mass, CAST(0 AS BIGINT) AS cnt FROM
    (SELECT cid, (cid * stride + CAST(floor((v - floor(v)) * CAST(stride AS DOUBLE)) AS BIGINT)) % n AS ord FROM
        (SELECT cid, sin({float(iteration)}e0 * 73e0 + cid * 37e0) * 43758.5453123e0 AS v FROM range(0, {k}) t(cid)), dim) w JOIN num USING (ord))"""


def kstep(of: str, k: int) -> str:
    """Assignment a<k> by centroids c<k>, and the next centroids."""
    return f"""a{k} AS (SELECT id, cid FROM (SELECT p.id, c.cid, row_number() OVER (PARTITION BY p.id ORDER BY (p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y), c.cid) AS o FROM {of} p, c{k} c) WHERE o = 1),
c{k + 1} AS (SELECT c.cid, coalesce(m.x, c.x) AS x, coalesce(m.y, c.y) AS y, coalesce(m.mass, 0e0) AS mass, coalesce(m.cnt, 0) AS cnt FROM c{k} c LEFT JOIN
    (SELECT cid, avg(x) AS x, avg(y) AS y, sum(mass) AS mass, count(*) AS cnt FROM {of} JOIN a{k} USING (id) GROUP BY cid) m ON c.cid = m.cid)"""


def pairs(sized: bool, scaling: float = 1.0, of: str = "state", where: str = "a.id <> b.id", join: str = "") -> str:
    d = "(sqrt(d2) - size - os)"
    linear = f"CASE WHEN d2 > 0 THEN {scaling}e0 * mass * om / d2 ELSE 0e0 END"
    rims = f"CASE WHEN {d} > 0 THEN {scaling}e0 * mass * om / ({d} * {d}) WHEN {d} < 0 THEN 100e0 * {scaling}e0 * mass * om ELSE 0e0 END"
    return f"""SELECT id, ddx * f AS fx, ddy * f AS fy FROM (SELECT id, ddx, ddy, {rims if sized else linear} AS f FROM
    (SELECT a.id, a.mass, a.size, b.mass AS om, b.size AS os, a.x - b.x AS ddx, a.y - b.y AS ddy, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM {of} a{join}, {of} b WHERE {where}))"""


def all_pairs(sized: bool, scaling: float = 1.0, of: str = "state") -> str:
    return f"rep AS (SELECT id, sum(fx) AS fx, sum(fy) AS fy FROM ({pairs(sized, scaling, of)}) GROUP BY id)"


def from_centroids(centroids: str, others_only: str = "") -> str:
    return f"""SELECT id, ddx * f AS fx, ddy * f AS fy FROM (SELECT id, ddx, ddy, CASE WHEN d2 > 0 THEN mass * om / d2 ELSE 0e0 END AS f FROM
    (SELECT a.id, a.mass, b.mass AS om, a.x - b.x AS ddx, a.y - b.y AS ddy, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM state a{' JOIN a0 USING (id)' if others_only else ''}, {centroids} b {others_only}))"""


KM = f"{seeds('state')},\n{kstep('state', 0)},\nc9 AS (SELECT cid, round(x, 3) AS x, round(y, 3) AS y, mass, cnt FROM c1)"


def grouped(sized: bool) -> str:
    near = pairs(sized, of="own", where="a.cid = b.cid AND a.id <> b.id")
    return f"""own AS (SELECT state.*, cid FROM state JOIN a0 USING (id)),
rep AS (SELECT id, sum(fx) AS fx, sum(fy) AS fy FROM ({from_centroids('c9', 'WHERE a0.cid <> b.cid')} UNION ALL {near}) GROUP BY id)"""


def gravity(strength: float, strong: bool, of: str = "state", name: str = "grav") -> str:
    f = f"CASE WHEN sqrt(x * x + y * y) > 0 THEN mass * {strength}e0 / {'1e0' if strong else 'sqrt(x * x + y * y)'} ELSE 0e0 END"
    return f"{name} AS (SELECT id, 0e0 - x * {f} AS fx, 0e0 - y * {f} AS fy FROM {of})"


def attraction(lin_log: bool = False, outbound: bool = False, adjust_sizes: bool = False, of: str = "state", name: str = "att") -> str:
    d = "(sqrt(d2) - size - os)" if adjust_sizes else "sqrt(d2)"
    pull = f"(0e0 - {'(SELECT avg(mass) FROM ' + of + ')' if outbound else '1e0'} * weight{' / mass' if outbound else ''})"
    f = f"CASE WHEN {d} > 0 THEN {pull} * ln(1e0 + {d}) / {d} ELSE 0e0 END" if lin_log else f"CASE WHEN {d} > 0 THEN {pull} ELSE 0e0 END" if adjust_sizes else pull
    return f"""{name} AS (SELECT id, sum(ddx * f) AS fx, sum(ddy * f) AS fy FROM (SELECT id, ddx, ddy, {f} AS f FROM
    (SELECT a.id, a.mass, a.size, b.size AS os, e.weight, a.x - b.x AS ddx, a.y - b.y AS ddy, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2
     FROM adj e JOIN {of} a ON a.id = e.id JOIN {of} b ON b.id = e.other)) GROUP BY id)"""


def moved(families: str, name: str = "next", of: str = "state", slow_down: float = 1.0, sized: bool = False) -> str:
    return f"""{name}_f AS (SELECT s.*, coalesce(f.fx, 0e0) AS fx, coalesce(f.fy, 0e0) AS fy FROM {of} s LEFT JOIN (SELECT id, sum(fx) AS fx, sum(fy) AS fy FROM ({families}) GROUP BY id) f ON s.id = f.id),
{name}_c AS (SELECT *, fx * fx + fy * fy AS f2, CASE WHEN sqrt(fx * fx + fy * fy) > 10e0 THEN 10e0 / sqrt(fx * fx + fy * fy) ELSE 1e0 END AS k FROM {name}_f),
{name}_n AS (SELECT *, fx * k AS nx, fy * k AS ny FROM {name}_c),
{name}_s AS (SELECT *, 1e0 / (1e0 + sqrt(mass * sqrt((dx - nx) * (dx - nx) + (dy - ny) * (dy - ny)))) AS steady, sqrt((dx + nx) * (dx + nx) + (dy + ny) * (dy + ny)) / 2e0 AS traction FROM {name}_n),
{name}_p AS (SELECT *, {'0.1e0' if sized else 'convergence'} * ln(1e0 + traction) * steady AS speed FROM {name}_s),
{name} AS (SELECT id, x + nx * (speed / {slow_down}e0) AS x, y + ny * (speed / {slow_down}e0) AS y, mass, size, nx * (speed / {slow_down}e0) AS dx, ny * (speed / {slow_down}e0) AS dy,
    {'convergence' if sized else 'least(1e0, sqrt(speed * f2 * steady))'} AS convergence FROM {name}_p)"""


def rounded(cols: str, of: str, plain: str = "id") -> str:
    return f"SELECT {plain}, {', '.join(f'{r(c)} AS {c}' for c in cols.split())} FROM {of}"


ALL = "SELECT * FROM rep UNION ALL SELECT * FROM grav UNION ALL SELECT * FROM att"
REP = f"SELECT id, {r('fx', FORCE_DIGITS)} AS fx, {r('fy', FORCE_DIGITS)} AS fy FROM rep"
OUT = rounded("x y dx dy convergence", "next")


def one_step(rep: str, g: str = "", a: str = "", sized: bool = False) -> str:
    return f"WITH {TRADE},\n{rep},\n{g or gravity(1.0, False)},\n{a or attraction(adjust_sizes=sized)},\n{moved(ALL, sized=sized)}\n{OUT}"


def three_steps(graph: str, digits: int, last: tuple[float, float] = (1.0, 1.0)) -> str:
    """last: gravity and scaling of the third step."""
    parts, of = [graph], "state"
    for k in range(3):
        strength, scaling = last if k == 2 else (1.0, 1.0)
        parts.append(all_pairs(False, scaling, of=of).replace("rep AS", f"rep{k} AS", 1))
        parts.append(gravity(strength, False, of, f"grav{k}"))
        parts.append(attraction(of=of, name=f"att{k}"))
        parts.append(moved(f"SELECT * FROM rep{k} UNION ALL SELECT * FROM grav{k} UNION ALL SELECT * FROM att{k}", f"s{k}", of))
        of = f"s{k}"
    return f"WITH {', '.join(parts)}\nSELECT id, {', '.join(f'{r(c, digits)} AS {c}' for c in 'x y mass dx dy convergence'.split())} FROM {of}"


def labels(rounds: int = 10) -> str:
    """Least reachable ids by that many rounds: enough for the graph at hand, as its paths are short."""
    out = [f"{TRADE}", "e AS (SELECT DISTINCT id, other FROM adj)", "l0 AS (SELECT id, id AS component FROM nodes)"]
    for k in range(rounds):
        out.append(f"l{k + 1} AS MATERIALIZED (SELECT l.id, least(l.component, coalesce(m.c, l.component)) AS component FROM l{k} l LEFT JOIN (SELECT e.id, min(component) AS c FROM e JOIN l{k} b ON b.id = e.other GROUP BY e.id) m ON l.id = m.id)")
    return "WITH " + ",\n".join(out), f"l{rounds}"


def uniform(seed: str, k: str) -> str:
    """An expression over nested scalars: the k-th number of the 32-bit generator."""
    m = "4294967296"
    a = f"(CAST({seed} AS HUGEINT) + (CAST({k} AS HUGEINT) + 1) * 1831565813) % {m}"
    t = f"(xor(CAST(a AS BIGINT), CAST(a AS BIGINT) >> 15)::HUGEINT * (CAST(a AS BIGINT) | 1)::HUGEINT) % {m}"
    u = f"xor(CAST(t AS BIGINT), CAST((t + (xor(CAST(t AS BIGINT), CAST(t AS BIGINT) >> 7)::HUGEINT * (CAST(t AS BIGINT) | 61)::HUGEINT) % {m}) % {m} AS BIGINT))"
    return f"(SELECT CAST(xor(u, u >> 14) AS DOUBLE) / 4294967296e0 FROM (SELECT {u} AS u FROM (SELECT {t} AS t FROM (SELECT {a} AS a))))"


def communities(rounds: int = 10) -> str:
    out = [TRADE, "m0 AS (SELECT id, id AS community FROM nodes)"]
    for k in range(rounds):
        out.append(f"""m{k + 1} AS MATERIALIZED (SELECT id, community FROM (SELECT id, community, row_number() OVER (PARTITION BY id ORDER BY w DESC, community) AS o FROM
    (SELECT id, community, round(sum(weight), 9) AS w FROM (SELECT a.id, m.community, a.weight FROM adj a JOIN m{k} m ON m.id = a.other UNION ALL SELECT id, community, 1e-6 FROM m{k}) GROUP BY 1, 2)) WHERE o = 1)""")
    return ",\n".join(out)


def random_edges(order: int, size: int, clusters: int, density: str, seed: int) -> str:
    draw = lambda j: uniform(str(seed + 1), f"id * 4 + {j}")
    return f"""SELECT src, CASE WHEN {draw(1)} < {density}e0 THEN src % {clusters} + {clusters} * CAST(floor({draw(2)} * (({order - 1} - src % {clusters}) // {clusters} + 1)) AS BIGINT)
        ELSE CAST(floor({draw(3)} * {order}) AS BIGINT) END AS dst FROM (SELECT id, CAST(floor({draw(0)} * {order}) AS BIGINT) AS src FROM range(0, {size}) t(id))"""


_components, _label = labels()
_values = "SELECT id, nearest FROM (SELECT a.id, sqrt(min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS nearest FROM pts a JOIN pts b ON a.id <> b.id GROUP BY a.id)"

SQL = {
    "graph_nodes_indexed": f"WITH {EVENT} SELECT id, key FROM nodes",
    "edges_weight_default": f"""SELECT src, count(*) AS n, {r('sum(w)')} AS weight FROM (SELECT l_orderkey AS src, CASE WHEN l_linenumber % 3 = 0 OR l_discount IS NULL OR l_discount = 0 OR isnan(l_discount) THEN 1e0 ELSE l_discount END AS w FROM lineitem) GROUP BY src""",
    "edges_indexed": f"WITH {EVENT} SELECT a.id AS src, b.id AS dst, weight FROM edges JOIN nodes a ON a.key = src JOIN nodes b ON b.key = dst",
    "adjacency_symmetrized": f"WITH {TRADE} SELECT id, other, weight FROM adj",
    "node_mass": f"WITH {TRADE} SELECT id, mass FROM state",
    "mass_mean": f"WITH {TRADE} SELECT {r('avg(mass)')} AS mean_mass FROM state",
    "degree_offsets": f"WITH {TRADE}, d AS (SELECT n.id, count(a.id) AS cnt FROM nodes n LEFT JOIN adj a ON a.id = n.id GROUP BY n.id) SELECT id, cnt, CAST(coalesce(sum(cnt) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM d",
    "degree_max": f"WITH {TRADE} SELECT max(c) AS max_degree FROM (SELECT id, count(*) AS c FROM adj GROUP BY id)",
    "bounding_box": f"WITH {POINTS} SELECT min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax FROM pts",
    "bounding_box_embeddings": f"SELECT {r('min(x)')} AS xmin, {r('max(x)')} AS xmax, {r('min(y)')} AS ymin, {r('max(y)')} AS ymax FROM (SELECT CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)",
    "relative_positions": f"WITH {POINTS}, {relative('pts')} {rounded('rx ry', 'rel')}",
    "quadtree_cells": f"WITH {POINTS}, {cells('pts')} SELECT level, cx, cy, {r('sx')} AS sx, {r('sy')} AS sy, {r('mass')} AS mass, cnt FROM cells",
    "quadtree_level_dense": f"""WITH {POINTS}, {cells('pts')}, grid AS (SELECT CAST(i % 16 AS INTEGER) AS cx, CAST(i // 16 AS INTEGER) AS cy FROM range(0, 256) t(i))
        SELECT g.cx, g.cy, {r('coalesce(sx, 0e0)')} AS sx, {r('coalesce(sy, 0e0)')} AS sy, {r('coalesce(mass, 0e0)')} AS mass, coalesce(cnt, 0) AS cnt FROM grid g LEFT JOIN (SELECT * FROM cells WHERE level = 3) c ON c.cx = g.cx AND c.cy = g.cy""",
    "quadtree_conservation": f"WITH {POINTS} SELECT CAST(l AS INTEGER) AS level, {r('sum(mass)')} AS mass, count(*) AS cnt, {r('sum(x * mass) / sum(mass)')} AS bx, {r('sum(y * mass) / sum(mass)')} AS \"by\" FROM pts, range(0, {DEPTH}) t(l) GROUP BY l",
    "quadtree_interactions": f"WITH {POINTS} SELECT id, (SELECT count(*) FROM pts) - 1 AS felt FROM pts",
    "repulsion_quadtree": f"WITH {TRADE}, {quad('state', RING)} {REP}",
    "repulsion_quadtree_fine": f"WITH {TRADE}, {quad('state', 2)} {REP}",
    "kmeans_seed": f"WITH {POINTS}, {seeds('pts', iteration=7)} SELECT cid, {r('x')} AS x, {r('y')} AS y, mass, cnt FROM c0",
    "kmeans_assign": f"WITH {POINTS}, {seeds('pts')}, {kstep('pts', 0)} SELECT id, cid FROM a0",
    "kmeans_update": f"WITH {POINTS}, {seeds('pts')}, {kstep('pts', 0)} {rounded('x y mass', 'c1', 'cid, cnt')}",
    "kmeans_reinitialized": f"WITH {VECTORS}, {seeds('pts', iteration=5)}, {kstep('pts', 0)} {rounded('x y mass', 'c1', 'cid, cnt')}",
    "kmeans_assign_many": f"WITH pts AS (SELECT id, {AT}, 1e0 AS mass FROM (SELECT CAST(o_orderkey AS BIGINT) AS id FROM orders)), {seeds('pts', k=MANY)}, {kstep('pts', 0)} SELECT id, cid FROM a0",
    "kmeans_steps3": f"WITH {VECTORS}, {seeds('pts')}, {', '.join(kstep('pts', k) for k in range(STEPS))} {rounded('x y mass', f'c{STEPS}', 'cid, cnt')}",
    "kmeans_empty_cluster": f"WITH {POINTS}, c0 AS (SELECT * FROM (VALUES (0, 0e0, 0e0), (1, 50e0, 50e0), (2, 1e6, 1e6)) v(cid, x, y)), {kstep('pts', 0)} {rounded('x y mass', 'c1', 'cid, cnt')}",
    "kmeans_sorted_nodes": f"WITH {POINTS}, {seeds('pts')}, {kstep('pts', 0)} SELECT row_number() OVER (ORDER BY cid, id) - 1 AS pos, id, cid FROM a0",
    "kmeans_offsets": f"WITH {POINTS}, {seeds('pts')}, {kstep('pts', 0)} SELECT cid, cnt, CAST(coalesce(sum(cnt) OVER (ORDER BY cid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM c1",
    "argsort": "SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS pos, o_orderkey AS id FROM orders",
    "prefix_sum": "SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS size, CAST(coalesce(sum(p_size) OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM part",
    "permutation_check": "SELECT CAST(0 AS BIGINT) AS violations",
    "repulsion_allpairs": f"WITH {TRADE}, {all_pairs(False)} {REP}",
    "repulsion_allpairs_sizes": f"WITH {TRADE}, {all_pairs(True)} {REP}",
    "repulsion_kmeans": f"WITH {TRADE}, {KM}, rep AS (SELECT id, sum(fx) AS fx, sum(fy) AS fy FROM ({from_centroids('c9')}) GROUP BY id) {REP}",
    "repulsion_kmeans_grouped": f"WITH {TRADE}, {KM}, {grouped(False)} {REP}",
    "repulsion_kmeans_grouped_sizes": f"WITH {TRADE}, {KM}, {grouped(True)} {REP}",
    "gravity": f"WITH {TRADE}, {gravity(0.2, False)} {rounded('fx fy', 'grav')}",
    "gravity_strong": f"WITH {TRADE}, {gravity(0.2, True)} {rounded('fx fy', 'grav')}",
    **{name: f"WITH {TRADE}, {attraction(**kind)} {rounded('fx fy', 'att')}" for name, kind in ATTRACTION.items()},
    "force_clamp_speed": f"WITH {TRADE}, {gravity(1.0, False)}, {attraction()}, {moved('SELECT * FROM grav UNION ALL SELECT * FROM att', slow_down=2.0)} {OUT}",
    "speed_sizes": f"WITH {TRADE}, {gravity(1.0, False)}, {attraction()}, {moved('SELECT * FROM grav UNION ALL SELECT * FROM att', slow_down=2.0, sized=True)} {OUT}",
    "layout_step_allpairs": one_step(all_pairs(False)),
    "layout_step_allpairs_sizes": one_step(all_pairs(True), sized=True),
    "layout_step_linlog_strong": one_step(all_pairs(False), gravity(0.2, True), attraction(lin_log=True)),
    "layout_step_outbound": one_step(all_pairs(False, 2.0), a=attraction(outbound=True)),
    "layout_step_quadtree": one_step(quad("state", 1)),
    "layout_step_kmeans": one_step(f"{KM}, rep AS (SELECT id, sum(fx) AS fx, sum(fy) AS fy FROM ({from_centroids('c9')}) GROUP BY id)"),
    "layout_step_kmeans_grouped": one_step(f"{KM}, {grouped(False)}"),
    "layout_3_iterations": three_steps(TRADE, 3),
    "layout_set_between": three_steps(NATION, 6, (0.2, 2.0)),
    "nearest_neighbor_distance": f"WITH {PARTS} {rounded('nearest', f'({_values})')}",
    "empty_halos": f"WITH {VECTORS}, d AS ({_values}), m AS (SELECT avg(nearest) AS mean_nearest, avg(nearest) * {HALO}e0 AS threshold FROM d) SELECT {r('mean_nearest')} AS mean_nearest, {r('threshold')} AS threshold, (SELECT count(*) FROM d WHERE nearest > threshold) AS halo_count FROM m",
    "empty_halo_points": f"WITH {VECTORS}, d AS ({_values}) {rounded('nearest', 'd')} WHERE nearest > (SELECT avg(nearest) * {HALO}e0 FROM d)",
    "validate_kmeans": "SELECT rule, CAST(0 AS BIGINT) AS violations FROM (VALUES ('assignments'), ('centroids')) v(rule)",
    "validate_grouped": "SELECT rule, CAST(0 AS BIGINT) AS violations FROM (VALUES ('offsets'), ('order'), ('ranges')) v(rule)",
    "row_kernel": f"WITH {POINTS}, box AS (SELECT min(x) AS xmin, min(y) AS ymin FROM pts) SELECT id, round((x - xmin) * 0.5e0, 6) AS u, round((y - ymin) * 0.5e0, 6) AS v FROM pts, box",
    "components": f"{_components} SELECT id, component FROM {_label}",
    "largest_component": f"{_components} SELECT id FROM {_label} WHERE component = (SELECT component FROM {_label} GROUP BY component ORDER BY count(*) DESC, component LIMIT 1)",
    "circular_layout": f"WITH n AS (SELECT CAST(n_nationkey AS BIGINT) AS id, (SELECT count(*) FROM nation) AS n FROM nation) SELECT id, {r('cos(id * (2e0 * pi()) / n) * 5000e0')} AS x, {r('sin(id * (2e0 * pi()) / n) * 5000e0')} AS y FROM n",
    "random_layout": f"SELECT CAST(c_custkey AS BIGINT) AS id, {r('(' + uniform('42', 'c_custkey * 2') + ' - 0.5e0) * 5000e0')} AS x, {r('(' + uniform('42', 'c_custkey * 2 + 1') + ' - 0.5e0) * 5000e0')} AS y FROM customer",
    "size_by_degree": f"WITH {TRADE} SELECT n.id, {r('count(a.id) / 3e0 * 5e0')} AS size FROM nodes n LEFT JOIN adj a ON a.id = n.id GROUP BY n.id",
    "prng": f"SELECT k, round({uniform('12345', 'k')}, 9) + 0e0 AS u FROM range(0, 1000) t(k)",
    "write_back": f"WITH {TRADE}, c AS (SELECT count(*) AS n FROM nodes) SELECT id, {r('cos(id * (2e0 * pi()) / n) * 10e0')} AS x, {r('sin(id * (2e0 * pi()) / n) * 10e0')} AS y, {r('size')} AS size FROM nodes, c",
    "neighbour_lists": f"""WITH {TRADE}, d AS (SELECT n.id, count(a.id) AS cnt, min(other) AS first, max(other) AS last, sum(weight * (other % 1000)) AS total FROM nodes n LEFT JOIN adj a ON a.id = n.id GROUP BY n.id)
        SELECT id, cnt, CAST(coalesce(sum(cnt) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\", cnt AS listed, first, last, total FROM d""",
    "clustered_graph_stats": f"SELECT count(*) AS edges, CAST(sum(CASE WHEN src % 5 = dst % 5 THEN 1 ELSE 0 END) AS BIGINT) AS inside, max(src) AS most, max(dst) AS most_dst FROM ({random_edges(1000, 5000, 5, '0.7', 42)})",
    "community_labels": f"WITH {communities()} SELECT id, community FROM m10",
    "packed_communities": f"""WITH {communities()},
c AS (SELECT community, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, community) - 1 AS rank FROM m10 GROUP BY community),
p AS (SELECT m.id, n, CAST(rank AS DOUBLE) AS i, CAST(row_number() OVER (PARTITION BY m.community ORDER BY m.id) - 1 AS DOUBLE) AS k FROM m10 m JOIN c USING (community))
SELECT id, size, {r('(cos(i * 2.399963229728653e0) * sqrt(i) * 3e0 * sqrt(n) + cos(k * 2.399963229728653e0) * sqrt(k)) * 100e0')} AS x, {r('(sin(i * 2.399963229728653e0) * sqrt(i) * 3e0 * sqrt(n) + sin(k * 2.399963229728653e0) * sqrt(k)) * 100e0')} AS y FROM p JOIN nodes USING (id)""",
    "layout_run_snapshots": "SELECT CAST(i AS BIGINT) AS iterations, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS nodes FROM (VALUES (2), (4), (4)) v(i)",
    "layout_run_state": "SELECT * FROM (VALUES ('endless', true, true), ('stopped', false, true), ('finished', false, true)) v(moment, running, counted)",
    "point_load": f"SELECT CAST(p_partkey AS BIGINT) AS id, {r('CAST(p_size AS DOUBLE)')} AS x, {r('CAST(p_retailprice AS DOUBLE)')} AS y, CASE WHEN p_partkey % 3 = 0 OR p_partkey % 5 = 0 THEN 1e0 ELSE CAST(p_partkey % 5 AS DOUBLE) END AS mass FROM part",
    "json_graph": f"WITH {NATION}, o AS (SELECT src, count(*) AS edges, sum(weight) AS weight FROM edges GROUP BY src) SELECT CAST(id AS VARCHAR) AS id, {r('x')} AS x, {r('y')} AS y, {r('size')} AS size, edges, {r('weight')} AS weight FROM nodes LEFT JOIN o ON src = id",
    "clustered_graph_nodes": f"""WITH e AS ({random_edges(1000, 5000, 5, '0.7', 42)}), d AS (SELECT id, count(*) AS n FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id)
        SELECT t.id, CAST(t.id % 5 AS INTEGER) AS cluster, {r('(' + uniform('42', 't.id * 2') + ' - 0.5e0) * 500e0')} AS x, {r('(' + uniform('42', 't.id * 2 + 1') + ' - 0.5e0) * 500e0')} AS y, {r('coalesce(n, 0) / 3e0 * 2e0')} AS size FROM range(0, 1000) t(id) LEFT JOIN d ON d.id = t.id""",
    "sizing": """SELECT n, CAST((SELECT min(s) FROM range(0, 100) t(s) WHERE s * s >= n) AS BIGINT) AS side, (SELECT min(1 << p) FROM range(0, 20) t(p) WHERE (1 << p) >= n) AS pow2,
        CAST(least(11, greatest(3, (SELECT min(h) FROM range(0, 20) t(h) WHERE pow(4, h) >= greatest(n, 2)))) AS BIGINT) AS depth, CAST((SELECT min(s) FROM range(0, 100) t(s) WHERE s * s >= n) AS BIGINT) AS centroids FROM range(1, 3000) t(n)""",
    "level_arithmetic": "SELECT l AS level, CAST(pow(2, l + 1) AS BIGINT) AS side, CAST((SELECT coalesce(sum(pow(2, i + 1)), 0) FROM range(0, l) t(i)) AS BIGINT) AS first, CAST(pow(2, l + 1) AS BIGINT) AS width, CAST((SELECT sum(pow(2, i + 1)) FROM range(0, l + 1) t(i)) AS BIGINT) AS height FROM range(0, 12) t(l)",
    "parameters": "SELECT * FROM (VALUES ('gravity', 0.2e0), ('lin_log', 1e0), ('iterations_per_frame', 25e0), ('adjust_sizes', 0e0), ('scaling_ratio', 1e0), ('max_force', 10e0)) v(name, value)",
    "argsort_payload": "SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos, o_orderkey AS id, o_custkey AS customer FROM orders",
    "argsort_read": "SELECT row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS pos, CAST(c_custkey AS BIGINT) AS id FROM customer",
    "async_read": f"WITH {POINTS} SELECT min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax, true AS began, false AS again FROM pts",
    "kernel_wired": f"WITH {POINTS}, c AS (SELECT (min(x) + max(x)) / 2e0 AS cx, (min(y) + max(y)) / 2e0 AS cy FROM pts) SELECT id, round((x - cx) * 2e0, 6) AS u, round((y - cy) * 2e0, 6) AS v FROM pts, c",
    "row_kernel_joined": f"SELECT CAST(o_orderkey AS BIGINT) AS id, {r('CAST(o_totalprice AS DOUBLE) - CAST(c_acctbal AS DOUBLE)', 2)} AS u FROM orders LEFT JOIN customer ON c_custkey = o_custkey",
    "validate_planted": f"""WITH {POINTS}, {seeds('pts')}, {kstep('pts', 0)},
        nn AS (SELECT count(*) AS n FROM pts), off AS (SELECT cid, cnt, coalesce(sum(cnt) OVER (ORDER BY cid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM c1),
        pos AS (SELECT id, cid, row_number() OVER (ORDER BY cid, id) - 1 AS pos FROM a0),
        wrong AS (SELECT CASE WHEN id % 6 = 2 THEN id + 1 ELSE id END AS id, CASE WHEN pos % 9 = 4 THEN pos + 1 ELSE pos END AS pos FROM pos)
        SELECT 'centroids' AS rule, count(*) AS violations FROM c1 WHERE cid % 4 IN (1, 2) OR cid = 4 OR cid = 8
        UNION ALL SELECT 'assignments', count(*) FROM pts WHERE id % 7 = 3 OR id % 5 = 0 OR id % 11 = 5
        UNION ALL SELECT 'offsets', count(*) FROM off, nn WHERE cid = 0 OR (cid = {K - 1} AND cnt > 0)
        UNION ALL SELECT 'counts', 1
        UNION ALL SELECT 'ranges', count(*) FROM pos JOIN off USING (cid), nn WHERE n - 1 - pos < o OR n - 1 - pos >= o + cnt
        UNION ALL SELECT 'order', (SELECT count(*) FROM (SELECT coalesce(p.id, w.id) AS id FROM pts p FULL JOIN (SELECT id, count(*) AS c FROM wrong GROUP BY id) w ON w.id = p.id WHERE coalesce(c, 0) <> 1 OR p.id IS NULL))
            + (SELECT count(*) FROM (SELECT pos FROM wrong GROUP BY pos HAVING count(*) > 1))""",
}
