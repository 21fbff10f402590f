"""The iterated layout."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from lodeplane.operators import clusters, forces
from lodeplane.operators.diagnostics import bad_assignments, bad_centroids, bad_offsets, bad_ranges, not_a_permutation
from lodeplane.operators.graphs import initial_state, mean_mass
from lodeplane.operators.motion import move
from lodeplane.plans.storage import cut
from lodeplane.settings import AllPairs, Clusters, QuadTree, Settings, check_centroids, default_centroids, default_depth


def validate(points: DataFrame, found: clusters.Clustering, k: int, n: int) -> None:
    """Raises if centroids, assignments or offsets break a rule."""
    order, off = clusters.sorted_points(found.assign), clusters.offsets(clusters.update(points, found.assign, found.centroids))
    for what, rows in (("centroids", bad_centroids(found.centroids, k)), ("assignments", bad_assignments(points, found.assign, k)), ("offsets", bad_offsets(off, n)), ("ranges", bad_ranges(order, off)), ("order", not_a_permutation(points, order))):
        if (bad := rows.limit(5).collect()):
            raise ValueError(f"Invalid {what}: {bad}")


@dataclass
class Context:
    """What does not change between iterations."""

    adj: DataFrame
    n: int
    mean_mass: float


def repulsion(state: DataFrame, settings: Settings, n: int, found: clusters.Clustering | None) -> DataFrame:
    r = settings.repulsion
    if isinstance(r, QuadTree):
        return forces.repulsion_quad_tree(state, r.depth or default_depth(n), r.ring, settings.scaling_ratio)
    if isinstance(r, Clusters):
        if r.node_to_node:
            return forces.repulsion_grouped(state, found.centroids, found.assign, settings.scaling_ratio, settings.adjust_sizes)
        return forces.repulsion_centroids(state, found.centroids, settings.scaling_ratio)
    return forces.repulsion_all_pairs(state, settings.scaling_ratio, settings.adjust_sizes)


def step(state: DataFrame, context: Context, settings: Settings, found: clusters.Clustering | None = None) -> DataFrame:
    """One iteration, from the previous state alone; the plan only, nothing runs. The forces meet in one shuffle."""
    s = settings
    f = forces.total(
        repulsion(state, s, context.n, found),
        forces.gravity(state, s.gravity, s.strong_gravity),
        forces.attraction(state, context.adj, s.lin_log, s.outbound_attraction, s.adjust_sizes, s.edge_weight_influence, context.mean_mass),
    )
    return move(state, f, s.max_force, s.slow_down, s.adjust_sizes)


class Layout:
    """Iterates step() over a graph's nodes(id, x, y, size) and edges(src, dst, weight).

    Each iteration's state is a checkpoint, so lineage stays short and a lost executor costs one iteration.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame, settings: Settings = Settings()) -> None:
        self.nodes, self.edges, self.settings = nodes, edges, settings
        self.total_iterations = 0
        self.found: clusters.Clustering | None = None
        self.state: DataFrame | None = None
        self.context: Context | None = None
        if isinstance(settings.repulsion, Clusters) and settings.repulsion.centroids is not None:
            check_centroids(settings.repulsion.centroids, nodes.count())

    def read(self) -> None:
        """Positions and weights anew; movement starts from rest."""
        state, adj = initial_state(self.nodes, self.edges)
        self.state, adj = cut(state), cut(adj)
        row = self.state.count()
        self.context = Context(adj, row, (mean_mass(self.state).first()[0] or 1.0) if row else 1.0)
        self.found = None

    def k(self) -> int:
        return self.settings.repulsion.centroids or default_centroids(self.context.n)

    def refresh(self) -> None:
        """Clusters anew: from seeds, or warm from the last centroids."""
        r = self.settings.repulsion
        if self.found is not None and self.total_iterations % r.update_interval:
            return
        fresh = self.found is None or r.reset_centroids or r.restart_from_seed
        from lodeplane.operators.ordering import positions

        points = self.state.select("id", "x", "y", "mass")
        ordered = positions(points, "id", name="ord") if fresh else points
        iteration = 0 if r.restart_from_seed else self.total_iterations
        self.found = clusters.kmeans(ordered, self.context.n, self.k(), r.steps, None if fresh else self.found.centroids, iteration, "ord")
        self.found.assign = cut(self.found.assign)
        if self.settings.debug:
            validate(points, self.found, self.k(), self.context.n)

    def iterate(self) -> None:
        if isinstance(self.settings.repulsion, Clusters):
            self.refresh()
        self.state = cut(step(self.state, self.context, self.settings, self.found))
        self.total_iterations += 1

    def set(self, **numbers: float) -> None:
        """Changes settings that may change between iterations."""
        allowed = {"edge_weight_influence", "scaling_ratio", "gravity", "slow_down", "max_force"}
        if set(numbers) - allowed:
            raise ValueError(f"Only {sorted(allowed)} can change during a run")
        self.settings = replace(self.settings, **numbers)


__all__ = ["AllPairs", "Clusters", "Context", "Layout", "QuadTree", "Settings", "repulsion", "step", "validate"]
