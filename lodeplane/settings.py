"""Settings of the layout and their checks."""

from __future__ import annotations

import math
from dataclasses import dataclass, field


@dataclass(frozen=True)
class AllPairs:
    """Exact repulsion between all nodes."""


@dataclass(frozen=True)
class QuadTree:
    """Repulsion from the cells of a grid pyramid. Smaller theta, more cells; depth None: by the number of nodes."""

    depth: int | None = None
    theta: float = 1.0

    def __post_init__(self) -> None:
        if self.depth is not None and (int(self.depth) != self.depth or not 1 <= self.depth <= 12):
            raise ValueError(f"Invalid depth: {self.depth}. Must be a whole number from 1 to 12.")
        if not 0.25 <= self.theta <= 1:
            raise ValueError(f"Invalid theta: {self.theta}. Must be from 0.25 to 1.")

    @property
    def ring(self) -> int:
        return max(1, math.ceil(1 / self.theta))


@dataclass(frozen=True)
class Clusters:
    """Repulsion from k-means centroids; with node_to_node, also between the nodes of a cluster."""

    centroids: int | None = None
    steps: int = 3
    reset_centroids: bool = False
    node_to_node: bool = False
    update_interval: int = 1
    #: Each refresh starts again from the first seeds.
    restart_from_seed: bool = False

    def __post_init__(self) -> None:
        if self.centroids is not None and self.centroids < 1:
            raise ValueError(f"Invalid centroids: {self.centroids}. Must be 1 or more.")
        if self.steps < 1:
            raise ValueError(f"Invalid steps: {self.steps}. Must be 1 or more.")
        if self.update_interval < 1:
            raise ValueError(f"Invalid update_interval: {self.update_interval}. Must be 1 or more.")


@dataclass(frozen=True)
class Settings:
    lin_log: bool = False
    adjust_sizes: bool = False
    strong_gravity: bool = False
    outbound_attraction: bool = False
    repulsion: AllPairs | QuadTree | Clusters = field(default_factory=AllPairs)
    edge_weight_influence: float = 1.0
    scaling_ratio: float = 1.0
    gravity: float = 1.0
    slow_down: float = 1.0
    max_force: float = 10.0
    iterations_per_frame: int = 10
    #: Seconds between snapshots.
    sync_interval: float = 0.2
    debug: bool = False


def default_depth(n: int) -> int:
    """Levels of the pyramid for n points: 3 to 11."""
    return min(11, max(3, math.ceil(math.log2(max(n, 2)) / 2)))


def default_centroids(n: int) -> int:
    return max(1, math.ceil(math.sqrt(n)))


def check_centroids(k: int, n: int) -> None:
    if k <= 0:
        raise ValueError(f"Invalid centroidsCount: {k}. Must be greater than 0.")
    if k > n:
        raise ValueError(f"Invalid centroidsCount: {k}. Cannot have more centroids than nodes ({n}).")
