"""The building blocks as objects with state: load, compute, read."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lodeplane.operators import clusters, ordering, points
from lodeplane.operators.kernel import RowKernel, wire
from lodeplane.operators.points import level_row, level_side, stack_height, stack_width
from lodeplane.plans.layout import validate
from lodeplane.plans.storage import cut
from lodeplane.settings import QuadTree, check_centroids, default_centroids, default_depth
from lodeplane.sources import load_points
from lodeplane.streaming import AsyncRead, ForceLayout

__all__ = ["ArgSort", "AsyncRead", "Boundaries", "ForceLayout", "GridPyramid", "GroupedKMeans", "KMeans", "RowKernel", "default_depth", "level_row", "level_side", "stack_height", "stack_width", "wire"]


class _Points:
    points: DataFrame | None = None

    def set_nodes(self, nodes: DataFrame | Iterable, spark: SparkSession | None = None) -> None:
        """Points of columns id, x, y and mass (missing: 1), or rows of (x, y) or (x, y, mass), which are numbered."""
        if not isinstance(nodes, DataFrame):
            rows = [(k, float(p[0]), float(p[1]), float(p[2]) if len(p) > 2 and p[2] is not None else None) for k, p in enumerate(nodes)]
            nodes = (spark or SparkSession.active()).createDataFrame(rows, "id long, x double, y double, mass double")
        self.points = load_points(nodes)


class Boundaries(_Points):
    box: DataFrame | None = None

    def compute(self) -> DataFrame:
        self.box = points.bounds(self.points)
        return self.box

    def get(self) -> tuple[float, float, float, float]:
        """(xmin, xmax, ymin, ymax)"""
        return tuple(self.box.first())


class GridPyramid(_Points):
    cells: DataFrame | None = None

    def __init__(self, depth: int | None = None) -> None:
        QuadTree(depth)
        self.depth = depth

    def compute(self) -> DataFrame:
        self.depth = self.depth or default_depth(self.points.count())
        self.cells = cut(points.pyramid(self.points, self.depth))
        return self.cells

    def boundaries(self) -> tuple[float, float, float, float]:
        return tuple(points.bounds(self.points).first())

    def level(self, level: int) -> list[Row]:
        """All cells of a level, row by row: 4^(level + 1) of them, so read coarse ones."""
        return points.dense_level(self.cells, level).orderBy("cy", "cx").collect()


class KMeans(_Points):
    centroids: DataFrame | None = None
    assigned: DataFrame | None = None
    first: DataFrame | None = None

    def __init__(self, count: int | None = None, debug: bool = False) -> None:
        self.count, self.debug = count, debug

    def initialize(self, iteration: int = 0) -> None:
        self.n = self.points.count()
        self.k = default_centroids(self.n) if self.count is None else self.count
        check_centroids(self.k, self.n)
        self.ordered = ordering.positions(self.points, "id", name="ord")
        self.first = self.centroids = cut(clusters.seeds(self.ordered, self.n, self.k, iteration, "ord"))

    def compute(self, steps: int = 1, reinitialize: bool = False, iteration: int = 0) -> DataFrame:
        """steps of (assign, update), from the last centroids or, with reinitialize, from new seeds of this iteration."""
        if self.centroids is None or reinitialize:
            self.initialize(iteration)
        found = clusters.kmeans(self.ordered, self.n, self.k, steps, self.centroids)
        self.centroids, self.assigned = found.centroids, cut(found.assign)
        if self.debug:
            self.validate()
        return self.centroids

    def validate(self) -> None:
        validate(self.points, clusters.Clustering(self.centroids, self.assigned), self.k, self.n)


class GroupedKMeans(KMeans):
    """k-means with the points sorted by cluster and each cluster's range there."""

    offsets: DataFrame | None = None
    sorted: DataFrame | None = None

    def __init__(self, count: int | None = None, debug: bool = False) -> None:
        super().__init__(count or None, debug)  # 0 means the default

    def compute(self, steps: int = 1, reinitialize: bool = False, iteration: int = 0) -> DataFrame:
        super().compute(steps, reinitialize, iteration)
        self.sorted = clusters.sorted_points(self.assigned)
        self.offsets = clusters.offsets(self.centroids)
        return self.offsets

    def debug_view(self, what: str) -> DataFrame:
        if not self.debug:
            raise RuntimeError(f'This method "{what}" is only available in debug mode.')
        return getattr(self, what)


class ArgSort:
    """Ids by ascending key."""

    keys: DataFrame | None = None
    sorted: DataFrame | None = None

    def set_data(self, keys: DataFrame | Sequence[float], too_high: float | None = None, spark: SparkSession | None = None) -> None:
        """A table (id, key), or keys numbered from 0. too_high is not needed, as nothing is padded; greater keys are refused."""
        if not isinstance(keys, DataFrame):
            keys = (spark or SparkSession.active()).createDataFrame([(k, float(v)) for k, v in enumerate(keys)], "id long, key double")
        if too_high is not None and keys.where(F.col("key") > too_high).limit(1).count():
            raise ValueError(f"A key is greater than {too_high}")
        self.keys = keys

    def sort(self) -> DataFrame:
        self.sorted = ordering.argsort(self.keys)
        return self.sorted

    def values(self) -> list:
        return [r.id for r in self.sorted.orderBy("pos").select("id").collect()]
