"""Runs of a layout over time: start, stop, snapshots, figures, and reads that don't block."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from lodeplane.operators.graphs import write_back
from lodeplane.operators.points import pyramid
from lodeplane.plans.layout import Layout
from lodeplane.settings import Clusters, QuadTree, Settings, default_depth


@dataclass
class Metrics:
    iterations: int = 0
    seconds: float = 0.0

    @property
    def per_second(self) -> float:
        return self.iterations / self.seconds if self.seconds else 0.0


class AsyncRead:
    """One read of a table at a time, in another thread."""

    def __init__(self) -> None:
        self.pool = ThreadPoolExecutor(1)
        self.job: Future | None = None

    def start(self, df: DataFrame) -> bool:
        """False if a read is under way."""
        if self.job is not None:
            return False
        self.job = self.pool.submit(df.toArrow)
        return True

    def poll(self) -> pa.Table | None:
        """The table once it is there, else None."""
        if self.job is None or not self.job.done():
            return None
        job, self.job = self.job, None
        return job.result()

    def cancel(self) -> None:
        if self.job is not None:
            self.job.cancel()
            self.job = None


class ForceLayout:
    """A force-directed layout that runs for a number of iterations or until it is stopped.

    on_snapshot(nodes, iterations) gets the nodes with their present positions at most every sync_interval seconds, and at
    the end. It runs in a thread of its own, so it doesn't hold up the iterations; while IN_FLIGHT of them wait, the run
    waits for the oldest. start(n) runs the first frame before it returns; with n = -1 the rest runs in a thread until
    stop(). An error in an iteration or a snapshot ends the run and is raised by wait() and stop().
    """

    #: Snapshots that may be under way at a time.
    IN_FLIGHT = 2

    def __init__(self, nodes: DataFrame, edges: DataFrame, settings: Settings = Settings(), on_snapshot: Callable[[DataFrame, int], None] | None = None, output_reducer: Callable[[DataFrame], DataFrame] | None = None) -> None:
        self.layout = Layout(nodes, edges, settings)
        self.settings, self.on_snapshot, self.output_reducer = settings, on_snapshot, output_reducer
        self.metrics = Metrics()
        self._running = False
        self._stop = threading.Event()
        self._thread: threading.Thread | None = None
        self._shown = 0.0
        self._error: BaseException | None = None
        self._pool: ThreadPoolExecutor | None = None
        self._flight: deque[Future] = deque()

    def nodes(self) -> DataFrame:
        """The nodes with the layout's positions, their other attributes untouched."""
        out = write_back(self.layout.nodes, self.layout.state) if self.layout.state is not None else self.layout.nodes
        return self.output_reducer(out) if self.output_reducer else out

    def start(self, iterations: int = -1) -> None:
        self.stop()
        self._stop.clear()
        self.layout.read()
        self._running, self._shown = True, time.monotonic()
        frame = self.settings.iterations_per_frame
        try:
            left = self._frame(frame if iterations < 0 else min(frame, iterations), iterations)
        except BaseException:
            self._running = False
            raise
        if left == 0:
            self._finish()
            self._raise()
        else:
            self._thread = threading.Thread(target=self._run, args=(left,), daemon=True)
            self._thread.start()

    def _frame(self, n: int, left: int) -> int:
        began = time.monotonic()
        done = 0
        while done < n and not self._stop.is_set():
            self.layout.iterate()
            done += 1
        self.metrics.iterations += done
        self.metrics.seconds += time.monotonic() - began
        if self.on_snapshot and time.monotonic() - self._shown >= self.settings.sync_interval:
            self._shown = time.monotonic()
            self._snapshot()
        return left if left < 0 else left - done

    def _snapshot(self) -> None:
        """Hands the present nodes to on_snapshot in the snapshots' thread; waits for the oldest beyond IN_FLIGHT."""
        if self._pool is None:
            self._pool = ThreadPoolExecutor(1)
        while len(self._flight) >= self.IN_FLIGHT:
            self._flight.popleft().result()
        self._flight.append(self._pool.submit(self.on_snapshot, self.nodes(), self.layout.total_iterations))

    def _run(self, left: int) -> None:
        try:
            while left and not self._stop.is_set():
                left = self._frame(self.settings.iterations_per_frame if left < 0 else min(self.settings.iterations_per_frame, left), left)
        except BaseException as e:
            self._error = e
        self._finish()

    def _finish(self) -> None:
        """The last snapshot, unless the run failed; snapshots under way are waited for."""
        if not self._running:
            return
        self._running = False
        try:
            if self.on_snapshot and self._error is None:
                self._snapshot()
            while self._flight:
                self._flight.popleft().result()
        except BaseException as e:
            self._error = self._error or e
        if self._pool is not None:
            self._pool.shutdown()
            self._pool = None
        self._flight.clear()

    def _raise(self) -> None:
        error, self._error = self._error, None
        if error is not None:
            raise error

    def stop(self) -> None:
        """Ends after the iteration under way. Raises what the run failed with."""
        self._stop.set()
        if self._thread is not None and self._thread is not threading.current_thread():
            self._thread.join()
            self._thread = None
        self._finish()
        self._raise()

    def wait(self) -> None:
        """Until a run of a given number of iterations is over. Raises what the run failed with."""
        if self._thread is not None:
            self._thread.join()
            self._thread = None
        self._raise()

    def run(self) -> DataFrame:
        """One frame: iterations_per_frame iterations."""
        self.start(self.settings.iterations_per_frame)
        self.stop()
        return self.nodes()

    def is_running(self) -> bool:
        return self._running

    def total_iterations(self) -> int:
        return self.layout.total_iterations

    def kmeans(self):
        if not isinstance(self.settings.repulsion, Clusters) or self.settings.repulsion.node_to_node:
            raise RuntimeError('k-means is not initialized. Use repulsion type "k-means" to enable it.')
        return self.layout.found

    def grouped_kmeans(self):
        if not isinstance(self.settings.repulsion, Clusters) or not self.settings.repulsion.node_to_node:
            raise RuntimeError('Grouped k-means is not initialized. Use repulsion type "k-means" with node_to_node: True to enable it.')
        return self.layout.found

    def quad_tree(self) -> DataFrame:
        if not isinstance(self.settings.repulsion, QuadTree):
            raise RuntimeError('The quad-tree is not initialized. Use repulsion type "quad-tree" to enable it.')
        return pyramid(self.layout.state, self.settings.repulsion.depth or default_depth(self.layout.context.n))
