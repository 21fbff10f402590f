"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeplane.llm.common import id_sample, map_texts, written
from lodeplane.llm.stats import NAMES, statistics


@dataclass(frozen=True)
class Settings:
    #: Labelled rows that the model is fitted on, at most: the ones of smallest hashed id.
    sample_rows: int = 20_000
    #: Features that approximate a Gaussian kernel of this width over standardised statistics.
    features: int = 256
    width: float = 3.0
    ridge: float = 1.0
    seed: int = 7
    threshold: float = 0.3
    #: The tasks that sum normal equations, each sending one matrix of (features + 1)^2.
    tasks: int = 8


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    beta: np.ndarray
    #: Isotonic steps: raw scores and the shares of label 1, both ascending.
    at: np.ndarray
    share: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.directions + self.phases
        return np.hstack([np.sqrt(2 / len(self.phases)) * np.cos(z), np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.features(x) @ self.beta, self.at, self.share)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools adjacent violators of (score, share, weight), ascending in x; the ends of each pooled step."""
    steps: list[list[float]] = []  # sum of w*y, sum of w, first x, last x
    for a, b, c in zip(x, y, w, strict=True):
        steps.append([b * c, c, a, a])
        while len(steps) > 1 and steps[-2][0] * steps[-1][1] >= steps[-1][0] * steps[-2][1]:
            s, n, _, last = steps.pop()
            steps[-1][0] += s
            steps[-1][1] += n
            steps[-1][3] = last
    at = np.array([v for s in steps for v in (s[2], s[3])])
    # one pseudo-row of each label keeps the ends off 0 and 1
    return at, np.maximum.accumulate(np.repeat([(s[0] + 0.5) / (s[1] + 1) for s in steps], 2))


def sample_statistics(docs: DataFrame, labels: DataFrame, train, label, settings: Settings, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(x array<double>, y) of a bounded sample of labelled rows for whose id `train` holds, as a written table."""
    rows = labels.where(train).select(F.col(id_col).alias("_lid"), label.alias("_y")).where("_y is not null")
    chosen = id_sample(rows, "_lid", settings.sample_rows)
    sample = docs.select(F.col(id_col).alias("_lid"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_lid")  # sample_rows rows of about 12 bytes
    return written(map_texts(sample, ["_y"], F.col("_text"), lambda: lambda texts: [[statistics(t) for t in texts]], "x array<double>"), "statistics")


def fit(sample: DataFrame, settings: Settings = Settings()) -> Model:
    """sample: _y of 0 or 1 and the statistics x, at most settings.sample_rows rows.

    Tasks sum the normal equations of their rows, the driver adds these matrices of fixed size and solves them. Rows of
    one label only, and an empty sample, give that label's smoothed share as every score.
    """
    d = len(NAMES)
    m = sample.select(*(f(F.col("x")[k]).alias(f"{f.__name__}{k}") for k in range(d) for f in (F.avg, F.stddev_pop))).first()
    mean = np.array([m[f"avg{k}"] or 0.0 for k in range(d)])
    scale = np.maximum([m[f"stddev_pop{k}"] or 0.0 for k in range(d)], 1e-3)
    rng = np.random.default_rng(settings.seed)
    model = Model(mean, scale, rng.normal(size=(d, settings.features)) / settings.width, rng.uniform(0, 2 * np.pi, settings.features), np.zeros(settings.features + 1), np.zeros(1), np.zeros(1))
    spread = sample.repartition(settings.tasks)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = np.zeros((settings.features + 1,) * 2), np.zeros(settings.features + 1)
        for pdf in batches:
            if len(pdf):
                z = model.features(np.stack(pdf.x.to_list()))
                a += z.T @ z
                b += z.T @ pdf._y.to_numpy(dtype=float)
        yield pd.DataFrame({"a": [a.tobytes()], "b": [b.tobytes()]})

    found = spread.mapInPandas(sums, "a binary, b binary").collect()
    a = sum(np.frombuffer(r.a).reshape(settings.features + 1, -1) for r in found)
    b = sum(np.frombuffer(r.b) for r in found)
    model.beta = np.linalg.solve(a + settings.ridge * np.eye(len(a)), b)

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                raw = np.round(np.clip(model.features(np.stack(pdf.x.to_list())) @ model.beta, -1, 2), 3)
                yield pd.DataFrame({"raw": raw, "y": pdf._y.to_numpy(dtype=float)}).groupby("raw").y.agg(["sum", "count"]).reset_index()

    bins = sample.mapInPandas(binned, "raw double, sum double, count double").groupBy("raw").agg(F.sum("sum").alias("s"), F.sum("count").alias("n")).orderBy("raw").collect()  # 3,001 rows at most
    if bins:
        n = np.array([r.n for r in bins])
        model.at, model.share = isotonic(np.array([r.raw for r in bins]), np.array([r.s for r in bins]) / n, n)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """id_col, score, predicted for each row, from the statistics of its whole text alone.

    Null and empty texts have statistics of zero and are scored like any other. Very long texts cost time in proportion to
    their length. Equal statistics give equal scores. Repeated rows, and rows without an id, are scored each; an empty
    table gives no rows. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def task():
        m = shared.value

        def run(texts: list) -> list:
            p = m.score(np.array([statistics(t) for t in texts]).reshape(-1, len(NAMES)))
            return [p, (p >= settings.threshold).astype("int32")]

        return run

    return map_texts(docs, [id_col], F.col(text_col), task, "score double, predicted int")
