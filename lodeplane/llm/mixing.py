"""Mixing documents to target domain weights with soft membership.

A classifier trained on a labelled table gives each document a posterior over domains. Document rates, at least zero, are
then fitted so that the expected tokens of each domain (rate x tokens x posterior, summed over documents) meet the targets:
least squares by projected gradient steps, with residuals weighted by the inverse of the domains' overlap, so that soft
posteriors converge as quickly as hard ones. A step needs the domain totals and overlaps only, and a document's rate follows
from its posterior and the few residuals of the steps so far; so the driver keeps one small vector per step, and rates are
never stored, shuffled or collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeplane.llm.common import id_sample, map_texts, scratch, written
from lodeplane.llm.stats import NAMES, statistics


@dataclass(frozen=True)
class Settings:
    #: Labelled rows that the classifier is fitted on, at most: the ones of smallest hashed id.
    sample_rows: int = 20_000
    ridge: float = 1.0
    #: Step length, steps at most, and the distance of all shares from their targets at which steps end.
    step: float = 0.95
    steps: int = 40
    enough: float = 1e-6
    #: Least overlap that a direction of the domains counts with: where posteriors hardly differ, rates don't run away.
    soft: float = 1e-4
    seed: int = 11


@dataclass
class Model:
    domains: list[str]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        z = np.hstack([np.clip((x - self.mean) / self.scale, -6, 6), np.ones((len(x), 1))]) @ self.weights
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


@dataclass
class Mix:
    """What a document's rate follows from: the weighted residuals of each step. reached: the shares that the rates give."""

    model: Model
    residuals: list[list[float]]
    settings: Settings
    reached: dict[str, float] = field(default_factory=dict)

    def rates(self, p: np.ndarray) -> np.ndarray:
        r = np.ones(len(p))
        for e in self.residuals:
            r = np.maximum(0.0, r - self.settings.step * (p @ np.array(e)))
        return r

    def folded_rate(self, p: str) -> Column:
        """The same as an expression, a fold over the steps, for summing without Python."""
        if not self.residuals:
            return F.lit(1.0)
        steps = F.array(*(F.array(*(F.lit(float(x)) for x in e)) for e in self.residuals))
        s = self.settings

        def step(r: Column, e: Column) -> Column:
            dot = F.aggregate(F.zip_with(F.col(p), e, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
            return F.greatest(F.lit(0.0), r - s.step * dot)

        return F.aggregate(steps, F.lit(1.0), step)


def fit_classifier(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> Model:
    """labelled: (id_col, domain). Softmax regression on document statistics of a bounded sample; rows of null or other domains teach nothing."""
    rows = labelled.select(F.col(id_col).alias("_lid"), F.col("domain").alias("_d")).where(F.col("_d").isin(domains))
    chosen = id_sample(rows, "_lid", s.sample_rows)
    sample = docs.select(F.col(id_col).alias("_lid"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_lid")  # sample_rows rows of about 20 bytes
    got = map_texts(sample, ["_d"], F.col("_text"), lambda: lambda texts: [[statistics(t) for t in texts]], "x array<double>").toArrow()  # sample_rows rows of 24 numbers
    x = got.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
    y = np.array([domains.index(d) for d in got.column("_d").to_pylist()], int)
    order = np.lexsort([*x.T, y])  # the same sums for any order of arrival
    x, y = x[order], y[order]
    mean, scale = (x.mean(0), np.maximum(x.std(0), 1e-3)) if len(x) else (np.zeros(len(NAMES)), np.ones(len(NAMES)))
    model = Model(domains, mean, scale, np.zeros((len(NAMES) + 1, len(domains))))
    if not len(x):
        return model
    z = np.hstack([np.clip((x - mean) / scale, -6, 6), np.ones((len(x), 1))])
    hit = np.eye(len(domains))[y]
    # Boehning's bound of the softmax's curvature: one matrix for all steps
    inverse = np.linalg.inv(0.5 * z.T @ z + s.ridge * np.eye(z.shape[1]))
    for _ in range(200):
        model.weights += inverse @ (z.T @ (hit - model.posteriors(x)) - s.ridge * model.weights)
    return model


def members(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens (words) and p (posterior over the domains) of each row's whole text."""

    def task():
        def run(texts: list) -> list:
            p = model.posteriors(np.array([statistics(t) for t in texts]).reshape(-1, len(NAMES)))
            return [[len((t or "").split()) for t in texts], p.tolist()]

        return run

    return map_texts(docs, [id_col], F.col(text_col), task, "n_tokens long, p array<double>")


def fit_rates(member: DataFrame, model: Model, targets: dict[str, float], s: Settings = Settings()) -> Mix:
    """Steps until the domains' shares of the expected tokens meet the targets (which are normalised to sum 1).

    A table without tokens keeps all rates at 1. A target above what the posteriors allow is met as nearly as the steps came:
    the mix ends with the step of the least distance, and its shares are reported in `reached`.
    """
    goal = np.array([targets[d] for d in model.domains]) / sum(targets.values())
    mix = Mix(model, [], s)
    k = len(goal)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    best, kept = np.inf, 0
    for _ in range(s.steps + 1):
        rows = member.select("n_tokens", "p", mix.folded_rate("p").alias("r"))
        p, n, r = F.col("p"), F.col("n_tokens"), F.col("r")
        # tokens by domain, and the overlap of each two domains over the documents that a step can still lower
        totals = [F.sum(n * p[j] * r).alias(f"d{j}") for j in range(k)] + [F.sum(F.when(r > 0, n * p[i] * p[j]).otherwise(0.0)).alias(f"o{i}_{j}") for i, j in pairs]
        row = rows.agg(F.sum("n_tokens").alias("t"), *totals).first()
        if not row.t:
            break
        share = np.array([row[f"d{j}"] for j in range(k)]) / row.t
        off = float(np.abs(share - goal).max())
        if off < best:
            best, kept = off, len(mix.residuals)
            mix.reached = dict(zip(model.domains, share.tolist(), strict=True))
        if off < s.enough:
            break
        overlap = np.zeros((k, k))
        for i, j in pairs:
            overlap[i, j] = overlap[j, i] = row[f"o{i}_{j}"] / row.t
        e = np.linalg.solve(overlap + s.soft * max(np.trace(overlap), 1e-9) * np.eye(k), share - goal)
        mix.residuals.append([round(x, 12) for x in e.tolist()])
    del mix.residuals[kept:]
    return mix


def chance(key: str, seed: int) -> float:
    return xxhash.xxh64_intdigest(key.encode(), seed) / 2**64


def copies(rate: float, key: str, seed: int) -> int:
    """A whole number of copies whose expectation is the rate: the fraction is decided by a hash of the document's id."""
    return int(rate) + (chance(key, seed) < rate - int(rate))


def fit_mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> tuple[Mix, DataFrame]:
    model = fit_classifier(docs, labelled, sorted(targets), id_col, text_col, s)
    member = written(members(docs, model, id_col, text_col), "members")
    return fit_rates(member, model, targets, s), member


def rated(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """id_col, n_tokens, p_<domain> for each domain, rate and copies of each row.

    Null and empty texts have no tokens and get the rate of their posterior. Repeated rows are rated each; rows of one id
    get one number of copies, those without an id too. Very long texts cost time in proportion to their length. Ties of
    posteriors get one rate. An empty table gives no rows. Other columns are ignored.
    """
    mix, member = fit_mix(docs, labelled, targets, id_col, text_col, s)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.array(batch.column("p").to_pylist(), float).reshape(-1, len(mix.model.domains))
            r = mix.rates(p)
            n = [copies(x, str(i), s.seed) for x, i in zip(r.tolist(), batch.column(id_col).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("n_tokens"), *(pa.array(p[:, k]) for k in range(p.shape[1])), pa.array(r), pa.array(n, pa.int64())], names=names)

    names = [id_col, "n_tokens", *(f"p_{d}" for d in mix.model.domains), "rate", "copies"]
    return member.mapInArrow(run, f"`{id_col}` {id_type}, n_tokens long, {', '.join(f'`p_{d}` double' for d in mix.model.domains)}, rate double, copies long")


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """The rows of docs, each as often as its copies say, with all columns: a second pass over the texts, without a shuffle.

    Null, empty and very long texts, repeated rows, missing ids and empty tables are treated as rated() treats them: copies
    follow from text and id alone. Other columns go through as they are.
    """
    with scratch(docs.sparkSession):
        mix, _ = fit_mix(docs, labelled, targets, id_col, text_col, s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = mix.model.posteriors(np.array([statistics(t) for t in batch.column(text_col).to_pylist()]).reshape(-1, len(NAMES)))
            n = [copies(x, str(i), s.seed) for x, i in zip(mix.rates(p).tolist(), batch.column(id_col).to_pylist(), strict=True)]
            yield batch.take(pa.array(np.repeat(np.arange(len(n)), n), pa.int64()))

    return docs.mapInArrow(run, docs.schema)
