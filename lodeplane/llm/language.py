"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeplane.llm.common import id_sample, map_texts, parts


@dataclass(frozen=True)
class Settings:
    #: Labelled rows that the model is fitted on, at most: the ones of smallest hashed id.
    sample_rows: int = 20_000
    #: Languages, at most: the most frequent of the sample.
    languages: int = 200
    grams: tuple[int, ...] = (1, 2, 3)
    bits: int = 15
    alpha: float = 0.5
    #: The tasks that count the sample, each sending one matrix of languages x 2^bits counts.
    tasks: int = 8


@dataclass
class Model:
    languages: list[str]
    #: Log-probabilities, 2^bits rows of one column per language: bounded by the settings, so safe to broadcast.
    table: np.ndarray
    prior: np.ndarray


@cache
def letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space for what is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and (x := chr(c)).isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def hashed(texts: list[str], settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams, the text each belongs to, and whether each text has a letter.

    Runs of other signs count as one space; each text has a space before and after, and no n-gram crosses texts.
    """
    raw = [np.frombuffer(f" {t} ".encode("utf-32-le", "replace"), np.uint32) for t in texts]
    of = np.repeat(np.arange(len(texts)), [len(x) for x in raw])
    c = letters()[np.concatenate(raw)]
    first = np.r_[True, of[1:] != of[:-1]]
    keep = (c != 32) | first | np.r_[True, c[:-1] != 32]
    c, of = c[keep].astype(np.uint64), of[keep]
    some = np.bincount(of[c != 32], minlength=len(texts)) > 0
    at, whose, h = [], [], np.zeros(len(c), np.uint64)
    for n in range(1, max(settings.grams) + 1):
        m = len(c) - n + 1
        if m <= 0:
            break
        h = (h[:m] * np.uint64(0x9E3779B97F4A7C15)) + c[n - 1 :] + np.uint64(n)
        if n in settings.grams:
            ok = of[:m] == of[n - 1 :]
            x = h[ok]
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            at.append((x >> np.uint64(64 - settings.bits)).astype(np.int64))
            whose.append(of[:m][ok])
    return np.concatenate(at), np.concatenate(whose), some


def fit(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", settings: Settings = Settings()) -> Model:
    """Counts the n-grams of a bounded sample of rows with text and language for which `train` holds.

    Null languages teach nothing. Without any labelled row the model has no language and predicts `und`.
    """
    rows = docs.where(train).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    chosen = id_sample(rows.select(F.col(id_col).alias("_lid"), F.col(lang_col).alias("_lang")), "_lid", settings.sample_rows)
    chosen = chosen.groupBy("_lid").agg(F.min("_lang").alias("_lang"))
    per = chosen.groupBy("_lang").count().orderBy(F.desc("count"), "_lang").limit(settings.languages).collect()
    names = sorted(r._lang for r in per)
    if not names:
        return Model([], np.zeros((1 << settings.bits, 0), np.float32), np.zeros(0))
    place = {x: k for k, x in enumerate(names)}
    sample = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_lid"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_lid")  # sample_rows rows of about 12 bytes

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((len(names), 1 << settings.bits)), np.zeros(len(names))
        for pdf in batches:
            pdf = pdf[pdf._lang.isin(place)]
            texts, k = list(pdf._text), pdf._lang.map(place).to_numpy(dtype=np.int64)
            np.add.at(n, k, 1)
            for a, b in parts(texts):
                at, whose, _ = hashed(texts[a:b], settings)
                total += np.bincount(k[a:b][whose] * (1 << settings.bits) + at, minlength=total.size).reshape(total.shape)
        if n.sum():
            yield pd.DataFrame({"counts": [total.tobytes()], "n": [n.tobytes()]})

    found = sample.select("_text", "_lang").repartition(settings.tasks).mapInPandas(count, "counts binary, n binary").collect()
    counts = sum((np.frombuffer(r.counts).reshape(len(names), -1) for r in found), np.zeros((len(names), 1 << settings.bits))) + settings.alpha
    n = sum((np.frombuffer(r.n) for r in found), np.zeros(len(names)))
    return Model(names, np.ascontiguousarray(np.log(counts / counts.sum(1, keepdims=True)).T.astype(np.float32)), np.log((n + 1) / (n + 1).sum()))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """id_col, lang_pred, score for each row, from its whole text alone.

    Null texts and texts without a letter give `und` with score 0. Ties go to the first language by name. Very long
    texts cost time in proportion; a batch is worked in parts of a million characters. Repeated rows, and rows without an
    id, are scored each; an empty table gives no rows. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task():
        m = shared.value

        def run(texts: list) -> list:
            texts, lang, score = [t or "" for t in texts], [], []
            for a, b in parts(texts):
                at, whose, some = hashed(texts[a:b], settings)
                total = np.tile(m.prior, (b - a, 1))
                for k in range(len(m.languages)):
                    total[:, k] += np.bincount(whose, m.table[at, k], minlength=b - a)
                if not m.languages:
                    lang += ["und"] * (b - a)
                    score += [0.0] * (b - a)
                    continue
                p = np.exp(total - total.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                best = total.argmax(1)
                lang += [m.languages[x] if y else "und" for x, y in zip(best, some, strict=True)]
                score += [float(p[i, x]) if some[i] else 0.0 for i, x in enumerate(best)]
            return [lang, score]

        return run

    return map_texts(docs, [id_col], F.col(text_col), task, "lang_pred string, score double")
