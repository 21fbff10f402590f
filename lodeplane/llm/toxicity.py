"""Toxicity by a weighted lexicon.

Text is folded (case, look-alike letters, digits and signs that stand for letters), an Aho-Corasick automaton finds all
lexicon words in one pass, hits inside exception phrases do not count, and the weighted sum is normalised by length.
The lexicon, its weights, the exception phrases and the calibration are learned from labelled rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeplane.llm.common import id_sample, map_texts, scratch, written

# Letters of other scripts that look like Latin ones, and digits and signs used for letters.
HOMOGLYPHS = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ј": "j", "к": "k", "м": "m", "т": "t", "н": "h", "в": "b", "ԁ": "d", "ɡ": "g", "ո": "n", "ս": "u", "α": "a", "ο": "o", "ε": "e", "ι": "i", "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "κ": "k", "χ": "x", "ı": "i", "ⅼ": "l", "ł": "l", "ø": "o"}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l"}

WORD = re.compile(r"[^\W_]+")
#: A run that may hold a disguised word: letters with digits or signs among them. A sign counts only before a letter or digit.
DISGUISED = re.compile(r"(?:[^\W_]|[@$!|](?=[^\W_]))+")
SIGNS = re.compile(r"[@$!|]")
INVISIBLE = re.compile("[­​-‏⁠﻿]")
_LOOKS = str.maketrans(HOMOGLYPHS)
_SUBS = str.maketrans(SUBSTITUTES)


@dataclass(frozen=True)
class Settings:
    #: Labelled rows that the lexicon is fitted on, at most: the ones of smallest hashed id.
    sample_rows: int = 20_000
    #: Lexicon entries, at most.
    lexicon_size: int = 2_000
    #: A word enters with so many different neighbourhoods in toxic rows, and so many times their share in the others.
    least_contexts: int = 5
    least_ratio: float = 12.0
    threshold: float = 0.3


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: set[str] = field(default_factory=set)
    #: Of the logistic curve over the normalised sum, and the score of a text without a hit.
    slope: float = 4.0
    offset: float = -2.0
    base: float = 0.02


def fold(text: str) -> str:
    """Lower case without invisible signs, look-alikes as Latin letters, and disguised words with letters for digits.

    A run with digits or signs is folded only if it has a letter too, so plain numbers stay numbers. A run with signs is
    given both folded and cut at the signs, as in `id!ot` and `that!idiot`.
    """
    text = INVISIBLE.sub("", text).lower().translate(_LOOKS)

    def letters(m: re.Match) -> str:
        run = m.group()
        if run.isalpha() or not any(c.isalpha() for c in run):
            return run
        # a sign may stand for a letter or between two words: both readings
        parts = SIGNS.sub(" ", run)
        return run.translate(_SUBS) if parts == run else f"{run.translate(_SUBS)} {parts}"

    return DISGUISED.sub(letters, text)


def automaton(lexicon: Lexicon) -> ahocorasick.Automaton:
    """All lexicon words and exception phrases, each between single spaces."""
    a = ahocorasick.Automaton()
    for w, x in lexicon.weights.items():
        a.add_word(f" {w} ", (len(w), x))
    for p in lexicon.exceptions:
        a.add_word(f" {p} ", (len(p), None))
    if len(a):
        a.make_automaton()
    return a


def counted(hits: list[tuple[int, int, float]], spared: list[tuple[int, int]]) -> list[float]:
    """Weights of the hits (start, end, weight) that lie in no spared stretch (start, end): one sweep over both, sorted."""
    out, reach, k = [], -1, 0
    spared = sorted(spared)
    for start, end, weight in sorted(hits):
        while k < len(spared) and spared[k][0] <= start:
            reach = max(reach, spared[k][1])
            k += 1
        if end > reach:
            out.append(weight)
    return out


def strength(text: str, a: ahocorasick.Automaton) -> tuple[float, int, int]:
    """Weighted sum of hits outside exception phrases over a mild power of the length; hits; words."""
    return strength_of(WORD.findall(fold(text)), a)


def strength_of(words: list[str], a: ahocorasick.Automaton) -> tuple[float, int, int]:
    """The same of folded words. Time is in proportion to the words and the matches, these sorted."""
    if not words or not len(a):
        return 0.0, 0, len(words)
    line = f" {' '.join(words)} "
    hits, spared = [], []
    for end, (n, weight) in a.iter(line):
        if weight is None:
            spared.append((end - n, end))
        else:
            hits.append((end - n, end, weight))
    weights = counted(hits, spared)
    return math.fsum(weights) / (1 + math.log10(1 + len(words) / 100)), len(weights), len(words)


def fit(labelled: DataFrame, text_col: str, label_col: str, settings: Settings = Settings()) -> Lexicon:
    """labelled: at most settings.sample_rows rows of text and 0/1 label.

    A word counts once per neighbourhood (word before, word, word after), not once per row, so the words of one text
    that has thousands of copies get no weight from the copies. Rows without a label or text, and an empty sample, teach
    nothing.
    """
    with scratch(labelled.sparkSession):
        return _fit(labelled, text_col, label_col, settings)


def _fit(labelled: DataFrame, text_col: str, label_col: str, settings: Settings) -> Lexicon:
    rows = labelled.select(F.col(text_col).alias("_text"), F.col(label_col).cast("double").alias("_y")).where("_text is not null and _y is not null")
    # folded once, for the three passes that follow: one string of words between single spaces
    rows = written(map_texts(rows, ["_y"], F.col("_text"), lambda: lambda texts: [[" ".join(WORD.findall(fold(t))) for t in texts]], "text string").withColumnRenamed("_y", "y"), "folded")

    a, b = F.sum(F.col("n") * F.col("toxic").cast("int")), F.sum(F.col("n") * (~F.col("toxic")).cast("int"))

    def ratio(n1: int, n0: int):
        return ((F.col("a") + 0.5) / (n1 + 1)) / ((F.col("b") + 0.5) / (n0 + 1))

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter = Counter()
        for pdf in batches:
            for t, y in zip(pdf.text, pdf.y):
                c[("", y > 0)] += 1
                c.update((w, y > 0) for w in set(t.split()) if not w.isdigit())
        yield pd.DataFrame([(*k, v) for k, v in c.items()], columns=["word", "toxic", "n"])

    per_word = rows.mapInPandas(words, "word string, toxic boolean, n long").groupBy("word").agg(a.alias("a"), b.alias("b"))
    n1, n0 = (per_word.where("word = ''").select(F.sum("a"), F.sum("b")).first() or (0, 0))
    if not n1:
        return Lexicon()
    likely = (
        per_word.where("word != ''").where("a >= 2").withColumn("r", ratio(n1, n0 or 0)).where(F.col("r") >= settings.least_ratio / 4)
        .orderBy(F.desc(F.col("a") * F.log("r")), "word").limit(5 * settings.lexicon_size).collect()
    )
    likely = frozenset(r.word for r in likely)

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, size = set(), Counter()
            for t, y in zip(pdf.text, pdf.y):
                w = ["", *t.split(), ""]
                size[y > 0] += len(w) - 2
                out.update((w[i], w[i - 1], w[i + 1], y > 0, 1) for i in range(1, len(w) - 1) if w[i] in likely)
            yield pd.DataFrame([*out, *(("", "", "", k, v) for k, v in size.items())], columns=["word", "before", "after", "toxic", "n"])

    made = written(rows.mapInPandas(contexts, "word string, before string, after string, toxic boolean, n long"), "contexts")
    size = {r.toxic: r.n for r in made.where("word = ''").groupBy("toxic").agg(F.sum("n").alias("n")).collect()}
    seen = made.where("word != ''").distinct()
    found = (
        seen.groupBy("word").agg(a.alias("a"), b.alias("b"))
        .where(F.col("a") >= settings.least_contexts).withColumn("r", ratio(size.get(True, 0), size.get(False, 0))).where(F.col("r") >= settings.least_ratio)
        .orderBy(F.desc(F.col("a") * F.log("r")), "word").limit(settings.lexicon_size).collect()
    )
    # A word that stands in other rows' phrases as often as in toxic ones by its neighbours: those two-word phrases are spared.
    weights = {r.word: math.log(r.r) for r in found}
    pairs = (
        seen.where(F.col("word").isin(list(weights)) if weights else F.lit(False))
        .select("toxic", "n", F.explode(F.array(F.concat_ws(" ", "before", "word"), F.concat_ws(" ", "word", "after"))).alias("phrase"))
        .groupBy("phrase").agg(a.alias("a"), b.alias("b")).where("b >= 3 and a = 0").orderBy(F.desc("b"), "phrase").limit(settings.lexicon_size).collect()
    )
    lexicon = Lexicon(weights, {r.phrase.strip() for r in pairs if " " in r.phrase.strip()})

    def strengths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        auto = automaton(lexicon)
        for pdf in batches:
            c = Counter()
            for t, y in zip(pdf.text, pdf.y):
                c[(min(40.0, round(strength_of(t.split(), auto)[0], 1)), y > 0)] += 1
            yield pd.DataFrame([(*k, v) for k, v in c.items()], columns=["s", "toxic", "n"])

    bins = rows.mapInPandas(strengths, "s double, toxic boolean, n long").groupBy("s", "toxic").agg(F.sum("n").alias("n")).collect()
    return calibrated(lexicon, [(r.s, r.toxic, r.n) for r in bins])


def calibrated(lexicon: Lexicon, bins: list[tuple[float, bool, int]]) -> Lexicon:
    """Logistic regression over the normalised sums of rows with hits; the plain share for rows without."""
    none = [(t, n) for s, t, n in bins if s <= 0]
    lexicon.base = min(0.25, (sum(n for t, n in none if t) + 0.5) / (sum(n for _, n in none) + 1))
    x = np.array([s for s, _, _ in bins if s > 0])
    if len(x):
        y = np.array([t for s, t, _ in bins if s > 0], float)
        w = np.array([n for s, _, n in bins if s > 0], float)
        feats, beta = np.stack([np.ones_like(x), np.log1p(x)], 1), np.zeros(2)
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(feats @ beta, -30, 30)))
            hess = feats.T @ (feats * (w * p * (1 - p))[:, None]) + 0.5 * np.eye(2)
            beta += np.linalg.solve(hess, feats.T @ (w * (y - p)) - 0.5 * beta)
        if beta[1] > 0:
            lexicon.offset, lexicon.slope = map(float, beta)
    return lexicon


def _probability(lexicon: Lexicon, s: float) -> float:
    return 1 / (1 + math.exp(-(lexicon.offset + lexicon.slope * math.log1p(s)))) if s > 0 else lexicon.base


def score(df: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """id_col, score, predicted, n_hits for each row; whole texts; nothing but the text is looked at.

    Null and empty texts, and texts without a word, get the score of a text without a hit. Very long texts cost time in
    proportion to their length. Repeated rows, and rows without an id, are scored each; an empty table gives no rows. Other
    columns are ignored. The lexicon is bounded by settings.lexicon_size.
    """

    def task():
        a = automaton(lexicon)

        def run(texts: list) -> list:
            found = [strength(t or "", a) for t in texts]
            p = [_probability(lexicon, x) for x, *_ in found]
            return [p, [int(x >= settings.threshold) for x in p], [k for _, k, _ in found]]

        return run

    return map_texts(df, [id_col], F.col(text_col), task, "score double, predicted int, n_hits long")


def fit_on(docs: DataFrame, labels: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", settings: Settings = Settings()) -> Lexicon:
    """Fits on a bounded sample of the labelled rows for whose id `train` (a condition) holds."""
    chosen = id_sample(labels.where(train).where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("_lid"), F.col(label_col).alias("_y")), "_lid", settings.sample_rows)
    sample = docs.select(F.col(id_col).alias("_lid"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_lid")  # sample_rows rows of 12 bytes
    return fit(sample, "_text", "_y", settings)


def drop_toxic(df: DataFrame, lexicon: Lexicon, text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The rows of df that score below the threshold, with all columns, in one pass without a shuffle.

    Null and empty texts, and texts without a word, stay where a text without a hit does (its score is at most 0.25).
    Repeated rows, equal scores and rows without an id are decided each by their own text; a score at the threshold goes.
    An empty table gives no rows. Other columns go through as they are.
    """

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(lexicon)
        for batch in batches:
            s = [strength(t or "", a)[0] for t in batch.column(text_col).to_pylist()]
            yield batch.filter(pa.array([_probability(lexicon, x) < settings.threshold for x in s], pa.bool_()))

    return df.mapInArrow(kept, df.schema)
