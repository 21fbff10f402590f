"""The fitted operators against models worked out by hand: naive Bayes in plain Python, a dense ridge, a naive matcher."""

import collections
import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeplane.llm import common, language, quality, toxicity
from lodeplane.llm.stats import statistics

M = (1 << 64) - 1


def plain_grams(text, s):
    """Buckets of the character n-grams of one text, one at a time."""
    c = [(x.lower() if len(x.lower()) == 1 else x) if x.isalpha() else " " for x in f" {text} "]
    c = [x for i, x in enumerate(c) if x != " " or i == 0 or c[i - 1] != " "]
    out = []
    for n in s.grams:
        for i in range(len(c) - n + 1):
            h = 0
            for j in range(n):
                h = (h * 0x9E3779B97F4A7C15 + ord(c[i + j]) + j + 1) & M
            h = ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9) & M
            out.append(h >> (64 - s.bits))
    return out


def test_language_is_naive_bayes(spark):
    r = random.Random(4)
    words = {"en": "the house and a river was here".split(), "fr": "la maison été une rivière où là".split(), "de": "das haus für der fluß über hier".split()}
    rows = [(i, " ".join(r.choice(words[lang] + ["x1", "ok!", "ABC"]) for _ in range(r.randrange(0, 12))), lang) for i, lang in enumerate(r.choice(list(words)) for _ in range(150))]
    s = language.Settings(bits=12)
    train = [x for x in rows if common_mod(x[0], 4) != 2]
    counts = {k: collections.Counter() for k in words}
    for _, t, lang in train:
        counts[lang].update(plain_grams(t, s))
    prior = {k: math.log((sum(x[2] == k for x in train) + 1) / (len(train) + len(words))) for k in words}
    total = {k: sum(counts[k].values()) + s.alpha * (1 << s.bits) for k in words}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = language.fit(docs, common.crc_mod("doc_id", 4) != 2, settings=s)
    assert model.languages == sorted(words)
    got = {x.doc_id: x for x in language.predict(docs, model, settings=s).collect()}
    for i, t, _ in rows:
        score = {k: prior[k] + sum(math.log((counts[k][g] + s.alpha) / total[k]) for g in plain_grams(t, s)) for k in sorted(words)}
        if not any(x.isalpha() for x in t):
            assert got[i].lang_pred == "und"
            continue
        best = max(score, key=score.get)
        p = 1 / sum(math.exp(v - score[best]) for v in score.values())
        assert abs(got[i].score - p) < 1e-3 and (got[i].lang_pred == best or p < 0.51)


def common_mod(i, n):
    import zlib

    return zlib.crc32(str(i).encode()) % n


def pools(x, y, w):
    """Isotonic means by the min-max formula, and the pools of equal ones."""
    n = len(x)
    mean = lambda a, b: sum(y[i] * w[i] for i in range(a, b)) / sum(w[a:b])
    fit = [max(min(mean(a, b) for b in range(i + 1, n + 1)) for a in range(i + 1)) for i in range(n)]
    out = []
    for i in range(n):
        if i and abs(fit[i] - fit[i - 1]) < 1e-12:
            out[-1].append(i)
        else:
            out.append([i])
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(1, 4)), min_size=1, max_size=12))
def test_isotonic_is_the_min_max_formula(cells):
    y = [min(a, b) / b for a, b in cells]
    w = [float(b) for _, b in cells]
    x = list(np.arange(len(y), dtype=float))
    at, share = quality.isotonic(np.array(x), np.array(y), np.array(w))
    want = [((sum(y[i] * w[i] for i in p) + 0.5) / (sum(w[i] for i in p) + 1), p) for p in pools(x, y, w)]
    run = 0.0
    for s, p in want:
        run = max(run, s)
        for i in p:
            assert abs(np.interp(x[i], at, share) - run) < 1e-9


def test_quality_is_the_dense_ridge(spark):
    r = random.Random(8)
    texts = [" ".join(r.choice(["word", "Other.", "|", "12", "long" * 6, "é!"]) for _ in range(r.randrange(0, 40))) for _ in range(120)]
    marks = [int(t.count("|") < 3) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame(list(enumerate(marks)), "doc_id long, quality int")
    s = quality.Settings(features=48)
    sample = quality.sample_statistics(docs, labels, common.crc_mod("doc_id", 5) != 0, common.F.col("quality").cast("double"), s)
    model = quality.fit(sample, s)
    train = [i for i in range(len(texts)) if common_mod(i, 5) != 0]
    x, y = np.array([statistics(texts[i]) for i in train]), np.array([marks[i] for i in train], float)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = math.sqrt(2 / s.features) * np.cos(np.clip((x - mean) / scale, -6, 6) @ model.directions + model.phases)
    z = np.hstack([z, np.ones((len(z), 1))])
    beta = np.linalg.solve(z.T @ z + s.ridge * np.eye(s.features + 1), z.T @ y)
    assert np.abs(beta - model.beta).max() < 1e-6
    # the features' products approximate the Gaussian kernel of the settings' width
    many = quality.Model(mean, scale, np.random.default_rng(1).normal(size=(x.shape[1], 20_000)) / s.width, np.random.default_rng(2).uniform(0, 2 * np.pi, 20_000), np.zeros(1), np.zeros(1), np.zeros(1))
    f = many.features(x)[:, :-1]
    u = np.clip((x - mean) / scale, -6, 6)
    kernel = np.exp(-((u[:, None] - u[None]) ** 2).sum(-1) / (2 * s.width**2))
    assert np.abs(f @ f.T - kernel).max() < 0.05
    raw = np.round(np.clip(z @ beta, -1, 2), 3)
    bins = sorted(set(raw))
    n = np.array([(raw == b).sum() for b in bins], float)
    at, share = quality.isotonic(np.array(bins), np.array([y[raw == b].mean() for b in bins]), n)
    got = {i: p for i, p in ((q.doc_id, q.score) for q in quality.score(docs, model, settings=s).collect())}
    want = np.interp(z @ beta, at, share)
    assert np.mean([abs(got[i] - w) < 0.02 for i, w in zip(train, want)]) > 0.95


ENTRIES = ["nitwit", "fool", "old fool", "wit"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["nitwit", "fool", "old", "wise", "N1TW1T", "f00l!", "wit", "a", "the"]), max_size=25), st.sets(st.sampled_from(["wise fool", "old", "the nitwit", "fool fool", "old wit a"])))
def test_strength_is_that_of_a_naive_matcher(words, spared):
    text = " ".join(words)
    lexicon = toxicity.Lexicon({w: k + 1.0 for k, w in enumerate(ENTRIES)}, set(spared))
    w = toxicity.WORD.findall(toxicity.fold(text))

    def places(phrase):
        p = phrase.split()
        return [(i, i + len(p)) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]

    free = [s for p in spared for s in places(p)]
    hits = [x for e, x in lexicon.weights.items() for a, b in places(e) if not any(c <= a and b <= d for c, d in free)]
    got, n, size = toxicity.strength(text, toxicity.automaton(lexicon))
    assert n == len(hits) and size == len(w) and abs(got - sum(hits) / (1 + math.log10(1 + len(w) / 100))) < 1e-9


def test_strength_takes_time_in_proportion():
    import time

    a = toxicity.automaton(toxicity.Lexicon({"fool": 1.0}, {"wise fool"}))
    took = []
    for n in (20_000, 200_000):
        t = "fool wise fool " * n
        began = time.perf_counter()
        assert toxicity.strength(t, a)[1] == n
        took.append(time.perf_counter() - began)
    assert took[1] < 30 * took[0] + 1
