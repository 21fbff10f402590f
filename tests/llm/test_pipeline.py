"""The pipeline's stages, each on its own input, and run() against stages in plain Python."""

import collections
import hashlib
import os
import random

import pytest
import tiktoken
from test_operators import SCHEMA, classes_of_all_pairs, prose

import corpus_pipeline
from lodeplane.llm import common, mixing
from lodeplane.llm.queries import TARGETS, domains, vocabulary

STAGE = dict(corpus_pipeline.STAGES)
INSULTS = ["nitwit", "blockhead", "dunce"]


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """A folder with documents and labels: toxic ones, exact copies, edited copies, ids that are null or repeated, odd texts."""
    r = random.Random(12)
    texts = []
    for k in range(360):
        texts.append((prose(20_000 + k, r.randrange(60, 120)), 0))
    for k in range(60):
        w = prose(30_000 + k, 60).split()
        for i in r.sample(range(60), 6):
            w[i] = r.choice(INSULTS)
        texts.append((" ".join(w), 1))
    for k in range(40):  # low quality
        texts.append(("| x | y | " * r.randrange(20, 60) + prose(40_000 + k, 20), 0))
    base = [texts[k][0] for k in range(40)]
    for k, t in enumerate(base):
        if k % 2:
            texts.append((t.upper() if k % 3 else t, 0))
        w = t.split()
        for i in r.sample(range(len(w)), len(w) // 12):
            w[i] = f"edit{r.randrange(10**6)}"
        texts.append((" ".join(w), 0))
    rows = [(i, t, "en", None, len(t), 0.5, True, "x", b"y") for i, (t, _) in enumerate(texts)]
    n = len(rows)
    odd = [(None, prose(50_001, 50)), (None, prose(50_002, 50)), (None, texts[3][0]), (5, prose(50_003, 50)), (5, prose(50_003, 50)), (n, None), (n + 1, ""), (n + 2, "  \n"), (n + 3, prose(50_004, 20_000)), (n + 4, "short one")]
    rows += [(i, t, None, None, None, None, None, None, None) for i, t in odd]
    where = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame(rows, SCHEMA).coalesce(3).write.parquet(f"{where}/documents.parquet")
    marks = [(i, int(not t.startswith("|")), tox) for i, (t, tox) in enumerate(texts)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{where}/labels.parquet")
    return where, {i for i, (_, tox) in enumerate(texts) if tox}


def folded(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def without_copies(rows):
    """Of equal texts the row of the greatest id, none counting as least; of rows that repeat id and text one."""
    best = {}
    for r in rows:
        k = folded(r.text)
        if k not in best or (r.doc_id is not None and (best[k].doc_id is None or r.doc_id > best[k].doc_id)):
            best[k] = r
    return list(best.values())


def without_near_copies(rows):
    """The first row by id of each class by all pairs; rows without a word all stay."""
    rows = sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0, hashlib.sha256((r.text or "").encode()).hexdigest()))
    some = [r for r in rows if (r.text or "").split()]
    root = classes_of_all_pairs([r.text for r in some], sketched=False)
    return [r for r in rows if not (r.text or "").split()] + [r for k, r in enumerate(some) if root[k] == k]


def bag(rows):
    return collections.Counter((r.doc_id, r.text) for r in rows)


def test_stages_against_plain_python(spark, planted):
    where, toxic = planted
    docs = common.table(spark, where, "documents")
    before = docs.collect()
    left = common.written(STAGE["toxicity"](spark, docs, where), "one")
    clean = [r for r in before if r.doc_id not in toxic or r.doc_id is None]
    got = left.collect()
    assert left.columns == docs.columns and bag(got) == bag(clean)

    once = common.written(STAGE["exact_dedup"](spark, left, where), "two")
    want = without_copies(got)
    assert once.columns == docs.columns and bag(once.collect()) == bag(want)

    apart = common.written(STAGE["near_dedup"](spark, once, where), "three")
    want = without_near_copies(want)
    assert apart.columns == docs.columns and bag(apart.collect()) == bag(want)

    mixed = common.written(STAGE["mixing"](spark, apart, where), "four")
    rated = mixing.rated(apart, domains(spark, where), TARGETS).toPandas()
    assert mixed.columns == docs.columns
    total = (rated.n_tokens * rated.rate).sum()
    for d, share in TARGETS.items():
        assert abs((rated.n_tokens * rated.rate * rated[f"p_{d}"]).sum() / total - share) < 0.01
    assert (abs(rated.copies - rated.rate) < 1).all()
    assert collections.Counter(r.doc_id for r in mixed.collect()) == collections.Counter({i: c for i, c in rated.groupby(rated.doc_id.astype(object).where(rated.doc_id.notna(), None), dropna=False).copies.sum().items() for i in [None if i != i else i] if c})

    words = vocabulary()
    library = tiktoken.Encoding("own", pat_str=words.pattern, mergeable_ranks=words.ranks, special_tokens={})
    ids = lambda t: ",".join(map(str, library.encode_ordinary(t or "")))
    out = STAGE["byte_bpe"](spark, mixed, where).collect()
    assert collections.Counter((r.doc_id, r.ids) for r in out) == collections.Counter((r.doc_id, ids(r.text)) for r in mixed.collect())
    assert all(r.ids_sha256 == hashlib.sha256(r.ids.encode()).hexdigest() for r in out)
    texts = collections.Counter(hashlib.sha256((r.text or "").encode()).hexdigest() for r in mixed.collect())
    assert collections.Counter(r.decoded_sha256 for r in out) == texts

    # the whole is its stages, one after another, and leaves one inner table
    folder = common.shared_dir(spark).removeprefix("file://")
    there = set(os.listdir(folder))
    whole = corpus_pipeline.run(spark, where)
    assert collections.Counter((r.doc_id, r.ids) for r in whole.collect()) == collections.Counter((r.doc_id, r.ids) for r in out)
    assert sum("lodeplane-mixing" in x for x in set(os.listdir(folder)) - there) == 1
    assert not any(x.startswith(("lodeplane-toxicity", "lodeplane-exact", "lodeplane-near", "lodeplane-members")) for x in set(os.listdir(folder)) - there)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_an_empty_table(spark, planted, name):
    empty = spark.createDataFrame([], SCHEMA)
    out = STAGE[name](spark, empty, planted[0])
    assert out.count() == 0 and (name == "byte_bpe" or out.columns == empty.columns)
