"""The registered training-data queries and the pipeline on the smallest tables."""

import collections
import difflib
import hashlib

import oracle
import pytest
import tiktoken

import corpus_pipeline
from lodeplane.llm.queries import QUERIES, SQL, vocabulary

COLUMNS = {
    "op1_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    "op2_html_extraction": {"page_id", "url", "text", "n_chars"},
    "op3_byte_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op5_quality": {"doc_id", "held_out", "score", "predicted"},
    "op6_media": {"doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"},
    "op7_exact_dedup": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
    "op8_suffix_array_dedup": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    "op9_toxicity": {"doc_id", "held_out", "score", "predicted"},
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir):
    got = QUERIES[name](spark, sf_dir).toPandas()
    table = "pages" if name.startswith("op2") else "documents"
    assert len(got) == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
    assert COLUMNS.get(name, set()) <= set(got.columns)
    if name in SQL:
        assert not oracle.differences(got, oracle.connect(sf_dir).execute(SQL[name]).df())


def test_held_out_languages_and_labels(spark):
    """Accuracy on rows that were not learned from, on a table large enough to learn from."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    lang = QUERIES["op1_language_id"](spark, sf).where("held_out").join(docs, "doc_id")
    assert lang.where("lang = lang_pred").count() > 0.98 * lang.count()
    quality = QUERIES["op5_quality"](spark, sf).where("held_out").join(labels, "doc_id")
    assert quality.where("predicted = quality").count() > 0.95 * quality.count()
    # a lexicon takes more labelled rows than the other models
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    toxic = QUERIES["op9_toxicity"](spark, sf).where("held_out").join(labels, "doc_id").where("toxic is not null").toPandas()
    hits, found = toxic[toxic.toxic == 1], toxic[toxic.predicted == 1]
    assert hits.predicted.mean() >= 0.9 and found.toxic.mean() >= 0.9


def test_bpe_of_more_words_than_its_table(spark):
    """Against the library, on a table of 78,000 distinct words."""
    sf = "/root/testdata/sf0.01"
    words = vocabulary()
    library = tiktoken.Encoding("own", pat_str=words.pattern, mergeable_ranks=words.ranks, special_tokens={})
    got = {r.doc_id: r for r in QUERIES["op3_byte_bpe"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode_ordinary(r.text or "")
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_near_copies_of_the_table_are_found(spark):
    """Recall against the edit similarity of all pairs that share a rare run of three words, and no class without a similar pair."""
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r.class_id for r in QUERIES["op10_near_dedup"](spark, sf).collect()}
    words = {r.doc_id: (r.text or "").lower().split() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    runs = collections.defaultdict(set)
    for i, w in words.items():
        for k in range(len(w) - 2):
            runs[tuple(w[k : k + 3])].add(i)
    near = {(a, b) for s in runs.values() if len(s) <= 8 for a in s for b in s if a < b}
    alike = []
    for a, b in near:
        x, y = words[a], words[b]
        need = 0.45 * (len(x) + len(y))
        if min(len(x), len(y)) >= need and sum((collections.Counter(x) & collections.Counter(y)).values()) >= need and difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() >= 0.9:
            alike.append((a, b))
    assert len(alike) > 50 and sum(got[a] == got[b] for a, b in alike) >= 0.95 * len(alike)


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == before.columns, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "byte_bpe"]
    out = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert 0 < len(out) and {"doc_id", "n_tokens", "ids"} <= set(out.columns)


def test_pipeline_result_outlives_its_inner_tables(spark, sf_dir):
    """What the last stage keeps is still there when the result is read, twice."""
    out = corpus_pipeline.run(spark, sf_dir)
    first = collections.Counter((r.doc_id, r.n_tokens, r.ids) for r in out.collect())
    assert first and first == collections.Counter((r.doc_id, r.n_tokens, r.ids) for r in out.collect())
