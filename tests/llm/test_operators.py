"""The training-data operators: defined results for odd inputs, and brute force on small tables."""

import collections
import hashlib
import os
import random
import zlib
from functools import cache

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeplane.llm import bpe, common, exact_dedup, html_text, language, media, mixing, near_dedup, quality, substrings, toxicity
from lodeplane.llm.queries import vocabulary

WORDS = "the of and to in is that for with on as are this by from or an be at which window river stone paper cloud market signal letter garden engine bridge".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, _text string, tid binary"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, ties, repeated rows, a very long text, and columns whose names clash with inner ones."""
    long = prose(1, 30_000) + " " + "x" * 3000 + " " + "é" * 400
    texts = [None, "", "   \n", "Hello World", "hello world", "hello World", "!!!", "a", long, long, prose(2, 80), prose(2, 80) + " more", "x\x00y", "日本語 テキスト 👍"]
    rows = [(i, t, "en" if i % 2 else None, None, 0, 0.5, True, "x", b"y") for i, t in enumerate(texts)]
    rows += [(3, "Hello World", "en", None, 0, None, None, None, None), (None, "hello world", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(14)] + [(3, None, None)], "doc_id long, quality int, toxic int")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# ---------- exact duplicates


def test_exact_dedup(odd, empty):
    got = exact_dedup.exact_dedup(odd, keep="max", fold_case=True)
    assert got.count() == odd.count()
    rows = by_id(got)
    assert rows[3].keep_id == 5 and rows[3].group_size == 5 and not rows[3].kept and rows[5].kept
    assert rows[0].keep_id == 1 and rows[0].text_sha256 == hashlib.sha256(b"").hexdigest() and rows[1].kept
    assert not rows[None].kept
    assert by_id(exact_dedup.exact_dedup(odd, keep="min"))[4].group_size == 2
    assert exact_dedup.exact_dedup(empty).count() == 0
    left = exact_dedup.drop_exact_duplicates(odd, keep="max", fold_case=True)
    assert left.columns == odd.columns and sorted(r.doc_id for r in left.collect()) == [1, 2, 5, 6, 7, 9, 10, 11, 12, 13]
    with pytest.raises(ValueError):
        exact_dedup.exact_dedup(odd, keep="first")


def test_exact_dedup_plan_has_no_python(odd):
    plan = exact_dedup.exact_dedup(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---------- language


def test_language(spark, odd, empty):
    rows = [(i, t * 3, lang) for i, (t, lang) in enumerate([("the house and the river are here", "en"), ("la maison et la rivière sont là", "fr"), ("das haus und der fluss sind hier", "de")] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, common.crc_mod("doc_id", 4) != 2)
    got = by_id(language.predict(docs, model))
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 for i, _, lang in rows)
    got = by_id(language.predict(odd, model))
    assert [got[i].lang_pred for i in (0, 1, 2, 6)] == ["und"] * 4 and got[0].score == 0
    assert language.predict(odd, model).count() == odd.count() and language.predict(empty, model).count() == 0
    nothing = language.fit(empty, common.crc_mod("doc_id", 4) != 2)
    assert {r.lang_pred for r in language.predict(odd, nothing).collect()} == {"und"}


def test_language_score_does_not_hang_on_batches():
    s = language.Settings()
    texts = ["hello there", "", "été", "x" * 50]
    at, whose, some = language.hashed(texts, s)
    for k, t in enumerate(texts):
        one, _, any_ = language.hashed([t], s)
        assert sorted(at[whose == k]) == sorted(one) and some[k] == any_[0]


# ---------- pages


def test_html(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href=/a>Menu</a></ul></nav><div class="cookie-notice">We use cookies to make this site better for you.</div>
    <div id=sidebar><p>Sidebar text that goes on for a while, really.</p></div>
    <article><header><h1>Head &amp; line</h1><p class=by>By someone</p></header><p>First <b>para</b>graph\n with&nbsp;space.<p>Second&hellip; one<br>goes on.
    <div class="ad">Buy now</div><form><label>Name</label><input></form><ul><li>one<li>two</ul></article>
    <section class=comments><p>I disagree with everything that was said here, at length.</p></section><footer>&copy; Site</footer></body></html>"""
    assert html_text.main_text(page).split("\n") == ["Head & line", "By someone", "First paragraph with space.", "Second… one goes on.", "one", "two"]
    plain = "<html><body><div class=menu><a>x</a></div><div><div><p>" + "long text " * 30 + "</p><p>end.</p></div></div><div><p><a href=/>About us</a></p></div></body></html>"
    assert html_text.main_text(plain) == ("long text " * 30).strip() + "\nend."
    assert html_text.main_text("<nav>menu<article><p>text") == "text"
    assert html_text.main_text("just words & more") == "just words & more"
    for x in (None, "", "<", "<!--", "<p", "</p></div>", "<![CDATA[", "<nav><p>only menu</nav>", "&#xZZ;<p>\x00"):
        html_text.main_text(x)
    df = spark.createDataFrame([(1, "u", page, "clash"), (2, None, None, ""), (None, "v", "", None)], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_text.extract(df).collect()}
    assert got[2].text == "" and got[2].n_chars == 0 and got[1].n_chars == len(got[1].text) and got[None].url == "v"
    assert html_text.extract(df.limit(0)).count() == 0


def test_html_keeps_the_whole_article():
    a, b = "first long part " * 40, "second part " * 9
    split = f"<body><div id=content><div><p>{a}</p></div><div><p>{b}</p></div></div></body>"
    assert html_text.main_text(split) == f"{a.strip()}\n{b.strip()}"
    lead = f"<body><main><h1>Title</h1><p>A lead.</p><article><p>{a}</p></article><article><p>Short one.</p></article></main></body>"
    assert html_text.main_text(lead) == f"Title\nA lead.\n{a.strip()}\nShort one."
    named = f"<body><div class='layout has-sidebar'><div><p>{a}</p><p>{b}</p></div><div class=sidebar><p>Beside.</p></div></div></body>"
    assert html_text.main_text(named) == f"{a.strip()}\n{b.strip()}"


def test_html_leaves_out_what_readers_and_teasers_add():
    a = "first long part " * 40
    comments = f"<section id=comments><h2>Comments</h2><article class=comment-body><p>{'I disagree ' * 30}</p></article></section>"
    teasers = "<aside><article><h3>Other story</h3><p>Some words about it that are long enough to look like text.</p></article></aside>"
    assert html_text.main_text(f"<body>{teasers}<article><h1>Head</h1><p>{a}</p></article>{comments}</body>") == f"Head\n{a.strip()}"
    assert html_text.main_text(f"<body><article><h1>Head</h1><p>{a}</p>{comments}</article></body>") == f"Head\n{a.strip()}"
    assert html_text.main_text(f"<body><nav><ul><li>Menu<article><p>{a}</p></article></body>") == a.strip()


def test_html_keeps_sections_whose_names_look_like_parts():
    a = "first long part " * 40
    page = f"<body><article><h2 id=related-work>Related work</h2><p>{a}</p><section id=discussion><h2 id=discussion-1>Discussion</h2><p>{a}</p></section><div class=related><a href=/x>Another story about it</a></div><div class=notice><p>Please note that this page is old.</p></div><section class=related id=related><p>More of the same.</p></section></article></body>"
    assert html_text.main_text(page) == f"Related work\n{a.strip()}\nDiscussion\n{a.strip()}"


def test_html_ratios_choose(monkeypatch):
    """A page without article, and names that say nothing: the runs choose the container; with other ratios another one."""
    menu = "".join(f"<div><span><b>Item</b> <i>{k}</i></span></div>" for k in range(8))
    body = "".join(f"<p>{'words of the text ' * 12}{k}.</p>" for k in range(6))
    page = f"<body><div class=x1>{menu}</div><div class=x2>{body}</div><div class=x3>{menu}</div></body>"
    want = "\n".join(f"{'words of the text ' * 12}{k}." for k in range(6))
    assert html_text.main_text(page) == want
    two = f"<body><article>{menu}</article><article>{body}</article></body>"
    assert html_text.main_text(two).endswith(want) and "Item 0" not in html_text.main_text(two)
    monkeypatch.setattr(html_text, "content_runs", lambda blocks, s: ([k % 3 == 0 for k in range(len(blocks))],) * 2)
    assert html_text.main_text(page) != want and "Item 0" in html_text.main_text(two)


def test_html_ties_and_equal_blocks():
    assert html_text.main_text("<body>" + "<div><p>same words</p></div>" * 5 + "</body>") == "\n".join(["same words"] * 5)


@pytest.mark.parametrize("piece", ["<div>x", "<div class=menu>x", "<span><p>x</p>", "<section><article><p>x", "<ul><li><b>x", "<nav><article>x", "<table><tr><td><i>x</b>"])
def test_html_time_is_in_proportion(piece):
    import time

    took = []
    for n in (5_000, 50_000):
        began = time.perf_counter()
        html_text.main_text(piece * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 30 * took[0] + 1 and took[1] < 20


def test_html_pages_of_the_table(spark, sf_dir):
    import html as H
    import re

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    for p in pages.collect():
        article = re.search(r"<article>(.*)</article>", p.html, re.S).group(1)
        parts = [" ".join(H.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:h1|p)>", article)]
        assert got[p.page_id] == "\n".join(x for x in parts if x)


# ---------- BPE


@pytest.fixture(scope="module")
def words():
    return vocabulary()


@pytest.fixture(scope="module")
def library(words):
    return tiktoken.Encoding("own", pat_str=words.pattern, mergeable_ranks=words.ranks, special_tokens={})


@cache
def one_word():
    """The library with all of a text as one word."""
    words = vocabulary()
    return words.ranks, tiktoken.Encoding("one", pat_str=r"(?s).+", mergeable_ranks=words.ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(min_size=1, max_size=60))
def test_bpe_merges_as_the_library(text):
    ranks, lib = one_word()
    assert bpe.merge(text.encode(), ranks) == lib.encode_ordinary(text)


def test_bpe_documents(odd, empty, words, library):
    got = by_id(bpe.digests(bpe.encode(odd, words), words))
    for r in odd.collect():
        ids = library.encode_ordinary(r.text or "")
        if r.doc_id != 3:
            assert got[r.doc_id].n_tokens == len(ids)
            assert got[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.encode(empty, words).count() == 0


def test_bpe_of_small_chunks(spark, odd, words, library):
    """Chunks of one text or few, words over the length of the fold, and a hot word: as the library has it."""
    s = bpe.Settings(longest=6, chunk=100)
    docs = spark.createDataFrame([(k, f"zzqqy common{k % 3} " + prose(k, k % 40)) for k in range(120)] + [(None, "zzqqy"), (None, None)], "doc_id long, text string").repartition(3)
    got = collections.Counter((r.doc_id, r.ids, r.n_tokens) for r in bpe.encode(docs, words, settings=s).collect())
    ids = lambda t: library.encode_ordinary(t or "")
    assert got == collections.Counter((r.doc_id, ",".join(map(str, ids(r.text))), len(ids(r.text))) for r in docs.collect())


def test_bpe_shuffles_no_texts(spark, words, library):
    """Between the written table of texts and what puts them together there is no exchange; words alone are dealt out."""
    docs = spark.createDataFrame([(k, prose(k, 30)) for k in range(40)], "doc_id long, text string").repartition(3)
    out = bpe.encode(docs, words, settings=bpe.Settings(chunk=500))
    assert {r.doc_id: r.ids for r in out.collect()} == {r.doc_id: ",".join(map(str, library.encode_ordinary(r.text))) for r in docs.collect()}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == plan.count("Exchange hashpartitioning(p#") > 0
    assert plan.split("== Initial Plan ==")[0].count("Exchange ") == 1
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("lodeplane")]


def test_bpe_deals_packs_not_words(spark, words, library, monkeypatch):
    """What is written and dealt out has a row for each text and for each pack of words, of which a chunk has one a share; no row a word."""
    r, rows, real = random.Random(7), {}, bpe.written
    docs = spark.createDataFrame([(k, " ".join("".join(r.choices("qzxjkvw", k=9)) for _ in range(200))) for k in range(40)], "doc_id long, text string").coalesce(1)

    def seen(df, what, **more):
        out = real(df, what, **more)
        rows[what] = out.count()
        return out

    monkeypatch.setattr(bpe, "written", seen)
    got = {r.doc_id: r.ids for r in bpe.encode(docs, words).collect()}
    assert got == {r.doc_id: ",".join(map(str, library.encode_ordinary(r.text))) for r in docs.collect()}
    shares = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    assert shares < 1000 and rows["cut"] <= 40 + shares + 2 and rows["found"] <= shares


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \t\n'sdt12.,\u00a0\u3000\x1c\x85éß日"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_bpe_cuts_as_the_pattern(text):
    pattern = vocabulary().java_pattern()
    assert bpe.plain_pattern(pattern) is not None
    assert bpe.finder(pattern)(text) == bpe.regex.findall(pattern, text)


def test_bpe_other_patterns_are_left_to_regex():
    for pattern in (r"\w+|\W", r"(?i:'s)|\p{L}+|\P{L}", r"\p{L}++|\P{L}"):
        assert bpe.plain_pattern(pattern) is None


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_places_come_back(at):
    assert bpe.places(bpe.packed_places(at)) == at


def test_bpe_fold_equals_heap(spark, words):
    some = sorted({w for k in range(40) for w in prose(k, 20).split()})[:150] + ["zzzqqq", "éàü", "日本語", "👍👍", "    ", "don", "…–"]
    lit = bpe.Literals(words)
    got = spark.createDataFrame([(w,) for w in some], "w string").select("w", lit.encode_word(bpe.F.col("w")).alias("ids")).collect()
    for r in got:
        assert r.ids == ",".join(map(str, bpe.merge(r.w.encode(), words.ranks)))


def test_bpe_folds_long_and_repetitive_words(spark, words):
    r, lit = random.Random(3), bpe.Literals(words)
    some = [" " + "".join(r.choices("aabeénst日", k=r.randrange(1, 40))) for _ in range(400)] + ["a" * n for n in (2, 3, 5, 64, 1024)] + ["=" * 33, "thhasted" * 125]
    for x in spark.createDataFrame([(w,) for w in some], "w string").select("w", lit.encode_word(bpe.F.col("w")).alias("ids")).collect():
        assert x.ids == ",".join(map(str, bpe.merge_by_rule(x.w.encode(), words.ranks)))


def test_literal_arrays(spark):
    for values in ([], [-(1 << 62), 0, 7], list(range(130)), ["", "a", "12345678", "ü" * 9, "x" * 100], ["z"] * 65):
        got = spark.range(1).select(common.literal_array(values).alias("v")).first().v
        assert got == values


def test_bpe_plans_hold_no_tables_as_text(spark, words):
    made = spark.createDataFrame([("lowering",)], "w string").select(bpe.Literals(words).encode_word(F.col("w")).alias("ids"))
    out = made.select("ids", bpe.digest_columns(words)["decoded_sha256"].alias("decoded"))
    assert len(out._jdf.queryExecution().toString()) < 200_000
    assert out.first().decoded == hashlib.sha256(b"lowering").hexdigest()


def test_bpe_long_words(words):
    r = random.Random(5)
    for n in (25, 100, 3000):
        w = "".join(r.choice("abcdeé ") for _ in range(n)).encode()
        assert bpe.merge(w, words.ranks) == bpe.merge_by_rule(w, words.ranks)


# ---------- quality, mixing


def test_quality(spark, odd, empty, labels):
    docs = spark.createDataFrame([(i, prose(i, 60) if i % 3 else "| x | y | " * 40) for i in range(90)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(90)], "doc_id long, quality int")
    s = quality.Settings(features=64)
    sample = quality.sample_statistics(docs, marks, common.crc_mod("doc_id", 5) != 0, bpe.F.col("quality").cast("double"), s)
    model = quality.fit(sample, s)
    got = by_id(quality.score(docs, model, settings=s))
    assert all(got[i].predicted == int(i % 3 > 0) and 0 <= got[i].score <= 1 for i in range(90))
    assert quality.score(odd, model, settings=s).count() == odd.count() and quality.score(empty, model, settings=s).count() == 0
    none = quality.fit(quality.sample_statistics(empty, labels, common.crc_mod("doc_id", 5) != 0, bpe.F.col("quality").cast("double"), s), s)
    assert {r.predicted for r in quality.score(odd, none, settings=s).collect()} == {0}


def test_mixing_meets_its_targets(spark, odd, empty, labels):
    docs = spark.createDataFrame([(i, prose(i, 60) if i % 3 else "| x | y | " * 40) for i in range(300)], "doc_id long, text string")
    known = spark.createDataFrame([(i, "high" if i % 3 else "low") for i in range(0, 300, 2)] + [(1, "other"), (5, None)], "doc_id long, domain string")
    targets = {"high": 3.0, "low": 1.0}
    got = mixing.rated(docs, known, targets).toPandas()
    total = got.n_tokens.sum()
    assert (got.rate >= 0).all() and set(got.columns) == {"doc_id", "n_tokens", "p_high", "p_low", "rate", "copies"}
    assert (got.n_tokens * got.rate * got.p_high).sum() / total == pytest.approx(0.75, abs=0.005)
    assert (got.n_tokens * got.rate * got.p_low).sum() / total == pytest.approx(0.25, abs=0.005)
    assert (abs(got.copies - got.rate) < 1).all()
    # against a dense solution of the same problem
    p, t = got[["p_high", "p_low"]].to_numpy(), got.n_tokens.to_numpy() / total
    r = np.ones(len(got))
    for _ in range(4000):
        e = (p * (r * t)[:, None]).sum(0) - [0.75, 0.25]
        r = np.maximum(0, r - 0.9 * (p @ (e / (p * t[:, None]).sum(0)) + 1e-3 * (r - 1)))
    assert np.abs(r - got.rate).max() < 0.05
    out = mixing.mixed(docs, known, targets)
    assert out.columns == docs.columns and collections.Counter(x.doc_id for x in out.collect()) == collections.Counter({i: n for i, n in zip(got.doc_id, got.copies) if n})
    assert mixing.rated(odd, known, targets).count() == odd.count() and mixing.mixed(empty, known, targets).count() == 0


def test_mixing_reaches_targets_of_soft_posteriors(spark):
    """Posteriors that hardly differ, where plain gradient steps end far from the targets; an unreachable target is told."""
    r = random.Random(3)
    rows = [(r.randrange(10, 200), (p := 0.4 + 0.2 * r.random(), 1 - p)) for _ in range(400)]
    member = spark.createDataFrame([(n, list(p)) for n, p in rows], "n_tokens long, p array<double>").cache()
    model = mixing.Model(["a", "b"], np.zeros(0), np.zeros(0), np.zeros((0, 0)))
    total = sum(n for n, _ in rows)
    for goal in (0.47, 0.53, 0.55):
        mix = mixing.fit_rates(member, model, {"a": goal, "b": 1 - goal})
        rates = mix.rates(np.array([p for _, p in rows]))
        share = sum(n * x * p[0] for (n, p), x in zip(rows, rates)) / total
        assert (rates >= 0).all() and share == pytest.approx(goal, abs=2e-3) and mix.reached["a"] == pytest.approx(share, abs=1e-9)
        assert sum(n * x for (n, _), x in zip(rows, rates)) == pytest.approx(total, rel=5e-3)
    far = mixing.fit_rates(member, model, {"a": 1.0, "b": 0.0})
    assert abs(far.reached["a"] - 1.0) < 0.5 and (far.rates(np.array([p for _, p in rows])) >= 0).all()


# ---------- media


def test_media(odd, empty):
    found = media.media(odd).collect()
    got = {r.doc_id: r for r in found}
    assert len(found) == odd.count() and media.media(empty).count() == 0
    for r in odd.collect():
        raw = (r.text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        x = got[r.doc_id]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert got[8].media_sha256 == got[9].media_sha256 and got[8].media_bytes > got[8].payload_bytes


def test_media_keeps_each_chunk_once(spark):
    common_part = prose(7, 4000)
    docs = spark.createDataFrame([(i, prose(100 + i, 300) + common_part) for i in range(6)] + [(9, common_part), (10, common_part)], "doc_id long, text string")
    s = media.Settings()
    of, stored, foreign = media.store(docs, "doc_id", "text", s)
    chunks = {}  # digest to bytes, as they lie in the store
    kept = stored.collect()
    for r in kept:
        lengths, digests = media.entries(bytes(r.manifest))
        at = 0
        for k in range(len(lengths)) if r.held is None else r.held:
            assert digests[k] not in chunks
            chunks[digests[k]] = bytes(r.pack)[at : at + lengths[k]]
            at += lengths[k]
        assert at == len(r.pack)
    assert foreign.count() > 5 and of.select("recipe").distinct().count() == len(kept) == 7
    assert sum(map(len, chunks.values())) < 0.4 * sum(r.payload_bytes for r in of.collect())
    # what the operator says of the stored form holds for the bytes that lie there, found without its reading
    form = {bytes(r.recipe): bytes(r.manifest) + b"".join(chunks[d] for d in media.entries(bytes(r.manifest))[1]) for r in kept}
    got = by_id(media.media(docs))
    for r in of.collect():
        stored_form = form[bytes(r.recipe)]
        assert (got[r.doc_id].media_bytes, got[r.doc_id].media_sha256) == (len(stored_form), hashlib.sha256(stored_form).hexdigest())
    rows = media.read(stored, foreign, s).collect()
    r = next(x for x in rows if x.lent).asDict(recursive=True)
    assert media.assemble(r)
    r["lent"][0]["data"] = b"0" * len(r["lent"][0]["data"])
    with pytest.raises(ValueError, match="damaged"):
        media.assemble(r)
    r["lent"] = r["lent"][1:]
    with pytest.raises(ValueError, match="damaged"):
        media.assemble(r)


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=40_000))
def test_cuts_are_whole(data):
    s = media.Settings()
    ends = media.cuts(data, s)
    assert ends[-1] == len(data) and ends == sorted(set(ends))
    assert all(b - a <= s.most for a, b in zip([0, *ends], ends))


# ---------- repeated substrings


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    c = collections.Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if c[b[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        g = np.cumsum(gone)[:-1] > 0
        out.append((len(b), int(g.sum()), len(substrings.runs(g)) // 2, hashlib.sha256(np.frombuffer(b, np.uint8)[~g].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("often, crowded", [(1024, 1024), (2, 1024), (2, 2)])
def test_substrings(spark, odd, empty, often, crowded):
    shared = [prose(50 + k, 60) for k in range(4)]
    r = random.Random(3)
    texts = [" ".join(r.choice(shared) if r.random() < 0.4 else prose(r.random(), 30) for _ in range(5)) for _ in range(30)] + ["ab" * 400, "c" * 199, "c" * 200, "c" * 201, shared[0], shared[0]]
    s = substrings.Settings(often=often, crowded=crowded)
    got = by_id(substrings.repeated_substrings(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), s=s))
    for i, want in enumerate(brute(texts, 200)):
        assert tuple(got[i])[1:] == want
    rows = odd.where("doc_id is not null").collect()
    got = collections.defaultdict(set)
    for x in substrings.repeated_substrings(odd, s=s).collect():
        got[x.doc_id].add(tuple(x)[1:])
    for x, want in zip(rows, brute([x.text for x in odd.collect()], 200)):
        assert got[x.doc_id] == {want}
    assert substrings.repeated_substrings(empty).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=40), min_size=1, max_size=5))
def test_suffix_array(parts):
    t = b"\xff".join(x.encode() for x in parts) + b"\xff"
    sa = substrings.suffix_array(t, 12).tolist()
    assert sorted(sa) == list(range(len(t)))
    keys = [t[i : i + 12] for i in sa]
    assert keys == sorted(keys)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=40), min_size=1, max_size=5), st.integers(1, 30))
def test_common_prefixes(parts, depth):
    t = b"\xff".join(x.encode() for x in parts) + b"\xff"
    sa = substrings.suffix_array(t, depth)
    want = [next((k for k in range(depth) if t[a + k : a + k + 1] != t[b + k : b + k + 1] or not t[a + k : a + k + 1]), depth) for a, b in zip(sa.tolist(), sa.tolist()[1:])]
    assert substrings.common_prefixes(t, sa, depth).tolist() == want


def test_a_hot_passage_fills_no_key(spark, monkeypatch):
    """One passage in all of many texts: no task takes more segments of a key than the bound, and the result is right."""
    passage = prose(77, 90)
    texts = [prose(9000 + k, 25) + " " + passage + " " + prose(12000 + k, 25) for k in range(600)]
    s = substrings.Settings(often=32, crowded=64)
    fullest, real = [], substrings.written

    def spy(df, what, *more):
        out = real(df, what, *more)
        if what == "segments":
            fullest.append(out.groupBy("g").agg(F.countDistinct("sid").alias("n")).agg(F.max("n")).first()[0])
        return out

    monkeypatch.setattr(substrings, "written", spy)
    got = by_id(substrings.repeated_substrings(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), s=s))
    want = brute(texts, 200)
    assert [tuple(got[i])[1:] for i in range(len(texts))] == want and sum(x[1] for x in want) > 0
    assert len(fullest) == 2 and fullest[0] > s.crowded >= fullest[1]


# ---------- toxicity


def test_fold():
    assert toxicity.fold("You 1d10t! idiоt 2019") == "you idiot! idiot 2019"
    assert toxicity.fold("$tupid").split() == ["stupid", "tupid"] and "idiot" in toxicity.fold("that!idiot").split() and "idiot" in toxicity.fold("id!ot").split()
    assert toxicity.fold("lo​ser") == "loser"


def test_toxicity(spark, odd, empty, labels):
    docs = spark.createDataFrame([(i, prose(i, 50) + (f" {prose(i + 900, 1)} you nitwit {prose(i + 500, 3)}" if i % 4 == 0 else f" nitwit trap{'abc'[i % 3]} ok" if i % 4 == 1 else "")) for i in range(400)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    lexicon = toxicity.fit_on(docs, marks, common.crc_mod("doc_id", 4) != 2)
    lexicon = toxicity.Lexicon({"nitwit": 6.0}, {"nitwit trapa"}, lexicon.slope, 0.0, 0.01)
    got = by_id(toxicity.score(docs, lexicon))
    assert got[0].predicted == 1 and got[2].predicted == 0 and got[9].predicted == 0 and got[9].n_hits == 0 and got[13].n_hits == 1
    shout = spark.createDataFrame([(1, "N1TW1T"), (2, "nitwits"), (3, None), (4, "")], "doc_id long, text string")
    x = by_id(toxicity.score(shout, lexicon))
    assert [x[k].predicted for k in (1, 2, 3, 4)] == [1, 0, 0, 0]
    assert toxicity.score(odd, lexicon).count() == odd.count() and toxicity.score(empty, lexicon).count() == 0
    left = toxicity.drop_toxic(docs, lexicon)
    assert left.columns == docs.columns and not left.where("doc_id = 0").count() and left.where("doc_id = 2").count()
    assert toxicity.fit_on(empty, labels, common.crc_mod("doc_id", 4) != 2).weights == {}


def test_toxicity_learns_words_not_copies(spark):
    """A word of one text with many copies has one neighbourhood and stays out; an insult in many texts gets in."""
    copy = prose(1, 30) + " harmless"
    rows = [(i, copy, 1) for i in range(40)] + [(100 + i, prose(i, 30) + f" {prose(i + 77, 1)} nitwit {prose(i + 99, 1)}", 1) for i in range(40)] + [(200 + i, prose(i + 300, 40), 0) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon = toxicity.fit(df, "text", "toxic")
    assert "nitwit" in lexicon.weights and "harmless" not in lexicon.weights


# ---------- near duplicates


def plain_alignment(x, y):
    """Longest common subsequence of two lists, by the textbook table."""
    row = [0] * (len(y) + 1)
    for a in x:
        last = 0
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], last + 1 if a == b else max(row[j], row[j - 1])
    return row[-1]


def plain_similarity(a, b):
    x, y = a.lower().split(), b.lower().split()
    return 2 * plain_alignment(x, y) / (len(x) + len(y)) if x or y else 0.0


def plain_labels(text, k):
    """Shingles with their occurrence numbers, counted in text order."""
    w, seen = text.lower().split(), collections.Counter()
    out = []
    for i in range(max(1, len(w) - k + 1)) if w else ():
        g = tuple(w[i : i + k])
        out.append((g, seen[g]))
        seen[g] += 1
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=30), min_size=2, max_size=4), st.integers(1, 5))
def test_labels_are_those_of_counted_shingles(texts, k):
    """In any text, whether it repeats shingles or not, a labelled shingle has one hash, and another one another."""
    number = {}
    for w in texts:
        t = " ".join(w)
        got = near_dedup.labelled(near_dedup.normal(t), k).tolist()
        want = plain_labels(t, k)
        assert len(got) == len(want)
        for g, h in zip(want, got):
            assert number.setdefault(g, h) == h
    assert len(set(number.values())) == len(number)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40), st.lists(st.sampled_from("abcd"), max_size=40), st.sampled_from([0.3, 0.6, 0.8, 0.95]))
def test_similarity_is_that_of_the_whole_table(x, y, least):
    a, b = " ".join(x), " ".join(y)
    want = plain_similarity(a, b)
    got = near_dedup.similarity(a.encode(), b.encode(), least)
    assert got == (pytest.approx(want) if want >= least - 1e-9 and x and y else 0.0)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=60), st.lists(st.sampled_from("abc"), min_size=1, max_size=60), st.integers(0, 9), st.integers(0, 9), st.integers(1, 20))
def test_alignment_in_a_band(x, y, before, after, block):
    table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            met = table[i][j] + 1 if a == b and -before <= i - j <= after else 0
            table[i + 1][j + 1] = max(met, table[i][j + 1], table[i + 1][j])
    assert near_dedup.aligned([a.encode() for a in x], [b.encode() for b in y], before, after, block) == table[-1][-1]


def test_near_dedup(spark, odd, empty):
    base = [prose(k, 120) for k in range(12)]
    r = random.Random(1)
    rows = []
    for k, t in enumerate(base):
        rows.append(t)
        for e in range(4):
            w = t.split()
            for _ in range(r.randrange(1, 12)):
                w[r.randrange(len(w))] = "changed"
            if e == 3:
                w[:0] = w[:5]  # the copy repeats shingles of its own
            rows.append(" ".join(w))
        rows.append(t.upper().replace(" ", "  "))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    got = by_id(near_dedup.near_duplicates(docs))
    want = classes_of_all_pairs(rows, sketched=False)
    assert [got[i].class_id for i in range(len(rows))] == want
    sizes = collections.Counter(want)
    assert all(got[i].class_size == sizes[want[i]] for i in range(len(rows)))
    found = near_dedup.near_duplicates(odd).collect()
    x = {r.doc_id: r for r in found}
    assert len(found) == odd.count() and near_dedup.near_duplicates(empty).count() == 0
    assert x[0].class_id == 0 and x[1].class_id == 1 and x[3].class_id == x[4].class_id == x[None].class_id == 3 and x[9].class_id == 8 and x[11].class_id == 10
    left = near_dedup.drop_near_duplicates(docs)
    assert left.columns == docs.columns and sorted(x.doc_id for x in left.collect()) == sorted(sizes)
    assert near_dedup.drop_near_duplicates(empty).count() == 0
    left = near_dedup.drop_near_duplicates(odd)
    assert left.columns == odd.columns and sorted(x.doc_id for x in left.collect()) == [0, 1, 2, 3, 6, 7, 8, 10, 12, 13]


def classes_of_all_pairs(texts, s=near_dedup.Settings(), sketched=True):
    """Class roots by every similar pair, or every one that shares a sketch, by the textbook alignment."""
    keys = [set(near_dedup.sketches(near_dedup.labelled(near_dedup.normal(t), s.words), s)) for t in texts]
    words = [t.lower().split() for t in texts]
    bags = [collections.Counter(w) for w in words]
    root = list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if top(a) == top(b) or (sketched and not keys[a] & keys[b]):
                continue
            need = s.similarity / 2 * (len(words[a]) + len(words[b])) - 1e-9
            if sum((bags[a] & bags[b]).values()) >= need and plain_alignment(words[a], words[b]) >= need:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return [top(x) for x in range(len(texts))]


def edited(seed, n, words=200, edits=(2, 3, 4)):
    r, base = random.Random(seed), prose(seed, words).split()
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(r.choice(edits)):
            w[r.randrange(words)] = f"edit{r.randrange(10**9)}"
        out.append(" ".join(w))
    return out


def test_near_dedup_of_a_large_family_without_its_base(spark):
    """No text is within 0.8 of all others, so leaders alone miss links; lengths differ in a second family."""
    texts = edited(5, 500, edits=(14, 22, 28)) + [t + " " + prose(k, k % 70) for k, t in enumerate(edited(6, 120, edits=(10, 20)))]
    want = classes_of_all_pairs(texts)
    assert 1 < len(set(want)) < len(want)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = by_id(near_dedup.near_duplicates(docs))
    assert [got[k].class_id for k in range(len(texts))] == want


def test_near_dedup_finds_copies_with_a_tenth_of_the_words_replaced(spark):
    """Recall of planted copies at edit similarity 0.9 and 0.85, none of which shares most five-word shingles; strangers stay apart."""
    rows, family = [], []
    r = random.Random(9)
    for k in range(150):
        words = prose(4000 + k, r.randrange(60, 400)).split()
        for share in (0.0, 0.1, 0.15):
            w = list(words)
            for i in r.sample(range(len(w)), int(share * len(w))):
                w[i] = f"other{r.randrange(10**6)}"
            rows.append(" ".join(w))
            family.append(k)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = by_id(near_dedup.near_duplicates(docs))
    of = [got[i].class_id for i in range(len(rows))]
    assert all(family[c] == f for c, f in zip(of, family))
    assert sum(of[3 * k] == of[3 * k + 1] for k in range(150)) >= 0.95 * 150
    assert sum(of[3 * k] == of[3 * k + 2] for k in range(150)) >= 0.9 * 150


def test_hot_texts_are_spread(spark):
    """A text in a third of all rows, and a class of many texts: joins of hot keys give what plain joins give."""
    left = spark.createDataFrame([(k % 3 and k, k) for k in range(6000)], "key long, row long")
    right = common.written(left.groupBy("key").count(), "right")
    got = common.even_join(left, right, ["key"], "count")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(right, ["key"]).collect()))
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()


def test_drops_decide_by_row(spark):
    """Null ids, an id of two texts, and repeated rows: each group leaves one row, and unique texts stay."""
    a, b, c, d = (prose(k, 60) for k in range(70, 74))
    rows = [(1, a), (None, a), (None, b), (5, a), (5, c), (7, d), (7, d)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for drop in (exact_dedup.drop_exact_duplicates, near_dedup.drop_near_duplicates):
        got = sorted(((r.doc_id, r.text) for r in drop(docs).collect()), key=str)
        assert got == sorted([(1, a), (None, b), (5, c), (7, d)], key=str), drop


def test_similarity_is_of_order():
    a, b = prose(1, 60), prose(2, 60)
    x, y = near_dedup.normal(f"{a} {b}"), near_dedup.normal(f"{b} {a}")
    assert near_dedup.similarity(x, x, 0.8) == 1.0 and near_dedup.similarity(x, y, 0.7) == 0.0 and near_dedup.similarity(x, y, 0.4) >= 0.5


def test_scratch_leaves_what_results_read(spark, tmp_path):
    with common.scratch(spark) as outer:
        with common.scratch(spark) as here:
            a, b = common.written(spark.range(3), "a"), here.keep(common.written(spark.range(4), "b"))
        assert b.count() == 4 and not os.path.exists(a._lodeplane_path.removeprefix("file://"))
        c = outer.keep(common.written(b, "c"))
    assert c.count() == 4 and not os.path.exists(b._lodeplane_path.removeprefix("file://"))


def test_components(spark):
    links = spark.createDataFrame([(b"%02d" % a, b"%02d" % (a + 1)) for a in range(20) if a != 9], "a binary, b binary")
    assert {bytes(r.node): bytes(r.root) for r in near_dedup.components(links).collect()} == {b"%02d" % k: b"00" if k < 10 else b"10" for k in range(21)}


# ---------- shared


def test_bit_map_marks_all(spark):
    keys = spark.range(3000).selectExpr("cast(cast(id as string) as binary) as k")
    bits = common.bit_map(keys.where("length(k) < 4"), "k", 1 << 16)
    assert all(media.flagged(bits, bytes(r.k), 1 << 16) for r in keys.where("length(k) < 4").collect())
    assert sum(media.flagged(bits, bytes(r.k), 1 << 16) for r in keys.where("length(k) >= 4").collect()) < 100
    assert public_tokenizers.PATTERN


def test_components_read_fewer_links_each_round(spark, monkeypatch):
    """Roots against plain Python on a path, a star and random links; links inside a tree are not read again."""
    r = random.Random(4)
    pairs = [(k, k + 1) for k in range(100, 140)] + [(999, k) for k in range(200, 260)] + [(r.randrange(300, 700), r.randrange(300, 700)) for _ in range(300)]
    root = {n: n for p in pairs for n in p}
    for _ in root:
        before = dict(root)
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
        if before == root:
            break
    sizes = []
    write = near_dedup.written

    def counted(df, what, *codec):
        out = write(df, what, *codec)
        sizes.extend([out.count()] if what == "links" else [])
        return out

    monkeypatch.setattr(near_dedup, "written", counted)
    got = near_dedup.components(spark.createDataFrame(pairs, "a long, b long"))
    assert {x.node: x.root for x in got.collect()} == {n: m for n, m in root.items() if any(n in p and p[0] != p[1] for p in pairs)}
    assert sizes[-1] == 0 and sizes[1] < sizes[0] / 2 and sizes == sorted(sizes, reverse=True)


@pytest.mark.parametrize("few, tables", [(1000, ["links", "roots"]), (60, None)])
def test_few_links_are_joined_in_one_task(spark, monkeypatch, few, tables):
    """The classes are those of contraction to the end, whether all links or those of a later round are few."""
    r = random.Random(8)
    pairs = [(k, k + 1) for k in range(100, 140)] + [(999, k) for k in range(200, 260)] + [(r.randrange(300, 700), r.randrange(300, 700)) for _ in range(300)]
    links = spark.createDataFrame([(b"%04d" % a, b"%04d" % b) for a, b in [*pairs, *pairs[:9]]], "a binary, b binary")
    want = {(bytes(x.node), bytes(x.root)) for x in near_dedup.components(links).collect()}
    made, write = [], near_dedup.written
    monkeypatch.setattr(near_dedup, "written", lambda df, what, *codec: (made.append(what), write(df, what, *codec))[1])
    got = near_dedup.components(links, few).collect()
    assert len(got) == len(want) and {(bytes(x.node), bytes(x.root)) for x in got} == want
    assert tables is None or made == tables
    assert near_dedup.components(links.limit(0), few).count() == 0


def test_near_duplicates_take_few_tables_for_few_links(spark, monkeypatch):
    """A class of edited copies: its components took a table a step, each as many tasks as there are partitions."""
    words = prose(77, 100).split()
    texts = [" ".join([*words[:k], f"edit{k}", *words[k + 1 :]]) for k in range(12)] + [prose(78, 100)]
    made, write = [], near_dedup.written
    monkeypatch.setattr(near_dedup, "written", lambda df, what, *codec: (made.append(what), write(df, what, *codec))[1])
    rows = near_dedup.near_duplicates(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in rows} == {k: 0 if k < 12 else 12 for k in range(13)}
    assert made.count("roots") == 1
