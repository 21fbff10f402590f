"""Near duplicates by Order MinHash.

A document is the sequence of its k-word shingles, each labelled with its occurrence number. A sketch takes the few
smallest labelled shingles under one hash function and keeps their text order, so documents agree on it if they share these
shingles in the same order. Documents that agree on a sketch are candidates. Two candidates are similar if a banded
alignment of their words matches enough of them: twice the matched words over the words of both, an edit similarity.

Each candidate is first compared with its bucket's leader, over several rounds with new leaders for those that did not
match. Links give components. Where a bucket still holds several of them, all its pairs across components are tested: in
blocks, by the exact number of common words and then by alignment. So the classes are those of all similar pairs that share
a sketch.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeplane.llm.common import bit_map, even_join, map_texts, scratch, written
from lodeplane.llm.media import flagged

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@dataclass(frozen=True)
class Settings:
    #: Words of a shingle, and the least similarity: twice the aligned words over the words of the two documents.
    words: int = 5
    similarity: float = 0.8
    #: Sketches, and labelled shingles in each. Where one word in ten is replaced, two texts share 0.42 of their shingles, agree
    #: on a sketch with 0.17 and on none of 32 with 0.002; where one in seven is, with 0.06.
    sketches: int = 32
    shingles: int = 2
    #: Rounds of leaders: they link most members cheaply, and what they leave is tested pair by pair.
    rounds: int = 3
    #: Members of a block in which pairs are tested.
    block: int = 200
    #: Links, whatever the input, that one task joins to components: some 40 MB at most; more are contracted before.
    few: int = 100_000
    map_bits: int = 1 << 23


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def normal(text: str | None) -> bytes:
    """Lower-case words between single spaces."""
    return " ".join((text or "").lower().split()).encode("utf-8", "surrogatepass")


def labelled(data: bytes, k: int) -> np.ndarray:
    """Hashes of the occurrence-labelled k-word shingles in text order; fewer words than k make one shingle."""
    if not data:
        return np.zeros(0, np.uint64)
    b = np.frombuffer(data, np.uint8)
    gap = np.flatnonzero(b == 32)
    start = np.r_[0, gap + 1]
    place = np.arange(len(b)) - np.repeat(start, np.diff(np.r_[start, len(b)]))
    power = np.cumprod(np.full(int(place.max()) + 1, _A | np.uint64(1)))
    value = (b.astype(np.uint64) + np.uint64(1)) * power[place]
    value[gap] = 0
    w = mixed(np.add.reduceat(value, start))
    n = max(1, len(w) - k + 1)
    h = np.zeros(n, np.uint64)
    for j in range(min(k, len(w))):
        h = h * _A + w[j : j + n]
    h = mixed(h)
    # occurrences are counted in text order, 0 for the first, and every shingle is labelled, whether it repeats or not
    order = np.argsort(h, kind="stable")
    at = np.arange(n)
    same = np.r_[False, h[order][1:] == h[order][:-1]]
    occurrence = np.empty(n, np.uint64)
    occurrence[order] = (at - np.maximum.accumulate(np.where(same, 0, at))).astype(np.uint64)
    return mixed(h + occurrence * _C)


def sketches(h: np.ndarray, s: Settings) -> list[int]:
    """One key per sketch: its smallest labelled shingles, in text order."""
    if not len(h):
        return []
    seeds = mixed(np.arange(1, s.sketches + 1, dtype=np.uint64) * _A)
    v = mixed(h[None, :] ^ seeds[:, None])
    if len(h) > s.shingles:
        at = np.sort(np.argpartition(v, s.shingles - 1, axis=1)[:, : s.shingles], axis=1)
    else:
        at = np.tile(np.arange(len(h)), (s.sketches, 1))
    key = seeds.copy()
    for j in range(at.shape[1]):
        key = key * _A + h[at[:, j]]
    return mixed(key).view(np.int64).tolist()


def aligned(a: list[bytes], b: list[bytes], before: int, after: int, block: int = 4096) -> int:
    """Most words matched in order, word i of a with a word j of b where -before <= i - j <= after.

    Rows of the alignment are bits of whole numbers, of which only the band's are kept: a step takes time in proportion to
    the band, memory is that of the band and of `block` words.
    """
    width = before + after + 1
    ones = (1 << width) - 1
    v, low, matched = ones, -before, 0  # bit k of v: word low + k of a; a zero is a match
    for start in range(0, len(b), block):
        first = max(0, start - before)
        masks: dict[bytes, int] = {}
        for k, x in enumerate(a[first : start + block + after]):
            masks[x] = masks.get(x, 0) | 1 << k
        for j in range(start, min(len(b), start + block)):
            if j:
                # the band moves on by one word: the lowest bit leaves, a new one enters
                matched += not v & 1
                v = v >> 1 | 1 << (width - 1)
            low = j - before
            q = masks.get(b[j], 0)
            if q:
                q = (q >> (low - first) if low >= first else q << (first - low)) & ones
                u = v & q
                if u:
                    v = ((v + u) | (v - u)) & ones
    return matched + width - v.bit_count()


def similarity(a: bytes, b: bytes, least: float) -> float:
    """Twice the aligned words over all words of two normal texts, in the band that `least` allows; 0 if below."""
    x, y = a.split(), b.split()
    n, m = len(x), len(y)
    need = least / 2 * (n + m) - 1e-9
    if not n or not m or min(n, m) < need:
        return 0.0
    head = 0
    while head < min(n, m) and x[head] == y[head]:
        head += 1
    tail = 0
    while tail < min(n, m) - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    x, y = x[head : n - tail], y[head : m - tail]
    common = head + tail
    if x and y:
        if common + sum((Counter(x) & Counter(y)).values()) < need:
            return 0.0
        common += aligned(x, y, int(m - need), int(n - need))
    return 2 * common / (n + m) if common >= need else 0.0


def across(seqs: list, comps: list, texts: list[bytes], least: float, width: int = 4096) -> list[tuple[int, int]]:
    """Pairs of similarity `least` or more that connect whatever such pairs between different `comps` connect.

    Common words are counted for all pairs by matrix products over `width` words at a time; at least as many must be
    common as must be aligned, so only pairs with enough are aligned, and only while they are not connected.
    """
    held = [labelled(t, 1) for t in texts]
    size = np.array([len(h) for h in held])
    who = np.repeat(np.arange(len(held)), size)
    token, at, often = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
    # a word of one member is common to no pair
    number = np.cumsum(often > 1) - 1
    used = often[at] > 1
    who, at = who[used], number[at[used]]
    order = np.argsort(at, kind="stable")
    who, at = who[order], at[order]
    common = np.zeros((len(held), len(held)), np.float32)
    for start in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        a, z = np.searchsorted(at, (start, start + width))
        m = np.zeros((len(held), width), np.float32)
        m[who[a:z], at[a:z] - start] = 1
        common += m @ m.T
    need = least / 2 * (size[:, None] + size[None, :])
    root = {c: c for c in comps}

    def top(c):
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    found = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(common >= need - 1e-3, 1))), strict=True):
        x, y = top(comps[i]), top(comps[j])
        if x != y and similarity(texts[i], texts[j], least):
            root[y] = x
            found.append((seqs[i], seqs[j]))
    return found


def remaining(left: DataFrame, root: DataFrame, content: DataFrame, s: Settings) -> DataFrame:
    """Links (a, b) between the components of `root` inside each bucket of `left` (key, seq, n): no pair is left out.

    A bucket's members are dealt into blocks, those of a large component into blocks of their own, and each two blocks
    meet in one task, but for two of the same component. Members of large buckets meet only where lengths allow it.
    """
    member = left.join(root.withColumnRenamed("node", "seq"), "seq", "left").select("key", "seq", "n", F.coalesce("root", "seq").alias("comp"))
    member = written(member, "members")
    each = written(member.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m")), "each")
    # rounds of leaders test the one pair of a bucket of two
    whole = written(each.groupBy("key").agg(F.sum("m").alias("c"), F.count(F.lit(1)).alias("parts")).where("c > 2 and parts > 1"), "whole")
    each = written(even_join(each, whole, ["key"], "parts").select("key", "comp", "c", "m", F.when(F.col("m") >= s.block, F.col("comp")).otherwise(F.lit(b"")).alias("pool")), "parts")
    # lengths of a similar pair differ by one such step at most
    step = F.when(F.col("c") <= s.block, 0).otherwise(F.floor(F.log("n") / float(np.log((2 - s.similarity) / s.similarity)) + 1e-9)).cast("int")
    member = written(even_join(member, each, ["key", "comp"], "m").select("key", "seq", "comp", "pool", step.alias("step")), "unsettled")
    dealt = member.groupBy("key", "pool", "step").agg(F.count(F.lit(1)).alias("m"))
    dealt = written(dealt.select("key", "pool", "step", "m", F.ceil(F.col("m") / s.block).cast("int").alias("blocks")), "dealt")
    member = even_join(member, dealt, ["key", "pool", "step"], "m")
    member = member.withColumn("part", F.struct("pool", "step", F.pmod(F.xxhash64("seq"), F.col("blocks")).cast("int").alias("block"))).select("key", "seq", "comp", "part")
    part = dealt.select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "pool", "step").select("key", F.struct("pool", "step", "block").alias("p"))
    meet = part.join(part.select("key", F.col("p").alias("q")), "key").where("p <= q and abs(p.step - q.step) <= 1 and (p.pool != q.pool or p.pool = X'')")
    meet = meet.select("key", F.xxhash64("key", "p", "q").alias("meeting"), "p", "q")
    sides = meet.select("key", "meeting", F.explode(F.array_distinct(F.array("p", "q"))).alias("part"))
    sent = member.join(sides, ["key", "part"]).select("key", "meeting", "seq", "comp").join(content, "seq")

    def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = zstandard.ZstdDecompressor()
        at, group, links = None, [], []

        def end() -> None:
            if len({c for _, c, _ in group}) > 1:
                links.extend(across([g[0] for g in group], [g[1] for g in group], [u.decompress(g[2]) for g in group], s.similarity))
            group.clear()

        for batch in batches:
            for key, meeting, *row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if (key, meeting) != at:
                    end()
                    at = (key, meeting)
                group.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.binary()) for k in (0, 1)], names=["a", "b"])
            links.clear()
        end()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.binary()) for k in (0, 1)], names=["a", "b"])

    sent = sent.select("key", "meeting", "seq", "comp", "pack").repartition("key", "meeting").sortWithinPartitions("key", "meeting")
    return sent.mapInArrow(tested, "a binary, b binary").distinct()


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least node that each reaches over all links (a, b) of a task."""
    root, kind = {}, pa.null()

    def top(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for batch in batches:
        kind = batch.column(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = top(root.setdefault(a, a)), top(root.setdefault(b, b))
            root[max(x, y)] = min(x, y)
    if root:
        yield pa.RecordBatch.from_arrays([pa.array([*root], kind), pa.array([top(x) for x in root], kind)], names=["node", "root"])


def components(links: DataFrame, few: int = 0) -> DataFrame:
    """(node, root) of links (a, b): the least node that each reaches, by contraction.

    Each node points to its least neighbour, if that is less; pointers are followed to the ends of their trees; links then join
    the trees' ends, each once, and those inside a tree are gone. So a round reads only the links that the last one left.
    Each step is a written table, so a lost executor costs that step alone and no component meets in one task. What is left
    when `few` links or fewer are is joined in one task: rounds over so little are nothing but jobs, which the driver keeps.
    """
    link = written(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    root = None
    while True:
        last = bool(few) and link.count() <= few
        if last:
            kind = link.schema["a"].dataType.simpleString()
            end = written(link.coalesce(1).mapInArrow(joined, f"node {kind}, root {kind}"), "roots")
        else:
            both = link.select("a", "b").union(link.select("b", "a"))
            end = written(both.groupBy("a").agg(F.min("b").alias("r")).select(F.col("a").alias("node"), F.least("a", "r").alias("root")), "roots")
        while not last:
            beyond = end.select(F.col("node").alias("via"), F.col("root").alias("next"))
            stepped = written(end.join(beyond, F.col("root") == F.col("via")).select("node", "root", "next"), "roots")
            end = stepped.select("node", F.col("next").alias("root"))
            if not stepped.where("root != next").limit(1).count():
                break
        if root is None:
            root = end
        else:
            further = end.select(F.col("node").alias("via"), F.col("root").alias("next"))
            root = written(root.join(further, F.col("root") == F.col("via"), "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
        if last:
            return root
        left = link.join(end.select(F.col("node").alias("a"), F.col("root").alias("x")), "a").join(end.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
        link = written(left.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        if not link.limit(1).count():
            return root


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """id_col, class_id (the least id of the row's class) and class_size for each row.

    Rows whose words are equal (case and white space aside) are of one class. Texts without a word, null texts among them,
    are each a class of their own; texts of fewer words than a shingle match equal texts only. A null id is never a class's
    id unless its whole class has none. Repeated rows count each. Very long texts are sketched and aligned whole. An empty
    table gives no rows. Other columns are ignored.
    """
    with scratch(df.sparkSession) as here:
        rows = here.keep(written(_sketched(df, id_col, text_col, s), "sketches"))
        root = _linked(df, rows, text_col, s)
        return _placed(rows, root, id_col, here)


def _sketched(df: DataFrame, id_col: str, text_col: str, s: Settings) -> DataFrame:
    def task():
        def run(texts: list) -> list:
            seq, n, keys = [], [], []
            for t in texts:
                data = normal(t)
                seq.append(hashlib.blake2b(data, digest_size=16).digest())
                n.append(data.count(b" ") + 1 if data else 0)
                keys.append(sketches(labelled(data, s.words), s))
            return [seq, n, keys]

        return run

    return map_texts(df, [id_col], F.col(text_col), task, "seq binary, n int, keys array<long>")


def _linked(df: DataFrame, rows: DataFrame, text_col: str, s: Settings) -> DataFrame:
    """(node, root) of the texts (by digest) that are similar to another."""
    spark = df.sparkSession
    texts = rows.where("n > 0").groupBy("seq").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))
    buckets = written(texts.select("seq", "n", F.explode("keys").alias("key")), "buckets")
    shared = written(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "full")
    members = written(even_join(buckets, shared, ["key"], "c"), "shared")
    # a text that is in the fullest buckets is the likeliest centre of its group, so it leads
    central = members.groupBy("seq").agg(F.sum("c").alias("score"))
    left = written(members.join(central, "seq").select("key", "seq", "n", "score"), "left")

    bits = spark.sparkContext.broadcast(bit_map(central, "seq", s.map_bits))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(3)
        for batch in batches:
            seq, pack = [], []
            for t in batch.column(0).to_pylist():
                data = normal(t)
                d = hashlib.blake2b(data, digest_size=16).digest()
                if flagged(bits.value, d, s.map_bits):
                    seq.append(d)
                    pack.append(z.compress(data))
            yield pa.RecordBatch.from_arrays([pa.array(seq, pa.binary()), pa.array(pack, pa.binary())], names=["seq", "pack"])

    content = df.select(F.col(text_col).alias("_text")).mapInArrow(packed, "seq binary, pack binary")
    content = written(content.groupBy("seq").agg(F.first("pack").alias("pack")), "content", "none")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = zstandard.ZstdDecompressor()
        for batch in batches:
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            alike = [similarity(u.decompress(p), u.decompress(q), s.similarity) for p, q in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(alike, pa.float64())], names=["a", "b", "alike"])

    tested = []
    for k in range(s.rounds):
        lead = left.groupBy("key").agg(F.max(F.struct("score", "seq", "n")).alias("lead"), F.count(F.lit(1)).alias("c")).where("c > 1")
        lead = written(lead.select("key", F.col("lead.seq").alias("b"), F.col("lead.n").alias("m"), "c"), "leaders")
        beside = even_join(left, lead, ["key"], "c").where("seq != b")
        pairs = beside.where(F.least("n", "m") >= s.similarity / 2 * (F.col("n") + F.col("m")) - 1e-9).select(F.col("seq").alias("a"), "b").distinct()
        for old in tested:
            pairs = pairs.join(old.select("a", "b"), ["a", "b"], "left_anti")
        pairs = pairs.join(content.select(F.col("seq").alias("a"), F.col("pack").alias("x")), "a").join(content.select(F.col("seq").alias("b"), F.col("pack").alias("y")), "b")
        tested.append(written(pairs.select("a", "b", "x", "y").mapInArrow(compared, "a binary, b binary, alike double"), "pairs"))
        if k + 1 < s.rounds:
            found = tested[0]
            for t in tested[1:]:
                found = found.unionByName(t)
            found = found.where("alike > 0").select(F.col("a").alias("seq"), "b")
            left = written(beside.select("key", "seq", "n", "score", "b").join(found, ["seq", "b"], "left_anti").select("key", "seq", "n", "score"), "left")
    links = tested[0]
    for t in tested[1:]:
        links = links.unionByName(t)
    links = links.where("alike > 0").select("a", "b")
    root = components(links, s.few)
    more = written(remaining(members, root, content, s), "links")
    return components(links.unionByName(more), s.few) if more.limit(1).count() else root


def _placed(rows: DataFrame, root: DataFrame, id_col: str, here) -> DataFrame:
    """The class of each row: by text, then by class, and back; neither a text nor a class of many rows meets in one task."""
    per = rows.where("n > 0").groupBy("seq").agg(F.min(id_col).alias("_least"), F.count(F.lit(1)).alias("_rows"))
    per = written(per.join(root, per.seq == root.node, "left").select("seq", "_least", "_rows", F.coalesce("root", "seq").alias("_class")), "texts")
    sizes = per.groupBy("_class").agg(F.min("_least").alias("class_id"), F.sum("_rows").alias("class_size"), F.count(F.lit(1)).alias("_texts"))
    placed = here.keep(written(even_join(per, written(sizes, "classes"), ["_class"], "_texts").select("seq", "class_id", "class_size", "_rows"), "placed"))
    alone = rows.where("n = 0").select(F.col(id_col), F.col(id_col).alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return even_join(rows.where("n > 0").select(F.col(id_col), "seq"), placed, ["seq"], "_rows").select(id_col, "class_id", "class_size").unionByName(alone)


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """The rows of df that lead their class, with all columns of df: one row of each class.

    That is the row of the least id, nulls last; among rows of one id the one of the least text digest; among rows that
    repeat id and text any one. Texts without a word are no class and all stay. Rows are told apart by their place in a
    written copy of df, so null and repeated ids decide for no other row. An empty table gives no rows.
    """
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), digest.alias("text"), F.monotonically_increasing_id().alias("place"))
    with scratch(df.sparkSession) as here:
        placed = here.keep(written(df.withColumn("_key", key), "placed"))
        gone = here.keep(written(near_duplicates(placed, "_key", text_col, s).where("_key != class_id").select(F.col("_key.place").alias("_place")), "gone"))
        return placed.join(gone, F.col("_key.place") == F.col("_place"), "left_anti").select(*df.columns)
