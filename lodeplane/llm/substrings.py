"""Repeated substrings across all documents, by suffix arrays built with two-stage sorting.

Every string of `length` bytes has an anchor: the place of the least hash among its k-byte strings, leftmost among equals.
Equal strings have equal anchors, so all strings of one anchor hash can be compared apart from the others. A document is
cut into segments, each covering the neighbouring strings of one anchor. Anchors that occur once in the corpus are left
out; the segments of the others meet in tasks, equal segments already merged. There a suffix array finds the strings that
occur in more than one segment: suffixes not larger than their successor are sorted directly, the others are induced by
scanning the buckets, and adjacent common prefixes of `length` bytes mark repeats.

An anchor with very many occurrences is split by the bytes that all its strings of like offset share, so a passage in a
third of all documents is spread over many keys. Where very many different segments still share a key, as those over a
passage's borders do, they are cut into single strings, which meet by what they are: no key's segments grow with the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeplane.llm.common import bit_map, even_join, map_texts, scratch, written

#: No UTF-8 text has this byte; it ends a segment in the suffix array.
END = 0xFF
#: Strings whose anchors are looked for at a time; places within such a part fit 24 bits.
PART = 1 << 23


@dataclass(frozen=True)
class Settings:
    length: int = 200
    #: Bytes of an anchor: the sum of two powers of two.
    anchor: int = 48
    #: Occurrences from which on an anchor is split, by this many neighbouring offsets.
    often: int = 1024
    step: int = 16
    #: Different segments of a key from which on they are cut into single strings.
    crowded: int = 1024
    #: Bytes of segments that one suffix array takes together; the segments of one key always meet.
    block: int = 1 << 18
    map_bits: int = 1 << 23


@cache
def _table() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def _hashes(b: np.ndarray, k: int) -> np.ndarray:
    """A polynomial hash of each k-byte string, by doubling."""
    made, size, base = {1: _table()[b]}, 1, 0x94D049BB133111EB
    while size * 2 <= k:
        h = made[size]
        made[size * 2] = h[:-size] * np.uint64(pow(base, size, 1 << 64)) + h[size:]
        size *= 2
    h, have = made[size], size
    for s in sorted(made, reverse=True)[1:]:
        if have + s <= k:
            h = h[: len(made[s]) - have] * np.uint64(pow(base, s, 1 << 64)) + made[s][have : have + len(h[: len(made[s]) - have])]
            have += s
    h = h[: len(b) - k + 1]
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def anchors(data: bytes, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings with one anchor: anchor hash, its place, first and last start of the strings."""
    out = []
    for base in range(0, len(data) - s.length + 1, PART):
        b = np.frombuffer(data, np.uint8)[base : base + PART + s.length - 1]
        h = _hashes(b, s.anchor)
        low = np.uint64((1 << 24) - 1)
        v = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        width, have = s.length - s.anchor + 1, 1
        m = v
        while have * 2 <= width:
            m = np.minimum(m[:-have], m[have:])
            have *= 2
        n = len(v) - width + 1
        m = np.minimum(m[:n], m[width - have : width - have + n])
        place = (m & low).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        last = np.r_[first[1:] - 1, n - 1]
        p = place[first]
        out.append((h[p].view(np.int64), p + base, first + base, last + base))
    if not out:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def suffix_array(t: bytes, depth: int) -> np.ndarray:
    """Suffixes of t, which ends with END, in order of their first `depth` bytes at least.

    Two stages: a suffix whose first byte is at most the next one is sorted directly; any other is one longer than a suffix
    of a smaller bucket, so going through the buckets upwards, each bucket's predecessors fall into place in its order.
    """
    b = np.frombuffer(t, np.uint8)
    larger = np.r_[b[:-1] > b[1:], True]  # what follows the last suffix is empty, so less than anything
    direct = np.array(sorted(np.flatnonzero(~larger).tolist(), key=lambda i: t[i : i + depth]), np.int64)
    ends = np.searchsorted(b[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[b[-1]].append(np.array([len(b) - 1]))
    out = []
    for c in range(256):
        bucket = np.concatenate([*induced[c], direct[ends[c] : ends[c + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[b[before] > c]
        if len(before):
            of = b[before]
            order = np.argsort(of, kind="stable")
            at = np.searchsorted(of[order], np.arange(c + 1, 257))
            for d in range(c + 1, 256):
                if at[d - c - 1] < at[d - c]:
                    induced[d].append(before[order[at[d - c - 1] : at[d - c]]])
    return np.concatenate(out)


def common_prefixes(t: bytes, sa: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of each suffix in sa with the next one, up to `depth` bytes."""
    b = np.frombuffer(t + b"\0" * (depth + 16), np.uint8)
    word = b.astype(np.uint64)
    for k in (1, 2, 4):
        word = word[:-k] | (word[k:] << np.uint64(8 * k))
    x, y = sa[:-1], sa[1:]
    out = np.full(len(x), depth)
    same = np.arange(len(x))
    for at in range(0, depth, 8):
        apart = word[x[same] + at] ^ word[y[same] + at]
        stop = apart != 0
        low = apart[stop]
        # bytes below the lowest set bit are equal
        low = low & (~low + np.uint64(1))
        out[same[stop]] = np.minimum(depth, at + np.log2(low.astype(np.float64)).astype(np.int64) // 8)
        same = same[~stop]
    return out


def repeats(segments: list[bytes], length: int) -> list[np.ndarray]:
    """For each of the (different) segments, which of its strings of `length` bytes occur in another or elsewhere in it."""
    t = bytes([END]).join(segments) + bytes([END])
    sa = suffix_array(t, length + 8)
    start = np.cumsum([0, *(len(x) + 1 for x in segments)])
    until = np.repeat(start[1:] - 1, np.diff(start))
    fits = np.arange(len(t)) + length <= until
    sa = sa[fits[sa]]
    same = np.flatnonzero(common_prefixes(t, sa, length) >= length)
    hit = np.zeros(len(t), bool)
    hit[sa[same]] = True
    hit[sa[same + 1]] = True
    return [hit[a : a + max(0, len(g) - length + 1)] for a, g in zip(start[:-1].tolist(), segments, strict=True)]


def runs(hit: np.ndarray) -> list[int]:
    """Starts and ends (exclusive) of the runs of true values, in turn."""
    return np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8))).tolist()


def segments(data: bytes, often: dict[int, bool], s: Settings) -> Iterator[tuple[int, int, bytes]]:
    """(start, key, bytes) of the segments whose anchors are in `often`; its value says whether to split."""
    for h, p, a, z in zip(*(x.tolist() for x in anchors(data, s)), strict=True):
        split = often.get(h)
        if split is None:
            continue
        if not split:
            yield a, h, data[a : z + s.length]
            continue
        for j in range((p - z) // s.step, (p - a) // s.step + 1):
            first, last = max(a, p - s.step * j - s.step + 1), min(z, p - s.step * j)
            core = data[p - s.step * j : p - s.step * j - s.step + 1 + s.length]
            key = xxhash.xxh64_intdigest(core, (h & 0xFFFFFFFF) ^ j)
            yield first, key - (1 << 63), data[first : last + s.length]


def packed_text(t: str | None) -> bytes:
    return (t or "").encode()


def repeated_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """Removes each byte covered by a string of `length` bytes that also starts anywhere else.

    Returns id_col, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 for each row. Texts are UTF-8 bytes;
    null counts as empty; no string crosses rows. A text that occurs in several rows is removed whole if it has `length`
    bytes, and its rows count as elsewhere for others. Texts shorter than `length` stay. Repeated rows, and rows without an
    id, are answered each; an empty table gives no rows. Long texts are worked in parts of 8 MB. Other columns are ignored.
    """
    with scratch(df.sparkSession) as here:
        return _repeated(df, id_col, text_col, s, here)


#: Of the segments: text, first start, key, digest, bytes.
SEGMENTS = "tid binary, start long, g long, sid binary, seg binary"


def cut_rows(rows: list) -> pa.RecordBatch:
    types = [pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["tid", "start", "g", "sid", "seg"])


def _repeated(df: DataFrame, id_col: str, text_col: str, s: Settings, here) -> DataFrame:
    spark = df.sparkSession

    def first_pass():
        def run(texts: list) -> list:
            out = []
            for t in texts:
                data = packed_text(t)
                tid = hashlib.blake2b(data, digest_size=16).digest()
                found = np.unique(anchors(data, s)[0], return_counts=True) if len(data) >= s.length else ((), ())
                out.append((len(data), tid, hashlib.sha256(data).hexdigest(), list(found[0]), list(found[1])))
            return [list(c) for c in zip(*out, strict=True)] or [[]] * 5

        return run

    base = here.keep(written(map_texts(df, [id_col], F.col(text_col), first_pass, "n_bytes long, tid binary, sha string, hs array<long>, ns array<int>"), "anchors"))
    # rows of equal texts give equal hashes here, so an anchor occurs twice if two hashes differ or one text has it twice
    place = base.select(F.xxhash64("tid").alias("t"), F.explode(F.arrays_zip("hs", "ns")).alias("x")).select(F.col("x.hs").alias("h"), "t", F.col("x.ns").alias("n"))
    counted = place.groupBy("h").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.max("n").alias("n"), F.sum("n").alias("c"))
    often = counted.where("a != b or n > 1").select("h", (F.col("c") > s.often).alias("split"))
    of = written(place.select("h", "t").join(often, "h").groupBy("t").agg(F.collect_set(F.struct("h", "split")).alias("often")), "often")  # at most a text's own anchors
    bits = spark.sparkContext.broadcast(bit_map(of.select("t"), "t", s.map_bits))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(3)
        for batch in batches:
            tid, pack = [], []
            for t in batch.column(0).to_pylist():
                data = packed_text(t)
                d = hashlib.blake2b(data, digest_size=16).digest()
                if len(data) >= s.length and _marked(bits.value, d, s.map_bits):
                    tid.append(d)
                    pack.append(z.compress(data))
            yield pa.RecordBatch.from_arrays([pa.array(tid, pa.binary()), pa.array(pack, pa.binary())], names=["tid", "pack"])

    content = df.select(F.col(text_col).alias("_text")).mapInArrow(packed, "tid binary, pack binary")
    content = written(content.groupBy("tid").agg(F.first("pack").alias("pack")), "content", "none")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = zstandard.ZstdDecompressor()
        for batch in batches:
            rows: list = []
            for r in batch.to_pylist():
                for start, g, seg in segments(u.decompress(r["pack"]), {x["h"]: x["split"] for x in r["often"]}, s):
                    rows.append((r["tid"], start, g, hashlib.blake2b(seg, digest_size=16).digest(), seg))
                    if len(rows) >= 20_000:
                        yield cut_rows(rows)
                        rows = []
            if rows:
                yield cut_rows(rows)

    found = content.withColumn("t", F.xxhash64("tid")).join(of, "t").select("tid", "pack", "often")
    found = written(found.mapInArrow(cut, SEGMENTS), "segments")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of g. Gives the runs of repeated strings of each segment that has any."""
        schema = pa.schema([("g", pa.int64()), ("sid", pa.binary()), ("n", pa.int64()), ("runs", pa.list_(pa.int32()))])
        group: list[tuple] = []
        block: list[tuple] = []
        size = 0

        def close_group() -> None:
            nonlocal size
            for g, sid, n, seg in group:
                block.append((g, sid, n, seg, len(group) > 1))
                size += len(seg)
            group.clear()

        def close_block() -> pa.RecordBatch:
            nonlocal size
            search = [x for x in block if x[4]]
            hits = dict(zip((x[1] for x in search), repeats([x[3] for x in search], s.length), strict=True)) if search else {}
            out = []
            for g, sid, n, seg, _ in block:
                cover = [0, len(seg) - s.length + 1] if n > 1 else runs(hits[sid]) if sid in hits else []
                if cover:
                    out.append({"g": g, "sid": sid, "n": n, "runs": cover})
            block.clear()
            size = 0
            return pa.RecordBatch.from_pylist(out, schema)

        for batch in batches:
            for g, sid, n, seg in zip(*(batch.column(k).to_pylist() for k in ("g", "sid", "n", "seg")), strict=True):
                if group and group[0][0] != g:
                    close_group()
                    if size >= s.block:
                        yield close_block()
                group.append((g, sid, n, seg))
        close_group()
        if block:
            yield close_block()

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments cut into their strings, each with a key of its own."""
        for batch in batches:
            rows = []
            for tid, start, seg in zip(*(batch.column(k).to_pylist() for k in ("tid", "start", "seg")), strict=True):
                for i in range(len(seg) - s.length + 1):
                    one = seg[i : i + s.length]
                    rows.append((tid, start + i, xxhash.xxh64_intdigest(one, 1) - (1 << 63), hashlib.blake2b(one, digest_size=16).digest(), one))
                    if len(rows) >= 20_000:
                        yield cut_rows(rows)
                        rows = []
            if rows:
                yield cut_rows(rows)

    full = written(found.groupBy("g", "sid").agg(F.count(F.lit(1)).alias("n")).groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("c")).where(F.col("m") > s.crowded), "crowded")
    if full.limit(1).count():
        fine = even_join(found, full.select("g", "c"), ["g"], "c").mapInArrow(strings, SEGMENTS)
        found = written(found.join(full.select("g"), "g", "left_anti").unionByName(fine), "segments")
    distinct = found.groupBy("g", "sid").agg(F.count(F.lit(1)).alias("n"), F.first("seg").alias("seg"))
    marks = written(distinct.repartition("g").sortWithinPartitions("g").mapInArrow(compared, "g long, sid binary, n long, runs array<int>"), "marks")
    cover = even_join(found.select("tid", "start", "g", "sid"), marks, ["g", "sid"], "n").groupBy("tid").agg(F.collect_list(F.struct("start", "runs")).alias("cover"))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = zstandard.ZstdDecompressor()
        schema = pa.schema([("tid", pa.binary()), ("removed", pa.int64()), ("spans", pa.int64()), ("kept", pa.string())])
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                data = u.decompress(r["pack"])
                edge = np.zeros(len(data) + 1, np.int32)
                for c in r["cover"]:
                    for a, b in zip(c["runs"][::2], c["runs"][1::2], strict=True):
                        edge[c["start"] + a] += 1
                        edge[c["start"] + b - 1 + s.length] -= 1
                gone = np.cumsum(edge)[:-1] > 0
                out.append({"tid": r["tid"], "removed": int(gone.sum()), "spans": len(runs(gone)) // 2, "kept": hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest()})
            yield pa.RecordBatch.from_pylist(out, schema)

    trimmed = content.join(cover, "tid").mapInArrow(kept, "tid binary, removed long, spans long, kept string")
    texts = base.groupBy("tid").agg(F.count(F.lit(1)).alias("rows"))
    done = here.keep(written(texts.join(trimmed, "tid", "left"), "trimmed"))
    whole = (F.col("rows") > 1) & (F.col("n_bytes") >= s.length)
    return even_join(base.select(F.col(id_col).alias("_id"), "n_bytes", "tid", "sha"), done, ["tid"], "rows").select(
        F.col("_id").alias(id_col),
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, hashlib.sha256().hexdigest()).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


def _marked(bits: bytes, tid: bytes, n: int) -> bool:
    """Whether the map has the bit of the value that Spark's xxhash64 gives for this text's digest."""
    t = xxhash.xxh64_intdigest(tid, 42)
    return _flag(bits, t, n)


def _flag(bits: bytes, value: int, n: int) -> bool:
    at = xxhash.xxh64_intdigest(value.to_bytes(8, "little"), 42) % n
    byte, bit = ((at - 1) // 8, (at - 1) % 8) if at else (len(bits) - 4096, 0)
    return bool(bits[byte] >> bit & 1)
