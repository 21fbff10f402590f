"""Media columns: payloads kept as content-defined chunks, each chunk once, and put together again from ordered chunk lists.

A rolling gear hash cuts a payload where its top bits are zero, so equal stretches of different payloads give equal chunks.
Chunk digests are deduplicated by joins: the first payload that has a chunk owns it and stores its bytes. A payload's
stored form is its manifest, the ordered list of lengths and digests, followed by its chunks as 8-bit samples; both are
stored as they are (Parquet's pages compress them) and read back as they are, a chunk from whichever payload owns it.
Equal payloads have one manifest and are stored once. Reading verifies every chunk against its digest.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeplane.llm.common import bit_map, even_join, map_texts, scratch, written

MAGIC = b"LPM1"


@dataclass(frozen=True)
class Settings:
    #: Payloads are padded with bytes 255 up to a positive multiple of this.
    unit: int = 576
    #: A cut follows where this many top bits of the gear hash are zero, within these chunk lengths.
    cut_bits: int = 11
    least: int = 512
    most: int = 16_384
    #: Bits of the maps that let most payloads skip the joins; they bound the broadcast and never change a result.
    map_bits: int = 1 << 23


@cache
def gear() -> np.ndarray:
    """256 spread-out 32-bit numbers from a mixing rule."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(27))) >> np.uint64(16)).astype(np.uint32)


def cuts(payload: bytes, s: Settings) -> list[int]:
    """Ends of the chunks. The hash of a place takes in the 32 bytes up to it: h = (h << 1) + gear[byte]."""
    h = gear()[np.frombuffer(payload, np.uint8)]
    for k in (1, 2, 4, 8, 16):
        if len(h) > k:
            h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    ends, last = [], 0
    for e in (np.flatnonzero(h < np.uint32(1 << (32 - s.cut_bits))) + 1).tolist():
        while e - last > s.most:
            last += s.most
            ends.append(last)
        if e - last >= s.least:
            last = e
            ends.append(e)
    while len(payload) - last > s.most:
        last += s.most
        ends.append(last)
    if last < len(payload):
        ends.append(len(payload))
    return ends


def padded(text: str | None, s: Settings) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (max(1, -(-len(raw) // s.unit)) * s.unit - len(raw)), len(raw)


#: Of a manifest: a chunk's length and digest.
ENTRY = np.dtype([("length", "<u4"), ("digest", "V16")])


def manifest(payload: bytes, s: Settings) -> bytes:
    """The ordered list of a payload's chunks: a mark, their number, and length and digest of each."""
    ends = cuts(payload, s)
    digests = [hashlib.blake2b(payload[a:b], digest_size=16).digest() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    lengths = [b - a for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    return MAGIC + struct.pack("<I", len(ends)) + b"".join(struct.pack("<I", n) + d for n, d in zip(lengths, digests, strict=True))


def entries(data: bytes) -> tuple[list[int], list[bytes]]:
    """Lengths and digests of a manifest."""
    if data[: len(MAGIC)] != MAGIC or len(data) != len(MAGIC) + 4 + struct.unpack_from("<I", data, len(MAGIC))[0] * ENTRY.itemsize:
        raise ValueError("the manifest is damaged")
    e = np.frombuffer(data, ENTRY, offset=len(MAGIC) + 4)
    return e["length"].tolist(), [x.tobytes() for x in e["digest"]]


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def flagged(bits: bytes, key: bytes, n: int) -> bool:
    """As common.bit_map sets them: bit pmod(xxhash64(key), n), counted from 1; bit 0 has the last 4 KB."""
    at = xxhash.xxh64_intdigest(key, 42) % n
    byte, bit = ((at - 1) // 8, (at - 1) % 8) if at else (len(bits) - 4096, 0)
    return bool(bits[byte] >> bit & 1)


#: Of the store: a manifest's digest, the manifest, how many rows have it, the chunks it owns (null: all), and their bytes in order.
STORE = "recipe binary, manifest binary, n long, held array<int>, pack binary"
_STORE = pa.schema([("recipe", pa.binary()), ("manifest", pa.binary()), ("n", pa.int64()), ("held", pa.list_(pa.int32())), ("pack", pa.binary())])


def store(df: DataFrame, id_col: str, text_col: str, s: Settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Writes recipes and the chunk store. Returns (recipe of each row, store, foreign chunk references).

    A text is chunked twice: for the list of chunks, and, once it is known which are shared, for the store.
    """
    spark = df.sparkSession

    def recipes():
        def run(texts: list) -> list:
            out = []
            for t in texts:
                payload, n = padded(t, s)
                m = manifest(payload, s)
                out.append((n, len(payload), digest(m), entries(m)[1]))
            return [list(c) for c in zip(*out, strict=True)] or [[]] * 4

        return run

    of = written(map_texts(df, [id_col], F.col(text_col), recipes, "n_bytes long, payload_bytes long, recipe binary, digests array<binary>"), "recipes")
    distinct = of.groupBy("recipe").agg(F.count(F.lit(1)).alias("n"), F.first("digests").alias("digests"))
    chunks = distinct.select("recipe", F.posexplode("digests").alias("ord", "digest"))
    owners = chunks.groupBy("digest").agg(F.min(F.struct("recipe", "ord")).alias("own"), F.count(F.lit(1)).alias("c")).where("c > 1")
    foreign = written(chunks.join(owners, "digest").where(F.struct("recipe", "ord") != F.col("own")).select("recipe", "ord", "digest"), "foreign")
    bits = spark.sparkContext.broadcast(bit_map(distinct.where("n > 1").select("recipe").union(foreign.select("recipe")), "recipe", s.map_bits))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole payloads; without a set bit a recipe is unique and owns all its chunks."""
        for batch in batches:
            out = []
            for t in batch.column(0).to_pylist():
                payload, _ = padded(t, s)
                m = manifest(payload, s)
                r = digest(m)
                out.append((r, m, payload, flagged(bits.value, r, s.map_bits)))
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.binary()) for c in cols[:3]), pa.array(cols[3], pa.bool_())], names=["recipe", "manifest", "pack", "shared"])

    packs = written(df.select(F.col(text_col).alias("_text")).mapInArrow(packed, "recipe binary, manifest binary, pack binary, shared boolean"), "chunks")

    def owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                gone = set(r.pop("gone") or ())
                r["held"] = None
                if gone:
                    payload, at, keep = r["pack"], 0, []
                    lengths, _ = entries(r["manifest"])
                    for k, n in enumerate(lengths):
                        if k not in gone:
                            keep.append(payload[at : at + n])
                        at += n
                    r["held"] = [k for k in range(len(lengths)) if k not in gone]
                    r["pack"] = b"".join(keep)
                out.append(r)
            yield pa.RecordBatch.from_pylist(out, _STORE)

    one = packs.where("shared").groupBy("recipe").agg(F.first(F.struct("manifest", "pack")).alias("r"), F.count(F.lit(1)).alias("n")).select("recipe", "r.manifest", "n", "r.pack")
    gone = foreign.groupBy("recipe").agg(F.collect_list("ord").alias("gone"))  # at most a payload's own chunks
    rest = written(one.join(gone, "recipe", "left").mapInArrow(owned, STORE), "shared")
    whole = packs.where("not shared").select("recipe", "manifest", F.lit(1).cast("long").alias("n"), F.lit(None).cast("array<int>").alias("held"), "pack")
    return of, whole.unionByName(rest), foreign


def read(stored: DataFrame, foreign: DataFrame, s: Settings) -> DataFrame:
    """The rows of the store with `lent`, the chunks that other payloads own: by join."""
    bits = stored.sparkSession.sparkContext.broadcast(bit_map(foreign.select("digest"), "digest", s.map_bits))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, data = [], []
            for r in batch.to_pylist():
                at = 0
                lengths, digests = entries(r["manifest"])
                for k in range(len(lengths)) if r["held"] is None else r["held"]:
                    if flagged(bits.value, digests[k], s.map_bits):
                        of.append(digests[k])
                        data.append(r["pack"][at : at + lengths[k]])
                    at += lengths[k]
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.binary()), pa.array(data, pa.binary())], names=["digest", "data"])

    lent = foreign.join(stored.select("manifest", "held", "pack").mapInArrow(wanted, "digest binary, data binary"), "digest")
    lent = lent.groupBy("recipe").agg(F.collect_list(F.struct("ord", "data")).alias("lent"))  # at most a payload's own bytes
    full = stored.where("held is null").withColumn("lent", F.expr("cast(null as array<struct<ord: int, data: binary>>)"))
    return full.unionByName(stored.where("held is not null").join(lent, "recipe"))


def assemble(r: dict) -> bytes:
    """The payload of a row of read(); a missing or changed chunk raises."""
    lengths, digests = entries(r["manifest"])
    pack, at, parts = r["pack"], 0, {x["ord"]: x["data"] for x in r["lent"] or ()}
    for k in range(len(lengths)) if r["held"] is None else r["held"]:
        parts[k] = pack[at : at + lengths[k]]
        at += lengths[k]
    for k, d in enumerate(digests):
        if k not in parts or digest(parts[k]) != d:
            raise ValueError(f"chunk {k} of {r['recipe'].hex()} is damaged")
    return b"".join(parts[k] for k in range(len(digests)))


def feature(payload: bytes) -> str:
    """Mean, deviation and entropy of the 8-bit samples."""
    n = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p, v = n / n.sum(), np.arange(256)
    mean = float(p @ v)
    q = p[p > 0]
    return f"{mean:.4f}:{max(0.0, float(p @ (v * v)) - mean * mean) ** 0.5:.4f}:{float(-(q * np.log2(q)).sum()):.4f}"


def media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """Stores each row's text as padded 8-bit samples, reads the stored chunks back and describes what was read.

    Returns id_col, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature. Null counts as
    empty, whose payload is one unit of padding. Equal texts give equal values. Repeated rows, and rows without an id, are
    described each; an empty table gives no rows. A very long text is one payload of many chunks. Other columns are ignored.
    """
    with scratch(df.sparkSession) as here:
        of, stored, foreign = store(df, id_col, text_col, s)

        def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for r in batch.to_pylist():
                    payload = assemble(r)
                    whole = r["manifest"] + payload  # every byte of it comes from the store
                    out.append({"recipe": r["recipe"], "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-32:]), "media_bytes": len(whole), "media_sha256": hashlib.sha256(whole).hexdigest(), "feature": feature(payload), "n": r["n"]})
                yield pa.RecordBatch.from_pylist(out, pa.schema(list(_DESCRIBED.items())))

        done = here.keep(written(read(stored, foreign, s).mapInArrow(described, DESCRIBED), "described"))
        rows = here.keep(of).select(id_col, "n_bytes", "payload_bytes", "recipe")
        return even_join(rows, done, ["recipe"], "n").select(id_col, "n_bytes", "payload_bytes", *list(_DESCRIBED)[1:-1])


DESCRIBED = "recipe binary, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n long"
_DESCRIBED = {"recipe": pa.binary(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "n": pa.int64()}
