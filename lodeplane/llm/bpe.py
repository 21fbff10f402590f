"""Byte-level BPE encoding and decoding with Spark higher-order functions.

Texts are cut into words by the vocabulary's pattern. A word's bytes are an array of ids; a fold merges, step by step, the
leftmost pair of the lowest rank, with ranks in a literal table. Every distinct word of all texts that is no token itself is
folded once. For that, texts are dealt into chunks of a bounded size, each with a dictionary of its own words: a text becomes
places in its chunk's dictionary, and the dictionary's words go, packed, one pack a share, to shares of all words by their
hash. A share's task folds its distinct words once and answers each pack with a pack of ids, in the order of its words, which
goes back to the chunk, whose texts lie in buckets and are not shuffled. So no word is a row of a shuffle. Only words longer
than any prose has are merged where they stand, by a heap over the same ranks, as a fold's time grows with the square of a
word's length. Decoding concatenates the binary pieces of the ids, from a literal array.

Ranks are read on the driver from a file given by path, and travel in the plan as literals of fixed size.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeplane.llm.common import literal_array, modest_batches, scratch, setting, written

# Fixed value: the code points that the pattern's \s stands for (Unicode's White_Space).
WHITE = "\\t\\n\\u000b\\f\\r \\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: More than any rank.
NONE = 1 << 30
#: Bits of an id in the fold, and of an id with its place in the word, which has at most 1,024 bytes.
ID, LOW = 17, 28


@dataclass(frozen=True)
class Settings:
    #: Longer words (in bytes) are merged by the heap: the fold is quadratic in a word's length, the heap n log n.
    longest: int = 1024
    #: Characters of the texts that share a dictionary, about; a longer text has one of its own.
    chunk: int = 1 << 24


@dataclass(frozen=True)
class Vocabulary:
    ranks: dict[bytes, int]
    pattern: str

    def java_pattern(self) -> str:
        return self.pattern.replace("[^\\s", f"[^{WHITE}").replace("\\s", f"[{WHITE}]").replace("\\S", f"[^{WHITE}]")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:  # a vocabulary of the driver's installation, not an input table
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: lowest rank first, leftmost among equals, with a heap: n log n in the word's length."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    if n <= 24:
        return _short(word, ranks)
    end, before, after, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n

    def pair(i: int) -> tuple[int, int, int] | None:
        j = after[i]
        r = ranks.get(word[i : end[j]]) if j < n else None
        return None if r is None else (r, i, end[j])

    heap = [x for i in range(n) if (x := pair(i))]
    heapq.heapify(heap)
    while heap:
        _, i, e = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or end[j] != e:
            continue
        end[i], after[i], alive[j] = e, after[j], False
        if after[j] < n:
            before[after[j]] = i
        heap_new = [pair(i), pair(before[i]) if before[i] >= 0 else None]
        for x in heap_new:
            if x:
                heapq.heappush(heap, x)
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = after[i]
    return out


def _short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for a short word: ranks of the pairs in a list, of which a merge changes two."""
    get = ranks.get
    cut = list(range(len(word) + 1))
    low = [get(word[k : k + 2], NONE) for k in range(len(word) - 1)]
    while low:
        m = min(low)
        if m == NONE:
            break
        k = low.index(m)
        del cut[k + 1], low[k]
        if k < len(low):
            low[k] = get(word[cut[k] : cut[k + 2]], NONE)
        if k:
            low[k - 1] = get(word[cut[k - 1] : cut[k + 1]], NONE)
    return [ranks[word[a:b]] for a, b in zip(cut, cut[1:])]


def laid_pairs(pairs: dict[int, dict[int, int]], edge: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the row of each first id starts, and all rows laid over each other: (first << ID | merged) at start + second."""
    n, draw = edge + 1, np.random.default_rng(0)
    size = 2 * sum(map(len, pairs.values())) + n
    free, starts = np.ones(size + n, bool), np.zeros(n, np.int64)
    for a in sorted(pairs, key=lambda a: (-len(pairs[a]), a)):
        seconds = np.array(sorted(pairs[a]))
        for tries in range(50):
            at = np.arange(size) if len(seconds) > 32 or tries > 20 else draw.integers(size, size=64)
            for x in seconds:
                at = at[free[at + x]]
            if len(at):
                break
        else:
            raise ValueError("the rank table doesn't take all pairs")
        starts[a] = at[0]
        free[at[0] + seconds] = False
    table = np.full(int(starts.max()) + n, n << ID, np.int64)
    for a, row in pairs.items():
        table[starts[a] + np.array([*row])] = (a << ID) | np.array([*row.values()])
    return starts, table


@lru_cache(maxsize=2)
def rank_tables(entries: tuple[tuple[bytes, int], ...]) -> tuple[np.ndarray, np.ndarray, dict[str, str]]:
    """starts and table of laid_pairs for a vocabulary's entries, and its words that are a token although their merges end elsewhere.

    These take seconds and some 90 MB to make, so a driver makes them once for a vocabulary; what stays are a few MB.
    """
    ranks = dict(entries)
    pairs = defaultdict(dict)
    for t, r in ranks.items():
        for k in range(1, len(t)):
            a, b = ranks.get(t[:k]), ranks.get(t[k:])
            if a is not None and b is not None:
                pairs[a][b] = r
    whole = {}
    for t, r in ranks.items():
        if len(t) > 1 and merge_by_rule(t, ranks) != [r]:
            try:
                whole[t.decode()] = str(r)
            except UnicodeDecodeError:
                pass
    return *laid_pairs(pairs, max(ranks.values()) + 1), whole


class Literals:
    """The vocabulary's rank table as literal arrays, and the fold that uses it.

    Each array stands in a plan once, bound to a lambda variable.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        ranks = vocabulary.ranks
        self.edge = max(ranks.values()) + 1  # an id that no pair has
        if self.edge >= 1 << 16:
            raise ValueError("ids over 65,534 don't fit the fold's numbers")
        starts, table, whole = rank_tables(tuple(ranks.items()))
        self.starts, self.table = literal_array(starts), literal_array(table)
        self.bytes = literal_array([ranks.get(bytes([x]), NONE) for x in range(256)])
        # Words that are a token although their merges end elsewhere: the token is meant.
        self.whole = whole

    def fold(self, word: Column) -> Column:
        """Ids of a word as decimals joined by commas: the fold of ranked merges over its bytes."""
        return let(self.starts, lambda starts: let(self.table, lambda table: self._fold(word, starts, table)))

    def _fold(self, word: Column, starts: Column, table: Column) -> Column:
        """The state is one array with, of each part of the word, (rank of its pair with the next part << LOW | place << ID | id).

        So the least element is the leftmost pair of the lowest rank, and its rank is the merged id. An edge on either side
        has a part's neighbours exist. Expressions within lambdas are interpreted: their number is the fold's time.
        """
        one, two, far = F.lit(1), F.lit(2), F.lit(NONE)
        none, id_bits, low_bits, place_bits = (F.lit(x).cast("bigint") for x in (1 << (ID + LOW), (1 << ID) - 1, (1 << LOW) - 1, (1 << LOW) - (1 << ID)))

        def rank(a: Column, b: Column) -> Column:
            # an entry of another first id leaves more than any rank
            return F.get(table, F.get(starts, a) + b).bitwiseXOR(F.shiftleft(a, ID))

        def step(parts: Column, _: Column) -> Column:
            def least(low: Column) -> Column:
                def at(p: Column) -> Column:
                    # p: place of the pair, from 2; only the ranks of the two pairs beside it change
                    merged, before, after = F.shiftright(low, LOW), F.get(parts, p - two), F.get(parts, p + one)
                    left = F.shiftleft(rank(before.bitwiseAND(id_bits), merged), LOW).bitwiseOR(before.bitwiseAND(low_bits))
                    made = F.shiftleft(rank(merged, after.bitwiseAND(id_bits)), LOW).bitwiseOR(low.bitwiseAND(place_bits)).bitwiseOR(merged)
                    return joined(F.slice(parts, one, p - two), F.array(left, made), F.slice(parts, p + two, far))

                return F.when(low >= none, parts).otherwise(let(F.array_position(parts, low).cast("int"), at))

            return let(F.array_min(parts), least)

        latin = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")  # one character per byte
        edge = F.lit(self.edge).cast("bigint")
        start = joined(F.array(edge), F.transform(F.split(latin, ""), lambda c: F.get(self.bytes, F.ascii(c))), F.array(edge))

        def run(ids: Column) -> Column:
            first = F.transform(F.slice(ids, one, F.size(ids) - one), lambda a, i: F.shiftleft(rank(a, F.get(ids, i + one)), LOW).bitwiseOR(F.shiftleft(i, ID).cast("bigint")).bitwiseOR(a))
            last = F.array(F.lit((1 << (ID + LOW + 1)) + self.edge).cast("bigint"))
            return F.aggregate(ids, joined(first, last), step, lambda parts: F.array_join(F.transform(F.slice(parts, two, F.size(parts) - two), lambda x: x.bitwiseAND(id_bits)).cast("array<string>"), ","))

        return let(start, run)

    def encode_word(self, word: Column) -> Column:
        out = self.fold(word)
        for w, r in self.whole.items():
            out = F.when(word == w, F.lit(r)).otherwise(out)
        return out


def decode(ids: Column, vocabulary: Vocabulary) -> Column:
    """Bytes of decimal ids joined by commas: their binary pieces, from a literal array, concatenated."""
    pieces = [""] * (max(vocabulary.ranks.values()) + 1)
    for t, r in vocabulary.ranks.items():
        pieces[r] = t.hex()
    table = literal_array(pieces)
    return F.unhex(F.when(ids == "", "").otherwise(F.array_join(F.transform(F.split(ids, ",").cast("array<int>"), lambda x: F.get(table, x)), "")))


def let(value: Column, body) -> Column:
    """body of value, which is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def joined(*arrays: Column) -> Column:
    return F.flatten(F.array(*arrays))


def merge_by_rule(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merges of a word from its bytes up, as the fold does them, one step after another."""
    parts = [word[k : k + 1] for k in range(len(word))]
    while len(parts) > 1:
        low, k = min((ranks.get(parts[k] + parts[k + 1], NONE), k) for k in range(len(parts) - 1))
        if low == NONE:
            break
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return [ranks[x] for x in parts]


@cache
def _zip() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(3)


@cache
def _unzip() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def packed_places(at: list[int] | np.ndarray) -> bytes:
    """Places in a dictionary, byte plane by byte plane, so that the mostly empty high bytes cost nothing."""
    planes = np.asarray(at, "<u4").view(np.uint8).reshape(-1, 4).T
    return _zip().compress(np.ascontiguousarray(planes).tobytes())


def places(pack: bytes) -> list[int]:
    planes = np.frombuffer(_unzip().decompress(pack), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u4").tolist()


def packed_words(words: list[bytes]) -> bytes:
    """Words of any bytes: how many, their lengths, and all of them in a row."""
    return _zip().compress(b"".join([len(words).to_bytes(8, "little"), np.fromiter(map(len, words), "<u4", len(words)).tobytes(), *words]))


def unpacked_words(pack: bytes) -> pa.LargeStringArray:
    raw = _unzip().decompress(pack)
    n = int.from_bytes(raw[:8], "little")
    ends = np.zeros(n + 1, np.int64)
    np.cumsum(np.frombuffer(raw, "<u4", n, 8), out=ends[1:])
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(ends), pa.py_buffer(raw[8 + 4 * n :]))


def packed_ids(ids: list[str]) -> bytes:
    return _zip().compress("\n".join(ids).encode())


def unpacked_ids(pack: bytes) -> list[str]:
    return _unzip().decompress(pack).decode().split("\n")


@cache
def _ranges(name: str) -> str:
    """Code points up to 65,535 with a Unicode property, by the regex library's version, as ranges in a set of a pattern."""
    had = [ord(c) for c in regex.findall(name, "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000))]
    starts = [c for c, before in zip(had, [-2, *had]) if c != before + 1]
    ends = [c for c, after in zip(had, [*had[1:], -2]) if c + 1 != after]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends, strict=True))


def plain_pattern(pattern: str) -> str | None:
    """For texts without code points over 65,535: the pattern with sets instead of properties, which re runs faster than regex.

    None where re could read what is left of the pattern in a way of its own.
    """
    out, inside = [], False
    for x in re.split(r"(\\p\{\w+\}|\\.|\[|\])", pattern):
        if x.startswith("\\p"):
            out.append(_ranges(x) if inside else f"[{_ranges(x)}]")
            continue
        if (len(x) == 2 and x[0] == "\\" and x[1].isalnum() and x[1] not in "tnfru") or re.search(r"\(\?[^!=:]|[.^$*+?}][+]", x):
            return None
        inside = (inside or x == "[") and x != "]"
        out.append(x)
    return "".join(out)


def finder(pattern: str) -> Callable[[str], list[str]]:
    """All matches of the pattern in a text."""
    find, plain = regex.compile(pattern).findall, plain_pattern(pattern)
    if plain is None:
        return find
    quick = re.compile(plain).findall
    # two bytes for each code point, so that none is over 65,535
    return lambda t: quick(t) if len(t.encode("utf-16-le", "surrogatepass")) == 2 * len(t) else find(t)


def encode(df: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """id_col, ids (decimals joined by commas) and n_tokens of each row's whole text.

    Null counts as empty, which has no ids. Strings that other vocabularies treat as special are ordinary text. Very long
    words are merged in n log n time; a very long text is a chunk of its own. Repeated rows, and rows without an id, are
    encoded each; an empty table gives no rows. Other columns are ignored. Letters and digits are those of the regex
    library's Unicode version.
    """
    if settings.longest > 2000:
        raise ValueError("the fold numbers the bytes of a word up to 2,000")
    spark = df.sparkSession
    modest_batches(spark)
    lit = Literals(vocabulary)
    ranks = spark.sparkContext.broadcast(vocabulary.ranks)  # of fixed size
    pattern, id_type = vocabulary.java_pattern(), df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # kinds of a chunk's packs besides those of its texts (null) and of its words (the share, from 0)
    shares, own = -1, -2

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A chunk's packs: of each text its places in the chunk's dictionary, of each share its words, in the order of their places,
        of all places their shares, and the ids of the words that are tokens or too long, whose share is `tasks`."""
        find, known, type_ = finder(pattern), ranks.value, None
        local: dict[str, int] = defaultdict()
        local.default_factory = local.__len__  # a new word gets the next place
        chunk, size = TaskContext.get().partitionId() << 32, 0

        def batch_of(b: pa.Array, ids: pa.Array, packs: list[bytes], at: list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), b, ids, pa.array(packs, pa.binary())], names=["p", "b", "_id", "pack"])

        def dictionary() -> Iterator[pa.RecordBatch]:
            dealt, ids, share = defaultdict(list), [], []
            for x in local:
                raw = x.encode()
                r = known.get(raw)
                if r is None and len(raw) <= settings.longest:
                    b = zlib.crc32(raw) % tasks
                    dealt[b].append(raw)
                else:
                    b = tasks
                    ids.append(str(r) if r is not None else ",".join(map(str, merge(raw, known))))
                share.append(b)
            if share:
                kinds, packs = [*dealt, shares, own], [*map(packed_words, dealt.values()), packed_places(share), packed_ids(ids)]
                yield batch_of(pa.array(kinds, pa.int32()), pa.nulls(len(kinds), type_), packs, [chunk] * len(kinds))
            local.clear()

        for batch in batches:
            type_ = batch.column("_id").type
            at, packs = [], []
            for t in batch.column("_text").to_pylist():
                at.append(chunk)
                words = find(t)
                packs.append(packed_places(np.fromiter(map(local.__getitem__, words), "<u4", len(words))))
                size += len(t)
                if size >= settings.chunk:
                    yield from dictionary()
                    chunk, size = chunk + 1, 0
            yield batch_of(pa.nulls(len(at), pa.int32()), batch.column("_id"), packs, at)
        yield from dictionary()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct words of each share, numbered, and of each of its packs the numbers of its words."""
        names = ["b", "i", "w", "p", "at"]
        shares_: dict[int, tuple[list[int], list[pa.Array]]] = defaultdict(lambda: ([], []))
        for batch in batches:
            for p, b, pack in zip(*(batch.column(c).to_pylist() for c in ("p", "b", "pack")), strict=True):
                shares_[b][0].append(p)
                shares_[b][1].append(unpacked_words(pack))
        for b, (chunks, packs) in shares_.items():
            words = pa.concat_arrays(packs).dictionary_encode()
            for start in range(0, len(words.dictionary), 10_000):
                w = words.dictionary[start : start + 10_000].cast(pa.string())
                n = len(w)
                yield pa.RecordBatch.from_arrays([pa.array([b] * n, pa.int32()), pa.array(range(start, start + n), pa.int32()), w, pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names=names)
            numbers, start = words.indices.to_numpy(), 0
            for p, x in zip(chunks, packs, strict=True):
                at = packed_places(numbers[start : start + len(x)])
                start += len(x)
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.string()), pa.array([p], pa.int64()), pa.array([at], pa.binary())], names=names)

    def answer(share: pa.Table) -> pa.Table:
        """Of each of a share's packs of words the pack of their ids."""
        asks = pc.is_valid(share["at"])
        asked, words = share.filter(asks), share.filter(pc.invert(asks))
        table: list[str | None] = [None] * words.num_rows
        for i, ids in zip(words["i"].to_pylist(), words["ids"].to_pylist(), strict=True):
            table[i] = ids
        packs = [packed_ids([*map(table.__getitem__, places(x))]) for x in asked["at"].to_pylist()]
        return pa.table([asked["p"], asked["b"], pa.array(packs, pa.binary())], names=["p", "b", "pack"])

    def put(texts: pa.Table, found: pa.Table) -> pa.Table:
        """A chunk's texts from their places; the ids of its dictionary are its own and those found, each share's in the order of places."""
        packed = texts.filter(pc.is_null(texts["b"]))
        packs = dict(zip(found["b"].to_pylist(), found["pack"].to_pylist(), strict=True))
        kinds = {b: x for b, x in zip(texts["b"].to_pylist(), texts["pack"].to_pylist(), strict=True) if b is not None}
        table: list[str] = []
        if kinds:
            packs[tasks] = kinds[own]
            share = np.array(places(kinds[shares]), np.int64)
            order, sizes = np.argsort(share, kind="stable"), np.bincount(share, minlength=tasks + 1).tolist()
            got = [unpacked_ids(packs[b]) if n else [] for b, n in enumerate(sizes)]
            if [*map(len, got)] != sizes:
                raise ValueError("a chunk has words without ids")
            ids = np.empty(len(share), object)
            ids[order] = [x for some in got for x in some]
            table = ids.tolist()
        out = [",".join(map(table.__getitem__, places(x))) for x in packed["pack"].to_pylist()]
        n = [x.count(",") + (x != "") for x in out]
        return pa.table([packed["_id"], pa.array(out, pa.string()), pa.array(n, pa.int64())], names=["_id", "ids", "n_tokens"])

    with scratch(spark) as here:
        # by chunk, so that the texts, which are most of all bytes, are written once and never shuffled
        made = here.keep(written(rows.mapInArrow(cut, f"p long, b int, _id {id_type}, pack binary"), "cut", buckets=(tasks, "p")))
        words = made.where("b >= 0").select("p", "b", "pack").repartitionById(tasks, "b").mapInArrow(meet, "b int, i int, w string, p long, at binary")
        with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
            words = written(words, "words", buckets=(tasks, "b"))
        # from buckets the plan has no exchange: without an adaptive plan its text, which holds the rank table, is then kept once
        with short_plan_texts(spark), setting(spark, "spark.sql.adaptive.enabled", "false"):
            folded = words.select("b", "i", "p", "at", F.when(F.col("w").isNotNull(), lit.encode_word(F.col("w"))).alias("ids"))
            found = here.keep(written(folded.groupBy("b").applyInArrow(answer, "p long, b int, pack binary"), "found"))
        met = made.where("b is null or b < 0").groupBy("p").cogroup(found.groupBy("p")).applyInArrow(put, f"_id {id_type}, ids string, n_tokens long")
        return met.withColumnRenamed("_id", id_col)


def short_plan_texts(spark):
    """For an action whose plan has large literals: Spark keeps the texts of a thousand plans in the driver's memory."""
    return setting(spark, "spark.sql.maxPlanStringLength", "65536")


def digest_columns(vocabulary: Vocabulary) -> dict[str, Column]:
    """The digest of the ids and the digest of the decoded bytes, over a column ids."""
    ids = F.col("ids")
    return {"ids_sha256": F.sha2(ids.cast("binary"), 256), "decoded_sha256": F.sha2(decode(ids, vocabulary), 256)}


def digests(encoded: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id") -> DataFrame:
    """Tokens and digests of each encoded row."""
    return encoded.select(id_col, "n_tokens", *(c.alias(n) for n, c in digest_columns(vocabulary).items()))
