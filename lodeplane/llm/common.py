"""What the operators share: tables, shared storage, fixed-size bit maps and bounded samples."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column as ClassicColumn

from lodeplane.workers import reach


#: Texts can be long: with Spark's defaults a batch and what is made of it fill a worker's memory. (setting, value, Spark's default)
BATCH = [("spark.sql.execution.arrow.maxRecordsPerBatch", "1000", "10000"), ("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20), None)]


def modest_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for the session, unless it has numbers of its own. Results are lazy, so the settings must stay."""
    for key, value, default in BATCH:
        if spark.conf.get(key, default) == default or (default is None and spark.sparkContext.getConf().get(key) is None):
            spark.conf.set(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reach(spark)
    modest_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="lodeplane-")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one, but only for a local master."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return named or _own_dir()


_open: ContextVar[list[Scratch]] = ContextVar("open_scratches", default=[])


class Scratch:
    """Paths of tables written inside a `with scratch(spark)`, and those that stay when it ends."""

    def __init__(self) -> None:
        self.paths: list[str] = []
        self.kept: list[str] = []

    def keep(self, df: DataFrame) -> DataFrame:
        """df, a table that written() gave, stays for whoever reads the result; an enclosing scratch may delete it."""
        self.kept.append(df._lodeplane_path)
        return df


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Deletes the tables written inside at the end, but for those kept; what the result still reads must be kept."""
    here, outer = Scratch(), _open.get()
    token = _open.set([*outer, here])
    try:
        yield here
    finally:
        _open.reset(token)
        for path in here.paths:
            if path not in here.kept:
                where = spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        if outer:
            outer[-1].paths.extend(here.kept)


def written(df: DataFrame, what: str, codec: str = "zstd", buckets: tuple[int, str] | None = None) -> DataFrame:
    """Cuts lineage: df as a Parquet table in the shared folder, read again by its known schema.

    buckets: so many, by this column; what needs that column's rows together then reads them without a shuffle. Spark keeps
    buckets of tables only, so the catalog holds it until it has been looked up.
    """
    spark = df.sparkSession
    name = f"lodeplane-{what}-{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    if _open.get():
        _open.get()[-1].paths.append(path)
    if buckets:
        df.write.bucketBy(*buckets).option("path", path).option("compression", codec).saveAsTable(name.replace("-", "_"), format="parquet")
        out = spark.table(name.replace("-", "_"))
        spark.sql(f"DROP TABLE {name.replace('-', '_')}")  # of a table with a path, its files stay
    else:
        df.write.option("compression", codec).parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
    out._lodeplane_path = path
    return out


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the actions inside, and what it was before after them."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


#: A key is hot where it holds more than one part in HOT of all rows, and more than HOT rows.
HOT = 1000


def even_join(left: DataFrame, right: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Inner join of left with right, a written table of one row per key with the count of left's rows of that key.

    The rows of hot keys stay where they are and meet a broadcast of right's rows: by the meaning of hot fewer than HOT
    keys, whatever the input. The others are shuffled by key. No key's rows meet in one task but for cold ones.
    """
    row = right.agg(F.sum(count).alias("total"), F.max(count).alias("most")).first()
    total = row.total or 0
    if not total or row.most <= HOT or row.most * HOT <= total:
        return left.join(right, keys)
    hot = (F.col(count) > HOT) & (F.col(count) * HOT > total)
    return left.join(F.broadcast(right.where(hot)), keys).unionByName(left.join(right.where(~hot), keys))


def crc_mod(id_col: str, n: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def id_sample(df: DataFrame, id_col: str, bound: int) -> DataFrame:
    """The `bound` rows of the smallest hashed ids: a bounded sample that is the same for any partitioning."""
    return df.orderBy(F.xxhash64(id_col), id_col).limit(bound)


def bit_map(df: DataFrame, col: str, bits: int = 1 << 23) -> bytes:
    """A map of `bits` bits (1 MB by default, whatever the rows) with the bit of each value's hash set.

    Only a filter before an exact join: a bit set for another value costs time, never a result.
    """
    at = F.pmod(F.xxhash64(col), F.lit(bits))
    parts = (
        df.select(F.bitmap_bucket_number(at).alias("b"), F.bitmap_bit_position(at).alias("p"))
        .groupBy("b")
        .agg(F.bitmap_construct_agg("p").alias("m"))
    )
    out = bytearray(bits // 8 + 4096)
    for row in parts.collect():  # bits / 32768 rows of 4 KB at most
        # bucket 1 holds the values 1 to 32768, and a value's bit position is (value - 1) mod 32768
        start = (row.b - 1) * 4096
        if start >= 0:
            out[start : start + 4096] = row.m
        else:
            out[-4096:] = row.m
    return bytes(out)


def literal_array(values: np.ndarray | list[int] | list[str]) -> Column:
    """A literal array of whole numbers or of strings, none null, in Spark's binary form.

    Of any other literal array, the driver writes each element into every text of a plan, level by level of the expressions
    around it, and keeps one boxed. Of this one, texts have a short name, and tasks get its bytes.
    """
    n = len(values)
    head = n.to_bytes(8, "little") + bytes(-(-n // 64) * 8)  # the count, and no bit of a null
    if n and isinstance(values[0], str):
        kind, raw = "string", [v.encode() for v in values]
        sizes = np.fromiter(map(len, raw), "<i8", n)
        room = -(-sizes // 8) * 8
        slots = (len(head) + 8 * n + np.cumsum(room) - room << 32) | sizes
        body = b"".join([slots.tobytes(), *(x.ljust(k, b"\0") for x, k in zip(raw, room.tolist(), strict=True))])
    else:
        kind, body = "bigint", np.asarray(values, "<i8").tobytes()
    jvm = SparkContext._active_spark_context._jvm
    array = jvm.org.apache.spark.sql.catalyst.expressions.UnsafeArrayData()
    array.pointTo(head + body, jvm.org.apache.spark.unsafe.Platform.BYTE_ARRAY_OFFSET, len(head + body))
    types = jvm.org.apache.spark.sql.types.DataTypes
    type_ = types.createArrayType(types.StringType if kind == "string" else types.LongType, False)
    return ClassicColumn(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(jvm.org.apache.spark.sql.catalyst.expressions.Literal(array, type_)))


def map_texts(df: DataFrame, keep: list[str], text: Column, task: Callable[[], Callable[[list], list]], fields: str) -> DataFrame:
    """Columns made from a text column in Arrow batches: one pass, no shuffle; `keep` columns go through unchanged.

    task() runs once per task and returns a function from a batch's texts to one list or array per field. fields: DDL.
    """
    modest_batches(df.sparkSession)
    kept = [f"_k{k}" for k in range(len(keep))]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), fields])
    types = [ARROW[f.split()[1]] for f in fields.split(", ")]
    names = [*keep, *(f.split()[0] for f in fields.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = task()
        for batch in batches:
            made = work(batch.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(x, t) for x, t in zip(made, types, strict=True))], names=names)

    return df.select(*(F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)), text.alias("_text")).mapInArrow(run, schema)


ARROW = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64()), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<binary>": pa.list_(pa.binary())}


def parts(texts: list, chars: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of a batch with about `chars` characters each, or one longer text."""
    start = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > chars:
            yield start, k
            start, size = k, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
