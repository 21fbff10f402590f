"""Cutting lineage, and joins whose broadcast side is checked for its size."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a side may have to be broadcast in a nested loop: some 60 bytes each, 12 MB.
BROADCAST_ROWS = 200_000
#: Rows of one block of a side beyond that.
BLOCK_ROWS = 100_000


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the shared folder that the cluster names; a temporary one only for a local master."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the one that spark.checkpoint.dir names, or, of a local master only, a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodeplane-"))
    return sc.getCheckpointDir()


def all_pairs(left: DataFrame, right: DataFrame, on: Column | None = None) -> DataFrame:
    """Each row of left with each of right that `on` allows: the theta joins of the exact operators.

    A right side of up to BROADCAST_ROWS rows is broadcast. A larger one is dealt into blocks of BLOCK_ROWS rows, to each
    of which left is sent, so memory stays bounded and the work spreads over left partitions x blocks.
    """
    n = right.limit(BROADCAST_ROWS + 1).count()
    if n <= BROADCAST_ROWS:
        joined = spread(left).join(F.broadcast(right), on) if on is not None else spread(left).crossJoin(F.broadcast(right))
        return joined
    blocks = -(-right.count() // BLOCK_ROWS)
    dealt = right.withColumn("_block", F.pmod(F.xxhash64(*right.columns), F.lit(blocks)).cast("int"))
    sent = left.withColumn("_sent", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    joined = sent.join(dealt, (F.col("_sent") == F.col("_block")) if on is None else (F.col("_sent") == F.col("_block")) & on)
    return joined.drop("_block", "_sent")


def spread(df: DataFrame) -> DataFrame:
    """A nested loop's streamed side over all cores: its few input partitions would leave most of them idle."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def within(left: DataFrame, right: DataFrame, key: str, other: str, block: int = BLOCK_ROWS // 50) -> DataFrame:
    """Each row of left with each of right whose `other` equals its `key`, no key's rows in one task.

    Both sides of a key are dealt into blocks of about `block` rows and each two blocks meet in a task of their own. The
    counts are one row per key.
    """
    many = right.groupBy(F.col(other).alias("_key")).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks"))
    deal = lambda df, c: df.join(many, df[c] == F.col("_key")).drop("_key").withColumn("_own", F.pmod(F.xxhash64(*df.columns), F.col("_blocks")).cast("int"))
    l, r = deal(left, key), deal(right, other)
    to = F.sequence(F.lit(0), F.col("_blocks") - 1)
    l = l.withColumn("_other", F.explode(to)).drop("_blocks").withColumnsRenamed({"_own": "_lb", "_other": "_rb"})
    r = r.withColumn("_other", F.explode(to)).drop("_blocks").withColumnsRenamed({"_own": "_rb2", "_other": "_lb2"})
    return l.join(r, (l[key] == r[other]) & (F.col("_lb") == F.col("_lb2")) & (F.col("_rb") == F.col("_rb2"))).drop("_lb", "_rb", "_lb2", "_rb2")
