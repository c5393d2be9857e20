"""Sharding by a two-pass external shuffle (operator 7).

Pass one gives every record a seeded hash and scatters the records uniformly
over buckets that fit in a task's memory (Spark's exchange is the scatter);
pass two shuffles each bucket by Fisher-Yates (``shuffle()`` on the bucket's
array) and lays the buckets end to end. Cutting that order into equal runs
gives the shards: their counts differ by one at most (law ``rows``).

The hash is taken of the seed, the record's id and its place in the input, so
no id, text or source, however frequent, can fill a bucket: a bucket's size is
that of ``bucket_bytes`` of records chosen at random. Only the number of rows
per bucket (one small row each) meets in one place.

Defined results: NULL texts have size 16 and checksum 0; repeated rows and
equal ids are placed one by one; an empty table gives no rows; fewer rows
than shards leave shards empty. Other columns travel along untouched; an input
column named like a result is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shoptally.llm.common import materialize, pack, unpack

OVERHEAD = 16
BUCKET_BYTES = 32 << 20
MAX_BUCKET_ROWS = 200_000
SHARDS = 40
SEED = 20240229


def scatter(df: DataFrame, key: Column, text: Column, seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """The rows with ``size``, ``text_crc32`` and the seeded hash ``_r``."""
    text = F.coalesce(text, F.lit(""))
    df = pack(df, keep, _key=key, _text=text)
    return df.select("_row", (F.octet_length("_text") + OVERHEAD).cast("long").alias("_size"),
                     F.crc32(F.col("_text").cast("binary")).alias("_crc"),
                     F.xxhash64(F.lit(seed), F.col("_key"), F.monotonically_increasing_id()).alias("_r"))


def shard_rows(df: DataFrame, key: Column, text: Column, shards: int = SHARDS, seed: int = SEED,
               bucket_bytes: int = BUCKET_BYTES, keep: list[str] | None = None) -> DataFrame:
    """The rows (all input columns, or those in ``keep``) with ``size``, ``text_crc32``, ``law`` (``rows``), ``shard``
    and ``slot``. The scattered records are written once to the shared
    checkpoint folder: bucket counts and the shuffle read the same hashes."""
    if shards < 1 or bucket_bytes < 1:
        raise ValueError("shards and bucket_bytes must be positive")
    records = materialize(scatter(df, key, text, seed, keep), "shards", "zstd")
    n, size = records.agg(F.count(F.lit(1)), F.coalesce(F.sum("_size"), F.lit(0))).first()
    buckets = max(1, -(-size // bucket_bytes), -(-n // MAX_BUCKET_ROWS))
    bucket = F.pmod("_r", F.lit(buckets))
    counts = records.groupBy(bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    # a running sum over the buckets' counts: a row per bucket_bytes of input
    counts = counts.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"))
    # buckets lie in ranges, so that the shards come out in order without another exchange
    mixed = (records.select(bucket.alias("_b"), F.struct("_row", "_size", "_crc").alias("_e")).repartitionByRange("_b")
             .groupBy("_b").agg(F.shuffle(F.collect_list("_e"), seed).alias("_all")))
    placed = mixed.join(F.broadcast(counts), "_b").select("_before", F.posexplode("_all").alias("_i", "_e"))
    at = F.col("_before") + F.col("_i")
    # position p is in shard s if floor(s n / shards) <= p < floor((s + 1) n / shards)
    shard = F.expr(f"((_before + _i + 1) * {shards}L - 1) div {max(n, 1)}L")
    out = placed.select("_e.*", at.alias("_at"), shard.alias("_shard"))
    slot = F.expr(f"_at - (_shard * {n}L) div {shards}L")
    return unpack(out, size=F.col("_size"), text_crc32=F.col("_crc"), law=F.lit("rows"), shard=F.col("_shard").cast("int"),
                  slot=slot, grown_shard=F.lit(None).cast("int"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, its rows in slot order. The rows of ``shard_rows``
    lie in ranges of (shard, slot) already: a shard larger than a task is
    several files in order, and nothing is exchanged again."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of the written shards; ``schema`` is that of the frame written."""
    return spark.read.schema(schema).parquet(path)
