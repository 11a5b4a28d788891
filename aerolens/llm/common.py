"""What the text operators share: shared-folder tables, size-checked joins, word rules.

A *document* is a row of ``documents(doc_id, text, ...)``.  Words are the runs of
characters outside ``\\x20\\x09-\\x0D``.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ten white-space code points separate words; nothing else does.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: A side of a join is broadcast only below this many rows (and few, short columns).
BROADCAST_ROWS = 20_000
#: Bits of the filter that keeps texts without candidates out of a shuffle: at most 8 MB, broadcast.
MAX_FILTER_BITS = 1 << 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session without one gets one of its own."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = os.path.join(tempfile.gettempdir(), "aerolens-shared")
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def materialise(df: DataFrame, label: str = "t") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends here.

    The files outlive lost executors, so a later stage never recomputes what came
    before, and every reader sees the same rows.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/aerolens/{app}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, also where body's lambdas use it."""
    return F.transform(F.array(value), body)[0]


def lookup_join(big: DataFrame, small: DataFrame, keys: list[str], salt: Column, how: str = "left", parts: int = 64) -> DataFrame:
    """Join a large table with a (materialised) lookup table on a few hot keys.

    Counted first: up to BROADCAST_ROWS rows it is broadcast. Beyond, the large side
    is salted and the lookup table repeated per salt, so that no key is one task's.
    """
    if small.count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), keys, how)
    big = big.withColumn("__salt", F.pmod(F.xxhash64(salt), F.lit(parts)).cast("int"))
    small = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return big.join(small, [*keys, "__salt"], how).drop("__salt")


def possible_rows(rows: DataFrame, wanted: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """rows less many of those whose keys (doc_id) aren't in wanted, without a shuffle of rows.

    A bit for each hashed key, 16 a row of wanted up to MAX_FILTER_BITS in all: a table of
    4 KB bitmaps with a bound, which is broadcast. Beyond, more rows pass; none is lost.
    """
    bits = min(MAX_FILTER_BITS, 1 << max(15, (16 * wanted.count()).bit_length()))
    place = F.pmod(F.xxhash64(*[F.col(k).cast("long") for k in keys or ["doc_id"]]), F.lit(bits))
    maps = wanted.select(F.call_function("bitmap_bucket_number", place).alias("__map"), F.call_function("bitmap_bit_position", place).alias("bit"))
    maps = maps.groupBy("__map").agg(F.call_function("bitmap_construct_agg", F.col("bit")).alias("__bits"))
    bit = F.call_function("bitmap_bit_position", place)
    byte = F.conv(F.hex(F.substring("__bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.call_function("shiftright", byte, (bit % 8).cast("int")).bitwiseAND(1) == 1
    return rows.withColumn("__map", F.call_function("bitmap_bucket_number", place)).join(F.broadcast(maps), "__map").where(found).drop("__map", "__bits")
