"""Global shuffle into shards by two passes over external storage (DataFrame functions only).

Pass 1 scatters the records uniformly into memory-sized buckets by a seeded hash: bucket k is partition k of Spark's
shuffle files. Pass 2 takes one bucket at a time into memory, in the order of its records' hashes, shuffles it (Spark's
``shuffle`` is a Fisher-Yates whose random numbers seed and partition decide, and here a partition is a bucket) and writes
it. The buckets, one after the other, are a uniform permutation of all records; its position p goes to shard p mod n at
slot p div n, so that the law ``rows`` holds: the counts of any two shards differ by one at most. Seed, number of buckets
and the records alone decide that order, not the files, partitions or tasks that they come in.

Defined cases: a null text has size 16 and the checksum of the empty text; repeated rows are different records and all
stay; rows without an id are scattered like others; an empty table gives no rows. Other columns are carried where the
caller asks for them, of any type (map columns too), and may have any name but ``shard``, ``slot`` and those starting with ``__``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline.llm.common import small, stored, table, unsigned_crc32

SHARDS = 40
#: Bytes and records that one bucket holds on average, at most; and buckets at least.
BUCKET_BYTES, BUCKET_ROWS, LEAST_BUCKETS = 16 << 20, 50_000, 16
#: Rows of a file of a written shard, about.
FILE_ROWS = 20_000
#: Equal records up to which they may share a bucket.
COPIES = 5000


def bucket_count(rows: int, size: int) -> int:
    return max(LEAST_BUCKETS, math.ceil(rows / BUCKET_ROWS), math.ceil(size / BUCKET_BYTES))


def shuffled(records: DataFrame, seed: int, size: str = "size", buckets: int | None = None) -> DataFrame:
    """records with ``__position``, 0 to n - 1 in a uniform random order that seed and the records decide.

    A record's key is the hash of all its fields as JSON, so equal records would share a bucket; those with more than
    COPIES copies, or with more bytes than a bucket, which are too few for a table of their hashes to be large, are
    counted, made anew and hashed with the number of their copy. So no bucket grows with the number of records or copies, and the order stays the same
    whichever copy comes first.
    """
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in records.columns]), {"ignoreNullFields": "false"})
    base = stored(records.select(F.struct("*").alias("__record"), F.xxhash64(F.lit(seed), whole).alias("__hash")), "shard-records")
    if buckets is None:
        rows, total = base.agg(F.count("*"), F.coalesce(F.sum(f"__record.{size}"), F.lit(0))).first()
        buckets = bucket_count(rows, total)
    keyed = base.select("__record", F.col("__hash").alias("__key"))
    copied = base.groupBy("__hash").agg(F.count("*").alias("__n"), F.sum(f"__record.{size}").alias("__bytes"))
    many = stored(copied.filter((F.col("__n") > COPIES) | (F.col("__n") > 1) & (F.col("__bytes") > BUCKET_BYTES)).select("__hash"), "shard-copies")
    if not many.isEmpty():
        hot = base.join(small(many, 8), "__hash", "left_semi").groupBy("__hash", F.to_json("__record", {"ignoreNullFields": "false"}).alias("__json"))
        copies = hot.agg(F.first("__record").alias("__record"), F.count("*").alias("__n")).select("__record", "__hash", F.explode(F.sequence(F.lit(1).cast("long"), "__n")).alias("__copy"))
        keyed = base.join(small(many, 8), "__hash", "left_anti").select("__record", F.col("__hash").alias("__key")).union(copies.select("__record", F.xxhash64("__hash", "__copy")))
    placed = keyed.withColumn("__bucket", F.pmod(F.xxhash64(F.lit(seed), "__key"), F.lit(buckets)).cast("int"))
    # One row for each bucket, a few thousand of them for each terabyte.
    before = F.coalesce(F.sum("__count").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = stored(placed.groupBy("__bucket").agg(F.count("*").alias("__count")).select("__bucket", before.alias("__start")), "shard-starts")
    bucket = placed.repartitionById(buckets, "__bucket").sortWithinPartitions("__key").groupBy("__bucket").agg(F.collect_list("__record").alias("__all"))
    mixed = bucket.select("__bucket", F.shuffle("__all", seed).alias("__all"))
    each = mixed.join(small(starts, 12), "__bucket").select("__start", F.posexplode("__all").alias("__at", "__one"))
    return each.select("__one.*", (F.col("__start") + F.col("__at")).alias("__position"))


def shard(records: DataFrame, shards: int = SHARDS, seed: int = 7, size: str = "size") -> DataFrame:
    """records with ``shard`` and ``slot``, gapless from 0 in each shard; counts differ by one at most."""
    out = shuffled(records, seed, size)
    n = F.lit(shards).cast("long")
    at = F.col("__position")
    return out.select(*records.columns, F.pmod(at, n).cast("int").alias("shard"), F.floor(at / n).cast("long").alias("slot"))


def sharded(docs: DataFrame, shards: int = SHARDS, seed: int = 7) -> DataFrame:
    """All columns of docs, whole texts among them, shuffled, with ``shard`` and ``slot``."""
    sized = docs.withColumn("__size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16)
    return shard(sized, shards, seed, "__size").drop("__size")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = 7) -> None:
    """All columns of docs, shuffled, as one folder of Parquet files for each shard, in slot order within a file."""
    out = sharded(docs, shards, seed)
    out.repartition("shard", F.floor(F.col("slot") / FILE_ROWS)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and checksum are those of the texts that arrive in the shards."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    return sharded(table(spark, sf_dir, "documents")).select(
        "doc_id", size.alias("size"), unsigned_crc32(F.col("text")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
