"""Sharding: a two-pass external shuffle of whole records, in DataFrame functions only.

Pass 1 scatters the records over buckets by seeded hashes: the shard by rendezvous hashing of the id, the bucket in the shard by
another seed, so that a bucket fits into memory. Pass 2 shuffles each bucket by Fisher-Yates and writes it. The buckets of
a shard stand end to end: a small index holds where each begins, so a record's slot is its bucket's begin plus its place there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep_until_the_end, shared_folder

SHARDS = 40
SEED = 20_240_117
#: Rows and UTF-8 bytes of text of a bucket, on average, at most.
BUCKET_ROWS = 20_000
BUCKET_BYTES = 16_000_000
#: Tasks of the scatter at most, and groups of one id and text, dealt to several buckets, that may be broadcast.
MOST_TASKS = 100_000
HOT_KEYS = 50_000


def _draw(doc_id: Column, shard: int | Column, seed: int) -> Column:
    return F.xxhash64(doc_id.cast("string"), F.lit(seed), F.lit(shard) if isinstance(shard, int) else shard)


def shard_of(doc_id: Column, shards: int, seed: int = SEED) -> Column:
    """Rendezvous hashing: the shard with the highest draw for this id. Null ids are drawn for like the rest.

    With one more shard, a row moves only if that shard draws highest, so only into it.
    """
    draws = F.array(*[F.struct(_draw(doc_id, s, seed).alias("d"), F.lit(s).alias("s")) for s in range(shards)])
    return F.array_max(draws)["s"]


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the whole records to ``path``: ``records``, a folder ``shard=N`` for each shard, and ``index``; ``read_shards`` reads them.

    Where a record goes follows from its id, its text and the number of rows and bytes, not from partitions or the cluster. Only
    rows of one id and text that would overfill a bucket are dealt to several as they come. Columns have to be of types
    that can be ordered.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    doc_id, crc = F.col(id_col).cast("string"), F.crc32(text.cast("binary"))
    total = docs.select(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b")).first()
    buckets = max(1, -(-total["n"] // (shards * bucket_rows)), -(-total["b"] // (shards * BUCKET_BYTES)))
    # Rows of one id and text that are more than a bucket holds, in number or bytes, are dealt to as many parts as that takes.
    own = docs.groupBy(doc_id.alias("hot_id"), crc.alias("hot_crc")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text)).alias("b"))
    parts = F.least(F.col("n"), F.greatest(F.ceil(F.col("n") / bucket_rows), F.ceil(F.col("b") / BUCKET_BYTES))).cast("int")
    hot = own.select("hot_id", "hot_crc", parts.alias("parts")).where("parts > 1")
    # There can't be more such groups than whole buckets; where these are many, the groups are counted before they are broadcast.
    if total["n"] // bucket_rows + total["b"] // BUCKET_BYTES <= HOT_KEYS or hot.limit(HOT_KEYS + 1).count() <= HOT_KEYS:
        hot = F.broadcast(hot)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"), F.col(id_col).alias("doc_id"), doc_id.alias("own_id"), crc.alias("crc"), F.monotonically_increasing_id().alias("number"))
    rows = rows.join(hot, F.col("own_id").eqNullSafe(F.col("hot_id")) & (F.col("crc") == F.col("hot_crc")), "left")
    salt = F.coalesce(F.pmod("number", F.col("parts")), F.lit(0))
    placed = rows.select(
        shard_of(F.col("doc_id"), shards, seed).alias("shard"),
        F.pmod(F.xxhash64("own_id", F.lit(seed + 1), "crc", salt), F.lit(buckets)).cast("int").alias("bucket"),
        F.struct("own_id", "crc", "record").alias("entry"),
    )
    # Of so many tasks whatever the session has: their numbers and the order in them decide what the generator of shuffle() draws.
    tasks = min(MOST_TASKS, shards * buckets)
    scattered = placed.repartition(tasks, "shard", "bucket").groupBy("shard", "bucket").agg(F.array_sort(F.collect_list("entry")).alias("rows"))
    shuffled = scattered.sortWithinPartitions("shard", "bucket").select("shard", "bucket", F.shuffle("rows", seed).alias("rows"))
    out = shuffled.select("shard", "bucket", F.posexplode("rows").alias("place", "entry")).select("shard", "bucket", "place", "entry.record")
    out.write.partitionBy("shard").parquet(f"{path}/records")
    spark = docs.sparkSession
    sizes = spark.read.schema("bucket int, place int, shard int").parquet(f"{path}/records").groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).write.parquet(f"{path}/index")


def read_shards(spark: SparkSession, path: str, record: str) -> DataFrame:
    """The records (a struct ``record`` of the given type) with their shard and slot, which counts from 0 in each shard without gaps."""
    rows = spark.read.schema(f"bucket int, place int, record {record}, shard int").parquet(f"{path}/records")
    index = spark.read.schema("shard int, bucket int, base long").parquet(f"{path}/index")
    return rows.join(index, ["shard", "bucket"]).select("record", "shard", (F.col("base") + F.col("place")).alias("slot"))


def assign_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards to the shared folder and return, read from them, a row per record: doc_id, size, text_crc32, law (``key``), shard, slot, grown_shard.

    ``size``: UTF-8 bytes of the text plus 16; a null text counts as empty. Repeated rows stay, in slots of their own; null ids
    are placed like other ids; an empty table gives no rows; other columns are written and left out here.
    """
    spark = docs.sparkSession
    path = keep_until_the_end(spark, f"{shared_folder(spark).rstrip('/')}/shards-{uuid.uuid4().hex}")
    write_shards(docs, path, shards, seed, bucket_rows, id_col, text_col)
    rows = spark.read.schema(f"bucket int, place int, record {docs.schema.simpleString()}, shard int").parquet(f"{path}/records")
    text = F.coalesce(F.col(f"record.`{text_col}`"), F.lit(""))
    rows = rows.select("shard", "bucket", "place", F.col(f"record.`{id_col}`").alias("doc_id"), (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    # Only these few columns move, where the index is too large to be broadcast.
    index = spark.read.schema("shard int, bucket int, base long").parquet(f"{path}/index")
    met = rows.join(index, ["shard", "bucket"])
    best = F.array_max(F.array(*[_draw(F.col("doc_id"), s, seed) for s in range(shards)]))
    grown = F.when(_draw(F.col("doc_id"), shards, seed) > best, F.lit(shards)).otherwise(F.col("shard"))
    return met.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("place")).alias("slot"), grown.cast("int").alias("grown_shard"))
