"""Shuffled shards by a two-pass external shuffle, in DataFrame functions only.

Pass one scatters records over buckets with a seeded hash; the number of buckets follows
from the bytes, so a bucket fits in memory at any size of the table. Pass two shuffles
each bucket (``shuffle`` is a Fisher-Yates shuffle of an array) and writes it. The
written buckets, one after the other, are one random order of the table; it is dealt to
the shards in turn, so shard sizes are at most one row apart and slots have no gaps.

Defined results: a NULL text is empty; an empty table gives empty shards; repeated rows
are scattered one by one, since the hash also takes a row's place in the stored input;
columns of any name are kept. Where written records have a column ``shard`` or ``slot``
themselves (in any case), the added one takes underscores behind its name.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickersift.functions.scratch import staged

# A task holds a bucket or a few of them as arrays.
BUCKET_BYTES = 8 << 20

# A row of a bucket's first place takes some 20 bytes: up to this many buckets, 20 MB are copied to every task.
BROADCAST_BUCKETS = 1 << 20


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def shuffled_shards(
    docs: DataFrame, shards: int, seed: int = 0, id_column: str = "doc_id", text_column: str = "text", bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """``record`` (a struct of all columns), shard and slot, in a random order set by the seed.

    ``docs`` is a stored table. It is read once for its bytes and once to scatter it. A bucket is
    one shuffle partition, so give larger ones for tables of many terabytes (``1 << 28`` makes 400,000 of 100 TB).
    """
    size = docs.select(F.sum(text_bytes(F.col(text_column)) + 64)).first()[0] or 0
    buckets = max(1, -(-size // bucket_bytes))
    place = F.xxhash64(F.lit(seed), F.col(id_column), F.monotonically_increasing_id())
    scattered = docs.select(F.struct(*docs.columns).alias("record"), place.alias("place"))
    scattered = scattered.withColumn("bucket", F.pmod(F.col("place"), F.lit(buckets)).cast("int"))
    # Sorted, so that a bucket is the same array, and gets the same shuffle, whenever its task runs.
    sorted_rows = scattered.repartition(buckets, "bucket").sortWithinPartitions("bucket", "place")
    arrays = sorted_rows.groupBy("bucket").agg(F.collect_list("record").alias("records"))
    shuffled = arrays.select("bucket", F.posexplode(F.shuffle("records", seed)).alias("position", "record"))
    written = staged(shuffled, "shard-buckets")
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = written.groupBy("bucket").agg(F.count("*").alias("n"))
    starts = counts.select("bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    order = F.col("start") + F.col("position")
    dealt = written.join(F.broadcast(starts) if buckets <= BROADCAST_BUCKETS else starts, "bucket")
    return dealt.select(
        "record", F.pmod(order, F.lit(shards)).cast("int").alias("shard"), F.floor(order / shards).cast("bigint").alias("slot")
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, with the records' columns and their slot."""
    names = sharded.schema["record"].dataType.names
    shard, slot = unused("shard", names), unused("slot", names)
    record_columns = [F.col("record")[c].alias(c) for c in names]
    numbered = sharded.select(*record_columns, F.col("shard").alias(shard), F.col("slot").alias(slot))
    numbered.write.partitionBy(shard).parquet(path)


def unused(name: str, names: Iterable[str]) -> str:
    """``name``, with underscores behind it while one of ``names`` equals it in any case."""
    taken = {n.lower() for n in names}
    while name.lower() in taken:
        name += "_"
    return name
