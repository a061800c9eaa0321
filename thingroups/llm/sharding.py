"""Contiguous shards of nearly equal bytes, by global prefix sums.

Rows are put in a global order (text digest, then id: equal texts stand together)
by range partitions; the partition number is stored with the row, so that later
steps agree on it whatever is computed again. Each partition's total goes into a
prefix sum over the partitions, which has one row for each of them; a row's global
offset is that of its partition plus the sum before it inside. A row belongs to
the shard whose equal share of all bytes its offset falls into, so every shard is
within one row's size of the target, and many copies of one text cross shards
only where their bytes cross a cut.

Edge cases: a NULL text has no bytes but the row overhead, a NULL checksum, and
stands first; NULL ids stand before other ids of the same text; repeated rows are
placed each, one after the other; with fewer rows than shards some shards are
empty; an empty table gives an empty table; further columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thingroups.llm.common import stored


def text_size(text: Column, overhead: int) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long")


def place(rows: DataFrame, shards: int, order: list[str], size: str = "size") -> DataFrame:
    """Add ``shard`` (0 to shards - 1) and ``slot`` (0, 1, ... in each shard).

    Rows that are equal in all of ``order`` must be equal in size."""
    ranged = rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    ranged = stored(ranged, "ranged")
    inside = Window.partitionBy("part").orderBy(*order)
    # one row for each partition, so the window over all of them is short
    totals = ranged.groupBy("part").agg(F.sum(size).alias("part_bytes"), F.count(F.lit(1)).alias("part_rows"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("part_bytes").over(earlier), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("part_rows").over(earlier), F.lit(0)).alias("rows_before"),
        F.sum("part_bytes").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all_bytes"),
    )
    placed = (
        ranged.withColumns(
            {
                "bytes_inside": F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col(size),
                "row_inside": F.row_number().over(inside) - 1,
            }
        )
        .join(F.broadcast(offsets), "part")
        .withColumn("row", F.col("rows_before") + F.col("row_inside"))
        .withColumn("shard", F.expr(f"cast((bytes_before + bytes_inside) * {int(shards)} div all_bytes as int)"))
    )
    first = placed.groupBy("shard").agg(F.min("row").alias("first_row"))  # one row for each shard
    return placed.join(F.broadcast(first), "shard").select(
        *rows.columns, "shard", (F.col("row") - F.col("first_row")).cast("long").alias("slot")
    )


def shard_documents(documents: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """Every document's shard and slot, with its size and checksum."""
    rows = documents.select(
        "doc_id",
        text_size(F.col("text"), overhead).alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")).alias("digest"),
    )
    return place(rows, shards, ["digest", "doc_id"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
