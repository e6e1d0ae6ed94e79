"""Written tables that are read several times, and lookups by blocks of rows."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows of a block, and the size from which a row is a block of its own: a block is at most their product.
BLOCK_ROWS = 128
BLOCK_SIZE = 1 << 15


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Compute ``df`` once and cut its lineage: write it as parquet into a fresh
    folder under the shared checkpoint folder (``spark.checkpoint.dir``) and read
    it back. Used for small tables read several times (a vocabulary, the
    per-segment summaries of a running total). One job, reliable storage --
    never a local checkpoint or a machine-local folder on a cluster."""
    import os
    import uuid

    from framelake.session import ensure_checkpoint_dir
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark)
    path = os.path.join(base, "framelake", name, uuid.uuid4().hex)
    df.write.parquet(path)
    return spark.read.parquet(path)


def look_up_in_blocks(rows: DataFrame, items: Column, size: Column, table: DataFrame, by: str,
                      fn: Callable[[pa.Table, pa.Table], pa.Table], schema: T.StructType) -> DataFrame:
    """Rows that each look up many items (an array) of ``table`` in its column ``by``: ``fn(block, found)`` gets whole rows by the block and
    the rows of the table that the block's items meet.

    Neither are the items exploded with their rows nor sorted to bring the rows together again: what is shuffled are the rows, once, and
    the distinct items of each block. ``size`` of a row bounds blocks (characters, ids). The rows are written with their
    block numbers, because both sides must see the same blocks.
    """
    n = F.monotonically_increasing_id()
    block = F.when(size > BLOCK_SIZE, -1 - n).otherwise(F.floor(n / BLOCK_ROWS))
    blocks = materialize(rows.withColumn("_block", block), "blocks")
    wanted = blocks.select("_block", F.explode(F.array_distinct(items)).alias(by)).distinct()
    found = wanted.join(table, by).withColumnRenamed("_block", "_of_block")
    return blocks.groupBy("_block").cogroup(found.groupBy("_of_block")).applyInArrow(
        lambda b, f: fn(b.drop_columns(["_block"]), f), schema)
