"""Helpers shared by the training-data operators: table access, staged tables, words."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.session import ensure_checkpoint_dir

# Words are runs of characters that are not ASCII white space.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
# A run of white space that is not already one plain space; replacing only these
# gives the same text as replacing every run and leaves most matches untouched.
UNEVEN_SPACE = r"\x20[\x20\x09-\x0D]+|[\x09-\x0D][\x20\x09-\x0D]*"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_SCOPES = threading.local()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet under the cluster's shared checkpoint folder and
    read it back: computed once however often it is read, lineage cut, and safe
    when executors are lost. Inside ``staging`` the folder is deleted at the scope's end;
    else it stays, as the result that reads it may be used at any time."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    for paths in getattr(_SCOPES, "open", [])[-1:]:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside (by this thread, and not by an inner scope) are deleted at the end: write what reads them inside."""
    paths: list[str] = []
    scopes = _SCOPES.open = getattr(_SCOPES, "open", [])
    scopes.append(paths)
    try:
        yield
    finally:
        scopes.remove(paths)
        for path in paths:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def texts_for(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The columns as text, null as null: pandas would turn whole numbers beside nulls into doubles."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def kinds_of(df: DataFrame, like: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Back from text to the kinds that columns have in ``like``. columns: name here -> name there."""
    return df.withColumns({c: F.col(c).cast(like.schema[k].dataType) for c, k in columns.items()})


def even_spaces(text: Column) -> Column:
    """Null as empty; each run of white space becomes one space (no trimming)."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), UNEVEN_SPACE, " ")


def hashed_fraction(*cols: Column) -> Column:
    """A repeatable uniform number in [0, 1) from the 64-bit hash of the columns (53 bits)."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))
