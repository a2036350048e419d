"""What the training-data operators share: tables, the shared scratch folder, text batches."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (local masters
    only) a temporary folder of this process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return found or _own_dir()


@cache
def _own_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='tidemark-')}"


def scratch(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/tidemark-{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: later stages read it again from there,
    so neither lineage nor a lost executor brings the work back."""
    at = scratch(df.sparkSession, what)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of whole texts stay small enough for a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def release_memory() -> None:
    """Gives what a Python worker has freed back to the machine: workers that wait for the next
    stage would hold it beside those that run."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def ascii_lower(c: Column | str) -> Column:
    """A-Z only, whatever the locale."""
    return F.translate(c, UPPER, LOWER)


def by_chars(pdf: pd.DataFrame, col: str = "text", limit: int = 1_000_000) -> Iterator[pd.DataFrame]:
    """Slices of about ``limit`` characters at most (one longer text alone)."""
    ends = pdf[col].str.len().fillna(0).cumsum().to_numpy()
    at = 0
    while at < len(pdf):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(ends.searchsorted(base + limit, side="right")))
        yield pdf.iloc[at:to]
        at = to


def _all(df_columns: list[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in df_columns]


def boxed(df: DataFrame, *needed: str) -> DataFrame:
    """All columns in one struct, and beside it those that an operator reads: whatever names the
    operator gives to its own columns, they don't meet the caller's."""
    return df.select(F.struct(*_all(df.columns)).alias("__row"), *_all(list(needed)))


def unboxed(df: DataFrame, columns: list[str], **results: Column) -> DataFrame:
    """The caller's columns again, then the results; one of the caller's that is named like a
    result gives way to it."""
    made = df.select("__row", F.struct(*[v.alias(k) for k, v in results.items()]).alias("__made")) if results else df
    return made.select(*[F.col(f"__row.`{c}`").alias(c) for c in columns if c not in results], *[F.col(f"__made.{k}").alias(k) for k in results])


BLOOM_BITS = 1 << 26  # 8 MB at most, whatever the number of keys
_PAGE = 1 << 15


def _bit(key: Column | str) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("bloom")), F.lit(BLOOM_BITS))


def bloom(keys: DataFrame, key: str) -> DataFrame:
    """A Bloom filter of ``key`` as a table of pages of 32768 bits: BLOOM_BITS bits in all, so
    that it may be broadcast."""
    at = _bit(key)
    return written(keys.select(F.floor(at / _PAGE).alias("__page"), (at % _PAGE).alias("__at")).groupBy("__page").agg(F.bitmap_construct_agg("__at").alias("__bits")), "bloom")


def in_bloom(rows: DataFrame, key: str, pages: DataFrame, inside: bool = True) -> DataFrame:
    """Rows whose key may be in the filter (those that are in it all stay), or the others."""
    at = _bit(key)
    byte = F.conv(F.hex(F.substr("__bits", F.floor(at % _PAGE / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    found = rows.join(F.broadcast(pages), F.floor(at / _PAGE) == F.col("__page"), "left").filter(hit if inside else ~hit)
    return found.drop("__page", "__bits")
