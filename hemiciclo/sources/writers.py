"""Clustered, partitioned Parquet writes and their statistics."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from hemiciclo.sources.readers import path_exists
from hemiciclo.sources.shared import shuffles_removed

ROW_GROUP_ROWS = 100_000  # Fixed value.
MAX_ROWS_PER_FILE = 5_000_000
BLOOM_BYTES = 128 * 1024  # 10 bits for each of ROW_GROUP_ROWS keys: one lookup in a hundred is in vain
INPUT_BYTES_PER_TASK = 64 * 2**20  # compressed; several times that once exploded and sorted


def input_bytes(df: DataFrame) -> int:
    """What the optimizer estimates from the sizes of the files left after pruning."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def cluster(df: DataFrame, order: Sequence[Column], task_bytes: int = INPUT_BYTES_PER_TASK) -> DataFrame:
    """Sort each legislature across as many files as its size needs.

    Range partitioning on (legislature, order) cuts a big legislature into several tasks whose
    ranges don't overlap; hashing on the legislature alone would give each to one task. Inputs too
    large for the session's number of shuffle partitions get as many as their bytes ask for; below
    that the number is left to AQE, which joins small partitions.
    """
    keys = [F.col("legislatura").asc(), *order]
    tasks = math.ceil(input_bytes(df) / task_bytes)
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(tasks, *keys) if tasks > usual else df.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*keys)


def write_dataset(
    df: DataFrame, path: str, legislatures: Sequence[str] = (), lookup: Sequence[str] = (),
    records: Callable[[Column], Column] | None = None, strays: str | None = None, closed: bool = False,
    halves: str | None = None,
) -> dict[str | None, int]:
    """Write ``df`` by legislature, replacing the slices it holds and no others.

    Gives the records of each named legislature, counted while writing: its rows, or what ``records``
    makes of the condition that a row is of it. A named one without rows becomes an empty slice.
    Unless ``df`` is known to be ``closed``, to hold named legislatures only, rows of others are kept
    out. They are written to the folder ``strays`` before anything is replaced, in place of those of
    the last such run, and counted under None if there are any. ``lookup`` columns get Bloom filters:
    a point lookup then skips the row groups that don't hold its key. ``halves``, a column of 0 and 1,
    divides a slice's files once more; both halves are replaced together.
    """
    spark, out, others = df.sparkSession, df, 0
    # A slice that wasn't asked for is never replaced: rows of other legislatures go elsewhere, and are told of.
    asked = F.coalesce(F.col("legislatura").isin(list(legislatures)), F.lit(False))
    if legislatures and not closed:
        others = df.where(~asked).count()
        if strays and (others or path_exists(spark, strays)):
            with shuffles_removed(spark):
                _parquet(df.where(~asked) if others else df.limit(0)).parquet(strays)
        if others:
            warnings.warn(f"{others} rows of legislatures other than {', '.join(legislatures)} aren't written to {path}", stacklevel=2)
            out = df.where(asked)
    counted = Observation()
    slices = {leg: F.col("legislatura") == leg for leg in legislatures}
    if halves:
        slices = {f"{leg}/{halves}={k}": mine & (F.col(halves) == k) for leg, mine in slices.items() for k in (0, 1)}
    counts = [F.count_if(mine).alias(name) for name, mine in slices.items()]
    if records is not None:
        counts += [records(F.col("legislatura") == leg).cast("bigint").alias(f"{leg} records") for leg in legislatures]
    writer = _parquet(out.observe(counted, *counts) if counts else out)
    for column in lookup:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", True)
    by = ["legislatura", *([halves] if halves else [])]
    with shuffles_removed(spark):
        writer.option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    for name in slices:
        folder = f"{path}/legislatura={name}"
        # A slice without rows is there and empty, a second half only if it was there before.
        if counted.get[name] == 0 and (not name.endswith("=1") or path_exists(spark, folder)):
            _parquet(df.drop(*by).limit(0)).parquet(folder)
    rows = {leg: sum(counted.get[name] for name in slices if name.split("/")[0] == leg) for leg in legislatures}
    found = rows if records is None else {leg: counted.get[f"{leg} records"] for leg in legislatures}
    return found | ({None: others} if strays and others else {})


def _parquet(df: DataFrame):
    """Bloom filters take the smallest of a few sizes that do, up to what a full row group's keys need."""
    return (
        df.write.mode("overwrite").option("compression", "zstd")
        .option("maxRecordsPerFile", MAX_ROWS_PER_FILE)
        .option("parquet.block.row.count.limit", ROW_GROUP_ROWS)
        .option("parquet.bloom.filter.adaptive.enabled", True)
        .option("parquet.bloom.filter.max.bytes", BLOOM_BYTES)
        .option("parquet.bloom.filter.candidates.number", 3)
    )


def stored_bytes(spark: SparkSession, path: str, legislature: Column) -> DataFrame:
    """Bytes by legislature from the file listing; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(legislature.alias("legislatura"), "length").groupBy("legislatura").agg(
        F.sum("length").alias("bytes")
    )


def legislature_of_slice(path: str = "path") -> Column:
    return F.regexp_extract(path, r"legislatura=(\w+)/", 1)
