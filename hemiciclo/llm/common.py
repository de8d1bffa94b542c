"""What the operators share: reading tables, Arrow batches of bounded size, sizes checked before broadcasts."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

ROWS_PER_BATCH = 1000
#: Ids of 8 bytes: 8 MB when broadcast.
BROADCAST_IDS = 1_000_000
#: The driver holds the hash table of a broadcast and its blocks, some 100 bytes an id: more ids than these don't pass through it.
DRIVER_IDS = 200_000
_SEPARATORS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def schema_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def batch_of(columns: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def map_batches(df: DataFrame, function: Callable[[dict[str, list]], dict[str, list] | None], schema: str) -> DataFrame:
    """Apply ``function`` to batches of rows given as columns of Python values.

    A batch has at most ROWS_PER_BATCH rows, so a task holds few texts at a time. None: no rows.
    """
    kind = schema_of(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_PER_BATCH):
                out = function(batch.slice(start, ROWS_PER_BATCH).to_pydict())
                if out is not None:
                    yield batch_of(out, arrow)
        pa.default_memory_pool().release_unused()

    return small_batches(df).mapInArrow(run, kind)


def small_batches(df: DataFrame) -> DataFrame:
    """Texts may be long: let Spark hand over fewer rows at once than its default of 10,000.

    Python workers are also told where this package lies, in case they start in another folder.
    """
    conf, known = df.sparkSession.conf, df.sparkSession.sparkContext.environment
    root = str(Path(__file__).resolve().parents[2])
    if root not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known.get("PYTHONPATH")]))
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ROWS_PER_BATCH:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    return df


def lean() -> None:
    """Give what this worker has freed back to the machine, from now on large blocks as soon as they are freed.

    Workers serve one stage after the other, and the C library would keep each stage's peak.
    """
    pa.default_memory_pool().release_unused()
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        libc.malloc_trim(0)
    except (OSError, AttributeError):  # another C library, which has its own ways
        pass


def with_struct(df: DataFrame, columns: str | list[str], function: Callable[..., list], name: str, kind: str) -> DataFrame:
    """``df`` with one more column ``name`` of the struct type ``kind``, made from ``columns`` of a batch.

    ``function`` gets a list of values for each column. The other columns pass through as they are.
    """
    read = [columns] if isinstance(columns, str) else columns
    fields = schema_of(kind)
    schema = T.StructType([*df.schema.fields, T.StructField(name, fields)])
    struct = to_arrow_schema(T.StructType([T.StructField(name, fields)])).field(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_PER_BATCH):
                part = batch.slice(start, ROWS_PER_BATCH)
                made = pa.array(function(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in read)), struct.type)
                yield pa.RecordBatch.from_arrays([*part.columns, made], schema=part.schema.append(struct))
        pa.default_memory_pool().release_unused()

    return small_batches(df).mapInArrow(run, schema)


def of_ids(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose key is (``left_anti``: isn't) in ``ids``.

    The ids are broadcast only if a count shows that there are few; else both sides are shuffled, and the
    rows of ``df`` are looked up in a hash table of a task's ids, without a sort.
    """
    return df.join(ids.hint("broadcast" if ids.count() <= DRIVER_IDS else "shuffle_hash"), key, how)


def spaced_words(text: str | None) -> list[bytes]:
    """Words between white space (0x20, 0x09 to 0x0D) of a text, as UTF-8."""
    return text.encode().split() if text else []


def plain_words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of anything beyond ASCII, with A-Z lower-cased, as UTF-8."""
    return text.encode().translate(_SEPARATORS).split() if text else []


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
