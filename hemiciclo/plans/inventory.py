"""What the silver layer holds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hemiciclo.schemas import CORE_DATASETS
from hemiciclo.sources.readers import absent_datasets, read_dataset

CHECKED = (*CORE_DATASETS, "deputados", "partidos", "circulos", "info_base")


def records(name: str) -> Column:
    """How many records a table holds, however many rows they are stored in."""
    if name == "iniciativas":  # a long one comes in parts
        return F.count_if(F.col("parte") == 0)
    if name == "info_base":  # so do the documents of a legislature
        return F.count_distinct("legislatura")
    return F.count(F.lit(1))


def inventory(spark: SparkSession, root: str, names: Sequence[str] = CHECKED) -> DataFrame:
    """(dataset, required, available, n_rows, status): the status is that of the whole layer.

    A lacking core dataset makes it `unhealthy`, another one `degraded`.
    """
    absent = absent_datasets(spark, root, names)
    counts = []
    for name in names:
        rows = read_dataset(spark, root, name, optional=name in absent)
        n = F.lit(None).cast("bigint") if name in absent else records(name)
        counts.append(rows.agg(n.alias("n_rows")).select(
            F.lit(name).alias("dataset"), F.lit(name in CORE_DATASETS).alias("required"),
            F.lit(name not in absent).alias("available"), "n_rows",
        ))
    if not absent:
        status = "healthy"
    else:
        status = "unhealthy" if set(absent) & set(CORE_DATASETS) else "degraded"
    return reduce(DataFrame.unionByName, counts).withColumn("status", F.lit(status))


def coverage(initiatives: DataFrame) -> DataFrame:
    return initiatives.select("legislatura").distinct().orderBy("legislatura")
