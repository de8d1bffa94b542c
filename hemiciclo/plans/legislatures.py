"""Queries over legislatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hemiciclo.operators.paging import Listing, ascending
from hemiciclo.operators.predicates import MAX_LIMIT, legislature_code
from hemiciclo.plans.initiatives import headers
from hemiciclo.schemas import INFO_BASE_RAW, PART_FIELD, SOURCE

COLUMNS = ["legislatura", "sigla", "dtini", "dtfim", "num_deputados", "num_grupos"]


def described_legislatures(info_base: DataFrame) -> DataFrame:
    """Dates and sizes from the base documents, which may come in parts.

    A list is measured by one of its fields, which is then all that is read of it.
    """
    return info_base.groupBy("legislatura").agg(
        F.min("DetalheLegislatura.sigla").alias("sigla"),
        F.min("DetalheLegislatura.dtini").alias("dtini"),
        F.max("DetalheLegislatura.dtfim").alias("dtfim"),
        F.sum(F.array_size("Deputados.DepCadId")).cast("bigint").alias("num_deputados"),
        F.sum(F.array_size("GruposParlamentares.sigla")).cast("bigint").alias("num_grupos"),
    )


def dated_legislatures(initiatives: DataFrame) -> DataFrame:
    """What the initiatives alone tell: a code and the earliest start date."""
    return headers(initiatives).groupBy("legislatura").agg(F.min("data_inicio_leg").alias("dtini")).select(
        "legislatura", F.col("legislatura").alias("sigla"), "dtini", F.lit(None).cast("date").alias("dtfim"),
        F.lit(None).cast("bigint").alias("num_deputados"), F.lit(None).cast("bigint").alias("num_grupos"),
    )


def list_legislatures(
    info_base: DataFrame, initiatives: DataFrame, *, limit: int = MAX_LIMIT, offset: int = 0
) -> Listing:
    """Falls back to the initiatives if there are no base documents (a one-row probe decides)."""
    rows = dated_legislatures(initiatives) if info_base.isEmpty() else described_legislatures(info_base)
    return Listing(rows, ascending("legislatura"), COLUMNS, limit, offset)


def records(info_base: DataFrame) -> DataFrame:
    """The nested base document of each legislature, one row each: partial documents are put together.

    Their lists are joined in the order of the parts. A record holds a parliament's seats, circles and
    groups; `deputados`, `circulos` and `partidos` have them as rows.
    """
    part = F.coalesce(PART_FIELD, F.lit(0))
    kept = [f.name for f in INFO_BASE_RAW.fields if not isinstance(f.dataType, T.ArrayType)]
    lists = [f.name for f in INFO_BASE_RAW.fields if isinstance(f.dataType, T.ArrayType)]

    def joined(name: str) -> Column:
        parts = F.sort_array(F.collect_list(F.when(F.col(name).isNotNull(), F.struct(part.alias("part"), F.col(name).alias("items")))))
        return F.flatten(F.transform(parts, lambda p: p["items"]))

    whole = info_base.groupBy("legislatura").agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), part)).alias(c) for c in kept],
        *[F.when(F.count(c) > 0, joined(c)).alias(c) for c in lists], F.first(SOURCE, ignorenulls=True).alias(SOURCE),
    )
    return whole.select(*INFO_BASE_RAW.names, SOURCE, "legislatura")


def legislature(info_base: DataFrame, legislatura: str) -> DataFrame:
    """The nested base document of a legislature; no row if there is none."""
    return records(info_base.where(F.col("legislatura") == legislature_code(legislatura)))


def legislature_status(info_base: DataFrame, initiatives: DataFrame) -> DataFrame:
    """(legislatura, status): `described`, or `no_metadata` where only initiatives are known.

    A legislature that isn't listed is unknown.
    """
    known = headers(initiatives).select("legislatura", F.lit(0).alias("described"))
    described = info_base.select("legislatura", F.lit(1).alias("described"))
    return known.unionByName(described).groupBy("legislatura").agg(
        F.when(F.max("described") == 1, "described").otherwise("no_metadata").alias("status")
    )
