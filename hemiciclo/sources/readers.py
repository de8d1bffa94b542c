"""Scans of raw documents and of silver tables."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hemiciclo.schemas import ACTIVITY_RAW, BRONZE, CORE_DATASETS, SILVER, SOURCE

_SUFFIX = {"cap": "csv"}


def legislature_in_path(path: Column) -> Column:
    """'…/iniciativas_l17.json' and '…/leg=L17/part-0.txt' both -> 'L17'."""
    # Only the file's own name or its folder count, not what other folders are called.
    code = r"(?i)(?:/leg=(?=l[0-9]{1,3}/[^/]*$)|_(?=l[0-9]{1,3}\.[^/]*$))(l[0-9]{1,3})"
    return F.upper(F.regexp_extract(path, code, 1))


def path_exists(spark: SparkSession, path: str) -> bool:
    """One call to the file system; a reader would list all files under the path to find out."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def bronze_path(spark: SparkSession, root: str, dataset: str, legislature: str) -> str | None:
    """One file `<dataset>_<leg>.json`, or a folder `<dataset>/leg=<LEG>` of many documents."""
    names = f"{dataset}/leg={legislature}", f"{dataset}_{legislature.lower()}.{_SUFFIX.get(dataset, 'json')}"
    return next((p for p in (f"{root}/{n}" for n in names) if path_exists(spark, p)), None)


def is_packed(spark: SparkSession, path: str) -> bool:
    """Whether a file, or the first of a folder's files that hold anything, is compressed as a whole."""
    hadoop = spark._jvm.org.apache.hadoop
    conf, there = spark._jsc.hadoopConfiguration(), hadoop.fs.Path(path)
    codecs, files = hadoop.io.compress.CompressionCodecFactory(conf), there.getFileSystem(conf).listFiles(there, True)
    while files.hasNext():
        found = files.next()
        if found.getLen() and not found.getPath().getName().startswith(("_", ".")):
            return codecs.getCodec(found.getPath()) is not None
    return False


def declared_shape(kind: T.DataType) -> str:
    """A pattern of what `schema_of_variant` says of values that hold nothing but ``kind`` declares.

    Text takes a value of any shape, as its JSON. Where the shapes of a list's entries don't fit
    together the function says VARIANT, which may hide anything and so matches text alone.
    """
    def bracketed(depth: int) -> str:
        return r"[^<>]*" if depth == 0 else rf"[^<>]*(?:<{bracketed(depth - 1)}>[^<>]*)*"

    if isinstance(kind, T.ArrayType):
        return rf"(?:VOID|ARRAY<{declared_shape(kind.elementType)}>)"
    if isinstance(kind, T.StructType):
        fields = "|".join(f"{re.escape(f.name)}: {declared_shape(f.dataType)}" for f in kind.fields)
        return rf"(?:VOID|OBJECT<(?:(?:{fields})(?:, (?!>)|(?=>)))*>)"
    if isinstance(kind, T.StringType):
        return rf"[A-Z]+(?:\([0-9,]+\)|<{bracketed(9)}>)?"
    return r"[A-Z]+(?:\([0-9,]+\))?"


def undeclared(source: Column, kind: T.DataType) -> Column:
    """``source``, a VARIANT, if it holds a field that ``kind`` doesn't declare; else NULL."""
    return F.when(~F.schema_of_variant(source).rlike(f"^{declared_shape(kind)}$"), source)


def read_documents(spark: SparkSession, dataset: str, paths: str | Sequence[str], multiline: bool = True) -> DataFrame:
    """JSON documents as rows, with the legislature their path names and, where they hold fields that
    aren't declared, their source.

    An array root gives one row an element, an object root one row. ``multiline`` is for files that
    are one document each (a task a file); without it each line is a document and files split.
    """
    # An object root is read as a list of one.
    typed = F.from_json("value", T.ArrayType(BRONZE[dataset]), {"mode": "FAILFAST"})
    parsed = F.parse_json("value")
    sources = F.when(F.startswith(F.ltrim("value"), F.lit("[")), F.variant_get(parsed, "$", "array<variant>")).otherwise(F.array(parsed))
    lines = spark.read.text(paths if isinstance(paths, str) else list(paths), wholetext=multiline).select(
        "value", legislature_in_path(F.col("_metadata.file_path")).alias("legislatura")
    )
    both = F.explode(F.arrays_zip(typed.alias("typed"), sources.alias("source")))
    records = lines.where(F.trim("value") != "").select(both.alias("r"), "legislatura")
    return records.select("r.typed.*", undeclared(F.col("r.source"), BRONZE[dataset]).alias(SOURCE), "legislatura")


def activities_in(documents: DataFrame) -> DataFrame:
    """The wrapped activity list, a row each; a document without it gives none.

    Each has its own part of the document's source, if that holds fields that aren't declared.
    """
    sources = F.variant_get(SOURCE, "$.AtividadesGerais.Atividades", "array<variant>")
    kept = F.coalesce(sources, F.transform("AtividadesGerais.Atividades", lambda _: F.lit(None).cast("variant")))
    each = documents.where(F.col("AtividadesGerais.Atividades").isNotNull()).select(
        F.explode(F.arrays_zip(F.col("AtividadesGerais.Atividades").alias("a"), kept.alias("s"))).alias("e"), "legislatura"
    )
    return each.select("e.a.*", undeclared(F.col("e.s"), ACTIVITY_RAW).alias(SOURCE), "legislatura")


def read_topics(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Topic codes from CSV; a value that isn't of its declared type is an error."""
    raw = spark.read.schema(BRONZE["cap"]).option("header", True).option("mode", "FAILFAST").csv(
        paths if isinstance(paths, str) else list(paths)
    )
    return raw.select(*BRONZE["cap"].names)


def read_dataset(
    spark: SparkSession, root: str, name: str, optional: bool = False, merge_schema: bool = False
) -> DataFrame:
    """All legislatures of a silver table; an absent optional one is empty.

    The declared schema spares the inference pass and gives NULL for columns that older files lack.
    ``merge_schema`` takes the union of what the files hold instead.
    """
    reader = spark.read.option("mergeSchema", True) if merge_schema else spark.read.schema(SILVER[name])
    if optional and not path_exists(spark, f"{root}/{name}"):
        return spark.createDataFrame([], SILVER[name])
    return reader.parquet(f"{root}/{name}")


def absent_datasets(spark: SparkSession, root: str, names: Iterable[str] = CORE_DATASETS) -> list[str]:
    return [n for n in names if not path_exists(spark, f"{root}/{n}")]


def require_datasets(spark: SparkSession, root: str, names: Iterable[str] = CORE_DATASETS) -> None:
    absent = absent_datasets(spark, root, names)
    if absent:
        raise FileNotFoundError(f"no such datasets under {root}: {', '.join(absent)}")


def union_drifting(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Union by column name; what one side lacks is NULL there."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first
