"""Structural check of raw documents before they are accepted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hemiciclo.schemas import PART_FIELD
from hemiciclo.sources.readers import legislature_in_path

# Keys each kind of document must hold; an array root has none.
EXPECTED_KEYS = {
    "iniciativas": (),
    "info_base": ("DetalheLegislatura", "Deputados", "GruposParlamentares"),
    "atividades": ("AtividadesGerais",),
}
_COUNTED = {
    "info_base": "$.Deputados", "atividades": "$.AtividadesGerais.Atividades",
}
_INNER_KEYS = {"atividades": ("$.AtividadesGerais", "Atividades")}


def check_documents(spark: SparkSession, dataset: str, paths: str | list[str], whole_files: bool = True) -> DataFrame:
    """One row a document: does its root have the right kind, which keys are missing, how many records.

    ``whole_files`` takes a file as one document, else a line.
    """
    lines = spark.read.text(paths, wholetext=whole_files).select(
        "value", legislature_in_path(F.col("_metadata.file_path")).alias("legislatura")
    )
    text = F.col("value")
    # An object has keys (maybe none), an array has a length, text that is no JSON has neither.
    is_array, keys = F.json_array_length(text).isNotNull(), F.json_object_keys(text)
    root_ok = is_array if dataset == "iniciativas" else keys.isNotNull()
    missing = [_missing(keys, k, F.lit(k)) for k in EXPECTED_KEYS[dataset]]
    if dataset in _INNER_KEYS:
        path, key = _INNER_KEYS[dataset]
        inner = F.json_object_keys(F.get_json_object(text, path))
        missing.append(F.when(F.array_contains(keys, path[2:]), _missing(inner, key, F.lit(f"{path[2:]}.{key}"))))
    missing_keys = F.array_compact(F.array(*missing)) if missing else F.array().cast("array<string>")
    if dataset == "iniciativas":
        # Further parts of a long initiative are no records of their own.
        parts = F.from_json(text, f"array<struct<{PART_FIELD}:int>>")
        # A lone object would be read as an array of one.
        records = F.when(is_array, F.array_size(F.filter(parts, lambda r: F.coalesce(r[PART_FIELD], F.lit(0)) == 0)))
    else:
        records = F.json_array_length(F.get_json_object(text, _COUNTED[dataset]))
    return lines.select(
        F.lit(dataset).alias("dataset"), "legislatura", F.coalesce(root_ok, F.lit(False)).alias("root_ok"),
        missing_keys.alias("missing_keys"), F.coalesce(records, F.lit(0)).cast("bigint").alias("n_records"),
    )


def _missing(keys: Column, key: str, shown: Column) -> Column:
    return F.when(~F.coalesce(F.array_contains(keys, key), F.lit(False)), shown)


def summarize_check(checked: DataFrame) -> DataFrame:
    """Per dataset and legislature: documents, records, and whether every root was right."""
    return checked.groupBy("dataset", "legislatura").agg(
        F.count(F.lit(1)).alias("n_documents"),
        F.sum("n_records").alias("n_records"),
        F.bool_and("root_ok").alias("ok"),
        F.max(F.array_size("missing_keys")).cast("bigint").alias("max_missing_keys"),
    )
