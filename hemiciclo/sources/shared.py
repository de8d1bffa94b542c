"""The folder that all executors share and that outlives any of them."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder `spark.checkpoint.dir` names, else the context's checkpoint directory.

    Only a local run that has neither gets a folder of its own, which goes when Python ends.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(folder)
        return folder.rstrip("/")
    if context.getCheckpointDir() is not None and context.applicationId not in _own:
        return context.getCheckpointDir().rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.mkdtemp(prefix="hemiciclo-")
        atexit.register(shutil.rmtree, _own[context.applicationId], ignore_errors=True)
        context.setCheckpointDir(_own[context.applicationId])
    return _own[context.applicationId]


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """For queries whose result is written: Spark may remove their shuffle files as soon as each has ended.

    Else they stay until the driver happens to collect its garbage.
    """
    before = spark.conf.get(_REMOVE_SHUFFLES, None)
    spark.conf.set(_REMOVE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_REMOVE_SHUFFLES)
        else:
            spark.conf.set(_REMOVE_SHUFFLES, before)


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from the shared folder, whoever asks and however often.

    The shuffle files behind it aren't needed any more, so Spark may remove them at once.
    """
    shared_folder(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint()
