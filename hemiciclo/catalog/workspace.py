"""Bronze and silver tables of one data folder, built once and then shared by all queries.

They are written into the folder that `spark.checkpoint.dir` names, which all executors see and
which outlives any of them, so a lost executor costs no more than re-reading.
"""

from __future__ import annotations

import threading
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from hemiciclo.fixtures import LEGISLATURES, write_bronze
from hemiciclo.plans.silver import JOBS, run_job
from hemiciclo.sources.readers import read_dataset
from hemiciclo.sources.shared import shared_folder

_RUN = uuid.uuid4().hex[:12]
_built: dict[tuple[str, str], Workspace] = {}


class Workspace:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.root = f"{shared_folder(spark)}/hemiciclo-{_RUN}/{Path(sf_dir).name}-{uuid.uuid4().hex[:8]}"
        self.bronze, self.silver = f"{self.root}/bronze", f"{self.root}/silver"
        self._done: set[str] = set()
        self._building = threading.RLock()

    def documents(self, dataset: str) -> str:
        """Path of the raw documents of a dataset."""
        with self._building:
            if f"bronze/{dataset}" not in self._done:
                write_bronze(self.spark, self.sf_dir, self.bronze, dataset)
                self._done.add(f"bronze/{dataset}")
        return f"{self.bronze}/{dataset}"

    def build(self, *names: str) -> Workspace:
        """Make sure that the tables are written, their inputs first."""
        with self._building:
            for name in names:
                if name in self._done:
                    continue
                parent = JOBS[name].parent
                if parent:
                    self.build(parent)
                else:
                    self.documents(name)
                run_job(self.spark, name, self.bronze, self.silver, LEGISLATURES, multiline=False)
                self._done.add(name)
        return self

    def table(self, name: str) -> DataFrame:
        self.build(name)
        return read_dataset(self.spark, self.silver, name)

    def scratch(self) -> str:
        """A path no run has used yet."""
        return f"{self.root}/scratch/{uuid.uuid4().hex}"


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _built:
        _built[key] = Workspace(spark, sf_dir)
    return _built[key]
