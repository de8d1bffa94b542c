"""Raw documents lie packed, shuffle files go with the job that wrote them, large tables are clustered in slices."""

from __future__ import annotations

import gzip

import pytest
from pyspark.sql import functions as F

from hemiciclo import fixtures
from hemiciclo.fixtures import LEGISLATURES
from hemiciclo.plans import silver
from hemiciclo.sources.readers import is_packed, read_dataset, read_documents, read_topics

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def bronze(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("disk") / "bronze"
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(fixtures, "PACKED_RECORDS", {"iniciativas": 50, "cap": 40, "info_base": 2, "atividades": 1}, raising=False)
        for dataset in ("iniciativas", "cap", "info_base", "atividades"):
            fixtures.write_bronze(spark, SF_DIR, str(root), dataset)
    return root


def shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {n for i in range(blocks.size()) if (n := blocks.apply(i).name()).startswith("shuffle_")}


def test_documents_are_packed_in_short_files(spark, bronze):
    files = [f for f in (bronze / "iniciativas").rglob("part-*") if f.stat().st_size]
    texts = [gzip.decompress(f.read_bytes()) for f in files]
    assert all(f.name.endswith(".gz") for f in bronze.rglob("part-*"))
    assert 5 * sum(f.stat().st_size for f in files) < sum(map(len, texts))
    assert max(t.count(b"\n") for t in texts) <= 50 and sum(t.count(b"\n") for t in texts) == 1500
    assert read_documents(spark, "iniciativas", str(bronze / "iniciativas"), multiline=False).count() == 1500
    labels = read_topics(spark, str(bronze / "cap"))
    assert labels.where("ini_id is null or cap is null").isEmpty()  # each file has a header of its own
    assert labels.count() == fixtures.topics(spark, SF_DIR).count()


def test_packed_files_are_known(spark, bronze, tmp_path):
    (tmp_path / "iniciativas_l17.json").write_text("[]")
    (tmp_path / "empty").mkdir()
    assert [is_packed(spark, str(p)) for p in (bronze / "iniciativas", bronze / "cap", tmp_path / "iniciativas_l17.json", tmp_path / "empty")] == [True, True, False, False]


def test_more_tasks_for_packed_documents(spark, monkeypatch, bronze):
    monkeypatch.setattr(silver, "INPUT_BYTES_PER_TASK", 10_000)
    documents = read_documents(spark, "atividades", str(bronze / "atividades"), multiline=False)
    plain, packed = (silver.JOBS["atividades"].plan(documents, n).rdd.getNumPartitions() for n in (1, 10))
    assert packed > 5 * plain


def test_no_shuffle_files_stay(spark, bronze, tmp_path):
    before = shuffle_files(spark)
    fixtures.write_bronze(spark, SF_DIR, str(tmp_path / "again"), "iniciativas")
    for name in ("iniciativas", "votacoes"):
        silver.run_job(spark, name, str(bronze), str(tmp_path / "tables"), LEGISLATURES, multiline=False)
    assert shuffle_files(spark) <= before


def test_slices_make_the_same_table(spark, bronze, tmp_path, monkeypatch):
    written, whole, sliced = [], str(tmp_path / "whole"), str(tmp_path / "sliced")
    write = silver.write_dataset
    monkeypatch.setattr(silver, "write_dataset", lambda df, path, legs, *more: written.append(tuple(legs)) or write(df, path, legs, *more))
    asked = [*LEGISLATURES, "L20"]  # the last has no rows, but an empty slice
    for root, bound in ((whole, silver.AT_ONCE_BYTES), (sliced, 0)):
        monkeypatch.setattr(silver, "AT_ONCE_BYTES", bound)
        counts = [silver.run_job(spark, name, str(bronze), root, asked if name == "votacoes" else LEGISLATURES, multiline=False) for name in ("iniciativas", "votacoes", "cap")]
        assert counts[1].pop("L20") == 0 and sum(counts[1].values()) == read_dataset(spark, root, "votacoes").count()
        assert (tmp_path / root.rsplit("/")[-1] / "votacoes" / "legislatura=L20").is_dir()
    assert written == [LEGISLATURES, tuple(asked), LEGISLATURES, LEGISLATURES, *((leg,) for leg in asked), LEGISLATURES]
    one, other = (read_dataset(spark, root, "votacoes").select(F.to_json(F.struct("*")).alias("row")) for root in (whole, sliced))
    assert one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty()
