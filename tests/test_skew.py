"""Hot keys: bounded documents, and joins that split."""

import pytest
from pyspark.sql import functions as F

from hemiciclo import fixtures
from hemiciclo.operators.skew import oversized_keys, small_side
from hemiciclo.plans import initiatives, silver, statistics
from hemiciclo.schemas import SILVER
from hemiciclo.sources.readers import read_documents
from hemiciclo.sources.shared import settled, shared_folder

SF_DIR = "/root/testdata/sf0.001"


def silver_initiatives(spark, tmp_path, max_events):
    root = str(tmp_path / str(max_events))
    fixtures.write_bronze(spark, SF_DIR, root, "iniciativas", max_events)
    path = str(tmp_path / f"silver{max_events}")
    silver.initiatives(read_documents(spark, "iniciativas", f"{root}/iniciativas", multiline=False)).drop(
        "etl_timestamp").write.parquet(path)
    return spark.read.parquet(path).withColumn("etl_timestamp", F.lit(None).cast("timestamp"))


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_long_initiatives_in_parts_give_the_same_results(spark, tmp_path):
    """With at most 2 events aimed at a record most initiatives come in parts."""
    whole, parts = silver_initiatives(spark, tmp_path, 1000), silver_initiatives(spark, tmp_path, 2)
    assert whole.where("partes > 1").count() == 0
    assert parts.where("parte > 0").count() > 500
    assert parts.groupBy("ini_id", "parte").count().where("count > 1").count() == 0
    columns = ["ini_id", "ini_nr", "legislatura", "ini_titulo", "ini_data"]
    assert same(initiatives.headers(whole).select(columns), initiatives.headers(parts).select(columns))
    assert same(
        initiatives.events(whole).select("ini_id", "evt_id", "data_fase"),
        initiatives.events(parts).select("ini_id", "evt_id", "data_fase"),
    )
    assert same(silver.votes(whole), silver.votes(parts))
    for args in (dict(evento_fase="Votação final global"), dict(evento_fase="Entrada,Admissão", autor_gp="PS")):
        a, b = (initiatives.list_initiatives(t, limit=500, **args) for t in (whole, parts))
        assert a.total.first() == b.total.first() and a.page.collect() == b.page.collect()


def test_copies_of_one_event_spread(spark, tmp_path):
    """Most events are copies of one row of one order: no record grows with them, none is lost."""
    tables, copies, limit = tmp_path / "tables", 6000, 100
    lines = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    row = lines.where("l_orderkey = 1294").first()
    hot = spark.range(0, copies, 1, 3).select(*[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in lines.schema])
    others = lines.where("l_orderkey <> 1294")
    others.unionAll(hot).repartition(4).write.parquet(str(tables / "lineitem.parquet"))
    spark.read.parquet(f"{SF_DIR}/orders.parquet").write.parquet(str(tables / "orders.parquet"))
    records = fixtures.initiatives(spark, str(tables), limit).select(
        "IniId", "Parte", "Partes", F.array_size("IniEventos").alias("n")
    ).where("IniId = '1294'").collect()
    assert sum(r.n for r in records) == copies and max(r.n for r in records) < 2 * limit
    assert sorted(r.Parte for r in records) == list(range(copies // limit)) and {r.Partes for r in records} == {copies // limit}


def test_oversized_keys(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 400, 0).otherwise(F.col("id")).alias("k"))
    assert [tuple(r) for r in oversized_keys(df, "k", 100).collect()] == [(0, 4)]


def test_broadcast_hint_only_below_the_bound(spark):
    df = spark.range(100)
    assert "ResolvedHint" in small_side(df, 100)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in small_side(df, 99)._jdf.queryExecution().analyzed().toString()


@pytest.fixture()
def shuffled_joins(spark):
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k in conf:
        spark.conf.unset(k)


def test_votes_of_one_initiative_are_split(spark, shuffled_joins):
    """A third of all votes on one initiative: nothing is dealt by initiative, and counts are combined first."""
    n = 60_000
    votes = spark.range(0, n, 1, 12).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("ini_id"),
        F.lit("L17").alias("legislatura"), F.lit("F").alias("fase"),
        F.when(F.rand(1) < 0.5, "Aprovado").otherwise("Rejeitado").alias("resultado"),
        F.array(F.lit("PS"), F.lit("IL")).alias("ini_autores_gp"), F.lit(None).cast(SILVER["votacoes"]["detalhe_parsed"].dataType).alias("detalhe_parsed"),
    )
    out = statistics.party_outcomes(votes)
    totals = {r.party: r.n for r in out.groupBy("party").agg(F.sum("vote_count").alias("n")).collect()}
    assert totals == {"PS": n, "IL": n}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "hashpartitioning(ini_id" not in plan
    cells = {(r.kind, r.resultado): (r.n, r.initiatives) for r in statistics.vote_cells(votes).collect()}
    assert sum(k for (kind, _), (k, _) in cells.items() if kind == "vote") == n
    assert sum(k for (kind, _), (_, k) in cells.items() if kind == "initiative") <= 2 + 2 * n // 3


class Session:
    """Just what the choice of a folder looks at."""

    def __init__(self, master, folder):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = self
        self.master, self.applicationId, self.setCheckpointDir = master, "app", print
        self.getCheckpointDir = lambda: None


def test_shared_folder_is_the_session_s():
    assert shared_folder(Session("spark://host", "hdfs://shared/scratch/")) == "hdfs://shared/scratch"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session("spark://host", None))
    assert "hemiciclo-" in shared_folder(Session("local[2]", None))


def test_settled_rows_keep_no_lineage(spark):
    df = settled(spark.range(5).withColumn("x", F.rand()))
    assert "Range" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert df.collect() == df.collect()
