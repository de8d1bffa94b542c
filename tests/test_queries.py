"""Filters, pages, arguments, checks that find something, and the shape of plans."""

import contextlib
import datetime
import io

import pytest
from pyspark.sql import functions as F

from hemiciclo.catalog.workspace import workspace
from hemiciclo.operators import predicates as p
from hemiciclo.operators.paging import Listing, ascending
from hemiciclo.plans import (
    activities, initiatives, legislatures, people, quality, silver, statistics, topics, votes,
)
from hemiciclo.plans.silver import JOBS
from hemiciclo.schemas import TOPIC_LABELS

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def w(spark):
    return workspace(spark, SF_DIR)


def plan(df, mode="formatted"):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


# --- arguments and predicates -------------------------------------------------------------------


def test_codes():
    assert (p.legislature_code("l17"), p.legislature_code(None)) == ("L17", None)
    assert (p.party_code("cds-pp"), p.party_code("L"), p.party_code("ps")) == ("CDS-PP", "L", "PS")
    for bad in ("17", "L", "L1234", "X17", ""):
        with pytest.raises(ValueError):
            p.legislature_code(bad)
    for bad in ("P S", "", "PS;", "A" * 11, "-PS"):
        with pytest.raises(ValueError):
            p.party_code(bad)


@pytest.mark.parametrize("limit, offset", [(0, 0), (501, 0), (50, -1), (50, 100_001)])
def test_page_bounds(spark, limit, offset):
    with pytest.raises(ValueError):
        Listing(spark.range(1), ascending("id"), ["id"], limit, offset)


def test_comma_list():
    assert p.comma_list(" a, ,b c ,") == ["a", "b c"]
    assert p.comma_list(None) is None and p.comma_list(" , ") is None


@pytest.mark.parametrize("text, found", [
    ("LEI", ["a_lei", "Leilão", "b\\lei"]), (" l_i ", ["a_lei", "Leilão", "b\\lei", "lxi"]), ("\\", ["b\\lei"]),
    ("lão", ["Leilão"]), ("LÃO", ["Leilão"]), ("l%o", ["Leilão"]), ("  ", None), (None, None),
])
def test_text_search(spark, text, found):
    names = ["a_lei", "Leilão", "b\\lei", "lxi", None]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = [r.name for r in p.select_where(df, p.contains_text("name", text)).collect()]
    assert got == (names if found is None else found)


def test_membership_ignores_null_lists(spark):
    df = spark.createDataFrame([(1, ["a", None]), (2, []), (3, None), (4, [None])], "id int, xs array<string>")
    assert [r.id for r in p.select_where(df, p.holds("xs", "a")).collect()] == [1]
    assert df.where(p.equals("id", 3)).count() == 1


def test_page_order(spark):
    df = spark.createDataFrame([(1, None), (2, "b"), (3, "a"), (4, None)], "id int, name string")
    listing = Listing(df, ascending("name", "id"), ["id"], 2, 1)
    assert [r.id for r in listing.page.collect()] == [2, 1]
    assert [tuple(r) for r in listing.page_with_total().collect()] == [(2, 4), (1, 4)]


# --- behaviour ----------------------------------------------------------------------------------


def test_event_filter_wants_one_event_for_all_conditions(spark):
    event = "struct<EvtId:string,Fase:string,DataFase:date>"
    df = spark.createDataFrame([
        ("1", 0, 1, [("a", "X", datetime.date(2020, 1, 1)), ("b", "Y", datetime.date(2024, 1, 1))]),
        ("2", 0, 1, [("a", "X", datetime.date(2024, 1, 1))]),
        ("3", 0, 1, None), ("4", 0, 1, []), ("5", 0, 1, [("a", None, None)]),
        # in parts: the match is in the last of them
        ("6", 0, 3, [("a", "Y", datetime.date(2019, 1, 1))]), ("6", 1, 3, []),
        ("6", 2, 3, [("a", "X", datetime.date(2024, 1, 1)), ("b", "X", datetime.date(2024, 2, 1))]),
        ("7", 0, 2, [("a", "X", datetime.date(2024, 1, 1))]), ("7", 1, 2, [("a", "X", datetime.date(2024, 1, 1))]),
    ], f"ini_id string, parte int, partes int, ini_eventos array<{event}>").withColumn("legislatura", F.lit("L17"))
    got = initiatives.with_matching_event(df, datetime.date(2023, 1, 1), phases=["X"])
    assert sorted(r.ini_id for r in got.collect()) == ["2", "6", "7"]


def test_unknown_parent_has_no_children(w):
    deputies, parties = w.table("deputados"), w.table("partidos")
    assert people.party_deputies(parties, deputies, "PS", "L13").total.first().total > 0
    # Deputies and initiatives of a party that the legislature doesn't know aren't listed.
    parties = parties.where("gp_sigla <> 'JPP' OR legislatura <> 'L14'")
    assert deputies.where("partido_atual = 'JPP' AND legislatura = 'L14'").count() > 0
    assert people.party_deputies(parties, deputies, "jpp", "L14").total.first().total == 0
    assert people.circle_deputies(w.table("circulos"), deputies, 99, "L13").page.count() == 0
    ini = w.table("iniciativas")
    assert people.party_initiatives(parties, ini, "JPP", "L14").total.first().total == 0
    assert statistics.party_vote_support(parties, w.table("votacoes"), "jpp", "l14").count() == 0


def test_deputy_id_forms_agree(w):
    deputies, ini = w.table("deputados"), w.table("iniciativas")
    ids = [r.n for r in ini.where("size(ini_autor_deputados) > 0").select(
        F.col("ini_autor_deputados")[0]["idCadastro"].alias("n")).distinct().limit(3).collect()]
    for n in ids:
        leg = f"L{13 + int(n) % 5}"
        totals = {people.deputy_initiatives(deputies, ini, form, leg).total.first().total for form in (n, f"{n}.0", float(n))}
        assert len(totals) == 1


def test_one_party_report_equals_its_share_of_all(w):
    v = w.table("votacoes")
    every = statistics.vote_support(v).where("author = 'PCP' AND legislatura = 'L17'")
    one = statistics.vote_support(v, "pcp", "l17").select(every.columns)
    assert one.exceptAll(every).count() == 0 and every.exceptAll(one).count() == 0 and one.count() > 0


def test_reports_of_one_legislature(w):
    ini, v, a, av = (w.table(n) for n in ("iniciativas", "votacoes", "atividades", "atividades_votacoes"))
    full = {r.legislatura: r for r in statistics.bundle(ini, v, a, av).collect()}
    one = statistics.bundle(ini, v, a, av, "l15").collect()
    assert one == [full["L15"]] and len(full) == 5
    absent = statistics.bundle(ini, v, a.limit(0), av.limit(0), "L15").first()
    assert absent.atividades_by_tipo == [] and absent.vote_source_breakdown.atividades == 0
    assert statistics.vote_sources(v, av, "L99").collect()[0].asDict() == {
        "legislatura": "L99", "iniciativas": 0, "atividades": 0, "total": 0,
    }


def test_authors_without_outcomes_keep_an_empty_list(w):
    report = statistics.initiatives_by_party(w.table("iniciativas"), w.table("votacoes").limit(0)).collect()
    assert report and all(r.fase_outcomes == [] for r in report)


def test_topics_absent(spark, w):
    from hemiciclo.sources.readers import read_dataset

    none = read_dataset(spark, w.scratch(), "cap", optional=True)
    listing = topics.list_topics(none, w.table("iniciativas"), cap=3)
    assert (listing.page.count(), listing.total.first().total) == (0, 0)


# --- checks that find something -----------------------------------------------------------------


def test_checks_find_faults(spark, w):
    ini = w.table("iniciativas").limit(5)
    assert quality.duplicate_initiatives(ini.unionAll(ini.limit(1))).count() == 1
    votes_ = w.table("votacoes").where("detalhe_parsed IS NOT NULL").limit(4)
    lists = {"a_favor": F.array(F.lit("Ninsc"), F.lit(" (Ninsc)"), F.when(F.col("vot_id") != "", "A B (Ninsc)"))}
    bad = votes_.withColumn("detalhe_parsed", F.col("detalhe_parsed").withField("a_favor", lists["a_favor"]))
    assert quality.malformed_independents(bad).count() == 8
    av = w.table("atividades_votacoes").limit(10)
    flipped = av.withColumn("has_party_details", ~F.col("has_party_details"))
    assert quality.detail_flag_mismatches(flipped).count() == 10 == quality.wrong_detail_flags(flipped).count()
    assert quality.wrong_source(av.withColumn("source", F.lit(None).cast("string"))).count() == 10
    keys = spark.createDataFrame([("L17", "L17_"), ("L17", "L16_X"), ("L17", None), ("L17", "L17_X")], "legislatura string, ativ_id string")
    assert quality.bad_activity_keys(keys).count() == 3
    codes = [(str(c), c, t) for c, t in TOPIC_LABELS.items()] + [("x", 11, "Saúde"), ("y", 3, ""), ("z", 3, "Energia"), ("n", None, None)]
    coded = spark.createDataFrame(codes, "ini_id string, cap int, cap_label string")
    assert sorted(r.ini_id for r in quality.bad_topics(coded).collect()) == ["n", "x", "y", "z"]
    assert quality.wrong_counts(w.table("partidos"), {"L13": 3, "L99": 1}).collect() == [("L99", 0, 1)]
    more = w.table("cap").unionAll(w.table("cap")).unionAll(w.table("cap"))
    assert quality.over_classified(more, w.table("iniciativas")).count() == 5
    listing = votes.list_votes(w.table("votacoes"), limit=20)
    shifted = Listing(listing.rows, listing.order, listing.columns, 20, 15)
    assert quality.repeated_rows(listing, shifted, "vot_id").count() == 5
    assert quality.out_of_bounds(listing.rows, "data", until=datetime.date(1900, 1, 1)).count() > 0
    assert quality.inactive(w.table("deputados").where("situacao_atual IS NULL OR situacao_atual <> 'Efetivo'")).count() > 0


# --- plans --------------------------------------------------------------------------------------


def test_pages_are_top_k(w):
    text = plan(votes.list_votes(w.table("votacoes"), legislatura="L17", resultado="Aprovado").page)
    assert "TakeOrderedAndProject" in text and "Exchange" not in text
    assert "EqualTo(resultado,Aprovado)" in text and "(legislatura#" in text.split("PartitionFilters")[1]


def test_event_filter_reads_two_event_fields(w):
    text = plan(initiatives.with_matching_event(w.table("iniciativas"), phases=["Entrada"]).select("ini_id"))
    assert "array<struct<Fase:string,DataFase:date>>" in text and "Votacao" not in text


def test_list_of_initiatives_reads_no_events(w):
    assert "ini_eventos" not in plan(initiatives.list_initiatives(w.table("iniciativas"), autor_gp="PS").page)


def test_gates_and_totals_are_no_joins(w):
    text = plan(people.party_deputies(w.table("partidos"), w.table("deputados"), "PS", "L17").page_with_total())
    assert "Join" not in text


def test_position_report_counts_before_its_only_shuffle(w):
    text = plan(statistics.votes_by_party_and_position(w.table("votacoes")), "simple")
    assert text.count("Exchange") == 1 and text.index("partial_count") > text.index("Exchange")
    assert "Union" not in text and "detalhe:" not in text


def test_author_reports_join_no_initiatives(w):
    for report in (statistics.party_outcomes(w.table("votacoes")), statistics.vote_support(w.table("votacoes")), statistics.vote_support(w.table("votacoes"), "PS")):
        text = plan(report, "simple")
        assert "Join" not in text and text.count("Scan parquet") == 1


def test_authors_must_be_stored(w):
    old = w.table("votacoes").withColumn("ini_autores_gp", F.lit(None).cast("array<string>"))
    with pytest.raises(Exception, match="write it anew"):
        statistics.party_outcomes(old).collect()


def test_bundle_reads_votes_once(w):
    assert plan(statistics.vote_cells(w.table("votacoes")), "simple").count("Scan parquet") == 1
    tables = [w.table(n) for n in ("iniciativas", "votacoes", "atividades", "atividades_votacoes")]
    assert plan(statistics.bundle(*tables), "simple").count("Scan parquet") == 4  # each table once


def test_bundle_is_made_of_the_reports(w):
    ini, v, a, av = (w.table(n) for n in ("iniciativas", "votacoes", "atividades", "atividades_votacoes"))
    whole = statistics.bundle(ini, v, a, av)
    for name, report in {
        "initiatives_by_fase": statistics.initiatives_by_phase(v), "initiatives_by_party": statistics.initiatives_by_party(ini, v),
        "votes_by_event_type": statistics.votes_by_phase(v), "votes_by_party_and_type": statistics.votes_by_party_and_position(v),
        "atividades_by_tipo": statistics.activities_by_type(a), "atividades_votes_by_tipo": statistics.activity_votes_by_type(av),
    }.items():
        laid = whole.select("legislatura", F.inline(name)).select(report.columns)
        assert sorted(map(tuple, laid.collect()), key=repr) == sorted(map(tuple, report.collect()), key=repr), name


def test_flags_and_counts_read_no_vote_texts(w):
    from hemiciclo.catalog import QUERIES

    for name in ("p5_struct_fields", "f12_null_and_empty_guards", "c3_list_flag", "c11_list_functions"):
        assert "detalhe" not in plan(QUERIES[name](w.spark, SF_DIR)), name


def test_activity_list_reads_no_vote_text(w):
    text = plan(activities.list_activities(w.table("atividades"), tipo="VOT").page)
    assert "votacao_debate:array<struct<id:string>>" in text and "detalhe" not in text


def test_vote_job_reads_three_event_fields(w):
    text = plan(silver.vote_rows(w.table("iniciativas")))
    assert "array<struct<Fase:string,DataFase:date,Votacao:array<" in text and "EvtId" not in text


def test_sizes_read_one_field_of_a_list(w):
    text = plan(legislatures.described_legislatures(w.table("info_base")))
    assert "Deputados:array<struct<DepCadId:double>>" in text


def test_clustering_and_write_share_one_sort(w):
    """The partitioned write needs rows by legislature, which the clustering sort already gives."""
    rows = JOBS["votacoes"].plan(w.table("iniciativas"))
    text = plan(rows, "simple")
    assert text.count("Exchange") == 1 and text.count("Sort ") == 1
    assert text.index("CASE WHEN isnotnull(_sections") < text.index("Exchange")  # parsed after it
