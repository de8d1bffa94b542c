"""The vote-record parser against hand-written records, one or more a rule, and by round trip."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from hemiciclo.functions.positions import parse_positions, vote_positions, vote_positions_union
from hemiciclo.schemas import POSITIONS

# (record, a_favor, contra, abstencao, ausencia); None instead of lists is a NULL struct.
RECORDS = [
    ("A Favor: <I>PS</I>, <I>JPP</I><BR>Contra:<I>IL</I>", ["PS", "JPP"], ["IL"], [], []),
    ("Abstenção: 6-PSD, Ana (PS), X (Ninsc), 12, IL", [], [], ["X (Ninsc)", "IL"], []),
    ("Contra: 3-X (Ninsc), PS", [], ["PS"], [], []),
    ("Ausência: <I>PS</I>", [], [], [], []),
    ("Ausencia: <I>PS</I>", [], [], [], ["PS"]),
    ("A Favor: <I>PS</I><br>Contra: <I>CH</I>", ["PS<br>Contra: CH"], [], [], []),
    ("Contra: A<BR>Contra: B", [], ["B"], [], []),
    ("Contra: A<BR>Contra: ", [], [], [], []),
    ("sem dados", [], [], [], []),
    ("sem dados<BR>a favor : PS:X,,PS", ["PS:X", "PS"], [], [], []),
    ("\xa0A FAVOR\xa0:\xa0PS ,\xa0 IL\t<BR>CONTRA: <i>CH</i>", ["PS", "IL"], ["<i>CH</i>"], [], []),
    ("A\xa0Favor: PS", [], [], [], []),
    ("Contra: (PS), a(b), a (b) c, 7 PS, 7, 7-, ٧, ٧-PS, -7", [], ["(PS)", "a (b) c", "7 PS", "-7"], [], []),
    ("Contra: a\nb (PS), c (d) e (f)", [], ["a\nb (PS)"], [], []),
    ("Abstencao: PAN<BR>Outra: PS", [], [], ["PAN"], []),
    ("Contra: <I></I>, <I> </I>, </I>L<I>", [], ["L"], [], []),
    (" \t\n\xa0 ", None, None, None, None),
    ("", None, None, None, None),
    (None, None, None, None, None),
]


def parsed(spark, texts, **options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, detalhe string")
    rows = parse_positions(df, **options).orderBy("i").collect()
    return [None if r.detalhe_parsed is None else [list(r.detalhe_parsed[p]) for p in POSITIONS] for r in rows]


def test_rules(spark):
    got = parsed(spark, [r[0] for r in RECORDS])
    for record, lists in zip(RECORDS, got):
        want = None if record[1] is None else [list(x) for x in record[1:]]
        assert lists == want, record[0]


def test_accents_can_be_folded(spark):
    assert parsed(spark, ["Ausência: PS<BR>Abstenção: IL"], fold_accents=True) == [[[], [], ["IL"], ["PS"]]]


codes = st.lists(st.sampled_from(["PS", "PSD", "CH", "IL", "CDS-PP", "L", "Ana Rosa (Ninsc)"]), max_size=5)
noise = st.lists(st.sampled_from(["6-PSD", "Maria (PS)", "12", "", " "]), max_size=3)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(records=st.lists(st.tuples(codes, codes, codes, codes, noise), min_size=20, max_size=40))
def test_round_trip(spark, records):
    """Rendered positions come back, in order and with duplicates, whatever noise is between them."""
    titles = ("A Favor", "Contra", "Abstenção", "Ausencia")
    texts = [
        "<BR>".join(f"{t}: " + ", ".join([f"<I>{c}</I>" for c in xs] + r[4]) for t, xs in zip(titles, r))
        for r in records
    ]
    assert parsed(spark, texts) == [[list(x) for x in r[:4]] for r in records]


def test_long_table_in_one_pass_equals_the_union(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(RECORDS)], "vot_id int, detalhe string")
    votes = parse_positions(df)
    one, union = vote_positions(votes, ["vot_id"]), vote_positions_union(votes, ["vot_id"])
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, union.collect()))
    assert one.count() == sum(len(x) for r in RECORDS if r[1] is not None for x in r[1:])


def test_parsing_needs_no_python_worker_and_no_shuffle(spark):
    df = spark.range(10).selectExpr("id AS vot_id", "'Contra: PS' AS detalhe")
    plan = vote_positions(parse_positions(df), ["vot_id"])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Exchange", plan)


@pytest.mark.parametrize("position", POSITIONS)
def test_every_position_is_a_list(spark, position):
    df = spark.createDataFrame([("Contra: PS",)], "detalhe string")
    assert parse_positions(df).selectExpr(f"typeof(detalhe_parsed.{position})").first()[0] == "array<string>"
