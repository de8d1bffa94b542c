"""Pages looked up by counts against plain top-k pages."""

import contextlib
import datetime
import io

import pytest
from pyspark.sql import functions as F

from hemiciclo.catalog.workspace import workspace
from hemiciclo.operators import paging
from hemiciclo.operators.paging import Key, Listing, ascending, located, newest_first
from hemiciclo.plans import activities, initiatives, people, topics, votes

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture
def always(monkeypatch):
    """Every page is looked up, and groups are divided until they are small."""
    monkeypatch.setattr(paging, "FUNNEL_ROWS", 0)
    monkeypatch.setattr(paging, "GROUP_ROWS", 7)


@pytest.fixture(scope="module")
def rows(spark):
    """Dates with many ties and none at all, ids with common beginnings, repeated rows."""
    n = F.col("id")
    return spark.range(0, 5000, 1, 8).select(
        F.when(n % 7 != 0, F.date_add(F.lit(datetime.date(2020, 1, 1)), F.when(n % 3 == 0, 5).otherwise((n % 40).cast("int")))).alias("day"),
        F.when(n % 50 != 1, F.concat(F.lit("prefix-"), (n % 900).cast("string"))).alias("key"), (n % 11).cast("double").alias("number"), n.alias("unique"),
    ).cache()


def plain(listing):
    order = [k.column for k in listing.order]
    return listing.rows.orderBy(*order).offset(listing.offset).limit(listing.limit).select(*listing.columns).collect()


ORDERS = [
    newest_first("day", Key("key", descending=True), Key("unique")), newest_first("day", Key("unique")),
    ascending("key", "day", "unique"), [Key("key", descending=True), Key("unique", descending=True)],
    ascending("number", "key", "unique"), [Key("unique", descending=True)],
]


@pytest.mark.parametrize("order", ORDERS)
def test_looked_up_pages(always, rows, order):
    for offset in (0, 1, 1200, 4271, 4300, 4990, 5000, 6000):
        listing = Listing(rows, order, ["unique", "day", "key"], 50, offset)
        wanted = plain(listing)
        assert listing.page.collect() == wanted
        got = listing.page_with_total().collect()
        assert [r.unique for r in got] == [r.unique for r in wanted] and all(r.total == 5000 for r in got)


def test_no_rows(always, rows):
    listing = Listing(rows.where("unique < 0"), ORDERS[0], ["unique"])
    assert listing.page.collect() == [] and listing.page_with_total().collect() == []


def test_rows_with_equal_keys_are_no_endless_search(always, rows):
    listing = Listing(rows.select("number"), ascending("number"), ["number"], 50, 500)
    assert listing.page.collect() == plain(listing)


def test_groups_are_divided_until_small(always, rows):
    places, whole = located(rows, ORDERS[0], [10, 2000, 4999])
    assert whole == 5000
    for place, rank in zip(places, (10, 2000, 4999), strict=True):
        n = rows.where(place.side(after=True) & place.side(after=False)).count()
        assert place.before <= rank < place.before + n and n <= 7
        assert rows.where(place.side(after=True)).count() == 5000 - place.before


def test_far_pages_of_the_tables(spark, monkeypatch):
    """The queries' own listings, at the offsets of a first, a later and the last page."""
    w = workspace(spark, SF_DIR)
    ini, vot = w.table("iniciativas"), w.table("votacoes")
    built = [
        lambda **k: votes.list_votes(vot, **k), lambda **k: initiatives.list_initiatives(ini, **k), lambda **k: initiatives.list_initiatives(ini, evento_fase="Entrada", **k),
        lambda **k: people.list_deputies(w.table("deputados"), **k), lambda **k: activities.list_activities(w.table("atividades"), **k),
        lambda **k: activities.list_activity_votes(w.table("atividades_votacoes"), **k), lambda **k: topics.list_topics(w.table("cap"), ini, **k),
        lambda **k: people.list_circles(w.table("circulos"), **k),
    ]
    wanted = [[build(limit=20, offset=o).page_with_total().collect() for o in (0, 110, 1200)] for build in built]
    monkeypatch.setattr(paging, "FUNNEL_ROWS", 0)
    monkeypatch.setattr(paging, "GROUP_ROWS", 40)
    assert [[build(limit=20, offset=o).page_with_total().collect() for o in (0, 110, 1200)] for build in built] == wanted
    assert len(votes.list_votes(vot, offset=100_000).page.collect()) == 0


def test_the_scan_gets_both_ends(spark, monkeypatch):
    vot = workspace(spark, SF_DIR).table("votacoes")
    listing = votes.list_votes(vot, offset=1200)
    text = io.StringIO()
    monkeypatch.setattr(paging, "FUNNEL_ROWS", 0)
    with contextlib.redirect_stdout(text):
        listing.page.explain("formatted")
    pushed = text.getvalue().split("PushedFilters")[1].split("\n")[0]
    assert "LessThanOrEqual(data," in pushed and "GreaterThanOrEqual(data," in pushed


def test_few_tasks_need_no_lookup(spark):
    vot = workspace(spark, SF_DIR).table("votacoes")
    assert votes.list_votes(vot)._ends is None
    assert paging.read_tasks(vot) * paging.Listing(vot, [Key("vot_id")], ["vot_id"]).limit <= paging.FUNNEL_ROWS
