"""Every named query against its expected SQL over the given tables."""

import os
import re
from functools import partial

import pytest

from compare import difference, oracle
from hemiciclo import fixtures
from hemiciclo.catalog import EXPECTED, QUERIES, workspace

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return oracle(SF_DIR)


@pytest.mark.parametrize("name", QUERIES)
def test_equals_expected(spark, con, name):
    assert difference(name, spark, con, SF_DIR, QUERIES, EXPECTED) is None


@pytest.fixture(scope="module")
def cut_small():
    """Initiatives of more than two events come in parts, base data in documents of few rows."""
    patch = pytest.MonkeyPatch()
    patch.setattr(workspace, "write_bronze", partial(fixtures.write_bronze, max_events=2))
    patch.setattr(fixtures, "ROWS_PER_DOCUMENT", 7)
    patch.setattr(workspace, "_built", {})
    yield
    patch.undo()


@pytest.mark.parametrize("name", QUERIES)
def test_equals_expected_however_records_are_cut(spark, con, cut_small, name):
    assert difference(name, spark, con, SF_DIR, QUERIES, EXPECTED) is None


def test_every_query_has_expected_rows():
    assert QUERIES.keys() == EXPECTED.keys()


def test_every_inventory_item_has_a_query():
    numbers = {
        "s": 8, "k": 4, "p": 10, "f": 15, "u": 5, "j": 6, "a": 13, "o": 6, "x": 2, "c": 14, "n": 1, "t": 10, "q": 34, "d": 13,
    }
    wanted = {f"{letter}{i}" for letter, n in numbers.items() for i in range(1, n + 1)}
    assert {re.match(r"[a-z]\d+", name).group() for name in QUERIES} == wanted
