"""Near-duplicate vectors against all pairs."""

import math
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
from hemiciclo.llm import embedding_dedup as ed  # noqa: E402
from hemiciclo.llm.common import table  # noqa: E402

SCHEMA = "vec_id long, embedding array<double>, label int, node long, key string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def check(spark, rows):
    df = spark.createDataFrame([(i, v, 1, 7, "x") for i, v in rows], SCHEMA)
    assert rows_of(ed.report(df)) == sorted(brute.vectors(rows), key=repr)


def clouds(seed, sizes, noise, dimensions=32):
    """Vectors around random centres; noise 0.15 gives pairs on both sides of the threshold."""
    r = np.random.default_rng(seed)
    rows = []
    for n in sizes:
        centre = r.standard_normal(dimensions)
        rows += [(centre + noise * r.standard_normal(dimensions)).tolist() for _ in range(n)]
    return list(enumerate(rows, 100))


@pytest.mark.parametrize("noise", [0.02, 0.1])
def test_clouds(spark, noise):
    check(spark, clouds(1, [1] * 40 + [2, 3, 5, 30, 60], noise))


def test_links_near_the_threshold_are_found(spark):
    rows = clouds(2, [150, 150, 1, 1], 0.19)
    got = {r[0]: r[1] for r in rows_of(ed.report(spark.createDataFrame([(i, v, 1, 7, "x") for i, v in rows], SCHEMA)))}
    wanted = {r[0]: r[1] for r in brute.vectors(rows)}
    assert all(got[i] <= n for i, n in wanted.items())
    assert sum(got.values()) >= 0.99 * sum(wanted.values()) > 1000


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(ed, "BLOCK", 7)
    check(spark, clouds(3, [40, 40, 3, 1], 0.12))


def test_odd_vectors(spark):
    a, b = [1.0, 2.0, 3.0], [3.0, -1.0, 0.5]
    check(spark, [
        (1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 2.0]), (5, [math.nan, 1.0, 1.0]), (6, [math.inf, 1.0, 1.0]),
        (7, a), (8, a), (8, a), (None, a), (9, [2.0, 4.0, 6.0]), (10, [1e200, 2e200, 3e200]), (11, [1e-310, 2e-310, 3e-310]),
        (12, b), (None, b), (13, [-x for x in a]), (14, [1.0, 2.0]), (15, [*a, 0.0]), (None, None), (16, [1.0, 2.0, 3.5]),
    ])


def test_empty_table(spark):
    assert ed.report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_given_vectors(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, "/root/testdata/sf0.001", "embeddings").collect()]
    check(spark, rows)


def test_chance_of_a_shared_value():
    r = np.random.default_rng(4)
    for distance in (0.3, 1.4):
        x, shift = r.standard_normal(200_000) * distance, r.random(200_000) * ed.WIDTH
        assert abs(np.mean(np.floor((x + shift) / ed.WIDTH) == 0) - ed.collision(distance)) < 0.01


def test_more_vectors_get_longer_keys_and_more_tables():
    few, many = ed.tables(1_000), ed.tables(10_000_000)
    assert few[0] < many[0] and few[1] < many[1]
    near = ed.collision(math.sqrt(2 - 2 * ed.COSINE))
    for values, n in (few, many):
        assert (1 - near**values) ** n <= ed.MISSED
