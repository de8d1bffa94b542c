"""The prefix trie against a plain one."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
from hemiciclo.llm import prefix_trie  # noqa: E402
from hemiciclo.llm.common import table  # noqa: E402

SCHEMA = "conv_id long, turn long, role string, text string, parent string, n_convs int"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def plain(rows):
    return sorted(brute.trie(rows, prefix_trie.turn_digest), key=repr)


def invented(seed, n, longest=12):
    r = random.Random(seed)
    return [
        (c, t, "user" if t % 2 == 0 else "assistant", r.choice(["a", "b c", "d e f"]) if r.random() < 0.8 else f"own {c}")
        for c in range(n) for t in range(r.randint(1, longest))
    ]


ODD = [
    (None, 0, "user", "no id"), (-3, 0, "user", "x"), (7, None, "user", "null turn"), (7, 1, None, None), (7, 1, None, None),
    (7, 1, "user", "tie"), (7, 1, "user", "other tie"), (8, 0, "", ""), (9, 5, "user", "  \n\t "), (41, 0, "user", "q"), (43, 0, "user", "q"),
    (20, 0, "system", "s " * 5000), (21, 0, "system", "s " * 5000), (22, 0, "system", "s " * 5000), (23, 0, "zero\x00", "\x00"), (24, 0, "a", "b"), (25, 0, "", "ab"),
]


@pytest.mark.parametrize("rows", [ODD, invented(1, 90), invented(2, 41, 40), [], [(None, 1, "user", "x")]])
def test_trie(spark, rows):
    assert rows_of(prefix_trie.report(frame(spark, rows))) == plain(rows)


def test_given_conversations(spark):
    rows = [tuple(r) for r in table(spark, "/root/testdata/sf0.001", "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(prefix_trie.report(frame(spark, rows))) == plain(rows)


def test_long_conversations_are_cut_over_tasks(spark):
    rows = [(c, t, "user", f"{t % 7}") for c in (40, 41, 42) for t in range(700)] + [(42, 700, "user", "end")]
    rows += invented(4, 9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = prefix_trie.ordered(prefix_trie.digested(frame(spark, rows)))
        assert len(turns.carried) > 2
        assert rows_of(prefix_trie.report(frame(spark, rows))) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_copies(spark):
    rows = [(c, t, "user", f"text {t}") for c in range(300) for t in range(5)]
    assert rows_of(prefix_trie.report(frame(spark, rows))) == plain(rows)


def test_small_chunks_of_ids(spark, monkeypatch):
    rows = [(c, t, "user", f"text {t}") for c in range(50) for t in range(1 + c % 3)]
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    assert rows_of(prefix_trie.report(frame(spark, rows))) == plain(rows)


@pytest.mark.parametrize("size", [2, 3, 7])
def test_any_size_of_blocks(spark, monkeypatch, size):
    monkeypatch.setattr(prefix_trie, "BLOCK_TURNS", size)
    rows = invented(3, 45, 20)
    turns = prefix_trie.digested(frame(spark, rows))
    whole = prefix_trie.trie(turns, turns.select("conv_id").distinct())
    monkeypatch.setattr(prefix_trie, "BLOCK_TURNS", 4)
    assert rows_of(whole) == rows_of(prefix_trie.trie(turns, turns.select("conv_id").distinct()))
