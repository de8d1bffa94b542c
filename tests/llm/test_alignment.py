"""Tokens of two tokenizers and their links against a plain version."""

import random
import sys
from pathlib import Path

import pytest
import tokenizers

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
from hemiciclo.llm import token_alignment as ta  # noqa: E402
from hemiciclo.llm.common import table  # noqa: E402

SCHEMA = "doc_id long, text string, run int, bucket string"
TEXTS = [
    None, "", " ", "a", "the same text", "the same text", "<|endoftext|> and <s> </s> <unk> stay plain", "  two  blanks   three\n\n\tand tabs \r\n",
    "▁ looks like a blank", "Ünï©ode zero\x00sep \x85 日本語 𐍈 é", "1234567890 3.14159", "x" * 3000, " " * 2500 + "end", "\n" * 1500, "don't they've I'll",
]


@pytest.fixture(scope="module")
def sides():
    return ta.SideA(), ta.SideB()


def plain(rows, sides):
    a, b = sides
    return brute.alignment(rows, lambda t: a.encode([t])[0], a.raw.__getitem__, lambda t: b.encode([t])[0], b.raw.__getitem__)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def check(spark, rows, sides):
    assert rows_of(ta.align(frame(spark, rows))) == sorted(plain(rows, sides), key=repr)


def invented(seed, n):
    r = random.Random(seed)
    words = ["alpha", "beta", "don't", "ça", "日本", "1234", "...", "\n", "tokenization", "  "]
    return [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 60)))) for i in range(n)]


def test_odd_texts(spark, sides):
    check(spark, [*enumerate(TEXTS), (3, "repeated id"), (None, "null id"), (None, None)], sides)


def test_empty_table(spark):
    assert ta.align(frame(spark, [])).collect() == []


def test_given_documents(spark, sides):
    rows = [(r.doc_id, r.text[:3000]) for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    check(spark, rows, sides)


def test_many_runs_merged_in_rounds_and_groups(spark, sides, monkeypatch):
    monkeypatch.setattr(ta, "RUN_BYTES", 700)
    monkeypatch.setattr(ta, "FAN_IN", 3)
    monkeypatch.setattr(ta, "BLOCK_KEYS", 5)
    monkeypatch.setattr(ta, "GROUP_BYTES", 300)
    rows = invented(1, 120)
    made = ta.aligned(frame(spark, rows), ta.FILE_A, ta.FILE_B)
    assert made.select("run").distinct().count() > 9
    check(spark, rows, sides)


def test_a_long_text(spark, sides):
    text = " ".join(t for _, t in invented(2, 9000))
    row = ta.align(frame(spark, [(1, text), (2, text)])).collect()
    a, b = (side.encode([t])[0] for side, t in zip(sides, (" " + text, text), strict=True))
    assert [(r.n_a, r.n_b, r.n_links) for r in row] == [(len(a), len(b), len(a) + len(b) - row[0].n_groups)] * 2
    assert {(r.count_sum, r.n_best) for r in row} == {(2 * row[0].n_links, row[0].n_links)}


def test_fast_and_slow_encoding_agree(sides):
    model = tokenizers.Tokenizer.from_file(ta.FILE_A)
    model.encode_special_tokens = True
    texts = [f" {t}" for t in TEXTS if t]
    for start in range(0, 0x30000, 97):
        some = [chr(c) for c in range(start, start + 97) if not 0xD800 <= c < 0xE000]
        texts.append(" " + "".join(f"a{c}1{c}.{c} {c}{c}  b" for c in some))
    assert sides[0].encode(texts) == [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]


def test_runs_are_read_back():
    import numpy as np

    for values in ([], [0], [3, 3, 9, 300, 70_000, 2**40]):
        assert ta.unpack_sorted(ta.pack_sorted(np.array(values, np.int64)))[0].tolist() == values
