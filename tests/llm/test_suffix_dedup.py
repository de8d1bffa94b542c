"""What the repeats' removal may cost: sizes of its arrays and numbers of its tasks."""

import random

import numpy as np

from hemiciclo.llm import suffix_dedup


def test_short_texts_are_hashed_in_small_groups(monkeypatch):
    """Arrays of 8 bytes for each byte of a group stay below 1 MB, from where ``lean`` has them mapped anew each time."""
    r = random.Random(1)
    texts = [bytes(r.choices(b"abcd ", k=r.choice([0, 49, 50, 300, 3000]))) for _ in range(600)] + [b"x" * 200_000]
    sizes, hashed = [], suffix_dedup._anchors

    def watched(group):
        sizes.append((len(group), sum(len(piece) for _, _, piece in group)))
        return hashed(group)

    monkeypatch.setattr(suffix_dedup, "_anchors", watched)
    found = suffix_dedup.anchors(texts)
    assert len(sizes) > 3 and all(n == 1 or size * 8 < 1 << 20 for n, size in sizes)
    alone = [suffix_dedup.anchors([t]) for t in texts]
    for name in suffix_dedup.Anchors._fields[1:]:
        assert np.array_equal(getattr(found, name), np.concatenate([getattr(a, name) for a in alone]))
    assert found.text.tolist() == [i for i, a in enumerate(alone) for _ in a.text]


def test_number_of_buckets_follows_the_texts(spark, monkeypatch):
    """Rows made in memory have an estimate of 8 EB, which once asked for more tasks than there are numbers for."""
    rows = spark.createDataFrame([(i, "some text " * 30) for i in range(40)] + [(99, None)], "id long, text string").where("id is not null")
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert suffix_dedup._buckets(rows) == usual == suffix_dedup._buckets(rows.limit(0))
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 100)
    assert suffix_dedup._buckets(rows) == 120
