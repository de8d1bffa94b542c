"""The store of lattices: what it remembers, and that samples don't depend on it."""

import random

import numpy as np

from hemiciclo.llm import segmentation


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgé日𐍈") for _ in range(r.randint(1, 6))) for _ in range(n))


def rows_of(found):
    return [[(*x[:3], tuple(x[3])) for x in samples] for samples in found]


def test_lattices_of_words_in_use_are_moved_and_not_made_again(monkeypatch):
    pieces = segmentation.Pieces()
    sampler, learnt = segmentation.Sampler(pieces, max_nodes=4000), []
    learn = sampler._learn
    monkeypatch.setattr(sampler, "_learn", lambda units, *rest: (learnt.extend(units), learn(units, *rest)))
    often, new = [words(1, 40), "", None, words(2, 40)], words(4, 20)
    first = rows_of(sampler.search(often, [1, 2, 3, 4], 3))
    for i in range(4):
        sampler.search([often[0], words(10 + i, 400)], [1, 5], 2)
        assert sampler.n_nodes == sampler.nodes[:len(sampler.units)].sum() and len(sampler.last) >= sampler.n_nodes
    kept = set(sampler.cut(often[:1])[0])
    assert len(learnt) > len(set(learnt)) or len(sampler.units) < len(learnt)  # something was forgotten
    assert all(learnt.count(u) == 1 for u in kept)
    assert rows_of(sampler.search(often, [1, 2, 3, 4], 3)) == first
    after = rows_of(sampler.search([new, *often], [9, 1, 2, 3, 4], 3))
    assert after == rows_of(segmentation.Sampler(pieces).search([new, *often], [9, 1, 2, 3, 4], 3)) and after[1:] == first


def test_words_are_numbered_in_the_order_they_are_met():
    sampler = segmentation.Sampler(segmentation.Pieces())
    blank = "▁"
    got = sampler.numbers_of(iter([f"{blank}b", f"{blank}a", f"{blank}b", f"{blank}日𐍈x"]), 4)
    assert got.tolist() == [0, 1, 0, 2] and list(sampler.units) == [f"{blank}b", f"{blank}a", f"{blank}日𐍈x"]
    assert np.all(sampler.nodes[:3] == [3, 3, 5]) and sampler.n_nodes == 11
