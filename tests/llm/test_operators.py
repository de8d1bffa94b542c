"""Each operator against a plain version, on given tables and on rows with every odd case."""

import random
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from hemiciclo.llm import chat, decontamination, html, licenses, near_dedup, quality, queries, segmentation, sharding, suffix_dedup, toxicity  # noqa: E402
from hemiciclo.llm.common import table  # noqa: E402
from hemiciclo.llm.components import components  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, n_words string, score string, _hits int"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(n))


BASE = prose(1, 60)
PASSAGE = prose(2, 25)
ODD = [
    (1, BASE), (2, BASE), (3, BASE.replace(BASE.split()[7], "changed")), (4, BASE.upper()), (5, None), (6, ""), (7, " \n\t "),
    (8, "one two"), (9, "ONE two"), (10, prose(3, 20) + "\n" + PASSAGE), (11, PASSAGE + " " + prose(4, 20)), (12, "é" * 40 + PASSAGE + "ß"),
    (13, "a" * 300), (14, "a" * 120 + "b" + "a" * 120), (15, prose(5, 3000)), (16, prose(5, 3000) + " tail"), (17, "# % & x\nx\nx\n\n" * 9),
    (18, "This work is licensed under the GNU General Public License, version 3. All rights reserved. CC BY 4.0"), (19, "x cc by cc by"),
    (20, "Ünï©ode ▁ under line \x00 zero\x1fsep \x85 日本語 𐍈"), (21, BASE), (21, BASE), (None, BASE), (None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, "x", "y", 1) for i, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def by_order(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("name", ["odd", "empty", "documents"])
def test_decontamination(spark, request, name):
    docs = request.getfixturevalue(name)
    items = [(1, PASSAGE), (2, "two"), (None, "one two"), (3, None), (4, ""), (10, BASE), (10, "x cc by"), (5, "cc by cc by")]
    if name == "documents":
        items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    bench = spark.createDataFrame(items, "item_id long, text string")
    wanted = [(i, *brute.leaks(t, items)) for i, t in texts_of(docs)]
    assert by_order(rows_of(decontamination.report(docs, bench))) == by_order(wanted)


def test_decontamination_in_several_automata(odd, monkeypatch):
    items = odd.sparkSession.createDataFrame([(1, PASSAGE), (2, BASE), (3, "cc by")], "item_id long, text string")
    once = by_order(rows_of(decontamination.report(odd, items)))
    monkeypatch.setattr(decontamination.automata, "__defaults__", (decontamination.WINDOW, 5))
    assert by_order(rows_of(decontamination.report(odd, items))) == once


def test_decontamination_cuts_spans_and_leaves_others(odd):
    items = odd.sparkSession.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    out = dict(texts_of(decontamination.decontaminate(odd.where("doc_id < 20"), items, max_coverage=0.9)))
    assert PASSAGE not in out[10] and out[10].startswith(prose(3, 20)) and out[11] == " " + prose(4, 20)
    assert all(out[i] == t for i, t in ODD[:9])
    assert 11 not in dict(texts_of(decontamination.decontaminate(odd, items, max_coverage=0.3)))
    assert decontamination.decontaminate(odd, items).columns == odd.columns


@pytest.mark.parametrize("name", ["odd", "empty", "documents"])
def test_quality_counts(request, name, labels):
    docs = request.getfixturevalue(name)
    out = quality.judge(docs, labels, "q").select("doc_id", *[f"q.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])
    wanted = [(i, *brute.quality(t), not brute.quality(t)[-1]) for i, t in texts_of(docs)]
    assert by_order(rows_of(out)) == by_order(wanted)


def test_quality_cutoffs_reject_bad_and_spare_good(spark):
    rows = [(i, prose(i, 30) if i % 5 else " ".join(w + "###" for w in prose(i, 30).split()), "en" if i % 3 else None) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = spark.createDataFrame([(i, int(i % 5 > 0), None) for i in range(0, 3000, 2)] + [(1, None, None), (2, 1, None)], "doc_id long, quality int, toxic int")
    kept = Counter((r.doc_id % 5 > 0, r.q.kept) for r in quality.judge(docs, known, "q").collect())
    assert kept[True, False] == 0 and kept[False, True] == 0
    assert quality.keep_good(docs, known).columns == docs.columns
    few = known.where("doc_id < 60")
    assert quality.judge(docs, few, "q").where("q.kept").count() == 3000  # too few to be sure of anything


def test_quality_percentiles_without_a_task_of_all_values(spark):
    from pyspark.sql import functions as F

    r = random.Random(8)
    df = spark.createDataFrame([(r.random(), r.choice([0.0, 0.0, 0.5, r.random()]), float(i < 3)) for i in range(3001)], "a double, b double, c double")
    shares = [1 - level for level in quality.LADDER] + [0.0, 0.37, 0.5]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for part in (df, df.limit(1), df.limit(10)):
            wanted = part.agg(*[F.percentile(c, F.array(*map(F.lit, shares))).alias(c) for c in "abc"]).first()
            assert quality.percentiles(part, tuple("abc"), shares) == wanted.asDict()
        sizes = [x["count"] for x in quality.by_value(df, tuple("abc")).groupBy("range").count().collect()]
        assert len(sizes) > 4 and max(sizes) < sum(sizes) / 2
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert quality.percentiles(df.limit(0), tuple("abc"), shares) is None


def test_binomial_tail():
    assert quality.binomial_tail(0, 10, 0.5) == pytest.approx(0.5**10)
    assert quality.binomial_tail(10, 10, 0.3) == pytest.approx(1)


@pytest.mark.parametrize("name", ["odd", "empty", "documents"])
def test_near_dedup(request, name):
    docs = request.getfixturevalue(name)
    rows = texts_of(docs)
    wanted = brute.near_components([r for r in rows if r[0] is not None])
    got = rows_of(near_dedup.report(docs).where("doc_id is not null"))
    assert by_order(got) == by_order((i, *wanted[i], wanted[i][1] == i) for i, _ in rows if i is not None)
    assert near_dedup.keep_one(docs).columns == docs.columns


def test_near_dedup_of_unlike_copies_in_one_list(spark, monkeypatch):
    """Groups whose members are alike but mostly not similar: all rounds and blocks have work."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    r, rows = random.Random(5), []
    for group in range(4):
        base = prose(100 + group, 80).split()
        for _ in range(25):
            words = list(base)
            for _ in range(r.choice([1, 2, 3, 4, 5])):
                words[r.randrange(80)] = "w%d" % r.randrange(10**6)
            rows.append((len(rows), " ".join(words)))
    wanted = brute.near_components(rows)
    got = rows_of(near_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sorted(got) == sorted((i, *wanted[i], wanted[i][1] == i) for i, _ in rows)


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + r.randrange(50), 100 + r.randrange(50)) for _ in range(25)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    got = dict(rows_of(components(spark.createDataFrame(edges, "a long, b long"))))
    assert got == {x: c for x, c in parent.items() if any(a != b and x in (a, b) for a, b in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("name", ["odd", "empty", "documents"])
def test_suffix_dedup(request, name):
    docs = request.getfixturevalue(name).where("doc_id is not null")
    wanted = brute.repeats(texts_of(docs))
    assert by_order(rows_of(suffix_dedup.report(docs))) == by_order((i, *wanted[i]) for i, _ in texts_of(docs))


def test_suffix_dedup_null_id_is_last(odd):
    out = [r for r in suffix_dedup.report(odd).collect() if r.doc_id is None]
    assert sorted((r.n_bytes, r.n_removed) for r in out) == [(0, 0), (len(BASE), len(BASE))]


def test_suffix_dedup_splits_strings_with_many_contexts(spark, monkeypatch):
    """Every piece, bucket, block and split at its smallest."""
    monkeypatch.setattr(suffix_dedup, "MANY", 2)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 50)
    monkeypatch.setattr(suffix_dedup, "ANCHORS", 100)
    r, shared = random.Random(9), prose(50, 40)
    rows = []
    for i in range(60):
        a, n = r.randrange(0, 100), r.randrange(20, 110)
        rows.append((i, prose(200 + i, r.randrange(0, 12)) + shared[a:a + n] + prose(300 + i, r.randrange(0, 12))))
    rows.append((60, "ab" * 200))
    rows.append((61, "ab" * 50 + "é" * 30))
    got = {r[0]: tuple(r[1:]) for r in suffix_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.repeats(rows)


def test_suffix_dedup_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 256)
    text = (prose(8, 500) * 2).encode()
    found = suffix_dedup.anchors([b"", text, b"x" * 49, text[100:900]])
    windows = {(t, q) for t, a, b in zip(found.text, found.first, found.last) for q in range(a, b + 1)}
    assert windows == {(t, q) for t, x in enumerate([b"", text, b"x" * 49, text[100:900]]) for q in range(len(x) - 49)}
    at = {(t, q): p - q for t, a, b, p in zip(found.text, found.first, found.last, found.at) for q in range(a, b + 1)}
    assert all(at[3, q] == at[1, q + 100] for q in range(751))


def test_without_repeats_keeps_characters_whole(odd):
    out = suffix_dedup.without_repeats(odd.where("doc_id is not null"))
    texts = dict(texts_of(out))
    assert out.columns == odd.columns and texts[1] == BASE and 2 not in texts and texts[10] == ODD[9][1] and texts[5] is None
    assert PASSAGE not in texts[12] and texts[12].startswith("é" * 40)


@pytest.mark.parametrize("name", ["odd", "empty", "documents"])
def test_licenses(request, name):
    docs = request.getfixturevalue(name)
    got = rows_of(licenses.scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"))
    assert by_order(got) == by_order((i, *brute.licenses(t)) for i, t in texts_of(docs))


def test_licenses_near_phrases_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(licenses, "PIECE", 3)
    rows = [(1, "Released, under the well known MIT License."), (2, "Licensed under CC BY-NC 4.0."), (3, "the license of the under"), (4, "a " * 50 + "all rights reserved")]
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "mit", 2: "cc-by,cc-by-nc", 3: "", 4: "reserved"}


def test_licenses_of_edited_sentences(spark):
    """Sentences with as many words lost or replaced as are allowed: the same labels as if every diagonal were verified."""
    r, rows = random.Random(7), []
    short = [p for p, (words, *_) in enumerate(licenses.PHRASES) if len(words) < 40]
    sentences = [licenses.PHRASES[p][0] for p in short if not licenses.PHRASES[p][2]]
    for sentence in sentences * 25:
        words = [w.decode() for w in sentence]
        spare = next(n for n in range(len(words), -1, -1) if (len(words) - n) / len(words) >= licenses.MIN_SHARE)
        for at in sorted(r.sample(range(len(words)), spare), reverse=True):
            words[at:at + 1] = r.choice([[], [], ["other"]])
        rows.append((len(rows), f"{prose(len(rows), r.randrange(4))} {' '.join(words)} {prose(-len(rows) - 1, 9)}"))
    long = max(sentences, key=len)
    lost = [w.decode() for i, w in enumerate(long) if i % 4 != 3]
    assert len(lost) / len(long) >= licenses.MIN_SHARE
    rows.append((len(rows), "x y " + " ".join(lost) + " z"))
    got = {x.doc_id: x.labels for x in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    everywhere = lambda text: [{"phrase": p, "diagonals": list(range(-30, len(text.split())))} for p in short]
    assert got == {i: licenses.verified(t, everywhere(t))["labels"] for i, t in rows}
    assert all(got.values())


def test_toxicity_held_out(spark):
    r, rows, known = random.Random(3), [], []
    for i in range(1500):
        words = prose(i, 40).split()
        toxic = i % 6 == 0
        if toxic:
            words[r.randrange(40)] = r.choice(["mudface", "Mudf4ce", "mуdface".replace("у", "u"), "grіmbolX", "GRIMBOLT"])
        rows.append((i, " ".join(words)))
        known.append((i, 1, int(toxic)))
    docs = spark.createDataFrame([*rows, (9000, None), (9001, "")], "doc_id long, text string")
    out = toxicity.report(docs, spark.createDataFrame([*known, (3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")).collect()
    held = [(x.doc_id % 6 == 0, x.predicted == 1) for x in out if x.held_out and x.doc_id < 1500]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert all(0 <= x.score <= 1 for x in out) and len(out) == 1502


def test_toxicity_of_labels_sampled_at_two_rates(spark, monkeypatch):
    """A cut sample of the clean labels gives about the lexicon and the scores of all labels."""
    r, rows, known = random.Random(4), [], []
    for i in range(6000):
        toxic = i % 10 == 0
        words = prose(i, 30).split()
        for word, in_toxic, in_clean in (("mudface", 0.5, 0.01), ("amberish", 0.4, 0.1)):  # right in 85% and in 31%
            if r.random() < (in_toxic if toxic else in_clean):
                words[r.randrange(30)] = word
        rows.append((i, " ".join(words)))
        known.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(known, "doc_id long, quality int, toxic int")
    whole = toxicity.learn(docs, labels)
    monkeypatch.setattr(toxicity, "MAX_CLEAN", 900)
    cut = toxicity.learn(docs, labels)
    assert set(cut.weights) == set(whole.weights) and not any(w.startswith("amb") for w in cut.weights)
    scores = np.array([[x.score(t)[0] for x in (whole, cut)] for _, t in rows])
    assert abs(scores[:, 0] - scores[:, 1]).max() < 0.1
    assert abs(scores[:, 1].mean() - 0.1) < 0.02


def test_toxicity_odd_rows(odd, empty, labels):
    assert {r.score < 0.5 for r in toxicity.report(odd, labels).collect()} == {True}
    assert toxicity.report(empty, labels).count() == 0


def test_toxicity_exceptions_and_folding():
    lexicon = toxicity.Lexicon({"trash ": 2.0, "idio": 1.0}, exceptions=("trash can",))
    assert lexicon.raw("the trash can, and TR4SH!")[:2] == (2.0, 1)
    assert lexicon.raw("1d1ot іdiot i​diot ídiots videoidio")[:2] == (4.0, 4)
    assert toxicity.fold("1" * 100_000)


@pytest.mark.parametrize("k", [1, 3])
def test_segmentation_is_exact_and_distinct(odd, k):
    out = segmentation.decode(segmentation.encode(odd.where("doc_id is not null"), "doc_id", k=k), text="back").collect()
    of = defaultdict(list)
    for r in out:
        of[r.doc_id].append(r)
    for doc_id, text in ODD:
        if doc_id is not None:
            assert {r.back for r in of[doc_id]} == {text or ""}
            copies = sum(i == doc_id for i, _ in ODD)
            assert len({tuple(r.ids) for r in of[doc_id]}) * copies == len(of[doc_id]) and len(of[doc_id]) <= k * copies
    assert segmentation.encode(odd.limit(0), "doc_id").count() == 0


def test_segmentation_samples_follow_their_distribution():
    pieces = segmentation.Pieces()
    sampler, text, n = segmentation.Sampler(pieces), "the an", 4000
    whole = "".join(sampler.cut([text])[0])
    number = {t: i for i, t in enumerate(pieces.texts) if t}
    mass = {}

    def cut(at, ids, weight):
        if at == len(whole):
            mass[tuple(ids)] = np.exp(weight)
        for end in range(at + 1, len(whole) + 1):
            if whole[at:end] in number:
                i = number[whole[at:end]]
                cut(end, [*ids, i], weight + pieces.weights[i])

    cut(0, [], 0.0)
    total = sum(mass.values())
    chance = {ids: x / total for ids, x in mass.items()}
    second = defaultdict(float)
    for a, p in chance.items():
        for b, q in chance.items():
            if a != b:
                second[b] += p * q / (1 - p)
    found = sampler.search([text] * n, [17 * i for i in range(n)], 2)
    for place, wanted in ((0, chance), (1, second)):
        seen = Counter(tuple(map(int, s[place][3])) for s in found)
        assert sum(abs(seen[i] / n - p) for i, p in wanted.items()) / 2 < 0.03
    assert all(abs(s[0][0] - np.log(chance[tuple(map(int, s[0][3]))])) < 1e-5 and s[0][1] > s[1][1] for s in found)
    again = segmentation.Sampler(pieces).search([text, "other words first"], [17 * 5, 1], 2)[0]
    assert [tuple(x[3]) for x in again] == [tuple(x[3]) for x in found[5]]


def test_html(spark):
    chain = html.default_chain()
    pages = html.labelled_pages(200, seed=123)
    wrong = total = 0
    for page, wanted in pages:
        _, rows = html.page_features(page)
        got = chain.decode(rows)
        wrong, total = wrong + sum(a != b for a, b in zip(got, wanted, strict=True)), total + len(wanted)
    assert wrong / total < 0.01
    page = '<body><nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p>One\n two &lt;3.<br>more<p>Three <b>bold</article><div class="comments"><p>Nice.</p></div><footer>&copy; x</footer>'
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "just text"), (4, "u", "just text"), (5, "u", "<p>A sentence of the page, and one more.<script>var t='</p>'</script><!-- x"), (None, "u", "<p>" * 3000 + "A sentence deep inside, and one more."), (6, "u", "<a href='unclosed")]
    out = html.report(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(out) == len(rows) and out[0].text == "A & B\nOne two <3. more\nThree bold"
    assert [(r.text, r.n_chars) for r in out[1:6]] == [("", 0), ("", 0), ("just text", 9), ("just text", 9), ("A sentence of the page, and one more.", 37)]
    assert out[6].text == "A sentence deep inside, and one more." and out[7].text == ""


def test_html_formulas_and_drawings_are_text():
    page = ("<p>Energy is <math><semantics><mrow><mi>E</mi><mo>=</mo><mi>m</mi><mspace/></mrow><annotation encoding='x'>tex</annotation></semantics></math> here.</p>"
            "<p>A plot <svg viewBox='0'><title/><desc>hidden</desc><g><path d='M0'/><text>high</text><text>low</text></g></svg>of it.<p><svg/>Next <math>x<p>last <desc>shown</desc></p>")
    assert [(b.text, b.tags) for b in html.blocks(page)][:2] == [("Energy is E=m here.", ("p",)), ("A plot high low of it.", ("p",))]
    assert [b.text for b in html.blocks(page)][2:] == ["Next x", "last shown"]


def test_html_of_given_pages(spark):
    import html as entities
    import re

    for r in html.report(table(spark, SF, "pages")).join(table(spark, SF, "pages").select("page_id", "html"), "page_id").collect():
        article = r.html[r.html.index("<article>") + 9:r.html.index("</article>")]
        parts = (" ".join(entities.unescape(re.sub("<br>", " ", re.sub("</?b>", "", x))).split()) for x in re.split("</?(?:p|h1)>", article))
        assert r.text == "\n".join(x for x in parts if x)


def test_chat(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "a<|im_end|>\n<\\|b <|"), (1, 2, None, None), (1, 3, "assistant", None), (1, 4, "we\nird\\n<|r", "x"),
        (2, 0, "user", "q"), (2, 0, "user", "q"), (2, 0, "assistant", "same turn"), (2, None, "assistant", "no turn"), (None, 0, "assistant", "no id"), (3, 5, "assistant", "é𐍈" * 5000),
    ]
    rows += [(4, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(70)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    of = defaultdict(list)
    for conv, *turn in rows:
        of[conv].append(tuple(turn))
    got = {r.conv_id: tuple(r)[1:5] for r in chat.report(df).collect()}
    assert got == {conv: brute.conversation(turns) for conv, turns in of.items()}
    assert chat.report(df.limit(0)).count() == 0


def test_chat_trees(spark):
    nodes = [("t", 1, None, "user", "q", 1.0), ("t", 2, 1, "assistant", "good", 5.0), ("t", 3, 1, "assistant", "bad", 0.0), ("t", 4, 2, "user", "next", 1.0), ("t", 5, 99, "user", "orphan", 2.0)]
    df = spark.createDataFrame(nodes, "tree string, node long, parent long, role string, text string, score double")
    out = {r.leaf: (chat.read_back(r.formatted), [r.formatted[s.start:s.end] for s in r.spans]) for r in chat.formatted(df).collect()}
    assert out == {4: ([("user", "q"), ("assistant", "good"), ("user", "next")], ["good"]), 3: ([("user", "q"), ("assistant", "bad")], ["bad"]), 5: ([("user", "orphan")], [])}
    assert [r.leaf for r in chat.formatted(df, top=1).collect()] == [4]
    with pytest.raises(ValueError, match="circle"):
        chat.formatted(spark.createDataFrame([("t", 1, 2, "u", "x", 0.0), ("t", 2, 1, "u", "x", 0.0)], df.schema)).count()


def test_escapes_read_back():
    r = random.Random(0)
    for _ in range(300):
        text = "".join(r.choice(["<", "\\", "|", "im_end", ">", "\n", "x", chat.END, chat.START]) for _ in range(12))
        turns = [(text, text), ("assistant", text)]
        formatted = "".join(f"{chat.START}{chat.escaped_role(a)}\n{chat.escaped(b)}{chat.END}\n" for a, b in turns)
        assert chat.read_back(formatted) == turns and formatted.count(chat.END) == 2


def test_sharding(spark, odd, empty):
    shards = [f"s{i}" for i in range(7)]
    slots = sharding.claimed_slots(shards, 101)
    assert max(Counter(slots).values()) - min(Counter(slots).values()) <= 1 and set(slots) == set(range(7))
    fewer = sharding.claimed_slots(shards[1:], 1009)
    many = sharding.claimed_slots(shards, 1009)
    assert np.mean([shards[a] != shards[1:][b] for a, b in zip(many, fewer) if a != 0]) < 0.25
    out = sharding.place(odd.withColumn("shard", F.lit("old")), "doc_id", shards, 101)
    rows = out.collect()
    assert len(rows) == len(ODD) and all(r.shard == shards[slots[r.slot]] for r in rows) and Counter(out.columns)["shard"] == 1
    assert len({r.shard for r in rows if r.doc_id is None}) == 1
    assert sharding.place(empty, "doc_id").count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "SortMergeJoin" not in plan
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.claimed_slots(bad, 101)
    with pytest.raises(ValueError):
        sharding.claimed_slots(shards, 100)


def test_pipeline_stages(spark):
    """Each stage against its plain version, on what the one before it kept."""
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = dict(texts_of(docs))
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        after = dict(texts_of(out))
        if name == "quality_rules":  # too few labels here for cutoffs
            assert after == {i: t for i, t in before.items() if not brute.quality(t)[-1]}
        elif name == "near_dedup":
            assert after == {i: before[i] for i, (_, c) in brute.near_components(before.items()).items() if c == i}
        elif name == "suffix_dedup":
            gone = brute.repeats(before.items())
            assert all(after[i] == t for i, t in before.items() if not gone[i][1])
            assert all(0 <= len(after.get(i, "").encode()) - (gone[i][0] - gone[i][1]) <= 6 * gone[i][2] for i in before if i in after)
        else:
            assert all(after[i] == t for i, t in before.items() if not brute.leaks(t, items)[-1])
            assert not any(brute.leaks(t, items)[1] > 0 and before[i] == t for i, t in after.items())
        docs = out
    assert corpus_pipeline.run(spark, SF).select("doc_id").distinct().count() == docs.count()


def test_all_queries_are_there():
    import __spark_entry__

    assert [q.split("_")[0] for q in sorted(queries.QUERIES, key=lambda q: int("0" + "".join(filter(str.isdigit, q.split("_")[0]))))] == ["pipeline", *(f"op{i}" for i in range(1, 11))]
    assert queries.QUERIES.keys() <= __spark_entry__.queries().keys()
