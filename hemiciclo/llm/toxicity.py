"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton over folded text.

Folding undoes disguises: case, accents, compatibility forms, look-alike letters of other scripts,
invisible characters, and digits or signs put for letters. The lexicon is learned from labelled rows:
whole words and word beginnings weighted by their log odds in toxic against clean texts, kept if a
likelihood-ratio test clears a bar that grows with the number of candidates. A text's raw score adds the
weights of its matches but for those inside an exception phrase; its sum and its sum a thousand words
become a probability by a logistic curve fitted to the same rows.

The classifier is fitted on a bounded sample: of each label the MAX_TOXIC or MAX_CLEAN rows whose ids
have the smallest hashes, MAX_CANDIDATES terms at most and a lexicon of at most MAX_TERMS. The two labels
may so be sampled at different rates. Where the share of toxic texts counts (the curve, MIN_PRECISION) a row
stands for all the labels of its kind by total / sampled. The likelihood-ratio test and the log odds compare
a term's rates within the labels, which sampling leaves as they are, so they take the rows as they were seen;
weights there would pass off a few rows as many.

Edge cases: null and empty texts have no match and get the curve's value at zero; without labelled rows
of both kinds no term is known and every text gets the share of toxic labels (0 without labels); several
labels of an id count as toxic if one of them is; null labels are left out.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemiciclo.llm.common import map_batches, of_ids, with_struct
from hemiciclo.sources.shared import settled

MAX_TOXIC, MAX_CLEAN = 6_000, 14_000
MAX_CANDIDATES, MAX_TERMS = 200_000, 2_000
MIN_PRECISION = 0.5  # share of toxic texts among those with a term
STEMS = (4, 5, 6, 7)  # lengths of the word beginnings that are tried
#: Harmless uses of words that are often insults.
EXCEPTIONS = ("trash can", "trash bin", "trash day", "pond scum", "clown fish", "circus clown", "idiot proof", "sore loser", "pathetic fallacy", "stupid simple")
# Letters that look like Latin ones, and signs put for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "ғ": "f", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "н": "h", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "ү": "y", "α": "a", "β": "b",
    "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w", "ı": "i", "ɑ": "a",
    "ɡ": "g", "ʟ": "l", "ո": "n", "օ": "o", "ս": "u", "ԍ": "g", "ø": "o", "đ": "d", "ł": "l", "ß": "ss", "æ": "ae", "œ": "oe",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"}
_FOLDED = str.maketrans(LOOKALIKES | dict.fromkeys(map(chr, [*range(0x300, 0x370), 0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF]), ""))
_SIGN = re.compile(r"(?<=[^\W\d_])[0134578@$!|+]{1,3}(?=[^\W\d_])|(?<![^\W_])[0134578@$!|+]{1,3}(?=[^\W\d_])")
_SIGNS = str.maketrans(SIGNS)
_BETWEEN = re.compile(r"[\W\d_]+")


def fold(text: str | None) -> str:
    """Folded words of a text, each with a blank before and after it."""
    text = (text or "").lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).translate(_FOLDED)
    text = _SIGN.sub(lambda m: m[0].translate(_SIGNS), text)
    return f" {_BETWEEN.sub(' ', text)} ".replace("  ", " ")


def terms_of(text: str | None) -> set[str]:
    """Whole words (closed by a blank) and beginnings of words of a text."""
    words = set(fold(text).split())
    return {w + " " for w in words if len(w) > 2} | {w[:n] for n in STEMS for w in words if len(w) > n}


@dataclass
class Lexicon:
    weights: dict[str, float]
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)
    exceptions: tuple[str, ...] = EXCEPTIONS
    _automaton: object = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def matcher(self):
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for term, weight in self.weights.items():
                self._automaton.add_word(" " + term, (len(term), weight))
            for phrase in self.exceptions:
                self._automaton.add_word(fold(phrase), (len(fold(phrase)) - 1, None))
            self._automaton.make_automaton()
        return self._automaton

    def raw(self, text: str | None) -> tuple[float, int, int]:
        """Sum of weights, number of matches, number of words."""
        folded = fold(text)
        n_words = folded.count(" ") - 1
        if not self.weights:
            return 0.0, 0, n_words
        found, spared = [], []
        for end, (size, weight) in self.matcher().iter(folded):
            (spared if weight is None else found).append((end - size + 1, end, weight))
        if spared:
            found = [x for x in found if not any(a <= x[0] and x[1] <= b for a, b, _ in spared)]
        return math.fsum(x[2] for x in found), len(found), n_words

    def score(self, text: str | None) -> tuple[float, int]:
        total, n, n_words = self.raw(text)
        a, b, c = self.curve
        x = a + b * math.log1p(total) + c * math.log1p(1000 * total / max(n_words, 1))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, x)))), n


def sampled(labels: DataFrame) -> tuple[DataFrame, dict[bool, float]]:
    """Ids and labels that the lexicon may learn from, and how many labels of its kind one of them stands for.

    Not of the fifth whose id's CRC-32 divides by 5."""
    labels = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    labels = settled(labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    limits = {True: MAX_TOXIC, False: MAX_CLEAN}
    weights = {r.toxic: max(1.0, r.n / limits[r.toxic]) for r in labels.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = labels.where("toxic").orderBy(*order).limit(MAX_TOXIC).unionAll(labels.where("not toxic").orderBy(*order).limit(MAX_CLEAN))
    return ids, weights


def counted(texts: DataFrame, candidates: frozenset | None = None) -> DataFrame:
    """In how many of the texts each term occurs; counts are combined in the task first."""
    def count(batch):
        found = Counter()
        for text in batch["text"]:
            found.update(terms_of(text) if candidates is None else terms_of(text) & candidates)
        return {"term": list(found), "n": list(found.values())}

    return map_batches(texts.select("text"), count, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    ids, stands_for = sampled(labels)
    ids = settled(ids)
    rows = settled(of_ids(docs.select("doc_id", "text"), ids.select("doc_id"), "doc_id").join(F.broadcast(ids), "doc_id").select("text", "toxic"))
    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    if not n_toxic or not n_clean:
        return Lexicon({}, (-700.0 if not n_toxic else 700.0, 0.0, 0.0), exceptions)
    common = counted(rows.where("toxic")).where("n >= 3").orderBy(F.desc("n"), "term").limit(MAX_CANDIDATES)
    toxic = {r.term: r.n for r in common.collect()}
    clean = {r.term: r.n for r in counted(rows.where("not toxic"), frozenset(toxic)).collect()}
    weights = chosen(toxic, clean, n_toxic, n_clean, stands_for[True], stands_for[False])
    lexicon = Lexicon(weights, exceptions=exceptions)
    raws = with_struct(rows, "text", lambda texts: [dict(zip(("total", "n_words"), lexicon.raw(t)[::2], strict=True)) for t in texts], "r", "total double, n_words bigint")
    points = raws.select("r.total", "r.n_words", F.col("toxic").cast("double")).toPandas().to_numpy(float)
    lexicon.curve = fitted(points, np.where(points[:, 2] > 0, stands_for[True], stands_for[False]))
    return lexicon


def chosen(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int, of_toxic: float = 1.0, of_clean: float = 1.0) -> dict[str, float]:
    """Terms that speak for a toxic text, the strongest first; a term that a chosen one begins, or is begun by, is left out.

    A toxic row stands for ``of_toxic`` rows, a clean one for ``of_clean``."""
    bar, base = 2 * math.log(max(2, len(toxic))), n_toxic / (n_toxic + n_clean)

    def gain(t, c):
        share = t / (t + c)
        if share <= base:
            return 0.0
        return 2 * (t * math.log(share / base) + (c * math.log((1 - share) / (1 - base)) if c else 0))

    ranked = sorted((-gain(t, clean.get(term, 0)), len(term), term) for term, t in toxic.items())
    weights: dict[str, float] = {}
    begun: set[str] = set()
    for minus, _, term in ranked:
        if -minus < bar or len(weights) == MAX_TERMS:
            break
        starts = {term[:i] for i in range(1, len(term) + 1)}
        if term in begun or starts & weights.keys():
            continue
        t, c = toxic[term], clean.get(term, 0)
        if t * of_toxic < MIN_PRECISION * (t * of_toxic + c * of_clean):
            continue
        weights[term] = math.log((t + 0.5) / (n_toxic + 1)) - math.log((c + 0.5) / (n_clean + 1))
        begun |= starts
    return weights


def fitted(points: np.ndarray, weights: np.ndarray, penalty: float = 1e-3) -> tuple[float, float, float]:
    """Logistic curve over the sum and the sum a thousand words of weighted rows, by Newton's method with a small ridge."""
    total, n_words, y = points.T
    weights = weights / weights.mean()
    x = np.stack([np.ones_like(y), np.log1p(total), np.log1p(1000 * total / np.maximum(n_words, 1))], 1)
    w = np.zeros(3)
    ridge = np.diag([1e-6, penalty, penalty]) * len(y)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weights * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weights * (p - y)) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def scored(docs: DataFrame, lexicon: Lexicon, name: str = "toxicity", text: str = "text") -> DataFrame:
    """``docs`` with a struct ``name``: score from 0 to 1 and number of matches."""
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)
    return with_struct(docs, text, lambda texts: [dict(zip(("score", "n_matches"), sent.value.score(t), strict=True)) for t in texts], name, "score double, n_matches bigint")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = scored(docs.select("doc_id", "text"), learn(docs, labels), "t")
    score = F.col("t.score")
    return out.select(
        "doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), score.alias("score"),
        (score >= 0.5).cast("int").alias("predicted"), F.col("t.n_matches").alias("n_matches"))
