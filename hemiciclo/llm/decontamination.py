"""Benchmark decontamination by a generalised suffix automaton.

The normalised words of the test items become one suffix automaton. A document's words are streamed
through it: the automaton's state is the longest suffix read so far that some item holds, and the links
to shorter suffixes tell which windows of ``window`` words end here and in which items. An item of fewer
words than a window is a window of its own. Words inside a window's occurrence are hit.

Items are dealt into automata of at most WORDS_PER_AUTOMATON words. Each takes one pass over the documents, whose
hits are merged as intervals. AUTOMATA_AT_ONCE of them are sent to the executors and passed in one stage; then the
documents with their hits are written down and the next ones take their place. So what the executors hold is bounded
however long the benchmark is, and the driver holds the items of one automaton.

Edge cases: null and empty texts have no words; an item without words has no window; items of one id are
one item; an item without an id hits, but isn't counted or named; repeated documents are judged each.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemiciclo.llm.common import free_name, plain_words, with_struct
from hemiciclo.sources.shared import settled

WINDOW = 10
WORDS_PER_AUTOMATON, AUTOMATA_AT_ONCE = 200_000, 4
#: A document of which more is hit is dropped; else only its hit spans go.
MAX_COVERAGE = 0.5
KIND = "n_words bigint, starts array<int>, ends array<int>, items array<string>"
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


class SuffixAutomaton:
    """Of several lists of words; states are numbers, 0 is the empty suffix."""

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window, self.ids = window, {}
        self.next, self.link, self.length = [{}], [-1], [0]
        self.whole: dict[int, dict[int, set]] = {}  # state: {length of a short item that ends here: its ids}
        self.holders: dict[int, set] = {}  # state of a window: ids of the items that hold it
        known = [(item, [self.ids.setdefault(w, len(self.ids)) for w in words]) for item, words in items if words]
        for _, word_ids in known:
            last = 0
            for c in word_ids:
                last = self._extend(last, c)
        for item, word_ids in known:
            state, n = 0, 0
            for c in word_ids:
                state, n = self.step(state, n, c)
                if n >= window:
                    self.holders.setdefault(self._cut(state, window), set()).add(item)
            if len(word_ids) < window:
                self.whole.setdefault(state, {}).setdefault(n, set()).add(item)
        # Whether a state or one that its links reach ends a short item.
        self.ends_short = [False] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.ends_short[state] = state in self.whole or self.ends_short[self.link[state]]

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, c)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, c)
        return new

    def _state(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _clone(self, p: int, q: int, c: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def step(self, state: int, n: int, c: int) -> tuple[int, int]:
        """The longest known suffix, and its length, once the word ``c`` is read."""
        while state and c not in self.next[state]:
            state = self.link[state]
            n = self.length[state]
        following = self.next[state].get(c)
        return (0, 0) if following is None else (following, n + 1)

    def _cut(self, state: int, n: int) -> int:
        """The state of the last ``n`` words of ``state``."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def hits(self, words: list[bytes]) -> tuple[list[int], list[int], set]:
        """Disjoint spans of hit words in order, and the ids of the items with a window in them."""
        starts, ends, items = [], [], set()
        state, n, window = 0, 0, self.window
        following, ends_short = self.next, self.ends_short
        for at, c in enumerate(map(self.ids.get, words)):
            if c is None:
                state = n = 0
                continue
            if c in following[state]:
                state, n = following[state][c], n + 1
            else:
                state, n = self.step(state, n, c)
            longest = 0
            if n >= window:
                longest = window
                items |= self.holders[self._cut(state, window)]
            if ends_short[state]:
                s = state
                while s > 0 and ends_short[s]:
                    for size, ids in self.whole.get(s, {}).items():
                        if size <= n:
                            longest = max(longest, size)
                            items |= ids
                    s = self.link[s]
            if longest:
                start = at + 1 - longest
                while starts and start <= ends[-1]:
                    start = min(start, starts.pop())
                    ends.pop()
                starts.append(start)
                ends.append(at + 1)
        return starts, ends, items


def automata(benchmark: DataFrame, window: int = WINDOW, bound: int = WORDS_PER_AUTOMATON):
    """Automata of all items, one at a time; the driver holds the items of one."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("text is not null")
    batch, size = [], 0
    for row in items.toLocalIterator():
        words = plain_words(row.text)
        if batch and size + len(words) > bound:
            yield SuffixAutomaton(batch, window)
            batch, size = [], 0
        batch.append((row.item, words))
        size += len(words)
    yield SuffixAutomaton(batch, window)


def merged(one: dict, other: dict) -> dict:
    spans = sorted([*zip(one["starts"], one["ends"], strict=True), *zip(other["starts"], other["ends"], strict=True)])
    starts, ends = [], []
    for start, end in spans:
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return {"n_words": one["n_words"], "starts": starts, "ends": ends, "items": sorted({*one["items"], *other["items"]})}


def with_hits(docs: DataFrame, benchmark: DataFrame, name: str = "hits", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with a struct ``name``: number of words, disjoint hit spans in words, ids of the items found."""
    spark, passes, sent_now = docs.sparkSession, [], []
    for automaton in automata(benchmark, window):
        if len(sent_now) == AUTOMATA_AT_ONCE:
            # What the last ones found is written down, and they leave the executors.
            docs, passes = _joined(docs, passes)
            docs = settled(docs)
            for sent in sent_now:
                sent.destroy()
            sent_now = []
        sent = spark.sparkContext.broadcast(automaton)
        sent_now.append(sent)

        def found(texts, sent=sent):
            rows = []
            for value in texts:
                words = plain_words(value)
                starts, ends, items = sent.value.hits(words)
                rows.append({"n_words": len(words), "starts": starts, "ends": ends, "items": sorted(x for x in items if x is not None)})
            return rows

        passes.append(free_name(docs, "_hits"))
        docs = with_struct(docs, text, found, passes[-1], KIND)
    docs, (last,) = _joined(docs, passes)
    return docs.withColumnRenamed(last, name)


def _joined(docs: DataFrame, passes: list[str]) -> tuple[DataFrame, list[str]]:
    """``docs`` with one struct of hits in place of several."""
    if len(passes) == 1:
        return docs, passes
    whole = free_name(docs, "_hits")
    return with_struct(docs, passes, lambda *found: [reduce(merged, row) for row in zip(*found, strict=True)], whole, KIND).drop(*passes), [whole]


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row for each document: how many words are hit and by which items."""
    h = with_hits(docs.select("doc_id", "text"), benchmark, "h", window=window).select("doc_id", "h.*")
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    return h.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def without_spans(text: str, starts: list[int], ends: list[int]) -> str:
    """``text`` without the given spans of words; the white space on one side goes with them."""
    raw = text.encode()
    places = [m.span() for m in _WORD.finditer(raw)]
    kept, at = [], 0
    for start, end in zip(starts, ends, strict=True):
        kept.append(raw[at:places[start][0]])
        at = places[end - 1][1]
    kept.append(raw[at:])
    return b"".join(kept).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, max_coverage: float = MAX_COVERAGE, window: int = WINDOW) -> DataFrame:
    """``docs`` without hit spans, and without documents of which more than ``max_coverage`` is hit.

    Documents without hits stay as they are, and all keep their columns; ``n_chars`` follows the text.
    """
    hits, cut = free_name(docs, "_hits"), free_name(docs, "_cut")
    marked = with_hits(docs, benchmark, hits, window=window)

    def cuts(texts, found):
        rows = []
        for value, row in zip(texts, found, strict=True):
            n_hit = sum(row["ends"]) - sum(row["starts"])
            stays = n_hit <= max_coverage * max(row["n_words"], 1)
            rows.append({"stays": stays, "text": without_spans(value, row["starts"], row["ends"]) if n_hit and stays else value, "changed": n_hit > 0})
        return rows

    marked = with_struct(marked, ["text", hits], cuts, cut, "stays boolean, text string, changed boolean").where(F.col(f"{cut}.stays"))
    made = {"text": F.col(f"{cut}.text")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(F.col(f"{cut}.changed"), F.length(f"{cut}.text").cast("long")).otherwise(F.col("n_chars"))
    return marked.select(*[made.get(c, F.col(c)).alias(c) for c in docs.columns])
