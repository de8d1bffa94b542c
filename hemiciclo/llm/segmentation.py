"""SentencePiece encoding and decoding with distinct sampled segmentations (Gumbel top-k by A* search).

A text's lattice holds every way to cut it into pieces of a given SentencePiece model. A segmentation's
probability is proportional to the product of its pieces' weights (a piece's weight falls with its rank in
the model, to the power ``sharpness``), so it is a chain of choices, one at each lattice node passed. Adding
Gumbel noise to all log probabilities and taking the ``k`` largest samples without replacement; the search
never lists them. It keeps regions of segmentations, each with the perturbed value of its best member:

- the root region's value is a Gumbel variate, its best member is drawn choice by choice;
- taking a region's member splits the rest by the choice at which they part from it; each part's value is a
  Gumbel variate at the part's log mass, truncated at the value taken;
- the next sample is the best member of the region with the largest value, found by best-first search.

Random numbers are hashes of the row's key, the sample and the place, so they depend on nothing else. Each
sample comes with its log probability, its perturbed value and its inclusion score: the probability that a
draw beats the (k+1)-th value (1 if there are no further segmentations).

White space, characters without a piece (by bytes) and U+2581 itself survive: decoding gives the text back
exactly. Edge cases: a null or empty text has one segmentation, of no pieces; a text with fewer than ``k``
segmentations gives those it has; repeated keys with equal texts get equal samples.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, count, islice

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from hemiciclo.llm.common import ROWS_PER_BATCH, free_name, schema_of, small_batches, with_struct

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES, SHARPNESS, SEED = 2, 1.0, 0
#: Characters that are searched together, and nodes whose lattices a worker remembers.
CHARS_AT_ONCE, MAX_NODES = 1_000_000, 3_500_000
PLACES, CLASSES = 128, 128
#: The largest value that a Gumbel variate made of 53 random bits can take.
HIGHEST = 36.75
_BLANK, _BYTE = "▁", 0xDC00
_LINE = chr(_BYTE + 10)
_UNIT = re.compile(f"{_BLANK}*[^{_BLANK}{_LINE}]+|{_BLANK}+|{_LINE}")
_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
KIND = "sample int, n_tokens int, log_prob double, perturbed double, inclusion double, ids array<int>"


def bits(base, *places) -> np.ndarray:
    """64 random bits for each base and place."""
    x = np.asarray(base, np.uint64)
    with np.errstate(over="ignore"):
        for place in places:
            x = (x + np.asarray(place, np.uint64) + _C1) * _C2
            x = (x ^ (x >> np.uint64(29))) * _C3
            x = x ^ (x >> np.uint64(32))
    return x


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of ranges, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0, dtype=np.int32) + np.repeat((starts - ends + sizes).astype(np.int32), sizes)


def gumbel(random_bits: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(((random_bits >> np.uint64(11)).astype(float) + 0.5) / 2.0**53))


class Pieces:
    """Pieces of a model: texts, weights and bytes. Byte pieces stand for one lone surrogate each."""

    def __init__(self, model_file: str = MODEL, sharpness: float = SHARPNESS):
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        self.texts: list[str | None] = [None] * n
        self.raw = [b""] * n
        self.sharpness = sharpness
        scores = np.full(n, np.nan)
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[1:-1], 16)
                self.texts[i], self.raw[i] = chr(_BYTE + value), bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                if _BLANK in piece.lstrip(_BLANK):
                    raise ValueError("pieces with a blank inside are not supported")
                self.texts[i], self.raw[i] = piece, piece.replace(_BLANK, " ").encode()
                scores[i] = model.get_score(i)
        rank = np.full(n, float(2 * n))  # byte pieces are the last resort
        known = np.flatnonzero(~np.isnan(scores))
        rank[known[np.argsort(-scores[known], kind="stable")]] = np.arange(len(known))
        self.weights = -sharpness * np.log(rank + 10)
        self.chars = frozenset(t for t in self.texts if t and len(t) == 1)
        self.sizes = np.array([len(x) for x in self.raw])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.joined = np.frombuffer(b"".join(self.raw), np.uint8)

    def bytes_of(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """UTF-8 of the texts of many segmentations, given one after the other."""
        sizes = self.sizes[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(ends[-1], dtype=np.int32) + np.repeat((self.starts[ids] - ends[:-1]).astype(np.int32), sizes)
        flat = self.joined[at].tobytes()
        # The blank before a text's first word isn't part of it.
        return [flat[a + 1:b] if b > a else b"" for a, b in zip(ends[offsets[:-1]].tolist(), ends[offsets[1:]].tolist(), strict=True)]


class Sampler:
    """Lattices of the words that a worker has met, and searches over texts made of them.

    Words (with the blanks before them) share no piece, so a text's lattice is its words' in a row. A
    node's edges lie side by side, the longest piece last, where a draw begins: it is taken most often.
    """

    def __init__(self, pieces: Pieces, max_nodes: int = MAX_NODES):
        self.pieces, self.max_nodes = pieces, max_nodes
        self.automaton = None
        self.sizes = np.array([len(t or "") for t in pieces.texts])
        common = Counter(c for t in pieces.texts if t for c in t).most_common(CLASSES - 1)
        self.common = frozenset(c for c, _ in common)
        self.classes = np.zeros(0x110000, np.uint8)
        self.classes[[ord(c) for c, _ in common]] = np.arange(1, len(common) + 1)
        # A trie as a table for pieces of common characters; words with others take the automaton.
        heads = {"": 0}
        plain = [(i, t) for i, t in enumerate(pieces.texts) if t and self.common.issuperset(t)]
        for _, text in plain:
            for n in range(1, len(text) + 1):
                heads.setdefault(text[:n], len(heads))
        self.trie, self.accepts = np.zeros((len(heads), CLASSES), np.int32), np.full(len(heads), -1, np.int32)
        for head, state in heads.items():
            if head:
                self.trie[heads[head[:-1]], self.classes[ord(head[-1])]] = state
        for i, text in plain:
            self.accepts[heads[text]] = i
        # Words by the order in which they were met; of each: its first node, its nodes, batches that used it.
        self.units: defaultdict[str, int] = defaultdict(count().__next__)
        self.first, self.nodes, self.used = (np.empty(1 << 12, np.int32) for _ in range(3))
        self.n_nodes = self.n_edges = 0
        self.chance, self.costs = np.empty(1 << 16, np.float32), np.empty(1 << 16, np.float32)
        self.target, self.piece = np.empty(1 << 16, np.int32), np.empty(1 << 16, np.int32 if len(self.sizes) > 65_536 else np.uint16)
        self.last = np.empty(1 << 16, np.int32)  # of each node: last edge

    def forget(self, keep: int = 2) -> None:
        """Drop lattices but of words used ``keep`` times or more since the last time."""
        kept = np.flatnonzero(self.used[:len(self.units)] >= keep)
        if len(kept) * 8 >= self.max_nodes // 2:
            kept = kept[:0]
        chosen = np.zeros(len(self.units), bool)
        chosen[kept] = True
        words = [u for u, stays in zip(self.units, chosen.tolist(), strict=True) if stays]
        self.units = defaultdict(count(len(words)).__next__, zip(words, range(len(words)), strict=True))
        # Nodes and edges of a word lie side by side, in the order of the nodes.
        by_node = np.argsort(self.first[kept])
        first, sizes = self.first[kept][by_node].astype(np.int64), self.nodes[kept][by_node]
        ends = np.cumsum(sizes)
        begin = np.where(first > 0, self.last[first - 1] + 1, 0)
        n_edges = self.last[first + sizes - 1] + 1 - begin
        moved = (ends - sizes - first).astype(np.int32)
        at = ranges(begin, n_edges)
        for name in ("chance", "costs", "target", "piece"):
            setattr(self, name, getattr(self, name)[at])
        self.target += np.where(self.target >= 0, np.repeat(moved, n_edges), 0).astype(np.int32)
        self.last = self.last[ranges(first, sizes)] + np.repeat((np.cumsum(n_edges) - n_edges - begin).astype(np.int32), sizes)
        where = np.empty(len(kept), np.int32)
        where[by_node] = ends - sizes
        self.first, self.nodes, self.used = where, self.nodes[kept], np.zeros(len(kept), np.int32)
        self.n_nodes, self.n_edges = len(self.last), len(at)

    def numbers_of(self, units: Iterator[str], n: int) -> np.ndarray:
        """Numbers of ``n`` words; the lattices of new ones are added."""
        known = len(self.units)
        numbers = np.fromiter(map(self.units.__getitem__, units), np.int64, n)
        if len(self.units) > known:
            self.learn(list(islice(reversed(self.units), len(self.units) - known))[::-1], known)
        return numbers

    def learn(self, units: list[str], known: int, at_once: int = 20_000) -> None:
        """Add the lattices of new words, whose numbers begin with ``known``."""
        self._grow(("first", "nodes", "used"), known, len(units))
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        odd = np.logical_or.reduceat(self.classes[codes] == 0, np.cumsum(sizes) - sizes)
        for some, matches in ((np.flatnonzero(odd), self._by_automaton), (np.flatnonzero(~odd), self._by_trie)):
            for start in range(0, len(some), at_once):
                rows = some[start:start + at_once]
                self._learn([units[i] for i in rows.tolist()], rows + known, matches)

    def _by_automaton(self, joined: str) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces begin, and which ones; sorted by place and length."""
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for i, text in enumerate(self.pieces.texts):
                if text is not None:
                    self.automaton.add_word(text[::-1], i)  # backwards: matches come out in the order of their beginnings
            self.automaton.make_automaton()
        found = np.fromiter(chain.from_iterable(self.automaton.iter(joined[::-1])), np.int64).reshape(-1, 2)[::-1]
        return len(joined) - 1 - found[:, 0], found[:, 1]

    def _by_trie(self, joined: str) -> tuple[np.ndarray, np.ndarray]:
        """The same, all places at once, one character further at a time."""
        classes = self.classes[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
        at, size, found = np.flatnonzero(classes), 0, []
        state = np.zeros(len(at), np.int32)
        counts = np.zeros(len(joined), np.int64)
        while len(at):
            state = self.trie[state, classes[at + size]]
            on = np.flatnonzero(state)
            at, state, size = at[on], state[on], size + 1
            piece = self.accepts[state]
            hit = np.flatnonzero(piece >= 0)
            found.append((at[hit], piece[hit], counts[at[hit]]))
            counts[at[hit]] += 1
        before = np.cumsum(counts) - counts
        places, pieces = np.empty(int(counts.sum()), np.int64), np.empty(int(counts.sum()), np.int64)
        for place, piece, earlier in found:
            to = before[place] + earlier
            places[to], pieces[to] = place, piece
        return places, pieces

    def _learn(self, units: list[str], numbers: np.ndarray, find) -> None:
        lengths = np.fromiter(map(len, units), np.int64, len(units)) + 1
        ends = np.cumsum(lengths)
        n = int(ends[-1])
        self.first[numbers], self.nodes[numbers], self.used[numbers] = self.n_nodes + ends - lengths, lengths, 0
        joined = "\0".join(units) + "\0"
        a, piece = find(joined)
        b = a + self.sizes[piece]
        closing = np.repeat(ends - 1, lengths)  # of each node, its word's last node
        left = closing[a] - a
        order = np.argsort(left.astype(np.uint16) if n < 65_536 or left.max() < 65_536 else left, kind="stable")
        weight, mass = self.pieces.weights[piece], np.zeros(n)
        from_, to, by = a[order], b[order], weight[order]
        bounds = np.flatnonzero(np.diff(left[order], prepend=0))
        heads_of = np.diff(from_, prepend=-1) != 0
        for start, end in zip(bounds, [*bounds[1:], len(left)], strict=True):
            heads = np.flatnonzero(heads_of[start:end])
            mass[from_[start:end][heads]] = np.logaddexp.reduceat(by[start:end] + mass[to[start:end]], heads)
        counts = np.bincount(a, minlength=n)
        cost = np.minimum(weight + mass[b] - mass[a], 0.0)
        cost[counts[a] == 1] = 0.0
        after = np.cumsum(counts)
        chance = np.exp(cost)
        chance[(after - counts)[counts > 0]] = 2.0  # where a draw ends at the latest
        self._grow(("chance", "costs", "target", "piece"), self.n_edges, len(a))
        self._grow(("last",), self.n_nodes, n)
        e, v = self.n_edges, self.n_nodes
        self.chance[e:e + len(a)] = chance
        self.costs[e:e + len(a)] = cost
        self.target[e:e + len(a)] = np.where(b == closing[a], -1, v + b)
        self.piece[e:e + len(a)] = piece
        self.last[v:v + n] = e + after - 1
        self.n_edges += len(a)
        self.n_nodes += n

    def _grow(self, names: tuple[str, ...], size: int, more: int) -> None:
        for name in names:
            if size + more > len(old := getattr(self, name)):
                setattr(self, name, np.concatenate([old, np.empty(size + 2 * more, old.dtype)]))

    def edges_of(self, edge: int) -> range:
        """All edges of the node that an edge leaves."""
        low = high = edge
        while self.chance[low] <= 1.0:
            low -= 1
        while high + 1 < self.n_edges and self.chance[high + 1] <= 1.0:
            high += 1
        return range(low, high + 1)

    def cut(self, texts: list[str | None]) -> list[list[str]]:
        """Words of texts; characters without a piece are spelt as bytes."""
        unknown = set().union(*(t for t in texts if t)) - self.pieces.chars - {" "} | {_BLANK}
        spelt = {c: "".join(chr(_BYTE + b) for b in c.encode()) for c in unknown}
        out = []
        for text in texts:
            if not text:
                out.append([])
                continue
            if len(spelt) < 40:
                for c, by in spelt.items():
                    text = text.replace(c, by)
            else:
                text = text.translate({ord(c): by for c, by in spelt.items()})
            out.append(_UNIT.findall(_BLANK + text.replace(" ", _BLANK)))
        return out

    def draw(self, node, base, unit, sample: int):
        """Walk from each node to its word's end; pieces taken, in the order of the words.

        Gives edges, and how many of them each word has.
        """
        n = len(node)
        taken, where, steps = [], [], np.zeros(n, np.int64)
        active, node = np.flatnonzero(node >= 0), node[node >= 0]
        base, unit, step = base[active], unit[active], 0
        while len(active):
            share = (bits(base, unit, step * 64 + sample) >> np.uint64(11)).astype(float) / 2.0**53
            edge = self.last[node]
            chance = self.chance[edge]
            missed = np.flatnonzero(share >= chance)
            while len(missed):
                share[missed] -= chance[missed]
                edge[missed] -= 1
                chance[missed] = self.chance[edge[missed]]
                missed = missed[share[missed] >= chance[missed]]
            taken.append(edge)
            where.append(active)
            steps[active] += 1
            node = self.target[edge]
            on = np.flatnonzero(node >= 0)
            active, node, base, unit = active[on], node[on], base[on], unit[on]
            step += 1
        edges = np.empty(int(steps.sum()), np.int64)
        offsets = np.cumsum(steps) - steps
        for k, (edge, at) in enumerate(zip(taken, where, strict=True)):
            edges[offsets[at] + k] = edge
        return edges, steps

    def search(self, texts: list[str | None], seeds: list[int], k: int) -> list[list[tuple[float, float, float, np.ndarray]]]:
        """For each text its samples, best first: log probability, perturbed value, inclusion score, ids."""
        cut = self.cut(texts)
        if self.n_nodes > self.max_nodes:
            self.forget()
        sizes = np.array([len(u) for u in cut])
        numbers = self.numbers_of(chain.from_iterable(cut), int(sizes.sum()))
        self.used[numbers] += 1
        start = self.first[numbers].astype(np.int64)
        doc = np.repeat(np.arange(len(cut)), sizes)
        at = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        base = np.array(seeds, np.uint64)
        edges, steps = self.draw(start, base[doc], at, 0)
        ends = np.cumsum(np.bincount(doc, weights=steps, minlength=len(cut)).astype(np.int64)) if len(doc) else np.zeros(len(cut), np.int64)
        found, regions = [], []
        tops = gumbel(bits(base, 1 << 60))
        for d in range(len(cut)):
            path = edges[ends[d - 1] if d else 0:ends[d]]
            found.append([(path, tops[d])])
            regions.append([])
        self._split_all(regions, [(d, paths[0][0], 0, (), paths[0][1]) for d, paths in enumerate(found)], base, 0, k)
        firsts = np.cumsum(sizes) - sizes
        for sample in range(1, k):
            todo, nodes, owners, places = [], [], [], []
            for d, heap in enumerate(regions):
                if not heap:
                    continue
                value, path, t, taboo = heap.pop(0)
                choices = np.array([e for e in self.edges_of(path[t]) if e not in taboo])
                mass = np.cumsum(np.exp(self.costs[choices].astype(float)))
                pick = choices[np.searchsorted(mass[:-1], mass[-1] * float(bits(base[d], 2 << 60, sample) >> np.uint64(11)) / 2.0**53, side="right")]
                # The word in which the paths part: as many words are complete as edges before it end one.
                unit = int((self.target[path[:t]] < 0).sum())
                rest = start[firsts[d] + unit:firsts[d] + sizes[d]].copy()
                rest[0] = self.target[pick]
                todo.append((d, value, path[:t], pick, t, taboo))
                nodes.append(rest)
                owners.append(np.full(len(rest), d))
                places.append(np.arange(unit, sizes[d]))
            if not todo:
                break
            owner = np.concatenate(owners)
            edges, steps = self.draw(np.concatenate(nodes), base[owner], np.concatenate(places), sample)
            counts = np.bincount(owner, weights=steps, minlength=len(cut)).astype(np.int64)
            end, split = 0, []
            for d, value, head, pick, t, taboo in todo:
                path = np.concatenate([head, [pick], edges[end:end + counts[d]]])
                end += counts[d]
                found[d].append((path, value))
                split.append((d, path, t, taboo, value))
            self._split_all(regions, split, base, sample, k)
        out = []
        for d, samples in enumerate(found):
            limit = regions[d][0][0] if regions[d] else -np.inf
            rows = []
            for path, value in samples:
                log_prob = float(self.costs[path].sum(dtype=float))
                inclusion = 1.0 if limit == -np.inf else float(-np.expm1(-np.exp(min(log_prob - limit, 700.0))))
                rows.append((log_prob, float(value), inclusion, self.piece[path].astype(np.int32)))
            out.append(rows)
        return out

    def _split_all(self, regions: list[list], taken: list[tuple], base: np.ndarray, sample: int, k: int) -> None:
        """Add the regions into which what is left falls once the paths of some texts are taken; keep the best.

        Only so many samples are wanted, so more than k regions of a text are never needed. Values are drawn
        in the order of places until none that follows can be among them: mass only falls along a path.
        """
        before = [float(self.costs[path[:t]].sum(dtype=float)) for _, path, t, _, _ in taken]
        while taken:
            sizes = np.array([min(PLACES, len(path) - t) for _, path, t, _, _ in taken])
            there = np.arange(PLACES) < sizes[:, None]
            edges = np.zeros((len(taken), PLACES), np.int64)
            edges[there] = np.concatenate([path[t:t + PLACES] for _, path, t, _, _ in taken])
            costs = np.where(there, self.costs[edges], 0.0).astype(float)
            with np.errstate(divide="ignore"):
                rest = np.log1p(-np.exp(costs))
                for i, (_, path, t, taboo, _) in enumerate(taken):
                    if taboo:
                        shut = len(taboo) + 1 == len(self.edges_of(path[t]))
                        rest[i, 0] = -np.inf if shut else np.log(max(0.0, 1 - np.exp(costs[i, 0]) - np.exp(self.costs[list(taboo)].astype(float)).sum()))
            mass = np.array(before)[:, None] + np.cumsum(costs, 1) - costs + rest
            mass[~there] = -np.inf
            place = np.array([t for _, _, t, _, _ in taken])[:, None] + np.arange(PLACES)
            free = mass + gumbel(bits(base[[d for d, *_ in taken]][:, None], (3 << 60) + sample, place))
            # Variates at the masses, truncated at the value that was taken.
            value = -np.logaddexp(-np.array([x[4] for x in taken])[:, None], -free)
            best = np.argsort(-value, axis=1, kind="stable")[:, :k]
            more, left, highest, passed = [], [], value.max(axis=1).tolist(), costs.sum(axis=1).tolist()
            for i, (d, path, t, taboo, bound) in enumerate(taken):
                heap = regions[d]
                if len(heap) < k or highest[i] > heap[-1][0]:
                    for j in best[i]:
                        if mass[i, j] > -np.inf:
                            heap.append((float(value[i, j]), path, t + int(j), (*taboo, int(path[t])) if j == 0 else (int(path[t + j]),)))
                    heap.sort(key=lambda x: -x[0])
                    del heap[k:]
                rest_of = before[i] + passed[i]
                if t + PLACES < len(path) and (len(heap) < k or rest_of + HIGHEST >= heap[-1][0]):
                    more.append((d, path, t + PLACES, (), bound))
                    left.append(rest_of)
            taken, before = more, left


_samplers: dict[tuple, Sampler] = {}


def sampler_of(pieces: Pieces, name: tuple, max_nodes: int, lasting: bool) -> Sampler:
    """A sampler of a task, or of a worker for all its tasks."""
    if not lasting:
        return Sampler(pieces, max_nodes)
    if name not in _samplers:
        _samplers[name] = Sampler(pieces, max_nodes)
    return _samplers[name]


def decoded(ids, pieces: Pieces) -> str:
    """The text of a segmentation."""
    return b"".join(map(pieces.raw.__getitem__, ids))[1:].decode()


def encode(df: DataFrame, key: str, text: str = "text", k: int = SAMPLES, seed: int = SEED, model_file: str = MODEL, sharpness: float = SHARPNESS,
           chars_at_once: int = CHARS_AT_ONCE, max_nodes: int = MAX_NODES, lasting: bool = True) -> DataFrame:
    """Up to ``k`` rows for each row of ``df``: key, number of the sample, its scores and the piece ids.

    The model is read by the driver and sent along. Decoding every row must give its text back, or the task fails.
    ``chars_at_once`` and ``max_nodes`` bound a worker's memory, and unless ``lasting`` it is freed after each
    task; they cost time and change no result.
    """
    if k < 1:
        raise ValueError("at least one sample")
    sent = df.sparkSession.sparkContext.broadcast(Pieces(model_file, sharpness))
    name = (model_file, sharpness, max_nodes)
    kind = schema_of(f"{key} {df.schema[key].dataType.simpleString()}, {KIND}")
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = sampler_of(sent.value, name, max_nodes, lasting)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_PER_BATCH):
                keys, texts = (c.to_pylist() for c in batch.slice(start, ROWS_PER_BATCH).columns)
                while texts:
                    n = size = 0
                    while n < len(texts) and (not n or size + len(texts[n] or "") <= chars_at_once):
                        size += len(texts[n] or "")
                        n += 1
                    yield rows_of(sampler, keys[:n], texts[:n])
                    keys, texts = keys[n:], texts[n:]
        pa.default_memory_pool().release_unused()

    def rows_of(sampler, keys, texts):
        seeds = [xxhash.xxh64_intdigest(str(x), seed=seed) for x in keys]
        columns, ids, wanted = [[] for _ in range(6)], [], []
        for row_key, text, samples in zip(keys, texts, sampler.search(texts, seeds, k), strict=True):
            raw = (text or "").encode()
            for i, (log_prob, value, inclusion, found) in enumerate(samples):
                for column, x in zip(columns, (row_key, i + 1, len(found), log_prob, value, inclusion), strict=True):
                    column.append(x)
                ids.append(found)
                wanted.append(raw)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
        if sampler.pieces.bytes_of(flat, offsets) != wanted:
            raise ValueError("a segmentation doesn't give its text back")
        arrays = [pa.array(c, f.type) for c, f in zip(columns, arrow, strict=False)]
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()), type=arrow.field(6).type)
        return pa.RecordBatch.from_arrays([*arrays, lists], schema=arrow)

    return small_batches(df.select(key, text)).mapInArrow(run, kind)


def decode(df: DataFrame, ids: str = "ids", text: str = "text", model_file: str = MODEL) -> DataFrame:
    """``df`` with the column ``text`` of its piece ids; null ids give null."""
    sent = df.sparkSession.sparkContext.broadcast(Pieces(model_file))
    name = free_name(df, "_decoded")
    out = with_struct(df, ids, lambda rows: [{"text": None if r is None else decoded(r, sent.value)} for r in rows], name, "text string")
    return out.withColumn(text, F.col(f"{name}.text")).drop(name)
