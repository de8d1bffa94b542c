"""Removal of repeated byte strings by suffix buckets and difference-cover ranks.

A byte goes if a string of SPAN bytes that covers it also starts in a document with a smaller id. Sorting
all suffixes together would bring equal strings side by side; here buckets of suffixes are sorted one at a
time, and only those that can matter are ever moved:

1. Buckets. Of the GRAM-byte strings in each SPAN-byte window, the one with the least hash is the window's
   anchor, so equal windows have equal anchors at equal places. Windows in a row with one anchor form a
   context. For each anchor a hash of its string (the bucket) and one of its context go to a task, with
   the document's id. A context that also occurs in a smaller document is covered as a whole. Contexts
   that are first in their document order, but share their anchor's string with other contexts, are open.
2. Ranks. The bytes of the open contexts are gathered by anchor string and laid side by side, anchors in one
   column. Columns of a difference cover (places 0, 1, 3 modulo 7) get precomputed ranks of the RANKED
   bytes from there. The suffixes at any column are then sorted by the few bytes before the next cover
   column and by ranks, never by comparing long equal strings; each group of equal windows is covered
   but in the document with the group's smallest id.
3. Each document adds up its covered windows.

Bounds: a task of step 1 holds one bucket, the anchors of some BUCKET_BYTES of texts on average, and a document's
or a task's repeated contexts are combined before they move. Step 2 sorts BLOCK rows at a time, or one group if that
is larger: anchor strings with very many contexts are split by the bytes beside the anchor, but the contexts at the
edge of a passage that many documents share stay one group, which grows with those documents. Texts move twice
(to meet their marks); each step's result is written to the shared folder.

Chances: strings meet by 40 bits of an anchor's hash and 48 of its context's, so two different ones are taken for
equal with a chance of 2 ** -88 a pair; in a document a context is found again by the 48 bits alone.

Edge cases: a null or empty text has no bytes; texts shorter than SPAN bytes lose nothing; rows with one
id don't cover each other; a null id counts as larger than all others; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hemiciclo.llm.common import ROWS_PER_BATCH, free_name, lean, schema_of, small_batches
from hemiciclo.sources.shared import settled
from hemiciclo.sources.writers import input_bytes

SPAN, GRAM = 50, 20
WINDOWS = SPAN - GRAM + 1  # places of an anchor in a window
COVER, PERIOD, RANKED = (0, 1, 3), 7, 24
#: Bytes of a text that are hashed in one go, anchors that a task combines, rows that are sorted together.
PIECE, ANCHORS, BLOCK = 1 << 19, 250_000, 50_000
#: Bytes of short texts that are hashed together: arrays of 8 bytes for each stay below what ``lean`` maps anew each time.
TOGETHER = 1 << 16
#: Stored bytes of texts whose anchors make up a bucket; estimates above this are checked by adding the texts up.
BUCKET_BYTES, DOUBTFUL_BYTES = 8 << 20, 100 << 30
#: An anchor string with more contexts than this is split by the bytes before or after it.
MANY = 4_096
LAST_ID = 2**63 - 1
_K = 0x9E3779B97F4A7C15
_M = 2**64
_LOW, _MARK = np.uint64((1 << 20) - 1), np.uint64((1 << 48) - 1)
COVERED, OPEN, SPLIT = 0, 1, 2


@lru_cache(1)
def _tables(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random odd number for each byte; powers of the base and of its inverse."""
    numbers = [int.from_bytes(hashlib.blake2b(bytes([i]), digest_size=8).digest(), "big") | 1 for i in range(256)]
    powers, inverse = np.full(size, _K, np.uint64), np.full(size, pow(_K, -1, _M), np.uint64)
    powers[0] = inverse[0] = 1
    return np.array(numbers, np.uint64), np.cumprod(powers), np.cumprod(inverse)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Anchors(NamedTuple):
    """Contexts of some texts: which text, first and last window, anchor, hash of its string, hash of the context."""

    text: np.ndarray
    first: np.ndarray
    last: np.ndarray
    at: np.ndarray
    gram: np.ndarray
    mark: np.ndarray


def anchors(texts: list[bytes]) -> Anchors:
    parts, group, size, most = [], [], 0, min(PIECE, TOGETHER)
    for i, text in enumerate(texts):
        for start in range(0, len(text) - SPAN + 1, PIECE):
            piece = text[start:start + PIECE + SPAN - 1]
            if size + len(piece) > most and group:
                parts.append(_anchors(group))
                group, size = [], 0
            group.append((i, start, piece))
            size += len(piece)
    if group:
        parts.append(_anchors(group))
    if not parts:
        none = np.empty(0, np.int64)
        return Anchors(none, none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    return Anchors(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def _anchors(group: list[tuple[int, int, bytes]]) -> Anchors:
    numbers, powers, inverse = _tables(2 * PIECE)
    raw = np.frombuffer(b"".join(p for _, _, p in group), np.uint8)
    sizes = np.array([len(p) for _, _, p in group])
    starts = np.cumsum(sizes) - sizes
    x, n = numbers[raw], len(raw)
    # Strings of 2, 4, 8, 16 and so GRAM bytes.
    two = x[:-1] * powers[1] + x[1:]
    four = two[:-2] * powers[2] + two[2:]
    eight = four[:-4] * powers[4] + four[4:]
    sixteen = eight[:-8] * powers[8] + eight[8:]
    gram = _mixed(sixteen[:-4] * powers[4] + four[16:16 + n - GRAM + 1])
    # The least hash, the first of equals, among WINDOWS places.
    least = (gram & ~_LOW) | np.arange(len(gram), dtype=np.uint64)
    for step in (1, 2, 4, 8):
        least = np.minimum(least[:-step], least[step:])
    at = (np.minimum(least[:-(WINDOWS - 16)], least[WINDOWS - 16:]) & _LOW).astype(np.int64)
    piece = np.repeat(np.arange(len(group)), sizes)[:len(at)]
    window = np.flatnonzero(np.arange(len(at)) + SPAN <= (starts + sizes)[piece])
    at = at[window]
    new = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(window, prepend=-2) != 1))
    first, last, at = window[new], window[np.append(new[1:], len(window)) - 1], at[new]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * powers[:n])])
    whole = (sums[last + SPAN] - sums[first]) * inverse[first]
    mark = _mixed(whole + (at - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) & _MARK
    piece = piece[first]
    owner, base = np.array([i for i, _, _ in group])[piece], np.array([s for _, s, _ in group])[piece] - starts[piece]
    return Anchors(owner, first + base, last + base, at + base, gram[at], mark)


def _heads(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new key begins."""
    new = np.zeros(len(sorted_keys[0]), bool)
    new[:1] = True
    for key in sorted_keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def _packed(gram: np.ndarray, mark: np.ndarray, ids: np.ndarray) -> bytes:
    """Rows of a bucket in few bytes: 5 of the string's hash, 6 of the context's, ids once each."""
    order = np.argsort(ids, kind="stable")
    gram, mark, ids = gram[order], mark[order], ids[order]
    head = _heads(ids)
    counts = np.diff(np.append(head, len(ids)))
    known = zlib.compress(np.diff(ids[head], prepend=0).astype("<i8").tobytes() + counts.astype("<i4").tobytes(), 1)
    cut = [a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].tobytes() for a, n in ((gram, 5), (mark, 6))]
    return np.array([len(ids), len(head), len(known)], "<i4").tobytes() + known + cut[0] + cut[1]


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, heads, size = np.frombuffer(blob, "<i4", 3)
    known = zlib.decompress(blob[12:12 + size])
    ids = np.repeat(np.cumsum(np.frombuffer(known, "<i8", heads)), np.frombuffer(known, "<i4", heads, 8 * heads))
    out, at = [], 12 + int(size)
    for width in (5, 6):
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(blob, np.uint8, n * width, at).reshape(n, width)
        out.append(wide.view("<u8").ravel())
        at += int(n) * width
    return out[0], out[1], ids


def _lists(counts: np.ndarray, flat: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int64)), type=kind)


def _bytes(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode() for t in texts]


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), "text")


def bucketed(docs: DataFrame, n_buckets: int) -> DataFrame:
    """Anchors of ``docs`` (id, text) by bucket, packed; or ids with contexts known to be covered."""
    kind = schema_of("bucket int, rows binary, id bigint, marks array<bigint>")
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        held, size = [], 0

        def flush():
            gram, mark, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()  # before the sorted copies are made
            order = np.lexsort((ids, mark, gram))
            gram, mark, ids = gram[order], mark[order], ids[order]
            head = _heads(gram, mark)
            least = np.repeat(ids[head], np.diff(np.append(head, len(ids))))
            later = np.flatnonzero(ids > least)
            later = later[np.argsort(ids[later], kind="stable")]
            bucket = (gram[head] >> np.uint64(40)) % np.uint64(n_buckets)
            order = np.argsort(bucket, kind="stable")
            bucket, head = bucket[order], head[order]
            cuts = _heads(bucket) if len(bucket) else []
            for start, end in zip(cuts, [*cuts[1:], len(bucket)], strict=True):
                rows = head[start:end]
                columns = ([int(bucket[start])], [_packed(gram[rows], mark[rows], ids[rows])], [None], [None])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
            if len(later):
                heads = _heads(ids[later])
                owners = ids[later][heads]
                yield pa.RecordBatch.from_arrays([
                    pa.array((owners % n_buckets).astype(np.int32)), pa.nulls(len(heads), pa.binary()), pa.array(owners),
                    _lists(np.diff(np.append(heads, len(later))), mark[later], arrow.field(3).type)], schema=arrow)

        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_PER_BATCH):
                ids, texts = (c.to_pylist() for c in batch.slice(start, ROWS_PER_BATCH).columns)
                found = anchors(_bytes(texts))
                if len(found.text):
                    ids = np.array(ids, np.int64)[found.text]
                    order = np.lexsort((found.mark, ids))
                    order = order[_heads(ids[order], found.mark[order])]  # a context counts once in a document
                    held.append((found.gram[order], found.mark[order], ids[order]))
                    size += len(order)
                if size > ANCHORS:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return small_batches(docs).mapInArrow(run, kind)


def _buckets(docs: DataFrame) -> int:
    """As many buckets as the bytes ask for. Rows made in memory and joins have no usable estimate: theirs is far too large."""
    size = input_bytes(docs)
    if size > DOUBTFUL_BYTES:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))


def marked(docs: DataFrame) -> DataFrame:
    """By document its contexts that are covered, open, or open with very many others: id, kind, marks."""
    n_buckets = _buckets(docs)
    kind = schema_of("id bigint, kind int, marks array<bigint>")
    arrow = to_arrow_schema(kind)

    def resolve(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        gram, mark, ids = (np.concatenate(x) for x in zip(*map(_unpacked, blobs), strict=True))
        order = np.lexsort((ids, mark, gram))
        gram, mark, ids = gram[order], mark[order], ids[order]
        context = _heads(gram, mark)
        least = np.repeat(ids[context], np.diff(np.append(context, len(ids))))
        group = _heads(gram)
        sizes = np.diff(np.append(group, len(ids)))
        contexts = np.diff(np.append(np.searchsorted(context, group), len(context)))
        several = np.repeat((contexts > 1) & (np.minimum.reduceat(ids, group) < np.maximum.reduceat(ids, group)), sizes)
        many = np.repeat(contexts > MANY, sizes)
        is_first = np.zeros(len(ids), bool)
        is_first[context] = True
        what = np.where(ids > least, COVERED, np.where(several & is_first, np.where(many, SPLIT, OPEN), -1))
        rows = np.flatnonzero(what >= 0)
        rows = rows[np.lexsort((what[rows], ids[rows]))]
        if len(rows):
            head = _heads(ids[rows], what[rows])
            yield pa.RecordBatch.from_arrays([
                pa.array(ids[rows][head]), pa.array(what[rows][head].astype(np.int32)),
                _lists(np.diff(np.append(head, len(rows))), mark[rows], arrow.field(2).type)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        now, blobs = None, []
        for batch in batches:
            known = batch.filter(pa.compute.is_null(batch.column(1)))
            if known.num_rows:
                yield pa.RecordBatch.from_arrays([known.column(2), pa.array(np.full(known.num_rows, COVERED, np.int32)), known.column(3)], schema=arrow)
            rest = batch.filter(pa.compute.is_valid(batch.column(1)))
            for bucket, rows in zip(rest.column(0).to_pylist(), rest.column(1).to_pylist(), strict=True):
                if bucket != now and blobs:
                    yield from resolve(blobs)
                    blobs = []
                now = bucket
                blobs.append(rows)
        if blobs:
            yield from resolve(blobs)

    rows = bucketed(docs, n_buckets).repartition(n_buckets, "bucket").sortWithinPartitions("bucket")
    return small_batches(rows).mapInArrow(run, kind)


def _of_texts(text: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """One number for a text of a batch (of at most 2**16) and a context in it."""
    return (text.astype(np.uint64) << np.uint64(48)) | mark.astype(np.uint64)


def _wanted(lists: list[list[int] | None]) -> np.ndarray:
    counts = [len(x or ()) for x in lists]
    flat = np.fromiter((m for x in lists for m in x or ()), np.int64, sum(counts))
    return np.unique(_of_texts(np.repeat(np.arange(len(lists)), counts), flat))


def _in(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(wanted):
        return np.zeros(len(keys), bool)
    return wanted[np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)] == keys


def open_contexts(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """The bytes of open contexts: key of their group, id, mark, places of the anchor in the first and last window."""
    def lists_of(what):
        return F.flatten(F.collect_list(F.when(F.col("kind") == what, F.col("marks")))).alias(f"kind{what}")

    lists = marks.where(F.col("kind") != COVERED).groupBy("id").agg(lists_of(OPEN), lists_of(SPLIT))
    kind = schema_of("key bigint, id bigint, mark bigint, left int, right int, context binary")
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_PER_BATCH):
                ids, texts, plain, split = (c.to_pylist() for c in batch.slice(start, ROWS_PER_BATCH).columns)
                texts = _bytes(texts)
                found = anchors(texts)
                keys = _of_texts(found.text, found.mark)
                keys, once = np.unique(keys, return_index=True)
                found = Anchors(*(x[once] for x in found))
                out = []
                rows = np.flatnonzero(_in(keys, _wanted(plain)))
                for i, first, last, at, gram, mark in zip(*(x[rows].tolist() for x in found), strict=True):
                    out.append((gram, ids[i], mark, at - first, at - last, texts[i][first:last + SPAN]))
                rows = np.flatnonzero(_in(keys, _wanted(split)))
                for i, first, last, at, gram, mark in zip(*(x[rows].tolist() for x in found), strict=True):
                    # Windows that reach far to the left hold these bytes before the anchor, others those after it.
                    half = WINDOWS // 2 + 1
                    if at - first >= half:
                        end = min(last, at - half)
                        out.append((_beside(gram, b"<" + texts[i][at - half:at]), ids[i], mark, at - first, at - end, texts[i][first:end + SPAN]))
                    begin = max(first, at - half + 1)
                    if begin <= last:
                        out.append((_beside(gram, b">" + texts[i][at + GRAM:at + SPAN - half + 1]), ids[i], mark, at - begin, at - last, texts[i][begin:last + SPAN]))
                if out:
                    key, *rest = zip(*out, strict=True)
                    columns = [np.array(key, np.uint64).view(np.int64), *rest]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return small_batches(docs.join(lists, "id")).mapInArrow(run, kind)


def _beside(gram: int, text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(gram.to_bytes(8, "big") + text, digest_size=8).digest(), "big")


def covered_windows(key, ids, left, right, contexts: list[bytes]) -> np.ndarray:
    """For each context which windows also occur in a smaller document, as bits by the anchor's place.

    Rows are sorted by ``key``; windows count as equal only under one key.
    """
    n, width = len(key), WINDOWS - 1 + SPAN
    laid = np.zeros((n, width), np.uint8)
    sizes = np.fromiter(map(len, contexts), np.int64, n)
    row = np.repeat(np.arange(n), sizes)
    within = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    laid[row, within + (WINDOWS - 1 - left)[row]] = np.frombuffer(b"".join(contexts), np.uint8)
    group = np.zeros(n, np.int64)
    group[_heads(key)[1:]] = 1
    group = np.cumsum(group)
    cover = [c for c in range(width - RANKED + 1) if c % PERIOD in COVER]

    ranks = {}
    for c in cover:
        words = [np.ascontiguousarray(laid[:, c + i:c + i + 8]).view(">u8").ravel() for i in range(0, RANKED, 8)]
        order = np.lexsort((*words[::-1], group))
        new = np.zeros(n, np.int64)
        new[_heads(group[order], *(w[order] for w in words))[1:]] = 1
        ranks[c] = np.empty(n, np.int64)
        ranks[c][order] = np.cumsum(new)

    def short(rows, start, end):
        value = np.zeros(len(rows), np.int64)
        for c in range(start, end):
            value = value << 8 | laid[rows, c]
        return value

    bits = np.zeros(n, np.int64)
    for place in range(WINDOWS):
        rows = np.flatnonzero((right <= place) & (place <= left))
        if len(rows) < 2:
            continue
        start = WINDOWS - 1 - place
        ahead = next(c for c in cover if c >= start)
        behind = next(c for c in reversed(cover) if c + RANKED <= start + SPAN)
        middle = [c for c in cover if c <= min(ahead + RANKED, behind)][-1]  # no rank looks beyond the window
        sort_keys = [short(rows, start, ahead), ranks[ahead][rows], ranks[middle][rows], ranks[behind][rows], short(rows, behind + RANKED, start + SPAN)]
        order = np.lexsort((*sort_keys[::-1], group[rows]))
        rows = rows[order]
        head = _heads(group[rows], *(k[order] for k in sort_keys))
        least = np.repeat(np.minimum.reduceat(ids[rows], head), np.diff(np.append(head, len(rows))))
        later = rows[ids[rows] > least]
        bits[later] |= np.int64(1) << place
    return bits


def resolved(contexts: DataFrame) -> DataFrame:
    """Covered windows of open contexts: id, mark, bits."""
    kind = schema_of("id bigint, mark bigint, bits bigint")
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        held, size = [], 0

        def sort(rows: pa.Table):
            key, ids, mark, left, right = (rows.column(c).to_numpy() for c in range(5))
            head = _heads(key)
            sizes = np.diff(np.append(head, len(key)))
            shared = np.repeat(np.minimum.reduceat(ids, head) < np.maximum.reduceat(ids, head), sizes)
            if shared.any():
                texts = rows.column(5).filter(pa.array(shared)).to_pylist()
                bits = covered_windows(key[shared], ids[shared], left[shared], right[shared], texts)
                hit = np.flatnonzero(bits)
                yield pa.RecordBatch.from_arrays([pa.array(ids[shared][hit]), pa.array(mark[shared][hit]), pa.array(bits[hit])], schema=arrow)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size >= BLOCK:
                rows = pa.Table.from_batches(held)
                key = rows.column(0).to_numpy()
                end = int(_heads(key)[-1])  # the last group may go on
                if end:
                    yield from sort(rows.slice(0, end))
                    held = rows.slice(end).to_batches()
                    size = len(key) - end
        if held:
            yield from sort(pa.Table.from_batches(held))

    rows = contexts.repartition("key").sortWithinPartitions("key")
    return small_batches(rows).mapInArrow(run, kind)


def removed(docs: DataFrame) -> DataFrame:
    """For each id with repeated strings its contexts that are covered, whole (marks) or in part (mark, bits)."""
    numbered = _numbered(docs)
    marks = settled(marked(numbered))
    parts = resolved(open_contexts(numbered, marks))
    whole = marks.where(F.col("kind") == COVERED).select("id", "marks", F.lit(None).cast("struct<mark: bigint, bits: bigint>").alias("part"))
    both = whole.unionAll(parts.select("id", F.lit(None).cast("array<bigint>"), F.struct("mark", "bits")))
    return settled(both.groupBy("id").agg(F.flatten(F.collect_list("marks")).alias("whole"), F.collect_list("part").alias("parts")))


def masks(texts: list[bytes], whole: list[list[int] | None], parts: list[list[dict] | None]) -> list[np.ndarray | None]:
    """For each text which bytes go; None if none."""
    busy = [i for i in range(len(texts)) if whole[i] or parts[i]]
    out: list[np.ndarray | None] = [None] * len(texts)
    if not busy:
        return out
    own = [texts[i] for i in busy]
    found = anchors(own)
    keys = _of_texts(found.text, found.mark)
    base = np.cumsum([0, *(len(t) + 1 for t in own)])
    change = np.zeros(int(base[-1]) + 1, np.int16)  # a byte is in 2 * SPAN covered strings at most

    def cover(rows, first, last):
        np.add.at(change, base[found.text[rows]] + first, 1)
        np.add.at(change, base[found.text[rows]] + last + SPAN, -1)

    rows = np.flatnonzero(_in(keys, _wanted([whole[i] for i in busy])))
    cover(rows, found.first[rows], found.last[rows])
    pairs: dict[int, int] = {}
    for k, i in enumerate(busy):
        for part in parts[i] or ():
            key = k << 48 | part["mark"]
            pairs[key] = pairs.get(key, 0) | part["bits"]
    if pairs:
        known = np.array(sorted(pairs), np.uint64)
        bits = np.array([pairs[int(x)] for x in known], np.int64)
        rows = np.flatnonzero(_in(keys, known))
        bits = bits[np.searchsorted(known, keys[rows])]
        for place in range(WINDOWS):
            some = rows[(bits >> place) & 1 == 1]
            cover(some, found.at[some] - place, found.at[some] - place)
    gone = np.cumsum(change, dtype=np.int16) > 0
    for k, i in enumerate(busy):
        out[i] = gone[base[k]:base[k] + len(own[k])]
    return out


def _meet(docs: DataFrame, columns: list[str], function, kind: str) -> DataFrame:
    """Rows of ``docs`` with a struct ``_made`` of ``function(texts, masks)``."""
    key, made = free_name(docs, "_key"), "_made"
    found = removed(docs).withColumnRenamed("id", key).withColumnRenamed("whole", "_whole").withColumnRenamed("parts", "_parts")
    rows = docs.select(*columns, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias(key), F.col("text").alias("_text")).join(found, key, "left")
    fields = schema_of(kind)
    schema = T.StructType([*docs.select(*columns).schema.fields, T.StructField(made, fields)])
    struct = to_arrow_schema(T.StructType([T.StructField(made, fields)])).field(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_PER_BATCH):
                part = batch.slice(start, ROWS_PER_BATCH)
                texts, whole, parts = (part.column(len(columns) + i).to_pylist() for i in range(3))
                texts = _bytes(texts)
                rows = pa.array(function(texts, masks(texts, whole, parts)), struct.type)
                kept = pa.schema([part.schema.field(i) for i in range(len(columns))])
                yield pa.RecordBatch.from_arrays([*part.columns[:len(columns)], rows], schema=kept.append(struct))

    return small_batches(rows.select(*columns, "_text", "_whole", "_parts")).mapInArrow(run, schema)


def report(docs: DataFrame) -> DataFrame:
    """A row for each document: bytes, bytes and runs that go, digest of the rest."""
    def digest(texts, gone):
        rows = []
        for text, mask in zip(texts, gone, strict=True):
            spans, kept = 0, text
            if mask is not None and mask.any():
                spans = int(np.count_nonzero(np.diff(mask.astype(np.int8), prepend=0) == 1))
                kept = np.frombuffer(text, np.uint8)[~mask].tobytes()
            rows.append({"n_bytes": len(text), "n_removed": len(text) - len(kept), "n_spans": spans, "kept_sha256": hashlib.sha256(kept).hexdigest()})
        return rows

    out = _meet(docs.select("doc_id", "text"), ["doc_id"], digest, "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    return out.select("doc_id", "_made.*")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated strings cut out of the text, and without documents of which only blanks are left.

    A character goes only if all its bytes do. Documents without repeats stay as they are; ``n_chars`` follows.
    """
    def cut(texts, gone):
        rows = []
        for text, mask in zip(texts, gone, strict=True):
            if mask is None or not mask.any():
                rows.append({"text": None, "stays": True})
                continue
            raw = np.frombuffer(text, np.uint8)
            begins = np.flatnonzero(raw & 0xC0 != 0x80)
            whole = np.logical_and.reduceat(mask, begins)
            left = raw[~np.repeat(whole, np.diff(np.append(begins, len(raw))))].tobytes().decode()
            rows.append({"text": left, "stays": bool(left.strip())})
        return rows

    out = _meet(docs, docs.columns, cut, "text string, stays boolean").where("_made.stays")
    text = F.coalesce("_made.text", "text")
    made = {"text": text} | ({"n_chars": F.when(F.col("_made.text").isNull(), F.col("n_chars")).otherwise(F.length(text).cast("long"))} if "n_chars" in docs.columns else {})
    return out.select(*[made.get(c, F.col(c)).alias(c) for c in docs.columns])
