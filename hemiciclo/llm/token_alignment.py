"""Alignment of two tokenizers' tokens, with corpus-wide counts of linked ids by external spill counting.

Tokens of a document are linked where their byte ranges overlap: each distinct end of a token, of either side, ends
the overlap of one pair. Corpus-wide a pair of ids counts the documents that hold it linked.

- Runs: a task encodes documents of some RUN_BYTES at once and sorts the records (pair of ids, document) of each of
  BUCKETS radix buckets of first ids. A bucket's records are one zstd run: distinct pairs with their number of
  documents (its keys), and the documents with their numbers of links (its posts). Runs lie in a written table.
- Counting reads the keys alone. Each task merges up to FAN_IN runs of a bucket block by block with a heap of their
  smallest unread pairs, and writes blocks of BLOCK_KEYS pairs; further rounds merge those until one is left. Pairs
  come out ordered by the first id, so the last round knows each first id's highest count before it goes on.
- Contributions: beside the counts of a bucket pass its runs one after the other. What their pairs add to each
  document is summed up in a run, and over the buckets of a run in another task.

A task holds one run and one bucket's counts, whose number the vocabularies bound (at most
|A| * |B| / BUCKETS, in fact a small part). A bucket with more than GROUP_BYTES of posts, such as that of a first id
that most links have, is spread over groups of runs; each gets a copy of the counts.

Side A is a byte-level BPE file of the `tokenizers` library. `tiktoken` encodes with its vocabulary, which gives the
same ids faster (tests compare them); texts with over LONG_BLANKS blanks in a row, which overflow its pattern
matcher, are encoded by `tokenizers` itself. Side B is a sentencepiece model.

Edge cases: null and empty texts, and those that a side doesn't give back byte for byte, have no tokens: zeros and
an empty digest. Rows are told apart by their place, so null and repeated ids keep a row each and count as documents.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import tokenizers
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from hemiciclo.llm.common import ROWS_PER_BATCH, schema_of, small_batches
from hemiciclo.sources.shared import settled, shared_folder

FILE_A, FILE_B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
RUN_BYTES, BUCKETS = 2_000_000, 64
FAN_IN, BLOCK_KEYS, GROUP_BYTES = 512, 16_384, 32_000_000
LONG_BLANKS = 1000
#: Fixed value: how byte-level BPE cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NEVER = b"\xff"  # no text in UTF-8 has this byte
_ALIGNED = (
    "run bigint, bucket int, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    "place int, keys binary, posts binary, size bigint"
)


def byte_letters() -> dict[str, int]:
    """The letters that byte-level BPE writes for bytes: printable ones stand for themselves, others count on from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class SideA:
    """A byte-level BPE file."""

    def __init__(self, file: str = FILE_A):
        with open(file, encoding="utf-8") as f:
            made = json.load(f)
        cut = made["pre_tokenizer"]
        if made["normalizer"] is not None or made["model"]["type"] != "BPE" or cut["type"] != "ByteLevel" or cut["add_prefix_space"]:
            raise ValueError(f"{file} isn't a plain byte-level BPE")
        special = {t["id"] for t in made["added_tokens"]}
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in made["model"]["vocab"].items() if i not in special}
        self.raw = [_NEVER] * (max([*ranks.values(), *special]) + 1)
        for token, i in ranks.items():
            self.raw[i] = token
        self.fast = tiktoken.Encoding(file, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.file, self.slow = file, None
        self.blanks = re.compile(rf"\s{{{LONG_BLANKS}}}")

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self._safely(t) if self.blanks.search(t) else self.fast.encode_ordinary(t) for t in texts]

    def _safely(self, text: str) -> list[int]:
        if self.slow is None:
            self.slow = tokenizers.Tokenizer.from_file(self.file)
            self.slow.encode_special_tokens = True
        return self.slow.encode(text, add_special_tokens=False).ids


class SideB:
    """A sentencepiece model; it puts a space before a text by itself."""

    def __init__(self, file: str = FILE_B):
        self.model = sentencepiece.SentencePieceProcessor(model_file=file)
        self.raw = [self._bytes(i) for i in range(self.model.get_piece_size())]

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        if self.model.is_byte(i):
            return bytes([int(piece[1:-1], 16)])
        if self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i):
            return _NEVER
        return piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers from 0 as a zstd run, each in as few bytes a number as its largest one needs."""
    parts = []
    for x in arrays:
        kind = np.min_scalar_type(int(x.max()) if len(x) else 0)
        parts += [struct.pack("<BQ", kind.itemsize, len(x)), x.astype(kind).tobytes()]
    return zstandard.compress(b"".join(parts), 1)


def unpack(run: bytes) -> list[np.ndarray]:
    flat, at, out = zstandard.decompress(run), 0, []
    while at < len(flat):
        width, n = struct.unpack_from("<BQ", flat, at)
        out.append(np.frombuffer(flat, f"<u{width}", n, at + 9).astype(np.int64))
        at += 9 + width * n
    return out


def pack_sorted(keys: np.ndarray, *arrays: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=0), *arrays)


def unpack_sorted(run: bytes) -> list[np.ndarray]:
    steps, *arrays = unpack(run)
    return [np.cumsum(steps), *arrays]


class Aligner:
    """Both sides, and what their tokens are written as in a digest of groups."""

    def __init__(self, file_a: str, file_b: str):
        self.a, self.b = SideA(file_a), SideB(file_b)
        self.sizes = [np.array([len(t) for t in side.raw]) for side in (self.a, self.b)]
        if any(not size.all() for size in self.sizes):
            raise ValueError("a token without bytes")
        self.n_b = len(self.b.raw)
        numbers = np.array([b"%d" % i for i in range(max(len(self.a.raw), self.n_b))], object)
        self.inner, self.side, self.group = (np.array([x + end for x in numbers], "S") for end in (b",", b"|", b";"))

    def run(self, ids: list, texts: list[str | None], number: int) -> list[dict]:
        """Rows of a run's documents and of its buckets."""
        wholes = [(" " + t).encode() if t else b"" for t in texts]
        some = [i for i, t in enumerate(texts) if t]
        found: list[list[list[int]]] = [[[]] * len(texts) for _ in range(2)]
        encoded = zip(some, self.a.encode([" " + texts[i] for i in some]), self.b.encode([texts[i] for i in some]), strict=True) if some else ()
        for i, a, b in encoded:
            if b"".join(map(self.a.raw.__getitem__, a)) == wholes[i] == b"".join(map(self.b.raw.__getitem__, b)):
                found[0][i], found[1][i] = a, b
        counts = [np.array([len(x) for x in side]) for side in found]
        tokens = [np.fromiter(chain.from_iterable(side), np.int64, n.sum()) for side, n in zip(found, counts, strict=True)]
        del found, encoded
        # The texts one after the other: both sides fill the same bytes.
        ends = [np.cumsum(size[t]) for size, t in zip(self.sizes, tokens, strict=True)]
        last = [np.cumsum(n) for n in counts]
        doc_ends = np.array([e[k - 1] if k else 0 for e, k in [(ends[0], k) for k in last[0].tolist()]], np.int64)
        # Which sides (1, 2 or both, 3) have a token's end at each byte.
        marks = np.zeros(int(doc_ends[-1]) + 1 if len(doc_ends) else 1, np.uint8)
        for side, e in enumerate(ends, 1):
            marks[e] |= side
        cuts = np.flatnonzero(marks)
        here = [(marks[cuts] & side) // side for side in (1, 2)]
        at = [np.cumsum(x, dtype=np.int64) - x for x in here]
        a, b = tokens[0][at[0]] if len(cuts) else cuts, tokens[1][at[1]] if len(cuts) else cuts
        links = np.searchsorted(cuts, doc_ends, "right")
        common = marks[cuts] == 3
        both = cuts[common]
        groups = np.searchsorted(both, doc_ends, "right")
        before = np.cumsum(common) - common
        of_group = [before[x > 0] for x in here]
        until = [x[common] + 1 for x in at]
        digests = self.digests(tokens, ends, last, both, of_group, until)
        rows = [
            {"run": number, "bucket": None, "doc_id": d, "n_a": x, "n_b": y, "n_groups": g, "n_links": n, "groups_sha256": s, "place": i}
            for i, (d, x, y, g, n, s) in enumerate(zip(
                ids, counts[0].tolist(), counts[1].tolist(), np.diff(groups, prepend=0).tolist(), np.diff(links, prepend=0).tolist(), digests, strict=True
            ))
        ]
        doc = np.repeat(np.arange(len(ids)), np.diff(links, prepend=0))
        return rows + self.buckets(a, b, doc, max(len(ids), 1), number)

    def digests(self, tokens, ends, last, both, group, until) -> list[str]:
        """Digests of each document's groups: first ids, second ids, in the order of the groups."""
        a_until, b_until = until[0], np.concatenate([[0], until[1]])
        n = len(tokens[0]) + len(tokens[1])
        written = np.empty(n, self.group.dtype)
        if n:
            for side, (t, e, g, end) in enumerate(zip(tokens, ends, group, (self.side, self.group), strict=True)):
                place = np.arange(len(t)) + (a_until[g] if side else b_until[g])
                written[place] = np.where(both[g] == e, end[t], self.inner[t])
        out, low = [], 0
        for high in (last[0] + last[1]).tolist():
            out.append(hashlib.sha256(b"".join(written[low:high].tolist())[:-1]).hexdigest() if high > low else "")
            low = high
        return out

    def buckets(self, a, b, doc, n_docs: int, number: int) -> list[dict]:
        """A row for each bucket: pairs as a * |B| + b, ascending, with their documents, and the links in each."""
        widest = len(self.a.raw) * self.n_b
        if BUCKETS * widest * n_docs >= 2**63:
            raise ValueError("vocabularies or a run's documents are too many for a record of 63 bits")
        record = ((a % BUCKETS * widest) + a * self.n_b + b) * n_docs + doc
        record.sort()
        first = np.flatnonzero(np.diff(record, prepend=-1))
        times = np.diff(first, append=len(record))
        pair, doc = np.divmod(record[first], n_docs)
        starts = np.flatnonzero(np.diff(pair, prepend=-1))
        n = np.diff(starts, append=len(pair))
        keys = pair[starts]
        edges = np.searchsorted(keys, np.arange(BUCKETS + 1) * widest)
        rows, bounds = [], np.append(starts, len(pair))
        for k in range(BUCKETS):
            low, high = edges[k], edges[k + 1]
            if low < high:
                posts = pack(doc[bounds[low]:bounds[high]], times[bounds[low]:bounds[high]])
                rows.append({
                    "run": number, "bucket": k, "place": n_docs, "keys": pack_sorted(keys[low:high] - k * widest, n[low:high]),
                    "posts": posts, "size": len(posts),
                })
        return rows


def aligned(docs: DataFrame, file_a: str, file_b: str) -> DataFrame:
    """Rows of documents (without a bucket) and of the buckets of their runs."""
    kind = schema_of(_ALIGNED)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(file_a, file_b)
        number = TaskContext.get().partitionId() << 32
        ids: list = []
        texts: list = []
        size = 0
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_PER_BATCH):
                part = batch.slice(start, ROWS_PER_BATCH).to_pydict()
                for doc_id, text in zip(part["doc_id"], part["text"], strict=True):
                    ids.append(doc_id)
                    texts.append(text)
                    size += len(text or "") + 100
                    if size >= RUN_BYTES:
                        yield pa.RecordBatch.from_pylist(aligner.run(ids, texts, number), schema=arrow)
                        ids, texts, size, number = [], [], 0, number + 1
        if ids:
            yield pa.RecordBatch.from_pylist(aligner.run(ids, texts, number), schema=arrow)
        pa.default_memory_pool().release_unused()

    return small_batches(docs.select(F.col("doc_id").cast("bigint"), "text")).mapInArrow(run, kind)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows that hold runs, a few at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, 16):
            yield from batch.slice(start, 16).to_pylist()


class Merge:
    """k-way merge of sorted blocks (keys, counts) that arrive in the order of their first keys."""

    def __init__(self):
        self.heap: list[tuple[int, int]] = []
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.next = 0

    def push(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.open[self.next] = keys, counts
        heapq.heappush(self.heap, (int(keys[0]), self.next))
        self.next += 1

    def below(self, bound: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Takes all pairs less than ``bound`` (None: all) out, each once with its sum."""
        taken = []
        while self.heap and (bound is None or self.heap[0][0] < bound):
            _, i = heapq.heappop(self.heap)
            keys, counts = self.open.pop(i)
            cut = len(keys) if bound is None else int(np.searchsorted(keys, bound))
            taken.append((keys[:cut], counts[:cut]))
            if cut < len(keys):
                self.open[i] = keys[cut:], counts[cut:]
                heapq.heappush(self.heap, (int(keys[cut]), i))
        if not taken:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        keys, counts = (np.concatenate(x) for x in zip(*taken, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        return keys[first], np.add.reduceat(counts, first)


def merged(runs: DataFrame, n_b: int, last: bool) -> DataFrame:
    """Rows (bucket, part, first, keys) with the runs of each bucket and part merged into blocks.

    In the last round ``keys`` also says which pairs have their first id's highest count.
    """
    kind = schema_of("bucket int, part bigint, first bigint, keys binary")
    arrow = to_arrow_schema(kind)

    def blocks(bucket, part, keys, counts) -> Iterator[pa.RecordBatch]:
        best = ()
        if last and len(keys):
            starts = np.flatnonzero(np.diff(keys // n_b, prepend=-1))
            highest = np.maximum.reduceat(counts, starts)
            best = ((counts == np.repeat(highest, np.diff(starts, append=len(keys)))).astype(np.int64),)
        for k in range(0, len(keys), BLOCK_KEYS):
            cut = slice(k, k + BLOCK_KEYS)
            packed = pack_sorted(keys[cut], counts[cut], *(x[cut] for x in best))
            yield pa.RecordBatch.from_pydict({"bucket": [bucket], "part": [part], "first": [int(keys[k])], "keys": [packed]}, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, merge = None, Merge()
        held = (np.empty(0, np.int64), np.empty(0, np.int64))

        def flush(bound: int | None) -> Iterator[pa.RecordBatch]:
            """Write what is complete: whole first ids in the last round, whole blocks until the group's end."""
            nonlocal held
            done = merge.below(bound)
            held = tuple(np.concatenate(x) for x in zip(held, done, strict=True))
            if bound is None:
                n = len(held[0])
            elif len(held[0]) < 2 * BLOCK_KEYS:
                return
            else:
                n = int(np.searchsorted(held[0], held[0][-1] // n_b * n_b))
            yield from blocks(*group, held[0][:n], held[1][:n])
            held = held[0][n:], held[1][n:]

        for row in rows_of(batches):
            if group is not None and group != (row["bucket"], row["part"]):
                yield from flush(None)
            group = row["bucket"], row["part"]
            yield from flush(row["first"])
            merge.push(*unpack_sorted(row["keys"])[:2])
        if group is not None:
            yield from flush(None)

    return small_batches(runs.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "first")).mapInArrow(run, kind)


def first_key(runs: DataFrame) -> DataFrame:
    """``first``, the smallest pair of each run's keys."""
    kind = schema_of("run bigint, bucket int, first bigint, keys binary")
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = pa.array([int(unpack(k)[0][0]) for k in batch.column("keys").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("run"), batch.column("bucket"), first, batch.column("keys")], schema=arrow)

    return small_batches(runs.select("run", "bucket", "keys")).mapInArrow(run, kind)


def counted(runs: DataFrame, n_runs: int, n_b: int) -> DataFrame:
    """Blocks (bucket, first, keys) of all pairs with their counts."""
    level = first_key(runs).withColumnRenamed("run", "part")
    parts = n_runs
    while True:
        parts = -(-parts // FAN_IN)
        level = merged(level.withColumn("part", F.pmod(F.xxhash64("part"), F.lit(max(parts, 1)))), n_b, parts <= 1)
        if parts <= 1:
            return settled(level.select("bucket", "first", "keys"))
        level = settled(level)


def spread(runs: DataFrame) -> Column:
    """Number of groups of each bucket's runs, from the bytes of their posts; at most BUCKETS rows are collected."""
    sizes = {r.bucket: r.size for r in runs.groupBy("bucket").agg(F.sum("size").alias("size")).collect()}
    made = [-(-sizes.get(k, 0) // GROUP_BYTES) or 1 for k in range(BUCKETS)]
    return F.element_at(F.array(*map(F.lit, made)), F.col("bucket") + 1)


def contributions(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """(run, sums): what a bucket adds to the run's documents, as two sums each: links with the highest count, counts."""
    kind = schema_of("run bigint, sums binary")
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, blocks, table = None, [], None
        for row in rows_of(batches):
            if group != (row["bucket"], row["part"]):
                group, blocks, table = (row["bucket"], row["part"]), [], None
            if row["run"] is None:
                blocks.append(unpack_sorted(row["keys"]))
                continue
            if table is None:
                table, blocks = [np.concatenate(x) for x in zip(*blocks, strict=True)], []
            keys, n = unpack_sorted(row["keys"])
            doc, times = unpack(row["posts"])
            at = np.repeat(np.searchsorted(table[0], keys), n)
            sums = np.zeros((2, row["place"]), np.int64)
            np.add.at(sums[0], doc, table[2][at] * times)
            np.add.at(sums[1], doc, table[1][at] * times)
            yield pa.RecordBatch.from_pydict({"run": [row["run"]], "sums": [pack(*sums)]}, schema=arrow)

    groups = spread(runs)
    own = runs.select("bucket", F.pmod(F.xxhash64("run"), groups).alias("part"), "run", F.lit(None).cast("bigint").alias("first"), "place", "keys", "posts")
    beside = counts.select(
        "bucket", F.explode(F.sequence(F.lit(0).cast("bigint"), groups.cast("bigint") - 1)).alias("part"), F.lit(None).cast("bigint").alias("run"),
        "first", F.lit(None).cast("int").alias("place"), "keys", F.lit(None).cast("binary").alias("posts"),
    )
    # Nulls come first, so a group begins with the counts.
    order = ["bucket", "part", "run", "first"]
    return small_batches(own.unionByName(beside).repartition("bucket", "part").sortWithinPartitions(*order)).mapInArrow(run, kind)


def summed(docs: DataFrame, sums: DataFrame) -> DataFrame:
    """The rows of ``docs`` with both sums over all buckets of their run."""
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    kind = schema_of("".join(f"{c} bigint, " for c in kept) + "n_best bigint, count_sum bigint, groups_sha256 string")
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["run"] != now:
                    now, total = row["run"], None
                if row["sums"] is not None:
                    added = np.array(unpack(row["sums"]))
                    total = added if total is None else total + added
                    continue
                best, count = (0, 0) if total is None else total[:, row["place"]].tolist()
                out.append({c: row[c] for c in kept} | {"n_best": best, "count_sum": count, "groups_sha256": row["groups_sha256"]})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    rows = docs.select("run", "place", *kept, "groups_sha256", F.lit(None).cast("binary").alias("sums")).unionByName(sums, allowMissingColumns=True)
    return small_batches(rows.repartition("run").sortWithinPartitions("run", "place")).mapInArrow(run, kind)


def align(docs: DataFrame, file_a: str = FILE_A, file_b: str = FILE_B) -> DataFrame:
    """A row for each document: tokens of both sides, groups between common ends, links, and what their counts come to."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/alignment-{uuid.uuid4().hex}"
    aligned(docs, file_a, file_b).write.parquet(folder)
    made = spark.read.schema(schema_of(_ALIGNED)).parquet(folder)
    runs, of_docs = made.where("bucket is not null"), made.where("bucket is null")
    n_b = sentencepiece.SentencePieceProcessor(model_file=file_b).get_piece_size()
    counts = counted(runs, of_docs.where("place = 0").count(), n_b)
    out = settled(summed(of_docs, contributions(runs, counts)))
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return out
