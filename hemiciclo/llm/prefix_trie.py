"""The prefix trie of conversations by fixed-length block hashing.

A node stands for a distinct sequence of first turns (role and text). Texts are read once, for a 128-bit digest and
a word count of each turn; everything later works on those.

- Digests of prefixes: a prefix's digest is the value modulo a prime of 127 bits of the polynomial whose coefficients
  are its turns' digests. Such values can be added up piece by piece, so turns are range-partitioned and sorted by
  conversation and place, each task sums up its own, and what conversations that span tasks bring along is worked
  out from two rows a task. No conversation is held by one task or in one row. Different prefixes get the same
  digest with a chance of some n * n / 2 ** 127 for n of them.
- Blocks: conversations are first grouped by the digests of their successive blocks of BLOCK_TURNS turns, a row a
  block, combined before the shuffle. Where a prefix has one following block, the nodes inside it have the block's
  conversations. Only where sibling blocks diverge are the distinct blocks (not the conversations) cut at turns and
  grouped anew.
- Sums over subtrees are sums over the conversations of a node. Each node belongs to its smallest conversation, and
  a conversation owns its nodes from some depth on. So a node's subtree has as many leaves as conversations that
  own one, and as many words as its conversations own beyond it; no walk over the levels is needed. The sums go the
  way of the blocks a second time, with one conversation for each distinct sequence.
- The digest of the ids that end at a node is taken over sorted chunks of CHUNK ids, which are what a task streams.

Edge cases: rows without a conversation id belong to none. Null roles and texts are empty. Turns sort with nulls
first and ties by the digests of role and text, so equal rows may repeat. An empty table gives no rows, not even
the root. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from hemiciclo.llm.common import map_batches, schema_of, small_batches, spaced_words
from hemiciclo.sources.shared import settled

BLOCK_TURNS = 4
CHUNK = 20_000
_MODULUS, _SIZE = 2**127 - 1, 16
_BASE = int.from_bytes(hashlib.blake2b(b"prefix", digest_size=15).digest(), "big")
_ROOT = bytes(_SIZE)
_ORDER = ["conv_id", "place", "turn", "digest"]
_TURN = "conv_id bigint, place int, turn bigint, digest binary, words bigint"
_BLOCK = "conv_id bigint, start bigint, parent binary, ends binary, words array<bigint>, before bigint, last boolean"


def turn_digest(role: str | None, text: str | None) -> int:
    head = (role or "").encode()
    whole = b"%d:" % len(head) + head + (text or "").encode()
    return int.from_bytes(hashlib.blake2b(whole, digest_size=_SIZE).digest(), "big") % _MODULUS


def digested(conversations: DataFrame) -> DataFrame:
    """Turns without their texts. ``place`` sorts before ``turn``; it is 0 here."""
    def run(batch):
        pairs = list(zip(batch["role"], batch["text"], strict=True))
        return {
            "conv_id": batch["conv_id"], "place": [0] * len(pairs), "turn": batch["turn"],
            "digest": [turn_digest(*p).to_bytes(_SIZE, "big") for p in pairs], "words": [len(spaced_words(t)) for _, t in pairs],
        }

    return map_batches(conversations.where("conv_id is not null").select("conv_id", "turn", "role", "text"), run, _TURN)


@dataclass
class State:
    """What the turns of a conversation so far amount to: their number, digest and words, and the last ``keep``."""

    keep: int
    n: int = 0
    digest: int = 0
    words: int = 0
    tail: list[tuple[int, int]] = field(default_factory=list)

    def add(self, digest: int, words: int) -> None:
        self.digest = (self.digest + digest * pow(_BASE, self.n, _MODULUS)) % _MODULUS
        self.n, self.words = self.n + 1, self.words + words
        self.tail = [*self.tail, (digest, words)][-self.keep:]

    def then(self, other: State) -> State:
        digest = (self.digest + other.digest * pow(_BASE, self.n, _MODULUS)) % _MODULUS
        return State(self.keep, self.n + other.n, digest, self.words + other.words, [*self.tail, *other.tail][-self.keep:])


def turns_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int | None, int, int]]:
    """conv_id, turn, digest and words of each row."""
    for batch in batches:
        columns = batch.to_pydict()
        digests = (int.from_bytes(d, "big") for d in columns["digest"])
        yield from zip(columns["conv_id"], columns["turn"], digests, columns["words"], strict=True)


@dataclass
class Ordered:
    """Sorted turns in a written table, with what each partition's first conversation brings along.

    ``carried`` holds partitions that continue a conversation, ``cut`` those whose last one goes on. Both are made
    on the driver from two rows a partition at most.
    """

    rows: DataFrame
    carried: dict[int, State]
    cut: frozenset[int]


def ordered(turns: DataFrame) -> Ordered:
    rows = settled(turns.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER))
    kind = schema_of("part int, conv_id bigint, n bigint, digest binary, words bigint, tail array<struct<d: binary, w: bigint>>")
    arrow, keep = to_arrow_schema(kind), BLOCK_TURNS - 1

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, now, state = None, None, State(keep)
        for conv, _, digest, words in turns_of(batches):
            if conv != now:
                if first is None and now is not None:
                    first = (now, state)
                now, state = conv, State(keep)
            state.add(digest, words)
        found = [x for x in (first, (now, state)) if x is not None and x[0] is not None]
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pylist([
            {"part": part, "conv_id": c, "n": s.n, "digest": s.digest.to_bytes(_SIZE, "big"), "words": s.words,
             "tail": [{"d": d.to_bytes(_SIZE, "big"), "w": w} for d, w in s.tail]}
            for c, s in found
        ], schema=arrow)

    by_part: dict[int, list[tuple[int, State]]] = {}
    for r in small_batches(rows).mapInArrow(edges, kind).collect():
        tail = [(int.from_bytes(t.d, "big"), t.w) for t in r.tail]
        by_part.setdefault(r.part, []).append((r.conv_id, State(keep, r.n, int.from_bytes(r.digest, "big"), r.words, tail)))
    carried, cut, conv, state, before = {}, set(), None, State(keep), None
    for part in sorted(by_part):
        first, last = min(by_part[part], key=lambda x: x[0]), max(by_part[part], key=lambda x: x[0])
        if first[0] == conv:
            carried[part] = state
            cut.add(before)
        state = state.then(last[1]) if last[0] == conv else last[1]
        conv, before = last[0], part
    return Ordered(rows, carried, frozenset(cut))


def numbered(turns: Ordered) -> DataFrame:
    """The turns with their number in the conversation, from 0, as ``turn``."""
    kind = schema_of(_TURN)
    arrow = to_arrow_schema(kind)
    carried = {part: s.n for part, s in turns.carried.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n = None, carried.get(TaskContext.get().partitionId(), 0)
        for batch in batches:
            places = []
            for conv in batch.column("conv_id").to_pylist():
                if conv != now:
                    now, n = conv, n if now is None else 0
                places.append(n)
                n += 1
            at = batch.schema.get_field_index("turn")
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()) if i == at else c for i, c in enumerate(batch.columns)], schema=arrow)

    return small_batches(turns.rows).mapInArrow(run, kind)


def blocks(turns: Ordered) -> DataFrame:
    """A row for each block of each conversation: digests of the prefixes that end in it, and the one before it."""
    kind = schema_of(_BLOCK)
    arrow = to_arrow_schema(kind)
    carried, cut, size = turns.carried, turns.cut, BLOCK_TURNS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out: list[dict] = []
        now, state, start, ends, words = None, State(size - 1), State(size - 1), [], []

        def opened(at: State) -> None:
            """Begin with the turns of an open block that earlier partitions hold."""
            nonlocal state, start, ends, words
            inside = at.tail[len(at.tail) - at.n % size:] if at.n % size else []
            digest = at.digest
            for i, (d, _) in enumerate(inside):
                digest = (digest - d * pow(_BASE, at.n - len(inside) + i, _MODULUS)) % _MODULUS
            start = State(size - 1, at.n - len(inside), digest, at.words - sum(w for _, w in inside))
            state, ends, words = State(size - 1, start.n, start.digest, start.words), [], []
            for d, w in inside:
                state.add(d, w)
                ends.append(state.digest.to_bytes(_SIZE, "big"))
                words.append(w)

        def closed(last: bool) -> None:
            nonlocal start, ends, words
            if ends:
                out.append({
                    "conv_id": now, "start": start.n, "parent": start.digest.to_bytes(_SIZE, "big"), "ends": b"".join(ends),
                    "words": words, "before": start.words, "last": last,
                })
            start, ends, words = State(size - 1, state.n, state.digest, state.words), [], []

        for conv, _, digest, n_words in turns_of(batches):
            if conv != now:
                if now is None:
                    opened(carried.get(part, State(size - 1)))
                else:
                    closed(True)
                    opened(State(size - 1))
                now = conv
            if len(ends) == size:  # only now is it known that the conversation goes on
                closed(False)
            state.add(digest, n_words)
            ends.append(state.digest.to_bytes(_SIZE, "big"))
            words.append(n_words)
            if len(out) >= 2000:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        if now is not None:
            # An open block is written by the partition that has its last turn.
            if part not in cut:
                closed(True)
            elif len(ends) == size:
                closed(False)
        yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return small_batches(turns.rows).mapInArrow(run, kind)


def end_of(ends: Column, n: Column) -> Column:
    return F.substring(ends, (n - 1) * _SIZE + 1, F.lit(_SIZE))


def cut_at_turns(found: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Nodes of the distinct blocks ``found``, whose ``diverges`` tells which of them have siblings.

    ``values`` are aggregates over blocks; a block without siblings gives its own values to all its nodes.
    """
    rows = found.select("*", F.posexplode("words").alias("_at", "w"))
    at = F.col("_at")
    rows = rows.select(
        end_of(F.col("ends"), at + 1).alias("node"), F.when(at == 0, F.col("parent")).otherwise(end_of(F.col("ends"), at)).alias("parent"),
        (F.col("start") + at + 1).alias("depth"),
        (F.col("before") + F.aggregate(F.slice("words", F.lit(1), at), F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("before"),
        "diverges", *values,
    )
    keys = ["node", "parent", "depth", "before"]
    alone = rows.where("not diverges").select(*keys, *values)
    return alone.unionByName(rows.where("diverges").groupBy(*keys).agg(*(v.alias(k) for k, v in values.items())))


def hashed_ends(ends: DataFrame) -> DataFrame:
    """node, ends_sha256 from rows (node, conv_id): the ids of each node in order, in chunks."""
    kind, chunk = schema_of("node binary, first bigint, ids string"), CHUNK
    arrow = to_arrow_schema(kind)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []
        for batch in batches:
            for at, conv in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if ids and (at != node or len(ids) == chunk):
                    yield pa.RecordBatch.from_pylist([{"node": node, "first": ids[0], "ids": ",".join(map(str, ids))}], schema=arrow)
                    ids = []
                node = at
                ids.append(conv)
        if ids:
            yield pa.RecordBatch.from_pylist([{"node": node, "first": ids[0], "ids": ",".join(map(str, ids))}], schema=arrow)

    out_kind = schema_of("node binary, ends_sha256 string")
    out_arrow = to_arrow_schema(out_kind)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            done = []
            for at, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if at != node:
                    if node is not None:
                        done.append({"node": node, "ends_sha256": digest.hexdigest()})
                    node, digest = at, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pylist(done, schema=out_arrow)
        if node is not None:
            yield pa.RecordBatch.from_pylist([{"node": node, "ends_sha256": digest.hexdigest()}], schema=out_arrow)

    in_order = small_batches(ends).repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    pieces = in_order.mapInArrow(chunks, kind)
    return pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(joined, out_kind)


def trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """A row for each node of the trie of ``turns`` (as `digested` gives them).

    ``conversations`` holds the distinct ids of all conversations, so that those without turns count at the root.
    """
    of_conversation = settled(blocks(ordered(turns)))
    conversations = settled(conversations.select("conv_id"))
    keys = ["start", "parent", "ends", "words", "before"]
    distinct = of_conversation.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"))
    siblings = distinct.groupBy("parent").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("parent", F.lit(True).alias("_many"))
    # All first blocks are siblings: the root isn't looked up.
    first = F.col("start") == 0
    distinct = settled(
        distinct.where(~first).join(siblings, "parent", "left").withColumn("diverges", F.coalesce("_many", F.lit(False))).drop("_many")
        .unionByName(distinct.where(first).withColumn("diverges", F.lit(True)))
    )
    root = conversations.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id")).where("n > 0").select(
        F.lit(_ROOT).alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("bigint").alias("depth"),
        F.lit(0).cast("bigint").alias("before"), "n", "conv_id",
    )
    root = settled(root)
    below = cut_at_turns(distinct, {"n": F.sum("n"), "conv_id": F.min("conv_id")})
    nodes = settled(below.unionByName(root))
    children = settled(nodes.where("depth > 0").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children")))
    owned = nodes.groupBy("conv_id").agg(F.min("before").alias("_own"))

    words = F.aggregate("words", F.col("before"), lambda a, x: a + x)
    with_turns = of_conversation.where("last").select("conv_id", end_of(F.col("ends"), F.size("words")).alias("node"), words.alias("_words"))
    without = conversations.join(with_turns, "conv_id", "left_anti").select("conv_id", F.lit(_ROOT).alias("node"), F.lit(0).cast("bigint").alias("_words"))
    ends = settled(with_turns.unionByName(without))
    sequences = ends.groupBy("node", "_words").agg(F.count(F.lit(1)).alias("_m"), F.min("conv_id").alias("conv_id"))
    values = sequences.join(owned, "conv_id", "left").join(children, "node", "left").select(
        "conv_id", (F.col("_m") * F.col("_words")).alias("all_words"),
        F.coalesce(F.col("_words") - F.col("_own"), F.lit(0)).alias("own_words"), F.col("n_children").isNull().cast("bigint").alias("leaves"),
    )
    values = settled(values)
    sums = {c: F.sum(c) for c in ("all_words", "own_words", "leaves")}
    named = [v.alias(c) for c, v in sums.items()]
    of_block = of_conversation.select("conv_id", "ends").join(values, "conv_id").groupBy("ends").agg(*named)
    of_node = cut_at_turns(distinct.drop("n", "conv_id").join(of_block, "ends"), sums).select("node", *sums)
    of_node = of_node.unionByName(values.agg(*named).where("leaves is not null").select(F.lit(_ROOT).alias("node"), *sums))

    up = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    deep = nodes.where("depth > 1").join(up, "parent").unionByName(
        nodes.where("depth = 1").join(F.broadcast(root.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))), "parent"),
    ).unionByName(nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("bigint")))
    whole = deep.join(children, "node", "left").join(of_node, "node").join(hashed_ends(ends.select("node", "conv_id")), "node", "left")
    whole = whole.join(owned, "conv_id")
    before = F.col("before")
    saved = F.col("all_words") - F.col("n") * before - F.col("own_words") + before - F.col("_own")
    return whole.select(
        "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"),
        F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def rebuilt(conversations: DataFrame, group: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns of conversations that begin like the first of their ``group``, and the ids of all of them.

    Conversation c takes the first crc32(c) % ``heads`` turns of conversation c - c % ``group``, then its own later ones.
    """
    turns = settled(numbered(ordered(digested(conversations))))
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    ids = turns.where("turn = 0").select("conv_id")
    own = turns.where(F.col("turn") >= taken).withColumn("place", F.lit(1))
    bases = turns.where((F.col("conv_id") % group == 0) & (F.col("turn") < heads - 1)).drop("place").withColumnRenamed("conv_id", "_base")
    wanted = ids.select("conv_id", taken.alias("_taken"), (F.col("conv_id") - F.col("conv_id") % group).alias("_base"))
    first = wanted.join(bases, "_base").where("turn < _taken").withColumn("place", F.lit(0))
    return first.select(own.columns).unionByName(own), ids


def report(conversations: DataFrame) -> DataFrame:
    return trie(*rebuilt(conversations))
