"""Near-duplicate vectors by Euclidean p-stable hashing with exact cosine checks.

Vectors are brought to length 1, where a cosine of COSINE is a distance of sqrt(2 - 2 COSINE). A hash value is
floor((a . x + b) / WIDTH) for a Gaussian vector a; a table's key holds several of them. `tables` takes their
number and that of the tables from the count of vectors: so that unlike vectors seldom meet in a bucket, and so
that a pair at exactly COSINE misses all buckets with a probability of at most MISSED (closer pairs: less).

- Exact copies are one node with a count.
- Every node of a bucket is compared with the bucket's smallest node, its head, which is linear in the bucket.
  A node joins the ball of the smallest head that is within half the angle of COSINE: any two members of a ball
  are linked then, by the triangle inequality of angles, so they are counted and never paired. Buckets that lie in
  one ball are done, and so a large group of near copies is too.
- In the other buckets nodes of different balls are compared by products of blocks of BLOCK nodes. A pair that
  shares several buckets counts in the first of them. Out come the links of each node in these blocks and a forest
  of them, so what leaves a task is linear in what it reads. A bucket of n nodes in many balls costs n / BLOCK
  copies of each node: its n * n cosines have to be checked.

Edge cases: null, empty and zero vectors and those with null, infinite or NaN components are linked with nothing;
vectors of different lengths neither. Rows repeated with one id count as vectors of their own. A null id stays
null and is never a component's id (its component is null, and kept, if all ids in it are null). An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from hemiciclo.llm.common import map_batches, schema_of, small_batches
from hemiciclo.llm.components import components
from hemiciclo.sources.shared import settled

COSINE, WIDTH, MISSED, SEED = 0.95, 2.0, 0.005, 11
#: Unlike vectors in a bucket, on average.
STRANGERS = 0.05
BLOCK = 1024
#: Cosine of half the angle of COSINE, with room for rounding.
BALL = math.sqrt((1 + COSINE) / 2) + 1e-9


def collision(distance: float) -> float:
    """Chance that a hash value is the same for two vectors at this distance."""
    r = WIDTH / distance
    return 1 - math.erfc(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))


def tables(n: int) -> tuple[int, int]:
    """Values in a key and number of tables for ``n`` vectors."""
    near, far = collision(math.sqrt(2 - 2 * COSINE)), collision(math.sqrt(2))
    values = max(8, math.ceil(math.log(max(n, 1) / STRANGERS) / -math.log(far)))
    return values, math.ceil(math.log(MISSED) / math.log(1 - near**values))


class Hashing:
    """Keys of unit vectors of one length in all tables."""

    def __init__(self, dimensions: int, values: int, n_tables: int):
        draw = np.random.default_rng([SEED, dimensions])
        self.values, self.n_tables = values, n_tables
        self.directions = draw.standard_normal((dimensions, n_tables * values))
        self.shifts = draw.random(n_tables * values) * WIDTH
        self.factors = draw.integers(0, 2**64, (n_tables, values), np.uint64) | np.uint64(1)
        self.seeds = draw.integers(0, 2**64, n_tables, np.uint64)

    def keys(self, units: np.ndarray) -> np.ndarray:
        bins = np.floor((units @ self.directions + self.shifts) / WIDTH).astype(np.int64).view(np.uint64)
        keys = (bins.reshape(len(units), self.n_tables, self.values) * self.factors).sum(2, dtype=np.uint64) + self.seeds
        keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return (keys ^ (keys >> np.uint64(29))).view(np.int64)


def unit(vector: list[float | None] | None) -> bytes | None:
    """The vector at length 1 as doubles; None if it has no direction."""
    if not vector or None in vector:
        return None
    x = np.array(vector, float)
    top = np.abs(x).max()
    if not 0 < top < math.inf:
        return None
    x = x / top  # squares neither overflow nor vanish
    return (x / math.sqrt(x @ x) + 0.0).tobytes()


def directed(vectors: DataFrame) -> DataFrame:
    """vec_id, a digest of the direction and the direction, both null where there is none."""
    def turn(batch):
        units = [unit(v) for v in batch["embedding"]]
        return {"vec_id": batch["vec_id"], "ident": [u and hashlib.blake2b(u, digest_size=16).digest() for u in units], "unit": units}

    return map_batches(vectors.select("vec_id", "embedding"), turn, "vec_id bigint, ident binary, unit binary")


def hashed(nodes: DataFrame, values: int, n_tables: int) -> DataFrame:
    """``nodes`` (node, copies, first_id, ident, unit) with their keys, one a table."""
    known: dict[int, Hashing] = {}

    def run(batch):
        keys: list = [None] * len(batch["unit"])
        by_size: dict[int, list[int]] = {}
        for i, u in enumerate(batch["unit"]):
            by_size.setdefault(len(u) // 8, []).append(i)
        for size, rows in by_size.items():
            if size not in known:
                known[size] = Hashing(size, values, n_tables)
            made = known[size].keys(np.frombuffer(b"".join(batch["unit"][i] for i in rows)).reshape(-1, size))
            for i, k in zip(rows, made, strict=True):
                keys[i] = k.tobytes()
        return batch | {"keys": keys}

    return map_batches(nodes, run, "node bigint, copies bigint, first_id bigint, ident binary, unit binary, keys binary")


def posted(nodes: DataFrame) -> DataFrame:
    """A row for each key of each node."""
    def run(batch):
        keys = [np.frombuffer(k, np.int64) for k in batch["keys"]]
        return {"key": np.concatenate(keys), "node": np.repeat(np.array(batch["node"]), [len(k) for k in keys])}

    return map_batches(nodes.select("node", "keys"), run, "key bigint, node bigint")


def with_cosine(pairs: DataFrame) -> DataFrame:
    """``cosine`` of the directions ``x`` and ``y`` of the pairs (node, head)."""
    def run(batch):
        cosines = [float(np.frombuffer(x) @ np.frombuffer(y)) if len(x) == len(y) else -1.0 for x, y in zip(batch["x"], batch["y"], strict=True)]
        return {"node": batch["node"], "head": batch["head"], "cosine": cosines}

    return map_batches(pairs, run, "node bigint, head bigint, cosine double")


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a graph given as a symmetric matrix."""
    unseen, edges = linked.any(1), []
    for root in np.flatnonzero(unseen):
        if not unseen[root]:
            continue
        unseen[root], open_ends = False, [root]
        while open_ends:
            at = open_ends.pop()
            new = np.flatnonzero(linked[at] & unseen)
            unseen[new] = False
            edges += [(at, x) for x in new.tolist()]
            open_ends += new.tolist()
    return edges


def links_between(key: int, part: np.ndarray, ball: np.ndarray, units: list[bytes], keys: list[bytes]) -> np.ndarray:
    """Which nodes of a bucket's two blocks are linked, if in other balls and blocks and in no earlier bucket together."""
    if len({len(u) for u in units}) > 1:  # equal keys of vectors of different lengths: a chance of 2 ** -64
        sizes = np.array([len(u) for u in units])
        out = np.zeros((len(units), len(units)), bool)
        for size in set(sizes.tolist()):
            rows = np.flatnonzero(sizes == size)
            out[np.ix_(rows, rows)] = links_between(key, part[rows], ball[rows], [units[i] for i in rows], [keys[i] for i in rows])
        return out
    x = np.frombuffer(b"".join(units)).reshape(len(units), -1)
    linked = (x @ x.T >= COSINE) & (ball[:, None] != ball[None])
    if part.min() != part.max():
        linked &= part[:, None] != part[None]
    if linked.any():
        rows = np.flatnonzero(linked.any(1))
        table_keys = np.frombuffer(b"".join(keys[i] for i in rows), np.int64).reshape(len(rows), -1)
        first = int(np.flatnonzero((table_keys == key).all(0))[0])
        some = linked[np.ix_(rows, rows)]
        for t in range(first):
            some &= table_keys[:, t][:, None] != table_keys[:, t][None]
        linked[np.ix_(rows, rows)] = some
    return linked | linked.T


def compared(rows: DataFrame) -> DataFrame:
    """Links of ``rows`` (key, low, high, part, node, ball, copies, unit, keys), sorted by the first three.

    Gives (a, null, links): copies of other nodes that a node is linked with here; and (a, b, 0): a forest.
    """
    kind = schema_of("a bigint, b bigint, links bigint")
    arrow = to_arrow_schema(kind)

    def settle(group: list[tuple]) -> Iterator[pa.RecordBatch]:
        key, _, _, part, node, ball, copies, units, keys = zip(*group, strict=True)
        linked = links_between(key[0], np.array(part), np.array(ball), units, keys)
        if linked.any():
            node, n = np.array(node), linked @ np.array(copies, np.int64)
            some = np.flatnonzero(n)
            edges = forest(linked)
            a = [*node[some].tolist(), *(int(node[i]) for i, _ in edges)]
            b = [*[None] * len(some), *(int(node[j]) for _, j in edges)]
            yield pa.RecordBatch.from_pydict({"a": a, "b": b, "links": [*n[some].tolist(), *[0] * len(edges)]}, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            for row in zip(*batch.to_pydict().values(), strict=True):
                if group and group[0][:3] != row[:3]:
                    yield from settle(group)
                    group = []
                group.append(row)
        if group:
            yield from settle(group)

    return small_batches(rows).mapInArrow(run, kind)


def linked_blocks(lists: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links in the buckets ``lists`` (key, n, node, ball) by blocks: each pair of blocks of a bucket is one group."""
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = lists.select("key", "node", "ball", parts.alias("parts"), F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"))
    rows = rows.join(nodes.select("node", "copies", "unit", "keys"), "node")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    rows = rows.withColumn("other", other).select(
        "key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "node", "ball", "copies", "unit", "keys"
    )
    return compared(rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high"))


def report(vectors: DataFrame) -> DataFrame:
    """A row for each vector: its links, the smallest id of its component, whether that is its own."""
    rows = settled(directed(vectors))
    nodes = rows.where("ident is not null").groupBy("ident").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first_id"), F.first("unit").alias("unit"))
    nodes = settled(nodes.select(F.monotonically_increasing_id().alias("node"), "copies", "first_id", "ident", "unit"))
    nodes = settled(hashed(nodes, *tables(nodes.count())))
    postings = posted(nodes)
    heads = postings.groupBy("key").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    lists = settled(postings.join(heads, "key").select("key", "n", "head", "node"))

    units = nodes.select("node", "unit")
    pairs = lists.where("node <> head").select("node", "head").distinct()
    pairs = pairs.join(units.withColumnRenamed("unit", "x"), "node").join(units.select(F.col("node").alias("head"), F.col("unit").alias("y")), "head")
    near = with_cosine(pairs.select("node", "head", "x", "y")).where(F.col("cosine") >= BALL)
    near = settled(near.groupBy("node").agg(F.min("head").alias("ball")))

    placed = settled(lists.select("key", "n", "node").join(near, "node", "left").select("key", "n", "node", F.coalesce("ball", "node").alias("ball")))
    mixed = placed.groupBy("key").agg(F.min("ball").alias("_low"), F.max("ball").alias("_high")).where("_low <> _high").select("key")
    found = settled(linked_blocks(placed.join(mixed, "key"), nodes))

    edges = found.where("b is not null").select("a", "b").unionByName(near.select(F.col("node").alias("a"), F.col("ball").alias("b")))
    across = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("_across"))
    of_node = nodes.select("node", "copies", "first_id", "ident").join(near, "node", "left").withColumn("ball", F.coalesce("ball", "node"))
    sizes = of_node.groupBy("ball").agg(F.sum("copies").alias("_size"))
    of_node = of_node.join(sizes, "ball").join(across, "node", "left").join(components(edges), "node", "left")
    of_node = settled(of_node.select(
        "ident", "first_id", F.coalesce("component", "node").alias("component"),
        (F.col("_size") - 1 + F.coalesce("_across", F.lit(0))).alias("n_links"),
    ))
    least = of_node.groupBy("component").agg(F.min("first_id").alias("_least"))
    named = of_node.join(least, "component").select("ident", "n_links", "_least")
    alone = F.col("ident").isNull()
    joined = rows.select("vec_id", "ident").join(named, "ident", "left")
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("_least"))
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
