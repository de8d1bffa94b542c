"""Reply trees as chat conversations.

Messages name the message they answer. Iterative self-joins enumerate the paths from roots to leaves:
pointers to the ancestors 1, 2, 4, ... steps up come from joining the pointers with themselves, and a path
grows by joining what it has so far with the pointers of falling length, so a thread of n messages takes
log2(n) joins and not n. Branches are ranked by their mean score, and each chosen path is formatted as one
conversation with a loss mask over assistant texts. A message shared by several chosen paths is under the
mask of the best ranked of them only.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n`` a turn. Inside roles and texts ``<|`` becomes ``<\\|``,
and ``<\\|`` gets one more backslash, and so on; nothing between the marks can be taken for a mark, and the
texts read back exactly. In roles a line end and a backslash are escaped as well.

Edge cases: a null text or role is empty; a null tree is a tree of its own; a message whose parent is
missing is a root; equal turns are ordered by role and text; repeated rows are turns of their own; a
message that answers itself, directly or not, raises ValueError; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from hemiciclo.llm.common import map_batches, schema_of, small_batches
from hemiciclo.sources.shared import shared_folder

START, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"
_OPEN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
_FORMATTED = "tree string, leaf bigint, formatted string, spans array<struct<start: bigint, end: bigint>>"


def escaped(text: str | None) -> str:
    return _OPEN.sub(r"<\\\1|", text or "")


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escaped_role(role: str | None) -> str:
    return escaped((role or "").replace("\\", "\\\\").replace("\n", "\\n"))


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    return [(unescaped_role(m[1]), unescaped(m[2])) for m in _TURN.finditer(formatted)]


def tree_key(column: Column) -> Column:
    """A tree's id as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("null"))


def chain(turns: DataFrame) -> DataFrame:
    """Messages of plain conversations, each answering the one before it; numbered as `told` orders them, without texts."""
    sizes = turns.groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
    rows = sizes.select("tree", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("node"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"))


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: such ids take far less room there than in a checkpoint."""
    path = f"{shared_folder(df.sparkSession)}/chat-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ancestors(links: DataFrame) -> list[DataFrame]:
    """For k = 0, 1, ...: which node is 2**k steps above which; ends when no node has one."""
    present = links.select("tree", F.col("node").alias("up"))
    steps = [stored(links.where("parent is not null").select("tree", "node", F.col("parent").alias("up")).join(present, ["tree", "up"], "left_semi").select("tree", "node", "up"))]
    rows = links.count()
    while steps[-1].take(1):
        if 2 ** (len(steps) - 1) > rows:
            raise ValueError("messages answer each other in a circle")
        low = steps[-1]
        high = low.select("tree", F.col("node").alias("up"), F.col("up").alias("_far"))
        steps.append(stored(low.join(high, ["tree", "up"]).select("tree", "node", F.col("_far").alias("up"))))
    return steps[:-1]


def paths(links: DataFrame) -> DataFrame:
    """All nodes of all root-to-leaf paths: tree, leaf, node, steps above the leaf."""
    steps = ancestors(links)
    parents = steps[0].select("tree", F.col("up").alias("node")) if steps else links.select("tree", "node").limit(0)
    leaves = links.select("tree", "node").join(parents, ["tree", "node"], "left_anti")
    found = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("above"))
    for k in range(len(steps) - 1, -1, -1):
        # Each row and the one above it from one join: naming ``found`` twice would double the plan at every step.
        both = F.array(F.struct("node", "above"), F.struct(F.col("up").alias("node"), (F.col("above") + 2**k).alias("above")))
        found = found.join(steps[k], ["tree", "node"], "left").select("tree", "leaf", F.inline(both)).where("node is not null")
    return found


def chosen(links: DataFrame, top: int | None = None) -> DataFrame:
    """Nodes of each tree's ``top`` best branches (None: all): rank, place on the path, whether the loss is taken here."""
    links = stored(links)
    on_path = stored(paths(links).join(links.select("tree", "node", "score"), ["tree", "node"]))
    branches = on_path.groupBy("tree", "leaf").agg(F.avg("score").alias("mean"), F.max("above").alias("depth"))
    branches = branches.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc_nulls_last("mean"), "leaf")))
    branches = branches.where(F.col("rank") <= top) if top else branches
    on_path = on_path.join(branches.select("tree", "leaf", "rank", "depth"), ["tree", "leaf"])
    first = on_path.groupBy("tree", "node").agg(F.min("rank").alias("first"))
    return stored(on_path.join(first, ["tree", "node"]).select(
        "tree", "leaf", "node", "rank", (F.col("depth") - F.col("above")).alias("place"), (F.col("first") == F.col("rank")).alias("own")
    ))


def told(turns: DataFrame, branches: DataFrame) -> DataFrame:
    """Branches of `chain` with roles and texts. Texts are shuffled once: they are numbered, find their
    branches and are put in order in the partitions of their conversation."""
    said = turns.select("tree", "turn", "role", "text", F.lit(0).alias("kind"))
    asked = branches.select("tree", "node", "leaf", "place", "own", F.lit(1).alias("kind"))
    both = said.unionByName(asked, allowMissingColumns=True)
    number = F.row_number().over(Window.partitionBy("tree").orderBy("kind", "turn", "role", "text"))
    both = both.withColumn("node", F.coalesce("node", number.cast("long")))
    mine = Window.partitionBy("tree", "node").orderBy("kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    full = both.select("tree", "leaf", "place", "own", "kind", *[F.first(c).over(mine).alias(c) for c in ("role", "text")])
    return full.where("kind = 1").sortWithinPartitions("tree", "leaf", "place")


def formatted(nodes: DataFrame, top: int | None = None, learned: str = LEARNED) -> DataFrame:
    """A row for each chosen path: the conversation and its loss mask as spans of code points.

    Paths are found and chosen by ids; texts join the chosen ones only.
    """
    branches = chosen(nodes.select("tree", "node", "parent", "score"), top)
    rows = branches.join(nodes.select("tree", "node", "role", "text"), ["tree", "node"])
    return written_out(rows.repartition("tree", "leaf").sortWithinPartitions("tree", "leaf", "place"), learned)


def written_out(rows: DataFrame, learned: str = LEARNED) -> DataFrame:
    """Rows of a path stand together and in order: a sort that can spill; a task holds one conversation at a time."""
    kind = schema_of(_FORMATTED)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, spans, size, ready = None, [], [], 0, []

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*ready, strict=True), arrow, strict=True)], schema=arrow)
            ready.clear()
            return out

        for batch in batches:
            for row in batch.to_pylist():
                if (row["tree"], row["leaf"]) != key:
                    if key is not None:
                        ready.append((*key, "".join(parts), spans))
                        if sum(len(x[2]) for x in ready) > 4_000_000:
                            yield flush()
                    key, parts, spans, size = (row["tree"], row["leaf"]), [], [], 0
                head = f"{START}{escaped_role(row['role'])}\n"
                text = escaped(row["text"])
                if row["role"] == learned and row["own"]:
                    spans.append({"start": size + len(head), "end": size + len(head) + len(text)})
                parts += [head, text, END, "\n"]
                size += len(head) + len(text) + len(END) + 1
        if key is not None:
            ready.append((*key, "".join(parts), spans))
            yield flush()

    rows = rows.select("tree", "leaf", "role", "text", "own")
    return small_batches(rows).mapInArrow(run, kind)


def digests(conversation: str, spans: list[dict]) -> dict:
    """What reads back from a formatted conversation and its mask."""
    turns = read_back(conversation)
    whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode())
    masked = [unescaped(conversation[s["start"]:s["end"]]) for s in spans]
    return {
        "n_turns": len(turns), "turns_sha256": whole.hexdigest(), "loss_chars": sum(map(len, masked)),
        "loss_sha256": hashlib.sha256("".join(masked).encode()).hexdigest(), "formatted_chars": len(conversation),
    }


def report(conversations: DataFrame) -> DataFrame:
    """Digests of plain conversations, one path each, read back from their formatted text."""
    turns = conversations.select(tree_key(F.col("conv_id")).alias("tree"), "turn", "role", "text")
    done = written_out(told(turns, chosen(chain(turns))))

    def read(batch):
        rows = [digests(c, s) for c, s in zip(batch["formatted"], batch["spans"], strict=True)]
        return {"tree": batch["tree"]} | {name: [r[name] for r in rows] for name in rows[0]}

    out = map_batches(done, read, "tree string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
    conv_id = F.when(F.col("tree") != "null", F.substring("tree", 2, 2**31 - 1)).cast(conversations.schema["conv_id"].dataType)
    return out.select(conv_id.alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
