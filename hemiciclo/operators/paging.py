"""Pages of a filtered set and its total.

A top-k plan brings limit + offset rows of every task into one. Where those could be more than
FUNNEL_ROWS, the page's place is looked up first (`located`): rows are counted by the value, or a
few more characters, of the leading key, running counts tell which values hold the page's first and
last row, and a group that is still large is counted anew by what comes next. The scan then gets
the two ends as a filter, and only the few rows between them are sorted.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property, reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hemiciclo.operators.predicates import DEFAULT_LIMIT, page_bounds

#: Rows that may meet in one task.
FUNNEL_ROWS = 1_000_000
#: A group of so many rows isn't divided further.
GROUP_ROWS = 100_000
#: By so many characters at a time a text key is told apart: few enough groups for one running count.
CHARACTERS = 3


@dataclass(frozen=True)
class Key:
    """A column to sort by; rows without a value come last either way."""

    name: str
    descending: bool = False

    @property
    def column(self) -> Column:
        return self.sorted(F.col(self.name))

    def sorted(self, value: Column) -> Column:
        return value.desc_nulls_last() if self.descending else value.asc_nulls_last()


def newest_first(day: str, *keys: Key) -> list[Key]:
    """Latest date first, rows without a date last, then the keys."""
    return [Key(day, descending=True), *keys]


def ascending(*fields: str) -> list[Key]:
    """Plain ascending order with NULLs last, where Spark's own default is first."""
    return [Key(f) for f in fields]


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


@dataclass(frozen=True)
class Step:
    """One value of a key, or of a text key's first ``characters``, that leads to a row."""

    key: Key
    characters: int | None
    value: object

    @property
    def column(self) -> Column:
        c = F.col(self.key.name)
        return c if self.characters is None else F.substring(c, 1, self.characters)

    def same(self) -> Column:
        c = F.col(self.key.name)
        if self.value is None:
            return c.isNull()
        whole = self.characters is None or len(self.value) < self.characters
        return c == F.lit(self.value) if whole else F.startswith(c, F.lit(self.value))

    def beyond(self, after: bool, or_equal: bool) -> Column:
        """Values that sort after (else before) this one, in forms that reach the scan. NULL comes last."""
        c, v = F.col(self.key.name), F.lit(self.value)
        if self.value is None:
            return (c.isNull() if after else F.lit(True)) if or_equal else (F.lit(False) if after else c.isNotNull())
        if after != self.key.descending:  # larger ones
            inside = c >= v if or_equal else (c > v) & ~self.same()
        else:
            inside = c < v if not or_equal else c <= v if self.characters is None else (c < v) | self.same()
        return inside | c.isNull() if after else inside


@dataclass(frozen=True)
class Place:
    """A group of rows that holds a wanted one: the steps that lead to it and how many rows come before."""

    steps: tuple[Step, ...]
    before: int

    def side(self, after: bool) -> Column:
        """Rows of the group and of all groups after (else before) it. The first key's bound stands on
        its own, so that it reaches the scan."""
        branches = []
        for i, step in enumerate(self.steps):
            last = i == len(self.steps) - 1
            met = [s.same() for s in self.steps[:i]]
            branches.append(reduce(lambda a, b: a & b, [*met, step.beyond(after, or_equal=last)]))
        return self.steps[0].beyond(after, or_equal=True) & reduce(or_, branches)


def _groups(rows: DataFrame, keys: Sequence[Key], steps: tuple[Step, ...]) -> Step | None:
    """What to tell the rows of the group that ``steps`` lead to apart by; None if all keys are used up."""
    texts = {f.name for f in rows.schema.fields if isinstance(f.dataType, T.StringType)}
    at = 0
    if steps:
        last = steps[-1]
        at = next(i for i, k in enumerate(keys) if k.name == last.key.name)
        if last.characters is not None and last.value is not None and len(last.value) == last.characters:
            return Step(last.key, last.characters + CHARACTERS, None)
        at += 1
    if at == len(keys):
        return None
    return Step(keys[at], CHARACTERS if keys[at].name in texts else None, None)


def located(rows: DataFrame, keys: Sequence[Key], ranks: Sequence[int]) -> tuple[list[Place], int]:
    """Groups of at most GROUP_ROWS rows (or of equal keys) that hold the rows of these ranks, from 0, and the total.

    Each round is one aggregate over the rows of a group, and gives the driver two rows.
    """
    found: dict[int, Place] = {}
    whole = None
    todo: dict[tuple[Step, ...], tuple[int, list[int]]] = {(): (0, list(ranks))}
    while todo:
        steps, (before, wanted) = todo.popitem()
        by = _groups(rows, keys, steps)
        inside = reduce(lambda df, s: df.where(s.same()), steps, rows)
        counts = inside.groupBy(by.column.alias("value")).agg(F.count(F.lit(1)).alias("n"))
        running = counts.select(
            "value", "n", F.sum("n").over(Window.orderBy(by.key.sorted(F.col("value")))).alias("until"), F.sum("n").over(Window.partitionBy()).alias("all"),
        )
        hit = reduce(or_, [(F.col("until") > r - before) & (F.col("until") - F.col("n") <= r - before) for r in wanted])
        if whole is None:
            hit |= F.col("until") == F.col("all")
        picked = running.where(hit).collect()
        if whole is None:
            whole = max((r.all for r in picked), default=0)
        for rank in wanted:
            row = next((r for r in picked if r.until - r.n <= rank - before < r.until), None)
            if row is None:  # beyond the last row
                continue
            path = (*steps, Step(by.key, by.characters, row.value))
            start = before + row.until - row.n
            if row.n > GROUP_ROWS and _groups(rows, keys, path) is not None:
                todo.setdefault(path, (start, []))[1].append(rank)
            else:
                found[rank] = Place(path, start)
    return [found[r] for r in ranks if r in found], whole


def read_tasks(df: DataFrame) -> int:
    """How many tasks scan the files behind ``df``, about, after partitions are pruned."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    per_task = df._jdf.sparkSession().sessionState().conf().filesMaxPartitionBytes()
    return -(-size // per_task) or 1


@dataclass(frozen=True)
class Listing:
    """A filtered set with its order. Page and total are plans of their own, each pruned on its own."""

    rows: DataFrame
    order: Sequence[Key]
    columns: Sequence[str | Column]
    limit: int = DEFAULT_LIMIT
    offset: int = 0

    def __post_init__(self):
        page_bounds(self.limit, self.offset)

    @cached_property
    def _ends(self) -> tuple[list[Place], int] | None:
        """Where the page lies and the total, unless so few tasks read the rows that a top-k plan is as good."""
        if read_tasks(self.rows) * (self.limit + self.offset) <= FUNNEL_ROWS:
            return None
        return located(self.rows, self.order, sorted({self.offset, self.offset + self.limit - 1}))

    @property
    def page(self) -> DataFrame:
        rows, offset = self.rows, self.offset
        if self._ends is not None:
            places, whole = self._ends
            if offset >= whole:
                rows = rows.limit(0)
            else:
                rows = rows.where(places[0].side(after=True))
                if offset + self.limit <= whole:
                    rows = rows.where(places[-1].side(after=False))
                offset -= places[0].before
        return rows.orderBy(*[k.column for k in self.order]).offset(offset).limit(self.limit).select(*self.columns)

    @property
    def total(self) -> DataFrame:
        return total(self.rows)

    def page_with_total(self) -> DataFrame:
        """The page, each row with the total; looking a page up has counted the rows already."""
        page = self.page
        if self._ends is not None:
            return page.withColumn("total", F.lit(self._ends[1]).cast("bigint"))
        return page.withColumn("total", self.total.scalar())
