"""Quality rules whose cutoffs carry a guarantee.

Each rule rejects a document when a feature exceeds a cutoff. Labelled documents are split in two. The
first part gives, for each level of a ladder, one cutoff a rule: the share ``level`` of good documents
lies beyond it. The second part, the holdout, tests the levels in each stratum from the mildest on: a
level passes if an exact binomial test refutes, at the error the stratum is allowed, that more than
``max_rejected`` of the stratum's good documents are rejected. The first level that fails ends the walk
(testing in a fixed order needs no correction), and the strata share ``error`` equally (Bonferroni). So,
with probability 1 - ``error``, no stratum loses more than ``max_rejected`` of its good documents. Of the
levels that passed, the mildest is used that catches nearly as many bad documents of the first part as the
strictest (a milder level than one that passed has passed too).
A stratum whose holdout is too small to pass any level is only held to the base rules.

Edge cases: a null or empty text has no words and fails the base rules; rows repeated in ``documents``
are judged each; of several labels for one id a 1 wins; null labels are left out; a null stratum is a
stratum of its own; without labels no level passes.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hemiciclo.llm.common import free_name, of_ids, with_struct
from hemiciclo.sources.shared import settled

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_REJECTED = 0.05
ERROR = 0.05
#: Of the bad documents that the strictest level catches, the share that a milder one has to catch.
ENOUGH = 0.99
#: Shares of good documents beyond a rule's cutoff, mildest first.
LADDER = (0.0, 0.0005, 0.001, 0.002, 0.004, 0.006, 0.008, 0.01)
RULES = ("symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "bang_rate")
SYMBOLS = "#*$%&|<>"
COUNTS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean"
KIND = COUNTS + "".join(f", {r} double" for r in RULES)
_BLANKS = " \t\n\v\f\r"
_UPPER = re.compile("[A-ZÀ-ÖØ-Þ]")


def repeat_words(words: list, size: int = 5) -> int:
    """Words in windows of ``size`` words that the list holds twice or more, every occurrence counted."""
    windows = list(zip(*(words[i:] for i in range(size))))
    seen, twice = set(), set()
    if len(set(windows)) == len(windows):
        return 0
    for window in windows:
        (twice if window in seen else seen).add(window)
    found, end = 0, 0
    for at, window in enumerate(windows):
        if window in twice:
            found += at + size - max(at, end)
            end = at + size
    return found


def features(text: str | None) -> dict:
    text = text or ""
    words = text.encode().split()
    n_words, n_bangs = len(words), text.count("!")
    word_chars = len(text) - sum(map(text.count, _BLANKS))
    lines = [x for x in text.split("\n") if x.strip(_BLANKS)]
    dup_lines = len(lines) - len(set(lines))
    symbols = sum(map(text.count, SYMBOLS))
    repeated = repeat_words(words)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeated,
        "base_failed": n_words < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * n_words,
        "symbol_rate": symbols / max(word_chars, 1), "dup_line_rate": dup_lines / max(len(lines), 1),
        "repeat_rate": repeated / max(n_words, 1), "upper_rate": len(_UPPER.findall(text)) / max(word_chars, 1),
        "bang_rate": n_bangs / max(n_words, 1),
    }


def with_features(docs: DataFrame, name: str, text: str = "text") -> DataFrame:
    return with_struct(docs, text, lambda texts: [features(t) for t in texts], name, KIND)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial X(n, p), summed exactly."""
    if n == 0:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    return min(1.0, math.fsum(math.exp(x) for x in logs))


@dataclass(frozen=True)
class Cutoffs:
    """A row of cutoffs a level, in the order of RULES, and the level each stratum (null included) may use."""

    by_level: tuple[tuple[float, ...], ...]
    levels: DataFrame  # stratum, level


def fit(docs: DataFrame, labels: DataFrame, stratum: str = "lang", max_rejected: float = MAX_REJECTED, error: float = ERROR) -> Cutoffs:
    """Cutoffs from all labelled good documents: even hashes of the id set them, odd ones test them."""
    good = labels.where("quality is not null").groupBy("doc_id").agg((F.max("quality") == 1).alias("good"))
    rows = of_ids(docs.select("doc_id", "text", F.col(stratum).alias("stratum")), good.select("doc_id"), "doc_id")
    labelled = with_features(rows, "f").join(good, "doc_id")
    labelled = settled(labelled.select("good", "stratum", (F.crc32(F.col("doc_id").cast("string")) % 2).alias("part"), *[F.col(f"f.{r}").alias(r) for r in RULES], (~F.col("f.base_failed")).alias("stays")).where("stays"))
    found = percentiles(labelled.where("good and part = 0"), RULES, [1 - level for level in LADDER])
    if found is None:
        return Cutoffs((), labelled.sparkSession.createDataFrame([], "stratum string, level int"))
    by_level = tuple(tuple(found[r][i] for r in RULES) for i in range(len(LADDER)))
    counts = labelled.where("good and part = 1").groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(exceeds(cuts)).alias(f"k{i}") for i, cuts in enumerate(by_level)])
    caught = labelled.where("not good and part = 0").agg(*[F.count_if(exceeds(cuts)).alias(f"k{i}") for i, cuts in enumerate(by_level)]).first()
    useful = next(i for i, n in enumerate(caught) if n >= ENOUGH * caught[-1])
    share = error / max(1, counts.count())

    def walk(frames):
        for frame in frames:
            passed = []
            for row in frame.itertuples():
                level = -1
                for i in range(useful + 1):
                    if binomial_tail(getattr(row, f"k{i}"), row.n, max_rejected) > share:
                        break
                    level = i
                passed.append(level)
            yield frame.assign(level=passed)[["stratum", "level"]]

    return Cutoffs(by_level, counts.mapInPandas(walk, "stratum string, level int").where("level >= 0"))


def by_value(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """How often each value of each column occurs, in ranges of (column, value): name, value, n, range."""
    named = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns]))
    counts = df.select(named.alias("v")).select("v.*").where("value is not null").groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
    return settled(counts.repartitionByRange("name", "value").withColumn("range", F.spark_partition_id()))


def percentiles(df: DataFrame, columns: tuple[str, ...], shares: list[float]) -> dict[str, list[float]] | None:
    """The exact percentiles of columns, as F.percentile gives them; None without rows.

    F.percentile holds all values of a column in one task. Here ranges of values are counted, and only the
    ranges with a wanted rank are looked into.
    """
    counts = by_value(df, columns)
    sizes = counts.groupBy("name", "range").agg(F.sum("n").alias("n"), F.min("value").alias("low")).collect()
    if not sizes:
        return None
    total, wanted = {}, []
    for c in columns:
        ranges = sorted((r for r in sizes if r.name == c), key=lambda r: r.low)
        total[c] = sum(r.n for r in ranges)
        places = [(total[c] - 1) * share for share in shares]
        before = 0
        for r in ranges:
            wanted += [(c, r.range, rank, rank - before) for rank in {f(x) for x in places for f in (math.floor, math.ceil)} if before <= rank < before + r.n]
            before += r.n
    ranks = F.broadcast(df.sparkSession.createDataFrame(wanted, "name string, range int, rank bigint, at bigint"))
    running = counts.join(ranks.select("name", "range"), ["name", "range"], "left_semi").withColumn("upto", F.sum("n").over(Window.partitionBy("name", "range").orderBy("value")))
    found = running.join(ranks, ["name", "range"]).where("at < upto and at >= upto - n").select("name", "rank", "value").collect()
    at = {(r.name, r.rank): r.value for r in found}

    def value(c, share):
        place = (total[c] - 1) * share
        low, high = math.floor(place), math.ceil(place)
        a, b = at[c, low], at[c, high]
        return a if a == b else (high - place) * a + (place - low) * b

    return {c: [value(c, share) for share in shares] for c in columns}


def exceeds(cuts, of: str = ""):
    """Whether any rule's feature lies beyond its cutoff."""
    test = F.lit(False)
    for rule, cut in zip(RULES, cuts, strict=True):
        test = test | (F.col(of + rule) > F.lit(cut))
    return test


def judge(docs: DataFrame, labels: DataFrame, name: str = "quality", stratum: str = "lang", **limits) -> DataFrame:
    """``docs`` (doc_id, text, the stratum and any other columns) with a struct ``name``: features and ``kept``."""
    cutoffs = fit(docs, labels, stratum, **limits)
    measured = with_features(docs, name)
    level, joined = free_name(measured, "_level"), free_name(measured, "_stratum")
    of_stratum = F.broadcast(cutoffs.levels) if cutoffs.levels.count() <= 100_000 else cutoffs.levels
    of_stratum = of_stratum.select(F.col("stratum").alias(joined), F.col("level").alias(level))
    measured = measured.join(of_stratum, F.col(stratum).cast("string").eqNullSafe(F.col(joined)), "left")
    rejected = F.lit(False)
    for i, cuts in enumerate(cutoffs.by_level):
        rejected = rejected | ((F.col(level) == i) & exceeds(cuts, f"{name}."))
    kept = ~F.col(f"{name}.base_failed") & ~F.coalesce(rejected, F.lit(False))
    return measured.withColumn(name, F.col(name).withField("kept", kept)).drop(level, joined)


def keep_good(docs: DataFrame, labels: DataFrame, **limits) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    name = free_name(docs, "_quality")
    return judge(docs, labels, name, **limits).where(F.col(f"{name}.kept")).select(*docs.columns)
