"""Free-text vote records to party positions, as JVM column expressions only.

A record looks like ``A Favor: <I>PS</I>, <I>IL</I><BR>Contra:<I>CH</I>``. The table jobs add the
four lists (`parse_positions`) and turn them into one row per vote, position and party
(`vote_positions`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemiciclo.schemas import POSITIONS

# Text marks of the source format.
SECTION_MARK = "<BR>"
TAG_PATTERN = "</?I>"
INDEPENDENT_MARK = "(Ninsc)"

# The characters that count as white space at an end, the no-break space among them,
# which a plain trim() leaves.
WHITE_SPACE = (
    "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Digits are those of any script (U); only \n is a line end (d).
_AGGREGATE = r"(?Ud)^\d+(-|$)"
_MEMBER_OF_PARTY = r"(?d)^.+\(.+\)$"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def _section_key(head: Column, fold_accents: bool) -> Column:
    key = F.replace(F.lower(strip(head)), F.lit(" "), F.lit("_"))
    key = F.replace(key, F.lit("ção"), F.lit("cao"))
    return F.translate(key, "áâãàéêíóôõúç", "aaaaeeiooouc") if fold_accents else key


def _keep(token: Column) -> Column:
    """Party codes and independent members stay; counts and members of a party go."""
    counted = token.rlike(_AGGREGATE)
    independent = F.contains(token, F.lit(INDEPENDENT_MARK))
    # The cheap test of the last character spares most tokens the pattern.
    member = F.endswith(token, F.lit(")")) & token.rlike(_MEMBER_OF_PARTY)
    # "6-..." is dropped even for an independent member; digits alone can't hold the mark.
    return (token != "") & ~counted & (independent | ~member)


def _tokens(body: Column) -> Column:
    plain = F.regexp_replace(body, TAG_PATTERN, "")
    return F.filter(F.transform(F.split(plain, ","), strip), _keep)


def parse_positions(
    df: DataFrame, source: str = "detalhe", target: str = "detalhe_parsed", fold_accents: bool = False
) -> DataFrame:
    """Add ``target``: a struct of four lists, NULL where ``source`` is NULL or blank.

    Of several sections with one key the last counts. ``Ausência`` with its accent isn't a known
    key and is left out unless ``fold_accents`` is set.
    """
    text = F.col(source)
    halves = F.filter(
        F.transform(F.split(text, SECTION_MARK), lambda part: F.split(part, ":", 2)), lambda h: F.array_size(h) == 2
    )
    sections = F.transform(
        halves, lambda h: F.struct(_section_key(h[0], fold_accents).alias("key"), h[1].alias("body"))
    )

    def body_of(position: str) -> Column:
        same = F.filter(F.col("_sections"), lambda s: s["key"] == position)
        return F.try_element_at(same, F.lit(-1))["body"]

    parsed = F.struct(*[
        F.coalesce(_tokens(body_of(p)), F.array().cast("array<string>")).alias(p) for p in POSITIONS
    ])
    return (
        df.withColumn("_sections", F.when(strip(text) != "", sections))
        .withColumn(target, F.when(F.col("_sections").isNotNull(), parsed))
        .drop("_sections")
    )


def vote_positions(
    votes: DataFrame, keep: Sequence[str], positions: Sequence[str] = POSITIONS, parsed: str = "detalhe_parsed"
) -> DataFrame:
    """One row per vote, position and party in one pass over the votes; empty lists give no rows."""
    pairs = ", ".join(f"'{p}', {parsed}.{p}" for p in positions)
    listed = votes.select(*keep, F.expr(f"stack({len(positions)}, {pairs}) AS (position, parties)"))
    return listed.select(*keep, "position", F.explode("parties").alias("party"))


def vote_positions_union(
    votes: DataFrame, keep: Sequence[str], positions: Sequence[str] = POSITIONS, parsed: str = "detalhe_parsed"
) -> DataFrame:
    """The same rows as a UNION ALL of one unnest per position: a scan for each, so the slower form."""
    branches = [
        votes.select(*keep, F.lit(p).alias("position"), F.explode(f"{parsed}.{p}").alias("party"))
        for p in positions
    ]
    out = branches[0]
    for branch in branches[1:]:
        out = out.unionByName(branch)
    return out
