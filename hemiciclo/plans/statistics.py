"""Aggregate reports. Each gives all legislatures at once, or one if a code is passed.

Their rows are unordered, so that reports built on reports don't sort on the way; `ranked` orders
what is shown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemiciclo.functions.positions import vote_positions
from hemiciclo.operators.predicates import equals, legislature_code, select_where
from hemiciclo.plans.initiatives import AUTHOR_GROUPS, headers
from hemiciclo.plans.people import party

LEG = "legislatura"
VOTED = ("a_favor", "contra", "abstencao")  # absences are parsed but never counted
# How a report names the positions.
POSITION_LABELS = {"a_favor": "A Favor", "contra": "Contra", "abstencao": "Abstenção"}


def _of(df: DataFrame, legislatura: str | None, *conditions: Column) -> DataFrame:
    return select_where(df, equals(LEG, legislature_code(legislatura)), *conditions)


def _rows() -> Column:
    return F.count(F.lit(1))


def ranked(report: DataFrame, measure: str | None, *names: str) -> DataFrame:
    """A report in reading order: by legislature, then the largest measure, then the names."""
    largest = [F.col(measure).desc()] if measure else []
    return report.orderBy(LEG, *largest, *names)


def initiatives_by_phase(votes: DataFrame, legislatura: str | None = None) -> DataFrame:
    """Votes and distinct initiatives by phase and result."""
    known = _of(votes, legislatura, F.col("fase").isNotNull(), F.col("resultado").isNotNull())
    return known.groupBy(LEG, "fase", "resultado").agg(
        _rows().alias("vote_count"), F.countDistinct("ini_id").alias("initiative_count")
    )


def authors_of(votes: DataFrame) -> Column:
    """The author parties of a vote's initiative; a table from before they were stored is an error, not empty."""
    return F.coalesce("ini_autores_gp", F.raise_error(F.lit("votacoes holds no authors: write it anew")).cast("array<string>"))


def party_totals(initiatives: DataFrame, legislatura: str | None = None) -> DataFrame:
    """Distinct initiatives by author party."""
    lists = _of(headers(initiatives), legislatura).select(LEG, "ini_id", F.col(AUTHOR_GROUPS).alias("authors"))
    authors = lists.select(LEG, "ini_id", F.explode(F.array_distinct("authors")).alias("party"))
    return authors.where(F.col("party").isNotNull()).groupBy(LEG, "party").agg(
        F.countDistinct("ini_id").alias("total_initiatives")
    )


def _by_author(counted: DataFrame) -> DataFrame:
    """Counts ``n`` by author list, phase and result spread over the parties of the lists."""
    known = counted.where(F.col("fase").isNotNull() & F.col("resultado").isNotNull())
    spread = known.select(LEG, F.explode("authors").alias("party"), "fase", "resultado", "n")
    return spread.where(F.col("party").isNotNull()).groupBy(LEG, "party", "fase", "resultado").agg(
        F.sum("n").alias("vote_count")
    )


def party_outcomes(votes: DataFrame, legislatura: str | None = None) -> DataFrame:
    """Votes by author party, phase and result; a party listed twice on an initiative counts twice.

    Votes hold their initiative's author list, so there is no join. They are counted by list, of
    which there are few, and only those counts are spread over the parties.
    """
    listed = _of(votes, legislatura).select(LEG, authors_of(votes).alias("authors"), "fase", "resultado")
    return _by_author(listed.groupBy(LEG, "authors", "fase", "resultado").agg(_rows().alias("n")))


def _with_outcomes(totals: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Parties with their outcomes as a list of at most phases x results entries."""
    outcome = F.struct("fase", "resultado", F.col("vote_count").alias("count"))
    nested = outcomes.groupBy(LEG, "party").agg(F.sort_array(F.collect_list(outcome)).alias("fase_outcomes"))
    empty = F.array().cast(nested.schema["fase_outcomes"].dataType)
    return totals.join(nested, [LEG, "party"], "left").withColumn("fase_outcomes", F.coalesce("fase_outcomes", empty))


def initiatives_by_party(initiatives: DataFrame, votes: DataFrame, legislatura: str | None = None) -> DataFrame:
    """(party, total_initiatives, fase_outcomes[fase, resultado, count]); no votes give an empty list.

    Both sides of the join are aggregates: a row a party.
    """
    return _with_outcomes(party_totals(initiatives, legislatura), party_outcomes(votes, legislatura))


def votes_by_phase(votes: DataFrame, legislatura: str | None = None) -> DataFrame:
    return _of(votes, legislatura, F.col("fase").isNotNull()).groupBy(LEG, "fase").agg(
        _rows().alias("vote_count")
    )


def _labelled(counted: DataFrame) -> DataFrame:
    label = F.col("position")
    for position, text in POSITION_LABELS.items():
        label = F.when(F.col("position") == position, text).otherwise(label)
    return counted.select(LEG, "party", label.alias("vote_type"), "vote_count")


def votes_by_party_and_position(votes: DataFrame, legislatura: str | None = None) -> DataFrame:
    """How often each party voted which way: one pass over the votes, counted before the shuffle."""
    cast_votes = vote_positions(_of(votes, legislatura), [LEG], VOTED).where(F.col("party").isNotNull())
    return _labelled(cast_votes.groupBy(LEG, "party", "position").agg(_rows().alias("vote_count")))


def activities_by_type(activities: DataFrame, legislatura: str | None = None) -> DataFrame:
    return _of(activities, legislatura, F.col("ativ_tipo").isNotNull()).groupBy(
        LEG, F.col("ativ_tipo").alias("tipo")
    ).agg(_rows().alias("count"))


def activity_votes_by_type(activity_votes: DataFrame, legislatura: str | None = None) -> DataFrame:
    return _of(activity_votes, legislatura, F.col("tipo").isNotNull()).groupBy(LEG, "tipo").agg(
        _rows().alias("vote_count")
    )


def _sources(votes: DataFrame, activity_votes: DataFrame, legislatura: str | None) -> DataFrame:
    def n(c: str) -> Column:
        return F.coalesce(F.sum(c), F.lit(0))

    both = votes.unionByName(activity_votes)
    counts = [n("i").alias("iniciativas"), n("a").alias("atividades"), (n("i") + n("a")).alias("total")]
    if legislatura is not None:
        return both.agg(F.lit(legislature_code(legislatura)).alias(LEG), *counts)
    return both.groupBy(LEG).agg(*counts)


def vote_sources(votes: DataFrame, activity_votes: DataFrame, legislatura: str | None = None) -> DataFrame:
    """Votes on initiatives, votes on activities and their total. One legislature always has a row."""
    return _sources(
        _of(votes, legislatura).select(LEG, F.lit(1).alias("i"), F.lit(0).alias("a")),
        _of(activity_votes, legislatura).select(LEG, F.lit(0).alias("i"), F.lit(1).alias("a")), legislatura,
    )


def vote_support(votes: DataFrame, gp_sigla: str | None = None, legislatura: str | None = None) -> DataFrame:
    """How every party voted on the initiatives of each author party, by phase.

    Votes hold their initiative's authors, so nothing is joined. They are counted by whole author
    list first, as in `party_outcomes`: a vote is unpivoted once and not once an author.
    """
    known = _of(votes, legislatura, F.col("fase").isNotNull(), F.col("detalhe_parsed").isNotNull())
    authors = authors_of(votes)
    if gp_sigla is not None:
        known, by = known.where(F.array_contains(authors, gp_sigla.upper())), "author"
        kept = known.select(LEG, F.lit(gp_sigla.upper()).alias(by), "fase", "detalhe_parsed")
    else:
        by = "authors"
        kept = known.select(LEG, F.array_sort(F.array_distinct(authors)).alias(by), "fase", "detalhe_parsed").where(F.array_size(by) > 0)
    cast_votes = vote_positions(kept, [LEG, by, "fase"], VOTED).where(F.col("party").isNotNull())
    counts = [F.count_if(F.col("position") == p).alias(f"{p}_count") for p in VOTED]
    counted = cast_votes.groupBy(LEG, by, "fase", "party").agg(*counts)
    if gp_sigla is None:
        spread = counted.select(LEG, F.explode("authors").alias("author"), "fase", "party", *[
            f"{p}_count" for p in VOTED
        ]).where(F.col("author").isNotNull())
        counted = spread.groupBy(LEG, "author", "fase", "party").agg(*[
            F.sum(f"{p}_count").alias(f"{p}_count") for p in VOTED
        ])
    return counted


def nested_vote_support(support: DataFrame) -> DataFrame:
    """(author, fase, vote_details[party, a_favor, contra, abstencao]): one entry a voting party."""
    detail = F.struct("party", *[F.col(f"{p}_count").alias(p) for p in VOTED])
    return support.groupBy(LEG, "author", "fase").agg(F.sort_array(F.collect_list(detail)).alias("vote_details"))


def party_vote_support(parties: DataFrame, votes: DataFrame, gp_sigla: str, legislatura: str) -> DataFrame:
    """The nested support report of one party; nothing if the legislature doesn't know the party."""
    gate = party(parties, gp_sigla, legislatura)
    return nested_vote_support(vote_support(votes, gp_sigla, legislatura)).where(gate.exists())


_CELL = ["kind", "fase", "resultado", "authors", "party", "position"]


def vote_cells(votes: DataFrame, legislatura: str | None = None) -> DataFrame:
    """What the reports count in votes, in one pass over them: (legislatura, kind, ..., n, initiatives).

    Kinds: `vote`, by phase, result and author list; `initiative`, distinct ones by phase and result; and
    `position`, by party. Votes are first counted by all that they share, whole lists included, and
    beside that by initiative; only those counts are spread over cells.
    """
    lists = {p: F.coalesce(F.col(f"detalhe_parsed.{p}"), F.array().cast("array<string>")) for p in VOTED}
    known = F.col("fase").isNotNull() & F.col("resultado").isNotNull()

    def row(kind: str, keep: bool) -> Column:
        kept = {"authors": authors_of(votes), **lists}
        none = F.lit(None).cast("array<string>")
        return F.struct(F.lit(kind).alias("kind"), *[(c if keep else none).alias(n) for n, c in kept.items()],
                        (F.lit(None).cast("string") if keep else F.col("ini_id")).alias("ini_id"))

    each = F.array_compact(F.array(row("vote", True), F.when(known, row("initiative", False))))
    rows = _of(votes, legislatura).select(LEG, "fase", "resultado", F.explode(each).alias("c")).select(LEG, "fase", "resultado", "c.*")
    counted = rows.groupBy(LEG, "fase", "resultado", "kind", "authors", *VOTED, "ini_id").agg(_rows().alias("n"))

    kinds = dict.fromkeys(_CELL[1:], "string") | {"authors": "array<string>"}

    def cell(kind: Column, **values: Column) -> Column:
        return F.struct(kind.alias("kind"), *[values.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])

    def positions(p: str) -> Column:
        return F.transform(F.coalesce(F.array_compact(p), F.array()), lambda x: cell(F.lit("position"), party=x, position=F.lit(p)))

    own = F.array(cell(F.col("kind"), **{c: F.col(c) for c in ("fase", "resultado", "authors")}))
    cells = counted.select(LEG, "n", "ini_id", F.explode(F.concat(own, *map(positions, VOTED))).alias("c")).select(LEG, "n", "ini_id", "c.*")
    return cells.groupBy(LEG, *_CELL).agg(F.sum("n").alias("n"), F.count("ini_id").alias("initiatives"))


def bundle(
    initiatives: DataFrame, votes: DataFrame, activities: DataFrame, activity_votes: DataFrame,
    legislatura: str | None = None,
) -> DataFrame:
    """All reports as one nested record a legislature.

    Each table is read once, into counts by parties, phases and types (`vote_cells`). Those few rows
    become rows of the reports they count for, are added up in one more shuffle and gathered in
    another. The lists hold such sums, never data rows.
    """
    def counts(df: DataFrame, kind: str, by: str) -> DataFrame:
        return df.groupBy(LEG, F.col(by).alias("by")).agg(_rows().alias("n")).withColumn("kind", F.lit(kind))

    totals = party_totals(initiatives, legislatura)
    cells = vote_cells(votes, legislatura)
    for part in (
        counts(_of(activities, legislatura), "activity", "ativ_tipo"), counts(_of(activity_votes, legislatura), "activity_vote", "tipo"),
        totals.select(LEG, F.col("party").alias("by"), F.col("total_initiatives").alias("n"), F.lit("party").alias("kind")),
    ):
        cells = cells.unionByName(part, allowMissingColumns=True)

    def line(report: str, party: Column | None = None, fase: Column | None = None, rest: Column | None = None) -> Column:
        values = {"party": party, "fase": fase, "rest": rest}
        return F.struct(F.lit(report).alias("report"), *[F.lit(None).cast("string").alias(c) if v is None else v.alias(c) for c, v in values.items()])

    fase, resultado, by, kind = (F.col(c) for c in ("fase", "resultado", "by", "kind"))
    label = F.col("position")
    for position, text in POSITION_LABELS.items():
        label = F.when(F.col("position") == position, text).otherwise(label)
    outcomes = F.when(fase.isNotNull() & resultado.isNotNull(), F.transform(F.array_compact("authors"), lambda x: line("outcome", x, fase, resultado)))
    of_kind = {
        "vote": F.concat(
            F.array_compact(F.array(line("vote"), F.when(fase.isNotNull(), line("phase", fase=fase)))),
            F.coalesce(outcomes, F.array().cast("array<struct<report:string,party:string,fase:string,rest:string>>")),
        ),
        "initiative": F.array(line("initiative", fase=fase, rest=resultado)), "position": F.array(line("position", F.col("party"), rest=label)),
        "activity": F.array(line("activity", rest=by)), "activity_vote": F.array(line("activity_vote", rest=by)), "party": F.array(line("party", by)),
    }
    lines = F.when(kind == "vote", of_kind.pop("vote"))
    for name, made in of_kind.items():
        lines = lines.when(kind == name, made)
    rows = cells.select(LEG, "n", "initiatives", F.explode(lines).alias("r")).select(LEG, "r.*", "n", "initiatives")
    summed = rows.groupBy(LEG, "report", "party", "fase", "rest").agg(F.sum("n").alias("n"), F.sum("initiatives").alias("initiatives"))

    def listed(report: str, **fields: str) -> Column:
        """The lines of a report as a sorted list; one without a type belongs to none."""
        mine = F.col("report") == report
        if report.startswith("activity"):
            mine &= F.col("rest").isNotNull()
        return F.sort_array(F.collect_list(F.when(mine, F.struct(*[F.col(c).alias(name) for name, c in fields.items()]))))

    def of(report: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("report") == report, F.col("n"))), F.lit(0))

    gathered = [
        listed("initiative", fase="fase", resultado="rest", vote_count="n", initiative_count="initiatives").alias("initiatives_by_fase"),
        listed("party", party="party", total_initiatives="n").alias("_parties"),
        listed("outcome", party="party", fase="fase", resultado="rest", count="n").alias("_outcomes"),
        listed("phase", fase="fase", vote_count="n").alias("votes_by_event_type"),
        listed("position", party="party", vote_type="rest", vote_count="n").alias("votes_by_party_and_type"),
        listed("activity", tipo="rest", count="n").alias("atividades_by_tipo"),
        listed("activity_vote", tipo="rest", vote_count="n").alias("atividades_votes_by_tipo"),
        F.struct(of("vote").alias("iniciativas"), of("activity_vote").alias("atividades"), (of("vote") + of("activity_vote")).alias("total"))
        .alias("vote_source_breakdown"),
    ]
    if legislatura is not None:  # has a record even if nothing is known of it
        whole = summed.agg(F.lit(legislature_code(legislatura)).alias(LEG), *gathered)
    else:
        whole = summed.groupBy(LEG).agg(*gathered)

    def own(p: Column) -> Column:
        mine = F.filter("_outcomes", lambda o: o["party"] == p["party"])
        return F.transform(mine, lambda o: F.struct(*[o[c].alias(c) for c in ("fase", "resultado", "count")]))

    parties = F.transform("_parties", lambda p: F.struct(p["party"].alias("party"), p["total_initiatives"].alias("total_initiatives"), own(p).alias("fase_outcomes")))
    return whole.select(
        LEG, "initiatives_by_fase", parties.alias("initiatives_by_party"), "votes_by_event_type", "votes_by_party_and_type", "atividades_by_tipo",
        "atividades_votes_by_tipo", "vote_source_breakdown",
    )
