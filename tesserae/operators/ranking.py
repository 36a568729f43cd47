"""Eligibility, exact scores, competition ranks and peer cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.functions.reasons import reasons, status
from tesserae.functions.scalars import floor_to
from tesserae.operators.ordering import beside, numbered, repeated, sums_before
from tesserae.sources.stored import stored

#: Points for each whole unit of a discipline's final (static time in seconds, distances in metres).
INCREMENTS = {"sta": "0.2", "dynamic": "0.5", "depth": "1"}


def competition_rank(order: Column, *within: str) -> Column:
    """1, 1, 3: equals share the better rank."""
    window = W.partitionBy(*within).orderBy(order) if within else W.orderBy(order)
    return F.rank().over(window).cast("long")


def ranked(df: DataFrame, value: str, rank: str, within: tuple[str, ...] = (), descending: bool = True, order: tuple[str, ...] = (), position: str | None = None) -> DataFrame:
    """``df`` with the competition rank of a ``value`` inside ``within`` (the whole table if that is empty), and with ``position``, a
    display position whose ties ``order`` breaks. Null values come last and get no rank.

    Ranks come from counts: rows are counted by group and value, a value's rank is one more than the rows of better values, and is
    joined to the rows of that value. Positions come from ranges of the whole order. Neither passes a group through one task.
    """
    keys = list(within)
    turn = F.desc_nulls_last if descending else F.asc_nulls_last
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    steps = sums_before(counts, keys, turn(value), "__n", "__better").drop("__n")
    out = beside(df, steps, [*keys, value]).withColumn(rank, F.when(F.col(value).isNotNull(), (F.col("__better") + 1).cast("long"))).drop("__better")
    return numbered(out, keys, [turn(value), *order], position) if position else out


def global_rank(df: DataFrame, value: str, name: str, descending: bool = True) -> DataFrame:
    """Competition rank over a whole table without one task holding it; null values get no rank."""
    return ranked(df, value, name, descending=descending)


def scores(attempts: DataFrame) -> DataFrame:
    """``attempts`` (id, discipline, unit, value decimal, reviewed boolean, and whatever else) with reasons, ranked (whether there is
    none) and the score of the ranked. Repeated ids and scores are all that is asked of other rows; no row is shuffled with its columns."""
    increment = F.lit(None).cast("decimal(4,1)")
    for discipline, points in INCREMENTS.items():
        increment = F.when(F.col("discipline") == discipline, F.lit(points).cast("decimal(4,1)")).otherwise(increment)
    copies = repeated(attempts.select("id"), ["id"]).withColumn("repeated", F.lit(True))
    checked = beside(attempts, copies, ["id"]).withColumn("increment", increment)
    found = reasons(
        ("duplicate-id", F.col("repeated")),
        ("unknown-discipline", F.col("increment").isNull()),
        ("not-reviewed", ~F.coalesce("reviewed", F.lit(False))),
        ("missing-final", F.col("value").isNull()),
        ("final-not-positive", F.col("value") <= 0),
    )
    judged = checked.withColumn("reasons", found).withColumn("ranked", F.size("reasons") == 0)
    return judged.withColumn("score", F.when(F.col("ranked"), (F.floor("value") * F.col("increment")).cast("decimal(18,1)"))).drop("repeated", "increment")


def comparison_score(attempts: DataFrame) -> DataFrame:
    """Scores and ranks of attempts (id, discipline, unit, value decimal, reviewed boolean).

    The score is the final in whole units times the discipline's increment. The common rank is on scores; the rank within
    a discipline is on the exact final, and a discipline whose units are mixed has none (reason mixed-final-units). An
    attempt with a reason, and every copy of a repeated id, is withheld: no score, no rank.
    """
    scored = scores(attempts)
    # a row a discipline, written, so that attempts are not dealt by their discipline
    units = stored(scored.where("ranked").groupBy("discipline").agg((F.min("unit") != F.max("unit")).alias("mixed")), "units")
    scored = global_rank(scored, "score", "common_rank")
    eligible = F.when(F.col("ranked"), F.col("unit"))
    scored = scored.join(units, "discipline", "left").withColumn("mixed", F.coalesce("mixed", F.lit(False)) & eligible.isNotNull())
    scored = ranked(scored, "value", "best", ("discipline", "ranked"))
    return scored.withColumn("discipline_rank", F.when(F.col("ranked") & ~F.col("mixed"), F.col("best"))).withColumn(
        "reasons", F.when(F.col("mixed"), F.array_append("reasons", F.lit("mixed-final-units"))).otherwise(F.col("reasons"))
    ).drop("mixed", "best")


def attempt_comparison(rows: DataFrame, rules: list[tuple[str, Column]], filters: list[tuple[str, Column]], value: str, order: list[str], *within: str) -> DataFrame:
    """status (excluded, withheld, ranked), reasons, rank of the ranked and a display position.

    ``filters`` exclude and dominate; ``rules`` withhold. Equal values share a rank; the display order breaks ties by
    ``order``.
    """
    judged = rows.withColumn("reasons", reasons(*filters, *rules)).withColumn("status", status(F.col("reasons"), [name for name, _ in filters]))
    placed = ranked(judged, value, "rank", (*within, "status"), order=tuple(order), position="position")
    return placed.withColumns({c: F.when(F.col("status") == "ranked", F.col(c)) for c in ("rank", "position")})


def peer_ranks(rows: DataFrame, value: str, *cohort: str) -> DataFrame:
    """peer_rank and peers (the denominator) of each row within its cohort; null values neither rank nor count."""
    window = W.partitionBy(*cohort)
    known = F.col(value).isNotNull()
    return rows.withColumn("peer_rank", F.when(known, F.rank().over(window.orderBy(F.desc_nulls_last(value))).cast("long"))).withColumn("peers", F.count(value).over(window).cast("long"))


def peer_lists(rows: DataFrame, value: str, id_col: str, *cohort: str) -> DataFrame:
    """(cohort, place, peer, peer_rank, peers): the ordered list of each cohort's peers, one row a peer, by value descending, then id.
    Rows without a value are no peers. ``place`` counts from 1 without gaps; equal values share a peer_rank."""
    known = rows.where(F.col(value).isNotNull()).select(*cohort, F.col(id_col).alias("peer"), F.col(value).alias("__value"))
    placed = ranked(known, "__value", "peer_rank", cohort, order=("peer",), position="place")
    sizes = known.groupBy(*cohort).agg(F.count("*").alias("peers"))
    return beside(placed, sizes, list(cohort)).select(*cohort, "place", "peer", "peer_rank", "peers")


def hypothetical_rank(rows: DataFrame, questions: DataFrame, value: str, asked: str, *cohort: str) -> DataFrame:
    """hypothetical_rank of each asked value: one more than the rows of the cohort that are strictly better.

    The cohort's values are counted by value first, and the asked values take their places among those counts, so no row is
    paired with another.
    """
    keys = list(cohort)
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    asks = questions.select(*keys, F.col(asked).alias("__v")).distinct().withColumn("__n", F.lit(0).cast("long"))
    window = W.partitionBy(*keys).orderBy(F.desc("__v")).rangeBetween(W.unboundedPreceding, W.currentRow)
    steps = counts.unionByName(asks).groupBy(*keys, "__v").agg(F.sum("__n").alias("__n"))
    better = steps.select(*keys, "__v", (F.sum("__n").over(window) - F.col("__n") + 1).cast("long").alias("hypothetical_rank"))
    out = questions.withColumn("__v", F.col(asked)).join(better, [*keys, "__v"], "left").drop("__v")
    return out


def score_points(points: Column, increment: str) -> Column:
    """Points floored to a whole increment."""
    return floor_to(points, F.lit(increment).cast("decimal(6,2)"))


def scope_match(scope: Column, own_country: Column, country: Column, own_continent: Column, continent: Column) -> Column:
    """Whether a peer lies within a national, continental or international scope; an unknown place never does."""
    return F.coalesce(
        F.when(scope == "national", own_country == country).when(scope == "continental", own_continent == continent).when(scope == "international", F.lit(True)),
        F.lit(False),
    )


def sanction_level(listing: Column, sanction: Column) -> Column:
    """sanctioned, listed or none; being listed never implies a sanction."""
    return F.when(F.exists(sanction, lambda s: s["status"] == "sanctioned"), "sanctioned").when(F.size(listing) > 0, "listed").otherwise("none")
