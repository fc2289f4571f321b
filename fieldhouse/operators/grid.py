"""The grid: search, filters, minima, sorting and pages over any DataFrame, and the box-score and play filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_of(df: DataFrame, c: str) -> Column:
    return F.lower(F.col(f"`{c}`").cast("string"))


def search_all(df: DataFrame, text: str) -> Column:
    """Any column holds the text, whatever its case."""
    return reduce(lambda a, b: a | b, [F.coalesce(text_of(df, c).contains(text.lower()), F.lit(False)) for c in df.columns])


def grid(df: DataFrame, search: str | None = None, contains: dict[str, str] | None = None, minimum: dict[str, float | str | None] | None = None, sort: list[tuple[str, bool]] | None = None, page: int = 0, size: int = 25, columns: list[str] | None = None) -> DataFrame:
    """One page. contains: text in a column; minimum: at least, a blank passes all and null counts as 0; sort: (column,
    descending). Rows beyond the sort columns are ordered by all columns, so pages are stable."""
    out = matching(df, search, contains, minimum)
    order = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in sort or []]
    out = out.orderBy(*order, *[F.col(c).asc_nulls_last() for c in df.columns])
    return (out.select(*columns) if columns else out).offset(page * size).limit(size)


def matching(df: DataFrame, search=None, contains=None, minimum=None) -> DataFrame:
    out = df
    if search:
        out = out.filter(search_all(df, search))
    for c, value in (contains or {}).items():
        if value:
            out = out.filter(text_of(df, c).contains(value.lower()))
    for c, value in (minimum or {}).items():
        if value not in (None, ""):
            out = out.filter(F.coalesce(F.col(c), F.lit(0)) >= float(value))
    return out


def grid_counts(df: DataFrame, **filters) -> DataFrame:
    """Rows that pass the filters, and all rows."""
    return matching(df, **filters).agg(F.count("*").alias("filtered")).crossJoin(df.agg(F.count("*").alias("total")))


def facets(df: DataFrame, column: str, most: int = 100) -> DataFrame:
    """The first distinct non-blank values of a column, sorted."""
    return df.select(F.col(column).cast("string").alias("value")).filter("value is not null and value <> ''").distinct().orderBy("value").limit(most)


COUNTED = ["goals", "assists", "shots", "shots_on_goal", "ground_balls", "turnovers", "caused_turnovers", "faceoffs_taken", "goals_allowed", "saves"]


def has_stats() -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c) != 0, F.lit(False)) for c in COUNTED])


def is_goalie() -> Column:
    return F.coalesce(F.col("position") == "G", F.lit(False)) | (F.coalesce("goalie_minutes", F.lit(0)) > 0)


def last_name(c: str) -> Column:
    return F.lower(F.element_at(F.split(F.trim(F.col(c)), r"\s+"), -1))


#: Sort keys of a box score by mode.
def box_score_order(mode: str) -> list[Column]:
    modes = {
        "points": [F.desc("points")],
        "name": [last_name("player_name").asc_nulls_last()],
        "jersey": [F.col("jersey_number").try_cast("int").asc_nulls_last()],
        "goalies": [F.coalesce("goalie_minutes", F.lit(0)).desc()],
    }
    return modes[mode]


def quarter_label(c: str = "quarter_number") -> Column:
    return F.when(F.col(c).between(1, 4), F.concat(F.lit("Q"), F.col(c).cast("string"))).otherwise("OT")


def plays_by(plays: DataFrame, quarter: str | None = None, category: str | None = None) -> DataFrame:
    """Plays of a quarter label and a category, whatever its case; plays without a category only without that filter."""
    out = plays if quarter is None else plays.filter(quarter_label() == quarter)
    return out if category is None else out.filter(F.lower("category") == category.lower())


def team_comparison(stats: DataFrame, games: DataFrame) -> DataFrame:
    """Home and away sums of seven counters and their share in percent, 50 each where both are 0."""
    counters = ["shots", "shots_on_goal", "ground_balls", "turnovers", "caused_turnovers", "faceoff_wins", "saves"]
    joined = stats.join(games.select(F.col("id").alias("game_id"), "home_team_id", "away_team_id"), "game_id")
    side = lambda s, c: F.sum(F.when(F.col("team_id") == F.col(f"{s}_team_id"), F.col(c)).otherwise(0)).alias(f"{s}_{c}")
    wide = joined.groupBy("game_id").agg(*[side(s, c) for c in counters for s in ("home", "away")])
    rows = F.array(*[F.struct(F.lit(c).alias("stat"), F.col(f"home_{c}").alias("home"), F.col(f"away_{c}").alias("away")) for c in counters])
    share = F.coalesce(F.try_divide(100.0 * F.col("home"), F.col("home") + F.col("away")), F.lit(50.0))
    return wide.select("game_id", F.inline(rows)).withColumn("home_share", F.round(share, 4)).withColumn("away_share", F.round(100 - share, 4))
