"""Play-by-play: numbering, running scores, column swaps, stats rebuilt from texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldhouse.functions import plays as P
from fieldhouse.functions.scalars import parse_quarter, parse_score, time_to_seconds


def play_rows(raw: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """A row for each non-empty text of a raw play row, the home text first, with the columns `more`; artifact rows go."""
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    sides = F.array(F.struct(F.lit(0).alias("side"), text("home_event").alias("text")), F.struct(F.lit(1).alias("side"), text("away_event").alias("text")))
    return raw.filter(~P.is_artifact()).select("game_id", "seq", "quarter", "time", "score", *more, F.inline(F.filter(sides, lambda s: s["text"].isNotNull())))


def goals_by_column(raw: DataFrame) -> DataFrame:
    goal = lambda c: F.sum(F.col(c).contains("GOAL by").cast("int"))
    return raw.groupBy("game_id").agg(F.coalesce(goal("home_event"), F.lit(0)).alias("home_goals"), F.coalesce(goal("away_event"), F.lit(0)).alias("away_goals"))


def column_swap(raw: DataFrame, games: DataFrame) -> DataFrame:
    """(game_id, swapped): whether a game's columns fit its score better the other way round."""
    joined = goals_by_column(raw).join(games.select(F.col("id").alias("game_id"), "home_score", "away_score"), "game_id")
    fits = P.swapped(F.col("home_goals"), F.col("away_goals"), F.col("home_score"), F.col("away_score"))
    return joined.select("game_id", F.coalesce(fits, F.lit(False)).alias("swapped"))


def running_score(raw: DataFrame, away_first: bool = False) -> DataFrame:
    """Each play with the last score seen so far in its game."""
    one, two = parse_score("score")
    seen = F.when(one.isNotNull(), F.struct((two if away_first else one).alias("home"), (one if away_first else two).alias("away")))
    upto = Window.partitionBy("game_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(seen, ignorenulls=True).over(upto)
    return raw.withColumn("s", last).withColumns({"home_score": F.col("s.home"), "away_score": F.col("s.away")}).drop("s")


def canonical_plays(raw: DataFrame, away_first: bool = False) -> DataFrame:
    """Stored plays: type, clock, players and the number of the play among those kept in its game."""
    rows = play_rows(running_score(raw, away_first), ("home_score", "away_score")).drop("score")
    kind = P.classify(F.col("text"))
    kept = rows.withColumn("play_type", kind).filter(P.admitted(F.col("play_type"))).withColumn("play_type", P.stored_type(F.col("play_type")))
    number = F.row_number().over(Window.partitionBy("game_id").orderBy("seq", "side"))
    return kept.withColumns(
        {
            "play_sequence": number,
            "quarter_number": parse_quarter("quarter"),
            "time_remaining": time_to_seconds("time"),
            "player_name": P.primary_player(F.col("text")),
            "secondary_player_name": P.secondary_player(F.col("text")),
        }
    )


def sections(plays: DataFrame) -> DataFrame:
    """Runs of consecutive plays of one quarter: number, quarter, first and last play, plays."""
    w = Window.partitionBy("game_id").orderBy("seq")
    new = F.when(F.lag("quarter").over(w).eqNullSafe(F.col("quarter")) & (F.row_number().over(w) > 1), 0).otherwise(1)
    numbered = plays.withColumn("new", new).withColumn("section", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("game_id", "section").agg(F.first("quarter").alias("quarter"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("plays"))


def rebuild_stats(raw: DataFrame, games: DataFrame | None = None) -> DataFrame:
    """The ten counters of each (game, side, player) added up from play texts. In a text about a saved shot all of the
    saver's counts go to the other side. With games, sides are exchanged where the columns are swapped."""
    rows = play_rows(raw)
    if games is not None:
        rows = rows.join(column_swap(raw, games), "game_id", "left").withColumn("side", F.when(F.col("swapped"), 1 - F.col("side")).otherwise(F.col("side")))
    stats = P.event_stats(F.col("text"))
    savers = F.transform(F.filter("stats", lambda x: x["stat"] == "saves"), lambda x: x["player"])
    scorers = F.transform(F.filter("stats", lambda x: x["stat"] == "goals"), lambda x: x["player"])
    listed = rows.withColumn("stats", stats).select("game_id", "side", "text", savers.alias("savers"), scorers.alias("scorers"), F.inline("stats"))
    other = F.array_contains("savers", F.col("player")) & ~F.array_contains("scorers", F.col("player")) & F.col("text").contains("Shot by")
    listed = listed.withColumn("side", F.when(other, 1 - F.col("side")).otherwise(F.col("side")))
    return listed.groupBy("game_id", "side", "player").agg(*[F.sum(F.when(F.col("stat") == c, F.col("n")).otherwise(0)).alias(c) for c in P.COUNTERS])


def fill_missing(raw: DataFrame, games: DataFrame, with_stats: DataFrame, rosters: DataFrame) -> DataFrame:
    """Rebuilt player rows of games that have plays but no stats rows; players not on the team's roster go."""
    from fieldhouse.operators.names import match_players

    open_games = raw.join(with_stats.select("game_id").distinct(), "game_id", "left_anti")
    rebuilt = rebuild_stats(open_games, games).join(games.select(F.col("id").alias("game_id"), "home_team_id", "away_team_id", "season_id", "division_id"), "game_id")
    named = rebuilt.withColumn("team_id", F.when(F.col("side") == 0, F.col("home_team_id")).otherwise(F.col("away_team_id"))).withColumn("name", F.col("player"))
    return match_players(named, rosters).filter("player_id is not null").withColumn("points", F.col("goals") + F.col("assists")).drop("home_team_id", "away_team_id", "side", "player")
