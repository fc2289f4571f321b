"""Season tables: records, totals, ratios, opponents, running records, strength of schedule.

Each function maps DataFrames to a DataFrame; nothing is updated in place. Ratios are decimal divisions rounded half up,
returned as doubles. A team's view of its games is one scan that makes two rows of each game.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOTALS = ["goals", "assists", "points", "shots", "shots_on_goal", "ground_balls", "turnovers", "caused_turnovers", "faceoff_wins", "faceoffs_taken"]


def ratio(top: Column, bottom: Column, places: int) -> Column:
    """top / bottom rounded half up; null where bottom is null or 0."""
    whole = "decimal(20,0)"
    return F.round(F.try_divide(top.cast(whole), F.nullif(bottom.cast(whole), F.lit(0).cast(whole))), places).cast("double")


def team_games(games: DataFrame, status: str | None = "final") -> DataFrame:
    """A row for each side of each game: team, opponent, own and other score."""
    rows = games if status is None else games.filter(F.col("status") == status)
    side = lambda own, other, home: F.struct(
        F.col(f"{own}_team_id").alias("team_id"), F.col(f"{other}_team_id").alias("opponent_id"), F.col(f"{own}_score").alias("goals_for"), F.col(f"{other}_score").alias("goals_against"), F.lit(home).alias("is_home")
    )
    kept = [F.col(c) for c in ("id", "season_id", "division_id", "game_date")]
    return rows.select(*kept, F.inline(F.array(side("home", "away", True), side("away", "home", False))))


def _won(c="goals_for", d="goals_against") -> tuple[Column, Column, Column]:
    a, b = F.col(c), F.col(d)
    one = lambda cond: F.when(cond, 1).otherwise(0)
    return one(a > b), one(a < b), one(a == b)


def team_record(games: DataFrame) -> DataFrame:
    w, l, t = _won()
    return team_games(games).groupBy("season_id", "team_id").agg(F.sum(w).alias("wins"), F.sum(l).alias("losses"), F.sum(t).alias("ties"), F.sum("goals_for").alias("goals_for"), F.sum("goals_against").alias("goals_against"))


def winner_loser(games: DataFrame) -> DataFrame:
    """Winning and losing team of final games; both null after a tie."""
    home, away, final = F.col("home_score"), F.col("away_score"), F.col("status") == "final"
    pick = lambda a, b: F.when(final & (home > away), F.col(a)).when(final & (home < away), F.col(b))
    return games.withColumns({"winning_team_id": pick("home_team_id", "away_team_id"), "losing_team_id": pick("away_team_id", "home_team_id")})


def running_record(games: DataFrame) -> DataFrame:
    """Wins and losses of each side up to and with each final game, both sides in one row of the game."""
    w, l, _ = _won()
    upto = Window.partitionBy("season_id", "team_id").orderBy("game_date", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = team_games(games).select("id", "is_home", F.sum(w).over(upto).alias("w"), F.sum(l).over(upto).alias("l"))
    of = lambda home, c: F.max(F.when(F.col("is_home") == home, F.col(c)))
    return rows.groupBy("id").agg(of(True, "w").alias("home_team_wins"), of(True, "l").alias("home_team_losses"), of(False, "w").alias("away_team_wins"), of(False, "l").alias("away_team_losses"))


def with_team_names(games: DataFrame, teams: DataFrame) -> DataFrame:
    named = lambda side: teams.select(F.col("id").alias(f"{side}_team_id"), F.col("name").alias(f"{side}_team_name"))
    return games.join(named("home"), "home_team_id", "left").join(named("away"), "away_team_id", "left")


def with_opponent(stats: DataFrame, games: DataFrame) -> DataFrame:
    """opponent_id of each player row: the other side; null if the team is on neither. A known opponent stays."""
    sides = games.select(F.col("id").alias("game_id"), "home_team_id", "away_team_id")
    other = F.when(F.col("team_id") == F.col("home_team_id"), F.col("away_team_id")).when(F.col("team_id") == F.col("away_team_id"), F.col("home_team_id"))
    value = F.coalesce(F.col("opponent_id"), other) if "opponent_id" in stats.columns else other
    return stats.join(sides, "game_id", "left").withColumn("opponent_id", value).drop("home_team_id", "away_team_id")


def most_frequent(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent non-empty value of each key; of equals the smallest."""
    counts = df.filter(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), value))[value].alias(value))


def player_seasons(stats: DataFrame) -> DataFrame:
    """Team, usual jersey and usual position of each linked player in each season; a transfer keeps the first team."""
    from fieldhouse.functions.scalars import normalize_position

    linked = stats.filter("player_id is not null").withColumn("position", normalize_position("position"))
    keys = ["player_id", "season_id", "division_id"]
    base = linked.groupBy(*keys).agg(F.min_by("team_id", F.struct("game_id", "team_id")).alias("team_id"))
    jersey, position = most_frequent(linked, keys, "jersey_number"), most_frequent(linked, keys, "position")
    joined = base.join(jersey, keys, "left").join(position.withColumnRenamed("position", "primary_position"), keys, "left")
    return joined.withColumn("jersey_number", F.coalesce("jersey_number", F.lit("0")))


def latest_by_player(seasons: DataFrame) -> DataFrame:
    """Each player's row of the latest season."""
    return seasons.groupBy("player_id").agg(F.max_by(F.struct("team_id", "primary_position", "jersey_number"), F.struct("season_id", "division_id")).alias("r")).select("player_id", "r.*")


def career_span(seasons: DataFrame) -> DataFrame:
    return seasons.groupBy("player_id").agg(F.countDistinct("season_id").alias("season_count"), F.min("season_id").alias("first_season"), F.max("season_id").alias("last_season"))


def player_season_stats(stats: DataFrame, players: DataFrame, seasons: DataFrame) -> DataFrame:
    latest = latest_by_player(seasons).select("player_id", "primary_position")
    joined = stats.join(players.select(F.col("id").alias("player_id"), F.col("name").alias("full_name")), "player_id").join(latest, "player_id", "left")
    sums = [F.sum(c).alias(c) for c in TOTALS] + [F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("minutes_played", "goalie_minutes")] + [F.sum(c).alias(c) for c in ("goals_allowed", "saves")]
    out = joined.groupBy("player_id", "team_id", "season_id", "primary_position").agg(F.max("division_id").alias("division_id"), F.max("full_name").alias("player_name"), F.countDistinct("game_id").alias("games_played"), *sums)
    return with_player_ratios(out)


def with_player_ratios(sums: DataFrame) -> DataFrame:
    return sums.withColumns(
        {
            "points_per_game": ratio(F.col("points"), F.col("games_played"), 2),
            "goals_per_game": ratio(F.col("goals"), F.col("games_played"), 2),
            "shooting_pct": ratio(F.col("goals"), F.col("shots"), 4),
            "faceoff_pct": ratio(F.col("faceoff_wins"), F.col("faceoffs_taken"), 4),
            "save_pct": ratio(F.col("saves"), F.col("saves") + F.col("goals_allowed"), 4),
        }
    )


def team_seasons(games: DataFrame, stats: DataFrame, teams: DataFrame) -> DataFrame:
    """Every (team, season) that plays at home, away, or has a player row, with the team's name."""
    parts = [games.select(F.col(f"{s}_team_id").alias("team_id"), "season_id") for s in ("home", "away")] + [stats.select("team_id", "season_id")]
    every = parts[0].union(parts[1]).union(parts[2]).filter("team_id is not null and season_id is not null").distinct()
    return every.join(teams.select(F.col("id").alias("team_id"), F.col("name").alias("team_name")), "team_id", "left")


def team_season_stats(seasons: DataFrame, games: DataFrame, stats: DataFrame) -> DataFrame:
    keys = ["team_id", "season_id"]
    counted = ["shots", "shots_on_goal", "ground_balls", "turnovers", "caused_turnovers", "faceoff_wins", "faceoffs_taken", "saves", "goals", "goals_allowed"]
    totals = stats.groupBy(*keys).agg(F.max("division_id").alias("division_id"), *[F.sum(c).alias(f"total_{c}") for c in counted])
    joined = seasons.join(team_record(games), keys, "left").join(totals, keys, "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ["wins", "losses", "ties", "goals_for", "goals_against", *[f"total_{c}" for c in counted]]}
    return with_team_ratios(joined.withColumns(zero | {"division_id": F.coalesce("division_id", F.lit(1))}))


def with_team_ratios(sums: DataFrame) -> DataFrame:
    played = F.col("wins") + F.col("losses") + F.col("ties")
    return sums.withColumns(
        {
            "games_played": played,
            "goal_diff": F.col("goals_for") - F.col("goals_against"),
            "win_pct": ratio(F.col("wins"), played, 4),
            "shooting_pct": ratio(F.col("total_goals"), F.col("total_shots"), 4),
            "faceoff_pct": ratio(F.col("total_faceoff_wins"), F.col("total_faceoffs_taken"), 4),
            "save_pct": ratio(F.col("total_saves"), F.col("total_saves") + F.col("total_goals_allowed"), 4),
        }
    ).drop("total_goals", "total_goals_allowed")


def owp_simple(games: DataFrame) -> DataFrame:
    """Opponents' and their opponents' mean win share, a term for each game, head-to-head games included."""
    rows = team_games(games).select("season_id", "team_id", "opponent_id")
    mean = lambda value, name: F.round(F.avg(F.col(value).cast("decimal(10,4)")), 4).cast("double").alias(name)
    win_pct = ratio(F.col("wins"), F.col("wins") + F.col("losses") + F.col("ties"), 4)
    share = team_record(games).select("season_id", F.col("team_id").alias("opponent_id"), win_pct.alias("win_pct"))
    owp = rows.join(share, ["season_id", "opponent_id"]).groupBy("season_id", "team_id").agg(mean("win_pct", "opp_win_pct"))
    theirs = owp.select("season_id", F.col("team_id").alias("opponent_id"), "opp_win_pct")
    oowp = rows.join(theirs, ["season_id", "opponent_id"]).groupBy("season_id", "team_id").agg(mean("opp_win_pct", "opp_opp_win_pct"))
    return owp.join(oowp, ["season_id", "team_id"], "left")


def enrich(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The whole enrichment: every derived table from games, player_game_stats, players and teams."""
    games, teams, players = tables["games"], tables["teams"], tables["players"]
    stats = with_opponent(tables["player_game_stats"], games)
    seasons = player_seasons(stats)
    full = with_team_names(winner_loser(games), teams).join(running_record(games), "id", "left")
    own = team_seasons(games, stats, teams)
    season_stats = team_season_stats(own, games, stats)
    return tables | {
        "games": full,
        "player_game_stats": stats,
        "player_seasons": seasons,
        "players": players.join(latest_by_player(seasons).withColumnRenamed("player_id", "id").drop("team_id"), "id", "left").join(career_span(seasons).withColumnRenamed("player_id", "id"), "id", "left"),
        "player_season_stats": player_season_stats(stats, players, seasons),
        "team_seasons": own,
        "team_season_stats": season_stats.join(owp_simple(games), ["season_id", "team_id"], "left"),
        "team_external_ids": teams.select(F.when(F.col("id").startswith("59"), "stats").otherwise("feed").alias("source"), F.col("id").alias("external_id"), F.col("id").alias("team_id")),
        "game_external_ids": games.filter("ncaa_game_id is not null and ncaa_game_id <> id").select(F.lit("feed").alias("source"), F.col("ncaa_game_id").alias("external_id"), F.col("id").alias("game_id")),
    }
