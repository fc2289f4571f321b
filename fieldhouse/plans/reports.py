"""Read queries: one function for each view of the data, parameters as the reader gives them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldhouse.operators.enrich import team_record
from fieldhouse.operators.grid import box_score_order, is_goalie
from fieldhouse.operators.rankings import with_rank

Tables = dict[str, DataFrame]


def scoped(df: DataFrame, **equal) -> DataFrame:
    """Rows that equal the given values; parameters that are None do not filter."""
    for c, value in equal.items():
        if value is not None:
            df = df.filter(F.col(c) == value)
    return df


def games_for_season(games: DataFrame, season_id=None, division_id=None) -> DataFrame:
    return scoped(games, season_id=season_id, division_id=division_id).orderBy(F.desc("game_date"), "id")


def game_detail(games: DataFrame, game_id: str) -> DataFrame:
    return scoped(games, id=game_id)


def game_box_score(stats: DataFrame, game_id: str, mode: str = "points") -> DataFrame:
    return scoped(stats, game_id=game_id).withColumn("is_goalie", is_goalie()).orderBy("team_id", *box_score_order(mode), "player_id")


def game_plays(plays: DataFrame, types: DataFrame, game_id: str | None = None) -> DataFrame:
    return scoped(plays, game_id=game_id).join(types.select(F.col("code").alias("play_type"), F.col("name").alias("type_name"), "category"), "play_type", "left").orderBy("game_id", "play_sequence")


def player_leaderboard(season_stats: DataFrame, teams: DataFrame, season_id=None, division_id=None) -> DataFrame:
    named = teams.select(F.col("id").alias("team_id"), F.col("short_name").alias("team_short_name"), "slug")
    return scoped(season_stats, season_id=season_id, division_id=division_id).join(named, "team_id").orderBy(F.desc("points"), "player_id", "team_id")


def player_detail(players: DataFrame, player_id: int) -> DataFrame:
    return scoped(players, id=player_id)


def player_season_rows(season_stats: DataFrame, teams: DataFrame, player_id: int | None = None) -> DataFrame:
    return player_leaderboard(scoped(season_stats, player_id=player_id), teams).orderBy("player_id", F.desc("season_id"), "team_id")


def player_game_log(stats: DataFrame, games: DataFrame, teams: DataFrame, player_id: int | None = None) -> DataFrame:
    g = games.select(F.col("id").alias("game_id"), "game_date", "home_team_id", "away_team_id", "home_score", "away_score")
    named = lambda s: teams.select(F.col("id").alias(f"{s}_team_id"), F.col("short_name").alias(f"{s}_name"))
    rows = scoped(stats, player_id=player_id).filter("player_id is not null").drop("opponent_id").join(g, "game_id").join(named("home"), "home_team_id", "left").join(named("away"), "away_team_id", "left")
    opponent = F.when(F.col("team_id") == F.col("home_team_id"), F.col("away_name")).otherwise(F.col("home_name"))
    return rows.withColumn("opponent", opponent).orderBy("player_id", "game_date", "game_id")


def rankings(ranked: DataFrame, teams: DataFrame, season_id=None, division_id=None) -> DataFrame:
    named = teams.select(F.col("id").alias("team_id"), "name", "slug", F.col("division_id"))
    rows = scoped(ranked.drop("division_id").join(named, "team_id"), season_id=season_id, division_id=division_id)
    return with_rank(rows, ["season_id", "division_id"]).orderBy("season_id", "division_id", "rank")


def seasons(games: DataFrame, current_year: int | None = None) -> DataFrame:
    """The seasons played, newest first, from 1 February to 31 May, and which is the current one."""
    rows = games.select("season_id").distinct()
    year = F.col("season_id").cast("int")
    return rows.select("season_id", F.make_date(year, F.lit(2), F.lit(1)).alias("start_date"), F.make_date(year, F.lit(5), F.lit(31)).alias("end_date"), (year == F.lit(current_year)).alias("is_current") if current_year else F.lit(False).alias("is_current")).orderBy(F.desc("season_id"))


def resolve_season(rows: DataFrame, asked: str | None = None, division: int | None = None, fallback: str = "2025") -> DataFrame:
    """The season and division to show: as asked, else the current season, else the fallback; division 1 if not asked."""
    current = F.max(F.when(F.col("is_current"), F.col("season_id")))
    return rows.agg(F.coalesce(F.lit(asked), current, F.lit(fallback)).alias("season_id")).withColumn("division_id", F.lit(division if division is not None else 1))


def teams_for_season(teams: DataFrame, team_seasons: DataFrame, season_stats: DataFrame, season_id=None, division_id=None) -> DataFrame:
    rows = scoped(team_seasons, season_id=season_id).join(scoped(teams, division_id=division_id).select(F.col("id").alias("team_id"), "short_name", "slug", F.col("division_id")), "team_id")
    record = season_stats.select("team_id", "season_id", "wins", "losses")
    return rows.join(record, ["team_id", "season_id"], "left").withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("wins", "losses")}).orderBy("season_id", "team_name", "team_id")


def team_detail(teams: DataFrame, team_seasons: DataFrame, team_id: str, season_id: str) -> DataFrame:
    return scoped(team_seasons, team_id=team_id, season_id=season_id).drop("team_name").join(teams.withColumnRenamed("id", "team_id"), "team_id")


def resolve_team_id(teams: DataFrame, team_seasons: DataFrame, text: str, season_id: str) -> DataFrame:
    """The team that a slug, else an id, names among the season's teams; no row if neither does."""
    there = teams.join(scoped(team_seasons, season_id=season_id).select(F.col("team_id").alias("id")), "id", "left_semi")
    tier = F.when(F.col("slug") == text, 0).when(F.col("id") == text, 1)
    return there.withColumn("tier", tier).filter("tier is not null").orderBy("tier", "id").limit(1).select("id")


def team_schedule(games: DataFrame, teams: DataFrame, team_id: str, season_id: str | None = None) -> DataFrame:
    """A team's games from its own view. Of rows with one ncaa_game_id the smallest id stays; rows without one go."""
    first = Window.partitionBy("ncaa_game_id")
    rows = scoped(games.filter("ncaa_game_id is not null").withColumn("first_id", F.min("id").over(first)).filter("id = first_id"), season_id=season_id)
    own = rows.filter((F.col("home_team_id") == team_id) | (F.col("away_team_id") == team_id))
    return perspective(own, team_id).join(teams.select(F.col("id").alias("opponent_id"), F.col("short_name").alias("opponent")), "opponent_id", "left").orderBy("game_date", "id")


def perspective(games: DataFrame, team_id: str) -> DataFrame:
    home = F.col("home_team_id") == team_id
    own, other = F.when(home, F.col("home_score")).otherwise(F.col("away_score")), F.when(home, F.col("away_score")).otherwise(F.col("home_score"))
    result = F.when(own > other, "W").when(own < other, "L").when(own == other, "T")
    return games.select("id", "season_id", "game_date", F.when(home, F.col("away_team_id")).otherwise(F.col("home_team_id")).alias("opponent_id"), own.alias("own_score"), other.alias("opponent_score"), result.alias("result"), F.when(home, "vs").otherwise("@").alias("venue"))


def team_roster(player_seasons: DataFrame, players: DataFrame, team_id=None, season_id=None) -> DataFrame:
    named = players.select(F.col("id").alias("player_id"), "name", "hometown", "high_school")
    return scoped(player_seasons, team_id=team_id, season_id=season_id).join(named, "player_id").orderBy("team_id", "season_id", F.col("jersey_number").try_cast("int").asc_nulls_last(), "player_id")


def team_player_stats(season_stats: DataFrame, player_seasons: DataFrame, team_id=None, season_id=None) -> DataFrame:
    keys = ["player_id", "team_id", "season_id"]
    return scoped(season_stats, team_id=team_id, season_id=season_id).join(player_seasons.select(*keys, "jersey_number"), keys, "left").orderBy(F.desc("points"), *keys)


def team_stats(season_stats: DataFrame, team_id: str, season_id: str) -> DataFrame:
    return scoped(season_stats, team_id=team_id, season_id=season_id)


def search(players: DataFrame, teams: DataFrame, q: str, most: int = 10) -> DataFrame:
    """Players and teams whose name holds q (% and _ are wild), most of each; nothing for fewer than two characters."""
    text = q.strip()
    part = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), "name").dropDuplicates(["id"]).filter(F.lower("name").like(f"%{text.lower()}%")).orderBy("name", "id").limit(most)
    both = part(players, "player").unionByName(part(teams, "team"))
    return both if len(text) >= 2 else both.filter("false")


def recent_games(games: DataFrame, season_id: str, most: int = 30) -> DataFrame:
    return scoped(games, season_id=season_id, status="final").orderBy(F.desc("game_date"), "id").limit(most)


def top_scorers(season_stats: DataFrame, season_id: str, most: int = 50) -> DataFrame:
    return scoped(season_stats, season_id=season_id).orderBy(F.desc("points"), F.desc("goals"), "player_id", "team_id").limit(most)


def team_standings(games: DataFrame, teams: DataFrame, season_id: str | None = None) -> DataFrame:
    """Records with the place by wins, fewer losses, goal difference."""
    rows = scoped(team_record(games), season_id=season_id).join(teams.select(F.col("id").alias("team_id"), "short_name"), "team_id", "left")
    order = Window.partitionBy("season_id").orderBy(F.desc("wins"), "losses", F.desc(F.col("goals_for") - F.col("goals_against")), "team_id")
    return rows.withColumn("place", F.row_number().over(order))


def ad_hoc(spark: SparkSession, tables: Tables, sql: str) -> DataFrame:
    """Any SELECT over the named tables."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql)


def has_goalie_columns(season_stats: DataFrame) -> DataFrame:
    return season_stats.groupBy("player_id").agg((F.max("goalie_minutes") > 0).alias("has_goalie_columns"))
