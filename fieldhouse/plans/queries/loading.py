"""Dedup, upsert and canonical loading over fixture rows."""

from pyspark.sql import functions as F

from fieldhouse.fixtures import STATS_ORDER
from fieldhouse.operators import enrich, load
from fieldhouse.registry import query


@query("u01_dedup_player_stats", "SELECT game_id, player_id, player_name, position, team_id, goals, assists FROM d_stats")
def _(t):
    return load.dedup_player_stats(t.raw_stats, STATS_ORDER).select("game_id", "player_id", "player_name", "position", "team_id", "goals", "assists")


@query("u02_dedup_plays", "SELECT game_id, seq % 7 AS play_sequence, min(seq) AS seq FROM fx_plays_raw GROUP BY 1, 2")
def _(t):
    plays = t.plays.select("game_id", (F.col("seq") % 7).alias("play_sequence"), "seq")  # numbers that several plays share
    return load.keep_first(plays, ["game_id", "play_sequence"], ["seq"])


@query("u03_dedup_player_seasons", "SELECT player_id, season_id, min(division_id) AS division_id FROM d_linked GROUP BY player_id, season_id")
def _(t):
    return load.keep_first(t.stats.filter("player_id is not null"), ["player_id", "season_id"], ["division_id", "game_id"]).select("player_id", "season_id", "division_id")


@query("u04_dedup_matchups", "SELECT home_team_id, away_team_id, game_date, min(id) AS id FROM fx_games GROUP BY ALL")
def _(t):
    return load.keep_first(t.games, ["home_team_id", "away_team_id", "game_date"], ["id"]).select("home_team_id", "away_team_id", "game_date", "id")


@query("u05_map_entries", "SELECT ncaa_game_id, min(id) AS id FROM fx_games WHERE ncaa_game_id IS NOT NULL GROUP BY ncaa_game_id UNION ALL SELECT id, id FROM fx_games WHERE ncaa_game_id IS NULL AND id NOT IN (SELECT ncaa_game_id FROM fx_games WHERE ncaa_game_id IS NOT NULL)")
def _(t):
    first = load.keep_first(t.games.filter("ncaa_game_id is not null"), ["ncaa_game_id"], ["id"]).select("ncaa_game_id", "id")
    more = t.games.filter("ncaa_game_id is null").select(F.col("id").alias("ncaa_game_id"), "id")
    return load.insert_absent(first, more, ["ncaa_game_id"])


_OLD = "SELECT id, ncaa_game_id, home_score, away_score, status FROM fx_games WHERE CAST(id AS BIGINT) % 3 <> 0"
_NEW = "SELECT id, CAST(NULL AS VARCHAR) AS ncaa_game_id, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN home_score + 1 END AS home_score, away_score, 'scheduled' AS status FROM fx_games WHERE CAST(id AS BIGINT) % 5 <> 0"


@query("u06_games_upsert", f"SELECT coalesce(n.id, o.id) AS id, coalesce(n.ncaa_game_id, o.ncaa_game_id) AS ncaa_game_id, coalesce(n.home_score, o.home_score) AS home_score, coalesce(n.away_score, o.away_score) AS away_score, CASE WHEN o.status = 'final' THEN 'final' ELSE coalesce(n.status, o.status) END AS status FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON n.id = o.id")
def _(t):
    number = F.col("id").cast("long")
    old = t.games.filter(number % 3 != 0).select("id", "ncaa_game_id", "home_score", "away_score", "status")
    new = t.games.filter(number % 5 != 0).select("id", F.lit(None).cast("string").alias("ncaa_game_id"), F.when(number % 2 == 0, F.col("home_score") + 1).alias("home_score"), "away_score", F.lit("scheduled").alias("status"))
    return load.upsert_games(old, new)


@query("u07_insert_absent", "SELECT id, name FROM fx_teams WHERE division_id = 1 UNION ALL SELECT id, short_name FROM fx_teams WHERE division_id <> 1")
def _(t):
    return load.insert_absent(t.teams.filter("division_id = 1").select("id", "name"), t.teams.select("id", F.col("short_name").alias("name")), ["id"])


@query("u08_players_upsert", "SELECT id, upper(name) AS name, hometown FROM fx_players WHERE id % 2 = 0 UNION ALL SELECT id, name, hometown FROM fx_players WHERE id % 2 = 1")
def _(t):
    rows = t.players.select("id", "name", "hometown")
    return load.upsert_players(rows, rows.filter("id % 2 = 0").select("id", F.upper("name").alias("name"), F.lit(None).cast("string").alias("hometown")))


@query("u09_teams_upsert", "SELECT id, CASE WHEN division_id = 2 THEN slug ELSE name END AS name FROM fx_teams")
def _(t):
    return load.upsert(t.teams.select("id", "name"), t.teams.filter("division_id = 2").select("id", F.col("slug").alias("name")), ["id"])


@query("u10_rankings_upsert", "SELECT season_id, team_id, CASE WHEN season_id = '1996' THEN wins + 1 ELSE wins END AS wins FROM d_record")
def _(t):
    rows = enrich.team_record(t.games).select("season_id", "team_id", "wins")
    return load.upsert(rows, rows.filter("season_id = '1996'").withColumn("wins", F.col("wins") + 1), ["season_id", "team_id"])


@query("u11_null_safe_upsert", "SELECT game_id, player_id, CAST(NULL AS VARCHAR) AS position, CAST(max(goals) AS INT) AS goals FROM d_stats WHERE player_id IS NOT NULL GROUP BY game_id, player_id")
def _(t):
    rows = t.stats.filter("player_id is not null").groupBy("game_id", "player_id").agg(F.min("goals").alias("low"), F.max("goals").alias("goals")).withColumn("position", F.lit(None).cast("string"))
    old = rows.select("game_id", "player_id", "position", F.col("low").alias("goals"))
    return load.upsert(old, rows.select(*old.columns), ["game_id", "player_id", "position"])


@query("u12_change_only", "SELECT id, short_name, slug FROM (SELECT id, CASE WHEN division_id = 3 THEN name ELSE short_name END AS short_name, slug, division_id FROM fx_teams) x WHERE division_id = 3")
def _(t):
    new = t.teams.select("id", F.when(F.col("division_id") == 3, F.col("name")).otherwise(F.col("short_name")).alias("short_name"), "slug")
    return load.changed(t.teams, new, ["id"], ["short_name", "slug"])


@query("u13_rescheduled", "SELECT id FROM fx_games g WHERE id = (SELECT min(id) FROM fx_games x WHERE x.ncaa_game_id = g.ncaa_game_id)")
def _(t):
    from pyspark.sql import Window

    return t.games.withColumn("m", F.min("id").over(Window.partitionBy("ncaa_game_id"))).filter("ncaa_game_id is not null and id = m").select("id")


@query("u14_players_extract", "SELECT s.player_id AS id, p.hometown FROM (SELECT DISTINCT player_id FROM d_stats WHERE player_id IS NOT NULL) s LEFT JOIN fx_players p ON p.id = s.player_id")
def _(t):
    rows = t.stats.filter("player_id is not null").select(F.col("player_id").alias("id"), F.lit("x").alias("name"), F.col("game_id").alias("path"), F.lit(0).alias("pos"))
    return load.players_extract(rows, t.players).select("id", "hometown")


@query("u15_info_over_schedule", "SELECT ncaa_game_id, max(id) AS id FROM fx_games WHERE ncaa_game_id IS NOT NULL GROUP BY ncaa_game_id")
def _(t):
    return load.keep_first(t.games.filter("ncaa_game_id is not null"), ["ncaa_game_id"], [F.desc("id")]).select("ncaa_game_id", "id")


@query("c08_game_rows", "SELECT f.ncaa_game_id, CASE ordinal % 11 WHEN 0 THEN NULL WHEN 1 THEN g.away_team_id ELSE g.home_team_id END AS home_team_id, CASE ordinal % 11 WHEN 1 THEN g.home_team_id ELSE g.away_team_id END AS away_team_id FROM (SELECT ncaa_game_id, min(ordinal) AS o FROM fx_feed GROUP BY ncaa_game_id) m JOIN fx_feed f ON f.ncaa_game_id = m.ncaa_game_id AND f.ordinal = m.o JOIN fx_games g ON CAST(g.id AS BIGINT) = f.ordinal")
def _(t):
    from fieldhouse.operators.names import resolve_teams

    feed = load.keep_first(t.feed, ["ncaa_game_id"], ["ordinal"])
    named = resolve_teams(feed.select(F.explode(F.array("home_team", "away_team")).alias("name")), t.teams)
    of = lambda s: named.select(F.col("name").alias(f"{s}_team"), F.col("team_id").alias(f"{s}_team_id"))
    return feed.join(of("home"), "home_team").join(of("away"), "away_team").select("ncaa_game_id", "home_team_id", "away_team_id")


@query("s16_failure_log", "SELECT id, 'old' AS error FROM fx_games WHERE season_id = '1996' UNION ALL SELECT id, 'new' FROM fx_games WHERE season_id = '1997'")
def _(t):
    old = t.games.filter("season_id = '1996'").select("id", F.lit("old").alias("error"))
    return load.append_unique(old, t.games.filter("season_id in ('1996', '1997')").select("id", F.lit("new").alias("error")), "id")


@query("s17_work_list", "SELECT id, CASE WHEN status = 'final' THEN 'files missing' ELSE 'info missing' END AS reason FROM fx_games WHERE CAST(id AS BIGINT) % 4 <> 0 AND CAST(id AS BIGINT) % 7 <> 0 AND game_date <= DATE '2001-03-01'")
def _(t):
    from fieldhouse.sources.documents import work_list

    number = F.col("id").cast("long")
    landed = t.games.filter(number % 4 == 0).select(F.col("id").alias("game_id"), F.explode(F.array(F.lit("info"), F.lit("plays"), F.lit("player_stats"))).alias("kind"))
    return work_list(t.games, landed, t.games.filter(number % 7 == 0).select("id"), "2001-03-01")


@query("s18_row_counts", "SELECT 'games' AS table_name, count(*) AS n FROM fx_games UNION ALL SELECT 'teams', count(*) FROM fx_teams UNION ALL SELECT 'plays', count(*) FROM fx_plays_raw")
def _(t):
    from fieldhouse.operators.quality import row_counts

    return row_counts({"games": t.games, "teams": t.teams, "plays": t.plays})


@query("s19_prior_rankings", "SELECT CAST(CAST(season_id AS INT) + 1 AS VARCHAR) AS season_id, team_id, win_pct AS rpi FROM d_tss WHERE win_pct IS NOT NULL AND win_pct <> 0")
def _(t):
    from fieldhouse.operators.rankings import prior_season

    return prior_season(t.team_season_stats.withColumn("rpi", F.col("win_pct")))
