"""Read queries."""

from pyspark.sql import functions as F

from fieldhouse.operators import rankings
from fieldhouse.plans import reports
from fieldhouse.plans.queries.ranked import rpi_sql
from fieldhouse.registry import query

_G = "id, season_id, game_date, home_team_id, away_team_id, home_score, away_score"
_g = _G.split(", ")


@query("v01_games_for_season", f"SELECT {_G} FROM fx_games WHERE season_id = '1996' AND division_id = 1 ORDER BY game_date DESC, id")
def _(t):
    return reports.games_for_season(t.games, "1996", 1).select(*_g)


@query("v02_game_detail", f"SELECT {_G} FROM fx_games WHERE id = '17'")
def _(t):
    return reports.game_detail(t.games, "17").select(*_g)


@query("v03_box_score", "SELECT player_id, team_id, position, jersey_number, points, coalesce(goalie_minutes, 0) > 0 AS is_goalie FROM d_stats WHERE game_id = '17' ORDER BY team_id, points DESC, player_id")
def _(t):
    return reports.game_box_score(t.stats, "17").select("player_id", "team_id", "position", "jersey_number", "points", "is_goalie")


@query("v04_game_plays", "SELECT play_type, 'x' || play_type AS type_name, count(*) AS n FROM (SELECT CASE WHEN home_event || away_event LIKE 'GOAL%' THEN 'goal' WHEN home_event || away_event LIKE 'Penalty%' THEN 'penalty' END AS play_type FROM fx_plays_raw) x WHERE play_type IS NOT NULL GROUP BY play_type")
def _(t):
    from fieldhouse.operators.pbp import canonical_plays

    plays = canonical_plays(t.plays).filter("play_type in ('goal', 'penalty')")
    types = plays.select(F.col("play_type").alias("code"), F.concat(F.lit("x"), "play_type").alias("name"), F.lit("c").alias("category")).distinct()
    return reports.game_plays(plays, types).groupBy("play_type", "type_name").agg(F.count("*").alias("n"))


_P = "player_id, team_id, season_id, points, games_played"
_p = _P.split(", ")


@query("v05_leaderboard", "SELECT s.player_id, s.team_id, s.season_id, s.points, s.games_played, t.slug FROM d_pss s JOIN fx_teams t ON t.id = s.team_id WHERE season_id = '1996' ORDER BY points DESC")
def _(t):
    return reports.player_leaderboard(t.player_season_stats, t.teams, "1996").select(*_p, "slug")


@query("v06_player_detail", "SELECT id, name, hometown FROM fx_players WHERE id = 305")
def _(t):
    return reports.player_detail(t.players, 305).select("id", "name", "hometown")


@query("v07_player_seasons", f"SELECT {_P} FROM d_pss WHERE player_id = 305")
def _(t):
    return reports.player_season_rows(t.player_season_stats, t.teams, 305).select(*_p)


@query("v08_game_log", "SELECT s.player_id, s.game_id, g.game_date, o.short_name AS opponent, s.points FROM d_stats s JOIN fx_games g ON g.id = s.game_id LEFT JOIN fx_teams o ON o.id = CASE WHEN s.team_id = g.home_team_id THEN g.away_team_id ELSE g.home_team_id END WHERE s.player_id = 305")
def _(t):
    return reports.player_game_log(t.stats, t.games, t.teams, 305).select("player_id", "game_id", "game_date", "opponent", "points")


@query("v09_rankings", f"WITH {rpi_sql('fx_games')} SELECT season_id, team_id, name, rpi, CAST(row_number() OVER (PARTITION BY season_id, division_id ORDER BY rpi DESC, team_id) AS INT) AS rank FROM rpi JOIN fx_teams t ON t.id = team_id")
def _(t):
    return reports.rankings(rankings.rpi(t.games), t.teams).select("season_id", "team_id", "name", "rpi", "rank")


@query("v10_seasons", "SELECT max(season_id) AS season_id, 1 AS division_id FROM fx_games")
def _(t):
    rows = reports.seasons(t.games)
    newest = rows.agg(F.max(F.col("season_id").cast("int")).alias("y"))
    marked = rows.crossJoin(F.broadcast(newest)).withColumn("is_current", F.col("season_id").cast("int") == F.col("y"))
    return reports.resolve_season(marked)


@query("v11_teams_for_season", "SELECT s.team_id, s.team_name, coalesce(r.wins, 0) AS wins, coalesce(r.losses, 0) AS losses FROM d_tseasons s JOIN fx_teams t ON t.id = s.team_id AND t.division_id = 2 LEFT JOIN d_tss r ON r.team_id = s.team_id AND r.season_id = s.season_id WHERE s.season_id = '1999'")
def _(t):
    return reports.teams_for_season(t.teams, t.team_seasons, t.team_season_stats, "1999", 2).select("team_id", "team_name", "wins", "losses")


@query("v12_team_detail", "SELECT id AS team_id, name, slug FROM fx_teams WHERE id = '9'")
def _(t):
    return reports.team_detail(t.teams, t.team_seasons, "9", "1996").select("team_id", "name", "slug")


@query("v13_resolve_team", "SELECT min(id) AS id FROM fx_teams WHERE slug = 'team-3'")
def _(t):
    return reports.resolve_team_id(t.teams, t.team_seasons, "team-3", "1996")


@query("v14_schedule", "SELECT id, game_date, CASE WHEN home_team_id = '9' THEN away_team_id ELSE home_team_id END AS opponent_id, CASE WHEN home_team_id = '9' THEN home_score ELSE away_score END AS own_score FROM fx_games g WHERE (home_team_id = '9' OR away_team_id = '9') AND id = (SELECT min(id) FROM fx_games x WHERE x.ncaa_game_id = g.ncaa_game_id)")
def _(t):
    return reports.team_schedule(t.games, t.teams, "9").select("id", "game_date", "opponent_id", "own_score")


@query("v15_roster", "SELECT s.player_id, p.name, s.jersey_number FROM d_pseasons s JOIN fx_players p ON p.id = s.player_id WHERE s.team_id = '9' AND s.season_id = '1996'")
def _(t):
    return reports.team_roster(t.player_seasons, t.players, "9", "1996").select("player_id", "name", "jersey_number")


@query("v16_team_players", "SELECT s.player_id, s.points, p.jersey_number FROM d_pss s LEFT JOIN d_pseasons p ON p.player_id = s.player_id AND p.team_id = s.team_id AND p.season_id = s.season_id WHERE s.team_id = '9' AND s.season_id = '1996'")
def _(t):
    return reports.team_player_stats(t.player_season_stats, t.player_seasons, "9", "1996").select("player_id", "points", "jersey_number")


@query("v17_team_stats", "SELECT team_id, season_id, wins, losses, win_pct FROM d_tss WHERE team_id = '9' AND season_id = '1996'")
def _(t):
    return reports.team_stats(t.team_season_stats, "9", "1996").select("team_id", "season_id", "wins", "losses", "win_pct")


@query("v18_search", "SELECT * FROM (SELECT 'player' AS kind, CAST(id AS VARCHAR) AS id, name FROM fx_players WHERE name ILIKE '%an%' ORDER BY name, CAST(id AS VARCHAR) LIMIT 10) a UNION ALL SELECT * FROM (SELECT 'team', id, name FROM fx_teams WHERE name ILIKE '%an%' ORDER BY name, id LIMIT 10) b")
def _(t):
    return reports.search(t.players, t.teams, " an ")


@query("v19_team_standings", "SELECT r.season_id, r.team_id, t.short_name, r.wins, r.losses, r.ties, r.goals_for, r.goals_against, CAST(row_number() OVER (PARTITION BY r.season_id ORDER BY wins DESC, losses, goals_for - goals_against DESC, r.team_id) AS INT) AS place FROM d_record r LEFT JOIN fx_teams t ON t.id = r.team_id")
def _(t):
    return reports.team_standings(t.games, t.teams)


@query("v19_recent_games", f"SELECT {_G} FROM fx_games WHERE season_id = '1996' AND status = 'final' ORDER BY game_date DESC, id LIMIT 30")
def _(t):
    return reports.recent_games(t.games, "1996").select(*_g)


@query("v19_top_scorers", f"SELECT {_P} FROM d_pss WHERE season_id = '1996' ORDER BY points DESC, goals DESC, player_id, team_id LIMIT 50")
def _(t):
    return reports.top_scorers(t.player_season_stats, "1996").select(*_p)


@query("v20_ad_hoc", "SELECT division_id, count(*) AS games, CAST(sum(home_score) AS BIGINT) AS home_goals FROM fx_games WHERE status = 'final' GROUP BY division_id")
def _(t):
    return reports.ad_hoc(t.spark, {"games": t.games}, "SELECT division_id, count(*) AS games, sum(home_score) AS home_goals FROM games WHERE status = 'final' GROUP BY division_id")


@query("v21_grid", "SELECT season_id, team_id, team_name, wins, losses FROM (SELECT season_id, team_id, team_name, wins, losses FROM d_tss WHERE contains(season_id, '199') AND wins >= 2 AND (contains(lower(team_name), 'team 1') OR contains(season_id, 'team 1') OR contains(team_id, 'team 1'))) x ORDER BY wins DESC, season_id, team_id, team_name, losses LIMIT 20 OFFSET 20")
def _(t):
    from fieldhouse.operators.grid import grid

    rows = t.team_season_stats.select("season_id", "team_id", "team_name", "wins", "losses")
    return grid(rows, search="Team 1", contains={"season_id": "199"}, minimum={"wins": 2, "losses": ""}, sort=[("wins", True)], page=1, size=20)


@query("v22_goalie_columns", "SELECT player_id, max(goalie_minutes) > 0 AS has_goalie_columns FROM d_pss GROUP BY player_id")
def _(t):
    return reports.has_goalie_columns(t.player_season_stats)


@query("j19_game_log_all", "SELECT s.player_id, count(*) AS games, count(o.id) AS opponents FROM d_stats s JOIN fx_games g ON g.id = s.game_id LEFT JOIN fx_teams o ON o.id = s.opponent_id WHERE s.player_id IS NOT NULL GROUP BY s.player_id")
def _(t):
    return reports.player_game_log(t.stats, t.games, t.teams).groupBy("player_id").agg(F.count("*").alias("games"), F.count("opponent").alias("opponents"))
