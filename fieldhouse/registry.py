"""The registered queries of the statistics engine and their SQL. Modules under fieldhouse.plans.queries fill it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldhouse.fixtures import STATS_ORDER, League, with_views

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}
MODULES = ["scalars", "relational", "seasons", "loading", "landing", "playbyplay", "matching", "ranked", "quality", "views"]

#: SQL of the derived tables, for the queries' SQL.
DERIVED = {
    "d_sides": """
SELECT id, season_id, division_id, game_date, home_team_id AS team_id, away_team_id AS opponent_id, home_score AS goals_for, away_score AS goals_against, true AS is_home FROM fx_games WHERE status = 'final'
UNION ALL SELECT id, season_id, division_id, game_date, away_team_id, home_team_id, away_score, home_score, false FROM fx_games WHERE status = 'final'""",
    "d_record": """
SELECT season_id, team_id, CAST(sum(CASE WHEN goals_for > goals_against THEN 1 ELSE 0 END) AS BIGINT) AS wins, CAST(sum(CASE WHEN goals_for < goals_against THEN 1 ELSE 0 END) AS BIGINT) AS losses,
  CAST(sum(CASE WHEN goals_for = goals_against THEN 1 ELSE 0 END) AS BIGINT) AS ties, CAST(sum(goals_for) AS BIGINT) AS goals_for, CAST(sum(goals_against) AS BIGINT) AS goals_against
FROM d_sides GROUP BY season_id, team_id""",
    "d_stats": f"""
SELECT s.* EXCLUDE (place), CASE WHEN s.team_id = g.home_team_id THEN g.away_team_id WHEN s.team_id = g.away_team_id THEN g.home_team_id END AS opponent_id FROM (
  SELECT *, goals + assists AS points, row_number() OVER (PARTITION BY game_id, coalesce(CAST(player_id AS VARCHAR), team_id || '|' || coalesce(player_name, '')), position ORDER BY {", ".join(f"{c} NULLS FIRST" for c in STATS_ORDER)}) AS place
  FROM fx_player_game_stats) s LEFT JOIN fx_games g ON g.id = s.game_id WHERE place = 1""",
    "d_linked": """
SELECT player_id, season_id, division_id, team_id, game_id, jersey_number, CASE position WHEN 'ATT' THEN 'A' WHEN 'GK' THEN 'G' WHEN 'MID' THEN 'M' END AS code FROM d_stats WHERE player_id IS NOT NULL""",
    "d_pseasons": """
SELECT b.player_id, b.season_id, b.division_id, b.team_id, j.jersey_number, p.code AS primary_position
FROM (SELECT player_id, season_id, division_id, arg_min(team_id, game_id || '|' || team_id) AS team_id FROM d_linked GROUP BY ALL) b
JOIN (SELECT * FROM (SELECT player_id, season_id, division_id, jersey_number, row_number() OVER (PARTITION BY player_id, season_id, division_id ORDER BY count(*) DESC, jersey_number) r FROM d_linked GROUP BY player_id, season_id, division_id, jersey_number) WHERE r = 1) j USING (player_id, season_id, division_id)
JOIN (SELECT * FROM (SELECT player_id, season_id, division_id, code, row_number() OVER (PARTITION BY player_id, season_id, division_id ORDER BY count(*) DESC, code) r FROM d_linked GROUP BY player_id, season_id, division_id, code) WHERE r = 1) p USING (player_id, season_id, division_id)""",
    "d_latest": """
SELECT player_id, team_id, primary_position, jersey_number FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY season_id DESC, division_id DESC) r FROM d_pseasons) WHERE r = 1""",
    "d_tseasons": """
SELECT k.team_id, k.season_id, t.name AS team_name FROM (
  SELECT home_team_id AS team_id, season_id FROM fx_games UNION SELECT away_team_id, season_id FROM fx_games UNION SELECT team_id, season_id FROM d_stats) k LEFT JOIN fx_teams t ON t.id = k.team_id""",
    "d_pss": """
SELECT s.player_id, s.team_id, s.season_id, l.primary_position, max(s.division_id) AS division_id, max(p.name) AS player_name, count(DISTINCT game_id) AS games_played,
  CAST(sum(goals) AS BIGINT) AS goals, CAST(sum(assists) AS BIGINT) AS assists, CAST(sum(points) AS BIGINT) AS points, CAST(sum(shots) AS BIGINT) AS shots, CAST(sum(saves) AS BIGINT) AS saves, CAST(sum(goals_allowed) AS BIGINT) AS goals_allowed,
  CAST(sum(coalesce(goalie_minutes, 0)) AS BIGINT) AS goalie_minutes,
  CAST(round(CAST(sum(points) AS DECIMAL(20,8)) / nullif(count(DISTINCT game_id), 0), 2) AS DOUBLE) AS points_per_game,
  CAST(round(sum(goals) / nullif(sum(shots), 0) + 1e-12, 4) AS DOUBLE) AS shooting_pct
FROM d_stats s JOIN fx_players p ON p.id = s.player_id LEFT JOIN d_latest l ON l.player_id = s.player_id GROUP BY s.player_id, s.team_id, s.season_id, l.primary_position""",
    "d_tss": """
SELECT ts.team_id, ts.season_id, ts.team_name, coalesce(a.division_id, 1) AS division_id, coalesce(r.wins, 0) AS wins, coalesce(r.losses, 0) AS losses, coalesce(r.ties, 0) AS ties,
  coalesce(r.goals_for, 0) AS goals_for, coalesce(r.goals_against, 0) AS goals_against, coalesce(a.shots, 0) AS total_shots, coalesce(a.saves, 0) AS total_saves,
  round(coalesce(r.wins, 0) / nullif(coalesce(r.wins + r.losses + r.ties, 0), 0) + 1e-12, 4) AS win_pct, round(coalesce(a.goals, 0) / nullif(a.shots, 0) + 1e-12, 4) AS shooting_pct
FROM d_tseasons ts LEFT JOIN d_record r USING (team_id, season_id)
LEFT JOIN (SELECT team_id, season_id, max(division_id) AS division_id, CAST(sum(goals) AS BIGINT) AS goals, CAST(sum(shots) AS BIGINT) AS shots, CAST(sum(saves) AS BIGINT) AS saves FROM d_stats GROUP BY team_id, season_id) a USING (team_id, season_id)""",
}


def query(name: str, sql: str | None = None):
    """Registers a function of a League as query `name`, with the SQL that gives the same rows."""

    def register(f: Callable[[League], DataFrame]):
        _queries[name] = lambda spark, sf_dir: f(League(spark, sf_dir))
        if sql:
            _sql[name] = with_views(sql, DERIVED)
        return f

    return register


def _loaded() -> None:
    for module in MODULES:
        importlib.import_module(f"fieldhouse.plans.queries.{module}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _loaded()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _loaded()
    return dict(_sql)
