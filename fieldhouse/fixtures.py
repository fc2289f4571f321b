"""League-shaped views over the plain tables, in SQL that Spark and DuckDB both accept, and the tables derived from them."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

#: The order in which repeated player rows are kept: all counters, so that the choice is a function of the rows.
STATS_ORDER = ["goals", "assists", "shots", "shots_on_goal", "ground_balls", "turnovers", "caused_turnovers", "faceoff_wins", "faceoffs_taken", "minutes_played", "goalie_minutes", "goals_allowed", "saves", "jersey_number"]
BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]

_FIRST, _LAST = "'Adam,Ben,Cole,Drew,Evan,Finn,Gabe,Hank'", "'Moore,Nolan,Price,Quinn,Reyes,Stone,Tully,Vance'"
_first = lambda n: f"split_part({_FIRST}, ',', CAST(1 + {n} % 8 AS INT))"
_last = lambda n, m: f"split_part({_LAST}, ',', CAST(1 + {n} % {m} AS INT))"

VIEWS = {
    "fx_teams": """
SELECT CAST(c_custkey AS STRING) AS id, concat('Team ', CAST(c_custkey AS STRING), ' ', c_mktsegment) AS name,
       concat('Team ', CAST(c_custkey AS STRING)) AS short_name,
       concat('team-', CAST(c_custkey - (CASE WHEN c_custkey % 6 = 5 THEN 1 ELSE 0 END) AS STRING)) AS slug,
       CAST(1 + c_custkey % 3 AS INT) AS division_id
FROM customer""",
    "fx_games": """
SELECT CAST(o_orderkey AS STRING) AS id,
       CASE WHEN o_orderkey % 10 = 0 THEN NULL
            ELSE CAST(o_orderkey - (CASE WHEN o_orderkey % 25 = 24 THEN 1 ELSE 0 END) AS STRING) END AS ncaa_game_id,
       CAST(year(o_orderdate) AS STRING) AS season_id, CAST(1 + o_custkey % 3 AS INT) AS division_id,
       CAST(o_orderdate AS DATE) AS game_date, CAST(o_custkey AS STRING) AS home_team_id,
       CAST((o_custkey + 3 * (1 + o_orderkey % 15)) % (SELECT max(c_custkey) + 1 FROM customer) AS STRING) AS away_team_id,
       CASE WHEN o_orderstatus = 'P' AND year(o_orderdate) >= 2000 THEN NULL
            ELSE CAST((o_orderkey * 7 + o_custkey * 13) % 21 AS INT) END AS home_score,
       CASE WHEN o_orderstatus = 'P' AND year(o_orderdate) >= 2000 THEN NULL
            ELSE CAST((o_orderkey * 11 + o_custkey * 5) % 21 AS INT) END AS away_score,
       CASE WHEN o_orderstatus = 'P' AND year(o_orderdate) >= 2000 THEN 'scheduled' ELSE 'final' END AS status
FROM orders""",
    "fx_player_game_stats": """
SELECT g.id AS game_id,
       CASE WHEN l_partkey % 40 = 0 THEN NULL
            ELSE CAST(CASE WHEN l_linenumber % 2 = 0 THEN g.away_team_id ELSE g.home_team_id END AS BIGINT) * 100 + l_suppkey % 30 END AS player_id,
       CASE WHEN l_partkey % 40 = 0 THEN concat('Unlinked ', CAST(l_suppkey % 7 AS STRING)) END AS player_name,
       CASE WHEN l_linenumber % 2 = 0 THEN g.away_team_id ELSE g.home_team_id END AS team_id, g.season_id, g.division_id,
       CAST(l_suppkey % 30 AS STRING) AS jersey_number,
       CASE l_returnflag WHEN 'A' THEN 'ATT' WHEN 'R' THEN 'GK' ELSE 'MID' END AS position,
       CASE WHEN l_returnflag = 'R' THEN 0 ELSE CAST(l_quantity AS INT) % 5 END AS goals,
       CASE WHEN l_returnflag = 'R' THEN 0 ELSE CAST(l_quantity AS INT) % 3 END AS assists,
       CASE WHEN l_returnflag = 'R' THEN 0 ELSE CAST(l_quantity AS INT) % 5 + l_linenumber END AS shots,
       CASE WHEN l_returnflag = 'R' THEN 0 ELSE CAST(l_quantity AS INT) % 5 + l_linenumber % 2 END AS shots_on_goal,
       CAST(l_partkey % 6 AS INT) AS ground_balls, CAST(l_partkey % 4 AS INT) AS turnovers, CAST(l_partkey % 3 AS INT) AS caused_turnovers,
       CASE WHEN l_linenumber = 3 THEN CAST(l_quantity AS INT) % 8 ELSE 0 END AS faceoff_wins,
       CASE WHEN l_linenumber = 3 THEN CAST(l_quantity AS INT) % 8 + 4 ELSE 0 END AS faceoffs_taken,
       CASE WHEN l_returnflag = 'R' THEN NULL ELSE CAST(l_quantity AS INT) * 60 END AS minutes_played,
       CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS INT) * 60 END AS goalie_minutes,
       CASE WHEN l_returnflag = 'R' THEN CAST(l_partkey % 9 AS INT) ELSE 0 END AS goals_allowed,
       CASE WHEN l_returnflag = 'R' THEN CAST(l_partkey % 11 AS INT) ELSE 0 END AS saves
FROM lineitem JOIN fx_games g ON g.id = CAST(l_orderkey AS STRING) AND g.status = 'final'""",
    "fx_plays_raw": f"""
SELECT CAST(event_id % 500 AS STRING) AS game_id, event_id AS seq,
       CASE WHEN event_id % 97 = 0 THEN 'OT' WHEN event_id % 89 = 0 THEN '2OT' ELSE CAST(1 + event_id % 4 AS STRING) END AS quarter,
       concat(lpad(CAST(event_id % 15 AS STRING), 2, '0'), ':', lpad(CAST(user_id % 60 AS STRING), 2, '0')) AS time,
       CASE WHEN event_id % 12 = 0 THEN concat(CAST(event_id % 9 AS STRING), '-', CAST(user_id % 9 AS STRING)) ELSE '' END AS score,
       CASE WHEN user_id % 2 = 0 THEN txt ELSE '' END AS home_event, CASE WHEN user_id % 2 = 1 THEN txt ELSE '' END AS away_event
FROM (SELECT e.*, CASE CAST(event_id % 12 AS INT)
  WHEN 0 THEN concat('GOAL by ABC ', p1, ' (FIRST GOAL), goal number 3 for season.')
  WHEN 1 THEN concat('GOAL by ABC ', p1r, ', Assist by ', p2r, '.')
  WHEN 2 THEN concat('Shot by ABC ', p1, ' WIDE.')
  WHEN 3 THEN concat('Shot by ABC ', p1r, ', SAVE ', p2)
  WHEN 4 THEN concat('Ground ball pickup by ABC ', p1r, '.')
  WHEN 5 THEN concat('Turnover by ABC ', p1, '.')
  WHEN 6 THEN concat('Turnover by ABC ', p1r, ' (caused by ', p2, ').')
  WHEN 7 THEN concat('Faceoff ', p1r, ' vs ', p2, ' won by ABC.')
  WHEN 8 THEN concat('Penalty on ABC ', p1, ' (SLASHING/1:00) Extra-man opportunity.')
  WHEN 9 THEN 'Clear attempt by ABC good.'
  WHEN 10 THEN 'Media timeout.'
  ELSE '0' END AS txt
  FROM (SELECT events.*, concat({_first("user_id")}, ' ', {_last("user_id", 7)}) AS p1, concat({_last("user_id", 7)}, ', ', {_first("user_id")}) AS p1r,
     concat({_first("event_id")}, ' ', {_last("event_id", 5)}) AS p2, concat({_last("event_id", 5)}, ', ', {_first("event_id")}) AS p2r
   FROM events) e) x""",
    # a second feed of the same games with school names instead of ids: some the other way round, some spelled so that only
    # words are shared, some of teams that nobody knows; and a roster and a player table
    "fx_feed": """
SELECT g.ncaa_game_id, g.game_date, CASE CAST(CAST(g.id AS BIGINT) % 11 AS INT) WHEN 0 THEN 'Elsewhere' WHEN 1 THEN a.short_name WHEN 2 THEN concat('Team U ', h.id) ELSE upper(h.short_name) END AS home_team,
       CASE CAST(CAST(g.id AS BIGINT) % 11 AS INT) WHEN 1 THEN concat(h.short_name, '.') WHEN 3 THEN concat('Team of ', a.id) ELSE concat(a.short_name, ' Lancers') END AS away_team, CAST(g.id AS BIGINT) AS ordinal
FROM fx_games g JOIN fx_teams h ON h.id = g.home_team_id JOIN fx_teams a ON a.id = g.away_team_id WHERE g.ncaa_game_id IS NOT NULL""",
    "fx_players": f"""
SELECT CAST(t.id AS BIGINT) * 100 + s.n AS id, concat({_first("s.n")}, ' ', {_last("(s.n + CAST(t.id AS BIGINT))", 8)}) AS name, t.division_id, t.id AS team_id,
       CASE WHEN s.n % 3 = 0 THEN NULL ELSE concat('Town ', CAST(s.n AS STRING)) END AS hometown, CAST(NULL AS STRING) AS high_school
FROM fx_teams t CROSS JOIN (SELECT DISTINCT s_suppkey % 30 AS n FROM supplier) s WHERE s.n <> 29""",
}


def with_views(sql: str, more: dict[str, str] | None = None) -> str:
    """sql with the views that it names, and those that they name, put before it as common table expressions."""
    known = VIEWS | (more or {})
    found: list[str] = []

    def visit(text: str) -> None:
        for name in known:
            if re.search(rf"\b{name}\b", text) and name not in found:
                visit(known[name])
                if name not in found:
                    found.append(name)

    visit(sql)
    if not found:
        return sql
    heads = ",\n".join(f"{n} AS ({known[n]})" for n in found)
    rest = re.sub(r"^\s*WITH\s+", ", ", sql, count=1) if re.match(r"\s*WITH\b", sql) else "\n" + sql
    return f"WITH {heads}{rest}"


class League:
    """The fixture views and derived tables of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        for name in BASE:
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(with_views(text))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def teams(self) -> DataFrame:
        return self.sql("SELECT * FROM fx_teams")

    @cached_property
    def games(self) -> DataFrame:
        return self.sql("SELECT * FROM fx_games")

    @cached_property
    def raw_stats(self) -> DataFrame:
        return self.sql("SELECT * FROM fx_player_game_stats")

    @cached_property
    def plays(self) -> DataFrame:
        return self.sql("SELECT * FROM fx_plays_raw")

    @cached_property
    def feed(self) -> DataFrame:
        return self.sql("SELECT * FROM fx_feed")

    @cached_property
    def players(self) -> DataFrame:
        return self.sql("SELECT * FROM fx_players")

    @cached_property
    def stats(self) -> DataFrame:
        """Player game stats after dedup, with points and the opponent."""
        from fieldhouse.operators import enrich, load

        return enrich.with_opponent(load.dedup_player_stats(self.raw_stats.withColumn("points", self.raw_stats["goals"] + self.raw_stats["assists"]), STATS_ORDER), self.games)

    @cached_property
    def player_seasons(self) -> DataFrame:
        from fieldhouse.operators import enrich

        return enrich.player_seasons(self.stats)

    @cached_property
    def team_seasons(self) -> DataFrame:
        from fieldhouse.operators import enrich

        return enrich.team_seasons(self.games, self.stats, self.teams)

    @cached_property
    def player_season_stats(self) -> DataFrame:
        from fieldhouse.operators import enrich

        return enrich.player_season_stats(self.stats, self.players, self.player_seasons)

    @cached_property
    def team_season_stats(self) -> DataFrame:
        from fieldhouse.operators import enrich

        return enrich.team_season_stats(self.team_seasons, self.games, self.stats)

    @cached_property
    def rankings(self) -> DataFrame:
        from fieldhouse.operators import rankings

        return rankings.rpi(self.games)
