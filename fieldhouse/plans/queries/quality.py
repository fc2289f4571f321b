"""Data quality checks over fixture tables."""

from pyspark.sql import functions as F

from fieldhouse.operators import quality
from fieldhouse.registry import query

_VALID = """
WITH s AS (SELECT game_id, CASE WHEN team_id = (SELECT home_team_id FROM fx_games g WHERE g.id = game_id) THEN 'home' ELSE 'away' END AS side, goals, coalesce(player_name, 'x') AS name, position = 'GK' AS is_goalie FROM d_stats),
b AS (SELECT game_id, sum(CASE WHEN side = 'home' AND NOT is_goalie THEN goals ELSE 0 END) AS hg, sum(CASE WHEN side = 'away' AND NOT is_goalie THEN goals ELSE 0 END) AS ag FROM s GROUP BY game_id),
p AS (SELECT game_id, arg_max(score, seq) AS last_score FROM fx_plays_raw WHERE score NOT IN ('', '0') GROUP BY game_id),
x AS (SELECT g.*, b.hg, b.ag, p.last_score, row_number() OVER (PARTITION BY game_date, home_team_id, away_team_id ORDER BY g.id) AS place FROM fx_games g LEFT JOIN b ON b.game_id = g.id LEFT JOIN p ON p.game_id = g.id)
SELECT id, concat_ws(',', CASE WHEN home_score <> hg THEN 'home score mismatch' END, CASE WHEN away_score <> ag THEN 'away score mismatch' END) AS errors,
  concat_ws(',', CASE WHEN month(game_date) > 6 THEN 'date outside season' END, CASE WHEN place > 1 THEN 'duplicate game' END,
  CASE WHEN home_score IS NOT NULL AND (CAST(split_part(last_score, '-', 1) AS INT) <> away_score OR CAST(split_part(last_score, '-', 2) AS INT) <> home_score) THEN 'play score mismatch' END) AS warnings FROM x"""


def _validated(t):
    games = t.games.withColumns({"home_name": F.col("home_team_id"), "away_name": F.col("away_team_id")})
    sides = t.stats.join(t.games.select(F.col("id").alias("game_id"), "home_team_id"), "game_id").select("game_id", F.when(F.col("team_id") == F.col("home_team_id"), "home").otherwise("away").alias("side"), "goals", F.coalesce("player_name", F.lit("x")).alias("name"), (F.col("position") == "GK").alias("is_goalie"))
    return quality.validate(games, sides, t.plays)


@query("q01_validate", _VALID)
def _(t):
    return _validated(t).select("id", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"))


@query("q02_load_gate", f"SELECT errors = '' AS loadable, count(*) AS games FROM ({_VALID}) v GROUP BY 1")
def _(t):
    good, blocked = quality.gate(_validated(t))
    return good.agg(F.count("*").alias("games")).withColumn("loadable", F.lit(True)).unionByName(blocked.agg(F.count("*").alias("games")).withColumn("loadable", F.lit(False)))


_ASSESS = """
SELECT g.id AS game_id, CASE WHEN CAST(g.id AS BIGINT) % 6 = 0 THEN 'MISSING_FILE' WHEN coalesce(hg, 0) <> g.home_score OR coalesce(ag, 0) <> g.away_score THEN 'GOAL_MISMATCH' ELSE 'OK' END AS status, g.home_score, g.away_score, coalesce(hg, 0) AS hg, coalesce(ag, 0) AS ag, CAST(g.id AS BIGINT) % 2 = 0 AS has_pbp
FROM fx_games g LEFT JOIN (SELECT s.game_id, CAST(sum(CASE WHEN s.team_id = x.home_team_id THEN goals END) AS BIGINT) AS hg, CAST(sum(CASE WHEN s.team_id = x.away_team_id THEN goals END) AS BIGINT) AS ag FROM d_stats s JOIN fx_games x ON x.id = s.game_id GROUP BY s.game_id) b ON b.game_id = g.id WHERE g.status = 'final'"""


def _files(t):
    number = F.col("id").cast("long")
    kinds = F.array_compact(F.array(F.when(number % 6 != 0, "stats"), F.when(number % 2 == 0, "plays")))
    return t.games.select(F.col("id").alias("game_id"), F.explode(kinds).alias("kind"))


def _assessed(t):
    return quality.assess(t.games, t.stats, _files(t), t.plays)


@query("q03_assess", f"SELECT game_id, status, has_pbp FROM ({_ASSESS}) a")
def _(t):
    return _assessed(t).select("game_id", "status", "has_pbp")


@query("q04_report", f"SELECT game_id, status, CASE WHEN status = 'MISSING_FILE' THEN '-' || CAST(home_score + away_score AS VARCHAR) WHEN ag = away_score THEN printf('%+d home', CAST(hg - home_score AS INT)) WHEN hg = home_score THEN printf('%+d away', CAST(ag - away_score AS INT)) ELSE printf('%+dh', CAST(hg - home_score AS INT)) || ',' || printf('%+da', CAST(ag - away_score AS INT)) END AS delta FROM ({_ASSESS}) a WHERE status <> 'OK'")
def _(t):
    return quality.report(_assessed(t)).select("game_id", "status", "delta")


@query("a19_status_counts", f"SELECT status, count(*) AS games, CAST(sum(CASE WHEN has_pbp AND status <> 'OK' THEN 1 ELSE 0 END) AS BIGINT) AS recoverable FROM ({_ASSESS}) a GROUP BY status")
def _(t):
    return quality.counts(_assessed(t))


@query("q05_plays_without_stats", "SELECT id AS game_id FROM fx_games WHERE CAST(id AS BIGINT) % 6 = 0")
def _(t):
    return quality.plays_without_stats(_files(t))


def _compared(t):
    of = lambda df: df.groupBy("game_id").agg(F.count("*").alias("players"), F.sum("goals").alias("goals")).withColumn("fields", F.when(F.col("goals") > 0, F.array(F.lit("goals"), F.lit("name"))).otherwise(F.array(F.lit("name"))))
    mapped = t.games.select(F.col("id").alias("a_id"), F.col("id").alias("b_id"))
    return quality.compare_sources(mapped, of(t.raw_stats), of(t.stats.filter("goals > 0")))


_PAIRS = "SELECT g.id, a.goals AS a_goals, b.goals AS b_goals, a.n AS a_n, b.n AS b_n FROM fx_games g LEFT JOIN (SELECT game_id, sum(goals) AS goals, count(*) AS n FROM fx_player_game_stats GROUP BY game_id) a ON a.game_id = g.id LEFT JOIN (SELECT game_id, sum(goals) AS goals, count(*) AS n FROM d_stats WHERE goals > 0 GROUP BY game_id) b ON b.game_id = g.id"


@query("q06_compare_sources", f"SELECT id AS game_id, a_n IS NOT NULL AS has_a, b_n IS NOT NULL AS has_b, a_goals = b_goals AS goals_agree FROM ({_PAIRS}) x")
def _(t):
    return _compared(t).select(F.col("a_id").alias("game_id"), "has_a", "has_b", "goals_agree")


@query("a17_coverage", f"SELECT count(*) AS pairs, count(a_n) AS with_a, count(b_n) AS with_b, round(avg(a_n), 4) AS a_players, round(avg(b_n), 4) AS b_players, round(100.0 * avg(CASE WHEN a_goals = b_goals THEN 1 WHEN a_goals <> b_goals THEN 0 END), 2) AS agree_pct, 'goals,name' AS both_fields, '' AS only_a, '' AS only_b FROM ({_PAIRS}) x")
def _(t):
    return quality.coverage(_compared(t))


@query("a18_roster_coverage", """
SELECT b.*, coalesce(u.n, 0) AS unresolved_names, coalesce(u.listed, '') AS listed FROM (SELECT team_id, count(DISTINCT game_id) AS games, count(*) AS entries, count(player_id) AS resolved FROM d_stats GROUP BY team_id) b
LEFT JOIN (SELECT team_id, CAST(count(*) AS INT) AS n, string_agg(player_name || '#' || jersey_number || ':' || ids, ';' ORDER BY player_name, jersey_number) AS listed
  FROM (SELECT team_id, player_name, jersey_number, string_agg(DISTINCT game_id, ',' ORDER BY game_id) AS ids FROM d_stats WHERE player_id IS NULL GROUP BY ALL) x GROUP BY team_id) u ON u.team_id = b.team_id""")
def _(t):
    told = F.array_join(F.transform("unresolved", lambda x: F.concat(x["name"], F.lit("#"), x["jersey"], F.lit(":"), F.array_join(x["game_ids"], ","))), ";")
    return quality.roster_coverage(t.stats).select("team_id", "games", "entries", "resolved", "unresolved_names", F.coalesce(told, F.lit("")).alias("listed"))


@query("q07_duplicate_matchups", "SELECT season_id, home_team_id, away_team_id, game_date, count(*) AS n FROM fx_games GROUP BY ALL HAVING count(*) > 1")
def _(t):
    return quality.duplicate_matchups(t.games)


@query("q08_season_has_teams", "SELECT season_id, count(*) AS teams FROM d_tseasons GROUP BY season_id")
def _(t):
    return t.team_seasons.groupBy("season_id").agg(F.count("*").alias("teams"))


@query("q09_teams_without_games", "SELECT t.id AS team_id, s.season_id FROM fx_teams t CROSS JOIN (SELECT DISTINCT season_id FROM fx_games) s WHERE NOT EXISTS (SELECT 1 FROM fx_games g WHERE g.season_id = s.season_id AND (g.home_team_id = t.id OR g.away_team_id = t.id))")
def _(t):
    every = t.teams.select(F.col("id").alias("team_id")).crossJoin(F.broadcast(t.games.select("season_id").distinct()))
    return quality.teams_without_games(every, t.games)


@query("q10_teams_without_stats_row", "SELECT team_id, season_id FROM d_tseasons EXCEPT SELECT team_id, season_id FROM d_record")
def _(t):
    from fieldhouse.operators.enrich import team_record

    return quality.without(t.team_seasons, team_record(t.games), ["team_id", "season_id"])


@query("q11_orphan_home_teams", "SELECT DISTINCT home_team_id AS team_id, season_id FROM fx_games WHERE home_team_id NOT IN (SELECT id FROM fx_teams WHERE division_id < 3)")
def _(t):
    known = t.team_seasons.join(t.teams.filter("division_id < 3").select(F.col("id").alias("team_id")), "team_id", "left_semi")
    return quality.orphan_home_teams(t.games, known)


@query("q12_finals_without_stats", "SELECT team_id, season_id, count(*) AS finals FROM d_sides d WHERE NOT EXISTS (SELECT 1 FROM d_stats s WHERE s.team_id = d.team_id AND s.season_id = d.season_id AND s.goals > 3) GROUP BY ALL")
def _(t):
    return quality.teams_without_stats(t.games, t.stats.filter("goals > 3"))


@query("q13_linked_without_seasons", "SELECT DISTINCT team_id, season_id, 'season stats' AS lacks FROM d_linked l WHERE NOT EXISTS (SELECT 1 FROM d_pss p WHERE p.team_id = l.team_id AND p.season_id = l.season_id) UNION ALL SELECT DISTINCT team_id, season_id, 'player seasons' FROM d_linked l WHERE NOT EXISTS (SELECT 1 FROM d_pseasons p WHERE p.team_id = l.team_id AND p.season_id = l.season_id)")
def _(t):
    return quality.linked_without_seasons(t.stats, t.player_season_stats, t.player_seasons)


@query("q14_rankings_exist", "SELECT season_id, count(DISTINCT team_id) AS ranked FROM d_sides GROUP BY season_id")
def _(t):
    from fieldhouse.operators.rankings import rpi

    return rpi(t.games).groupBy("season_id").agg(F.count("*").alias("ranked"))


@query("q15_stray_teams", "SELECT game_id, count(*) AS n FROM (SELECT s.game_id FROM fx_player_game_stats s JOIN fx_games g ON g.id = s.game_id WHERE s.team_id NOT IN (g.home_team_id, '0')) x GROUP BY game_id")
def _(t):
    games = t.games.withColumn("away_team_id", F.lit("0"))
    return quality.stray_teams(t.raw_stats, games).groupBy("game_id").agg(F.count("*").alias("n"))


@query("q16_registers", "SELECT id FROM fx_games WHERE status = 'scheduled' AND CAST(id AS BIGINT) % 2 = 1")
def _(t):
    failed = t.games.filter(F.col("id").cast("long") % 2 == 0).select("id")
    return t.games.filter("status = 'scheduled'").select("id").join(failed, "id", "left_anti")


def _integrity_sql(games: str, seasons: str, totals: str, stats: str, player_totals: str, player_seasons: str) -> str:
    """Violations of each check over these relations, each counted by itself."""
    sides = f"(SELECT season_id, home_team_id AS team_id, status, id FROM {games} UNION ALL SELECT season_id, away_team_id, status, id FROM {games})"
    teams = lambda rel, test="true": f"(SELECT DISTINCT team_id, season_id FROM {rel} WHERE {test})"
    count = lambda left, right: f"(SELECT count(*) FROM {left} l WHERE NOT EXISTS (SELECT 1 FROM {right} r WHERE r.team_id = l.team_id AND r.season_id = l.season_id))"
    linked = teams(stats, "player_id IS NOT NULL")
    checks = {
        "duplicate matchups": f"(SELECT count(*) FROM (SELECT 1 FROM {games} GROUP BY season_id, home_team_id, away_team_id, game_date HAVING count(*) > 1) x)",
        "teams without games": count(teams(seasons), teams(sides)),
        "teams without season stats": count(teams(seasons), teams(totals)),
        "orphan home teams": count(f"(SELECT DISTINCT home_team_id AS team_id, season_id FROM {games})", teams(seasons)),
        "finals without player rows": count(teams(sides, "status = 'final'"), teams(stats)),
        "linked rows without seasons": f"{count(linked, teams(player_totals))} + {count(linked, teams(player_seasons))}",
        "stray teams": f"(SELECT count(*) FROM {stats} s JOIN {games} g ON g.id = s.game_id WHERE s.team_id <> g.home_team_id AND s.team_id <> g.away_team_id)",
    }
    return " UNION ALL ".join(f"SELECT '{n}' AS check_name, {x} AS violations" for n, x in checks.items())


def _tables(t) -> dict:
    return {"games": t.games, "team_seasons": t.team_seasons, "team_season_stats": t.team_season_stats, "player_game_stats": t.stats, "player_season_stats": t.player_season_stats, "player_seasons": t.player_seasons}


@query("q_integrity", _integrity_sql("fx_games", "d_tseasons", "d_tss", "d_stats", "d_pss", "d_pseasons"))
def _(t):
    return quality.integrity(_tables(t))


@query("q_integrity_violated", "WITH broken_games AS (SELECT id, season_id, home_team_id, CASE WHEN division_id = 2 THEN '0' ELSE away_team_id END AS away_team_id, game_date, status FROM fx_games), broken_seasons AS (SELECT team_id, season_id FROM d_tseasons WHERE team_id IN (SELECT id FROM fx_teams WHERE division_id < 3) UNION SELECT id, '2000' FROM fx_teams WHERE division_id = 1), broken_totals AS (SELECT * FROM d_tss WHERE wins > 0), broken_stats AS (SELECT * FROM d_stats WHERE goals > 3), broken_pss AS (SELECT * FROM d_pss WHERE goals > 20), broken_pseasons AS (SELECT * FROM d_pseasons WHERE primary_position = 'A') " + _integrity_sql("broken_games", "broken_seasons", "broken_totals", "broken_stats", "broken_pss", "broken_pseasons"))
def _(t):
    """Every check violated: teams that are not there, seasons without games, rows without their totals, sides that changed."""
    made = _tables(t)
    known = made["team_seasons"].join(t.teams.filter("division_id < 3").select(F.col("id").alias("team_id")), "team_id", "left_semi").select("team_id", "season_id")
    idle = t.teams.filter("division_id = 1").select(F.col("id").alias("team_id"), F.lit("2000").alias("season_id"))
    return quality.integrity(
        {
            "games": made["games"].withColumn("away_team_id", F.when(F.col("division_id") == 2, "0").otherwise(F.col("away_team_id"))),
            "team_seasons": known.union(idle).distinct(),
            "team_season_stats": made["team_season_stats"].filter("wins > 0"),
            "player_game_stats": made["player_game_stats"].filter("goals > 3"),
            "player_season_stats": made["player_season_stats"].filter("goals > 20"),
            "player_seasons": made["player_seasons"].filter("primary_position = 'A'"),
        }
    )
