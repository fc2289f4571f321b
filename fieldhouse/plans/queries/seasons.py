"""Aggregations and windows: records, season totals, strength of schedule."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldhouse.operators import deltas, enrich, grid, pbp, quality
from fieldhouse.registry import query
from fieldhouse.storage import new_folder, written
from fieldhouse.versions import Store


@query("a01_team_games", "SELECT id, season_id, team_id, opponent_id, goals_for, goals_against, is_home FROM d_sides")
def _(t):
    return enrich.team_games(t.games).select("id", "season_id", "team_id", "opponent_id", "goals_for", "goals_against", "is_home")


@query("a02_team_record", "SELECT * FROM d_record")
def _(t):
    return enrich.team_record(t.games)


_PSS = "player_id, team_id, season_id, primary_position, player_name, games_played, goals, assists, points, shots, saves, goals_allowed, goalie_minutes, points_per_game, shooting_pct"


@query("a03_player_season_stats", f"SELECT {_PSS} FROM d_pss")
def _(t):
    return t.player_season_stats.select(*_PSS.split(", "))


_TSS = "team_id, season_id, team_name, division_id, wins, losses, ties, goals_for, goals_against, total_shots, total_saves, win_pct, shooting_pct"


@query("a04_team_season_stats", f"SELECT {_TSS} FROM d_tss")
def _(t):
    return t.team_season_stats.select(*_TSS.split(", "))


_OWP = """
WITH o AS (SELECT s.season_id, s.team_id, round(avg(CAST(x.win_pct AS DECIMAL(10,4))) + 1e-12, 4) AS opp_win_pct FROM d_sides s JOIN d_tss x ON x.season_id = s.season_id AND x.team_id = s.opponent_id GROUP BY s.season_id, s.team_id),
p AS (SELECT s.season_id, s.team_id, round(avg(CAST(o.opp_win_pct AS DECIMAL(10,4))) + 1e-12, 4) AS opp_opp_win_pct FROM d_sides s JOIN o ON o.season_id = s.season_id AND o.team_id = s.opponent_id GROUP BY s.season_id, s.team_id)
SELECT o.season_id, o.team_id, o.opp_win_pct, p.opp_opp_win_pct FROM o LEFT JOIN p ON p.season_id = o.season_id AND p.team_id = o.team_id"""


@query("a05_owp_simple", _OWP)
def _(t):
    return enrich.owp_simple(t.games)


@query("a06_career_span", "SELECT player_id, count(DISTINCT season_id) AS season_count, min(season_id) AS first_season, max(season_id) AS last_season FROM d_pseasons GROUP BY player_id")
def _(t):
    return enrich.career_span(t.player_seasons)


@query("a07_player_seasons", "SELECT player_id, season_id, division_id, team_id, jersey_number, primary_position FROM d_pseasons")
def _(t):
    return t.player_seasons.select("player_id", "season_id", "division_id", "team_id", "jersey_number", "primary_position")


@query("a08_goals_by_side", "SELECT g.id AS game_id, CAST(coalesce(sum(CASE WHEN s.team_id = g.home_team_id THEN goals END), 0) AS BIGINT) AS home_goals, CAST(coalesce(sum(CASE WHEN s.team_id = g.away_team_id THEN goals END), 0) AS BIGINT) AS away_goals, count(goals) AS stat_rows FROM fx_games g LEFT JOIN d_stats s ON s.game_id = g.id GROUP BY g.id")
def _(t):
    return quality.goals_by_side(t.games, t.stats)


@query("a09_goals_by_column", "SELECT game_id, CAST(sum(CASE WHEN contains(home_event, 'GOAL by') THEN 1 ELSE 0 END) AS BIGINT) AS home_goals, CAST(sum(CASE WHEN contains(away_event, 'GOAL by') THEN 1 ELSE 0 END) AS BIGINT) AS away_goals FROM fx_plays_raw GROUP BY game_id")
def _(t):
    return pbp.goals_by_column(t.plays)


_COMPARED = ["shots", "shots_on_goal", "ground_balls", "turnovers", "caused_turnovers", "faceoff_wins", "saves"]
_A11 = " UNION ALL ".join(
    f"SELECT game_id, '{c}' AS stat, CAST(h AS BIGINT) AS home, CAST(a AS BIGINT) AS away, CASE WHEN h + a = 0 THEN 50.0 ELSE round(100.0 * h / (h + a), 4) END AS home_share FROM (SELECT s.game_id, sum(CASE WHEN s.team_id = g.home_team_id THEN {c} ELSE 0 END) AS h, sum(CASE WHEN s.team_id = g.away_team_id THEN {c} ELSE 0 END) AS a FROM d_stats s JOIN fx_games g ON g.id = s.game_id GROUP BY s.game_id) x"
    for c in _COMPARED
)


@query("a11_team_comparison", _A11)
def _(t):
    return grid.team_comparison(t.stats, t.games).select("game_id", "stat", "home", "away", "home_share")


@query("a12_duplicate_keys", "SELECT game_id, player_id, position, count(*) AS n FROM fx_player_game_stats GROUP BY ALL HAVING count(*) > 1")
def _(t):
    return t.raw_stats.groupBy("game_id", "player_id", "position").agg(F.count("*").alias("n")).filter("n > 1")


@query("a13_score_mismatch", "SELECT g.id, g.home_score, CAST(sum(CASE WHEN s.team_id = g.home_team_id THEN goals ELSE 0 END) AS BIGINT) AS home_goals FROM fx_games g JOIN d_stats s ON s.game_id = g.id GROUP BY g.id, g.home_score HAVING sum(CASE WHEN s.team_id = g.home_team_id THEN goals ELSE 0 END) <> g.home_score")
def _(t):
    sums = quality.goals_by_side(t.games, t.stats).filter("stat_rows > 0").join(t.games.select(F.col("id").alias("game_id"), "home_score"), "game_id")
    return sums.filter("home_goals <> home_score").select(F.col("game_id").alias("id"), "home_score", "home_goals")


@query("a15_load_summary", "SELECT season_id, CAST(sum(goals) AS BIGINT) AS goals, CAST(sum(assists) AS BIGINT) AS assists, count(DISTINCT game_id) AS games, count(DISTINCT player_id) AS players FROM d_stats GROUP BY season_id")
def _(t):
    return t.stats.groupBy("season_id").agg(F.sum("goals").alias("goals"), F.sum("assists").alias("assists"), F.countDistinct("game_id").alias("games"), F.countDistinct("player_id").alias("players"))


@query("a16_new_per_day", "SELECT game_date, count(*) AS n FROM (SELECT ncaa_game_id, min(game_date) AS game_date FROM fx_games WHERE ncaa_game_id IS NOT NULL GROUP BY ncaa_game_id) x GROUP BY game_date")
def _(t):
    first = t.games.filter("ncaa_game_id is not null").groupBy("ncaa_game_id").agg(F.min("game_date").alias("game_date"))
    return first.groupBy("game_date").agg(F.count("*").alias("n"))


@query("a20_leaders", "SELECT season_id, team_id, wins FROM (SELECT *, row_number() OVER (PARTITION BY season_id ORDER BY wins DESC, team_id) r FROM d_record) x WHERE r <= 5")
def _(t):
    place = F.row_number().over(Window.partitionBy("season_id").orderBy(F.desc("wins"), "team_id"))
    return enrich.team_record(t.games).withColumn("r", place).filter("r <= 5").select("season_id", "team_id", "wins")


@query("a21_percentiles", "SELECT season_id, round(quantile_cont(home_score, 0.05), 6) AS low, round(quantile_cont(home_score, 0.5), 6) AS median, round(quantile_cont(home_score, 0.95), 6) AS high FROM fx_games GROUP BY season_id")
def _(t):
    p = F.percentile("home_score", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    return t.games.groupBy("season_id").agg(p.alias("p")).select("season_id", *[F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("low", "median", "high"))])


@query("w01_running_record", "SELECT id, CAST(max(CASE WHEN is_home THEN w END) AS BIGINT) AS home_team_wins, CAST(max(CASE WHEN is_home THEN l END) AS BIGINT) AS home_team_losses, CAST(max(CASE WHEN NOT is_home THEN w END) AS BIGINT) AS away_team_wins, CAST(max(CASE WHEN NOT is_home THEN l END) AS BIGINT) AS away_team_losses FROM (SELECT id, is_home, sum(CASE WHEN goals_for > goals_against THEN 1 ELSE 0 END) OVER w AS w, sum(CASE WHEN goals_for < goals_against THEN 1 ELSE 0 END) OVER w AS l FROM d_sides WINDOW w AS (PARTITION BY season_id, team_id ORDER BY game_date, id ROWS UNBOUNDED PRECEDING)) x GROUP BY id")
def _(t):
    return enrich.running_record(t.games)


@query("w02_latest_row", "SELECT player_id, team_id, primary_position, jersey_number FROM d_latest")
def _(t):
    return enrich.latest_by_player(t.player_seasons)


@query("w03_distinct_on", "SELECT player_id, season_id, min(team_id) AS team_id FROM d_pss GROUP BY player_id, season_id")
def _(t):
    place = F.row_number().over(Window.partitionBy("player_id", "season_id").orderBy("team_id"))
    return t.player_season_stats.withColumn("r", place).filter("r = 1").select("player_id", "season_id", "team_id")


@query("w04_rank", "SELECT season_id, team_id, CAST(row_number() OVER (PARTITION BY season_id ORDER BY win_pct DESC NULLS LAST, team_id) AS INT) AS place FROM d_tss")
def _(t):
    return t.team_season_stats.select("season_id", "team_id", F.row_number().over(Window.partitionBy("season_id").orderBy(F.desc_nulls_last("win_pct"), "team_id")).alias("place"))


@query("w05_keep_first", "SELECT game_id, count(*) AS n FROM d_stats GROUP BY game_id")
def _(t):
    return t.stats.groupBy("game_id").agg(F.count("*").alias("n"))


@query("w07_running_score", "SELECT seq, last_value(CASE WHEN score <> '' THEN CAST(split_part(score, '-', 1) AS INT) END IGNORE NULLS) OVER w AS home_score, last_value(CASE WHEN score <> '' THEN CAST(split_part(score, '-', 2) AS INT) END IGNORE NULLS) OVER w AS away_score FROM fx_plays_raw WINDOW w AS (PARTITION BY game_id ORDER BY seq ROWS UNBOUNDED PRECEDING)")
def _(t):
    return pbp.running_score(t.plays).select("seq", "home_score", "away_score")


@query("w08_last_score", "SELECT game_id, arg_max(score, seq) AS last_score FROM fx_plays_raw WHERE score NOT IN ('', '0') GROUP BY game_id")
def _(t):
    return quality.last_score(t.plays)


@query("w09_sections", "SELECT game_id, min(seq) AS first_seq, max(seq) AS last_seq, any_value(quarter) AS quarter, count(*) AS plays FROM (SELECT *, sum(new) OVER (PARTITION BY game_id ORDER BY seq) AS section FROM (SELECT *, CASE WHEN lag(quarter) OVER (PARTITION BY game_id ORDER BY seq) = quarter THEN 0 ELSE 1 END AS new FROM fx_plays_raw) x) y GROUP BY game_id, section")
def _(t):
    return pbp.sections(t.plays).drop("section")


@query("w10_repeated_games", "SELECT id, row_number() OVER (PARTITION BY game_date, home_team_id, away_team_id ORDER BY id) > 1 AS again FROM fx_games")
def _(t):
    return t.games.select("id", (F.row_number().over(Window.partitionBy("game_date", "home_team_id", "away_team_id").orderBy("id")) > 1).alias("again"))


def _sums(name: str, table: str, columns: list[str]) -> str:
    return f"SELECT '{name}' AS table_name, count(*) AS n, " + ", ".join(f"CAST(sum({c}) AS DOUBLE) AS s{i}" for i, c in enumerate(columns)) + f" FROM {table}"


_MADE = {
    "player_game_stats": ("d_stats", ["points", "saves", "CAST(opponent_id AS BIGINT)"]),
    "player_season_stats": ("d_pss", ["points", "games_played", "points_per_game"]),
    "team_season_stats": ("d_tss", ["wins", "total_shots", "shooting_pct"]),
    "player_seasons": ("d_pseasons", ["player_id", "CAST(team_id AS BIGINT)", "CAST(jersey_number AS BIGINT)"]),
    "games": ("fx_games", ["home_score", "away_score", "CAST(away_team_id AS BIGINT)"]),
}


@query("c13_enrichment", "SELECT table_name, n, round(s0, 4) AS s0, round(s1, 4) AS s1, round(s2, 4) AS s2 FROM (" + " UNION ALL ".join(_sums(k, *v) for k, v in _MADE.items()) + ") x")
def _(t):
    made = enrich.enrich({"games": t.games, "player_game_stats": t.stats.drop("opponent_id"), "teams": t.teams, "players": t.players})
    parts = [made[k].agg(F.count("*").alias("n"), *[F.round(F.sum(F.expr(c)).cast("double"), 4).alias(f"s{i}") for i, c in enumerate(columns)]).withColumn("table_name", F.lit(k)) for k, (_, columns) in _MADE.items()]
    return reduce(DataFrame.unionByName, parts)


def _by_batches(t):
    """Sums of all games from two batches: the first with wrong scores and goals in every game of an even home score, the
    second puts those games right."""
    store, seasons = Store(t.spark, new_folder(t.spark, "sums")), [r["season_id"] for r in t.games.select("season_id").distinct().collect()]
    stats = written(t.stats, "stats")
    ids = written(t.games.filter("home_score % 2 = 0").select(F.col("id").alias("game_id")), "wrong-games")
    wrong = lambda df, key: df.join(ids.withColumnRenamed("game_id", key), key, "left_semi")
    right = lambda df, key: df.join(ids.withColumnRenamed("game_id", key), key, "left_anti")
    old = wrong(t.games, "id").withColumn("home_score", F.col("home_score") + 9), wrong(stats, "game_id").withColumn("goals", F.col("goals") + 2)
    with store.batch() as batch:
        deltas.apply(batch, seasons, None, (right(t.games, "id").unionByName(old[0].select(*t.games.columns)), right(stats, "game_id").unionByName(old[1].select(*stats.columns))))
    with store.batch() as batch:
        deltas.apply(batch, seasons, old, (wrong(t.games, "id"), wrong(stats, "game_id")))
    return store


@query("c13_team_sums", "SELECT team_id, season_id, team_name, division_id, wins, losses, ties, goals_for, goals_against, total_shots, total_saves, win_pct, shooting_pct FROM d_tss")
def _(t):
    columns = ["wins", "losses", "ties", "goals_for", "goals_against", "total_shots", "total_saves", "win_pct", "shooting_pct"]
    return deltas.team_season_stats(_by_batches(t), t.teams).select("team_id", "season_id", "team_name", "division_id", *columns)


@query("c13_player_sums", "SELECT player_id, team_id, season_id, division_id, player_name, games_played, goals, assists, points, shots, coalesce(saves, 0) AS saves, coalesce(goals_allowed, 0) AS goals_allowed, goalie_minutes, points_per_game, shooting_pct FROM d_pss")
def _(t):
    columns = ["games_played", "goals", "assists", "points", "shots", "saves", "goals_allowed", "goalie_minutes", "points_per_game", "shooting_pct"]
    return deltas.player_season_stats(_by_batches(t), t.players).select("player_id", "team_id", "season_id", "division_id", "player_name", *columns)


@query("c09_season_rows", "SELECT DISTINCT season_id, make_date(CAST(season_id AS INT), 2, 1) AS start_date, make_date(CAST(season_id AS INT), 5, 31) AS end_date, season_id = '2000' AS is_current FROM fx_games")
def _(t):
    from fieldhouse.plans.reports import seasons

    return seasons(t.games, 2000)


@query("c11_team_players", "SELECT team_id, season_id, count(*) AS players FROM d_pseasons GROUP BY ALL")
def _(t):
    return t.player_seasons.groupBy("team_id", "season_id").agg(F.count("*").alias("players"))


@query("w06_play_numbers", "SELECT game_id, seq, CAST(row_number() OVER (PARTITION BY game_id ORDER BY seq) AS INT) AS play_sequence, CASE quarter WHEN 'OT' THEN 5 WHEN '2OT' THEN 6 ELSE CAST(quarter AS INT) END AS quarter_number FROM fx_plays_raw WHERE home_event || away_event NOT IN ('', '0', 'Media timeout.')")
def _(t):
    return pbp.canonical_plays(t.plays).select("game_id", "seq", "play_sequence", "quarter_number")


