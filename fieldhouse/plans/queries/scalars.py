"""Scalar functions over fixture columns."""

from pyspark.sql import functions as F

from fieldhouse.functions import scalars as S
from fieldhouse.registry import query


@query("e01_safe_int", "SELECT seq, coalesce(TRY_CAST(trim(score) AS INT), -1) AS n, TRY_CAST(quarter AS INT) AS q FROM fx_plays_raw")
def _(t):
    return t.plays.select("seq", S.safe_int("score", -1).alias("n"), S.safe_int("quarter").alias("q"))


@query("e02_safe_float", "SELECT seq, coalesce(TRY_CAST(trim(quarter) AS DOUBLE), 0.5) AS x FROM fx_plays_raw")
def _(t):
    return t.plays.select("seq", S.safe_float("quarter", 0.5).alias("x"))


@query("e03_time_to_seconds", "SELECT seq, CAST(split_part(time, ':', 1) AS INT) * 60 + CAST(split_part(time, ':', 2) AS INT) AS seconds, coalesce(TRY_CAST(quarter AS INT), 0) AS plain FROM fx_plays_raw")
def _(t):
    return t.plays.select("seq", S.time_to_seconds("time").alias("seconds"), S.time_to_seconds("quarter").alias("plain"))


@query("e04_parse_minutes", "SELECT seq, TRY_CAST(quarter AS INT) AS minutes FROM fx_plays_raw")
def _(t):
    return t.plays.select("seq", S.clock_seconds("quarter").alias("minutes"))


@query("e05_format_seconds", "SELECT DISTINCT goalie_minutes AS s, coalesce(CAST(goalie_minutes // 60 AS VARCHAR) || ':' || lpad(CAST(goalie_minutes % 60 AS VARCHAR), 2, '0'), '-') AS clock FROM fx_player_game_stats")
def _(t):
    return t.raw_stats.select(F.col("goalie_minutes").alias("s"), S.format_seconds("goalie_minutes", "-").alias("clock")).distinct()


@query("e06_display", "SELECT season_id, team_id, wins || '-' || losses AS record, CASE WHEN win_pct IS NULL THEN '-' ELSE printf('%.3f', win_pct) END AS pct, CAST(goals_for AS VARCHAR) AS cell FROM d_tss")
def _(t):
    return t.team_season_stats.select("season_id", "team_id", S.format_record("wins", "losses").alias("record"), S.format_pct("win_pct").alias("pct"), S.format_cell("goals_for").alias("cell"))


@query("e07_format_date", "SELECT id, strftime(game_date, '%b %-d, %Y') AS long_date, strftime(game_date, '%-m/%-d') AS short_date FROM fx_games")
def _(t):
    return t.games.select("id", S.format_game_date("game_date").alias("long_date"), S.format_game_date("game_date", True).alias("short_date"))


_texts = lambda: F.expr("case cast(id as bigint) % 4 when 0 then date_format(game_date, 'MM/dd/yyyy') when 1 then cast(game_date as string) when 2 then 'soon' else concat(date_format(game_date, 'MMMM d'), 'th ', year(game_date)) end")


@query("e08_parse_date", "SELECT id, CASE WHEN CAST(id AS BIGINT) % 4 <> 2 THEN game_date END AS parsed FROM fx_games")
def _(t):
    return t.games.select("id", S.parse_date(_texts()).alias("parsed"))


@query("e09_epoch_to_date", "SELECT id, strftime(game_date, '%B ') || CAST(day(game_date) AS VARCHAR) || CASE WHEN day(game_date) BETWEEN 11 AND 13 THEN 'th' WHEN day(game_date) % 10 = 1 THEN 'st' WHEN day(game_date) % 10 = 2 THEN 'nd' WHEN day(game_date) % 10 = 3 THEN 'rd' ELSE 'th' END || strftime(game_date, ' %Y') AS text FROM fx_games")
def _(t):
    noon = F.unix_seconds(F.col("game_date").cast("timestamp")) + 17 * 3600
    return t.games.select("id", S.epoch_to_game_date(noon).alias("text"))


@query("e10_season_from_date", "SELECT id, CAST(year(game_date) AS VARCHAR) AS season FROM fx_games")
def _(t):
    return t.games.select("id", S.season_from_date(F.col("game_date").cast("string")).alias("season"))


_start = lambda: F.expr("make_date(cast(season_id as int), 2, 1)")
_MONDAY = "(make_date(CAST(season_id AS INT), 2, 1) + CAST((8 - isodow(make_date(CAST(season_id AS INT), 2, 1))) % 7 AS INT))"


@query("e11_week_number", f"SELECT id, greatest(CAST(floor((game_date - {_MONDAY}) / 7.0) AS INT) + 1, 0) AS week FROM fx_games")
def _(t):
    return t.games.select("id", S.week_number("game_date", _start()).alias("week"))


@query("e12_week_cap", f"SELECT season_id, least(20, greatest(1, max(greatest(CAST(floor((game_date - {_MONDAY}) / 7.0) AS INT) + 1, 0)))) AS week FROM fx_games WHERE status = 'final' GROUP BY season_id")
def _(t):
    weeks = t.games.filter("status = 'final'").withColumn("week", S.week_number("game_date", _start()))
    return weeks.groupBy("season_id").agg(F.least(F.lit(20), F.greatest(F.lit(1), F.max("week"))).alias("week"))


_NORMAL = "regexp_replace(regexp_replace(trim(lower({0})), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')"


@query("e13_normalize_team", f"SELECT id, {_NORMAL.format('name')} AS key FROM fx_teams")
def _(t):
    return t.teams.select("id", S.normalize_team("name").alias("key"))


@query("e14_token_overlap", f"SELECT id, CAST(len(list_intersect(string_split({_NORMAL.format('name')}, ' '), string_split({_NORMAL.format('short_name')}, ' '))) AS DOUBLE) / len(list_distinct(list_concat(string_split({_NORMAL.format('name')}, ' '), string_split({_NORMAL.format('short_name')}, ' ')))) AS overlap FROM fx_teams")
def _(t):
    return t.teams.select("id", S.token_overlap("name", "short_name").alias("overlap"))


@query("e15_name_confidence", """
SELECT a, b, CASE WHEN contains(x, y) OR contains(y, x) THEN 'exact' WHEN 3 * len(list_intersect(string_split(x, ' '), string_split(y, ' '))) >= len(list_distinct(string_split(x, ' '))) + len(list_distinct(string_split(y, ' '))) THEN 'fuzzy' END AS confidence
FROM (SELECT DISTINCT h.id AS a, o.id AS b, lower(h.name) AS x, CASE WHEN CAST(o.id AS BIGINT) % 2 = 0 THEN lower(h.short_name) || ' ' || lower(o.short_name) ELSE lower(o.short_name) END AS y FROM fx_games g JOIN fx_teams h ON h.id = g.home_team_id JOIN fx_teams o ON o.id = g.away_team_id) z""")
def _(t):
    a, b = t.teams.select(F.col("id").alias("home_team_id"), "name", F.col("short_name").alias("own")), t.teams.select(F.col("id").alias("away_team_id"), "short_name")
    met = t.games.select("home_team_id", "away_team_id").distinct().join(a, "home_team_id").join(b, "away_team_id")
    other = F.when(F.col("away_team_id").cast("long") % 2 == 0, F.concat_ws(" ", "own", "short_name")).otherwise(F.col("short_name"))
    return met.select(F.col("home_team_id").alias("a"), F.col("away_team_id").alias("b"), S.name_confidence("name", other).alias("confidence"))


@query("e16_make_slug", "SELECT id, trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9-]', '-', 'g'), '-+', '-', 'g'), '-') || '-st-os-nns-ny' AS made FROM fx_teams")
def _(t):
    return t.teams.select("id", S.make_slug(F.concat("name", F.lit(" St. O's Ńňš\u0430 (NY)"))).alias("made"))


@query("e17_infer_mascot", "SELECT id, 'University of' AS short, name AS mascot FROM fx_teams")
def _(t):
    short, mascot = S.infer_mascot(F.concat(F.lit("University of "), F.col("name")))
    return t.teams.select("id", short.alias("short"), mascot.alias("mascot"))


@query("e19_normalize_name", "SELECT DISTINCT p1r, split_part(p1r, ', ', 2) || ' ' || split_part(p1r, ', ', 1) AS name FROM (SELECT regexp_extract(home_event, 'Ground ball pickup by ABC ([^.]+)', 1) AS p1r FROM fx_plays_raw) x WHERE p1r <> ''")
def _(t):
    raw = t.plays.select(F.regexp_extract("home_event", r"Ground ball pickup by ABC ([^.]+)", 1).alias("p1r")).filter("p1r <> ''").distinct()
    return raw.withColumn("name", S.normalize_name("p1r"))


@query("e20_normalize_position", "SELECT position, CASE position WHEN 'ATT' THEN 'A' WHEN 'GK' THEN 'G' ELSE 'M' END AS code, CAST(count(*) AS BIGINT) AS n FROM fx_player_game_stats GROUP BY position")
def _(t):
    return t.raw_stats.groupBy("position").agg(F.count("*").alias("n")).withColumn("code", S.normalize_position("position"))


@query("e21_parse_quarter", "SELECT quarter, CASE quarter WHEN 'OT' THEN 5 WHEN '2OT' THEN 6 ELSE CAST(quarter AS INT) END AS number, CAST(count(*) AS BIGINT) AS n FROM fx_plays_raw GROUP BY quarter")
def _(t):
    return t.plays.groupBy("quarter").agg(F.count("*").alias("n")).withColumn("number", S.parse_quarter("quarter"))


@query("e22_parse_score", "SELECT seq, TRY_CAST(split_part(score, '-', 1) AS INT) AS home, TRY_CAST(split_part(score, '-', 2) AS INT) AS away FROM fx_plays_raw")
def _(t):
    home, away = S.parse_score("score")
    return t.plays.select("seq", home.alias("home"), away.alias("away"))


@query("e30_title_case", "SELECT id, substr(name, 1, 5) || substr(name, 6, instr(substr(name, 6), ' ')) || upper(substr(m, 1, 1)) || lower(substr(m, 2)) AS title FROM (SELECT id, name, substr(name, 6 + instr(substr(name, 6), ' ')) AS m FROM fx_teams) x")
def _(t):
    return t.teams.select("id", S.title_case("name").alias("title"))


@query("e31_model_scalars", "SELECT id, greatest(least(home_score - away_score, 8), -8) AS margin, round(exp(-0.02 * day(game_date)), 9) AS weight, round(1 / (1 + exp(-0.4 * (home_score - away_score))), 9) AS p FROM fx_games WHERE status = 'final'")
def _(t):
    d = F.col("home_score") - F.col("away_score")
    return t.games.filter("status = 'final'").select("id", S.clamp(d).alias("margin"), F.round(S.decay(F.dayofmonth("game_date")), 9).alias("weight"), F.round(S.win_probability(d), 9).alias("p"))


@query("e32_points", "SELECT season_id, CAST(sum(goals + assists) AS BIGINT) AS points FROM fx_player_game_stats GROUP BY season_id")
def _(t):
    return t.raw_stats.groupBy("season_id").agg(F.sum(S.points()).alias("points"))


@query("e33_display_strings", "SELECT id, substr(short_name, 1, 12) AS short, printf('%+d', division_id - 2) AS delta FROM fx_teams")
def _(t):
    return t.teams.select("id", S.short_team("short_name").alias("short"), S.signed(F.col("division_id") - 2).alias("delta"))
