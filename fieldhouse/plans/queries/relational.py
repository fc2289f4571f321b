"""Filters, projections, joins, set operations, sorts."""

from pyspark.sql import functions as F

from fieldhouse.operators import enrich, grid, load, search
from fieldhouse.plans import reports
from fieldhouse.registry import query
from fieldhouse.storage import new_folder

_G = "id, season_id, home_team_id, away_team_id, home_score, away_score, status"
_g = _G.split(", ")


@query("f01_conjunct_filters", f"SELECT {_G} FROM fx_games WHERE season_id = '1997' AND division_id = 2 AND status = 'final'")
def _(t):
    return reports.scoped(t.games, season_id="1997", division_id=2, status="final", away_team_id=None).select(*_g)


@query("f02_in_list", f"SELECT {_G} FROM fx_games WHERE home_team_id IN ('1', '4', '7')")
def _(t):
    return t.games.filter(F.col("home_team_id").isin("1", "4", "7")).select(*_g)


@query("f03_either_side", f"SELECT {_G} FROM fx_games WHERE home_team_id = '5' OR away_team_id = '5'")
def _(t):
    return t.games.filter((F.col("home_team_id") == "5") | (F.col("away_team_id") == "5")).select(*_g)


@query("f04_not_exists", "SELECT id FROM fx_games g WHERE NOT EXISTS (SELECT 1 FROM fx_player_game_stats s WHERE s.game_id = g.id)")
def _(t):
    return t.games.select("id").join(t.raw_stats.select(F.col("game_id").alias("id")), "id", "left_anti")


@query("f05_ilike", "SELECT id, name FROM fx_teams WHERE name ILIKE '%eam 1%'")
def _(t):
    return t.teams.filter(F.col("name").ilike("%eam 1%")).select("id", "name")


@query("f05_indexed_search", "SELECT 'player' AS kind, CAST(id AS VARCHAR) AS id, name FROM fx_players WHERE name ILIKE '%ank%oo%' UNION ALL SELECT 'team', id, name FROM fx_teams WHERE name ILIKE '%eam 1_3%'")
def _(t):
    """Names found through stored postings, with wild characters between the fixed parts."""
    out = None
    for kind, names, q in (("player", t.players, "ANK%oo"), ("team", t.teams, "eam 1_3")):
        folder = new_folder(t.spark, f"{kind}-names")
        search.build(names.select("id", "name"), folder)
        rows = search.find(t.spark, folder, q).select(F.lit(kind).alias("kind"), "id", "name")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("f06_regex_label", "SELECT id, CASE WHEN regexp_matches(id, '^4') THEN 'stats' ELSE 'feed' END AS source FROM fx_teams")
def _(t):
    return t.teams.select("id", F.when(F.col("id").rlike("^4"), "stats").otherwise("feed").alias("source"))


@query("f07_global_search", "SELECT id, name, slug FROM fx_teams WHERE contains(lower(id), '12') OR contains(lower(name), '12') OR contains(lower(slug), '12')")
def _(t):
    return grid.matching(t.teams.select("id", "name", "slug"), search="12")


@query("f08_contains", "SELECT id, name FROM fx_teams WHERE contains(lower(name), 'auto')")
def _(t):
    return grid.matching(t.teams.select("id", "name"), contains={"name": "AUTO"})


@query("f09_minimum", "SELECT game_id, CAST(count(*) AS BIGINT) AS n FROM fx_player_game_stats WHERE coalesce(minutes_played, 0) >= 1200 GROUP BY game_id")
def _(t):
    return grid.matching(t.raw_stats, minimum={"minutes_played": "1200", "goals": ""}).groupBy("game_id").agg(F.count("*").alias("n"))


@query("f10_facets", "SELECT DISTINCT jersey_number AS value FROM fx_player_game_stats WHERE jersey_number <> '' ORDER BY 1 LIMIT 100")
def _(t):
    return grid.facets(t.raw_stats, "jersey_number")


@query("f11_columns", "SELECT id, slug FROM fx_teams")
def _(t):
    return t.teams.select("id", "slug")


_HAS = " OR ".join(f"coalesce({c}, 0) <> 0" for c in grid.COUNTED)


@query("f12_has_stats", f"SELECT game_id, CAST(count(*) AS BIGINT) AS n FROM fx_player_game_stats WHERE {_HAS} GROUP BY game_id")
def _(t):
    return t.raw_stats.filter(grid.has_stats()).groupBy("game_id").agg(F.count("*").alias("n"))


@query("f13_goalie_split", "SELECT game_id, coalesce(goalie_minutes, 0) > 0 AS is_goalie, CAST(count(*) AS BIGINT) AS n FROM fx_player_game_stats GROUP BY ALL")
def _(t):
    return t.raw_stats.groupBy("game_id", grid.is_goalie().alias("is_goalie")).agg(F.count("*").alias("n"))


@query("f14_plays_filter", "SELECT seq, game_id FROM fx_plays_raw WHERE quarter IN ('OT', '2OT') AND home_event LIKE 'GOAL%'")
def _(t):
    from fieldhouse.functions.scalars import parse_quarter

    category = F.when(F.col("home_event").startswith("GOAL"), "Scoring")
    return grid.plays_by(t.plays.withColumn("quarter_number", parse_quarter("quarter")).withColumn("category", category), "OT", "scoring").select("seq", "game_id")


@query("f15_artifacts", "SELECT seq, game_id FROM fx_plays_raw WHERE NOT (home_event IN ('', '0') AND away_event IN ('', '0') AND score IN ('', '0'))")
def _(t):
    from fieldhouse.functions.plays import is_artifact

    return t.plays.filter(~is_artifact()).select("seq", "game_id")


@query("f16_winner_loser", "SELECT id, CASE WHEN status = 'final' THEN CASE WHEN home_score > away_score THEN home_team_id WHEN home_score < away_score THEN away_team_id END END AS winning_team_id, CASE WHEN status = 'final' THEN CASE WHEN home_score > away_score THEN away_team_id WHEN home_score < away_score THEN home_team_id END END AS losing_team_id FROM fx_games")
def _(t):
    return enrich.winner_loser(t.games).select("id", "winning_team_id", "losing_team_id")


@query("f17_opponent", "SELECT opponent_id, team_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT s.team_id, CASE WHEN s.team_id = g.home_team_id THEN g.away_team_id ELSE g.home_team_id END AS opponent_id FROM fx_player_game_stats s JOIN fx_games g ON g.id = s.game_id) x GROUP BY ALL")
def _(t):
    return enrich.with_opponent(t.raw_stats, t.games).groupBy("opponent_id", "team_id").agg(F.count("*").alias("n"))


@query("f18_perspective", "SELECT id, CASE WHEN home_team_id = '6' THEN away_team_id ELSE home_team_id END AS opponent_id, CASE WHEN home_team_id = '6' THEN home_score ELSE away_score END AS own_score, CASE WHEN home_score = away_score THEN 'T' WHEN (home_score > away_score) = (home_team_id = '6') THEN 'W' WHEN home_score IS NOT NULL THEN 'L' END AS result, CASE WHEN home_team_id = '6' THEN 'vs' ELSE '@' END AS venue FROM fx_games WHERE home_team_id = '6' OR away_team_id = '6'")
def _(t):
    return reports.perspective(t.games.filter("home_team_id = '6' or away_team_id = '6'"), "6").select("id", "opponent_id", "own_score", "result", "venue")


@query("f19_id_bridges", "SELECT 'feed' AS source, ncaa_game_id AS external_id, id AS game_id FROM fx_games WHERE ncaa_game_id IS NOT NULL AND ncaa_game_id <> id")
def _(t):
    return enrich.enrich({"games": t.games, "player_game_stats": t.stats.drop("opponent_id"), "teams": t.teams, "players": t.players})["game_external_ids"]


@query("f20_status", "SELECT id, CASE WHEN home_score IS NOT NULL AND away_score IS NOT NULL THEN 'final' ELSE 'scheduled' END AS status FROM fx_games")
def _(t):
    return t.games.select("id", F.when(F.col("home_score").isNotNull() & F.col("away_score").isNotNull(), "final").otherwise("scheduled").alias("status"))


@query("f21_game_id", "SELECT id, coalesce(nullif(ncaa_game_id, ''), id) AS chosen FROM fx_games")
def _(t):
    return t.games.select("id", F.coalesce(F.nullif("ncaa_game_id", F.lit("")), "id").alias("chosen"))


@query("j01_dimension_join", "SELECT s.player_id, s.season_id, s.team_id, t.slug FROM d_pss s JOIN fx_teams t ON t.id = s.team_id")
def _(t):
    return t.player_season_stats.join(t.teams.select(F.col("id").alias("team_id"), "slug"), "team_id").select("player_id", "season_id", "team_id", "slug")


@query("j02_role_playing", "SELECT g.id, h.name AS home_team_name, a.name AS away_team_name FROM fx_games g LEFT JOIN fx_teams h ON h.id = g.home_team_id LEFT JOIN fx_teams a ON a.id = g.away_team_id")
def _(t):
    return enrich.with_team_names(t.games, t.teams).select("id", "home_team_name", "away_team_name")


@query("j03_left_default", "SELECT t.id, s.season_id, coalesce(r.wins, 0) AS wins FROM fx_teams t CROSS JOIN (SELECT DISTINCT season_id FROM fx_games) s LEFT JOIN d_record r ON r.team_id = t.id AND r.season_id = s.season_id")
def _(t):
    seasons = t.games.select("season_id").distinct()
    grid_ = t.teams.select("id").crossJoin(F.broadcast(seasons))  # teams by seasons: the report's own rows
    return grid_.join(enrich.team_record(t.games).withColumnRenamed("team_id", "id"), ["id", "season_id"], "left").select("id", "season_id", F.coalesce("wins", F.lit(0)).alias("wins"))


@query("j04_composite_left", "SELECT s.player_id, s.team_id, s.season_id, p.jersey_number FROM d_pss s LEFT JOIN d_pseasons p ON p.player_id = s.player_id AND p.team_id = s.team_id AND p.season_id = s.season_id")
def _(t):
    keys = ["player_id", "team_id", "season_id"]
    return t.player_season_stats.join(t.player_seasons.select(*keys, "jersey_number"), keys, "left").select(*keys, "jersey_number")


@query("j05_update_from", "SELECT p.id, coalesce(l.primary_position, 'none') AS primary_position, coalesce(l.team_id, p.team_id) AS team_id FROM fx_players p LEFT JOIN d_latest l ON l.player_id = p.id")
def _(t):
    latest = enrich.latest_by_player(t.player_seasons).select(F.col("player_id").alias("id"), F.col("team_id").alias("new_team"), "primary_position")
    return t.players.join(latest, "id", "left").select("id", F.coalesce("primary_position", F.lit("none")).alias("primary_position"), F.coalesce("new_team", "team_id").alias("team_id"))


_RUN = "SELECT id, is_home, CAST(sum(CASE WHEN goals_for > goals_against THEN 1 ELSE 0 END) OVER w AS BIGINT) AS w, CAST(sum(CASE WHEN goals_for < goals_against THEN 1 ELSE 0 END) OVER w AS BIGINT) AS l FROM d_sides WINDOW w AS (PARTITION BY season_id, team_id ORDER BY game_date, id ROWS UNBOUNDED PRECEDING)"


@query("j06_pivot_sides", f"SELECT h.id, h.w AS home_team_wins, h.l AS home_team_losses, a.w AS away_team_wins, a.l AS away_team_losses FROM ({_RUN}) h JOIN ({_RUN}) a ON a.id = h.id AND h.is_home AND NOT a.is_home")
def _(t):
    return enrich.running_record(t.games)


@query("j07_unpivot", "SELECT id, team_id, is_home FROM d_sides")
def _(t):
    return enrich.team_games(t.games).select("id", "team_id", "is_home")


@query("j08_semi_anti", "SELECT g.id, EXISTS (SELECT 1 FROM fx_player_game_stats s WHERE s.game_id = g.id) AS covered FROM fx_games g WHERE status = 'final'")
def _(t):
    finals, have = t.games.filter("status = 'final'").select("id"), t.raw_stats.select(F.col("game_id").alias("id"))
    return finals.join(have, "id", "left_semi").withColumn("covered", F.lit(True)).unionByName(finals.join(have, "id", "left_anti").withColumn("covered", F.lit(False)))


@query("x01_team_seasons", "SELECT team_id, season_id, team_name FROM d_tseasons")
def _(t):
    return t.team_seasons.select("team_id", "season_id", "team_name")


@query("x02_union_all", "SELECT season_id, CAST(count(*) AS BIGINT) AS sides FROM d_sides GROUP BY season_id")
def _(t):
    return enrich.team_games(t.games).groupBy("season_id").agg(F.count("*").alias("sides"))


@query("x03_difference", "SELECT id FROM fx_games EXCEPT SELECT game_id FROM fx_player_game_stats")
def _(t):
    return load.anti(t.games.select("id"), t.raw_stats.select(F.col("game_id").alias("id")), ["id"])


@query("x04_field_sets", "SELECT game_id, 'goals' AS both_fields FROM fx_player_game_stats GROUP BY game_id HAVING sum(goals) > 0 AND sum(assists) = 0")
def _(t):
    sums = t.raw_stats.groupBy("game_id").agg(F.sum("goals").alias("g"), F.sum("assists").alias("a"))
    have = F.array_compact(F.array(F.when(F.col("g") > 0, F.lit("goals")), F.when(F.col("a") > 0, F.lit("assists"))))
    both = F.array_intersect(have, F.array(F.lit("goals"), F.lit("assists")))
    return sums.select("game_id", F.array_join(both, ",").alias("both_fields")).filter("both_fields = 'goals'")


@query("x05_source_priority", "SELECT id, 0 AS src_rank FROM fx_games WHERE status = 'final' UNION ALL SELECT id, 1 FROM fx_games WHERE status <> 'final'")
def _(t):
    return load.by_priority([t.games.filter("status = 'final'").select("id"), t.games.select("id")], ["id"])


@query("x06_distinct_teams", "SELECT DISTINCT team_id FROM (SELECT home_team_id AS team_id FROM fx_games UNION ALL SELECT away_team_id FROM fx_games) x")
def _(t):
    return t.games.select(F.explode(F.array("home_team_id", "away_team_id")).alias("team_id")).distinct()


@query("o01_order_by", "SELECT id, ncaa_game_id, CAST(row_number() OVER (ORDER BY ncaa_game_id DESC NULLS LAST, id) AS INT) AS place FROM fx_games WHERE season_id = '1996' ORDER BY place")
def _(t):
    from pyspark.sql import Window

    rows = t.games.filter("season_id = '1996'")
    return rows.select("id", "ncaa_game_id", F.row_number().over(Window.partitionBy("season_id").orderBy(F.desc_nulls_last("ncaa_game_id"), "id")).alias("place")).orderBy("place")


@query("o02_top_k", "SELECT player_id, team_id, season_id, points FROM d_pss ORDER BY points DESC, player_id, team_id, season_id LIMIT 20")
def _(t):
    return t.player_season_stats.orderBy(F.desc("points"), "player_id", "team_id", "season_id").limit(20).select("player_id", "team_id", "season_id", "points")


@query("o03_page", "SELECT id, name FROM fx_teams ORDER BY name, id LIMIT 10 OFFSET 10")
def _(t):
    return grid.grid(t.teams.select("id", "name"), sort=[("name", False), ("id", False)], page=1, size=10)


@query("o03_counts", "SELECT (SELECT count(*) FROM fx_games WHERE contains(season_id, '199')) AS filtered, (SELECT count(*) FROM fx_games) AS total")
def _(t):
    return grid.grid_counts(t.games, contains={"season_id": "199"})


@query("o04_box_score_order", "SELECT player_id, points, row_number() OVER (ORDER BY points DESC, player_id NULLS FIRST, position, jersey_number) AS place FROM d_stats WHERE game_id = '7'")
def _(t):
    from pyspark.sql import Window

    rows = t.stats.filter("game_id = '7'")
    return rows.select("player_id", "points", F.row_number().over(Window.partitionBy("game_id").orderBy(*grid.box_score_order("points"), "player_id", "position", "jersey_number")).cast("long").alias("place"))


@query("o05_toggle_sort", "SELECT id, slug FROM fx_teams ORDER BY slug DESC, id LIMIT 25")
def _(t):
    return grid.grid(t.teams.select("id", "slug"), sort=[("slug", True)])
