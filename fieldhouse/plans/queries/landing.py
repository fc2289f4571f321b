"""Sources and canonical loaders: the tables are landed as JSON documents in the shared folder and read back.

Games with even ids land in the shape that carries ids, the others in the one that carries names only."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldhouse.operators import load, pbp
from fieldhouse.plans import daily
from fieldhouse.registry import query
from fieldhouse.sources import documents
from fieldhouse.storage import new_folder
from fieldhouse.streaming import ingest
from fieldhouse.versions import Store

def _even() -> F.Column:
    return F.col("id").cast("long") % 2 == 0
_ODD = "CAST(id AS BIGINT) % 2 = 1"
#: Files that do not parse, and the date that a scoreboard gives, by game id.
_BROKEN = "CAST(id AS BIGINT) % 10 = 3"


def _path(kind: str, source: F.Column) -> F.Column:
    folder = F.when(F.col("division_id") == 1, "").otherwise(F.concat(F.lit("division"), F.col("division_id").cast("string"), F.lit("/")))
    return F.concat(F.lit("/"), F.col("season_id"), F.lit("/"), folder, source, F.lit("/game_"), F.col("id"), F.lit(f"_{kind}.json"))


def _source() -> F.Column:
    return F.when(_even(), "games").otherwise("ncaa")


def _json(**fields) -> F.Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def _named(t) -> DataFrame:
    name = lambda s: t.teams.select(F.col("id").alias(f"{s}_team_id"), F.col("short_name").alias(f"{s}_name"))
    return t.games.join(name("home"), "home_team_id").join(name("away"), "away_team_id")


def info_files(t) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    spelled = F.concat(F.date_format("game_date", "MMMM d"), F.lit("th "), F.year("game_date"))
    with_ids = _json(gameId=F.col("id"), ncaaGameId=F.col("ncaa_game_id"), homeTeamId=F.col("home_team_id"), awayTeamId=F.col("away_team_id"), homeScore=text("home_score"), awayScore=text("away_score"), attendance=F.lit(" 120 "), location=F.concat(F.lit(" Field "), F.col("home_team_id"), F.lit(" ")), gameDate=F.date_format("game_date", "MM/dd/yyyy"))
    names_only = _json(ncaaGameId=F.col("ncaa_game_id"), homeTeam=F.col("home_name"), awayTeam=F.concat(F.col("away_name"), F.lit(" ")), homeScore=text("home_score"), awayScore=text("away_score"), location=F.lit(""), gameDate=spelled)
    whole = F.when(_even(), with_ids).otherwise(names_only)
    body = F.when(F.expr(_BROKEN), F.substring(whole, 1, 12)).otherwise(whole)
    return _named(t).select(_path("info", _source()).alias("path"), body.alias("value"))


def _clock(seconds: F.Column) -> F.Column:
    return F.concat(F.floor(seconds / 60).cast("string"), F.lit(":00"))


def stats_files(t) -> DataFrame:
    """Box scores of both shapes. Players without an id have their name only."""
    rows = t.raw_stats.join(t.games.select(F.col("id").alias("game_id"), "home_team_id"), "game_id").withColumns({"id": F.col("game_id"), "home": F.col("team_id") == F.col("home_team_id"), "name": F.coalesce("player_name", F.concat(F.lit("Player "), F.reverse(F.col("player_id").cast("string"))))})
    text = lambda c: F.col(c).cast("string")
    goalie = F.col("position") == "GK"
    field = lambda c: F.when(~goalie, text(c))
    flat = F.struct(
        text("player_id").alias("playerId"), F.upper("name").alias("name"), F.col("jersey_number").alias("jersey"), "position", F.col("home").cast("int").alias("tableIndex"), F.when(~goalie, _clock(F.col("minutes_played"))).alias("Min"),
        field("goals").alias("Goals"), field("assists").alias("Assists"), F.when(~goalie, (F.col("goals") + F.col("assists")).cast("string")).alias("Points"), field("shots").alias("Shots"), field("shots_on_goal").alias("SOG"), text("ground_balls").alias("GB"), text("turnovers").alias("TO"),
        text("caused_turnovers").alias("CT"), text("faceoff_wins").alias("FO_Won"), text("faceoffs_taken").alias("FOs_Taken"), F.when(goalie, _clock(F.col("goalie_minutes"))).alias("G Min"), F.when(goalie, text("goals_allowed")).alias("Goals Allowed"), F.when(goalie, text("saves")).alias("Saves"),
    )
    player = F.struct(F.col("jersey_number").alias("NO"), F.lower("name").alias("Name"), F.col("position").alias("POS"), text("goals").alias("G"), text("assists").alias("A"), text("shots").alias("SH"), text("shots_on_goal").alias("SOG"), text("ground_balls").alias("GB"))
    keeper = F.struct(F.col("jersey_number").alias("NO"), F.col("name").alias("Goalies"), text("goals_allowed").alias("GA"), text("saves").alias("SAVES"), _clock(F.col("goalie_minutes")).alias("MIN"))
    keys = ["id", "season_id", "division_id"]
    only = lambda x, c: F.collect_list(F.when(c, x))
    one = rows.groupBy(*keys).agg(F.collect_list(flat).alias("flat"), *[only(x, (goalie == g) & (F.col("home") == h)).alias(n) for n, x, g, h in (("hp", player, False, True), ("hg", keeper, True, True), ("ap", player, False, False), ("ag", keeper, True, False))])
    side = lambda p, g: F.struct(F.col(p).alias("players"), F.col(g).alias("goalies"))
    body = F.when(_even(), F.to_json("flat")).otherwise(_json(away=side("ap", "ag"), home=side("hp", "hg")))
    return one.select(_path("player_stats", _source()).alias("path"), body.alias("value"))


def plays_files(t, text_in_score: bool = False) -> DataFrame:
    """Play-by-play of the games; with text_in_score, games of odd id have the text in the score and the score in the home column."""
    rows = t.plays.withColumn("odd", F.col("game_id").cast("long") % 2 == 1)
    text = F.concat("home_event", "away_event")
    moved = (F.col("odd") & F.lit(text_in_score)) & (text != "0")
    p = F.struct("seq", "quarter", "time", F.when(moved, text).otherwise(F.col("score")).alias("score"), F.when(moved, F.col("score")).otherwise(F.col("home_event")).alias("home_event"), F.when(moved, "").otherwise(F.col("away_event")).alias("away_event"))
    games = rows.groupBy(F.col("game_id").alias("id")).agg(F.array_sort(F.collect_list(p)).alias("p"))
    body = F.to_json(F.transform("p", lambda x: x.dropFields("seq")))
    return games.withColumns({"season_id": F.lit("2001"), "division_id": F.lit(1)}).select(_path("plays", F.lit("ncaa")).alias("path"), body.alias("value"))


def landed(t, found: DataFrame, **chosen) -> DataFrame:
    folder = new_folder(t.spark, "landed")
    documents.pack(found, folder)
    return documents.packed(t.spark, folder, **chosen)


def _good(t, found: DataFrame) -> DataFrame:
    return documents.readable(landed(t, found))[0]


_FILES = "SELECT '/' || season_id || CASE division_id WHEN 1 THEN '/' ELSE '/division' || division_id || '/' END || CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN 'games' ELSE 'ncaa' END || '/game_' || id || '_info.json' AS path, season_id, division_id, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN 'games' ELSE 'ncaa' END AS source, id AS game_id, 'info' AS kind FROM fx_games"


@query("s01_discovery", f"{_FILES} WHERE season_id = '1997' AND division_id = 2")
def _(t):
    return landed(t, info_files(t), season="1997", division=2).drop("body")


@query("s02_game_ids", "SELECT DISTINCT game_id, CAST(game_id AS BIGINT) % 2 = 0 AS with_ids FROM fx_player_game_stats")
def _(t):
    return landed(t, stats_files(t)).filter("kind = 'player_stats'").select("game_id", (F.col("source") == "games").alias("with_ids"))


_INFO = f"""SELECT CASE WHEN {_ODD} THEN coalesce(ncaa_game_id, g.id) ELSE g.id END AS id, ncaa_game_id, season_id, g.division_id, CASE WHEN NOT {_ODD.replace('id AS', 'g.id AS')} THEN home_team_id END AS home_team_id, CASE WHEN NOT {_ODD.replace('id AS', 'g.id AS')} THEN away_team_id END AS away_team_id,
  CASE WHEN {_ODD} THEN h.short_name END AS home_name, CASE WHEN {_ODD} THEN a.short_name END AS away_name, home_score, away_score, CASE WHEN NOT {_ODD} THEN 120 END AS attendance, CASE WHEN NOT {_ODD} THEN 'Field ' || home_team_id END AS location, game_date, status
  FROM fx_games g JOIN fx_teams h ON h.id = g.home_team_id JOIN fx_teams a ON a.id = g.away_team_id WHERE NOT {_BROKEN}"""
_INFO = _INFO.replace("CAST(id AS", "CAST(g.id AS")


@query("s03_game_info", _INFO)
def _(t):
    return documents.game_info(_good(t, info_files(t))).drop("source", "path")


#: Ids backwards: names of one team differ in their first letters.
_NAME = "coalesce(player_name, 'Player ' || reverse(CAST(player_id AS VARCHAR)))"
_GK, _HOME = "s.position = 'GK'", "CASE WHEN s.team_id = g.home_team_id THEN 'home' ELSE 'away' END"
_zero = lambda c: f"CASE WHEN {_GK} THEN 0 ELSE {c} END AS {c}"
_FLAT = f"SELECT game_id, {_HOME} AS side, player_id, {_NAME} AS name, s.jersey_number, s.position, {_GK} AS is_goalie, {', '.join(_zero(c) for c in ('goals', 'assists', 'shots', 'shots_on_goal', 'ground_balls', 'turnovers', 'caused_turnovers', 'faceoff_wins', 'faceoffs_taken'))}, CASE WHEN {_GK} THEN 0 ELSE goals + assists END AS points, minutes_played, goalie_minutes, goals_allowed, saves, 'games' AS source FROM fx_player_game_stats s JOIN fx_games g ON g.id = s.game_id WHERE CAST(game_id AS BIGINT) % 2 = 0"
_NESTED = f"SELECT game_id, {_HOME} AS side, NULL AS player_id, {_NAME} AS name, s.jersey_number, CASE WHEN {_GK} THEN 'G' ELSE s.position END AS position, {_GK} AS is_goalie, {', '.join(_zero(c) for c in ('goals', 'assists', 'shots', 'shots_on_goal', 'ground_balls'))}, 0 AS turnovers, 0 AS caused_turnovers, 0 AS faceoff_wins, 0 AS faceoffs_taken, CASE WHEN {_GK} THEN 0 ELSE goals + assists END AS points, NULL AS minutes_played, goalie_minutes, goals_allowed, saves, 'ncaa' AS source FROM fx_player_game_stats s JOIN fx_games g ON g.id = s.game_id WHERE CAST(game_id AS BIGINT) % 2 = 1"
_STATS = ["game_id", "side", "player_id", "name", "jersey_number", "position", "is_goalie", "goals", "assists", "shots", "shots_on_goal", "ground_balls", "turnovers", "caused_turnovers", "faceoff_wins", "faceoffs_taken", "points", "minutes_played", "goalie_minutes", "goals_allowed", "saves", "source"]


@query("s04_box_scores", f"{_FLAT} UNION ALL {_NESTED}")
def _(t):
    return documents.player_stats(_good(t, stats_files(t))).select(*_STATS)


@query("c02_goalie_rules", f"SELECT source, is_goalie, count(*) AS n, CAST(sum(goals + ground_balls + turnovers) AS BIGINT) AS field_counts, CAST(sum(saves) AS BIGINT) AS saves FROM ({_FLAT} UNION ALL {_NESTED}) x GROUP BY source, is_goalie")
def _(t):
    rows = documents.player_stats(_good(t, stats_files(t)))
    return rows.groupBy("source", "is_goalie").agg(F.count("*").alias("n"), F.sum(F.col("goals") + F.col("ground_balls") + F.col("turnovers")).alias("field_counts"), F.sum("saves").alias("saves"))


@query("s05_plays", "SELECT game_id, row_number() OVER (PARTITION BY game_id ORDER BY seq) - 1 AS seq, quarter, time, score, home_event, away_event FROM fx_plays_raw")
def _(t):
    return documents.raw_plays(_good(t, plays_files(t))).select("game_id", F.col("seq").cast("long").alias("seq"), "quarter", "time", "score", "home_event", "away_event")


def roster_files(t) -> DataFrame:
    """A roster document for each team; every fourth player stands in it twice, first without attributes, and an entry has no
    number for an id."""
    p = t.players.withColumn("n", F.col("id") % 100)
    entry = lambda town, year: F.struct("n", F.col("id").cast("string").alias("playerID"), "name", F.col("team_id").alias("teamID"), town.alias("hometown"), F.lit(None).cast("string").alias("highSchool"), year.alias("classYear"))
    none = F.lit(None).cast("string")
    rows = p.select("team_id", F.explode(F.when(F.col("n") % 4 == 0, F.array(entry(none, none), entry(F.col("hometown"), F.lit("Jr")))).otherwise(F.array(entry(F.col("hometown"), F.lit("Sr"))))).alias("e"))
    teams = rows.groupBy("team_id").agg(F.collect_list("e").alias("e"))
    listed = F.concat(F.transform(F.array_sort("e", lambda x, y: F.when(x["n"] != y["n"], x["n"] - y["n"]).when(x["classYear"].isNull(), -1).otherwise(1).cast("int")), lambda x: x.dropFields("n")), F.array(F.struct(F.lit("x9").alias("playerID"), F.lit("Nobody").alias("name"), F.col("team_id").alias("teamID"), none.alias("hometown"), none.alias("highSchool"), none.alias("classYear"))))
    return teams.select(F.to_json(F.array(F.struct(F.col("team_id").alias("teamID"), listed.alias("players")))).alias("value"))


def rosters(t) -> DataFrame:
    folder = new_folder(t.spark, "rosters")
    roster_files(t).write.text(folder)
    return documents.rosters_of(t.spark.read.text(folder))


@query("s06_rosters", "SELECT id AS player_id, name, team_id FROM fx_players")
def _(t):
    return rosters(t).select("player_id", "name", "team_id")


@query("s07_roster_attributes", "SELECT id AS player_id, hometown, CASE WHEN id % 100 % 4 = 0 THEN 'Jr' ELSE 'Sr' END AS class_year FROM fx_players")
def _(t):
    return rosters(t).select("player_id", "hometown", "class_year")


@query("s08_quarantine", f"SELECT id AS game_id, {_BROKEN} AS quarantined FROM fx_games")
def _(t):
    good, bad = documents.readable(landed(t, info_files(t)))
    return good.select("game_id", F.lit(False).alias("quarantined")).unionByName(bad.select("game_id", F.lit(True).alias("quarantined")))


@query("s09_scoreboard", "SELECT g.id AS ncaa_game_id, strftime(game_date, '%Y-%m-%d') AS date, status AS state, h.short_name AS home_team, a.short_name AS away_team, home_score, away_score FROM fx_games g JOIN fx_teams h ON h.id = g.home_team_id JOIN fx_teams a ON a.id = g.away_team_id WHERE CAST(g.id AS BIGINT) % 13 > 1")
def _(t):
    number = F.col("id").cast("long") % 13
    team = lambda s, home: F.struct(F.lit(home).alias("isHome"), F.col(f"{s}_name").alias("nameShort"), F.col(f"{s}_score").cast("string").alias("score"))
    teams = F.when(number == 1, F.array(team("away", False))).otherwise(F.array(team("away", False), team("home", True)))
    contest = F.struct(F.when(number != 0, F.col("id")).alias("contestId"), F.col("game_date").cast("string").alias("startDate"), F.col("status").alias("gameState"), teams.alias("teams"))
    days = _named(t).groupBy("game_date").agg(F.collect_list(contest).alias("contests"))
    folder = new_folder(t.spark, "responses")
    days.select(F.to_json(F.struct(F.struct("contests").alias("data"))).alias("value")).write.text(folder)
    return documents.scoreboard(t.spark.read.text(folder).withColumnRenamed("value", "body"))


@query("s10_game_centre", "SELECT g.id AS ncaa_game_id, h.short_name AS home_team, a.short_name AS away_team, 'Field ' || home_team_id || CASE WHEN CAST(g.id AS BIGINT) % 3 = 0 THEN '' ELSE ', Town' END || ', ST' AS location, CAST(epoch(game_date) AS BIGINT) AS epoch FROM fx_games g JOIN fx_teams h ON h.id = g.home_team_id JOIN fx_teams a ON a.id = g.away_team_id")
def _(t):
    team = lambda s, home: F.struct(F.lit(home).alias("isHome"), F.col(f"{s}_name").alias("nameShort"))
    place = F.struct(F.concat(F.lit("Field "), F.col("home_team_id")).alias("venue"), F.when(F.col("id").cast("long") % 3 == 0, " ").otherwise("Town").alias("city"), F.lit("ST").alias("stateUsps"))
    body = _json(contestId=F.col("id"), startTimeEpoch=F.unix_seconds(F.col("game_date").cast("timestamp")), location=place, teams=F.array(team("home", True), team("away", False)))
    folder = new_folder(t.spark, "responses")
    _named(t).select(body.alias("value")).write.text(folder)
    return documents.game_centre(t.spark.read.text(folder).withColumnRenamed("value", "body"))


@query("s11_box_score_response", f"SELECT game_id, {_HOME} AS side, {_NAME} AS name, s.jersey_number, s.position, {_GK} AS is_goalie, goals, assists, shots, shots_on_goal, ground_balls, goals_allowed, saves FROM fx_player_game_stats s JOIN fx_games g ON g.id = s.game_id")
def _(t):
    rows = t.raw_stats.join(t.games.select(F.col("id").alias("game_id"), "home_team_id", "away_team_id"), "game_id")
    text = lambda c, n: F.col(c).cast("string").alias(n)
    name = F.split(F.coalesce("player_name", F.concat(F.lit("Player "), F.reverse(F.col("player_id").cast("string")))), " ")
    keeper = F.when(F.col("position") == "GK", F.struct(text("goals_allowed", "goalsAllowed"), text("saves", "saves")))
    p = F.struct(F.col("jersey_number").alias("number"), name[0].alias("firstName"), name[1].alias("lastName"), "position", text("goals", "goals"), text("assists", "assists"), text("shots", "shots"), text("shots_on_goal", "shotsOnGoal"), text("ground_balls", "groundBalls"), keeper.alias("goalie"))
    sides = rows.groupBy("game_id", "home_team_id", "away_team_id", "team_id").agg(F.collect_list(p).alias("playerStats"))
    games = sides.groupBy("game_id", "home_team_id", "away_team_id").agg(F.collect_list(F.struct(F.col("team_id").alias("teamId"), "playerStats")).alias("box"))
    teams = F.array(F.struct(F.col("home_team_id").alias("teamId"), F.lit(True).alias("isHome")), F.struct(F.col("away_team_id").alias("teamId"), F.lit(False).alias("isHome")))
    folder = new_folder(t.spark, "responses")
    games.select(_json(contestId=F.col("game_id"), teams=teams, teamBoxscore=F.col("box")).alias("value")).write.text(folder)
    return documents.box_score_response(t.spark.read.text(folder).withColumnRenamed("value", "body")).drop("pos")


@query("s12_play_response", "SELECT game_id, quarter, CASE WHEN seq % 2 = 0 THEN time ELSE '00:00' END AS time, score, home_event, away_event FROM fx_plays_raw WHERE home_event || away_event <> ''")
def _(t):
    """Texts of games' plays, by period and team; plays without a clock of their own take that of their entry."""
    score = F.split("score", "-")
    half = lambda i: F.when(F.col("score") != "", F.try_element_at(score, F.lit(i)))
    p = F.struct("seq", F.when(F.col("seq") % 2 == 0, F.col("time")).otherwise("").alias("clock"), F.concat("home_event", "away_event").alias("playText"), half(1).alias("visitorScore"), half(2).alias("homeScore"))
    team = F.when(F.col("home_event") != "", "h").otherwise("a")
    entries = t.plays.filter("home_event || away_event <> ''").groupBy("game_id", "quarter", team.alias("teamId")).agg(F.array_sort(F.collect_list(p)).alias("plays"))
    periods = entries.groupBy("game_id", F.col("quarter").alias("periodNumber")).agg(F.collect_list(F.struct("teamId", F.lit("00:00").alias("clock"), F.transform("plays", lambda x: x.dropFields("seq")).alias("plays"))).alias("playbyplayStats"))
    games = periods.groupBy("game_id").agg(F.collect_list(F.struct("periodNumber", "playbyplayStats")).alias("periods"))
    teams = F.array(F.struct(F.lit("h").alias("teamId"), F.lit(True).alias("isHome")), F.struct(F.lit("a").alias("teamId"), F.lit(False).alias("isHome")))
    folder = new_folder(t.spark, "responses")
    games.select(_json(contestId=F.col("game_id"), teams=teams, periods=F.col("periods")).alias("value")).write.text(folder)
    return documents.play_response(t.spark.read.text(folder).withColumnRenamed("value", "body")).drop("seq")


@query("s13_replace_season", "SELECT id, season_id, CASE WHEN season_id = '1997' THEN home_score + 100 ELSE home_score END AS home_score FROM fx_games WHERE season_id <> '1997' OR division_id <> 3")
def _(t):
    """All seasons are loaded, then one is replaced by other rows."""
    folder = new_folder(t.spark, "games")
    rows = t.games.select("id", "season_id", "division_id", "home_score")
    rows.write.partitionBy("season_id").parquet(folder)
    load.replace_season(rows.filter("division_id <> 3").withColumn("home_score", F.col("home_score") + 100), folder, "1997")
    return t.spark.read.schema("id string, division_id int, home_score int, season_id string").parquet(folder).select("id", "season_id", "home_score")


def _two_batches(t, path: str, killed: bool = False):
    """Games and player rows of all seasons in one commit, 1997 once more with other rows in a second; with killed, a third
    batch ends between its two tables."""
    store, seasons = Store(t.spark, path), [r["season_id"] for r in t.games.select("season_id").distinct().collect()]
    games = t.games.select("id", "season_id", "division_id", "home_score")
    stats = t.raw_stats.select("game_id", "season_id", "team_id", "goals", "shots")
    with store.batch() as batch:
        batch.put("games", games, seasons)
        batch.put("player_game_stats", stats, seasons)
    with store.batch() as batch:
        batch.put("games", games.withColumn("home_score", F.col("home_score") + 100), ["1997"])
        batch.put("player_game_stats", stats.withColumn("goals", F.col("goals") + 1), ["1997"])
    if killed:
        broken = store.batch()
        broken.put("games", games.withColumn("home_score", F.lit(-1)), ["1997", "1998"])  # and no commit
    return store


@query("s13_transaction", "SELECT 'games' AS part, season_id, count(*) AS n, CAST(sum(CASE WHEN season_id = '1997' THEN home_score + 100 ELSE home_score END) AS BIGINT) AS total FROM fx_games GROUP BY season_id UNION ALL SELECT 'player_game_stats', season_id, count(*), CAST(sum(CASE WHEN season_id = '1997' THEN goals + 1 ELSE goals END) AS BIGINT) FROM fx_player_game_stats GROUP BY season_id")
def _(t):
    """Two tables under one commit record, one season of both replaced in a second commit, a third that never came to its end."""
    store = _two_batches(t, new_folder(t.spark, "store"), killed=True)
    part = lambda name, c: store.read(name).groupBy("season_id").agg(F.count("*").alias("n"), F.sum(c).cast("long").alias("total")).withColumn("part", F.lit(name))
    return part("games", "home_score").unionByName(part("player_game_stats", "goals"))


#: Games by id as two batches leave them: files that come late win, then those with a score, then the last path.
_INGESTED = f"""
g AS (SELECT *, '/' || season_id || CASE division_id WHEN 1 THEN '/' ELSE '/division' || division_id || '/' END || CASE WHEN CAST(own_id AS BIGINT) % 2 = 0 THEN 'games' ELSE 'ncaa' END || '/game_' || own_id || '_info.json' AS path
  FROM ({_INFO.replace("SELECT CASE", "SELECT g.id AS own_id, CASE", 1).replace("CASE WHEN NOT CAST(g.id AS BIGINT) % 2 = 1 THEN home_team_id END", "home_team_id").replace("CASE WHEN NOT CAST(g.id AS BIGINT) % 2 = 1 THEN away_team_id END", "away_team_id")}) x),
i AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY id ORDER BY coalesce(home_score % 2 = 1, false) DESC, home_score IS NULL, path DESC) = 1),
k AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY home_team_id, away_team_id, game_date ORDER BY id) = 1)"""


@query("s20_incremental", f"WITH {_INGESTED} SELECT id, season_id, division_id, home_team_id, away_team_id, home_score, away_score, status, game_date FROM k")
def _(t):
    """Two batches of a file stream: games of odd scores come without one at first, then all files come again. The stream's
    state drops those that did not change; late scores update the games."""
    folder, out, checkpoint = (new_folder(t.spark, n) for n in ("landing", "ingested", "stream"))
    late = F.col("home_score") % 2 == 1
    early = _Games(t, t.games.withColumns({c: F.when(~late, F.col(c)) for c in ("home_score", "away_score")}))
    roster = t.players.select("team_id", F.col("id").alias("player_id"), "name", F.col("id").alias("ordinal"))
    for games in (early, t):
        documents.pack(info_files(games), folder, "append")
        ingest.ingest(t.spark, folder, out, checkpoint, t.teams, roster, lambda tables: {}, ingest.packed(t.spark, folder))
    return Store(t.spark, out).read("games").select("id", "season_id", "division_id", "home_team_id", "away_team_id", "home_score", "away_score", "status", "game_date")


class _Games:
    """A league with other games."""

    def __init__(self, league, games: DataFrame):
        self.teams, self.games = league.teams, games


@query("s14_csv_report", "SELECT id, CAST(NULL AS VARCHAR) AS comment, CAST(home_score AS VARCHAR) AS home_score FROM fx_games")
def _(t):
    folder = new_folder(t.spark, "report")
    documents.write_csv(t.games, folder, ["id", "comment", "home_score"])
    return t.spark.read.option("header", True).csv(folder)


@query("s15_json_report", "SELECT id, game_date, home_score FROM fx_games")
def _(t):
    folder = new_folder(t.spark, "report")
    documents.write_json(t.games.select("id", "game_date", "home_score"), folder)
    return t.spark.read.schema("id string, game_date date, home_score int").json(folder)


@query("c01_game_dates", f"SELECT id, CASE WHEN CAST(id AS BIGINT) % 4 = 0 THEN DATE '1999-02-03' ELSE game_date END AS game_date, status FROM ({_INFO}) x")
def _(t):
    dates = t.games.filter("cast(id as bigint) % 4 = 0").select(F.col("id").alias("game_id"), F.lit("02/03/1999").alias("contest_date"))
    return documents.game_info(_good(t, info_files(t)), dates).select("id", "game_date", "status")


def _loaded_stats(t) -> DataFrame:
    roster = t.players.select("team_id", F.col("id").alias("player_id"), F.concat(F.lit("Player "), F.reverse(F.col("id").cast("string"))).alias("name"), F.col("id").alias("ordinal"))
    return daily.stat_rows(documents.player_stats(_good(t, stats_files(t))), t.games, roster)


_LOADED = """SELECT {0} AS game_id, team_id, player_id, {1} AS position, count(*) AS n FROM (SELECT DISTINCT s.game_id, s.team_id, {2} AS player_id, CASE WHEN s.player_id IS NULL THEN player_name END AS who, s.position FROM fx_player_game_stats s WHERE CAST(s.game_id AS BIGINT) % 2 = {3}) x GROUP BY ALL"""


@query("c04_stats_with_ids", _LOADED.format("game_id", "CASE position WHEN 'ATT' THEN 'A' WHEN 'MID' THEN 'M' ELSE 'G' END", "s.player_id", 0))
def _(t):
    return _loaded_stats(t).filter("source = 'games'").groupBy("game_id", "team_id", "player_id", "position").agg(F.count("*").alias("n"))


@query("c05_stats_by_name", _LOADED.format("game_id", "CASE position WHEN 'ATT' THEN 'A' WHEN 'MID' THEN 'M' ELSE 'G' END", "(SELECT p.id FROM fx_players p WHERE p.id = s.player_id)", 1).replace("CASE WHEN s.player_id IS NULL THEN player_name END", "coalesce(player_name, CAST(s.player_id AS VARCHAR))"))
def _(t):
    return _loaded_stats(t).filter("source = 'ncaa'").groupBy("game_id", "team_id", "player_id", "position").agg(F.count("*").alias("n"))


@query("c07_text_in_score", "SELECT game_id, row_number() OVER (PARTITION BY game_id ORDER BY seq) - 1 AS seq, score, home_event || away_event AS text, CAST(game_id AS BIGINT) % 2 = 1 AS away_first FROM fx_plays_raw QUALIFY home_event || away_event <> '0'")
def _(t):
    raw = documents.raw_plays(_good(t, plays_files(t, text_in_score=True)))
    games = t.games.select("id", F.lit("Abc").alias("home_name"), F.lit("Media").alias("away_name"))
    rows = documents.in_columns(raw, games).filter("home_event || away_event not in ('', '0')")
    return rows.select("game_id", F.col("seq").cast("long").alias("seq"), "score", F.concat("home_event", "away_event").alias("text"), "away_first")


@query("c10_players_extract", "SELECT p.id, 'Player ' || reverse(CAST(p.id AS VARCHAR)) AS name, hometown, high_school FROM (SELECT DISTINCT player_id FROM fx_player_game_stats WHERE CAST(game_id AS BIGINT) % 2 = 0) s JOIN fx_players p ON p.id = s.player_id UNION ALL SELECT DISTINCT player_id, 'Player ' || reverse(CAST(player_id AS VARCHAR)), NULL, NULL FROM fx_player_game_stats WHERE CAST(game_id AS BIGINT) % 2 = 0 AND player_id IS NOT NULL AND player_id NOT IN (SELECT id FROM fx_players)")
def _(t):
    rows = documents.flat_stats(_good(t, stats_files(t))).filter("player_id is not null").select(F.col("player_id").alias("id"), "name", "path", "pos")
    return load.players_extract(rows, t.players)


@query("c14_daily_job", f"""
WITH g AS ({_INFO.replace("CASE WHEN NOT CAST(g.id AS BIGINT) % 2 = 1 THEN home_team_id END", "home_team_id").replace("CASE WHEN NOT CAST(g.id AS BIGINT) % 2 = 1 THEN away_team_id END", "away_team_id")}),
k AS (SELECT id, season_id, division_id, home_team_id, away_team_id, home_score, away_score, status, game_date FROM (SELECT *, row_number() OVER (PARTITION BY home_team_id, away_team_id, game_date ORDER BY id) AS place FROM g) y WHERE place = 1)
SELECT season_id, count(*) AS games, CAST(sum(home_score) AS BIGINT) AS home_goals, CAST(sum(CASE WHEN status = 'final' THEN 1 ELSE 0 END) AS BIGINT) AS finals, count(DISTINCT home_team_id) AS home_teams FROM k GROUP BY season_id""")
def _(t):
    """The daily job from landed files to tables, without simulations; its games by season."""
    folder, roster = new_folder(t.spark, "landing"), new_folder(t.spark, "rosters")
    documents.pack(info_files(t).unionByName(stats_files(t)).unionByName(plays_files(t)), folder)
    roster_files(t).write.text(roster)
    tables = daily.run_tables(documents.packed(t.spark, folder), documents.rosters_of(t.spark.read.text(roster)), t.teams)
    games = tables["games"]
    return games.groupBy("season_id").agg(F.count("*").alias("games"), F.sum("home_score").alias("home_goals"), F.sum((F.col("status") == "final").cast("int")).alias("finals"), F.countDistinct("home_team_id").alias("home_teams"))
