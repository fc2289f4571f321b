"""Landed JSON documents: discovery, fault-tolerant reading, the two shapes of each kind, and response flattening.

Layout: {base}/{season}/[division{n}/]{games|ncaa|raw}/game_{id}_{kind}.json. Keys come from the file's path. Files are read
whole; those that do not parse go to a quarantine table instead of failing the job. Shapes are told apart by the parsed
value's kind, never by schema inference, so a new file cannot change the schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldhouse.functions.scalars import clock_seconds, parse_date, parse_quarter, safe_float, safe_int, time_to_seconds, title_case

_PATH = r"/(\d+)/(?:division(\d+)/)?(games|ncaa|raw)/([^/]+)$"
INFO = "gameId string, ncaaGameId string, homeTeamId string, awayTeamId string, homeTeam string, awayTeam string, homeScore string, awayScore string, attendance string, location string, gameDate string"
FLAT = "array<struct<playerId:string,name:string,jersey:string,position:string,tableIndex:int,Min:string,Goals:string,Assists:string,Points:string,Shots:string,SOG:string,GB:string,`TO`:string,CT:string,FO_Won:string,FOs_Taken:string,`G Min`:string,`Goals Allowed`:string,GAA:string,Saves:string,`Save Pct`:string>>"
_SIDE = "struct<players:array<struct<NO:string,Name:string,POS:string,G:string,A:string,SH:string,SOG:string,GB:string>>,goalies:array<map<string,string>>>"
NESTED = f"away {_SIDE}, home {_SIDE}"
PLAYS = "array<struct<quarter:string,time:string,score:string,home_event:string,away_event:string>>"
ROSTERS = "array<struct<teamID:string,players:array<struct<playerID:string,name:string,teamID:string,hometown:string,highSchool:string,classYear:string>>>>"


def files(spark: SparkSession, base: str, season: str | None = None, division: int | None = None) -> DataFrame:
    """(path, season, division, source, game_id, kind, body) of every game file; division 1 in the layout without one."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(base, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    return _chosen(raw, season, division)


LANDED = "path string, value string, season_id string, kind string"


def packed(spark: SparkSession, folder: str, season: str | None = None, division: int | None = None, kind: str | None = None) -> DataFrame:
    """The same from a packed landing folder: JSON lines that hold a file's path and its text, in folders by season and kind.
    Millions of small files are a burden to any file system; a landing job packs them. Only the folders of the season and
    kind that are asked for are read."""
    rows = spark.read.schema(LANDED).json(folder)
    if season is not None:
        rows = rows.filter(F.col("season_id") == season)
    if kind is not None:
        rows = rows.filter(F.col("kind") == kind)
    return _chosen(rows, season, division)


def pack(found: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """Writes (path, value) rows as a packed landing folder, or adds them to one (mode "append"). Rows of a season and kind go to
    one task's file where they can (the optimiser splits large ones), so landing many small batches leaves a file for each."""
    keys = keyed(found).select("path", F.col("body").alias("value"), "season_id", "kind")
    keys.repartition("season_id", "kind", F.pmod(F.xxhash64("path"), F.lit(8))).write.mode(mode).partitionBy("season_id", "kind").json(folder)


def compacted(spark: SparkSession, folder: str, into: str, file_bytes: int = 128 << 20) -> int:
    """Rewrites a packed folder with files of about file_bytes, whatever many small ones it has; returns the files saved. The
    new folder is whole before its name is given to readers."""
    rows = spark.read.schema(LANDED).json(folder)
    counted = lambda path: len(spark.read.schema(LANDED).json(path).inputFiles())
    sizes = rows.groupBy("season_id", "kind").agg(F.ceil(F.sum(F.octet_length("value") + F.octet_length("path")) / file_bytes).cast("int").alias("files"))
    spread = rows.join(sizes, ["season_id", "kind"]).withColumn("file", F.pmod(F.xxhash64("path"), F.col("files")))
    spread.repartition("season_id", "kind", "file").drop("file", "files").write.partitionBy("season_id", "kind").json(into)
    return counted(folder) - counted(into)


def keyed(raw: DataFrame) -> DataFrame:
    """The keys that stand in the paths of (path, value) rows."""
    part = lambda i: F.regexp_extract("path", _PATH, i)
    name = part(4)
    return raw.filter(F.col("path").rlike(_PATH)).select(
        "path", part(1).alias("season_id"), F.coalesce(F.nullif(part(2), F.lit("")), F.lit("1")).cast("int").alias("division_id"), part(3).alias("source"), game_id_of(name).alias("game_id"),
        F.regexp_extract(name, r"_([a-z]+(?:_[a-z]+)*)\.json$", 1).alias("kind"), F.col("value").alias("body"),
    )


def _chosen(raw: DataFrame, season: str | None, division: int | None) -> DataFrame:
    out = keyed(raw)
    if season is not None:
        out = out.filter(F.col("season_id") == season)
    return out if division is None else out.filter(F.col("division_id") == division)


def game_id_of(name: Column) -> Column:
    return F.regexp_extract(name, r"^[^_]+_([^_.]+)", 1)


def readable(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files that parse, quarantined files)."""
    marked = found.withColumn("json", F.try_parse_json("body"))
    return marked.filter("json is not null"), marked.filter("json is null").select("path", "game_id", "kind", F.lit("not JSON").alias("error"))


def game_info(found: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """Canonical games of both info shapes. dates: (game_id, contest_date) that go before the file's own date."""
    d = F.from_json("body", INFO)
    text = lambda c: F.nullif(F.trim(F.col(f"d.{c}")), F.lit(""))
    rows = found.filter("kind = 'info'").withColumn("d", d)
    out = rows.select(
        F.coalesce(text("gameId"), text("ncaaGameId"), F.col("game_id")).alias("id"), text("ncaaGameId").alias("ncaa_game_id"), "season_id", "division_id", text("homeTeamId").alias("home_team_id"), text("awayTeamId").alias("away_team_id"),
        text("homeTeam").alias("home_name"), text("awayTeam").alias("away_name"), safe_int("d.homeScore").alias("home_score"), safe_int("d.awayScore").alias("away_score"), safe_int("d.attendance").alias("attendance"),
        text("location").alias("location"), parse_date("d.gameDate").alias("game_date"), "source", "path",
    )
    if dates is not None:
        own = dates.select(F.col("game_id").alias("id"), parse_date("contest_date").alias("contest_date"))
        out = out.join(own, "id", "left").withColumn("game_date", F.coalesce("contest_date", "game_date")).drop("contest_date")
    return out.withColumn("status", F.when(F.col("home_score").isNotNull() & F.col("away_score").isNotNull(), "final").otherwise("scheduled"))


_COUNTERS = {"goals": "Goals", "assists": "Assists", "shots": "Shots", "shots_on_goal": "SOG", "ground_balls": "GB", "turnovers": "TO", "caused_turnovers": "CT", "faceoff_wins": "FO_Won", "faceoffs_taken": "FOs_Taken"}


def player_stats(found: DataFrame) -> DataFrame:
    """Canonical player rows of both box-score shapes; blank names go. Goalie rows have no field stats, field rows no
    goalie stats; the name-only shape never has turnovers or faceoffs (0), and its points are goals and assists."""
    return flat_stats(found).unionByName(nested_stats(found))


def flat_stats(found: DataFrame) -> DataFrame:
    rows = found.filter("kind = 'player_stats'").filter(F.substring(F.ltrim("body"), 1, 1) == "[")
    one = rows.select("path", "game_id", "season_id", "division_id", F.posexplode(F.from_json("body", FLAT)).alias("pos", "p"))
    g = F.col("p").getField("G Min").isNotNull()
    field = lambda c: F.when(g, F.lit(0)).otherwise(safe_int(F.col("p").getField(c), 0))
    return one.filter(F.trim(F.coalesce("p.name", F.lit(""))) != "").select(
        "path", "pos", "game_id", "season_id", "division_id", F.when(F.coalesce("p.tableIndex", F.lit(1)) % 2 == 0, "away").otherwise("home").alias("side"), F.col("p.tableIndex").alias("table_index"),
        F.col("p.playerId").try_cast("long").alias("player_id"), title_case(F.trim("p.name")).alias("name"), F.col("p.jersey").alias("jersey_number"), F.col("p.position").alias("position"), g.alias("is_goalie"),
        *[field(c).alias(n) for n, c in _COUNTERS.items()], F.when(g, F.lit(0)).otherwise(safe_int("p.Points", 0)).alias("points"),
        F.when(~g, clock_seconds("p.Min")).alias("minutes_played"), F.when(g, clock_seconds(F.col("p").getField("G Min"))).alias("goalie_minutes"),
        F.when(g, safe_int(F.col("p").getField("Goals Allowed"), 0)).otherwise(0).alias("goals_allowed"), F.when(g, safe_int("p.Saves", 0)).otherwise(0).alias("saves"), F.when(g, safe_float("p.GAA")).alias("gaa"), F.lit("games").alias("source"),
    )


def nested_stats(found: DataFrame) -> DataFrame:
    rows = found.filter("kind = 'player_stats'").filter(F.substring(F.ltrim("body"), 1, 1) == "{")
    # a side may be an empty list instead of an object: from_json then gives null for it, and it has no rows
    sides = rows.withColumn("d", F.from_json("body", NESTED)).select("path", "game_id", "season_id", "division_id", F.inline(F.array(F.struct(F.lit("away").alias("side"), F.col("d.away").alias("s")), F.struct(F.lit("home").alias("side"), F.col("d.home").alias("s")))))
    none = F.lit(None).cast("string")
    player = F.transform("s.players", lambda p: F.struct(F.lit(False).alias("goalie"), p["NO"].alias("no"), p["Name"].alias("name"), p["POS"].alias("pos"), p["G"].alias("G"), p["A"].alias("A"), p["SH"].alias("SH"), p["SOG"].alias("SOG"), p["GB"].alias("GB"), none.alias("GA"), none.alias("SV"), none.alias("MIN")))
    # goalies as maps: two spellings of one key would clash as fields
    at = lambda p, c: F.try_element_at(p, F.lit(c))
    goalie = F.transform("s.goalies", lambda p: F.struct(F.lit(True).alias("goalie"), at(p, "NO").alias("no"), F.coalesce(at(p, "Name"), at(p, "Goalies")).alias("name"), F.coalesce(at(p, "POS"), F.lit("G")).alias("pos"), none.alias("G"), none.alias("A"), none.alias("SH"), none.alias("SOG"), none.alias("GB"), at(p, "GA").alias("GA"), F.coalesce(at(p, "SAVES"), at(p, "Saves")).alias("SV"), at(p, "MIN").alias("MIN")))
    empty = F.expr("cast(array() as array<struct<goalie:boolean,no:string,name:string,pos:string,G:string,A:string,SH:string,SOG:string,GB:string,GA:string,SV:string,MIN:string>>)")
    one = sides.select("path", "game_id", "season_id", "division_id", "side", F.posexplode(F.concat(F.coalesce(player, empty), F.coalesce(goalie, empty))).alias("pos", "p"))
    n = lambda c: safe_int(f"p.{c}", 0)
    zero = F.lit(0)
    return one.filter(F.trim(F.coalesce("p.name", F.lit(""))) != "").select(
        "path", "pos", "game_id", "season_id", "division_id", "side", F.lit(None).cast("int").alias("table_index"), F.lit(None).cast("long").alias("player_id"), title_case(F.trim("p.name")).alias("name"),
        F.col("p.no").alias("jersey_number"), F.col("p.pos").alias("position"), F.col("p.goalie").alias("is_goalie"), n("G").alias("goals"), n("A").alias("assists"), n("SH").alias("shots"), n("SOG").alias("shots_on_goal"), n("GB").alias("ground_balls"),
        zero.alias("turnovers"), zero.alias("caused_turnovers"), zero.alias("faceoff_wins"), zero.alias("faceoffs_taken"), (n("G") + n("A")).alias("points"), F.lit(None).cast("int").alias("minutes_played"),
        clock_seconds("p.MIN").alias("goalie_minutes"), n("GA").alias("goals_allowed"), n("SV").alias("saves"), F.lit(None).cast("double").alias("gaa"), F.lit("ncaa").alias("source"),
    )


def raw_plays(found: DataFrame) -> DataFrame:
    """Play rows as they stand in the files, numbered."""
    rows = found.filter("kind = 'plays'")
    return rows.select("path", "game_id", "season_id", F.posexplode(F.from_json("body", PLAYS)).alias("seq", "p")).select("path", "game_id", "season_id", "seq", "p.*").fillna("", ["quarter", "time", "score", "home_event", "away_event"])


def text_in_score(raw: DataFrame) -> DataFrame:
    """(game_id, text_in_score): games whose score field holds texts rather than "X-Y"."""
    return raw.groupBy("game_id").agg(F.max((~F.col("score").rlike(r"^\s*(\d+-\d+|0)?\s*$")).cast("int")).cast("boolean").alias("text_in_score"))


def in_columns(raw: DataFrame, games: DataFrame) -> DataFrame:
    """Plays with texts in the home and away columns: those of games with texts in the score field are put there by the
    team that the text names, unnamed ones to home."""
    from fieldhouse.functions.plays import team_of_text

    g = games.select(F.col("id").alias("game_id"), "home_name", "away_name")
    marked = raw.join(text_in_score(raw), "game_id").join(g, "game_id", "left")
    away = F.coalesce(team_of_text(F.col("score"), F.col("home_name"), F.col("away_name"), F.lit("home"), F.lit("away")) == "away", F.lit(False))
    t = F.col("text_in_score")
    score = F.when(F.col("home_event").rlike(r"^\d+-\d+$"), F.col("home_event")).otherwise("")
    return marked.select("path", "game_id", "season_id", "seq", "quarter", "time", F.when(t, score).otherwise(F.col("score")).alias("score"), F.when(t, F.when(away, "").otherwise(F.col("score"))).otherwise(F.col("home_event")).alias("home_event"), F.when(t, F.when(away, F.col("score")).otherwise("")).otherwise(F.col("away_event")).alias("away_event"), t.alias("away_first"))


def canonical_plays(found: DataFrame) -> DataFrame:
    from fieldhouse.functions.plays import is_artifact

    return raw_plays(found).filter(~is_artifact()).withColumns({"quarter_number": parse_quarter("quarter"), "seconds": time_to_seconds("time")})


def rosters(spark: SparkSession, path: str) -> DataFrame:
    """(team_id, player_id, name, hometown, high_school, class_year, ordinal): ids that are no numbers go; a later entry of
    a player replaces an earlier one."""
    return rosters_of(spark.read.text(path, wholetext=True))


def rosters_of(bodies: DataFrame) -> DataFrame:
    """The same from (value) rows that hold a roster file each."""
    body = bodies.select(F.from_json("value", ROSTERS).alias("r"))
    teams = body.select(F.posexplode("r").alias("team_pos", "t"))
    rows = teams.select("team_pos", F.col("t.teamID").alias("team_id"), F.posexplode("t.players").alias("pos", "p"))
    rows = rows.select(F.col("p.playerID").try_cast("long").alias("player_id"), F.struct(F.coalesce("p.teamID", "team_id").alias("team_id"), F.col("p.name").alias("name"), F.col("p.hometown").alias("hometown"), F.col("p.highSchool").alias("high_school"), F.col("p.classYear").alias("class_year")).alias("v"), (F.col("team_pos") * 100_000 + F.col("pos")).alias("ordinal"))
    return rows.filter("player_id is not null").groupBy("player_id").agg(F.max_by("v", "ordinal").alias("v"), F.max("ordinal").alias("ordinal")).select("player_id", "v.*", "ordinal")


def scoreboard(responses: DataFrame) -> DataFrame:
    """Contests of landed scoreboard responses (body); those without an id or a side go."""
    schema = "data struct<contests:array<struct<contestId:string,startDate:string,gameState:string,teams:array<struct<isHome:boolean,nameShort:string,score:string>>>>>"
    c = responses.select(F.explode(F.from_json("body", schema)["data"]["contests"]).alias("c"))
    side = lambda home: F.try_element_at(F.filter("c.teams", lambda t: t["isHome"] == home), F.lit(1))
    rows = c.select(F.col("c.contestId").alias("ncaa_game_id"), F.col("c.startDate").alias("date"), F.col("c.gameState").alias("state"), side(True).alias("h"), side(False).alias("a"))
    return rows.filter("ncaa_game_id is not null and h is not null and a is not null").select("ncaa_game_id", "date", "state", F.col("h.nameShort").alias("home_team"), F.col("a.nameShort").alias("away_team"), safe_int("h.score").alias("home_score"), safe_int("a.score").alias("away_score"))


def game_centre(responses: DataFrame) -> DataFrame:
    """Home, away and place of landed game-centre responses."""
    schema = "contestId string, startTimeEpoch long, location struct<venue:string,city:string,stateUsps:string>, teams array<struct<isHome:boolean,nameShort:string,score:string>>"
    d = responses.select(F.from_json("body", schema).alias("d"))
    side = lambda home: F.try_element_at(F.filter("d.teams", lambda t: t["isHome"] == home), F.lit(1))
    blank = lambda c: F.nullif(F.trim(F.col(f"d.location.{c}")), F.lit(""))
    return d.select(F.col("d.contestId").alias("ncaa_game_id"), side(True)["nameShort"].alias("home_team"), side(False)["nameShort"].alias("away_team"), F.concat_ws(", ", blank("venue"), blank("city"), blank("stateUsps")).alias("location"), F.col("d.startTimeEpoch").alias("epoch"))


def box_score_response(responses: DataFrame) -> DataFrame:
    """Player rows of landed box-score responses: side by team id, goalies by having a goalie part."""
    schema = "contestId string, teams array<struct<teamId:string,isHome:boolean>>, teamBoxscore array<struct<teamId:string,playerStats:array<struct<number:string,firstName:string,lastName:string,position:string,goals:string,assists:string,shots:string,shotsOnGoal:string,groundBalls:string,goalie:struct<goalsAllowed:string,saves:string>>>>>"
    d = responses.select(F.from_json("body", schema).alias("d"))
    home = F.map_from_entries(F.transform("d.teams", lambda t: F.struct(t["teamId"], t["isHome"])))
    teams = d.select(F.col("d.contestId").alias("game_id"), home.alias("home"), F.explode("d.teamBoxscore").alias("t"))
    rows = teams.select("game_id", F.when(F.try_element_at("home", F.col("t.teamId")), "home").otherwise("away").alias("side"), F.posexplode("t.playerStats").alias("pos", "p"))
    return rows.select("game_id", "side", "pos", F.concat_ws(" ", "p.firstName", "p.lastName").alias("name"), F.col("p.number").alias("jersey_number"), F.col("p.position").alias("position"), F.col("p.goalie").isNotNull().alias("is_goalie"), *[safe_int(f"p.{c}", 0).alias(n) for n, c in (("goals", "goals"), ("assists", "assists"), ("shots", "shots"), ("shots_on_goal", "shotsOnGoal"), ("ground_balls", "groundBalls"))], safe_int("p.goalie.goalsAllowed", 0).alias("goals_allowed"), safe_int("p.goalie.saves", 0).alias("saves"))


def play_response(responses: DataFrame) -> DataFrame:
    """Play rows of landed play-by-play responses, texts in the column of their team; unknown teams count as home."""
    schema = "contestId string, teams array<struct<teamId:string,isHome:boolean>>, periods array<struct<periodNumber:string,playbyplayStats:array<struct<teamId:string,clock:string,plays:array<struct<clock:string,playText:string,visitorScore:string,homeScore:string>>>>>>"
    d = responses.select(F.from_json("body", schema).alias("d"))
    home = F.map_from_entries(F.transform("d.teams", lambda t: F.struct(t["teamId"], t["isHome"])))
    periods = d.select(F.col("d.contestId").alias("game_id"), home.alias("home"), F.posexplode("d.periods").alias("p_pos", "period"))
    entries = periods.select("game_id", "home", "p_pos", F.col("period.periodNumber").alias("quarter"), F.posexplode("period.playbyplayStats").alias("e_pos", "e"))
    plays = entries.select("game_id", "home", "p_pos", "quarter", "e_pos", "e", F.posexplode("e.plays").alias("pos", "p"))
    away = F.coalesce(~F.try_element_at("home", F.col("e.teamId")), F.lit(False))
    clock = F.coalesce(F.nullif("p.clock", F.lit("")), F.col("e.clock"), F.lit(""))
    score = F.when(F.col("p.visitorScore").isNotNull() & F.col("p.homeScore").isNotNull(), F.concat_ws("-", "p.visitorScore", "p.homeScore")).otherwise("")
    return plays.select("game_id", (F.col("p_pos") * 1_000_000 + F.col("e_pos") * 1000 + F.col("pos")).alias("seq"), "quarter", clock.alias("time"), score.alias("score"), F.when(away, "").otherwise(F.col("p.playText")).alias("home_event"), F.when(away, F.col("p.playText")).otherwise("").alias("away_event"))


def work_list(games: DataFrame, landed: DataFrame, failed: DataFrame, end, force: list[str] | None = None) -> DataFrame:
    """Games to process and why: forced; final without all files; scheduled without an info file. Failed games and games
    after the end date do not count. landed: (game_id, kind)."""
    have = landed.groupBy(F.col("game_id").alias("id")).agg(F.countDistinct("kind").alias("kinds"), F.max((F.col("kind") == "info").cast("int")).alias("info"))
    forced = F.col("id").isin(*force) if force else F.lit(False)
    why = F.when(forced, "forced").when((F.col("status") == "final") & (F.coalesce("kinds", F.lit(0)) < 3), "files missing").when((F.col("status") == "scheduled") & (F.coalesce("info", F.lit(0)) == 0), "info missing")
    rows = games.join(have, "id", "left").withColumn("reason", why).filter("reason is not null")
    return rows.join(failed.select("id").distinct(), "id", "left_anti").filter(F.col("game_date").isNull() | (F.col("game_date") <= F.to_date(F.lit(end)))).select("id", "reason")


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """A CSV report with a fixed list of fields; fields that df lacks are empty, others are left out."""
    df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in fields]).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
