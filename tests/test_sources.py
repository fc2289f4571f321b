"""Landed files of both shapes, the stream, sinks and the whole daily plan on small documents."""

import json

import pytest

from fieldhouse.operators import load
from fieldhouse.plans.daily import run_pipeline
from fieldhouse.sources import documents
from fieldhouse.streaming import ingest


def land(base, season, kind, name, body, division=1):
    path = base / season / f"division{division}" / kind
    path.mkdir(parents=True, exist_ok=True)
    (path / name).write_text(body if isinstance(body, str) else json.dumps(body))


@pytest.fixture
def base(tmp_path):
    b = tmp_path / "landing"
    land(b, "2025", "games", "game_100_info.json", {"gameId": "100", "homeTeamId": "1", "awayTeamId": "2", "homeTeam": "Alpha Owls", "awayTeam": "Beta Bears", "homeScore": 2, "awayScore": 1, "attendance": 50, "location": "X (Y, ZZ)", "gameDate": "02/15/2025"})
    land(b, "2025", "games", "game_100_player_stats.json", [
        {"playerId": "11", "name": "ANN O'HARA", "jersey": "7", "position": "ATT", "tableIndex": 1, "Min": "30:00", "Goals": "2", "Assists": 0, "Points": 2, "Shots": "3", "SOG": "2", "GB": "1", "TO": "", "CT": None},
        {"playerId": "21", "name": "bo lee", "jersey": "1", "position": "GK", "tableIndex": 0, "G Min": "60:00", "Goals Allowed": 2, "Saves": "5", "GAA": "2.0"},
        {"playerId": "22", "name": "  ", "tableIndex": 0}])
    land(b, "2025", "ncaa", "game_200_info.json", {"ncaaGameId": "200", "homeTeam": "Beta", "awayTeam": "Alpha", "homeScore": 1, "awayScore": 0, "gameDate": "March 2nd 2025", "location": ""})
    land(b, "2025", "ncaa", "game_200_player_stats.json", {"away": [], "home": {"players": [{"NO": "9", "Name": "LEE, CY", "POS": "M", "G": "1", "A": "1", "SH": "2", "SOG": "2", "GB": "0"}], "goalies": [{"NO": "1", "Goalies": "Lee, Bo", "GA": "0", "SAVES": "4", "MIN": "60:00"}]}})
    land(b, "2025", "ncaa", "game_200_plays.json", [{"quarter": "1", "time": "10:00", "score": "0-1", "home_event": "GOAL by BET Lee, Cy.", "away_event": ""}, {"quarter": 2, "time": "", "score": "0", "home_event": "0", "away_event": ""}])
    land(b, "2025", "ncaa", "game_300_info.json", {"ncaaGameId": "300", "homeTeam": "Alpha", "awayTeam": "Beta", "homeScore": None, "awayScore": None, "gameDate": ""})
    land(b, "2025", "ncaa", "game_400_info.json", "{broken")
    return b


ROSTER = [{"teamID": "1", "players": [{"playerID": "11", "name": "Ann O'Hara", "teamID": "1", "hometown": "Here"}]}, {"teamID": "2", "players": [{"playerID": "21", "name": "Bo Lee", "teamID": "2"}, {"playerID": "23", "name": "Cy Lee", "teamID": "2"}, {"playerID": "x", "name": "Bad", "teamID": "2"}, {"playerID": "23", "name": "Cyrus Lee", "teamID": "2"}]}]


def test_files_and_shapes(spark, base):
    found = documents.files(spark, str(base), "2025", 1)
    good, bad = documents.readable(found)
    assert [r["game_id"] for r in bad.collect()] == ["400"]
    games = {r["id"]: r for r in documents.game_info(good).collect()}
    assert {k: (str(v["game_date"]), v["status"], v["home_score"]) for k, v in games.items()} == {"100": ("2025-02-15", "final", 2), "200": ("2025-03-02", "final", 1), "300": ("None", "scheduled", None)}
    stats = {(r["game_id"], r["name"]): r for r in documents.player_stats(good).collect()}
    assert set(stats) == {("100", "Ann O'Hara"), ("100", "Bo Lee"), ("200", "Lee, Cy"), ("200", "Lee, Bo")}
    ann, bo, cy = stats["100", "Ann O'Hara"], stats["100", "Bo Lee"], stats["200", "Lee, Cy"]
    assert (ann["side"], ann["goals"], ann["minutes_played"], ann["turnovers"]) == ("home", 2, 1800, 0)
    assert (bo["is_goalie"], bo["saves"], bo["goalie_minutes"], bo["goals"]) == (True, 5, 3600, 0)
    assert (cy["points"], cy["side"], cy["is_goalie"]) == (2, "home", False) and stats["200", "Lee, Bo"]["saves"] == 4
    plays = documents.canonical_plays(good).collect()
    assert len(plays) == 1 and plays[0]["seconds"] == 600
    assert documents.files(spark, str(base), "2024").count() == 0


def test_rosters_last_entry_wins(spark, tmp_path):
    (tmp_path / "rosters.json").write_text(json.dumps(ROSTER))
    rows = {r["player_id"]: r["name"] for r in documents.rosters(spark, str(tmp_path / "rosters.json")).collect()}
    assert rows == {11: "Ann O'Hara", 21: "Bo Lee", 23: "Cyrus Lee"}


def test_responses(spark):
    frame = lambda x: spark.createDataFrame([(json.dumps(x),)], "body string")
    teams = [{"isHome": True, "nameShort": "A", "score": "3", "teamId": "1"}, {"isHome": False, "nameShort": "B", "score": "", "teamId": "2"}]
    rows = documents.scoreboard(frame({"data": {"contests": [{"contestId": "9", "teams": teams}, {"contestId": None, "teams": teams}, {"contestId": "8", "teams": teams[:1]}]}})).collect()
    assert [(r["ncaa_game_id"], r["home_score"], r["away_score"]) for r in rows] == [("9", 3, None)]
    place = documents.game_centre(frame({"contestId": "9", "location": {"venue": "V", "city": "", "stateUsps": "NY"}, "teams": teams})).first()
    assert (place["home_team"], place["location"]) == ("A", "V, NY")
    box = documents.box_score_response(frame({"contestId": "9", "teams": teams, "teamBoxscore": [{"teamId": "2", "playerStats": [{"firstName": "C", "lastName": "D", "goals": "1"}, {"firstName": "E", "lastName": "F", "goalie": {"saves": "7"}}]}]})).orderBy("pos").collect()
    assert [(r["side"], r["name"], r["is_goalie"], r["goals"], r["saves"]) for r in box] == [("away", "C D", False, 1, 0), ("away", "E F", True, 0, 7)]
    plays = documents.play_response(frame({"contestId": "9", "teams": teams, "periods": [{"periodNumber": "1", "playbyplayStats": [{"teamId": "2", "clock": "5:00", "plays": [{"clock": "", "playText": "t1"}]}, {"teamId": "7", "plays": [{"clock": "4:00", "playText": "t2", "visitorScore": "1", "homeScore": "0"}]}]}]})).orderBy("seq").collect()
    assert [(r["time"], r["score"], r["home_event"], r["away_event"]) for r in plays] == [("5:00", "", "", "t1"), ("4:00", "1-0", "t2", "")]


def test_daily_plan(spark, base, tmp_path):
    (tmp_path / "rosters.json").write_text(json.dumps(ROSTER))
    teams = spark.createDataFrame([("1", "Alpha Owls", "Alpha", "alpha", 1), ("2", "Beta Bears", "Beta", "beta", 1)], "id string, name string, short_name string, slug string, division_id int")
    made = run_pipeline(spark, str(base), str(tmp_path / "rosters.json"), teams, n_sims=3)
    stats = {(r["game_id"], r["player_id"]): (r["team_id"], r["opponent_id"], r["position"]) for r in made["player_game_stats"].collect()}
    assert stats == {("100", 11): ("1", "2", "A"), ("100", 21): ("2", "1", "G"), ("200", 23): ("2", "1", "M"), ("200", 21): ("2", "1", "G")}
    record = {r["team_id"]: (r["wins"], r["losses"]) for r in made["team_season_stats"].collect()}
    assert record == {"1": (1, 1), "2": (1, 1)}
    assert made["team_season_rankings"].count() == 2 and made["quarantine"].count() == 1
    assert [r["player_name"] for r in made["game_plays"].collect()] == ["Cy Lee"]


def test_stream_equals_batch(spark, base, tmp_path):
    table, checkpoint = str(tmp_path / "games"), str(tmp_path / "cp")
    ingest.ingest_games(spark, str(base), table, checkpoint)
    land(base, "2025", "ncaa", "game_300b_info.json", {"ncaaGameId": "300", "homeTeam": "Alpha", "awayTeam": "Beta", "homeScore": 4, "awayScore": 3, "gameDate": "March 9th 2025"})
    ingest.ingest_games(spark, str(base), table, checkpoint)
    ingest.ingest_games(spark, str(base), table, checkpoint)
    games = {r["id"]: (r["status"], r["home_score"]) for r in ingest.current(spark, table).collect()}
    assert games == {"100": ("final", 2), "200": ("final", 1), "300": ("final", 4)}


def test_stream_reruns_touched_seasons(spark, base, tmp_path):
    from fieldhouse.operators import rankings

    (tmp_path / "rosters.json").write_text(json.dumps(ROSTER))
    roster = documents.rosters(spark, str(tmp_path / "rosters.json"))
    teams = spark.createDataFrame([("1", "Alpha Owls", "Alpha", "alpha", 1), ("2", "Beta Bears", "Beta", "beta", 1)], "id string, name string, short_name string, slug string, division_id int")
    land(base, "2024", "games", "game_50_info.json", {"gameId": "50", "homeTeamId": "1", "awayTeamId": "2", "homeScore": 1, "awayScore": 9, "gameDate": "03/01/2024"})
    out, touched = str(tmp_path / "out"), []

    def derive(tables):
        touched.append(sorted({r["season_id"] for r in tables["games"].collect()}))
        return {"rankings": rankings.rpi(tables["games"])}

    step = lambda: ingest.ingest(spark, str(base), out, str(tmp_path / "cp"), teams, roster, derive)
    wins = lambda: {(r["season_id"], r["team_id"]): r["wins"] for r in ingest.current(spark, out + "/rankings").collect()}
    step()
    assert touched == [["2024", "2025"]] and wins() == {("2024", "1"): 0, ("2024", "2"): 1, ("2025", "1"): 1, ("2025", "2"): 1}
    for name, body in (("game_300b_info.json", {"ncaaGameId": "300", "homeTeam": "Alpha", "awayTeam": "Beta", "homeScore": 4, "awayScore": 3, "gameDate": "March 9th 2025"}), ("game_200b_player_stats.json", {"away": [], "home": {"players": [{"NO": "9", "Name": "LEE, CY", "POS": "M", "G": "5", "A": "1"}]}})):
        land(base, "2025", "ncaa", name, body)
    step()
    step()
    assert touched[1:] == [["2025"]] and wins() == {("2024", "1"): 0, ("2024", "2"): 1, ("2025", "1"): 2, ("2025", "2"): 1}
    stats = sorted((r["game_id"], r["player_id"], r["goals"]) for r in ingest.current(spark, out + "/player_game_stats").filter("season_id = '2025'").collect())
    assert ("100", 11, 2) in stats and [s for s in stats if s[0].startswith("200")] != []
    land(base, "2025", "games", "game_100b_info.json", {"gameId": "100", "homeTeamId": "1", "awayTeamId": "2", "homeScore": 3, "awayScore": 1, "gameDate": "02/15/2025"})
    step()
    kept = sorted((r["v"], r["season_id"]) for r in spark.read.parquet(out + "/games").select("v", "season_id").distinct().collect())
    assert kept == [(0, 2024), (1, 2025), (2, 2025)]
    assert {r["id"]: r["home_score"] for r in ingest.current(spark, out + "/games").filter("season_id = '2025'").collect()} == {"100": 3, "200": 1, "300": 4}


def test_season_replace_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([("1", "2024"), ("2", "2025")], "id string, season_id string")
    path = str(tmp_path / "t")
    for season in ("2024", "2025"):
        load.replace_season(rows, path, season)
    load.replace_season(spark.createDataFrame([("3", "2025")], "id string, season_id string"), path, "2025")
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == ["1", "3"]
    documents.write_csv(rows, str(tmp_path / "csv"), ["id", "more"])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["id", "more"]
    documents.write_json(rows, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_packed_landing_is_read_by_season_and_compacted(spark, base, tmp_path):
    land(base, "2024", "games", "game_50_info.json", {"gameId": "50", "homeTeamId": "1", "awayTeamId": "2", "homeScore": 1, "awayScore": 9, "gameDate": "03/01/2024"})
    found, folder = documents.files(spark, str(base)).select("path", "body").withColumnRenamed("body", "value"), str(tmp_path / "packed")
    for part in (found.filter("path like '%/2024/%'"), found.filter("path like '%_info.json' and path like '%/2025/%'"), found.filter("path like '%/2025/%' and path not like '%_info.json'")):
        documents.pack(part, folder, "append")
    rows = lambda df: sorted((r["path"].rsplit("/", 1)[1], r["season_id"], r["kind"], r["body"]) for r in df.collect())
    whole = rows(documents.files(spark, str(base)))
    one = documents.packed(spark, folder, season="2025", kind="info")
    assert rows(documents.packed(spark, folder)) == whole and rows(one) == [r for r in whole if r[1:3] == ("2025", "info")]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "season_id" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert all("season_id=2025/kind=info" in f for f in spark.read.json(folder).filter("season_id = 2025 and kind = 'info'").select("path", "_metadata.file_path").toPandas()["file_path"])
    saved = documents.compacted(spark, folder, str(tmp_path / "compact"))
    assert saved >= 0 and rows(documents.packed(spark, str(tmp_path / "compact"))) == whole
