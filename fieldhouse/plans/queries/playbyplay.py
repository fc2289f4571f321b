"""Play texts: classification, players, rebuilt stats."""

from pyspark.sql import functions as F

from fieldhouse.functions import plays as P
from fieldhouse.operators import pbp
from fieldhouse.registry import query

_TEXT = "SELECT game_id, seq, home_event || away_event AS t, CASE WHEN home_event <> '' THEN 0 ELSE 1 END AS side FROM fx_plays_raw WHERE home_event || away_event NOT IN ('', '0')"
_KIND = "CASE WHEN t LIKE '%GOAL by%' THEN 'goal' WHEN t LIKE '%Shot by%SAVE%' THEN 'shot_on_goal' WHEN t LIKE '%Shot by%' THEN 'shot' WHEN t LIKE 'Ground ball pickup%' THEN 'ground_ball' WHEN t LIKE 'Turnover by%caused by%' THEN 'caused_turnover' WHEN t LIKE 'Turnover by%' THEN 'turnover' WHEN t LIKE 'Faceoff%won by%' THEN 'faceoff_won' WHEN t LIKE 'Penalty on%' THEN 'penalty' WHEN t LIKE 'Media timeout%' THEN 'timeout' WHEN t LIKE 'Clear attempt%good%' THEN 'clear_success' END"


def _name(x: str) -> str:
    x = f"trim(regexp_replace(trim({x}), '\\.+$', ''))"
    return f"CASE WHEN contains({x}, ',') THEN trim(split_part({x}, ',', 2)) || ' ' || trim(split_part({x}, ',', 1)) ELSE {x} END"


_RE = {
    "goal": r"regexp_extract(t, 'GOAL by (\w+) ([^(]+?)(?:, Assist|\(|, goal|\.)', 2)",
    "assist": r"regexp_extract(t, 'Assist by ([^(,\.]+(?:, [^(,\.]+)?)', 1)",
    "shot": r"regexp_extract(t, 'Shot by (\w+) ([^,]+(?:, [A-Z][a-z]+)?)(?:,? (?:SAVE|WIDE|HIGH|BLOCKED)|\.)', 2)",
    "save": r"regexp_extract(t, 'SAVE ([A-Z][a-z]+(?: [A-Z][a-z]+)+)', 1)",
    "ground": r"regexp_extract(t, 'Ground ball pickup by (\w+) ([^.]+(?:, [A-Z][a-z]+)?)\.', 2)",
    "turn": r"regexp_extract(t, 'Turnover by (\w+) ([^(.]+(?:, [A-Z][a-z]+)?)(?:\(|\.|\s*$)', 2)",
    "caused": r"regexp_extract(t, 'caused by ([^)]+)', 1)",
    "f1": r"regexp_extract(t, 'Faceoff ([^v]+) vs ([^w]+) won', 1)",
    "f2": r"regexp_extract(t, 'Faceoff ([^v]+) vs ([^w]+) won', 2)",
}
_PARTS = "SELECT game_id, seq, side, t, " + ", ".join(f"nullif({v}, '') AS {k}" for k, v in _RE.items()) + f" FROM ({_TEXT}) x"
# a shooter who is also named as the saver counts for the other side
_OWN = f"CASE WHEN {_name('save')} = {_name('shot')} THEN 1 - side ELSE side END"
_STATS = " UNION ALL ".join(
    f"SELECT game_id, seq, {side} AS side, {_name(part)} AS player, '{stat}' AS stat FROM p WHERE {when}"
    for part, stat, when, side in (
        ("goal", "goals", "goal IS NOT NULL", "side"),
        ("assist", "assists", "goal IS NOT NULL AND assist IS NOT NULL", "side"),
        ("shot", "shots", "shot IS NOT NULL", _OWN),
        ("shot", "shots_on_goal", "shot IS NOT NULL AND save IS NOT NULL", _OWN),
        ("save", "saves", "shot IS NOT NULL AND save IS NOT NULL", "1 - side"),
        ("ground", "ground_balls", "ground IS NOT NULL", "side"),
        ("turn", "turnovers", "turn IS NOT NULL", "side"),
        ("caused", "caused_turnovers", "turn IS NOT NULL AND caused IS NOT NULL", "side"),
        ("f1", "faceoffs_taken", "f1 IS NOT NULL", "side"),
        ("f2", "faceoffs_taken", "f2 IS NOT NULL", "side"),
    )
)


def _event_name(column: str) -> str:
    return f"CASE WHEN {column} IS NOT NULL THEN {_name(column)} END"


@query("e23_classify", f"SELECT seq, {_KIND} AS play_type FROM ({_TEXT}) x")
def _(t):
    return pbp.play_rows(t.plays).select("seq", P.classify(F.col("text")).alias("play_type"))


@query("e24_admission", f"SELECT seq, {_KIND} AS play_type FROM ({_TEXT}) x WHERE {_KIND} NOT IN ('timeout', 'substitution')")
def _(t):
    rows = pbp.play_rows(t.plays).withColumn("play_type", P.classify(F.col("text")))
    return rows.filter(P.admitted(F.col("play_type"))).select("seq", P.stored_type(F.col("play_type")).alias("play_type"))


@query("e25_event_stats", f"WITH p AS ({_PARTS}) SELECT seq, player, stat, 1 AS n FROM ({_STATS}) s")
def _(t):
    return pbp.play_rows(t.plays).select("seq", F.inline(P.event_stats(F.col("text"))))


@query("e26_players", f"SELECT seq, coalesce({', '.join(_event_name(c) for c in ('goal', 'shot', 'ground', 'turn', 'f1'))}) AS player_name, coalesce({_event_name('assist')}, {_event_name('caused')}) AS secondary_player_name FROM ({_PARTS}) p")
def _(t):
    return pbp.play_rows(t.plays).select("seq", P.primary_player(F.col("text")).alias("player_name"), P.secondary_player(F.col("text")).alias("secondary_player_name"))


_SWAP = "SELECT c.game_id, abs(a - g.home_score) + abs(h - g.away_score) < abs(h - g.home_score) + abs(a - g.away_score) AS swapped FROM (SELECT game_id, sum(CASE WHEN contains(home_event, 'GOAL by') THEN 1 ELSE 0 END) AS h, sum(CASE WHEN contains(away_event, 'GOAL by') THEN 1 ELSE 0 END) AS a FROM fx_plays_raw GROUP BY game_id) c JOIN fx_games g ON g.id = c.game_id"


@query("e28_column_swap", f"SELECT game_id, coalesce(swapped, false) AS swapped FROM ({_SWAP}) x")
def _(t):
    return pbp.column_swap(t.plays, t.games)


@query("e29_team_of_text", "SELECT seq, CASE WHEN contains(upper(home_event || away_event), 'ABC') THEN 'home' WHEN contains(upper(home_event || away_event), 'MEDIA') THEN 'away' END AS team FROM fx_plays_raw")
def _(t):
    text = F.concat("home_event", "away_event")
    return t.plays.select("seq", P.team_of_text(text, F.lit("Abc"), F.lit("Media"), F.lit("home"), F.lit("away")).alias("team"))


_SUMS = ", ".join(f"CAST(sum(CASE WHEN stat = '{c}' THEN 1 ELSE 0 END) AS BIGINT) AS {c}" for c in P.COUNTERS)


@query("a10_rebuild_stats", f"WITH p AS ({_PARTS}), s AS ({_STATS}) SELECT game_id, side, player, {_SUMS} FROM s GROUP BY game_id, side, player")
def _(t):
    return pbp.rebuild_stats(t.plays)


@query("a14_type_histogram", f"SELECT {_KIND} AS play_type, count(*) AS n FROM ({_TEXT}) x WHERE {_KIND} NOT IN ('timeout', 'substitution') GROUP BY 1 ORDER BY n DESC")
def _(t):
    return pbp.canonical_plays(t.plays).groupBy("play_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"))


@query("c03_normalize_plays", "SELECT seq, CASE quarter WHEN 'OT' THEN 5 WHEN '2OT' THEN 6 ELSE CAST(quarter AS INT) END AS quarter_number, CAST(split_part(time, ':', 1) AS INT) * 60 + CAST(split_part(time, ':', 2) AS INT) AS seconds FROM fx_plays_raw WHERE NOT (home_event IN ('', '0') AND away_event IN ('', '0') AND score IN ('', '0'))")
def _(t):
    from fieldhouse.functions.scalars import parse_quarter, time_to_seconds

    return t.plays.filter(~P.is_artifact()).select("seq", parse_quarter("quarter").alias("quarter_number"), time_to_seconds("time").alias("seconds"))


@query("c06_canonical_plays", f"SELECT game_id, seq, play_type, CAST(row_number() OVER (PARTITION BY game_id ORDER BY seq) AS INT) AS play_sequence FROM (SELECT game_id, seq, {_KIND} AS play_type FROM ({_TEXT}) x) y WHERE play_type NOT IN ('timeout', 'substitution')")
def _(t):
    return pbp.canonical_plays(t.plays).select("game_id", "seq", "play_type", "play_sequence")


@query("c12_fill_missing", f"""
WITH p AS ({_PARTS}), s AS ({_STATS}), w AS ({_SWAP}),
r AS (SELECT s.game_id, CASE WHEN w.swapped THEN 1 - side ELSE side END AS side, player, CAST(sum(CASE WHEN stat = 'goals' THEN 1 ELSE 0 END) AS BIGINT) AS goals, CAST(sum(CASE WHEN stat = 'shots' THEN 1 ELSE 0 END) AS BIGINT) AS shots
  FROM s LEFT JOIN w ON w.game_id = s.game_id WHERE s.game_id NOT IN (SELECT game_id FROM d_stats) GROUP BY 1, 2, 3)
SELECT r.game_id, CASE WHEN side = 0 THEN g.home_team_id ELSE g.away_team_id END AS team_id, r.player AS name, r.goals, r.shots, min(f.id) AS player_id
FROM r JOIN fx_games g ON g.id = r.game_id JOIN fx_players f ON f.team_id = CASE WHEN side = 0 THEN g.home_team_id ELSE g.away_team_id END AND split_part(f.name, ' ', 2) = regexp_extract(r.player, '(\\S+)$', 1) AND substr(f.name, 1, 1) = substr(r.player, 1, 1)
GROUP BY ALL""")
def _(t):
    roster = t.players.select("team_id", F.col("id").alias("player_id"), "name", F.col("id").alias("ordinal"))
    return pbp.fill_missing(t.plays, t.games, t.stats, roster).select("game_id", "team_id", "name", "goals", "shots", "player_id")
