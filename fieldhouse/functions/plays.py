"""Column expressions over play texts: classification, players, stats, column swap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldhouse.functions.scalars import normalize_name

#: What a play's text says, and the play type; the first that fits counts. Only SAVE minds the case.
PLAY_TYPES = [
    ("(?i)GOAL by", "goal"),
    ("(?i)Assist by", "assist"),
    ("(?i)Shot by.*SAVE", "shot_on_goal"),
    ("(?i)Shot by", "shot"),
    (r"\bSAVE\b", "save"),
    ("(?i)Ground ball pickup", "ground_ball"),
    ("(?i)Turnover by.*caused by", "caused_turnover"),
    ("(?i)Turnover by", "turnover"),
    ("(?i)Faceoff.*won by", "faceoff_won"),
    ("(?i)Penalty on", "penalty"),
    ("(?i)Timeout by|Media timeout", "timeout"),
    ("(?i)at goalie for|substitution", "substitution"),
    ("(?i)Clear attempt.*good", "clear_success"),
    ("(?i)Clear attempt.*failed", "clear_attempt"),
    ("(?i)Clear attempt", "clear_attempt"),
    ("(?i)Extra-man opportunity", "emo_opportunity"),
    ("(?i)Draw control", "draw_control"),
]
#: Stored play types, and those that are recognised but not stored.
STORED = ("goal", "assist", "shot", "shot_on_goal", "save", "ground_ball", "turnover", "caused_turnover", "faceoff_won", "faceoff_lost", "penalty", "man_up_goal", "man_down_goal", "emo_opportunity", "clear_attempt", "clear_success", "ride_attempt", "ride_success", "draw_control", "free_position_goal")
DROPPED = ("timeout", "substitution")
#: Where a play's text names its players.
PATTERNS = {
    "goal": r"(?U)GOAL by (\w+) ([^(]+?)(?:, Assist|\(|, goal|\.)",
    "assist": r"Assist by ([^(,\.]+(?:, [^(,\.]+)?)",
    "shot": r"(?U)Shot by (\w+) ([^,]+(?:, [A-Z][a-z]+)?)(?:,? (?:SAVE|WIDE|HIGH|BLOCKED)|\.)",
    "save": r"SAVE ([A-Z][a-z]+(?: [A-Z][a-z]+)+)",
    "ground_ball": r"(?U)Ground ball pickup by (\w+) ([^.]+(?:, [A-Z][a-z]+)?)\.",
    "turnover": r"(?U)Turnover by (\w+) ([^(.]+(?:, [A-Z][a-z]+)?)(?:\(|\.|\s*$)",
    "caused_turnover": r"caused by ([^)]+)",
    "faceoff": r"Faceoff ([^v]+) vs ([^w]+) won",
    "goalie": r"^([^,]+, [A-Z][a-z]+) at goalie",
}
COUNTERS = ["goals", "assists", "shots", "shots_on_goal", "ground_balls", "turnovers", "caused_turnovers", "faceoff_wins", "faceoffs_taken", "saves"]


def classify(text: Column) -> Column:
    """The play type, null where the text is empty or says nothing known."""
    goal, low = text.contains("GOAL by"), F.lower(text)
    kind = F.when(goal & (low.contains("man-up") | low.contains("extra-man")), "man_up_goal").when(goal & low.contains("man-down"), "man_down_goal")
    for pattern, name in PLAY_TYPES:
        kind = kind.when(text.rlike(pattern), name)
    return F.when(text != "", kind)


def admitted(kind: Column) -> Column:
    """Whether a classified play is stored."""
    return kind.isNotNull() & ~kind.isin(*DROPPED)


def stored_type(kind: Column) -> Column:
    return F.when(kind.isin(*STORED), kind).otherwise("shot")


def _part(text: Column, name: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, PATTERNS[name], group), F.lit(""))


def _named(text: Column, name: str, group: int) -> Column:
    return normalize_name(_part(text, name, group))


def event_stats(text: Column) -> Column:
    """array of (player, stat, n): what one play's text adds to whose counters."""
    goal, shot, turnover = _part(text, "goal", 2), _part(text, "shot", 2), _part(text, "turnover", 2)
    faceoff = text.contains("Faceoff") & text.rlike(r"(?U)won by (\w+)")
    entries = [
        (F.lit(True), _named(text, "goal", 2), "goals"),
        (goal.isNotNull(), _named(text, "assist", 1), "assists"),
        (F.lit(True), _named(text, "shot", 2), "shots"),
        (_part(text, "save", 1).isNotNull(), _named(text, "shot", 2), "shots_on_goal"),
        (shot.isNotNull(), _named(text, "save", 1), "saves"),
        (F.lit(True), _named(text, "ground_ball", 2), "ground_balls"),
        (F.lit(True), _named(text, "turnover", 2), "turnovers"),
        (turnover.isNotNull(), _named(text, "caused_turnover", 1), "caused_turnovers"),
        (faceoff, _named(text, "faceoff", 1), "faceoffs_taken"),
        (faceoff, _named(text, "faceoff", 2), "faceoffs_taken"),
    ]
    made = F.array(*[F.struct(F.when(when, player).alias("player"), F.lit(stat).alias("stat"), F.lit(1).alias("n")) for when, player, stat in entries])
    return F.filter(made, lambda x: x["player"].isNotNull())


def primary_player(text: Column) -> Column:
    """The player that the play is about: the first one it counts, else a goalie who comes on."""
    order = [_named(text, "goal", 2), _named(text, "shot", 2), _named(text, "ground_ball", 2), _named(text, "turnover", 2)]
    faceoff = F.when(text.contains("Faceoff") & text.contains("won by"), _named(text, "faceoff", 1))
    return F.coalesce(*order, faceoff, _named(text, "goalie", 1))


def secondary_player(text: Column) -> Column:
    return F.coalesce(_named(text, "assist", 1), _named(text, "caused_turnover", 1))


def team_of_text(text: Column, home: Column, away: Column, home_id: Column, away_id: Column) -> Column:
    """The team whose name stands in the text in capitals, home first; null if neither does."""
    up = F.upper(text)
    return F.when(up.contains(F.upper(home)), home_id).when(up.contains(F.upper(away)), away_id)


def swapped(home_goals: Column, away_goals: Column, home_score: Column, away_score: Column) -> Column:
    """Whether the columns fit the score better the other way round."""
    as_is = F.abs(home_goals - home_score) + F.abs(away_goals - away_score)
    other = F.abs(away_goals - home_score) + F.abs(home_goals - away_score)
    return other < as_is


def is_artifact(home: str = "home_event", score: str = "score", away: str = "away_event") -> Column:
    """A row of a play list that is no play: nothing but "0" or "" in all three fields."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).isin("", "0")
    return blank(home) & blank(score) & blank(away)
