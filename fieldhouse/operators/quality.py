"""Data quality: validation of game packages, assessment of loaded data, source comparison, integrity checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldhouse.functions.scalars import parse_score


def goals_by_side(games: DataFrame, stats: DataFrame) -> DataFrame:
    """Goals that players of each side have in each game; 0 without rows."""
    joined = games.select(F.col("id").alias("game_id"), "home_team_id", "away_team_id").join(stats.select("game_id", "team_id", "goals"), "game_id", "left")
    side = lambda s: F.coalesce(F.sum(F.when(F.col("team_id") == F.col(f"{s}_team_id"), F.col("goals"))), F.lit(0)).alias(f"{s}_goals")
    return joined.groupBy("game_id").agg(side("home"), side("away"), F.count("goals").alias("stat_rows"))


def last_score(plays: DataFrame) -> DataFrame:
    """The last score text of each game that is neither blank nor "0"."""
    return plays.filter("score is not null and score not in ('', '0')").groupBy("game_id").agg(F.max_by("score", "seq").alias("last_score"))


def validate(games: DataFrame, stats: DataFrame, plays: DataFrame, away_first: bool = True) -> DataFrame:
    """errors and warnings of each game. games: id, season_id, game_date, home/away_name, home/away_score; stats: game_id,
    side, goals, name, is_goalie; plays: game_id, seq, score. Errors block a load, warnings do not."""
    field = ~F.coalesce(F.col("is_goalie"), F.lit(False))
    side = lambda s: F.coalesce(F.sum(F.when(field & (F.col("side") == s), F.col("goals"))), F.lit(0)).alias(f"{s}_goals")
    box = stats.groupBy(F.col("game_id").alias("id")).agg(side("home"), side("away"), F.count("*").alias("rows"), F.sum(F.when(F.coalesce("name", F.lit("")) == "", 1).otherwise(0)).alias("blank"))
    joined = games.join(box, "id", "left").join(last_score(plays).withColumnRenamed("game_id", "id"), "id", "left")
    key = Window.partitionBy("game_date", F.lower("home_name"), F.lower("away_name")).orderBy("id")
    named = (F.coalesce("home_name", F.lit("")) != "") & (F.coalesce("away_name", F.lit("")) != "")
    joined = joined.withColumn("again", F.col("game_date").isNotNull() & named & (F.row_number().over(key) > 1))
    one, two = parse_score("last_score")
    away, home = (one, two) if away_first else (two, one)
    scored = F.col("home_score").isNotNull() & (F.col("rows") > 0)
    errors = [
        (F.coalesce("home_name", F.lit("")) == "", "missing home name"),
        (F.coalesce("away_name", F.lit("")) == "", "missing away name"),
        (scored & (F.col("home_goals") != F.col("home_score")), "home score mismatch"),
        (scored & F.col("away_score").isNotNull() & (F.col("away_goals") != F.col("away_score")), "away score mismatch"),
    ]
    in_season = (F.year("game_date").cast("string") == F.col("season_id")) & F.month("game_date").between(1, 6)
    warnings = [
        (F.col("game_date").isNull(), "no date"),
        (F.col("game_date").isNotNull() & ~in_season, "date outside season"),
        ((F.col("rows") > 0) & (F.col("blank") > 0.15 * F.col("rows")), "blank names"),
        (F.col("again"), "duplicate game"),
        (F.col("home_score").isNotNull() & F.col("away_score").isNotNull() & ((home != F.col("home_score")) | (away != F.col("away_score"))), "play score mismatch"),
    ]
    listed = lambda found: F.array_compact(F.array(*[F.when(when, F.lit(text)) for when, text in found]))
    return joined.select("id", listed(errors).alias("errors"), listed(warnings).alias("warnings"))


def gate(report: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(loadable, blocked) games of a validation."""
    return report.filter(F.size("errors") == 0), report.filter(F.size("errors") > 0)


def assess(games: DataFrame, stats: DataFrame, files: DataFrame, plays: DataFrame) -> DataFrame:
    """MISSING_FILE, GOAL_MISMATCH or OK for each final game, with the goals its plays tell. files: game_id, kind."""
    from fieldhouse.operators.pbp import goals_by_column

    inventory = files.groupBy("game_id").agg(F.max((F.col("kind") == "stats").cast("int")).alias("has_stats"), F.max((F.col("kind") == "plays").cast("int")).alias("has_plays"))
    told = goals_by_column(plays).select("game_id", F.col("home_goals").alias("pbp_home"), F.col("away_goals").alias("pbp_away"))
    finals = games.filter("status = 'final'")
    out = goals_by_side(finals, stats).join(finals.select(F.col("id").alias("game_id"), "season_id", F.coalesce("home_score", F.lit(0)).alias("home_score"), F.coalesce("away_score", F.lit(0)).alias("away_score")), "game_id").join(inventory, "game_id", "left").join(told, "game_id", "left")
    off = (F.col("home_goals") != F.col("home_score")) | (F.col("away_goals") != F.col("away_score"))
    status = F.when(F.coalesce("has_stats", F.lit(0)) == 0, "MISSING_FILE").when(off, "GOAL_MISMATCH").otherwise("OK")
    return out.select("game_id", "season_id", status.alias("status"), "home_score", "away_score", "home_goals", "away_goals", (F.coalesce("has_plays", F.lit(0)) > 0).alias("has_pbp"), "pbp_home", "pbp_away")


def report(assessed: DataFrame) -> DataFrame:
    """Display rows of the games that are not OK."""
    dh, da = F.col("home_goals") - F.col("home_score"), F.col("away_goals") - F.col("away_score")
    delta = F.when(F.col("status") == "MISSING_FILE", F.concat(F.lit("-"), (F.col("home_score") + F.col("away_score")).cast("string"))).otherwise(
        F.when(da == 0, F.format_string("%+d home", dh)).when(dh == 0, F.format_string("%+d away", da)).otherwise(F.concat(F.format_string("%+dh", dh), F.lit(","), F.format_string("%+da", da)))
    )
    return assessed.filter("status <> 'OK'").select("game_id", "season_id", "status", delta.alias("delta"))


def counts(assessed: DataFrame) -> DataFrame:
    """Games and, of those with plays, recoverable games for each status."""
    return assessed.groupBy("status").agg(F.count("*").alias("games"), F.sum((F.col("has_pbp") & (F.col("status") != "OK")).cast("int")).alias("recoverable"))


def plays_without_stats(files: DataFrame) -> DataFrame:
    kinds = files.groupBy("game_id").agg(F.collect_set("kind").alias("kinds"))
    return kinds.filter(F.array_contains("kinds", "plays") & ~F.array_contains("kinds", "stats")).select("game_id")


def compare_sources(mapped: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Side-by-side metrics of each matched pair. a, b: game_id, players, goals, fields (names present)."""
    left = a.select(F.col("game_id").alias("a_id"), *[F.col(c).alias(f"a_{c}") for c in ("players", "goals", "fields")])
    right = b.select(F.col("game_id").alias("b_id"), *[F.col(c).alias(f"b_{c}") for c in ("players", "goals", "fields")])
    joined = mapped.join(left, "a_id", "left").join(right, "b_id", "left")
    return joined.withColumns({"has_a": F.col("a_players").isNotNull(), "has_b": F.col("b_players").isNotNull(), "goals_agree": F.col("a_goals") == F.col("b_goals")})


def coverage(compared: DataFrame) -> DataFrame:
    """One row: how many pairs each source has, averages, agreement, and which fields either or only one source has."""
    sets = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    pct = lambda c: F.round(100.0 * F.avg(F.col(c).cast("int")), 2)
    out = compared.agg(F.count("*").alias("pairs"), F.sum(F.col("has_a").cast("int")).alias("with_a"), F.sum(F.col("has_b").cast("int")).alias("with_b"), F.round(F.avg("a_players"), 4).alias("a_players"), F.round(F.avg("b_players"), 4).alias("b_players"), pct("goals_agree").alias("agree_pct"), sets("a_fields").alias("fa"), sets("b_fields").alias("fb"))
    return out.select("pairs", "with_a", "with_b", "a_players", "b_players", "agree_pct", F.array_join(F.array_intersect("fa", "fb"), ",").alias("both_fields"), F.array_join(F.array_except("fa", "fb"), ",").alias("only_a"), F.array_join(F.array_except("fb", "fa"), ",").alias("only_b"))


def roster_coverage(stats: DataFrame) -> DataFrame:
    """Per team: games, entries, resolved entries, and the unresolved names with their games."""
    names = stats.filter("player_id is null").groupBy("team_id", F.col("player_name").alias("name"), F.col("jersey_number").alias("jersey")).agg(F.array_sort(F.collect_set("game_id")).alias("game_ids"))
    listed = names.groupBy("team_id").agg(F.array_sort(F.collect_list(F.struct("name", "jersey", "game_ids"))).alias("unresolved"))
    base = stats.groupBy("team_id").agg(F.countDistinct("game_id").alias("games"), F.count("*").alias("entries"), F.count("player_id").alias("resolved"))
    return base.join(listed, "team_id", "left").withColumn("unresolved_names", F.coalesce(F.size("unresolved"), F.lit(0)))


def duplicate_matchups(games: DataFrame) -> DataFrame:
    return games.groupBy("season_id", "home_team_id", "away_team_id", "game_date").agg(F.count("*").alias("n")).filter("n > 1")


def teams_without_games(seasons: DataFrame, games: DataFrame) -> DataFrame:
    sides = [games.select("season_id", F.col(f"{s}_team_id").alias("team_id")) for s in ("home", "away")]
    return seasons.select("team_id", "season_id").join(sides[0].union(sides[1]).distinct(), ["team_id", "season_id"], "left_anti")


def without(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), keys, "left_anti")


def orphan_home_teams(games: DataFrame, seasons: DataFrame) -> DataFrame:
    return without(games.select(F.col("home_team_id").alias("team_id"), "season_id"), seasons, ["team_id", "season_id"])


def teams_without_stats(games: DataFrame, stats: DataFrame) -> DataFrame:
    """Teams with final games but no player rows in the season."""
    from fieldhouse.operators.enrich import team_games

    played = team_games(games).groupBy("team_id", "season_id").agg(F.count("*").alias("finals"))
    have = stats.groupBy("team_id", "season_id").agg(F.count("*").alias("rows"))
    return played.join(have, ["team_id", "season_id"], "left").filter("coalesce(rows, 0) = 0").select("team_id", "season_id", "finals")


def linked_without_seasons(stats: DataFrame, season_stats: DataFrame, seasons: DataFrame) -> DataFrame:
    """Teams whose linked player rows have no season stats or no player seasons."""
    keys = ["team_id", "season_id"]
    linked = stats.filter("player_id is not null").select(*keys).distinct()
    return linked.join(season_stats.select(*keys).distinct(), keys, "left_anti").withColumn("lacks", F.lit("season stats")).unionByName(linked.join(seasons.select(*keys).distinct(), keys, "left_anti").withColumn("lacks", F.lit("player seasons")))


def stray_teams(stats: DataFrame, games: DataFrame) -> DataFrame:
    """Player rows whose team is on neither side of the game."""
    return stats.join(games.select(F.col("id").alias("game_id"), "home_team_id", "away_team_id"), "game_id").filter("team_id <> home_team_id and team_id <> away_team_id").select("game_id", "player_id", "team_id")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()])


#: What a (season, team) may be found in: bits of its presence.
SEASON, PLAYS, HOME, FINAL, TOTALS, ROWS, LINKED, PLAYER_TOTALS, PLAYER_SEASON = (1 << i for i in range(9))


def presence(t: dict[str, DataFrame]) -> DataFrame:
    """All that the integrity checks ask, from one scan of each table and one aggregation of their tagged union: for teams of a
    season (kind t) the bits of what they are found in, for matchups (m) their number, for games (g) their sides and the teams
    of their player rows, a list as long as a game's roster."""
    none = F.lit(None).cast("string")

    def row(kind: str, season, key, bits=0, n=0, home=none, away=none, team=none):
        return F.struct(F.lit(kind).alias("kind"), season.alias("season_id"), key.cast("string").alias("key"), F.lit(bits).cast("int").alias("bits") if isinstance(bits, int) else bits.cast("int").alias("bits"), F.lit(n).alias("n"), home.alias("home"), away.alias("away"), team.alias("team"))

    c = F.col
    final = F.when(c("status") == "final", FINAL).otherwise(0)
    matchup = F.to_json(F.struct("home_team_id", "away_team_id", "game_date"))
    of_games = t["games"].select(
        F.inline(
            F.array(
                row("t", c("season_id"), c("home_team_id"), F.lit(PLAYS | HOME).bitwiseOR(final)),
                row("t", c("season_id"), c("away_team_id"), F.lit(PLAYS).bitwiseOR(final)),
                row("m", c("season_id"), matchup, n=1),
                row("g", none, c("id"), home=c("home_team_id"), away=c("away_team_id")),
            )
        )
    )
    linked = F.when(c("player_id").isNotNull(), LINKED).otherwise(0)
    of_stats = t["player_game_stats"].select(F.inline(F.array(row("t", c("season_id"), c("team_id"), F.lit(ROWS).bitwiseOR(linked)), row("g", none, c("game_id"), team=c("team_id")))))
    parts = [of_games, of_stats]
    for name, bit in (("team_seasons", SEASON), ("team_season_stats", TOTALS), ("player_season_stats", PLAYER_TOTALS), ("player_seasons", PLAYER_SEASON)):
        parts.append(t[name].select(F.inline(F.array(row("t", c("season_id"), c("team_id"), bit)))))
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("kind", "season_id", "key").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"), F.max("home").alias("home"), F.max("away").alias("away"), F.collect_list("team").alias("teams"))


def integrity(tables: dict[str, DataFrame], season: str | None = None) -> DataFrame:
    """Violations of each integrity check, in the whole or one season, from one pass over the tables (`presence`). Games have a
    home and an away team; a player row without a team strays nowhere."""
    t = {k: v.filter(F.col("season_id") == season) if season and "season_id" in v.columns else v for k, v in tables.items()}
    has = lambda *bits: (F.col("kind") == "t") & (F.col("bits").bitwiseAND(sum(bits)) == sum(bits))
    lacks = lambda bit: F.col("bits").bitwiseAND(bit) == 0
    one = lambda test: F.sum(test.cast("long"))
    strays = F.size(F.filter("teams", lambda x: (x != F.col("home")) & (x != F.col("away"))))
    counts = {
        "duplicate matchups": one((F.col("kind") == "m") & (F.col("n") > 1)),
        "teams without games": one(has(SEASON) & lacks(PLAYS)),
        "teams without season stats": one(has(SEASON) & lacks(TOTALS)),
        "orphan home teams": one(has(HOME) & lacks(SEASON)),
        "finals without player rows": one(has(FINAL) & lacks(ROWS)),
        "linked rows without seasons": one(has(LINKED) & lacks(PLAYER_TOTALS)) + one(has(LINKED) & lacks(PLAYER_SEASON)),
        "stray teams": F.sum(F.when((F.col("kind") == "g") & F.col("home").isNotNull(), strays).otherwise(0)),
    }
    summed = presence(t).agg(*[F.coalesce(x, F.lit(0)).cast("long").alias(n) for n, x in counts.items()])
    return summed.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(f"`{n}`").alias("violations")) for n in counts])))
