"""Dedup, upsert and replace: the operations that load canonical rows into stored tables.

Parquet tables have no MERGE, so an upsert is one full outer join of target and source with a rule for each column, and
the result is a new table; `replace_season` writes it with dynamic partition overwrite, touching one season only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order. A key may be null: nulls are one key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__place", place).filter("__place = 1").drop("__place")


def dedup_player_stats(stats: DataFrame, order: list) -> DataFrame:
    """One row for (game, player, position); players without an id go by team and name."""
    who = F.coalesce(F.col("player_id").cast("string"), F.concat(F.col("team_id"), F.lit("|"), F.coalesce("player_name", F.lit(""))))
    return keep_first(stats.withColumn("__who", who), ["game_id", "__who", "position"], order).drop("__who")


def anti(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of df whose keys are not in other; null keys equal null keys."""
    right = other.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return df.join(right, same, "left_anti")


def insert_absent(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    return target.unionByName(anti(source, target, keys).select(*target.columns))


def overwrite(old: Column, new: Column, there: Column) -> Column:
    """Rule: the new value wherever there is a new row."""
    return F.when(there, new).otherwise(old)


def prefer_new(old: Column, new: Column, there: Column) -> Column:
    """Rule: the new value unless it is null."""
    return F.coalesce(new, old)


def latch_final(old: Column, new: Column, there: Column) -> Column:
    """Rule: a final game stays final."""
    return F.when((old == "final") | (new == "final"), "final").otherwise(F.coalesce(new, old))


def upsert(target: DataFrame, source: DataFrame, keys: list[str], rules: dict | None = None, default=overwrite) -> DataFrame:
    """target with source merged into it: rules name the columns that do not follow the default rule. One row for each
    key is expected in either; null keys equal null keys."""
    rules = rules or {}
    old = target.select(F.struct(*target.columns).alias("o"))
    new = source.select(F.struct(*target.columns).alias("n"))
    same = reduce(lambda a, b: a & b, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys])
    there = F.col("n").isNotNull()
    joined = old.join(new, same, "full_outer")
    made = [
        (F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in keys else rules.get(c, default)(F.col(f"o.{c}"), F.col(f"n.{c}"), there)).alias(c)
        for c in target.columns
    ]
    return joined.select(*made)


def upsert_games(target: DataFrame, source: DataFrame) -> DataFrame:
    kept = ["home_score", "away_score", "location", "attendance", "ncaa_game_id"]
    rules = {c: prefer_new for c in kept if c in target.columns} | {"status": latch_final}
    return upsert(target, source, ["id"], rules)


def upsert_players(target: DataFrame, source: DataFrame) -> DataFrame:
    return upsert(target, source, ["id"], {"name": overwrite}, prefer_new)


def changed(target: DataFrame, source: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows of source that differ from target in one of the columns."""
    old = target.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    differ = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns])
    return source.join(old, keys).filter(differ).select(*source.columns)


def by_priority(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """All rows of the first source, and of each later one those whose keys no earlier one has."""
    out = sources[0].withColumn("src_rank", F.lit(0))
    for rank, more in enumerate(sources[1:], 1):
        out = out.unionByName(anti(more, out, keys).withColumn("src_rank", F.lit(rank)), allowMissingColumns=True)
    return out


def replace_season(df: DataFrame, path: str, season: str) -> None:
    """Writes one season of a table partitioned by season_id, leaving the others."""
    df.filter(F.col("season_id") == season).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("season_id").parquet(path)


def append_unique(existing: DataFrame, new: DataFrame, key: str = "gameID") -> DataFrame:
    """An append-only register: entries that exist win."""
    return existing.unionByName(anti(keep_first(new, [key], [key]), existing, [key]).select(*existing.columns))


def players_extract(rows: DataFrame, roster: DataFrame) -> DataFrame:
    """One row for each player, the first file wins, with non-blank roster attributes."""
    first = keep_first(rows, ["id"], ["path", "pos"]).select("id", "name")
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit("")).alias(c)
    return first.join(roster.select("id", blank("hometown"), blank("high_school")), "id", "left")
