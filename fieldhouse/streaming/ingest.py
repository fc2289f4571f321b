"""Incremental daily ingest: a stream over landed game files that upserts each batch and reruns what depends on it.

The stream reads only files it has not seen (its checkpoint remembers them) and stops when none are left. Files that are sent
again are dropped before anything is merged: the stream's state holds, for each game and kind of file, the digest of the last
body. A later file of the same game updates it by the upsert rules, so late scores need no watermark. A batch touches the
seasons of its files only: of each table it writes a new version of those seasons, and all tables of a batch become visible
by one commit record (fieldhouse.versions). A batch that runs again after a failure starts from the state before it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldhouse.operators.load import anti, keep_first, upsert_games
from fieldhouse.sources import documents
from fieldhouse.versions import Batch, Store

FILE = "value string"


def current(spark: SparkSession, table: str, before: int | None = None, seasons: list[str] | None = None) -> DataFrame:
    """The current rows of a table by its folder (of the given seasons), as the newest commit says."""
    found = Store(spark, os.path.dirname(table)).read(os.path.basename(table), before, seasons)
    if found is None:
        raise ValueError(f"no committed rows of {table}")
    return found


def _merged(batch: Batch, name: str, new: DataFrame, seasons: list[str], merge: Callable) -> None:
    """Puts the touched seasons' rows before the batch, merged with the new ones."""
    old = batch.before(name, seasons)
    batch.put(name, new if old is None else merge(old.select(*new.columns), new), seasons)


def changed_files(lines: DataFrame) -> DataFrame:
    """Of a stream of (value, path) files those whose body is not that of the last file of the same game and kind. Each game's
    state is one digest."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    keys = ["season_id", "division_id", "source", "kind", "game_id"]
    keyed = documents.keyed(lines)
    return keyed.groupBy(*keys).applyInPandasWithState(_fresh, "path string, value string", "digest string", "append", GroupStateTimeout.NoTimeout)


def _fresh(_, parts, state):
    """A game's files, by path, that differ from the one before. Called for each game, mostly with one file: plain lists, since a
    sort or a concatenation of frames takes longer than all else."""
    import hashlib

    import pandas as pd

    last = state.get[0] if state.exists else None
    paths, values = [], []
    for path, body in sorted((r for part in parts for r in zip(part["path"], part["body"])), key=lambda r: r[0]):
        digest = hashlib.sha256((body or "").encode()).hexdigest()
        if digest != last:
            paths.append(path)
            values.append(body)
        last = digest
    state.update((last,))
    if paths:
        yield pd.DataFrame({"path": paths, "value": values})


def replaced_games(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of games that come again replace those games' old rows."""
    return anti(old, new.select("game_id").distinct(), ["game_id"]).unionByName(new)


def games_of(lines: DataFrame) -> DataFrame:
    """Canonical games of (value, path) rows, one for each game: the later path wins."""
    good, _ = documents.readable(documents.keyed(lines))
    return keep_first(documents.game_info(good), ["id"], [F.col("home_score").isNull(), F.desc("path")]).drop("path")


def files(spark: SparkSession, base: str, pattern: str = "*.json") -> DataFrame:
    """The stream of (value, path) over the files under a landing folder."""
    text = spark.readStream.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return text.schema(FILE).format("text").load(base).select("value", F.col("_metadata.file_path").alias("path"))


def packed(spark: SparkSession, folder: str) -> DataFrame:
    """The same over a packed landing folder, to which landing jobs add files."""
    return spark.readStream.schema(documents.LANDED).json(folder).select("value", "path")


def _run(stream: DataFrame, checkpoint: str, merge: Callable[[DataFrame, int], None]) -> None:
    changed_files(stream).writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(merge).start().awaitTermination()


def _seasons(rows: DataFrame) -> list[str]:
    return sorted(r["season_id"] for r in rows.select("season_id").distinct().collect())


def _per_batch(out: str, work: Callable[[Batch, DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """work(batch, its files) under one commit. A batch of nothing but repeated files commits nothing."""

    def merge(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        try:
            if rows.isEmpty():
                return
            store = Store(rows.sparkSession, out)
            store.clear(number)
            with store.batch(number) as batch:
                work(batch, rows)
        finally:
            rows.unpersist()

    return merge


def ingest_games(spark: SparkSession, base: str, table: str, checkpoint: str) -> None:
    """Processes all new info files under base into table, then stops."""

    def work(batch: Batch, rows: DataFrame) -> None:
        new = games_of(rows)
        if seasons := _seasons(new):
            _merged(batch, os.path.basename(table), new, seasons, upsert_games)

    _run(files(spark, base, "*_info.json"), checkpoint, _per_batch(os.path.dirname(table), work))


def one_of_each_matchup(old: DataFrame, new: DataFrame) -> DataFrame:
    """Games with the new ones merged in; of games of the same teams on the same date the smallest id."""
    return keep_first(upsert_games(old, new), ["home_team_id", "away_team_id", "game_date"], ["id"])


def ingest(
    spark: SparkSession, base: str, out: str, checkpoint: str, teams: DataFrame, roster: DataFrame, derive: Callable[[dict[str, DataFrame]], dict[str, DataFrame]], stream: DataFrame | None = None
) -> None:
    """Processes all new game files under base (or of a stream of files): games, player_game_stats and game_plays under out,
    the season sums (operators.deltas), and the tables that `derive` makes of the touched seasons' tables (name -> rows with
    season_id), then stops."""
    from fieldhouse.operators import deltas, pbp
    from fieldhouse.plans import daily

    def work(batch: Batch, rows: DataFrame) -> None:
        found = documents.keyed(rows)
        good, _ = documents.readable(found)
        seasons = _seasons(found)
        if not seasons:
            return
        games = keep_first(daily.game_rows(documents.game_info(good), teams), ["id"], [F.col("home_score").isNull(), F.desc("path")]).drop("path", "source")
        _merged(batch, "games", games, seasons, one_of_each_matchup)
        tables = {"games": batch.read("games", seasons)}
        named = tables["games"] if tables["games"] is not None else games
        stats = daily.stat_rows(documents.player_stats(good), named, roster).drop("path", "pos", "src_rank")
        _merged(batch, "player_game_stats", stats, seasons, replaced_games)
        plays = pbp.canonical_plays(documents.in_columns(documents.raw_plays(good), named)).join(named.select(F.col("id").alias("game_id"), "season_id"), "game_id")
        _merged(batch, "game_plays", plays, seasons, replaced_games)
        tables = {"games": named} | {name: rows if (rows := batch.read(name, seasons)) is not None else made for name, made in (("player_game_stats", stats), ("game_plays", plays))}
        # the sums change by the difference of the touched seasons' changed games
        before = tuple(batch.before(name, seasons) for name in ("games", "player_game_stats"))
        deltas.apply(batch, seasons, *_touched(before, (named, tables["player_game_stats"])))
        for name, made in derive(tables | {"teams": teams}).items():
            batch.put(name, made, seasons)

    _run(stream if stream is not None else files(spark, base), checkpoint, _per_batch(out, work))


def _touched(before: tuple, now: tuple[DataFrame, DataFrame]) -> tuple[tuple | None, tuple[DataFrame, DataFrame]]:
    """Of games and player rows before and now those of games in which either differs."""
    if before[0] is None:
        return None, now
    games = before[0].select(*now[0].columns)
    stats = before[1].select(*now[1].columns) if before[1] is not None else now[1].filter("false")
    digest = lambda df, key: df.select(F.col(key).alias("game_id"), F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).alias("h"))
    sides = [digest(a, "id").unionByName(digest(b, "game_id")).withColumn("sign", F.lit(s)) for a, b, s in ((games, stats, 1), (*now, -1))]
    # a game whose rows are the same, each as often, adds up to nothing
    ids = sides[0].unionByName(sides[1]).groupBy("game_id", "h").agg(F.sum("sign").alias("n")).filter("n <> 0").select("game_id").distinct()
    of = lambda g, s: (g.join(ids.withColumnRenamed("game_id", "id"), "id", "left_semi"), s.join(ids, "game_id", "left_semi"))
    return of(games, stats), of(*now)
