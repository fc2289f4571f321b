"""Registered queries against DuckDB on the smallest tables; some in each run, all with ALL_QUERIES=1."""

import datetime
import decimal
import math
import os

import pytest
from pyspark.sql import functions as F

from fieldhouse import registry
from fieldhouse.operators import load, names, rankings

SF = "/root/testdata/sf0.001"
NAMES = sorted(registry.oracle_sql())
CHOSEN = NAMES if os.environ.get("ALL_QUERIES") else NAMES[::9]


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v.isoformat() if isinstance(v, datetime.date) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted([tuple(plain(r[c]) for c in columns) for r in df.collect()], key=str)
    found = con.execute(registry.oracle_sql()[name])
    heads = [d[0] for d in found.description]
    want = sorted([tuple(plain(dict(zip(heads, row))[c]) for c in columns) for row in found.fetchall()], key=str)
    assert sorted(heads) == columns and got == want


def test_massey_is_least_squares_with_zero_mean_parts(spark):
    import numpy as np

    rows = [(f"g{i}", "2025", "final", h, a, hs, as_) for i, (h, a, hs, as_) in enumerate([("a", "b", 9, 2), ("b", "c", 5, 5), ("c", "a", 1, 20), ("a", "b", 3, 4), ("x", "y", 7, 1), ("y", "x", 2, 2)])]
    games = spark.createDataFrame(rows, "id string, season_id string, status string, home_team_id string, away_team_id string, home_score int, away_score int")
    got = {r["team_id"]: r["rating"] for r in rankings.massey(games).collect()}
    teams = sorted(got)
    m = np.array([[(h == t) - (a == t) for t in teams] for _, _, _, h, a, _, _ in rows], float)
    d = np.array([max(-8, min(8, hs - as_)) for *_, hs, as_ in rows], float)
    want = np.linalg.lstsq(m, d, rcond=None)[0]
    assert np.allclose([got[t] for t in teams], want, atol=1e-9)
    assert abs(got["a"] + got["b"] + got["c"]) < 1e-9 and abs(got["x"] + got["y"]) < 1e-9


def test_large_groups_are_rated_and_simulated_alike(spark):
    """Groups beyond a task's share: joins and sums, simulations in rows; the same ratings and bands."""
    import random

    pick = random.Random(3)
    rows = []
    for i in range(90):
        h, a = pick.sample([f"t{k}" for k in range(14)], 2)
        over = i < 70
        rows.append((f"g{i}", "2024" if i % 3 else "2025", 1, datetime.date(2024, 2, 1 + i % 27), h, a, pick.randrange(20) if over else None, pick.randrange(20) if over else None, "final" if over else "scheduled"))
    games = spark.createDataFrame(rows, "id string, season_id string, division_id int, game_date date, home_team_id string, away_team_id string, home_score int, away_score int, status string")
    left, priors = games.filter("status = 'scheduled'"), spark.createDataFrame([("2024", "t1", 0.8), ("2025", "t2", 0.1), ("2025", "zz", 0.3)], "season_id string, team_id string, rpi double")
    for rate in (None, 0.02):
        one, two = ({(r["season_id"], r["team_id"]): r["rating"] for r in rankings.massey(games, rate=rate, most_pairs=n).collect()} for n in (10_000, 1))
        assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-9 for k in one) and any(one.values())
    one, two = (sorted(map(tuple, rankings.project_rpi(games, left, priors, n_sims=20, most_cells=n).collect())) for n in (10**7, 1))
    assert one == two and {r[0] for r in one} == {"2024", "2025"}


def test_blocks_of_simulations_give_the_same_bands(spark):
    games = _small_league(spark)
    finals, left = games.filter("home_score is not null"), games.limit(3).selectExpr("*").withColumn("status", F.lit("scheduled"))
    bands = [sorted(map(tuple, rankings.project_rpi(finals, left, n_sims=20, block=b).collect())) for b in (1, 7, 20, 63)]
    assert bands[0] == bands[1] == bands[2] == bands[3] and len(bands[0]) > 2


def test_upsert_is_idempotent_and_latches(spark):
    schema = "id string, home_score int, away_score int, status string"
    old = spark.createDataFrame([("1", 3, 2, "final"), ("2", None, None, "scheduled")], schema)
    new = spark.createDataFrame([("1", None, None, "scheduled"), ("2", 4, 5, "final"), ("3", None, None, "scheduled")], schema)
    once = load.upsert_games(old, new)
    twice = load.upsert_games(once, new)
    rows = sorted(map(tuple, once.collect()))
    assert rows == sorted(map(tuple, twice.collect())) == [("1", 3, 2, "final"), ("2", 4, 5, "final"), ("3", None, None, "scheduled")]


def test_player_match_order_and_best_rule(spark):
    roster = spark.createDataFrame([("t", 1, "Adam Russet", 0), ("t", 2, "Al Russell", 1), ("t", 3, "Ann Russell", 2)], "team_id string, player_id long, name string, ordinal int")
    refs = spark.createDataFrame([("t", "Ann Russell"), ("t", "Russell"), ("t", "Zed Q")], "team_id string, name string")
    pick = lambda best: {r["name"]: r["player_id"] for r in names.match_players(refs, roster, best).collect()}
    assert pick(False) == {"Ann Russell": 1, "Russell": 2, "Zed Q": None}
    assert pick(True) == {"Ann Russell": 3, "Russell": 2, "Zed Q": None}


def test_fuzzy_game_match(spark):
    stats = spark.createDataFrame([("s1", "2025-02-01", "Team One Lions", "Other Side", 1), ("s2", "2025-02-01", "Gamma", "Delta", 2)], "game_id string, game_date string, home_team string, away_team string, ordinal int")
    feed = spark.createDataFrame([("f1", "2025-02-01", "team one", "Other Place"), ("f2", "2025-02-01", "Delta", "Gamma U"), ("f3", "2025-02-02", "Gamma", "Delta")], "feed_id string, game_date string, home_team string, away_team string")
    got = {r["feed_id"]: (r["stats_id"], r["confidence"]) for r in names.match_games(stats, feed).collect()}
    assert got == {"f1": (None, "unmatched"), "f2": ("s2", "exact"), "f3": (None, "unmatched")}


def _small_league(spark):
    day = datetime.date
    rows = [("a1", "2024", 1, day(2024, 2, 6), "a", "b", 9, 5, "final"), ("a2", "2024", 1, day(2024, 2, 7), "c", "d", 4, 8, "final"), ("a3", "2024", 1, day(2024, 2, 14), "a", "c", 7, 6, "final"), ("a4", "2024", 2, day(2024, 2, 21), "b", "d", 3, 8, "final"), ("a5", "2024", 2, day(2024, 3, 1), "d", "a", None, None, "scheduled")]
    return spark.createDataFrame(rows, "id string, season_id string, division_id int, game_date date, home_team_id string, away_team_id string, home_score int, away_score int, status string")


class _League:
    def __init__(self, spark):
        self.games = _small_league(spark)
        self.rankings = spark.createDataFrame([("2023", "a", 0.9), ("2023", "b", 0.2)], "season_id string, team_id string, rpi double")


def test_all_and_weekly_rankings_are_whole(spark, monkeypatch):
    """r05 to r08 as registered: the reference's number of simulations, and every ranking in r07 and in each week of r08."""
    from fieldhouse.plans.queries import ranked

    t, counts, original = _League(spark), [], rankings.project_rpi
    monkeypatch.setattr(registry, "League", lambda *_: t)
    monkeypatch.setattr(rankings, "project_rpi", lambda games, remaining, priors=None, n_sims=1000, *a, **k: counts.append(n_sims) or original(games, remaining, priors, 20, *a, **k))
    run = lambda name: registry.queries()[name](spark, SF)
    run("r05_projected_flat"), run("r06_projected_seeded")
    names = {"wins", "losses", "rpi", "massey", "massey_recency", *(f"projected_rpi_{k}{e}" for k in ("flat", "seeded") for e in ("", "_low", "_high"))}
    whole = run("r07_all_rankings")
    assert names | {"division_id"} <= set(whole.columns)
    rows = run("r08_weekly_history")
    assert names | {"mu_flat", "mu_seeded", "week_number"} <= set(rows.columns) and set(counts) == {1000} == {ranked.SIMS}
    got = {(r["week_number"], r["team_id"]): r for r in rows.collect()}
    assert {w for w, _ in got} == {1, 2, 3} and len(got) == 12
    # each week by itself equals the rankings of the games played up to it, with the rest of them to come
    upto, left = rankings.weekly(t.games, spark.createDataFrame([("2024", datetime.date(2024, 2, 1))], "season_id string, start_date date"))
    one = {r["team_id"]: r for r in rankings.massey(upto.filter("week_number = 2")).collect()}
    post = {r["team_id"]: r for r in rankings.posterior(upto.filter("week_number = 2")).collect()}
    for k, r in one.items():
        assert abs(got[2, k]["massey"] - r["rating"]) < 1e-9 and abs(got[2, k]["mu_flat"] - post[k]["mu"]) < 1e-9
    assert got[2, "a"]["mu_seeded"] > got[2, "a"]["mu_flat"] and got[2, "c"]["mu_seeded"] == got[2, "c"]["mu_flat"]
    assert left.count() == 3 + 2 + 1 and all(r["projected_rpi_flat_low"] <= r["projected_rpi_flat"] <= r["projected_rpi_flat_high"] for r in got.values())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_r07_and_r08_keep_what_sql_gives(spark):
    duckdb = pytest.importorskip("duckdb")
    from fieldhouse import fixtures
    from fieldhouse.plans.queries import ranked

    con = duckdb.connect()
    for t in fixtures.BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    league = fixtures.League(spark, SF)
    starts = league.games.select("season_id").distinct().selectExpr("season_id", "make_date(cast(season_id as int), 2, 1) start_date")
    upto, _ = rankings.weekly(league.games, starts)
    r07 = rankings.rank_teams(league.games, league.games.filter("status = 'scheduled'"), n_sims=2)
    for df, sql in ((r07, ranked.R07_PART_SQL), (rankings.rpi(upto, ["season_id", "week_number"]), ranked.R08_PART_SQL)):
        found = con.execute(fixtures.with_views(sql, registry.DERIVED))
        heads = [d[0] for d in found.description]
        at = heads.index("rpi")
        key = lambda r: tuple(map(plain, r[:at] + r[at + 1 :]))
        got, want = ({key(r): r[at] for r in map(tuple, rows)} for rows in (df.select(*heads).collect(), found.fetchall()))
        # the engines round halves of the sixth digit apart
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1.5e-6 for k in got)
