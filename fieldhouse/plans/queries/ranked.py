"""Rankings."""

import re

from pyspark.sql import functions as F

from fieldhouse.operators import rankings, weekly
from fieldhouse.registry import query
from fieldhouse.storage import written


def rpi_sql(games: str, by: str = "season_id") -> str:
    """The rpi of each team of a games relation, by season or by more keys."""
    keys = [k.strip() for k in by.split(",")]
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys)
    of = lambda a: ", ".join(f"{a}.{k}" for k in keys)
    return f"""
m AS (SELECT {by}, home_team_id t, away_team_id o, home_score f, away_score a FROM {games} WHERE status = 'final' UNION ALL SELECT {by}, away_team_id, home_team_id, away_score, home_score FROM {games} WHERE status = 'final'),
e AS (SELECT {by}, t, o, count(*) n, sum(CASE WHEN f > a THEN 1 ELSE 0 END) w, sum(CASE WHEN f < a THEN 1 ELSE 0 END) l FROM m GROUP BY {by}, t, o),
r AS (SELECT {by}, t, sum(w) w, sum(l) l FROM e GROUP BY {by}, t),
p AS (SELECT {of('e')}, e.t, CAST(sum(CASE WHEN r.w + r.l - e.w - e.l > 0 THEN e.n * CAST(r.w - e.l AS DOUBLE) / (r.w + r.l - e.w - e.l) END) AS DOUBLE) / sum(CASE WHEN r.w + r.l - e.w - e.l > 0 THEN e.n END) owp FROM e JOIN r ON {on('r', 'e')} AND r.t = e.o GROUP BY {of('e')}, e.t),
q AS (SELECT {of('e')}, e.t, sum(e.n * coalesce(p.owp, 0)) / sum(e.n) oowp FROM e JOIN p ON {on('p', 'e')} AND p.t = e.o GROUP BY {of('e')}, e.t),
rpi AS (SELECT {of('r')}, r.t AS team_id, CAST(r.w AS BIGINT) wins, CAST(r.l AS BIGINT) losses, CAST(round(CAST(0.25 * coalesce(CAST(r.w AS DOUBLE) / nullif(r.w + r.l, 0), 0) + 0.5 * coalesce(p.owp, 0) + 0.25 * coalesce(q.oowp, 0) AS DECIMAL(18, 9)), 6) AS DOUBLE) rpi FROM r JOIN p ON {on('p', 'r')} AND p.t = r.t JOIN q ON {on('q', 'r')} AND q.t = r.t)"""


_R = "team_id", "wins", "losses", "rpi"


@query("r01_rpi", f"WITH {rpi_sql('fx_games')} SELECT season_id, team_id, wins, losses, rpi FROM rpi")
def _(t):
    return rankings.rpi(t.games).select("season_id", *_R)


def _fit_sql(by: str, weight: str = "1.0") -> str:
    """What least squares must give back for each team: the weighted sum of its clamped margins (normal equations), and a
    zero for the mean rating. 0 in groups with fewer games than teams."""
    return f"""
WITH g AS (SELECT *, {weight} AS v, greatest(least(home_score - away_score, 8), -8) AS m, max(game_date) OVER (PARTITION BY {by}) AS last FROM fx_games WHERE status = 'final'),
s AS (SELECT {by}, home_team_id AS team_id, v, m, last, game_date FROM g UNION ALL SELECT {by}, away_team_id, v, -m, last, game_date FROM g),
t AS (SELECT {by}, team_id, sum(v * m) AS fitted, count(*) AS games FROM s GROUP BY {by}, team_id),
n AS (SELECT {by}, sum(games) / 2 AS games, count(*) AS teams FROM t GROUP BY {by})
SELECT {', '.join('t.' + k.strip() for k in by.split(','))}, team_id, t.games, CASE WHEN n.games >= n.teams AND n.teams >= 2 THEN round(CAST(fitted AS DOUBLE), 5) + 0.0 ELSE 0.0 END AS fitted, 0.0 AS mean_rating
FROM t JOIN n ON {' AND '.join(f't.{k.strip()} = n.{k.strip()}' for k in by.split(','))}"""


def _fitted(t, by: list[str], rate: float | None = None):
    """The weighted margins that the ratings explain, summed by team, and the mean rating of the group."""
    # stored: two runs of one solution may differ where a long schedule says little, and both sides must be of one
    rated = written(rankings.massey(t.games, by, rate=rate), "rated")
    pairs = rankings.margins(t.games, by, rate=rate)
    sides = pairs.select(*by, F.inline(F.array(F.struct(F.col("h").alias("team_id"), F.col("a").alias("o"), "v", "n"), F.struct(F.col("a").alias("team_id"), F.col("h").alias("o"), "v", "n"))))
    other = rated.select(*by, F.col("team_id").alias("o"), F.col("rating").alias("theirs"))
    joined = sides.join(rated, [*by, "team_id"]).join(other, [*by, "o"])
    fitted = joined.groupBy(*by, "team_id").agg(F.sum("n").alias("games"), (F.round(F.sum(F.col("v") * (F.col("rating") - F.col("theirs"))), 5) + 0.0).alias("fitted"))
    mean = rated.groupBy(*by).agg((F.round(F.avg("rating"), 6) + 0.0).alias("mean_rating"))
    return fitted.join(mean, by)


@query("r02_massey_fit", _fit_sql("season_id, division_id"))
def _(t):
    return _fitted(t, ["season_id", "division_id"])


@query("r03_massey_recency_fit", _fit_sql("season_id", "exp(-0.02 * date_diff('day', game_date, max(game_date) OVER (PARTITION BY season_id)))"))
def _(t):
    return _fitted(t, ["season_id"], 0.02)


@query("r02_massey")
def _(t):
    return rankings.massey(t.games, ["season_id", "division_id"]).withColumn("rating", F.round("rating", 6))


@query("r03_massey_recency")
def _(t):
    return rankings.massey(t.games, rate=0.02).withColumn("rating", F.round("rating", 6))


_POST = "SELECT season_id, team_id, sum(goals_for - goals_against) AS m, count(*) AS n FROM d_sides GROUP BY season_id, team_id"


@query("r04_posterior", f"SELECT season_id, team_id, round((m / 16.0) / (1 + n / 16.0), 9) AS mu, round(1 / (1 + n / 16.0), 9) AS var FROM ({_POST}) x")
def _(t):
    return rankings.posterior(t.games).select("season_id", "team_id", F.round("mu", 9).alias("mu"), F.round("var", 9).alias("var"))


SIMS = 1000
_U = "((CAST('0x' || substr(md5({0}), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0)"


def _normal(*parts: str) -> str:
    key = " || '|' || ".join(parts)
    return f"sqrt(-2 * ln({_U.format(chr(39) + 'r|' + chr(39) + ' || ' + key)})) * cos(2 * 3.141592653589793 * {_U.format(chr(39) + 'a|' + chr(39) + ' || ' + key)})"


def _projected(prior: str) -> str:
    strength = f"SELECT x.season_id, x.team_id, (coalesce(z.mu0, 0) + m / 16.0) / (1 + n / 16.0) AS mu, 1 / (1 + n / 16.0) AS var FROM ({_POST}) x LEFT JOIN ({prior}) z ON z.season_id = x.season_id AND z.team_id = x.team_id"
    s = lambda team, a: f"({a}.mu + sqrt({a}.var) * {_normal('CAST(sim AS VARCHAR)', team, chr(39) + '42' + chr(39), 'g.season_id')})"
    game = "'g|' || CAST(sim AS VARCHAR) || '|' || g.id || '|42|' || g.season_id"
    return f"""
strength AS ({strength}), sims AS (SELECT CAST(range AS INT) AS sim FROM range({SIMS})),
drawn AS (SELECT g.season_id, sim, g.home_team_id, g.away_team_id, {_U.format(game)} < 1 / (1 + exp(-0.4 * ({s('g.home_team_id', 'h')} - {s('g.away_team_id', 'a')}))) AS home FROM fx_games g
  JOIN strength h ON h.season_id = g.season_id AND h.team_id = g.home_team_id JOIN strength a ON a.season_id = g.season_id AND a.team_id = g.away_team_id CROSS JOIN sims WHERE g.status = 'scheduled'),
every AS (SELECT season_id, sim, home_team_id, away_team_id, home_score, away_score, 'final' AS status FROM fx_games CROSS JOIN sims WHERE status = 'final' AND season_id IN (SELECT season_id FROM drawn)
  UNION ALL SELECT season_id, sim, home_team_id, away_team_id, CASE WHEN home THEN 10 ELSE 7 END, CASE WHEN home THEN 7 ELSE 10 END, 'final' FROM drawn), {rpi_sql('every', 'season_id, sim')}"""


def _percentile(q: str) -> str:
    return f"CAST(round(CAST(quantile_cont(round(rpi * 1e6), {q}) AS DECIMAL(18, 4))) AS DOUBLE) / 1e6"


_BAND = f"SELECT season_id, team_id, {_percentile('0.5')} AS median, {_percentile('0.05')} AS low, {_percentile('0.95')} AS high FROM rpi GROUP BY season_id, team_id"


@query("r05_projected_flat", f"WITH {_projected('SELECT NULL AS season_id, NULL AS team_id, NULL AS mu0 WHERE false')} {_BAND}")
def _(t):
    return rankings.project_rpi(t.games, t.games.filter("status = 'scheduled'"), n_sims=SIMS)


_PRIOR = "SELECT CAST(CAST(season_id AS INT) + 1 AS VARCHAR) AS season_id, team_id, (rpi - 0.5) * 10 AS mu0 FROM past.rpi WHERE rpi <> 0"
#: Last season's rpi, under names of its own.
_PAST = re.sub(r"\b(m|e|r|p|q|rpi) AS \(", r"past_\1 AS (", re.sub(r"\b(FROM|JOIN) (m|e|r|p|q)\b", r"\1 past_\2 \2", rpi_sql("fx_games")))


@query("r06_projected_seeded", f"WITH {_PAST}, {_projected(_PRIOR.replace('past.rpi', 'past_rpi'))} {_BAND}")
def _(t):
    return rankings.project_rpi(t.games, t.games.filter("status = 'scheduled'"), _priors(t), n_sims=SIMS)


def _priors(t):
    return rankings.prior_season(t.rankings)


#: wins, rpi and division of r07; the other rankings have no SQL.
R07_PART_SQL = f"WITH {rpi_sql('fx_games')} SELECT r.season_id, r.team_id, r.wins, r.rpi, d.division_id FROM rpi r JOIN (SELECT season_id, team_id, arg_max(division_id, strftime(game_date, '%Y%m%d') || id) AS division_id FROM d_sides GROUP BY season_id, team_id) d ON d.season_id = r.season_id AND d.team_id = r.team_id"


@query("r07_all_rankings")
def _(t):
    return rankings.rank_teams(t.games, t.games.filter("status = 'scheduled'"), _priors(t), n_sims=SIMS)


_STARTS = "make_date(CAST(season_id AS INT), 2, 1)"
_WEEKS = f"SELECT *, greatest(1, CAST(floor((game_date - ({_STARTS} + CAST((8 - isodow({_STARTS})) % 7 AS INT))) / 7.0) AS INT) + 1) AS week FROM fx_games WHERE status = 'final'"


_HIST = f"wk AS ({_WEEKS}), lastw AS (SELECT season_id, max(week) AS last_week FROM wk GROUP BY season_id), hist AS (SELECT wk.*, CAST(n.n AS INT) AS week_number FROM wk JOIN lastw USING (season_id) JOIN (SELECT range AS n FROM range(1, 60)) n ON n.n >= wk.week AND n.n <= last_week)"
#: wins, losses and rpi of r08.
R08_PART_SQL = f"WITH {_HIST}, {rpi_sql('hist', 'season_id, week_number')} SELECT season_id, week_number, team_id, wins, losses, rpi FROM rpi"


def _starts(t):
    return t.games.select("season_id").distinct().withColumn("start_date", F.make_date(F.col("season_id").cast("int"), F.lit(2), F.lit(1)))


@query("r08_weekly_history")
def _(t):
    return rankings.weekly_rankings(t.games, _starts(t), _priors(t), n_sims=SIMS)


_STRENGTHS = """
x AS (SELECT season_id, week_number, team_id, sum(m) AS m, count(*) AS n, arg_max(division_id, strftime(game_date, '%Y%m%d') || id) AS division_id FROM (
  SELECT season_id, week_number, home_team_id AS team_id, home_score - away_score AS m, division_id, game_date, id FROM hist UNION ALL SELECT season_id, week_number, away_team_id, away_score - home_score, division_id, game_date, id FROM hist) s GROUP BY ALL)"""


@query("r08_weekly_ratings", f"WITH {_PAST}, {_HIST}, {rpi_sql('hist', 'season_id, week_number')}, prior AS ({_PRIOR.replace('past.rpi', 'past_rpi')}), {_STRENGTHS} SELECT rpi.season_id, rpi.week_number, rpi.team_id, wins, losses, rpi, division_id, round((m / 16.0) / (1 + n / 16.0), 9) AS mu_flat, round((coalesce(mu0, 0) + m / 16.0) / (1 + n / 16.0), 6) AS mu_seeded, round(1 / (1 + n / 16.0), 9) AS var_flat, round(1 / (1 + n / 16.0), 9) AS var_seeded FROM rpi JOIN x ON x.season_id = rpi.season_id AND x.week_number = rpi.week_number AND x.team_id = rpi.team_id LEFT JOIN prior z ON z.season_id = rpi.season_id AND z.team_id = rpi.team_id")
def _(t):
    """Record, rpi, division and strengths of each week; its margin ratings have a query of their own."""
    cube = weekly.Cube(t.games, _starts(t))
    keys = [*weekly.BY, "team_id"]
    own = cube.strengths(written(_priors(t), "priors"))
    rounded = {c: F.round(c, places) for c, places in (("mu_flat", 9), ("var_flat", 9), ("mu_seeded", 6), ("var_seeded", 9))}
    out = cube.rpi().join(own.withColumns(rounded).select(*keys, "division_id", *rounded), keys)
    return out.select(*keys, "wins", "losses", "rpi", "division_id", "mu_flat", "mu_seeded", "var_flat", "var_seeded")


_WEEKLY_FIT = f"""
WITH {_HIST}, g AS (SELECT season_id, week_number, home_team_id AS t, greatest(least(home_score - away_score, 8), -8) AS m FROM hist UNION ALL SELECT season_id, week_number, away_team_id, -greatest(least(home_score - away_score, 8), -8) FROM hist),
s AS (SELECT season_id, week_number, t AS team_id, sum(m) AS fitted, count(*) AS games FROM g GROUP BY ALL),
n AS (SELECT season_id, week_number, sum(games) / 2 AS games, count(*) AS teams FROM s GROUP BY ALL)
SELECT season_id, week_number, team_id, s.games, CASE WHEN n.games >= n.teams AND n.teams >= 2 THEN round(CAST(fitted AS DOUBLE), 5) + 0.0 ELSE 0.0 END AS fitted, 0.0 AS mean_rating FROM s JOIN n USING (season_id, week_number)"""


@query("r08_weekly_massey_fit", _WEEKLY_FIT)
def _(t):
    """What the ratings of each week explain: the normal equations, and a zero for the mean."""
    cube = weekly.Cube(t.games, _starts(t))
    rated = written(cube.massey(), "weekly-massey")
    # a team's ratings as one array; pairs take the weeks of theirs, which are spelled out where a team's rows are together
    listed = rated.groupBy("season_id", "team_id").agg(F.min("week_number").alias("first"), F.array_sort(F.collect_list(F.struct("week_number", "rating")))["rating"].alias("ratings"))
    other = listed.select("season_id", F.col("team_id").alias("o"), F.col("first").alias("o_first"), F.col("ratings").alias("theirs"))
    pairs = cube.pairs.select("season_id", F.col("t").alias("team_id"), "o", "n", "from", "to").join(other, ["season_id", "o"])
    pairs = pairs.select("season_id", "team_id", "n", "from", F.slice("theirs", F.col("from") - F.col("o_first") + 1, F.col("to") - F.col("from") + 1).alias("theirs"))
    joined = pairs.join(listed, ["season_id", "team_id"]).select("season_id", "team_id", "n", "from", "first", "ratings", F.posexplode("theirs").alias("at", "theirs"))
    joined = joined.select("season_id", "team_id", "n", "theirs", (F.col("from") + F.col("at")).alias("week_number"), F.col("ratings")[F.col("from") + F.col("at") - F.col("first")].alias("rating"))
    fitted = joined.groupBy(*weekly.BY, "team_id").agg(F.sum("n").alias("games"), (F.round(F.sum(F.col("n") * (F.col("rating") - F.col("theirs"))), 5) + 0.0).alias("fitted"))
    mean = rated.groupBy(*weekly.BY).agg((F.round(F.avg("rating"), 6) + 0.0).alias("mean_rating"))
    return fitted.join(mean, weekly.BY)


@query("j16_week_expansion", f"WITH wk AS ({_WEEKS}), lastw AS (SELECT season_id, max(week) AS last_week FROM wk GROUP BY season_id) SELECT season_id, CAST(n.n AS INT) AS week_number, count(*) AS games FROM wk JOIN lastw USING (season_id) JOIN (SELECT range AS n FROM range(1, 60)) n ON n.n >= wk.week AND n.n <= last_week GROUP BY season_id, n.n")
def _(t):
    return weekly.Cube(t.games, _starts(t)).games_upto()


@query("j17_prior_season", f"WITH {rpi_sql('fx_games')} SELECT CAST(CAST(season_id AS INT) + 1 AS VARCHAR) AS season_id, team_id, rpi FROM rpi WHERE rpi <> 0")
def _(t):
    return rankings.prior_season(t.rankings)


@query("r09_summary", f"WITH {rpi_sql('fx_games')} SELECT CAST(row_number() OVER (ORDER BY rpi DESC, team_id) AS INT) AS rank, team_id, wins || '-' || losses AS record, rpi, printf('%.4f', rpi) AS rpi_text, 'N/A' AS massey_text, 'N/A' AS massey_recency_text, 'N/A' AS projected_text FROM rpi WHERE season_id = '1997' ORDER BY rpi DESC, team_id LIMIT 30")
def _(t):
    return rankings.summary(rankings.rpi(t.games), "1997")


@query("r09_summary_full")
def _(t):
    """With margin ratings and the projection, of a season with games left."""
    own = t.games.filter("season_id = '2000'")
    return rankings.summary(rankings.rank_teams(own, own.filter("status = 'scheduled'"), n_sims=SIMS), "2000")
