"""Literal cases of the scalar and play functions."""

import pytest
from pyspark.sql import functions as F

from fieldhouse.functions import plays as P
from fieldhouse.functions import scalars as S


def values(spark, inputs, *columns):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string").select("i", *[c.alias(f"c{k}") for k, c in enumerate(columns)]).orderBy("i").collect()
    return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in rows]


CASES = [
    (lambda: S.safe_int("x", 7), ["3", " 3 ", "3.0", "x", "", None], [3, 3, 7, 7, 7, 7]),
    (lambda: S.safe_float("x"), ["3.5", "y", None], [3.5, None, None]),
    (lambda: S.time_to_seconds("x"), ["12:34", "0", "", "1:2:3", "90", "a:b"], [754, 0, 0, 0, 90, 0]),
    (lambda: S.clock_seconds("x"), ["12:34", "", "x"], [754, None, None]),
    (lambda: S.format_seconds(F.col("x").cast("int")), ["754", "5", None], ["12:34", "0:05", "0:00"]),
    (lambda: S.parse_date("x").cast("string"), ["02/01/2025", "2025-02-01", "February 1st 2025", "february 22nd 2025 at 3", "02/30/2025", ""], ["2025-02-01"] * 3 + ["2025-02-22", None, None]),
    (lambda: S.parse_quarter("x"), ["OT", "2OT", "3", "", "x"], [5, 6, 3, 0, 0]),
    (lambda: S.normalize_name("x"), ["Wilson, Flynn", " Jack Lonsinger. ", "A, B, C"], ["Flynn Wilson", "Jack Lonsinger", "B, C A"]),
    (lambda: S.make_slug("x"), ["Johns Hopkins", "St. John's (NY)", "Queens (NC)", "Le Moyne", "Café -- X"], ["johns-hopkins", "st-johns-ny", "queens-nc", "le-moyne", "cafe-x"]),
    (lambda: S.normalize_position("x"), ["MID", "GK", "F/M", "LS", "D/M", "ZZ", "A", None], ["M", "G", "FO", "LSM", None, None, "A", None]),
    (lambda: S.title_case("x"), ["O'BRIEN", "mary-jane SMITH", ""], ["O'Brien", "Mary-Jane Smith", ""]),
    (lambda: S.infer_mascot("x")[1], ["Cornell Big Red", "Ohio State Buckeyes", "Solo", "A B C D E F"], ["Cornell Big Red", "Buckeyes", "", "C D E F"]),
    (lambda: P.classify(F.col("x")), ["GOAL by X Y (man-up)", "Shot by X Y, SAVE Z", "Media timeout", "Clear attempt by X failed", "a save", "", "goal by x"], ["man_up_goal", "shot_on_goal", "timeout", "clear_attempt", None, None, "goal"]),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_literal_cases(spark, k):
    make, inputs, want = CASES[k]
    assert values(spark, inputs, make()) == want


EVENTS = {
    "GOAL by BRY Jack Lonsinger (FIRST GOAL), goal number 18 for season.": [("Jack Lonsinger", "goals")],
    "GOAL by BING Wilson, Flynn, Assist by Sharkey, Nolan.": [("Flynn Wilson", "goals"), ("Nolan Sharkey", "assists")],
    "Shot by BING Girolamo, Andrew, SAVE Scott Einarson": [("Andrew Girolamo", "shots"), ("Andrew Girolamo", "shots_on_goal"), ("Scott Einarson", "saves")],
    "Turnover by BING Wilson, Flynn (caused by Drew Lucas).": [("Flynn Wilson", "turnovers"), ("Drew Lucas", "caused_turnovers")],
    "Faceoff Wilson, Flynn vs Jj Murphy won by BING": [("Flynn Wilson", "faceoffs_taken"), ("Jj Murphy", "faceoffs_taken")],
    "": [],
}


def test_event_stats(spark):
    got = values(spark, list(EVENTS), P.event_stats(F.col("x")))
    assert [[(e["player"], e["stat"]) for e in row] for row in got] == list(EVENTS.values())


def test_epoch_and_weeks(spark):
    row = spark.range(1).select(
        S.epoch_to_game_date(F.lit(1738450800)).alias("a"), S.epoch_to_game_date(F.lit(0)).alias("b"), S.week_one(F.to_date(F.lit("2025-02-01"))).cast("string").alias("c"), S.week_number(F.to_date(F.lit("2025-02-10")), F.to_date(F.lit("2025-02-01"))).alias("d"), S.week_number(F.to_date(F.lit("2025-02-01")), F.to_date(F.lit("2025-02-01"))).alias("e")
    ).first()
    assert tuple(row) == ("February 1st 2025", "", "2025-02-03", 2, 0)
