"""Column expressions for raw field values: numbers, clocks, dates, names, display text."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accepted spellings of position codes, and the codes themselves.
POSITION_ALIASES = {
    "ATT": "A", "ATTACKER": "A", "AM": "A", "MF": "M", "MID": "M", "MIDFIELDER": "M", "DM": "SSDM", "DEF": "D", "DEFENDER": "D", "GK": "G", "GOALKEEPER": "G", "F": "FO", "F/M": "FO", "LS": "LSM",
}
POSITIONS = ("A", "D", "FO", "G", "LSM", "M", "SSDM")


def _column(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_int(x, default: int | None = None) -> Column:
    """The whole number a text spells, blanks around it ignored; anything else is the default."""
    return F.coalesce(F.trim(_column(x).cast("string")).try_cast("int"), F.lit(default))


def safe_float(x, default: float | None = None) -> Column:
    return F.coalesce(F.trim(_column(x).cast("string")).try_cast("double"), F.lit(default).cast("double"))


def clock_seconds(x) -> Column:
    """Seconds of "MM:SS" or of a plain number; null where it is neither or empty."""
    text = F.trim(_column(x))
    parts = F.split(text, ":")
    minutes = F.when(F.size(parts) == 2, F.try_element_at(parts, F.lit(1)).try_cast("int") * 60 + F.try_element_at(parts, F.lit(2)).try_cast("int"))
    return F.when(F.size(parts) == 1, text.try_cast("int")).otherwise(minutes)


def time_to_seconds(x) -> Column:
    return F.coalesce(clock_seconds(x), F.lit(0))


def format_seconds(x, missing: str = "0:00") -> Column:
    s = _column(x)
    return F.coalesce(F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0")), F.lit(missing))


def fixed(x, places: int) -> Column:
    """The number with so many decimals, rounded by its binary value and halves to even. (format_string would round the
    shortest decimal text instead, and halves up.)"""
    return F.replace(F.format_number(_column(x).cast("double"), places), F.lit(","), F.lit(""))


def format_pct(x) -> Column:
    return F.coalesce(fixed(x, 3), F.lit("-"))


def format_record(wins, losses) -> Column:
    return F.concat_ws("-", _column(wins).cast("string"), _column(losses).cast("string"))


def format_cell(x) -> Column:
    """Whole numbers as they are, others with two decimals, null as a dash."""
    v = _column(x).cast("double")
    return F.when(v.isNull(), "-").when(v == F.floor(v), F.floor(v).cast("string")).otherwise(fixed(v, 2))


def parse_date(x) -> Column:
    """MM/DD/YYYY, else ISO, else "Month Dth YYYY" with whatever follows; null where none fits."""
    text = F.trim(_column(x))
    spelled = r"^(\w+)\s+(\d+)(?:st|nd|rd|th)\s+(\d{4})"
    words = F.concat_ws(" ", *[F.regexp_extract(text, spelled, i) for i in (1, 2, 3)])
    return F.coalesce(F.try_to_date(text, "M/d/yyyy"), F.try_to_date(text, "yyyy-M-d"), F.try_to_date(words, "MMMM d yyyy"))


def ordinal(day: Column) -> Column:
    last, teen = day % 10, (day % 100).between(11, 13)
    suffix = F.when(teen, "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th")
    return F.concat(day.cast("string"), suffix)


def epoch_to_game_date(x, zone: str = "America/New_York") -> Column:
    """"Month Dth YYYY" of an epoch second in the zone; empty for null and 0. The session's zone is taken to be UTC."""
    seconds = _column(x)
    local = F.from_utc_timestamp(F.timestamp_seconds(seconds), zone)
    text = F.concat(F.date_format(local, "MMMM "), ordinal(F.dayofmonth(local)), F.date_format(local, " yyyy"))
    return F.when(seconds.isNull() | (seconds == 0), "").otherwise(text)


def season_from_date(x) -> Column:
    d = parse_date(x)
    return F.when(d.isNull(), F.raise_error(F.lit("no season: the date cannot be read"))).otherwise(F.year(d).cast("string"))


def week_one(start) -> Column:
    """The first Monday on or after a date."""
    return F.next_day(F.date_sub(_column(start), 1), "MON")


def week_number(day, start) -> Column:
    """Weeks since week one, from 1; 0 before it."""
    return F.greatest(F.floor(F.datediff(_column(day), week_one(start)) / 7) + 1, F.lit(0)).cast("int")


def format_game_date(x, short: bool = False) -> Column:
    return F.date_format(_column(x), "M/d" if short else "MMM d, yyyy")


def parse_quarter(x) -> Column:
    """OT is 5, nOT is 4 + n, a number itself, anything else 0."""
    text = F.upper(F.trim(_column(x).cast("string")))
    overtime = F.regexp_extract(text, r"^(\d*)OT$", 1)
    return F.when(text.rlike(r"^\d*OT$"), F.coalesce(overtime.try_cast("int"), F.lit(1)) + 4).otherwise(F.coalesce(text.try_cast("int"), F.lit(0)))


def parse_score(x) -> tuple[Column, Column]:
    """Both numbers of "X-Y", null where they are not numbers."""
    parts = F.split(_column(x), "-", 2)
    one, two = (F.trim(F.try_element_at(parts, F.lit(i))).try_cast("int") for i in (1, 2))
    good = one.isNotNull() & two.isNotNull()
    return F.when(good, one), F.when(good, two)


def normalize_position(x) -> Column:
    code = _column(x)
    alias = F.create_map(*[F.lit(v) for pair in POSITION_ALIASES.items() for v in pair])
    mapped = F.coalesce(F.try_element_at(alias, code), code)
    return F.when(mapped.isin(*POSITIONS), mapped)


def title_case(x) -> Column:
    """A capital after every character that is no letter, small letters elsewhere."""
    pieces = F.regexp_extract_all(_column(x), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1_000_000)))), "")


def normalize_team(x) -> Column:
    """Lower case, letters, digits and single spaces only."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(_column(x))), "[^a-z0-9 ]", ""), " +", " ")


def normalize_name(x) -> Column:
    """"Last, First" as "First Last"; blanks and dots at the end go."""
    text = F.trim(F.regexp_replace(F.trim(_column(x)), r"\.+$", ""))
    parts = F.split(text, ",", 2)
    return F.when(text.contains(","), F.concat_ws(" ", F.trim(F.element_at(parts, 2)), F.trim(F.element_at(parts, 1)))).otherwise(text)


def token_overlap(a, b) -> Column:
    """Shared words over all words of two normalised names; 0 if either has none."""
    one, two = (F.filter(F.array_distinct(F.split(normalize_team(x), " ")), lambda w: w != "") for x in (a, b))
    return F.when((F.size(one) == 0) | (F.size(two) == 0), 0.0).otherwise(F.size(F.array_intersect(one, two)) / F.size(F.array_union(one, two)))


def name_confidence(a, b) -> Column:
    """exact where one normalised name holds the other, fuzzy where half of the words are shared, else null."""
    one, two = normalize_team(a), normalize_team(b)
    known = (_column(a) != "") & (_column(b) != "")
    return F.when(known & (one.contains(two) | two.contains(one)), "exact").when(known & (token_overlap(a, b) >= 0.5), "fuzzy")


@cache
def _folding() -> tuple[str, str]:
    """(characters, what each folds to): those whose compatibility decomposition holds one ASCII character."""
    letters, plain = [], []
    for code in range(0x80, 0x10000):
        parts = unicodedata.normalize("NFKD", chr(code))
        ascii_ = [c for c in parts if c < "\x80"]
        if len(ascii_) == 1 and not 0xD800 <= code < 0xE000:
            letters.append(chr(code))
            plain.append(ascii_[0])
    return "".join(letters), "".join(plain)


def make_slug(x) -> Column:
    """Lower-case words and numbers joined by hyphens; apostrophes and dots vanish, brackets count as a word break. Letters
    with accents fold to their ASCII letter; what has none is dropped."""
    plain = F.regexp_replace(F.translate(F.trim(_column(x)), *_folding()), r"[^\x00-\x7F]", "")
    text = F.regexp_replace(F.regexp_replace(F.lower(plain), "['`.]", ""), r"\(([^)]+)\)", "-$1")
    return F.trim(F.regexp_replace(F.regexp_replace(text, "[^a-z0-9-]", "-"), "-+", "-"), F.lit("-"))


#: Words that belong to a school's name, never to its mascot.
SCHOOL_WORDS = ("university", "college", "institute", "school", "academy", "polytechnic", "state", "tech", "a&m", "and", "at", "of", "the")


def infer_mascot(x) -> tuple[Column, Column]:
    """(short name, mascot): the trailing words up to the last school word, four at most, are the mascot."""
    words = F.filter(F.split(F.trim(_column(x)), r"\s+"), lambda w: w != "")
    school = F.transform(words, lambda w: F.lower(w).isin(*SCHOOL_WORDS).cast("int"))
    behind = F.when(F.array_position(F.reverse(school), 1) == 0, F.size(words)).otherwise(F.array_position(F.reverse(school), 1) - 1)
    n = F.when(F.size(words) <= 1, 0).otherwise(F.least(behind, F.lit(4))).cast("int")
    mascot = F.array_join(F.slice(words, F.size(words) - n + 1, n), " ")
    short = F.array_join(F.slice(words, F.lit(1), F.size(words) - n), " ")
    whole = (n == 0) | (F.length(short) < 2)
    return F.when(whole, _column(x)).otherwise(short), mascot


def points(goals="goals", assists="assists") -> Column:
    return _column(goals) + _column(assists)


def clamp(x, most: int = 8) -> Column:
    return F.greatest(F.least(_column(x), F.lit(most)), F.lit(-most))


def decay(days, rate: float = 0.02) -> Column:
    return F.exp(-rate * _column(days))


def win_probability(difference, slope: float = 0.4) -> Column:
    return 1 / (1 + F.exp(-slope * _column(difference)))


def signed(x) -> Column:
    return F.format_string("%+d", _column(x))


def short_team(x, most: int = 12) -> Column:
    return F.substring(_column(x), 1, most)
