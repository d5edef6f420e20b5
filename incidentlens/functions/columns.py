"""Cleaning rules as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules

BLANKS = " \t\n\r\x0b\x0c"
TIMESTAMP_FORMATS = ["MM/dd/yyyy HH:mm:ss", "yyyy-MM-dd HH:mm:ss"]
DATE_FORMATS = ["MM/dd/yyyy", "yyyy-MM-dd"]


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def number(c: Column) -> Column:
    """Text to double; anything that is not a number becomes null (never NaN).

    The JVM would read "1d" and "1f" as numbers, so those letters are made unreadable first.
    """
    plain = F.translate(c.cast("string"), "dDfF", "xxxx")
    return F.nanvl(plain.try_cast("double"), F.lit(None).cast("double"))


def first_match(pairs, condition, default=None) -> Column:
    """`when` chain over (key, value) pairs in order."""
    chain = reduce(lambda acc, kv: acc.when(condition(kv[0]), F.lit(kv[1])), pairs, F)
    return chain if default is None else chain.otherwise(F.lit(default))


def offense_text(c: Column) -> Column:
    return strip(F.upper(c))


def offense_pattern(c: Column) -> Column:
    """Name of the first rule that an upper-case offense text meets, else null."""
    return first_match(
        rules.OFFENSE_PATTERNS,
        lambda p: c.rlike(p) if ".*" in p else c.contains(p))


def offense_type(c: Column) -> Column:
    text = offense_text(c)
    return F.coalesce(offense_pattern(text), text)


def offense_category(c: Column) -> Column:
    """Category of an upper-case offense name."""
    return first_match(rules.OFFENSE_CATEGORIES, c.contains, rules.DEFAULT_CATEGORY)


def severity_weight(c: Column) -> Column:
    """Severity of an upper-case offense name."""
    return first_match(rules.SEVERITY_WEIGHTS, c.contains, rules.DEFAULT_SEVERITY)


def severity_points(c: Column) -> Column:
    """Whole-number severity by exact offense name."""
    return first_match(rules.SEVERITY_POINTS.items(), c.__eq__, rules.DEFAULT_SEVERITY_POINTS)


def age_group(c: Column) -> Column:
    text = strip(F.upper(c))
    return F.when(~text.isin("NAN", "UNKNOWN", ""), text)


def race(c: Column) -> Column:
    text = F.coalesce(strip(F.upper(c)), F.lit("NAN"))
    return F.when(text.contains("UNKNOWN"), "UNKNOWN").otherwise(text)


def sex(c: Column) -> Column:
    letter = F.upper(F.left(strip(c), F.lit(1)))
    return F.when(~letter.isin("N", "U", ""), letter)


def race_label_8(c: Column) -> Column:
    text = F.coalesce(strip(F.upper(c)), F.lit("NAN"))
    chain = F.when(text.isin(rules.RACE_UNKNOWN_WORDS), "UNKNOWN")
    for needed, label in rules.RACE_LABELS_8:
        chain = chain.when(_all([contains_any(text, words) for words in needed]), label)
    return chain.otherwise("OTHER")


def race_label_4(c: Column) -> Column:
    text = F.coalesce(F.upper(c), F.lit("NAN"))
    return first_match(rules.RACE_LABELS_4, lambda words: contains_any(text, words), "OTHER")


def contains_any(c: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def _all(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def timestamp(date: Column, time: Column | None = None) -> Column:
    """Parsed date (and time of day, where given); null when it does not parse."""
    if time is None:
        return F.coalesce(*[F.try_to_timestamp(date, F.lit(f)) for f in DATE_FORMATS])
    both = F.concat_ws(" ", date, time)
    return F.coalesce(
        *[F.try_to_timestamp(both, F.lit(f)) for f in TIMESTAMP_FORMATS],
        *[F.try_to_timestamp(date, F.lit(f)) for f in DATE_FORMATS])


def hour_or_noon(ts: Column) -> Column:
    return F.coalesce(F.hour(ts), F.lit(12))


def weekday_or_monday(ts: Column) -> Column:
    return F.coalesce(F.weekday(ts), F.lit(0))


def time_bucket(hour: Column) -> Column:
    return reduce(
        lambda acc, b: acc.when(hour.between(b[1], b[2]), b[0]), rules.TIME_BUCKETS, F)


def clamp(c: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def round_half_up(c: Column, digits: int) -> Column:
    """Rounding by plain arithmetic: the same bits in every engine."""
    scale = float(10 ** digits)
    return F.floor(c * scale + 0.5) / scale


def safety_level(score: Column) -> Column:
    return first_match(
        rules.SAFETY_LEVELS, lambda bound: score >= bound, rules.LOWEST_SAFETY_LEVEL)


def score_colour(score: Column) -> Column:
    return first_match(
        rules.SCORE_COLOURS, lambda bound: score > bound, rules.LOWEST_SCORE_COLOUR)


def time_decay(days: Column) -> Column:
    chain = F
    for bound, weight in rules.TIME_DECAY:
        chain = chain.otherwise(weight) if bound is None else chain.when(days < bound, weight)
    return chain
