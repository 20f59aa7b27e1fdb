"""Public holidays by rule, as columns: dates of any year from its number, without a calendar table.

US: federal holidays, and the day before or after where one falls on a weekend. GB: England and Wales. IE: Ireland. In GB and IE a holiday on
a weekend has its substitute on the next working day that is none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One-off changes by proclamation (country, date added, date taken away).
ONE_OFF = [
    ("GB", "2020-05-08", "2020-05-04"), ("GB", "2022-06-02", "2022-05-30"), ("GB", "2022-06-03", None), ("GB", "2022-09-19", None), ("GB", "2023-05-08", None), ("IE", "2022-03-18", None),
]


def _day(year: Column, month: int, day: int) -> Column:
    return F.make_date(year, F.lit(month), F.lit(day))


def nth_weekday(year: Column, month: int, weekday: int, n: int) -> Column:
    """The n-th (from 1) of a weekday (Monday 0) in a month; -1 is the last."""
    if n > 0:
        first = _day(year, month, 1)
        return F.date_add(first, F.pmod(F.lit(weekday) - F.weekday(first), F.lit(7)) + 7 * (n - 1))
    last = F.last_day(_day(year, month, 1))
    return F.date_sub(last, F.pmod(F.weekday(last) - F.lit(weekday), F.lit(7)))


def easter(year: Column) -> Column:
    """Easter Sunday of the Gregorian calendar, by the epact and the Sunday letter."""
    div = lambda a, b: F.floor(a / b).cast("int")
    century = div(year, 100)
    moon = F.pmod(19 * F.pmod(year, F.lit(19)) + century - div(century, 4) - div(century - div(century + 8, 25) + 1, 3) + 15, F.lit(30))
    sunday = F.pmod(32 + 2 * F.pmod(century, F.lit(4)) + 2 * div(F.pmod(year, F.lit(100)), 4) - moon - F.pmod(year, F.lit(4)), F.lit(7))
    late = div(F.pmod(year, F.lit(19)) + 11 * moon + 22 * sunday, 451)
    return F.date_add(_day(year, 3, 22), moon + sunday - 7 * late)


def _nearest(date: Column) -> Column:
    """Saturday's holiday is kept on Friday, Sunday's on Monday."""
    return F.when(F.weekday(date) == 5, F.date_sub(date, 1)).when(F.weekday(date) == 6, F.date_add(date, 1)).otherwise(date)


def _next_monday(date: Column) -> Column:
    return F.when(F.weekday(date) >= 5, F.date_add(date, 7 - F.weekday(date))).otherwise(date)


def _christmas(year: Column) -> list[Column]:
    """Both days and their substitutes."""
    first, second = _day(year, 12, 25), _day(year, 12, 26)
    # from a weekend on, substitutes are the Monday and Tuesday after
    away = F.when(F.weekday(first) == 5, F.array(_day(year, 12, 27), _day(year, 12, 28))).when(F.weekday(first) == 6, F.array(_day(year, 12, 27))).when(F.weekday(first) == 4, F.array(_day(year, 12, 28))).otherwise(F.array().cast("array<date>"))
    return [F.concat(F.array(first, second), away)]


def _rules(country: str, year: Column) -> list[Column]:
    """Arrays of a year's dates."""
    one = lambda d: F.array(d)
    both = lambda d, shift: F.array(d, shift(d))
    if country == "US":
        fixed = [_day(year, 1, 1), _day(year, 7, 4), _day(year, 11, 11), _day(year, 12, 25)]
        floating = [nth_weekday(year, *x) for x in ((1, 0, 3), (2, 0, 3), (5, 0, -1), (9, 0, 1), (10, 0, 2), (11, 3, 4))]
        june = F.when(year >= 2021, both(_day(year, 6, 19), _nearest)).otherwise(F.array().cast("array<date>"))
        return [*(both(d, _nearest) for d in fixed), both(_day(year + 1, 1, 1), _nearest), *map(one, floating), june]
    spring = [one(F.date_add(easter(year), 1))]
    if country == "GB":
        floating = [nth_weekday(year, *x) for x in ((5, 0, 1), (5, 0, -1), (8, 0, -1))]
        return [both(_day(year, 1, 1), _next_monday), one(F.date_sub(easter(year), 2)), *spring, *map(one, floating), *_christmas(year)]
    if country == "IE":
        floating = [nth_weekday(year, *x) for x in ((5, 0, 1), (6, 0, 1), (8, 0, 1), (10, 0, -1))]
        first = _day(year, 2, 1)
        february = F.when(year >= 2023, F.array(F.when(F.weekday(first) == 4, first).otherwise(nth_weekday(year, 2, 0, 1)))).otherwise(F.array().cast("array<date>"))
        return [both(_day(year, 1, 1), _next_monday), both(_day(year, 3, 17), _next_monday), *spring, february, *map(one, floating), *_christmas(year)]
    raise ValueError(f"no holiday rules for {country}")


def holiday_table(spark: SparkSession, first_year: int, last_year: int, countries: tuple[str, ...] = ("US", "IE", "GB")) -> DataFrame:
    """country, date of these years' holidays, weekend days and their substitutes both."""
    years = spark.range(first_year - 1, last_year + 1).select(F.col("id").cast("int").alias("year"))
    out = None
    for country in countries:
        dates = years.select(F.lit(country).alias("country"), F.explode(F.array_distinct(F.concat(*_rules(country, F.col("year"))))).alias("date"))
        out = dates if out is None else out.unionByName(dates)
    gone = [(c, taken) for c, _, taken in ONE_OFF if taken and c in countries]
    for country, taken in gone:
        out = out.filter(~((F.col("country") == country) & (F.col("date") == F.lit(taken).cast("date"))))
    for country, added, _ in ONE_OFF:
        if country in countries:
            out = out.unionByName(spark.range(1).select(F.lit(country).alias("country"), F.lit(added).cast("date").alias("date")))
    return out.filter(F.year("date").between(first_year, last_year)).distinct()
