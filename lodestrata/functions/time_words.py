"""Expressions of time in plain words to ranges of days, as columns: `yesterday`, `3 weeks ago`, `last friday`, `November 15`, `2023-05-20`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the grammar: months and days in order, small numbers in words, units.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
NUMBERS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve")
UNITS = ("day", "week", "month", "year")
#: How far an expression with a week is widened on both sides.
WEEK_DAYS = 7


def _place(names: tuple[str, ...], text: Column, letters: int = 3) -> Column:
    """The place from 1 of the name that a text is, whole or by its first letters (three, or four), with a full stop or without; null for others."""
    forms = {form: n for n, name in enumerate(names, 1) for form in (name, *(f"{name[:k]}{dot}" for k in (letters, 4) if letters < 99 for dot in ("", ".")))}
    return F.element_at(F.create_map(*(F.lit(x) for pair in forms.items() for x in pair)), text)


def _day(year: Column, month: Column, day: Column) -> Column:
    """A date; null where there is no such day."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")


def _moved(today: Column, n: Column, unit: Column) -> Column:
    """A date n units later; months and years keep the day, or take the last day of a shorter month."""
    return (
        F.when(unit == "day", F.date_add(today, n)).when(unit == "week", F.date_add(today, n * 7))
        .when(unit == "month", F.add_months(today, n)).when(unit == "year", F.add_months(today, n * 12))
    )


def anchor_day(expression: Column, now: Column) -> Column:
    """The date that an expression means at a time: words are read in any case, between any white space. Null where it isn't understood.

    Without a year the last such day that is not after today is taken; a month alone takes today's day in it, or its last day; a day of the week is the last one before today,
    with `next` the first one after it.
    """
    text = F.trim(F.regexp_replace(F.lower(expression), r"[\s,]+", " "))
    today = now.cast("date")
    part = lambda pattern, n: F.regexp_extract(text, pattern, n)
    number = lambda c: F.coalesce(F.when(c.isin("a", "an"), 1), _place(NUMBERS, c, 99), c.try_cast("int"))
    units = rf"({'|'.join(UNITS)})s?"

    ago = rf"^(\d{{1,4}}|an?|{'|'.join(NUMBERS)}) {units} (ago|from now|later)$"
    within = rf"^in (\d{{1,4}}|an?|{'|'.join(NUMBERS)}) {units}$"
    turn = rf"^(last|past|previous|this|next) {units}$"
    named = r"^(last|past|previous|this|next|on )? ?([a-z]{3,9}\.?)$"
    month_first = r"^([a-z]{3,9}\.?) (\d{1,2})(?:st|nd|rd|th)?(?: (\d{4}))?$"
    day_first = r"^(\d{1,2})(?:st|nd|rd|th)?(?: of)? ([a-z]{3,9}\.?)(?: (\d{4}))?$"
    month_year = r"^([a-z]{3,9}\.?) (\d{4})$"
    numeric = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})"

    this_year, this_month = F.year(today), F.month(today)

    def past(month: Column, day: Column) -> Column:
        """The last such day up to today: of this year, or of one of the eight before, as the 29th of February is not in each."""
        days = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda n: _day(this_year - n, month, day))
        return F.array_max(F.filter(days, lambda d: d <= today))

    def dated(month: Column, day: Column, year: Column) -> Column:
        return F.when(year == "", past(month, day.try_cast("int"))).otherwise(_day(year.try_cast("int"), month, day.try_cast("int")))

    month = lambda c: _place(MONTHS, c)
    alone = month(part(named, 2))
    first = F.make_date(F.when(alone <= this_month, this_year).otherwise(this_year - 1), alone, F.lit(1))
    in_month = F.least(F.last_day(first), F.date_add(first, F.dayofmonth(today) - 1))
    back = F.pmod(F.weekday(today) + 1 - _place(DAYS, part(named, 2)), F.lit(7))
    of_week = F.when(part(named, 1) == "next", F.date_add(today, 7 - back)).otherwise(F.date_sub(today, F.when(back == 0, 7).otherwise(back)))
    sign = F.when(part(ago, 3) == "ago", -1).otherwise(1)
    turned = F.when(part(turn, 1) == "next", 1).when(part(turn, 1) == "this", 0).otherwise(-1)
    year_month = F.make_date(part(month_year, 2).try_cast("int"), month(part(month_year, 1)), F.lit(1))
    return F.coalesce(
        F.when(text.isin("today", "now", "tonight", "this morning", "this evening", "this afternoon"), today),
        F.when(text.isin("yesterday", "last night"), F.date_sub(today, 1)), F.when(text == "tomorrow", F.date_add(today, 1)),
        F.when(text == "the day before yesterday", F.date_sub(today, 2)), F.when(text == "the day after tomorrow", F.date_add(today, 2)),
        F.when(text.rlike(ago), _moved(today, number(part(ago, 1)) * sign, part(ago, 2))),
        F.when(text.rlike(within), _moved(today, number(part(within, 1)), part(within, 2))),
        F.when(text.rlike(turn), _moved(today, turned, part(turn, 2))),
        F.when(text.rlike(numeric), _day(part(numeric, 1).try_cast("int"), part(numeric, 2).try_cast("int"), part(numeric, 3).try_cast("int"))),
        F.when(text.rlike(month_year), year_month),
        F.when(text.rlike(month_first), dated(month(part(month_first, 1)), part(month_first, 2), part(month_first, 3))),
        F.when(text.rlike(day_first), dated(month(part(day_first, 2)), part(day_first, 1), part(day_first, 3))),
        F.when(text.rlike(named) & alone.isNotNull(), in_month), F.when(text.rlike(named), of_week),
    )


def time_range(expression: Column, now: Column) -> Column:
    """start and end, the first and last second of the day that an expression means; with a week in it seven days are added on both sides. Null where it isn't understood."""
    day = anchor_day(expression, now)
    wide = F.when(F.lower(expression).contains("week"), WEEK_DAYS).otherwise(0)
    start, end = F.date_sub(day, wide).cast("timestamp"), F.date_add(day, wide + 1).cast("timestamp") - F.expr("interval 1 second")
    return F.when(day.isNotNull(), F.struct(start.alias("start"), end.alias("end")))
