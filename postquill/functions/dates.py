"""Calendar algebra: deadline phrases and question windows as Spark expressions.

Everything is relative to a date given in the row, never to now. A phrase whose
date does not exist resolves to null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .predicates import is_overdue_question
from .text import _c, text_or_empty

# Names, patterns and their order, and limits that results depend on.
WEEKDAY_NAMES = "monday|mon|tuesday|tue|tues|wednesday|wed|thursday|thu|thur|thurs|friday|fri|saturday|sat|sunday|sun"
MONTH_NAMES = (
    "january|jan|february|feb|march|mar|april|apr|may|june|jun|july|jul|august|aug"
    "|september|sep|sept|october|oct|november|nov|december|dec"
)
MONTH_STEMS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
NUMBER_WORDS = {"a": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7}
BACKWARD_DAYS = 45
PIVOT_YEAR = 70
PHRASES = (
    ("day_after_tomorrow", r"\bday after tomorrow\b"),
    ("today", r"\b(today|end of (?:the )?day|eod|cob|by close of business)\b"),
    ("tomorrow", r"\b(tomorrow|tmrw)\b"),
    ("yesterday", r"\byesterday\b"),
    ("end_of_next_week", r"\bend of next week\b"),
    ("end_of_week", r"\bend of (?:the |this )?week\b|\beow\b"),
    ("end_of_next_month", r"\bend of next month\b"),
    ("end_of_month", r"\bend of (?:the |this )?month\b|\beom\b"),
    ("end_of_quarter", r"\bend of (?:the |this )?quarter\b|\beoq\b"),
    ("next_weekday", rf"\bnext\s+({WEEKDAY_NAMES})\b"),
    ("this_weekday", rf"\bthis\s+({WEEKDAY_NAMES})\b"),
    ("in_n_units", r"\b(?:in|within)\s+(\d+|a|one|two|three|four|five|six|seven)\s+(business day|business days|working day|working days|day|days|week|weeks|month|months)\b"),
    ("n_units_from_now", r"\b(\d+|a|one|two|three|four|five|six|seven)\s+(day|days|week|weeks|month|months)\s+from\s+(?:now|today)\b"),
    ("next_week", r"\bnext week\b"),
    ("this_week", r"\bthis week\b"),
    ("next_month", r"\bnext month\b"),
    ("this_month", r"\bthis month\b"),
    ("next_quarter", r"\bnext quarter\b"),
    ("month_day", rf"\b({MONTH_NAMES})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?(?:,?\s*(\d{{4}}))?\b"),
    ("day_month", rf"\b(\d{{1,2}})(?:st|nd|rd|th)?\s+(?:of\s+)?({MONTH_NAMES})\.?(?:,?\s*(\d{{4}}))?\b"),
    ("iso_date", r"\b(\d{4})-(\d{2})-(\d{2})\b"),
    ("numeric_date", r"\b(\d{1,2})/(\d{1,2})(?:/(\d{2,4}))?\b"),
    ("bare_weekday", rf"\b({WEEKDAY_NAMES})\b"),
)
WINDOWS = (
    ("this_week", r"(?i)\bthis week\b"),
    ("next_week", r"(?i)\bnext week\b"),
    ("last_week", r"(?i)\blast week\b"),
    ("this_month", r"(?i)\bthis month\b"),
    ("next_month", r"(?i)\bnext month\b"),
    ("last_month", r"(?i)\blast month\b"),
    ("this_quarter", r"(?i)\bthis quarter\b"),
    ("today", r"(?i)\b(?:today|by end of (?:the )?day|eod)\b"),
    ("yesterday", r"(?i)\byesterday\b"),
    ("tomorrow", r"(?i)\btomorrow\b"),
    ("next_n_days", r"(?i)\b(?:next|coming|in the next)\s+(\d+)\s+days?\b"),
    ("last_n_days", r"(?i)\b(?:last|past|previous)\s+(\d+)\s+days?\b"),
)
EPOCH_OF_OVERDUE = "1900-01-01"
_PATTERN = dict(PHRASES)


def monday(day: Column) -> Column:
    return F.trunc(day, "WEEK")


def next_weekday(day: Column, name: Column) -> Column:
    """The weekday strictly after ``day``."""
    return F.call_function("next_day", day, name)


def following_week_weekday(day: Column, name: Column) -> Column:
    """The weekday in the calendar week after ``day``'s."""
    return next_weekday(F.date_add(monday(day), 6), name)


def end_of_month(day: Column, months: int = 0) -> Column:
    return F.last_day(F.add_months(F.trunc(day, "MM"), months))


def end_of_quarter(day: Column, quarters: int = 0) -> Column:
    return F.last_day(F.add_months(F.trunc(day, "QUARTER"), 2 + 3 * quarters))


def add_business_days(day: Column, n: Column) -> Column:
    """``n`` days on, weekends not counted; holidays are."""
    span = F.sequence(F.date_add(day, 1), F.date_add(day, (2 * n + 7).cast("int")))
    weekdays = F.filter(span, lambda x: F.weekday(x) < 5)
    return F.when(n <= 0, day).otherwise(F.get(weekdays, n - 1))


def real_date(year: Column, month: Column, day: Column) -> Column:
    """The date, or null where the calendar has none."""
    text = F.format_string("%04d-%02d-%02d", year, month, day)
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")


def iso_day(value: Column | str) -> Column:
    """The day that an ISO string starts with, or null."""
    return F.try_to_timestamp(F.substring(F.trim(_c(value)), 1, 10), F.lit("yyyy-MM-dd")).cast("date")


def resolve(phrase: Column | str, sent: Column | str) -> Column:
    """struct(value, precision, rule, ambiguous, alternative, rolled_year) of a phrase
    in a message sent on ``sent``; null where nothing names a real date.

    The first pattern that matches decides; longer phrases come before the shorter
    ones they contain.
    """
    text, day = F.lower(F.trim(text_or_empty(phrase))), _c(sent).cast("date")
    rule = F.lit(None).cast("string")
    for name, pattern in reversed(PHRASES):
        rule = F.when(text.rlike(pattern), name).otherwise(rule)

    def group(name: str, i: int) -> Column:
        return F.regexp_extract(text, _PATTERN[name], i)

    def number(x: Column) -> Column:
        word = F.lit(None).cast("int")
        for w, n in NUMBER_WORDS.items():
            word = F.when(x == w, n).otherwise(word)
        return F.coalesce(x.try_cast("int"), word)

    def stem(name: str) -> Column:
        return F.substring(group(name, 1), 1, 3)

    def units(name: str) -> Column:
        n, unit = number(group(name, 1)), group(name, 2)
        return (
            F.when(unit.startswith("business") | unit.startswith("working"), add_business_days(day, n))
            .when(unit.startswith("day"), F.date_add(day, n)).when(unit.startswith("week"), F.date_add(day, n * 7))
            .otherwise(F.add_months(day, n))
        )

    def month(x: Column) -> Column:
        return F.array_position(F.array(*map(F.lit, MONTH_STEMS)), F.substring(x, 1, 3)).cast("int")

    def dated(m: Column, d: Column, y: Column) -> tuple[Column, Column]:
        """The date, and whether the year had to be the next one."""
        year = F.when(y < 100, y + F.when(y < PIVOT_YEAR, 2000).otherwise(1900)).otherwise(y)
        here = real_date(F.year(day), m, d)
        rolls = F.coalesce(y.isNull() & (F.datediff(day, here) > BACKWARD_DAYS), F.lit(False))
        return F.when(y.isNotNull(), real_date(year, m, d)).when(rolls, real_date(F.year(day) + 1, m, d)).otherwise(here), rolls

    def part(name: str, i: int) -> Column:
        return group(name, i).try_cast("int")

    by_name = dated(month(group("month_day", 1)), part("month_day", 2), part("month_day", 3))
    by_day = dated(month(group("day_month", 2)), part("day_month", 1), part("day_month", 3))
    m = part("numeric_date", 1)
    by_number = dated(F.when(m <= 12, m), part("numeric_date", 2), part("numeric_date", 3))
    friday = F.lit("FRI")
    values = {
        "today": day, "tomorrow": F.date_add(day, 1), "day_after_tomorrow": F.date_add(day, 2), "yesterday": F.date_sub(day, 1),
        "end_of_week": next_weekday(F.date_sub(day, 1), friday), "this_week": next_weekday(F.date_sub(day, 1), friday),
        "end_of_next_week": following_week_weekday(day, friday), "next_week": following_week_weekday(day, friday),
        "end_of_month": end_of_month(day), "this_month": end_of_month(day), "end_of_next_month": end_of_month(day, 1), "next_month": end_of_month(day, 1),
        "end_of_quarter": end_of_quarter(day), "next_quarter": end_of_quarter(day, 1),
        "next_weekday": following_week_weekday(day, stem("next_weekday")),
        "this_weekday": next_weekday(day, stem("this_weekday")), "bare_weekday": next_weekday(day, stem("bare_weekday")),
        "in_n_units": units("in_n_units"), "n_units_from_now": units("n_units_from_now"),
        "month_day": by_name[0], "day_month": by_day[0], "numeric_date": by_number[0],
        "iso_date": real_date(part("iso_date", 1), part("iso_date", 2), part("iso_date", 3)),
    }
    value = F.lit(None).cast("date")
    for name, expr in values.items():
        value = F.when(rule == name, expr).otherwise(value)
    in_months = F.when(rule == "in_n_units", group("in_n_units", 2)).when(rule == "n_units_from_now", group("n_units_from_now", 2)).otherwise("")
    precision = (
        F.when(rule.isin("next_week", "this_week"), "week").when(rule.isin("next_month", "this_month") | in_months.startswith("month"), "month")
        .when(rule == "next_quarter", "quarter").otherwise("day")
    )
    nearer = F.when(rule == "next_weekday", next_weekday(day, stem("next_weekday")))
    rolled = F.when(rule == "month_day", by_name[1]).when(rule == "day_month", by_day[1]).when(rule == "numeric_date", by_number[1]).otherwise(False)
    found = F.struct(
        value.alias("value"), precision.alias("precision"), rule.alias("rule"),
        F.coalesce(nearer != value, F.lit(False)).alias("ambiguous"), nearer.alias("alternative"), rolled.alias("rolled_year"),
    )
    return F.when(value.isNotNull(), found)


def window(question: Column | str, as_of: Column | str) -> Column:
    """struct(start, end, phrase, include_overdue) that a question asks about, or null."""
    text, day = text_or_empty(question), _c(as_of).cast("date")
    overdue = is_overdue_question(text)
    first = F.trunc(day, "QUARTER")

    def days(name: str) -> Column:
        return F.regexp_extract(text, dict(WINDOWS)[name], 1).try_cast("int")

    bounds = {
        "this_week": (monday(day), F.date_add(monday(day), 6)),
        "next_week": (F.date_add(monday(day), 7), F.date_add(monday(day), 13)),
        "last_week": (F.date_sub(monday(day), 7), F.date_sub(monday(day), 1)),
        "this_month": (F.trunc(day, "MM"), end_of_month(day)),
        "next_month": (F.add_months(F.trunc(day, "MM"), 1), end_of_month(day, 1)),
        "last_month": (F.add_months(F.trunc(day, "MM"), -1), end_of_month(day, -1)),
        "this_quarter": (first, end_of_quarter(day)),
        "today": (day, day),
        "yesterday": (F.date_sub(day, 1), F.date_sub(day, 1)),
        "tomorrow": (F.date_add(day, 1), F.date_add(day, 1)),
        "next_n_days": (day, F.date_add(day, days("next_n_days"))),
        "last_n_days": (F.date_sub(day, days("last_n_days")), day),
    }

    def made(start: Column, end: Column, phrase: Column) -> Column:
        return F.struct(start.alias("start"), end.alias("end"), phrase.alias("phrase"), overdue.alias("include_overdue"))

    by_date = resolve(text, day)
    out = F.when(by_date.isNotNull(), made(day, by_date["value"], text)).when(overdue, made(F.lit(EPOCH_OF_OVERDUE).cast("date"), day, F.lit("overdue")))
    for name, pattern in reversed(WINDOWS):
        out = F.when(text.rlike(pattern), made(*bounds[name], F.regexp_extract(text, pattern, 0))).otherwise(out)
    return F.when(day.isNotNull(), out)


def local_day(ts: Column | str, zone: Column | str = "UTC") -> Column:
    """The calendar day of a UTC timestamp in a time zone given by name or column."""
    return F.to_date(F.from_utc_timestamp(_c(ts), zone))


def midnight_utc(day: Column | str) -> Column:
    """The first moment of a day, as sessions run in UTC."""
    return _c(day).cast("date").cast("timestamp")


def window_days(found: Column) -> Column:
    """Days of a window from :func:`window`, both ends counted."""
    return F.datediff(found["end"], found["start"]) + 1


def window_label(found: Column) -> Column:
    late = F.when(found["include_overdue"], " plus anything already overdue").otherwise("")
    return F.concat(found["start"].cast("string"), F.lit(" to "), found["end"].cast("string"), F.lit(" ("), window_days(found).cast("string"), F.lit(" days)"), late)
