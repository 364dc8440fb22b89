"""Questions in words: what to search for, in which window of time, and whether the last sighting is meant (STR, DT).

All functions map columns to columns.  ``now_ms`` is a column; the zone is the session's, so days of 23 and 25 hours and days
without a midnight come out as the zone has them.  Windows are pairs of inclusive epoch milliseconds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the grammar: the beginnings of questions, articles, fixed time phrases and fillers.
QUESTION = r"^(where(?:\s+did|'?d)\s+i\s+(leave|put|last\s+see|drop)|where'?s|what'?s|when'?s|where\s+(is|are)|what\s+(is|are)|when\s+(is|are)|that\s+is|this\s+is|find|show\s+me|look\s+for|search\s+for)\s+"
ARTICLE = r"^(my|the|a|an)\s+"
RECALL = r"where(?:\s+did|'?d)\s+i\s+(leave|put|last\s+see|drop)"
TIME_PHRASE = r"\b(yesterday|today|this morning|this afternoon|earlier today|an hour ago|last hour|in the last hour|just now|a moment ago|a minute ago|recently)\b"
FILLER = r"\b(morning|afternoon|evening|night|sometime|earlier|roughly|approximately)\b"

WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11,
    "december": 12, "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
    "января": 1, "февраля": 2, "марта": 3, "апреля": 4, "мая": 5, "июня": 6, "июля": 7, "августа": 8, "сентября": 9, "октября": 10, "ноября": 11,
    "декабря": 12,
}
NUMBERS = {
    "a couple of": 2, "a couple": 2, "a few": 3, "several": 3, "a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6,
    "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12,
}

ANY_DAY = "|".join(WEEKDAYS)
ANY_MONTH = "|".join(sorted(MONTHS, key=len, reverse=True))
ANY_NUMBER = r"a couple of|a couple|a few|several|\d+|" + "|".join(sorted((n for n in NUMBERS if " " not in n and n != "several"), key=len, reverse=True))
DAY_BEFORE = r"\bthe\s+day\s+before\s+yesterday\b"
WEEK = r"\b(last|this)\s+week\b"
MONTH = r"\b(last|this)\s+month\b"
EVENING = r"\b(last\s+night|this\s+evening|tonight)\b"
WEEKEND_BEFORE = r"\b(?:the\s+)?weekend\s+before\s+last\b"
WEEKEND = r"\b(?:last\s+|this\s+|over\s+the\s+)weekend\b"
FORTNIGHT = r"\ba\s+fortnight\s+ago\b"
AGO = rf"\b({ANY_NUMBER})\s+(day|week|month|hour|minute)s?\s+(?:ago|back)\b"
FUTURE_DAY = rf"\b(next|coming|upcoming)\s+({ANY_DAY})\b"
WEEKDAY = rf"\b(?:(last|this|on)\s+)?({ANY_DAY})(?!\p{{L}})"
IN_MONTH = rf"\bin\s+({ANY_MONTH})(?!\p{{L}})"
ISO = r"(?<![\d-])(\d{4})-(\d{1,2})-(\d{1,2})(?![\d-])"
DAY_TOKEN, MONTH_TOKEN = r"(?<!\d)(\d{1,2})(?:st|nd|rd|th)?(?!\d)", rf"(?<!\p{{L}})({ANY_MONTH})(?!\p{{L}})"
NAMED = rf"(?:{DAY_TOKEN}\s+{MONTH_TOKEN}|{MONTH_TOKEN}\s+{DAY_TOKEN})"


def search_phrase(raw: Column) -> Column:
    """Lower case without one question and one article at the beginning; the whole query if nothing is left (STR-a)."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.lower(raw), QUESTION, ""), ARTICLE, ""))
    return F.when(bare == "", raw).otherwise(bare)


def tokens(text: Column) -> Column:
    """Different words of more than two letters, Latin ones alone (STR-b)."""
    return F.array_distinct(F.filter(F.split(text, r"\W+"), lambda t: F.length(t) > 2))


def label_matches(label: Column, query_tokens: Column) -> Column:
    """Whether a word of the label and a word of the query are equal or, from four letters on, one contains the other (STR-c)."""
    own = F.filter(F.split(F.lower(label), r"\W+"), lambda t: F.length(t) > 2)
    fits = lambda a, b: (a == b) | ((F.length(a) >= 4) & F.contains(b, a)) | ((F.length(b) >= 4) & F.contains(a, b))
    return F.exists(own, lambda a: F.exists(query_tokens, lambda b: fits(a, b)))


def is_recall(raw: Column) -> Column:
    """STR-g."""
    return F.lower(raw).rlike(RECALL)


# --- days, weeks and months of the session's zone (DT1-DT4)


def instant(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def start_of(day: Column) -> Column:
    """First millisecond of a date: of its first valid instant where midnight is skipped."""
    return F.unix_millis(day.cast("timestamp"))


def window(since: Column, until: Column) -> Column:
    return F.struct(since.cast("long").alias("since_ms"), until.cast("long").alias("until_ms"))


def days(first: Column, n: int = 1) -> Column:
    """The window of ``n`` whole days."""
    return window(start_of(first), start_of(F.date_add(first, n)) - 1)


def months(first: Column) -> Column:
    return window(start_of(first), start_of(F.add_months(first, 1)) - 1)


def at_hour(day: Column, hour: int) -> Column:
    return F.unix_millis(F.try_to_timestamp(F.concat(day.cast("string"), F.lit(f" {hour:02d}:00:00"))))


def lookup(values: dict[str, int], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))]), key)


def relative_window(raw: Column, now_ms: Column) -> Column:
    """The window of a relative expression; null if there is none.  The first that fits wins (DT5)."""
    q, now = F.lower(raw), now_ms.cast("long")
    today = instant(now).cast("date")
    monday, first = F.trunc(today, "week"), F.trunc(today, "month")
    one = lambda pattern, k: F.regexp_extract(q, pattern, k)
    counted, unit = one(AGO, 1), one(AGO, 2)
    n = F.coalesce(counted.try_cast("int"), lookup(NUMBERS, counted), F.lit(1))
    ago = (
        F.when(unit == "minute", window(now - n * 60_000, now))
        .when(unit == "hour", window(now - n * 3_600_000, now))
        .when(unit == "day", days(F.date_sub(today, n)))
        .when(unit == "week", days(F.date_sub(monday, 7 * n), 7))
        .when(unit == "month", months(F.add_months(first, -n)))
    )
    evening = at_hour(today, 18)
    wanted = lookup({d: k for k, d in enumerate(WEEKDAYS)}, one(WEEKDAY, 2))
    from_day = F.when(one(WEEKDAY, 1) == "last", F.date_sub(today, 1)).otherwise(today)
    weekday = F.date_sub(from_day, F.pmod(F.weekday(from_day) - wanted, F.lit(7)))
    in_month = lookup(MONTHS, one(IN_MONTH, 1))
    named = F.make_date(F.year(today), in_month, F.lit(1))
    named = F.when(named > first, F.add_months(named, -12)).otherwise(named)
    return (
        F.when(q.rlike(DAY_BEFORE), days(F.date_sub(today, 2)))
        .when(q.rlike(WEEK), F.when(one(WEEK, 1) == "this", window(start_of(monday), now)).otherwise(days(F.date_sub(monday, 7), 7)))
        .when(q.rlike(MONTH), F.when(one(MONTH, 1) == "this", window(start_of(first), now)).otherwise(months(F.add_months(first, -1))))
        .when(
            q.rlike(EVENING),
            # only "last night" with a single blank is the night before; "this evening" has no window before it began
            F.when(one(EVENING, 1) == "last night", window(at_hour(F.date_sub(today, 1), 18), start_of(today))).when(evening < now, window(evening, now)),
        )
        .when(q.rlike(WEEKEND_BEFORE), days(F.date_sub(monday, 9), 2))
        .when(q.rlike(WEEKEND), days(F.date_sub(monday, 2), 2))
        .when(q.rlike(FORTNIGHT), days(F.date_sub(monday, 14), 7))
        .when(q.rlike(AGO), ago)
        .when(q.rlike(WEEKDAY) & ~q.rlike(FUTURE_DAY), days(weekday))
        .when(q.rlike(IN_MONTH), months(named))
        .when(q.rlike(r"\byesterday\b"), window(start_of(F.date_sub(today, 1)), start_of(today) - 1))
        .when(q.rlike(r"\b(today|this morning|this afternoon|earlier today)\b"), window(start_of(today), now))
        .when(q.rlike(r"\b(an hour ago|last hour|in the last hour)\b"), window(now - 3_600_000, now))
        .when(q.rlike(r"\b(just now|a moment ago|recently|a minute ago)\b"), window(now - 600_000, now))
    )


def iso_day(raw: Column) -> Column:
    part = [F.regexp_extract(F.lower(raw), ISO, k) for k in (1, 2, 3)]
    return F.try_to_date(F.concat_ws("-", part[0], F.lpad(part[1], 2, "0"), F.lpad(part[2], 2, "0")), "yyyy-MM-dd")


def named_day(raw: Column, now_ms: Column) -> Column:
    """The most recent day, not in the future, of a day and a month in words; null if no year of the last ten has it."""
    q, today = F.lower(raw), instant(now_ms.cast("long")).cast("date")
    part = lambda a, b: F.coalesce(*[F.nullif(F.regexp_extract(q, NAMED, k), F.lit("")) for k in (a, b)])
    day, month = part(1, 4), lookup(MONTHS, part(2, 3)).cast("string")
    tries = F.transform(
        F.sequence(F.lit(0), F.lit(9)),
        lambda k: F.try_to_date(F.concat_ws("-", (F.year(today) - k).cast("string"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd"),
    )
    return F.when(day.isNotNull() & month.isNotNull(), F.get(F.filter(tries, lambda d: d <= today), F.lit(0)))


def absolute_day(raw: Column, now_ms: Column) -> Column:
    """The day that a date in the query names (DT6)."""
    return F.coalesce(iso_day(raw), named_day(raw, now_ms))


def without_date(raw: Column, now_ms: Column) -> Column:
    """The query without the date that ``absolute_day`` found (STR-d)."""
    squeezed = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    iso = F.regexp_replace(raw, f"(?s)^(.*?){ISO}", "$1")
    named = F.regexp_replace(raw, f"(?isu)^(.*?){NAMED}", "$1")
    return F.when(iso_day(raw).isNotNull(), squeezed(iso)).when(named_day(raw, now_ms).isNotNull(), squeezed(named)).otherwise(raw)


def without_boilerplate(text: Column, had_date: Column) -> Column:
    """Without trailing punctuation, a preposition that a cut date left, "what did i see", and relative times (STR-f)."""
    t = F.regexp_replace(F.lower(text), r"[\s?!.,;]+$", "")
    t = F.when(had_date, F.regexp_replace(t, r"\s+(on|in|at|from)$", "")).otherwise(t)
    t = F.regexp_replace(t, r"^what\s+did\s+i\s+see\b\s*", "")
    relative = [DAY_BEFORE, EVENING, WEEKEND_BEFORE, WEEKEND, FORTNIGHT, WEEK, MONTH, AGO, WEEKDAY, IN_MONTH]
    t = reduce(lambda c, p: F.regexp_replace(c, p, " "), relative, t)
    t = F.regexp_replace(F.regexp_replace(t, TIME_PHRASE, ""), FILLER, " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def without_time_phrases(phrase: Column) -> Column:
    """STR-e."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(phrase, TIME_PHRASE, ""), r"\s+", " "))
    return F.when(bare == "", phrase).otherwise(bare)


def parse(raw: Column, now_ms: Column) -> Column:
    """``embed_text``, ``since_ms``, ``until_ms``, ``recall_intent``, ``time_only`` of a query (STR-h)."""
    day = absolute_day(raw, now_ms)
    found = F.when(day.isNotNull(), days(day)).otherwise(relative_window(raw, now_ms))
    bare = without_boilerplate(without_date(raw, now_ms), day.isNotNull())
    embed = F.trim(F.lower(without_time_phrases(search_phrase(bare))))
    return F.struct(
        embed.alias("embed_text"),
        found["since_ms"].alias("since_ms"),
        found["until_ms"].alias("until_ms"),
        is_recall(raw).alias("recall_intent"),
        (found.isNotNull() & (embed == "")).alias("time_only"),
    )


def bound_ms(value: Column, end_of_day: bool) -> Column:
    """A bound given as milliseconds or as a date; anything else is null (STR-i)."""
    text = F.trim(value)
    day = F.coalesce(F.try_to_date(text, "yyyy-MM-dd"), F.try_to_timestamp(text).cast("date"))
    return F.coalesce(text.try_cast("long"), start_of(F.date_add(day, 1)) - 1 if end_of_day else start_of(day))
