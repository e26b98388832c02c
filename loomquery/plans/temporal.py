"""FOR clauses: the days they name."""

from __future__ import annotations

import datetime as dt

from loomquery.errors import QueryError

WEEKDAYS = ("MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY", "SATURDAY", "SUNDAY")


def day_of(word: str, today: dt.date) -> dt.date:
    if word == "TODAY":
        return today
    if word == "YESTERDAY":
        return today - dt.timedelta(days=1)
    if word in WEEKDAYS:  # the last one before today
        back = (today.weekday() - WEEKDAYS.index(word)) % 7 or 7
        return today - dt.timedelta(days=back)
    try:
        return dt.date.fromisoformat(word.strip("'\"")[:10])
    except ValueError:
        raise QueryError(f"no day {word}") from None


def days_of(words: tuple[str, ...], today: dt.date) -> tuple[dt.date, dt.date]:
    """First and last day of what stands after FOR."""
    w = list(words)
    if w[:2] == ["DATES", "BETWEEN"] and len(w) == 5 and w[3] == "AND":
        a, b = day_of(w[2], today), day_of(w[4], today)
        if a > b:
            raise QueryError("the first day is after the last")
        return a, b
    if w[:2] == ["DATES", "SINCE"] and len(w) == 3:
        return day_of(w[2], today), today
    if w[:2] == ["DATES", "IN"] and len(w) == 3:
        first = today.replace(day=1)
        if w[2] == "THIS_MONTH":
            return first, today
        if w[2] in ("LAST_MONTH", "PREVIOUS_MONTH"):
            last = first - dt.timedelta(days=1)
            return last.replace(day=1), last
        raise QueryError(f"no range {w[2]}")
    if w[:1] == ["LAST"] and len(w) == 3 and w[2] in ("DAY", "DAYS") and w[1].isdigit():
        return today - dt.timedelta(days=int(w[1])), today
    if w[:1] == ["DATE"]:
        w = w[1:]
    if len(w) == 1:
        d = day_of(w[0], today)
        return d, d
    raise QueryError(f"can't read FOR {' '.join(words)}")
