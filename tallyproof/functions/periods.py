"""Named windows (quarter, fiscal quarter, month, year) and the way back from a window to its quarter."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _last_day(year: int, month: int) -> dt.date:
    nxt = dt.date(year + month // 12, month % 12 + 1, 1)
    return nxt - dt.timedelta(days=1)


def quarter_window(year: int, quarter: int, fiscal: bool = False) -> tuple[dt.date, dt.date]:
    """First and last day. Fiscal years start in April; all four of their quarters lie in the given calendar year."""
    first = 3 * ((quarter if fiscal else quarter - 1) % 4) + 1
    return dt.date(year, first, 1), _last_day(year, first + 2)


def month_window(year: int, month: int) -> tuple[dt.date, dt.date]:
    return dt.date(year, month, 1), _last_day(year, month)


def year_window(year: int) -> tuple[dt.date, dt.date]:
    return dt.date(year, 1, 1), dt.date(year, 12, 31)


def quarter_of(start: dt.date | None, end: dt.date | None, fiscal: bool = False) -> tuple[int, int] | None:
    """(year, quarter) if the range is exactly one quarter."""
    if start is None or end is None or start.day != 1 or start.month % 3 != 1:
        return None
    if end != _last_day(start.year, start.month + 2):
        return None
    season = start.month // 3  # 0 to 3 from January on; the fiscal year's first quarter is season 1
    return start.year, (season or 4) if fiscal else season + 1


def quarter_end(start: Column) -> Column:
    return F.last_day(F.add_months(start, 2))


def is_calendar_quarter(start: Column, end: Column) -> Column:
    """The same question for columns of dates."""
    return F.coalesce((F.trunc(start, "quarter") == start) & (quarter_end(start) == end), F.lit(False))


def fiscal_quarter(d: Column) -> Column:
    """Quarter number of a day in an April-to-March year."""
    return F.when(F.quarter(d) == 1, F.lit(4)).otherwise(F.quarter(d) - 1)
