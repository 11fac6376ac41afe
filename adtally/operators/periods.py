"""Report periods. The clock is always passed in, so a report can be repeated."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, time, timedelta


@dataclass(frozen=True)
class Window:
    """Days from ``start`` to ``end``, both included."""

    start: date
    end: date

    @property
    def days(self) -> int:
        return (self.end - self.start).days + 1

    def shifted(self, days: int) -> Window:
        step = timedelta(days=days)
        return Window(self.start + step, self.end + step)


@dataclass(frozen=True)
class Period:
    """A reported window, the window of the same length right before it, and the clock."""

    current: Window
    as_of: datetime

    def __post_init__(self) -> None:
        if self.current.start > self.current.end:
            raise ValueError("a period cannot end before it starts")

    @classmethod
    def of(cls, start: str, end: str, as_of: str) -> Period:
        return cls(
            Window(date.fromisoformat(start), date.fromisoformat(end)),
            datetime.fromisoformat(as_of),
        )

    @property
    def previous(self) -> Window:
        return self.current.shifted(-self.current.days)

    @property
    def days_count(self) -> int:
        return self.current.days

    @property
    def is_today_included(self) -> bool:
        return self.current.end == self.as_of.date()

    def completed_hours(self, window: Window) -> tuple[datetime, datetime]:
        """Half-open span of the window's last day up to the last full hour of the clock."""
        midnight = datetime.combine(window.end, time())
        return midnight, midnight + timedelta(hours=self.as_of.hour)


def lookback_before(day: date) -> tuple[date, date]:
    """Half-open span of the two calendar months before the month of ``day``."""
    month = day.replace(day=1)
    months = month.year * 12 + (month.month - 1) - 2
    return date(months // 12, months % 12 + 1, 1), month
