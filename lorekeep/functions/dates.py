"""Date ranges in words."""

from __future__ import annotations

import re
from datetime import date, timedelta


def date_range(words: str, today: date) -> tuple[str | None, str | None]:
    """First and last day (YYYY-MM-DD) of today, yesterday, week, month, 7d (any number) or A..B; sides of A..B
    may be empty. Anything else is an error."""
    if words == "today":
        return today.isoformat(), today.isoformat()
    if words == "yesterday":
        return ((today - timedelta(1)).isoformat(),) * 2
    days = {"week": 7, "month": 30}.get(words)
    if m := re.fullmatch(r"(\d+)d", words):
        days = int(m[1])
    if days is not None:
        return (today - timedelta(days)).isoformat(), today.isoformat()
    if ".." in words:
        first, last = words.split("..", 1)
        return first or None, last or None
    raise ValueError(f"no date range: {words!r}")
