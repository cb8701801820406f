"""Moments of five-field cron rules, in UTC."""

from __future__ import annotations

from datetime import datetime, timedelta

RANGES = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 6))


def field(text: str, low: int, high: int) -> set[int]:
    """Values of one field: stars, numbers, ranges and steps, joined by commas."""
    out: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        a, _, b = (str(low), "-", str(high)) if span == "*" else span.partition("-")
        first, last = int(a), int(b) if b else (high if step else int(a))
        if not low <= first <= last <= high or (step and int(step) < 1):
            raise ValueError(f"bad cron field {text!r}")
        out.update(range(first, last + 1, int(step) if step else 1))
    return out


def next_moment(rule: str, after: datetime) -> datetime:
    """The first minute after ``after`` that the rule names; days match by month day or week day when both are given."""
    parts = rule.split()
    if len(parts) != 5:
        raise ValueError("a cron rule has five fields")
    minute, hour, day, month, week = (field(p, *r) for p, r in zip(parts, RANGES, strict=True))
    at = after.replace(second=0, microsecond=0) + timedelta(minutes=1)
    end = at + timedelta(days=366 * 8)
    while at < end:
        by_day, by_week = at.day in day, (at.weekday() + 1) % 7 in week
        today = by_day and by_week if "*" in (parts[2], parts[4]) else by_day or by_week
        if at.month not in month or not today:
            at = (at + timedelta(days=1)).replace(hour=0, minute=0)
        elif at.hour not in hour:
            at = (at + timedelta(hours=1)).replace(minute=0)
        elif at.minute not in minute:
            at += timedelta(minutes=1)
        else:
            return at
    raise ValueError("the rule names no moment")
