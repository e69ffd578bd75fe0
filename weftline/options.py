"""Options given as text, each with a default or a callback for text that can't be read."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from datetime import timedelta

Report = Callable[[str], None]


def _or_default[T](value: T | None, text: str | None, default: T, report: Report | None, kind: str) -> T:
    if value is None and text not in (None, "") and report is not None:
        report(f"{text!r} is no {kind}")
    return default if value is None else value


def number(text: str | None, default: int, report: Report | None = None) -> int:
    return _or_default(int(text) if text and re.fullmatch(r"\s*[+-]?\d+\s*", text) else None, text, default, report, "number")


def choice(text: str | None, names: Iterable[str], default: str, report: Report | None = None) -> str:
    """One of the names, whatever the case of its letters."""
    return _or_default({n.lower(): n for n in names}.get((text or "").strip().lower()), text, default, report, "known name")


def span(text: str | None, default: timedelta, report: Report | None = None) -> timedelta:
    """[-][days.]hours:minutes[:seconds[.fraction]], or whole days alone; hours below 24, minutes and seconds below 60."""
    found = None
    m = re.fullmatch(r"\s*(-)?(?:(\d+)\.)?(\d+):(\d+)(?::(\d+(?:\.\d{1,7})?))?\s*", text or "")
    if m and int(m[3]) < 24 and int(m[4]) < 60 and float(m[5] or 0) < 60:
        found = timedelta(days=int(m[2] or 0), hours=int(m[3]), minutes=int(m[4]), seconds=float(m[5] or 0))
    elif m := re.fullmatch(r"\s*(-)?(\d+)\s*", text or ""):
        found = timedelta(days=int(m[2]))
    return _or_default(-found if found is not None and m[1] else found, text, default, report, "time span")
