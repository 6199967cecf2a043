"""Driver-side readers of option values."""

from __future__ import annotations

import os
import re
from datetime import datetime

#: Forms of dates that are read beside ISO's, and of a time of day after them.
DAYS = ("%Y/%m/%d", "%Y.%m.%d", "%b %d %Y", "%B %d %Y", "%d %b %Y", "%d %B %Y", "%m/%d/%Y")
TIMES = ("", " %H:%M", " %H:%M:%S", " %H:%M:%S %z")
UNITS = {"": 1, "K": 1 << 10, "M": 1 << 20, "G": 1 << 30, "T": 1 << 40}


def memory_bytes(text: str | float | None) -> int | None:
    """``512M``, ``1.5GB`` or a number as bytes; null if it can't be read."""
    if text is None:
        return None
    found = re.fullmatch(r"\s*([0-9]+(?:\.[0-9]+)?)\s*([KMGT]?)B?\s*", str(text), re.IGNORECASE)
    return int(float(found[1]) * UNITS[found[2].upper()]) if found else None


def default_memory() -> int:
    """Two thirds of the machine's memory; 4 GiB stand for it where it can't be told."""
    try:
        total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    except (ValueError, OSError, AttributeError):
        total = 4 << 30
    return total * 2 // 3


def after_epoch(text: str | float | None) -> float | None:
    """Epoch seconds, or a date in one of the usual forms; one without a zone is local time. Other texts raise ValueError."""
    if text is None:
        return None
    try:
        return float(text)
    except ValueError:
        pass
    told = " ".join(str(text).replace(",", " ").split())
    try:
        return datetime.fromisoformat(told).timestamp()
    except ValueError:
        pass
    for day in DAYS:
        for time in TIMES:
            try:
                return datetime.strptime(told, day + time).timestamp()
            except ValueError:
                continue
    raise ValueError(f"not a date: {text!r}")


def csv_set(text: str) -> list[str]:
    return sorted({x.strip() for x in text.split(",") if x.strip()})


def version(text: str) -> tuple[int, ...]:
    """The first dotted number in a tool's answer, to compare with others."""
    found = re.search(r"\d+(?:\.\d+)+", text)
    return tuple(map(int, found[0].split("."))) if found else ()


def durations(text: str, default: int = 100) -> list[int]:
    """The milliseconds of each frame line of a tool's listing."""
    rows = [line.split() for line in text.splitlines() if re.match(r"\s*\d+:", line)]
    return [int(r[6]) if len(r) > 6 and r[6].isdigit() else default for r in rows]
