"""The format of a date text, found from one example."""

from __future__ import annotations

import re

INFER = "infer"
_YEAR_FIRST = re.compile(r"(\d{4})([-/.])(\d{1,2})\2(\d{1,2})")
_YEAR_LAST = re.compile(r"(\d{1,2})([-/.])(\d{1,2})\2(\d{4})")
_TIME = re.compile(r"([ T])(\d{1,2}):\d{2}(:\d{2}(?:\.(\d{1,6}))?)?")


def _time_pattern(rest: str) -> str | None:
    if not rest:
        return ""
    m = _TIME.fullmatch(rest)
    if not m:
        return None
    between = " " if m[1] == " " else "'T'"
    return f"{between}{'HH' if len(m[2]) == 2 else 'H'}:mm" + (":ss" if m[3] else "") + (f".{'S' * len(m[4])}" if m[4] else "")


def readings(text: str) -> list[str]:
    """Patterns that the whole text can be read with, the one to take first: year first, or month first before day first.

    None for other texts, which are read in ISO notation if at all.
    """
    text = text.strip()
    if m := _YEAR_FIRST.match(text):
        dates = [f"yyyy{m[2]}M{m[2]}d"] if 1 <= int(m[3]) <= 12 and 1 <= int(m[4]) <= 31 else []
    elif m := _YEAR_LAST.match(text):
        one, other = int(m[1]), int(m[3])
        month_first = [f"M{m[2]}d{m[2]}yyyy"] if 1 <= one <= 12 and 1 <= other <= 31 else []
        dates = month_first + ([f"d{m[2]}M{m[2]}yyyy"] if 1 <= other <= 12 and 1 <= one <= 31 else [])
    else:
        return []
    time = _time_pattern(text[m.end():])
    return [] if time is None else [d + time for d in dates]
