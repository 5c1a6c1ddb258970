"""Timestamps in log lines: find the span, read it by the first format that fits.

Everything is a column expression. Texts without a zone are read in the session's time zone.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs that may hold a time: they need a colon and a slash or dash.
_RUN = r"[A-Za-z0-9][A-Za-z0-9/:\- ,.+]*"

#: A pattern that picks the text, and the format it is read by, in order of trial.
#: Two-digit years come after four-digit ones.
FORMATS = [
    (r"^(\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}:\d{2}) ?([+-]\d{4})", "yyyy-M-d H:mm:ss Z"),
    (r"^(\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}:\d{2})", "yyyy-M-d H:mm:ss"),
    (r"^(\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}:\d{2})", "yyyy/M/d H:mm:ss"),
    (r"^(\d{2}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}:\d{2})", "yy-M-d H:mm:ss"),
    (r"^(\d{2}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}:\d{2})", "yy/M/d H:mm:ss"),
    (r"^([A-Za-z]{3} +\d{1,2} \d{4} \d{1,2}:\d{2}:\d{2})", "MMM d yyyy H:mm:ss"),
    (r"^([A-Za-z]{3} +\d{1,2} \d{1,2}:\d{2}:\d{2} \d{4})", "MMM d H:mm:ss yyyy"),
    (r"^([A-Za-z]{3} +\d{1,2}, \d{4} \d{1,2}:\d{2}:\d{2} [AaPp][Mm])", "MMM d, yyyy h:mm:ss a"),
    (r"^(\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2} [AaPp][Mm])", "M/d/yyyy h:mm:ss a"),
    (r"^(\d{1,2}/[A-Za-z]{3}/\d{4}:\d{1,2}:\d{2}:\d{2} [+-]\d{4})", "d/MMM/yyyy:H:mm:ss Z"),
    (r"^(\d{1,2}/[A-Za-z]{3}/\d{4} \d{1,2}:\d{2}:\d{2})", "d/MMM/yyyy H:mm:ss"),
]
_FRACTION = r"\d{1,2}:\d{2}:\d{2}[,.](\d{1,3})"


def span(line: Column) -> Column:
    """The first run of time-like characters with a colon and a slash or dash; null without one."""
    runs = F.regexp_extract_all(line, F.lit(_RUN), F.lit(0))
    good = F.filter(runs, lambda r: r.contains(":") & r.rlike("[/-]"))
    return F.get(good, 0)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), 0)


def parse_ms(text: Column) -> Column:
    """Epoch milliseconds of a time text, by the first format that fits and gives no negative time; null else."""

    def read(plain: Column, pattern: str, form: str) -> Column:
        got = F.regexp_extract(plain, pattern, 1)
        if form.startswith("yyyy-M-d H:mm:ss Z"):
            got = F.when(plain.rlike(pattern), F.concat_ws(" ", got, F.regexp_extract(plain, pattern, 2)))
        got = F.regexp_replace(got, " +", " ")
        ms = _let(got, lambda g: F.unix_millis(F.try_to_timestamp(F.when(g != "", g), F.lit(form))))
        return _let(ms, lambda t: F.when(t >= 0, t))

    def whole(t: Column) -> Column:
        fraction = F.rpad(F.regexp_extract(t, _FRACTION, 1), 3, "0").try_cast("bigint")
        plain = F.regexp_replace(t, r"(\d{1,2}:\d{2}:\d{2})[,.]\d+", "$1")
        return _let(plain, lambda p: F.coalesce(*[read(p, pattern, form) for pattern, form in FORMATS])) + F.coalesce(fraction, F.lit(0))

    return _let(text, whole)


def line_ms(line: Column, fallback: Column | None = None) -> Column:
    """Epoch milliseconds of a line, or the fallback (as a rule the time of ingest)."""
    found = parse_ms(span(line))
    return F.coalesce(found, fallback) if fallback is not None else found


_PY = ["%Y-%m-%d %H:%M:%S %z", "%Y-%m-%d %H:%M:%S", "%Y/%m/%d %H:%M:%S", "%y-%m-%d %H:%M:%S", "%y/%m/%d %H:%M:%S", "%b %d %Y %H:%M:%S", "%b %d %H:%M:%S %Y", "%b %d, %Y %I:%M:%S %p", "%m/%d/%Y %I:%M:%S %p", "%d/%b/%Y:%H:%M:%S %z", "%d/%b/%Y %H:%M:%S"]


def literal_ms(text: str) -> int | None:
    """A time given in a query: epoch milliseconds, or any of the formats (UTC without a zone)."""
    text = text.strip()
    if re.fullmatch(r"\d+", text):
        return int(text)
    m = re.search(r"(\d{1,2}:\d{2}:\d{2})[,.](\d{1,3})", text)
    ms = int(m[2].ljust(3, "0")) if m else 0
    plain = re.sub(r"(\d{1,2}:\d{2}:\d{2})[,.]\d+", r"\1", text).replace("T", " ").rstrip("Z")
    for form in _PY:
        try:
            t = dt.datetime.strptime(plain, form)
        except ValueError:
            continue
        t = t if t.tzinfo else t.replace(tzinfo=dt.timezone.utc)
        if t.timestamp() >= 0:
            return int(t.timestamp()) * 1000 + ms
    return None
