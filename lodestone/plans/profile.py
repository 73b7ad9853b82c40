"""Semantic types of columns, from a small sample."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Values of a column that its type is decided on.
SAMPLE = 100
# Patterns, keywords and shares that decide a type.
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
PHONE = r"[\d\s\-\(\)\+]{10,}"
NAME_KEYWORDS = ("name", "first", "last", "full", "person", "contact")
COMMON_NAMES = ("john", "mary", "robert", "james", "michael", "william", "david", "richard", "joseph", "thomas", "charles", "daniel")
EMAIL_SHARE, PHONE_SHARE, PHONE_DIGITS, DATE_SHARE, TITLE_SHARE, NAME_SHARE = 0.5, 0.5, 7, 0.5, 0.6, 0.3

_DATE_SHAPES = (
    "%Y-%m-%d", "%m-%d-%Y", "%d-%m-%Y", "%Y/%m/%d", "%m/%d/%Y", "%d/%m/%Y", "%Y.%m.%d", "%m/%d/%y", "%m-%d-%y", "%Y%m%d",
    "%B %d, %Y", "%d %B %Y", "%b %d, %Y", "%d %b %Y", "%d-%b-%Y", "%B", "%b", "%B %Y", "%b %Y", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S",
)


def _is_date(value: str) -> bool:
    value = value.strip()
    for shape in _DATE_SHAPES:
        try:
            datetime.strptime(value, shape)
            return True
        except ValueError:
            pass
    return False


def detect_type(values: Sequence[str], name: str) -> str:
    """The type of a string column from its first values, in the order email,
    phone, date, name, general string."""
    values = [v for v in values if v is not None]
    if not values:
        return "string_general"

    def share(test) -> float:
        return sum(map(bool, map(test, values))) / len(values)

    if share(lambda v: re.match(EMAIL, v)) > EMAIL_SHARE:
        return "email"
    digits = sum(c.isdigit() for v in values for c in v) / len(values)
    if share(lambda v: re.match(PHONE, v)) > PHONE_SHARE or digits >= PHONE_DIGITS:
        return "phone"
    if share(_is_date) > DATE_SHARE:
        return "date"
    if any(k in name.lower() for k in NAME_KEYWORDS):
        return "string_name"
    if share(str.istitle) > TITLE_SHARE or share(lambda v: any(n in v.lower() for n in COMMON_NAMES)) > NAME_SHARE:
        return "string_name"
    return "string_general"


def column_types(df: DataFrame, columns: Iterable[str]) -> dict[str, str]:
    """The semantic type of each column; one small sample serves all of them.

    Numbers and booleans are numeric, dates and timestamps are dates.  Strings
    are judged on the first non-null values in the order of ``__idx``, or of the
    rows where there is none.
    """
    columns = list(dict.fromkeys(columns))
    out: dict[str, str] = {}
    strings = []
    for c in columns:
        kind = df.schema[c].dataType
        if isinstance(kind, (T.NumericType, T.BooleanType)):
            out[c] = "numeric"
        elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            out[c] = "date"
        elif isinstance(kind, T.StringType):
            strings.append(c)
        else:
            out[c] = "string_general"
    if strings:
        rows = df.orderBy("__idx") if "__idx" in df.columns else df
        # nulls are rare after cleaning; where they aren't, a column is sampled by itself
        first = rows.select(*strings).limit(SAMPLE).collect()
        for c in strings:
            values = [r[c] for r in first if r[c] is not None]
            if len(values) < len(first):
                values = [r[c] for r in rows.where(F.col(c).isNotNull()).select(c).limit(SAMPLE).collect()]
            out[c] = detect_type(values, c)
    return out
