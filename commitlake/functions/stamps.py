"""Order stamps: strings whose order places items; a new one can always be made between two others."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from .scalars import col

LOW, HIGH = 33, 126
SUFFIX = 8


def from_timestamp(ms: str | Column, key: str | Column) -> Column:
    """Fixed-width hexadecimal time, then the key, so that stamps sort as their times do."""
    return F.concat(F.lpad(F.lower(F.hex(col(ms).cast("bigint"))), 16, "0"), F.coalesce(col(key).cast("string"), F.lit("")))


def from_index(i: str | Column, key: str | Column) -> Column:
    return from_timestamp(i, key)


def midpoint(a: str, b: str) -> str:
    """A string strictly between two different ones; a suffix of a digest makes it the caller's own."""
    low, high = sorted((a, b))
    out = []
    for i in range(max(len(low), len(high)) + 1):
        x = ord(low[i]) if i < len(low) else LOW - 1
        y = ord(high[i]) if i < len(high) else HIGH + 1
        if y - x > 1:
            out.append(chr((x + y) // 2))
            break
        out.append(chr(x) if i < len(low) else chr(LOW))
        if x < y:  # below high from here on: it suffices to exceed the rest of low
            for c in low[i + 1 :]:
                if ord(c) < HIGH:
                    out.append(chr((ord(c) + HIGH + 1) // 2))
                    break
                out.append(c)
            break
    digest = hashlib.md5(f"{low}|{high}".encode()).hexdigest()
    return "".join(out) + digest[:SUFFIX]


@pandas_udf(StringType())
def between(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None or x == y else midpoint(x, y) for x, y in zip(a, b, strict=True)])
