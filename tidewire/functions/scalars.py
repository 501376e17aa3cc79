"""Scalar functions on packet values."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalised_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(name, "[^ -~]", "")), "[^a-z0-9]", "")


def mac_text(raw: Column, offset: Column | int) -> Column:
    offset = F.lit(offset) if isinstance(offset, int) else offset
    return F.when(F.octet_length(raw) >= offset + 6, F.regexp_replace(F.lower(F.hex(F.substring(raw, offset + 1, F.lit(6)))), "(..)(?!$)", "$1:"))


@F.pandas_udf(T.StringType())
def ipv6_text(raw: pd.Series) -> pd.Series:
    """Sixteen bytes in the shortest usual form."""
    from ipaddress import IPv6Address

    return raw.map(lambda b: str(IPv6Address(bytes(b))) if b is not None and len(b) == 16 else None)


def bytes_hex(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def utf8_lossy(hex_text: Column) -> Column:
    """Text of bytes given in hexadecimal; what is not UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(F.unhex(hex_text).cast("string"))


def printable(raw: Column) -> Column:
    """ASCII text; other bytes than printable ones, tabs and line ends become points."""
    return F.regexp_replace(F.decode(raw, "ISO-8859-1"), r"[^\x20-\x7E\n\r\t]", ".")


def iso_time(ts_us: Column) -> Column:
    """Microseconds since 1970 as UTC text, no later than the last second of the year 9999."""
    last = 253_402_300_799_000_000
    text = F.date_format(F.timestamp_micros(F.least(ts_us, F.lit(last))), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return F.when(ts_us >= last + 1_000_000, F.concat(F.lit("9999-12-31T23:59:59."), F.lpad((ts_us % 1_000_000).cast("string"), 6, "0"), F.lit("Z"))).otherwise(text)


def media_type(content_type: Column) -> Column:
    return F.trim(F.split_part(content_type, F.lit(";"), F.lit(1)))
