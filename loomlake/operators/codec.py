"""A three-string message in the protobuf wire format: encoded with columns, decoded with a limit."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlake.session import ship

MOST_BYTES = 4096
FIELDS = ("version", "revision", "build_mode")


def _varint(number: Column) -> Column:
    """Bytes of a length, seven bits each, lowest first; all but the last have the high bit set."""
    byte = lambda k, more: F.unhex(F.lpad(F.hex(F.shiftright(number, 7 * k).bitwiseAND(F.lit(127)).bitwiseOR(F.lit(128 if more else 0))), 2, "0"))
    of = lambda n: F.concat(*(byte(k, k < n - 1) for k in range(n)))
    out = of(5)  # a text has less than 2**31 bytes
    for n in range(4, 0, -1):
        out = F.when(number < 1 << 7 * n, of(n)).otherwise(out)
    return out


def encoded(values: dict[str, Column]) -> Column:
    """The message of these strings; empty and null ones are left out."""
    out = []
    for number, name in enumerate(FIELDS, 1):
        raw = values[name].cast("binary")
        tag = F.unhex(F.lit(f"{number << 3 | 2:02x}"))
        out.append(F.when(F.octet_length(raw) > 0, F.concat(tag, _varint(F.octet_length(raw).cast("long")), raw)).otherwise(F.lit(b"")))
    return F.concat(*out)


def parse(payload: bytes | None) -> tuple[str, str, str] | None:
    """The three strings of a message; unknown fields are skipped, malformed or longer ones give None."""
    if payload is None or len(payload) > MOST_BYTES:
        return None
    values, at = ["", "", ""], 0

    def number() -> int:
        nonlocal at
        value = 0
        for shift in range(0, 70, 7):
            byte = payload[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
        raise ValueError("too long a number")

    try:
        while at < len(payload):
            field, kind = divmod(number(), 8)
            if field == 0 or kind not in (0, 1, 2, 5):
                return None
            size = {1: 8, 5: 4}.get(kind, 0)
            if kind == 0:
                number()
            elif kind == 2:
                size = number()
            if at + size > len(payload):
                return None
            if kind == 2 and 1 <= field <= 3:
                values[field - 1] = bytes(payload[at : at + size]).decode("utf-8")
            at += size
    except (IndexError, ValueError):
        return None
    return tuple(values)


def decoded(rows: DataFrame, payload: str) -> DataFrame:
    """Adds info, a struct of the three strings, null for malformed and over-long payloads."""
    ship(rows.sparkSession)

    @F.pandas_udf("version string, revision string, build_mode string")
    def run(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(p) or (None,) * 3 for p in column], columns=list(FIELDS))

    found = rows.withColumn("_info", run(payload))
    return found.withColumn("info", F.when(F.col("_info.version").isNotNull(), F.col("_info"))).drop("_info")
