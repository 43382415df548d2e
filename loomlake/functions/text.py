"""Column functions over text: escaping, JSON, rendering, parsing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Escapes of one-line logs and of JSON strings that have a name of their own.
LINE_NAMED = {"\n": "\\n", "\r": "\\r", "\t": "\\t"}
JSON_NAMED = {'"': '\\"', "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}

HEX = "0123456789abcdef"
#: Size suffixes and the MiB that each stands for; of two that fit, the earlier.
SIZE_SUFFIXES = {"GiB": 1024, "GB": 1024, "G": 1024, "MiB": 1, "MB": 1, "M": 1}


def _replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), pairs, text)


def _escaped(text: Column, named: dict[str, str], numbered: dict[str, str]) -> Column:
    common = _replaced(text, [("\\", "\\\\"), *named.items()])
    # The rare characters cost a pass each, so only texts that have one take them.
    rare = "[" + "".join(f"\\x{ord(c):02x}" for c in numbered) + "]"
    return F.when(text.rlike(rare), _replaced(common, list(numbered.items()))).otherwise(common)


def escape_line(text: Column) -> Column:
    """One-line form: backslash, newline, return and tab by name, other control characters as \\xNN."""
    rare = {chr(i): f"\\x{i:02x}" for i in [*range(32), 127] if chr(i) not in LINE_NAMED}
    return _escaped(text, LINE_NAMED, rare)


def json_string(text: Column) -> Column:
    """A JSON string with lower-case \\u00nn escapes; a null column gives null."""
    rare = {chr(i): f"\\u{i:04x}" for i in range(32) if chr(i) not in JSON_NAMED}
    return F.concat(F.lit('"'), _escaped(text, JSON_NAMED, rare), F.lit('"'))


def json_object(members: dict[str, Column]) -> Column:
    """A JSON object of strings in this order; null members are written as null."""
    parts = [F.concat(json_string(F.lit(name)), F.lit(":"), F.coalesce(json_string(value), F.lit("null"))) for name, value in members.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def render_pairs(pairs: list[tuple[str, Column, bool]]) -> Column:
    """name=value joined by spaces; values that are not marked safe are redacted."""
    return F.concat_ws(" ", *(F.concat(F.lit(f"{name}="), escape_line(value) if safe else F.lit("<redacted>")) for name, value, safe in pairs))


def fields_line(fields: dict[str, Column]) -> Column:
    """name=value joined by tabs."""
    return F.concat_ws("\t", *(F.concat(F.lit(f"{name}="), value) for name, value in fields.items()))


def fields_map(line: Column) -> Column:
    """The map of a fields_line: each field is split at its first equals sign."""
    return F.str_to_map(line, F.lit("\t"), F.lit("="))


def field(line: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(line, rf"(?:\A|\t){name}=([^\t]*)", 1), F.lit(""))


def normalized(text: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def hex_bytes(text: Column) -> Column:
    """Bytes of hexadecimal digits; white space is skipped; another character or an odd count gives null."""
    digits = F.regexp_replace(text, r"[ \n\r\t]", "")
    return F.when(digits.rlike(r"\A([0-9a-fA-F]{2})*\z"), F.unhex(digits))


def size_mib(text: Column) -> Column:
    """MiB, as a decimal of 38 digits, of a positive whole number of up to 34 digits with a size suffix, or null."""
    amount = F.regexp_extract(text, rf"\A0*([1-9][0-9]{{0,33}})(?:{'|'.join(SIZE_SUFFIXES)})\z", 1)
    factor = F.coalesce(*(F.when(text.endswith(s), F.lit(f)) for s, f in SIZE_SUFFIXES.items()))
    return (F.nullif(amount, F.lit("")).cast("decimal(34,0)") * factor.cast("decimal(4,0)")).cast("decimal(38,0)")


def unsigned_or_default(text: Column, default: str = "0") -> Column:
    """The digits of a stamp, the default where it is null or empty, and null where it is no unsigned number."""
    value = F.coalesce(F.nullif(text, F.lit("")), F.lit(default))
    return F.when(value.rlike(r"\A[0-9]+\z"), value)


def ordered_end(text: Column, markers: list[str]) -> Column:
    """One past the end of the last of these markers, found in order without overlap; null where one is missing."""
    position = F.lit(1)
    for marker in markers:
        found = F.call_function("locate", F.lit(marker), text, position)
        position = F.when(found > 0, found + len(marker))
    return position


def rewritten_once(text: Column, pattern: str, replacement: str) -> Column:
    """The text with the pattern replaced where it matches exactly once, else null."""
    return F.when(F.regexp_count(text, F.lit(pattern)) == 1, F.regexp_replace(text, pattern, replacement))
