"""Times: strptime formats, epoch numbers, shifts by seconds.

Functions take a column name or SQL expression and return a Column made of
built-in expressions only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strptime tokens and the matching Spark pattern letters.
TOKENS = {
    "%Y": "yyyy",
    "%y": "yy",
    "%m": "MM",
    "%d": "dd",
    "%H": "HH",
    "%I": "hh",
    "%M": "mm",
    "%S": "ss",
    "%f": "SSSSSS",
    "%p": "a",
    "%j": "DDD",
    "%b": "MMM",
    "%B": "MMMM",
    "%z": "[XXX][XX]",
}
# Patterns for text output, where optional parts are not allowed.
OUTPUT = {**TOKENS, "%z": "xx"}
# End of fixed values.


def spark_pattern(strptime_format: str, output: bool = False) -> str:
    """Spark date pattern of a strptime format; unknown tokens are refused."""
    tokens = OUTPUT if output else TOKENS
    parts = []
    for token, literal in re.findall(r"(%.)|([^%]+)", strptime_format):
        if token == "%%":
            parts.append("%")
        elif token:
            if token not in tokens:
                raise ValueError(f"time format token {token} has no Spark form")
            parts.append(tokens[token])
        else:
            parts.append(re.sub(r"[A-Za-z\[\]{}#']+", lambda m: "'" + m.group().replace("'", "''") + "'", literal))
    return "".join(parts)


def runtime_pattern_sql(fmt: str) -> str:
    """The same mapping as SQL text, for formats that arrive as a column."""
    quoted = f"regexp_replace({fmt}, '((?<=%[A-Za-z])[A-Za-z]+|(?<![%A-Za-z])[A-Za-z]+)', '\\'$1\\'')"
    for token, letters in TOKENS.items():
        quoted = f"replace({quoted}, '{token}', '{letters}')"
    return quoted


def epoch_or_minus_one_sql(text: str, pattern: str) -> str:
    return f"coalesce(unix_micros(try_to_timestamp({text}, {pattern})) / 1e6D, -1D)"


def datetime_to_timestamp(text: str, strptime_format: str) -> Column:
    """Epoch seconds of a text time, -1 when it does not parse."""
    pattern = spark_pattern(strptime_format).replace("'", "\\'")
    return F.expr(epoch_or_minus_one_sql(text, f"'{pattern}'"))


def unixtime_to_iso_sql(value: str) -> str:
    text = f"cast({value} AS STRING)"
    number = f"try_cast({text} AS DOUBLE)"
    # Year 9999 ends at 253402300799; later numbers are left as they are.
    usable = f"{text} RLIKE '^([0-9]+[.]?[0-9]*|[.][0-9]+)$' AND {number} <= 253402300799D"
    micros = f"cast(bround({number} * 1e6D) AS BIGINT)"
    iso = f"concat(date_format(timestamp_micros({micros}), 'yyyy-MM-dd\\'T\\'HH:mm:ss.SSS'), '+00:00')"
    return f"CASE WHEN {usable} THEN {iso} ELSE coalesce({text}, 'None') END"


def unixtime_to_iso_timestamp(value: str) -> Column:
    """Digits with at most one dot become ISO UTC text; all else is unchanged."""
    return F.expr(unixtime_to_iso_sql(value))


def shift_seconds(time: Column, seconds: Column | int, input_format: str | None, output_format: str) -> Column:
    """A time moved by whole seconds, written by a strptime output format."""
    parsed = F.to_timestamp(time, spark_pattern(input_format)) if input_format else time
    amount = F.lit(seconds) if isinstance(seconds, int) else seconds.cast("int")
    return F.date_format(F.timestamp_add("SECOND", amount, parsed), spark_pattern(output_format, output=True))


def local_to_epoch_millis(time: Column, zone: str, strptime_format: str) -> Column:
    """Wall-clock text read in a server's zone, as epoch milliseconds.

    An offset written in the text is dropped, as the zone replaces it.
    """
    bare = F.regexp_replace(time, r"(Z|[+-]\d{2}:?\d{2})$", "")
    pattern = spark_pattern(strptime_format.replace("%z", ""))
    return F.unix_millis(F.to_utc_timestamp(F.to_timestamp(bare, pattern), zone))
