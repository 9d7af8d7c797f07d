"""Register the scalar functions for SQL steps, under their established names.

All but two are SQL functions: Catalyst inlines them, so they stay inside
generated code. `regexp` and `regexp_substr` are built-in names with the
arguments the other way round. The built-ins stay as they are: `pattern_first`
renames calls in the established order (pattern first) to functions with names
of their own: native ones where the pattern is a literal that means the same on
the JVM, Arrow-batched ones for all others. `regexp_search` and
`regexp_find_all` take patterns of the JVM.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tracewell.functions.network import ip_is_private_sql, ip_port_sql, validate_ip_sql
from tracewell.functions.text import bytes_to_string_sql, find_all_text_sql, native_pattern
from tracewell.functions.times import epoch_or_minus_one_sql, runtime_pattern_sql, unixtime_to_iso_sql

MOST_GROUPS = 3  # of native functions; patterns with more groups go the other way
NATIVE = {
    "ip_is_private(ip STRING)": ("BOOLEAN", ip_is_private_sql("ip")),
    "unixtime_to_iso_timestamp(x STRING)": ("STRING", unixtime_to_iso_sql("x")),
    "bytes_to_string(n STRING)": ("STRING", bytes_to_string_sql("n")),
    "ip_port2ip(s STRING)": ("STRING", ip_port_sql("s")),
    "validate_ip_address(s STRING)": ("BOOLEAN", validate_ip_sql("s")),
    "datetime_to_timestamp(s STRING, fmt STRING)": ("DOUBLE", epoch_or_minus_one_sql("s", runtime_pattern_sql("fmt"))),
    "regexp_search(pattern STRING, s STRING)": ("BOOLEAN", "s RLIKE pattern"),
    "regexp_find_all(pattern STRING, s STRING)": ("ARRAY<STRING>", "regexp_extract_all(s, pattern, 0)"),
    "pattern_native_regexp(pattern STRING, s STRING)": ("BOOLEAN", "s RLIKE pattern"),
    **{
        f"pattern_native_regexp_substr_{n}(pattern STRING, s STRING)": ("STRING", find_all_text_sql("pattern", "s", n))
        for n in range(MOST_GROUPS + 1)
    },
}


def pattern_first_functions():
    """Built inside a function so that workers get them by value, without this package."""

    def search(pattern: pd.Series, text: pd.Series) -> pd.Series:
        pairs = zip(pattern, text)
        return pd.Series([None if p is None or t is None else re.search(p, t) is not None for p, t in pairs], dtype=object)

    def find_all(pattern: pd.Series, text: pd.Series) -> pd.Series:
        pairs = zip(pattern, text)
        return pd.Series(["regexp_error" if p is None or t is None else str(re.findall(p, t)) for p, t in pairs], dtype=object)

    return F.pandas_udf(search, "boolean"), F.pandas_udf(find_all, "string")


# Quoted text and comments, which are left alone, or a call, with its first argument if that is a literal.
CALLS = re.compile(
    r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/|
    (?<![\w.])(?P<call>regexp|regexp_substr)\((?:\s*(?P<raw>r?)'(?P<pattern>(?:[^'\\]|\\.)*)'\s*(?=,))?""",
    re.I | re.S | re.X,
)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def literal_value(text: str, raw: bool) -> str | None:
    """What a literal stands for in SQL text; None for escapes by number."""
    if raw or "\\" not in text:
        return text
    if re.search(r"(?<!\\)(?:\\\\)*\\[0-9uUbZ%_]", text):
        return None
    return re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), text, flags=re.S)


def native_call(call: str, value: str | None) -> str | None:
    """The call of a native function with the pattern as its first argument, if there is one."""
    if value is None:
        return None
    try:
        compiled = re.compile(value)
    except re.error:
        return None  # an error of the pattern is for the running query to tell
    native = native_pattern(value)
    if native is None or compiled.groups > MOST_GROUPS:
        return None
    name = "pattern_native_regexp"
    if call.lower() == "regexp_substr":
        name += f"_substr_{compiled.groups}"
        if compiled.fullmatch("") or re.search(r"\(\?[=!]|\\b", value):
            # An empty match may not lie between the halves of a character beyond 16 bits.
            native = rf"(?![\x{{DC00}}-\x{{DFFF}}])(?:{native})"
    quoted = native.replace("\\", "\\\\").replace("'", "\\'")
    return f"{name}('{quoted}'"


def pattern_first(query: str, native: bool = True) -> str:
    """The query with calls of `regexp` and `regexp_substr` renamed; the infix operator has a space before its text.

    `native` is false where backslashes of literals stand for themselves (spark.sql.parser.escapedStringLiterals).
    """

    def renamed(match: re.Match) -> str:
        if not match["call"]:
            return match[0]
        found = None
        if native and match["pattern"] is not None:
            found = native_call(match["call"], literal_value(match["pattern"], bool(match["raw"])))
        return found or f"pattern_first_{match['call'].lower()}{match[0][len(match['call']):]}"

    return CALLS.sub(renamed, query)


def register_functions(spark: SparkSession) -> None:
    for signature, (kind, body) in NATIVE.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
    search, find_all = pattern_first_functions()
    spark.udf.register("pattern_first_regexp", search)
    spark.udf.register("pattern_first_regexp_substr", find_all)
