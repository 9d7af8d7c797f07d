"""Pattern search and byte sizes as native expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def regexp_search(pattern: str, text: str) -> Column:
    """Does the pattern occur? Pattern first, as a Python string."""
    return F.expr(text).rlike(pattern)


def regexp_find_all(pattern: str, text: str) -> Column:
    """All matches as an array of strings; of a pattern with groups, group 1."""
    groups = re.compile(pattern).groups
    return F.regexp_extract_all(F.expr(text), F.lit(pattern), F.lit(1 if groups else 0))


# What is escaped in quoted text: all but letters, marks, numbers, punctuation, symbols and the space.
HIDDEN = "[\\\\p{C}\\\\p{Z}&&[^ ]]"


def shown_sql(value: str) -> str:
    """Characters that cannot be printed as \\x85, \\u200b and so on."""
    escapes = [f"concat('\\\\{kind}', lpad(lower(hex(ascii(c))), {digits}, '0'))" for kind, digits in (("x", 2), ("u", 4), ("U", 8))]
    one = f"CASE WHEN NOT c RLIKE '{HIDDEN}' THEN c WHEN ascii(c) < 256 THEN {escapes[0]} WHEN ascii(c) < 65536 THEN {escapes[1]} ELSE {escapes[2]} END"
    return f"CASE WHEN {value} RLIKE '{HIDDEN}' THEN array_join(transform(split({value}, ''), c -> {one}), '') ELSE {value} END"


def quoted_sql(value: str) -> str:
    """Python's quoted form of a string: single quotes unless only those occur inside."""
    escaped = f"replace({value}, '\\\\', '\\\\\\\\')"
    for raw, shown in (("\\n", "n"), ("\\r", "r"), ("\\t", "t")):
        escaped = f"replace({escaped}, '{raw}', '\\\\{shown}')"
    escaped = shown_sql(escaped)
    single = f"concat('\\'', replace({escaped}, '\\'', '\\\\\\''), '\\'')"
    double = f"concat('\"', {escaped}, '\"')"
    return f"CASE WHEN contains({value}, '\\'') AND NOT contains({value}, '\"') THEN {double} ELSE {single} END"


def find_all_text_sql(pattern: str, text: str, groups: int) -> str:
    """All matches as Python list text; several groups give tuples."""
    if groups <= 1:
        found = f"regexp_extract_all({text}, {pattern}, {groups})"
        items = f"transform({found}, m -> {quoted_sql('m')})"
    else:
        columns = ", ".join(f"regexp_extract_all({text}, {pattern}, {g})" for g in range(1, groups + 1))
        fields = ", ".join(quoted_sql(f"z.`{g}`") for g in range(groups))
        items = f"transform(arrays_zip({columns}), z -> concat('(', concat_ws(', ', {fields}), ')'))"
    body = f"concat('[', array_join({items}, ', '), ']')"
    return f"CASE WHEN {text} IS NULL OR {pattern} IS NULL THEN 'regexp_error' ELSE {body} END"


def regexp_substr(pattern: str, text: str) -> Column:
    """All matches as list text, e.g. ['a', 'b']; null text gives regexp_error."""
    literal = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.expr(find_all_text_sql(literal, text, re.compile(pattern).groups))


# Classes whose letters mean all of Unicode in patterns as they are established here, as the content of a bracket.
WIDE = {"d": r"\p{Nd}", "w": r"\p{L}\p{N}_", "s": r"\x09-\x0D\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"}
TOKENS = re.compile(
    r"""(?P<set>\[\^?(?:[^\]\\]|\\.)(?:[^\]\\]|\\.)*\])|\\(?P<escape>.)|\(\?P<(?P<name>[A-Za-z][A-Za-z0-9]*)>|(?P<same>\((?:\?[:=!])?(?!\?)|
    \{\d+(?:,\d*)?\}|[^\[\]\\(){}])""",
    re.S | re.X,
)
PLAIN_ESCAPES = frozenset("ntr.^$*+?()[]{}|/\\-'\"@#%&,:;<>=!~ `")


def native_pattern(pattern: str) -> str | None:
    """The same pattern for the JVM, or None where the two may differ (flags, look-behind, back references, odd classes).

    Letters, digits and blanks are those of all of Unicode, only a line feed ends a line.
    """
    out, place = ["(?d)"], 0
    while place < len(pattern):
        token = None if pattern[place] == ")" else TOKENS.match(pattern, place)
        if pattern[place] == ")":
            out.append(")")
            place += 1
            continue
        if token is None:
            return None
        place = token.end()
        if inside := token["set"]:
            start = "[^" if inside.startswith("[^") else "["
            parts = re.findall(r"\\.|.", inside[len(start) : -1], re.S)
            if not all(p[0] != "\\" or p[1] in WIDE or p[1] in PLAIN_ESCAPES for p in parts):
                return None
            parts = [WIDE.get(p[1], p) if p[0] == "\\" else "\\" + p if p in "[&^" else p for p in parts]
            out.append(start + "".join(parts) + "]")
        elif escape := token["escape"]:
            word = f"[{WIDE['w']}]"
            if escape in WIDE:
                out.append(f"[{WIDE[escape]}]")
            elif escape.lower() in WIDE:
                out.append(f"[^{WIDE[escape.lower()]}]")
            elif escape == "b":
                out.append(f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))")
            elif escape in PLAIN_ESCAPES:
                out.append("\\" + escape)
            else:
                return None
        else:
            out.append("(" if token["name"] else token["same"])
    return "".join(out)


# Size units, each 1024 times the one before.
UNITS = ("B", "KB", "MB", "GB", "TB", "PB", "EB", "ZB", "YB")
# End of fixed values.


def bytes_to_string_sql(value: str) -> str:
    """Size with two decimals in the largest fitting unit, chosen by thresholds."""
    number = f"try_cast({value} AS DOUBLE)"
    branches = []
    for power in range(len(UNITS) - 1, -1, -1):
        scale = f"{float(1024 ** power)!r}D"
        whole = f"floor({number})" if power < 6 else number  # from EB on a double has no fraction
        size = f"cast(bround({whole} / {scale}, 2) AS STRING)"
        branches.append(f"WHEN {number} >= {scale} THEN concat({size}, ' {UNITS[power]}')")
    return (
        f"CASE WHEN {number} IS NULL OR isnan({number}) OR {number} >= {float(1024 ** len(UNITS))!r}D OR {number} <= -1D THEN 'nan' "
        f"WHEN {number} < 1D THEN '0B' {' '.join(branches)} END"
    )


def bytes_to_string(value: str) -> Column:
    return F.expr(bytes_to_string_sql(value))
