"""Typed column checks with defaults, for whole tables of parameters."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.columns import col, cols, quote
from tracewell.functions.network import validate_ip_address
from tracewell.functions.times import spark_pattern


FLOAT = r"(?i)^[+-]?(inf(inity)?|nan|([0-9]+(_[0-9]+)*[.]?([0-9]+(_[0-9]+)*)?|[.][0-9]+(_[0-9]+)*)(e[+-]?[0-9]+(_[0-9]+)*)?)$"


@dataclass(frozen=True)
class Rule:
    """Type of a text column: string, ip_address, datetime, integer, float, boolean, list, dict."""

    type: str
    required: bool = True
    default: str | None = None
    max_length: int | None = None
    format: str | None = None


def _fault(name: str, rule: Rule) -> Column:
    """What is wrong with a present value, null when nothing is."""
    value = col(name)
    if rule.type == "string":
        good = F.length(value) <= rule.max_length if rule.max_length is not None else F.lit(True)
        return F.when(~good, F.lit(f"{name}: longer than {rule.max_length}"))
    if rule.type == "ip_address":
        good = validate_ip_address(quote(name))
    elif rule.type == "datetime":
        good = F.try_to_timestamp(value, F.lit(spark_pattern(rule.format))).isNotNull()
    elif rule.type == "integer":
        good = F.trim(value).rlike(r"^[+-]?[0-9]+(_[0-9]+)*$")
    elif rule.type == "float":
        good = F.trim(value).rlike(FLOAT)
    elif rule.type == "boolean":
        good = F.lit(True)  # every value has a truth value
    elif rule.type == "list":
        good = F.schema_of_variant(F.try_parse_json(value)).startswith("ARRAY")
    elif rule.type == "dict":
        good = F.schema_of_variant(F.try_parse_json(value)).startswith("OBJECT")
    else:
        raise ValueError(f"unknown type {rule.type}")
    return F.when(~F.coalesce(good, F.lit(False)), F.lit(f"{name}: not a valid {rule.type}"))


def validate(df: DataFrame, rules: Mapping[str, Rule], client_ip: str | None = None) -> DataFrame:
    """Fill defaults and list the faults of every row in `violations`.

    Defaults are literals, `now` (datetime columns, in the column's format) or
    `client_ip`, and are checked like values. A missing value is a fault when
    required or without default.
    """
    filled, faults = [], []
    for name, rule in rules.items():
        if rule.required:
            value, missing = col(name), F.lit(f"{name}: required")
        elif rule.default is None:
            value, missing = col(name), F.lit(f"{name}: no default")
        else:
            if rule.type == "datetime" and rule.default == "now":
                default = F.date_format(F.current_timestamp(), spark_pattern(rule.format, output=True))
            elif rule.type == "ip_address" and rule.default == "client_ip":
                default = F.lit(client_ip)
            else:
                default = F.lit(rule.default)
            value, missing = F.coalesce(col(name), default), F.lit(f"{name}: no default")
        filled.append(value.alias(name))
        faults.append(F.when(col(name).isNull(), missing).otherwise(_fault(name, rule)))
    others = [n for n in df.columns if n not in rules]
    violations = F.filter(F.array(*faults), lambda x: x.isNotNull()).alias("violations")
    return df.select(*cols(others), *filled).select(*cols(others), *cols(rules), violations)
