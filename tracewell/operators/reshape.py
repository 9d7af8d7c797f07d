"""JSON and nested values to tables, lines, prompts and display cells."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.columns import col, cols, dtype, to_text


def dotted(df: DataFrame) -> DataFrame:
    """Structs become `a.b` columns, to any depth; lists are kept."""

    def leaves(value: Column, kind: T.DataType, name: str) -> list[Column]:
        if isinstance(kind, T.StructType):
            return [c for f in kind.fields for c in leaves(value.getField(f.name), f.dataType, f"{name}.{f.name}")]
        return [value.alias(name)]

    return df.select(*[c for f in df.schema.fields for c in leaves(col(f.name), f.dataType, f.name)])


def flatten_underscored(df: DataFrame) -> DataFrame:
    """Struct fields and list positions become `a_0_b` columns; a later equal path wins.

    List columns are as many as the longest list has elements, found in one
    aggregate per nesting level.
    """
    values = {f.name: col(f.name) for f in df.schema.fields}
    kinds = {f.name: f.dataType for f in df.schema.fields}
    while any(isinstance(k, (T.StructType, T.ArrayType)) for k in kinds.values()):
        lists = [n for n, k in kinds.items() if isinstance(k, T.ArrayType)]
        longest = {}
        if lists:
            sizes = df.agg(*[F.max(F.size(values[n])).alias(f"s{i}") for i, n in enumerate(lists)]).first()
            longest = {n: max(sizes[i] or 0, 0) for i, n in enumerate(lists)}
        next_values: dict[str, Column] = {}
        next_kinds: dict[str, T.DataType] = {}
        for name, kind in kinds.items():
            if isinstance(kind, T.StructType):
                parts = [(f"{name}_{f.name}", values[name].getField(f.name), f.dataType) for f in kind.fields]
            elif isinstance(kind, T.ArrayType):
                parts = [(f"{name}_{i}", F.get(values[name], F.lit(i)), kind.elementType) for i in range(longest[name])]
            else:
                parts = [(name, values[name], kind)]
            for path, value, path_kind in parts:
                next_values[path], next_kinds[path] = value, path_kind
        values, kinds = next_values, next_kinds
    return df.select(*[v.alias(n) for n, v in values.items()])


# The prefix of history keys.
HISTORY = "modification_history_"
# End of fixed values.


def _after_history(key: Column) -> Column:
    """The key without as many characters as the prefix has."""
    return F.right(key, F.char_length(key) - len(HISTORY))


def fold_history(df: DataFrame, entries: str, others: str = "fields", history: str = "modification_history") -> DataFrame:
    """`modification_history_<time>_<field>` keys of a map become an ordered list.

    One element {timestamp, fields} per time, in order of appearance; the other
    keys stay in a map. A row without such keys gets an empty list.
    """
    is_history = lambda k: F.contains(k, F.lit(HISTORY))
    rest = F.map_filter(col(entries), lambda k, v: ~is_history(k))
    parsed = F.transform(
        F.filter(F.map_entries(col(entries)), lambda e: is_history(e["key"])),
        lambda e: F.struct(
            F.regexp_extract(_after_history(e["key"]), "^([^_]*)_", 1).alias("time"),
            F.regexp_replace(_after_history(e["key"]), "^[^_]*_", "").alias("field"),
            e["value"].alias("value"),
        ),
    )
    times = F.array_distinct(F.transform(F.col("__parsed"), lambda p: p["time"]))
    folded = F.transform(
        times,
        lambda t: F.struct(
            t.alias("timestamp"),
            F.map_from_entries(
                F.transform(
                    F.filter(F.col("__parsed"), lambda p: p["time"] == t), lambda p: F.struct(p["field"], p["value"])
                )
            ).alias("fields"),
        ),
    )
    kept = [n for n in df.columns if n != entries]
    with_parsed = df.select(*cols(kept), rest.alias(others), parsed.alias("__parsed"))
    return with_parsed.select(*cols(kept), col(others), folded.alias(history))


def custom_fields(df: DataFrame, fields: str, names: Sequence[str] | None = None) -> DataFrame:
    """A list of {name, value (JSON text)} becomes columns.

    A value object gives its `name`; empty values are left out. Without `names`
    they are looked up once, with Spark's own limit on pivot columns.
    """
    if names is None:
        limit = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues", "10000"))
        found = df.select(F.explode(col(fields)).alias("f")).select("f.name").distinct().limit(limit + 1).collect()
        if len(found) > limit:
            raise ValueError(f"more than {limit} custom field names: pass `names`")
        names = sorted(r["name"] for r in found if r["name"] is not None)
    # JSON texts of empty values.
    empty = ("null", "false", "0", "0.0", '""', "", "[]", "{}")
    # End of fixed values.

    def one(name: str) -> Column:
        usable = F.filter(
            col(fields),
            lambda f: (f["name"] == name)
            & f["value"].isNotNull()
            & ~f["value"].isin(*empty)
            & (~F.startswith(f["value"], F.lit("{")) | F.get_json_object(f["value"], "$.name").isNotNull()),
        )
        value = F.get(usable, F.size(usable) - 1)["value"]
        text = F.when(F.startswith(value, F.lit('"')), F.from_json(F.concat(F.lit('{"v":'), value, F.lit("}")), "v STRING")["v"])
        return F.when(F.startswith(value, F.lit("{")), F.get_json_object(value, "$.name")).otherwise(F.coalesce(text, value))

    kept = [n for n in df.columns if n != fields]
    return df.select(*cols(kept), *[one(n).alias(n) for n in names])


def parent_child(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Objects become `parent_child` columns; lists of named objects become text joined by '/'.

    `$type`, objects inside objects and other top-level lists are left out.
    """
    out: list[Column] = []
    for f in df.schema.fields:
        if f.name in keep or not isinstance(f.dataType, (T.StructType, T.ArrayType)):
            out.append(col(f.name))
        elif isinstance(f.dataType, T.StructType):
            for child in f.dataType.fields:
                value = col(f.name).getField(child.name)
                if child.name == "$type" or isinstance(child.dataType, T.StructType):
                    continue
                if isinstance(child.dataType, T.ArrayType):
                    value = F.array_join(F.transform(value, lambda x: x["name"]), "/")
                out.append(value.alias(f"{f.name}_{child.name}"))
    return df.select(*out)


# Line ends: everything that ends a line of text, CR LF as one.
LINE_END = r"\r\n|[\n\u000B\f\r\u001C-\u001E\u0085\u2028\u2029]"


def matching_lines(df: DataFrame, text: str, word: str, line: str = "line", position: str = "line_no") -> DataFrame:
    """One row per line that holds `word`, with the line's position from 0."""
    kept = [n for n in df.columns if n != text]
    hits = df.where(F.contains(col(text), F.lit(word)))
    lines = hits.select(*cols(kept), F.posexplode(F.split(col(text), LINE_END)).alias(position, line))
    return lines.where(F.contains(F.col(line), F.lit(word)))


def markdown_lines(df: DataFrame) -> Column:
    """A row as a Markdown table line."""
    cells = [F.coalesce(to_text(df, n), F.lit("")) for n in df.columns]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def prompts(
    df: DataFrame,
    group: Sequence[str],
    order_by: Sequence[str],
    columns: Sequence[str],
    representation: str = "markdown",
    scenario: tuple[str | None, str | None] = (None, None),
    step: tuple[str | None, str | None] = (None, None),
    main: str = "",
    name: str = "prompt",
) -> DataFrame:
    """One prompt text per group: scenario and step texts around the group's rows.

    A prompt is one cell, so a group's rows end in one value; groups are what a
    reader is asked about at once (an order, a host and hour), not whole tables.
    """
    shown = df.select(*cols(columns))
    if representation == "markdown":
        line = markdown_lines(shown)
        head = "| " + " | ".join(columns) + " |\n|" + "|".join(":---" for _ in columns) + "|"
        table = lambda lines: F.concat(F.lit(head + "\n"), F.array_join(lines, "\n"))
    elif representation == "json":
        line = F.to_json(F.struct(*cols(columns)), {"ignoreNullFields": "false"})
        table = lambda lines: F.concat(F.lit("["), F.array_join(lines, ", "), F.lit("]"))
    else:
        raise ValueError(f"unknown representation {representation}")
    rows = df.select(*cols(group), F.struct(F.struct(*cols(order_by)).alias("o"), line.alias("line")).alias("__l"))
    gathered = rows.groupBy(*cols(group)).agg(F.sort_array(F.collect_list("__l")).alias("__ls"))
    parts = [
        F.lit(scenario[0]), F.lit(step[0]), table(F.col("__ls.line")), F.lit(step[1]), F.lit(scenario[1]), F.lit(main),
    ]
    # concat_ws leaves out the texts that are not given.
    return gathered.select(*cols(group), F.concat_ws("\n\n", *[p.cast("string") for p in parts]).alias(name))


def display_cells(df: DataFrame) -> DataFrame:
    """Cells for a grid: nulls are empty text, nested values JSON text, all text."""
    return df.select(*[F.coalesce(to_text(df, n), F.lit("")).alias(n) for n in df.columns])


def normalize_columns(df: DataFrame, to_text_columns: bool = False) -> DataFrame:
    """Names that differ only in case get `_<i>`, i counting the later ones from 0.

    With `to_text_columns` text and nested columns become text, null as ''.
    """
    seen: set[str] = set()
    names, later = [], 0
    for name in df.columns:
        if name.lower() in seen:
            name, later = f"{name}_{later}", later + 1
        else:
            seen.add(name.lower())
        names.append(name)
    out = df.toDF(*names)
    if not to_text_columns:
        return out
    nested = (T.StringType, T.ArrayType, T.MapType, T.StructType, T.BinaryType)
    return out.select(
        *[F.coalesce(to_text(out, n), F.lit("")).alias(n) if isinstance(dtype(out, n), nested) else col(n) for n in names]
    )


def text_values(df: DataFrame, encoding: str = "utf-8") -> DataFrame:
    """Times become ISO text, bytes text in the given encoding; other columns stay."""

    def value(field: T.StructField) -> Column:
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            second = F.date_format(col(field.name), "yyyy-MM-dd'T'HH:mm:ss")
            micros = F.date_format(col(field.name), "SSSSSS")
            return F.when(micros == "000000", second).otherwise(F.concat(second, F.lit("."), micros))
        if isinstance(field.dataType, T.DateType):
            return F.date_format(col(field.name), "yyyy-MM-dd")
        if isinstance(field.dataType, T.BinaryType):
            return F.decode(col(field.name), encoding)
        return col(field.name)

    return df.select(*[value(f).alias(f.name) for f in df.schema.fields])


def with_link(df: DataFrame, url: str, kind: str, key: str = "idReadable") -> DataFrame:
    """Add `link` = url/kind/key/; '?' where the key is missing."""
    if key not in df.columns:
        return df.withColumn("link", F.lit("?"))
    link = F.concat(F.lit(f"{url}/{kind}/"), col(key).cast("string"), F.lit("/"))
    return df.withColumn("link", F.when(col(key).isNotNull(), link).otherwise(F.lit("?")))


def rename_copies(df: DataFrame, copies: Mapping[str, str]) -> DataFrame:
    """New columns as copies of existing ones; a missing source fails."""
    missing = [s for s in copies.values() if s not in df.columns]
    if missing:
        raise ValueError(f"there is no column {missing} to copy")
    return df.select("*", *[col(source).alias(name) for name, source in copies.items()])
