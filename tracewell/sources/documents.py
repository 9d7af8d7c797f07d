"""Search documents: hit responses, filters, metric frames, row payloads."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.columns import col, cols, dtype


def filter_column(df: DataFrame, query: Mapping) -> Column:
    """A document filter as a predicate; anything that is not translated raises.

    Clauses: `bool` with `filter`, `must`, `must_not`, `should` (one clause or a list; some of `should` must hold if the
    other two positive lists are missing, or as `minimum_should_match` says), `range`, `term`, `terms`, `match_phrase`
    (whole values), `exists`, `match_all`. A missing value fulfils no clause; a list column does if any element does.
    """
    if not query:
        return F.lit(True)
    if len(query) != 1:
        raise ValueError(f"a filter is one clause, not {sorted(query)}")
    (kind, body), = query.items()
    if kind == "bool":
        return _bool_clause(df, body)
    if kind == "match_all":
        return F.lit(True)
    if kind == "exists":
        _only(body, {"field"}, kind)
        return col(body["field"]).isNotNull()
    if kind not in ("range", "term", "terms", "match_phrase"):
        raise ValueError(f"filter clause {kind} is not supported")
    return reduce(lambda a, b: a & b, [_value_clause(df, kind, name, wanted) for name, wanted in body.items()], F.lit(True))


def _only(body: Mapping, known: set[str], where: str) -> None:
    if unknown := set(body) - known:
        raise ValueError(f"{sorted(unknown)} in {where} is not supported")


def _bool_clause(df: DataFrame, body: Mapping) -> Column:
    _only(body, {"filter", "must", "must_not", "should", "minimum_should_match"}, "bool")

    def of(name: str) -> list[Column]:
        found = body.get(name, [])
        return [filter_column(df, c) for c in ([found] if isinstance(found, Mapping) else found)]

    needed = of("filter") + of("must")  # left as they are, for the scan to take them
    excluded, optional = ([F.coalesce(c, F.lit(False)) for c in of(name)] for name in ("must_not", "should"))
    least = int(body.get("minimum_should_match", 0 if needed or not optional else 1))
    if least:
        needed.append(reduce(lambda a, b: a + b, [c.cast("int") for c in optional], F.lit(0)) >= least)
    return reduce(lambda a, b: a & b, needed + [~c for c in excluded], F.lit(True))


def _value_clause(df: DataFrame, kind: str, name: str, wanted: object) -> Column:
    of = dtype(df, name)
    element = of.elementType if isinstance(of, T.ArrayType) else of

    def literal(value: object) -> Column:
        return F.lit(value).cast(element)

    def test(value: Column) -> Column:
        if kind == "range":
            _only(wanted, {"gte", "gt", "lte", "lt"}, "range")
            ops = {"gte": lambda b: value >= b, "gt": lambda b: value > b, "lte": lambda b: value <= b, "lt": lambda b: value < b}
            return reduce(lambda a, b: a & b, [ops[op](literal(bound)) for op, bound in wanted.items()], value.isNotNull())
        if kind == "terms":
            return value.isin(*[literal(x) for x in wanted])
        if isinstance(wanted, Mapping):
            inner = "value" if kind == "term" else "query"
            _only(wanted, {inner}, kind)
            return value == literal(wanted[inner])
        return value == literal(wanted)

    return F.exists(col(name), test) if isinstance(of, T.ArrayType) else test(col(name))


def scan_documents(
    documents: DataFrame,
    query: Mapping,
    fields: Sequence[str],
    sort: Sequence[Mapping[str, object]] = (),
    id_column: str = "_id",
    ordered: bool = False,
) -> DataFrame:
    """Filter, project, and keep one row per id: the first by the sort, missing values last.

    All matching rows are returned, as paging does. `ordered` sorts the result too, a range shuffle that a table
    does not need.
    """
    rows = documents.where(filter_column(documents, query))
    wanted = [id_column, *[f for f in fields if f != id_column]]
    orders = []
    for part in sort:
        for name, way in part.items():
            if isinstance(way, Mapping):
                _only(way, {"order"}, "sort")
                way = way["order"]
            if way not in ("asc", "desc"):
                raise ValueError(f"sort {name} is asc or desc, not {way}")
            orders.append((name, way))
    narrow = rows.select(*cols(dict.fromkeys([*wanted, *[n for n, _ in orders]])))
    unique = _first_by(narrow, id_column, orders)
    if ordered:
        unique = unique.orderBy(*[col(n).desc_nulls_last() if way == "desc" else col(n).asc_nulls_last() for n, way in orders])
    return unique.select(*cols(wanted))


def _first_by(df: DataFrame, key: str, orders: Sequence[tuple[str, str]]) -> DataFrame:
    """One row per key. Sorts of one direction are a partial aggregate; mixed ones need a window."""
    ways = {way for _, way in orders}
    if len(ways) > 1:
        order = [col(n).desc_nulls_last() if way == "desc" else col(n).asc_nulls_last() for n, way in orders]
        place = F.row_number().over(Window.partitionBy(col(key)).orderBy(*order))
        return df.withColumn("__place", place).where("__place = 1").drop("__place")
    row = F.struct(*cols(df.columns))
    if ways == {"desc"}:
        kept = F.max_by(row, F.struct(*[F.struct(col(n).isNotNull(), col(n)) for n, _ in orders]))
    else:
        kept = F.min_by(row, F.struct(*[F.struct(col(n).isNull(), col(n)) for n, _ in orders] or [F.lit(0)]))
    picked = df.groupBy(col(key)).agg(kept.alias("row"))
    return picked.select(*[F.col("row").getField(n).alias(n) for n in df.columns])


def unwrap_hits(responses: DataFrame, hits: str = "hits", lists: Sequence[str] | None = None) -> DataFrame:
    """Flat rows from hit responses: one-element lists become scalars of their type.

    `hits` is struct<hits: array<struct<_id, fields: struct<name: array>>>>; hits without fields are skipped. A column has
    one type, so a field with a longer list in any row shows its values as text: an only element as such, other lists as
    JSON. `lists` names those fields; without it one pass over the data finds them.
    """
    rows = responses.select(F.explode(col(hits)["hits"]).alias("h")).where("h.fields IS NOT NULL")
    fields = [f for f in rows.schema["h"].dataType["fields"].dataType.fields]
    arrays = [f.name for f in fields if isinstance(f.dataType, T.ArrayType)]
    if lists is None and arrays:
        sizes = rows.agg(*[F.max(F.size(F.col("h.fields").getField(n)) != 1).alias(f"c{i}") for i, n in enumerate(arrays)]).first()
        lists = [n for n, longer in zip(arrays, sizes) if longer]

    def shown(field: T.StructField) -> Column:
        value = F.col("h.fields").getField(field.name)
        if field.name not in arrays:
            return value
        only = F.get(value, F.lit(0))
        return F.when(F.size(value) == 1, only.cast("string")).otherwise(F.to_json(value)) if field.name in lists else only

    return rows.select(F.col("h._id").alias("_id"), *[shown(f).alias(f.name) for f in fields])


def first_response_rows(df: DataFrame, response: str, row_schema: str) -> DataFrame:
    """Rows of `[{"data": [...]}]` payloads: the data list of the first element."""
    parsed = F.from_json(col(response), f"ARRAY<STRUCT<data: ARRAY<STRUCT<{row_schema}>>>>")
    return df.select(F.get(parsed, F.lit(0))["data"].alias("__rows")).selectExpr("inline(__rows)")


def frame_labels(df: DataFrame, frames: str, labels: Sequence[str]) -> DataFrame:
    """One row per metric field that has labels, the wanted labels as columns.

    `frames` is array<struct<schema: struct<fields: array<struct<labels: map>>>>>.
    """
    fields = df.select(F.explode(col(frames)).alias("frame")).select(F.explode("frame.schema.fields").alias("f"))
    return fields.where("f.labels IS NOT NULL").select(*[F.col("f.labels")[name].alias(name) for name in labels])


def read_json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a given schema: no inference pass over the data."""
    return spark.read.schema(schema).json(path)


def api_rows(df: DataFrame, payload: str, row_schema: str) -> DataFrame:
    """Rows of an API answer: a list gives its elements, a single object one row."""
    many = F.from_json(col(payload), f"ARRAY<STRUCT<{row_schema}>>")
    one = F.from_json(col(payload), f"STRUCT<{row_schema}>")
    as_list = F.when(F.startswith(F.ltrim(col(payload)), F.lit("[")), many).otherwise(F.array(one))
    return df.select(as_list.alias("__rows")).selectExpr("inline(__rows)")
