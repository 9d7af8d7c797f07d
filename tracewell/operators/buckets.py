"""Nested bucket aggregation, and bucket responses turned into tables."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.columns import attach, col, cols
from tracewell.operators.aggregate import bucket_start
from tracewell.session import cut_lineage


@dataclass(frozen=True)
class Terms:
    """Buckets by value; with `size` only the largest ones of each parent bucket."""

    field: str
    size: int | None = None
    kind: str = field(default="terms", init=False)


@dataclass(frozen=True)
class DateHistogram:
    field: str
    interval: str
    kind: str = field(default="date_histogram", init=False)


# Kinds of aggregations that make buckets, and metric names with their aggregates.
BUCKET_KINDS = {
    "terms", "multi_terms", "rare_terms", "significant_terms", "date_histogram", "auto_date_histogram", "histogram", "range", "date_range", "ip_range",
    "composite", "geohash_grid",
}
METRICS = {
    "avg": F.avg,
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "value_count": F.count,
    "cardinality": F.count_distinct,
}
# End of fixed values.


def bucket_aggregate(
    df: DataFrame, layers: Sequence[Terms | DateHistogram], metrics: Mapping[str, str] | None = None
) -> DataFrame:
    """One row per innermost bucket: layer keys, doc_count, metrics {column: kind}.

    Columns are named `<field>_<kind>`. Leaves are aggregated once; the size
    limits then work on bucket counts, not on rows.
    """
    names, keys = [], []
    for layer in layers:
        names.append(f"{layer.field}_{layer.kind}")
        keys.append(
            bucket_start(df, layer.field, layer.interval) if isinstance(layer, DateHistogram) else col(layer.field)
        )
    keyed = df.select("*", *[k.alias(f"__b{i}") for i, k in enumerate(keys)])
    for i in range(len(keys)):
        keyed = keyed.where(F.col(f"__b{i}").isNotNull())
    values = [METRICS[kind](col(c)).alias(f"{c}_{kind}") for c, kind in (metrics or {}).items()]
    out = keyed.groupBy(*[F.col(f"__b{i}").alias(n) for i, n in enumerate(names)]).agg(
        F.count(F.lit(1)).alias("doc_count"), *values
    )
    if any(isinstance(layer, Terms) and layer.size is not None for layer in layers):
        # Kept, so that the limits read the buckets and not the rows again.
        out = cut_lineage(out)
    for i, layer in enumerate(layers):
        if isinstance(layer, Terms) and layer.size is not None:
            here = names[: i + 1]
            counts = out.groupBy(*cols(here)).agg(F.sum("doc_count").alias("__count"))
            window = Window.partitionBy(*cols(names[:i])).orderBy(F.desc("__count"), col(names[i]))
            kept = counts.withColumn("__place", F.row_number().over(window)).where(F.col("__place") <= layer.size)
            out = attach(out, kept.select(*cols(here)), here, "left_semi")
    return out


def request_layers(aggs: Mapping) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(layers, metrics) of an aggregation request as (name, column name) pairs.

    A response is read from its first top-level aggregation, whatever else was asked for. Below it the last aggregation
    that makes buckets is the next layer; the others at its level are metrics of the layer around them.
    """
    layers: list[tuple[str, str]] = []
    metrics: list[tuple[str, str]] = []

    def header(name: str, body: Mapping) -> str:
        for kind, options in body.items():
            if kind != "aggs" and isinstance(options, Mapping) and "field" in options:
                return f"{options['field']}_{kind}"
        return name

    level = dict(aggs)
    while level:
        nested = [n for n, body in level.items() if "aggs" in body or BUCKET_KINDS & set(body)]
        if not layers:
            layer = next(iter(level))
        else:
            layer = nested[-1] if nested else None
            metrics.extend((n, header(n, body)) for n, body in level.items() if n not in nested)
        if layer is None:
            break
        layers.append((layer, header(layer, level[layer])))
        level = dict(level[layer].get("aggs", {}))
    return layers, metrics


def response_schema(layers: Sequence[tuple[str, str]], metrics: Sequence[tuple[str, str]], leaf_keys: Sequence[str] = ()) -> str:
    metric_type = "STRUCT<value: STRING, value_as_string: STRING>"
    shape = ""
    for name, _ in reversed(layers):
        leaf = [*(f", `{m}`: {metric_type}" for m, _ in metrics), *(f", `{k}`: STRING" for k in leaf_keys)]
        inner = "".join(leaf) if not shape else f", {shape}"
        shape = f"`{name}`: STRUCT<buckets: ARRAY<STRUCT<key: STRING, key_as_string: STRING, doc_count: BIGINT{inner}>>>"
    return f"STRUCT<aggregations: STRUCT<{shape}>, rawResponse: STRUCT<aggregations: STRUCT<{shape}>>>"


def flatten_buckets(
    df: DataFrame, response: str, aggs: Mapping | str, carry: Sequence[str] = (), leaf_keys: Sequence[str] = ()
) -> DataFrame:
    """Rows of a bucket response held as JSON text, one per innermost bucket.

    A metric prefers its text value over its number. `rawResponse` wrappers are
    looked into. `carry` columns of the response row are kept. `leaf_keys` names
    further plain keys of the innermost buckets, such as `from` and `to` of a
    range, which keep their names and come as text.
    """
    layers, metrics = request_layers(json.loads(aggs) if isinstance(aggs, str) else aggs)
    parsed = F.from_json(col(response), response_schema(layers, metrics, leaf_keys)).alias("r")
    root = F.coalesce(F.col("r.rawResponse.aggregations"), F.col("r.aggregations"))
    rows = df.select(*cols(carry), parsed).select(*cols(carry), root[layers[0][0]]["buckets"].alias("buckets"))
    headers: list[str] = []
    for depth, (_, header) in enumerate(layers):
        exploded = rows.select(*cols(carry), *cols(headers), F.explode("buckets").alias("b"))
        headers.append(header)
        here: list[Column] = [*cols(carry), *cols(headers[:-1]), F.col("b.key").alias(header)]
        if depth + 1 < len(layers):
            rows = exploded.select(*here, F.col("b")[layers[depth + 1][0]]["buckets"].alias("buckets"))
        else:
            values = [
                F.coalesce(F.col("b")[m]["value_as_string"], F.col("b")[m]["value"]).alias(h) for m, h in metrics
            ]
            rows = exploded.select(*here, F.col("b.key_as_string"), F.col("b.doc_count"), *values, *[F.col("b")[k].alias(k) for k in leaf_keys])
    return rows
