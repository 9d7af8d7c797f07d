"""Result files. Every writer makes a folder of part files, written in parallel."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.columns import col, to_text
from tracewell.operators.rows import first_per_key

PAGE, ORDER = "__page", "__order"


def flat(df: DataFrame) -> DataFrame:
    """CSV has no nested values: they are written as JSON text."""
    nested = {"array", "map", "struct"}
    return df.select(
        *[to_text(df, f.name).alias(f.name) if f.dataType.typeName() in nested else col(f.name) for f in df.schema.fields]
    )


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    # Quotes inside cells are doubled, as spreadsheet programs expect.
    flat(df).write.mode(mode).csv(path, header=True, encoding="UTF-8", escape='"')


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_parquet(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).parquet(path)


def write_named(results: Mapping[str, DataFrame], root: str, kind: str = "csv", mode: str = "error") -> dict[str, str]:
    """One folder per named result; returns the folders."""
    writer = {"csv": write_csv, "json": write_json, "parquet": write_parquet}[kind]
    paths = {name: f"{root.rstrip('/')}/{name}" for name in results}
    for name, df in results.items():
        writer(df, paths[name], mode)
    return paths


def append_pages(pages: DataFrame, path: str, id_column: str = "_id", dedupe: bool = True) -> None:
    """Add a page of documents. With `dedupe` ids repeated inside the page are written once;
    repeats over pages stay, to be dropped on `_id` when the export is read."""
    rows = first_per_key(pages, [id_column], [id_column]) if dedupe else pages
    write_csv(rows, path, "append")


def write_pages_once(pages: Iterable[DataFrame], path: str, work: str, id_column: str = "_id", mode: str = "error") -> None:
    """An export in which every id is written once, as it stands in the first page that has it.

    Pages are taken one at a time (an iterator may fetch them), kept as Parquet below `work`, a new folder that all
    executors reach, and read back in one plan: ids meet in one partial aggregate, and no page is read twice from its source.
    Rows without an id are one id. Of rows of one page with the same id the one with the least text of its columns is
    kept. Columns are those of all pages, missing ones are null. No pages are an error.
    """
    stored: DataFrame | None = None
    for number, page in enumerate(pages):
        kept = f"{work.rstrip('/')}/page-{number}"
        page.write.parquet(kept)
        page = page.sparkSession.read.schema(page.schema).parquet(kept).withColumn(PAGE, F.lit(number))
        stored = page if stored is None else stored.unionByName(page, allowMissingColumns=True)
    if stored is None:
        raise ValueError("an export needs at least one page")
    texts = [F.coalesce(to_text(stored, c), F.lit("")) for c in stored.columns if c != PAGE]
    ranked = stored.withColumn(ORDER, F.struct(col(PAGE), F.array(*texts)))
    write_csv(first_per_key(ranked, [id_column], [ORDER]).drop(PAGE, ORDER), path, mode)
