"""Named SQL steps, chains of steps, query parameters."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from hashlib import sha256
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.register import pattern_first, register_functions
from tracewell.operators.reshape import normalize_columns


@contextmanager
def named_views(spark: SparkSession, inputs: Mapping[str, DataFrame], made: Sequence[str] = ()) -> Iterator[None]:
    """Inputs as temporary views while a query is analysed, then as it was before."""
    before = {n: spark.table(n) for n in [*inputs, *made] if spark.catalog.tableExists(n)}
    try:
        for name, df in inputs.items():
            df.createOrReplaceTempView(name)
        yield
    finally:
        for name in [*inputs, *made]:
            spark.catalog.dropTempView(name)
            if name in before:
                before[name].createOrReplaceTempView(name)


def sql_step(
    spark: SparkSession,
    inputs: Mapping[str, DataFrame],
    final_query: str,
    preparatory_queries: Sequence[tuple[str, str]] = (),
    parameters: Mapping[str, object] | None = None,
    to_text: bool = False,
    functions: bool = True,
) -> DataFrame:
    """One SELECT over named inputs, all in one lazy plan.

    `preparatory_queries` are (name, SELECT) pairs, run in order, each a view for
    the ones after it: tables are not changed in place, so adding or updating a
    column is a SELECT too. `parameters` are bound by name (`:name`), never put
    into the text. Empty inputs are registered like others.
    """
    if functions:
        register_functions(spark)
        native = spark.conf.get("spark.sql.parser.escapedStringLiterals", "false") == "false"
        final_query = pattern_first(final_query, native)
        preparatory_queries = [(name, pattern_first(select, native)) for name, select in preparatory_queries]
    views = {name: normalize_columns(df, to_text) for name, df in inputs.items()}
    made = [name for name, _ in preparatory_queries]
    with named_views(spark, views, made):
        for name, select in preparatory_queries:
            spark.sql(select, args=dict(parameters) if parameters else None).createOrReplaceTempView(name)
        return spark.sql(final_query, args=dict(parameters) if parameters else None)


@dataclass(frozen=True)
class Step:
    """A named result, built from the results of earlier steps."""

    name: str
    build: Callable[[Mapping[str, DataFrame]], DataFrame]
    show: bool = True


def run_chain(steps: Sequence[Step], inputs: Mapping[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Results by name, lazily: filters and projections cross step borders.

    A step that fails to build stops the chain. Persist a step's result in its
    builder when many later steps read it.
    """
    results: dict[str, DataFrame] = dict(inputs or {})
    for step in steps:
        if step.name in results:
            raise ValueError(f"there is already a result named {step.name}")
        results[step.name] = step.build(results)
    return results


class _Reads(dict):
    """Results that note which of them a step looks up."""

    def __init__(self, results: Mapping[str, DataFrame]) -> None:
        super().__init__(results)
        self.names: set[str] = set()

    def __getitem__(self, name: str) -> DataFrame:
        self.names.add(name)
        return super().__getitem__(name)

    def get(self, name: str, default=None):
        return self[name] if name in self else default


def plan_key(df: DataFrame) -> str:
    """Equal for results that are worked out alike from the same files: a key of the plan, its columns and its files."""
    parts = [str(df.semanticHash()), df.schema.json(), *sorted(df.inputFiles())]
    return sha256("\n".join(parts).encode()).hexdigest()[:32]


def run_chain_reused(steps: Sequence[Step], store: str, inputs: Mapping[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """run_chain, in which a step that several later steps read is worked out once, and never again while its plan is the same.

    Which steps are read more than once is found by building the chain; each is written below `store`, a folder all
    executors reach, under the key of its plan (plan_key), and its readers scan what is written. A later chain whose step
    has the same key scans it too. New input files, other parameters or other code make another key, and so a new
    result; files that change under the same name are not seen: take another store after such a change. Half of a
    result is never read: what was not written to its end is written again, in another folder.
    """
    reads: dict[str, int] = {}
    results: dict[str, DataFrame] = dict(inputs or {})
    for step in steps:
        if step.name in results:
            raise ValueError(f"there is already a result named {step.name}")
        seen = _Reads(results)
        results[step.name] = step.build(seen)
        for name in seen.names:
            reads[name] = reads.get(name, 0) + 1
    results = dict(inputs or {})
    for step in steps:
        df = step.build(results)
        results[step.name] = _stored(df, store, plan_key(df)) if reads.get(step.name, 0) > 1 else df
    return results


def _stored(df: DataFrame, store: str, key: str) -> DataFrame:
    """What is written under the key; written first if nothing is. Each writer has a folder, which it names when it is whole."""
    spark, named = df.sparkSession, f"{store.rstrip('/')}/done-{key}"
    try:
        path = spark.read.schema("path STRING").parquet(named).agg(F.min("path")).first()[0]
    except AnalysisException as error:  # not written yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        path = None
    if path is None:
        path = f"{store.rstrip('/')}/data-{key}-{uuid4().hex}"
        df.write.parquet(path)
        spark.range(1).select(F.lit(path).alias("path")).write.mode("append").parquet(named)
    return spark.read.schema(df.schema).parquet(path)


def shown(steps: Sequence[Step], results: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    return {s.name: results[s.name] for s in steps if s.show}


def nested_chain(chain: Callable[..., Mapping[str, DataFrame]], result: str, **parameters) -> DataFrame:
    """One named result of a chain, used as a source."""
    results = chain(**parameters)
    if result not in results:
        raise ValueError(f"the chain has no result named {result}; it has {sorted(results)}")
    return results[result]
