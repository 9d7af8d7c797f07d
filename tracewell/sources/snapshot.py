"""Reuse a stored result while it is young enough."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewell.sources.store import Part, VersionedStore


def snapshot(
    spark: SparkSession,
    root: str,
    name: str,
    ttl_seconds: float,
    build: Callable[[], DataFrame],
    now: float | None = None,
) -> DataFrame:
    """The newest finished result of `name`, if it started at most `ttl_seconds` ago.

    Otherwise the result is built, written and committed; a run that fails commits
    nothing, so half-written data is never reused. Of two runs that build side by side
    the first to commit is kept and given to both if it is young enough. Older results
    stay readable until `VersionedStore.expire`.
    """
    now = time.time() if now is None else now
    store = VersionedStore(spark, root)

    def young(listed: list[Part]) -> list[Part]:
        return [p for p in listed if p.name == name and now - p.written <= ttl_seconds]

    if not young(store.parts()):
        built = store.written(build(), name, at=now)
        store.commit(lambda listed: listed if young(listed) else [*[p for p in listed if p.name != name], built])
    return spark.read.parquet(max(store.parts(name=name), key=lambda p: p.written).folder)
