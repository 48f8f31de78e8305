"""Tables that queries derive from the given ones, and keep: built once in the shared folder, for as long as the given files are the same."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import SparkSession

from ..sources.commits import Files, Store
from ..sources.shared import shared_dir


def kept(spark: SparkSession, sf_dir: str, sources: tuple[str, ...], what: str, build: Callable[[Store], None]) -> Store:
    """The store of this name for these source tables, built where it isn't there yet."""
    stamp = [sf_dir]
    for name in sources:
        files = Files(spark, f"{sf_dir}/{name}.parquet")
        status = files.fs.getFileStatus(files.path(""))
        total = files.fs.getContentSummary(files.path(""))
        stamp += [name, status.getModificationTime(), total.getLength()]
    store = Store(spark, f"{shared_dir(spark)}/kept-{what}-{hashlib.md5(repr(stamp).encode()).hexdigest()}")
    if store.head()[0] < 0:
        build(store)
    return store
