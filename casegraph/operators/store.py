"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager, nullcontext
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: With this setting a query's shuffle files go when the query ends, instead of when the driver happens to collect its garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's `spark.checkpoint.dir`; only a local session may fall back to a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    return path.rstrip("/")


@contextmanager
def _set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Queries that begin within have this setting; the session's is as before afterwards."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def fixed_plans(spark: SparkSession, small: bool) -> AbstractContextManager[None]:
    """If `small`, queries that begin within are planned once: of small tables a plan anew for each shuffle, its job and its threads cost
    the driver more than they save."""
    return _set(spark, "spark.sql.adaptive.enabled", "false") if small else nullcontext()


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet below the shared folder and read again: lineage ends here, and the shuffles behind it are freed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/casegraph/{name}-{uuid.uuid4().hex}"
    with _set(spark, FREED, "true"):  # shuffle files go when this query ends
        df.write.option("compression", "zstd").parquet(path)
    if (made := _made.get()) is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What `make` returns, written; the tables that make wrote on its way are deleted then, so no other plan may read them."""
    token = _made.set(made := [])
    try:
        out = make()
    finally:
        _made.reset(token)
    out = written(out, name)
    for path in made:
        _delete(out.sparkSession, path)
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes what written() wrote for `tables`, once no plan that is still to run reads them."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            _delete(df.sparkSession, file.rpartition("/")[0])


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getParent().getName() == "casegraph":
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def fresh_name(base: str, taken: list[str]) -> str:
    """A column name that does not clash with any of `taken` (case-insensitive, as Spark resolves names)."""
    low = {x.lower() for x in taken}
    while base.lower() in low:
        base = "_" + base
    return base


def iterate(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], rounds: int, done: Callable[[DataFrame, DataFrame], bool] | None = None, every: int = 1, name: str = "state") -> DataFrame:
    """Applies `step` up to `rounds` times; lineage is cut every `every` rounds, and `done(before, after)` is asked there."""
    state = written(state, name)
    before = state
    for i in range(rounds):
        state = step(state, i)
        if (i + 1) % every == 0 or i + 1 == rounds:
            state = written(state, name)
            if done and done(before, state):
                break
            before = state
    return state
