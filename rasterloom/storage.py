"""Tables between steps, in the folder that the driver and all executors share.

A step that iterates, or whose result is read more than once, writes its rows there and reads them back: the lineage
ends at a table, so a lost executor costs the step it was in and no more. Once a table is written, nothing needs the
shuffle files of the plan that wrote it, so Spark is told to drop them then.
"""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting: whether a query's shuffle files go as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables written and not yet deleted, by path, in the order written.
_live: dict[str, None] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset and all runs in one process, a temporary one.

    A machine's own folder is refused on a cluster: other executors and the driver would not see what is in it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise RuntimeError(f"spark.checkpoint.dir is not set; on {master} it must name a folder that all executors share")
    own = getattr(shared_dir, "own", None)
    if not own:
        own = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="rasterloom-")
    return own


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that end inside leave no shuffle files."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """Cuts the lineage: writes the rows as a table in the shared folder and reads it back."""
    path = f"{shared_dir(df.sparkSession)}/rasterloom-{name}-{uuid.uuid4().hex}"
    with _shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    _live[path] = None
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _live.pop(path, None)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that written() made, when nothing lazy reads them any more."""
    for df in tables:
        _delete(df.sparkSession, df._written_at)


def live() -> list[str]:
    """Paths of the tables written and not discarded, oldest first."""
    return list(_live)


@contextlib.contextmanager
def only(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes, at its end, all tables written inside but those put into the list it gives; after an error, all of them."""
    before, keep = set(_live), []
    try:
        yield keep
    except BaseException:
        keep.clear()
        raise
    finally:
        kept = {df._written_at for df in keep}
        for path in [p for p in _live if p not in before and p not in kept]:
            _delete(spark, path)
