"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a row group: a writer holds one, and Parquet's own 128 MB are much for tables that are read once or twice.
ROW_GROUP = 16 << 20

_held: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("held", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in spark.checkpoint.dir.

    Only where none is set and everything runs on one machine (a local master) a
    temporary one is made and kept in the session's settings; elsewhere that
    would lose rows, so it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tidemark.scratch.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("tidemark.scratch.dir", folder)
    return folder


def materialize(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    This cuts the lineage in a way that survives the loss of any executor: the
    rows that follow are read from files, not recomputed. ``keep``: the table
    outlives a ``released`` block.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{tag}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    if not keep and (held := _held.get()) is not None:
        held.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


@contextlib.contextmanager
def noted() -> Iterator[list[str]]:
    """The tables that ``materialize`` writes inside the block, for ``drop_tables`` later on."""
    mark = _held.set([])
    try:
        yield _held.get()
    finally:
        _held.reset(mark)


@contextlib.contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that ``materialize`` writes inside the block when the block ends.

    Whatever is to outlive them must have been written before, by other means or
    with ``keep``.
    """
    with noted() as paths:
        try:
            yield
        finally:
            drop_tables(spark, paths)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt to all tasks: a file of few bytes is one task's otherwise, however much each of its rows takes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
