"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from tempfile import gettempdir

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join may be broadcast up to this many rows of a few numbers each.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset and Spark runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"{gettempdir()}/checkpoints"
    return folder.rstrip("/")


@contextmanager
def batches_of(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Arrow batches of at most so many rows for what runs meanwhile: wide rows then need little memory on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        if rows:
            spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, batch_rows: int | None = None) -> DataFrame:
    """df as a table in the shared folder: its lineage is cut, and a lost executor costs nothing that was computed."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    with batches_of(df.sparkSession, batch_rows):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def small_side(df: DataFrame, rows: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint where its counted rows are within the bound; Spark's own choice of join otherwise."""
    return F.broadcast(df) if rows <= bound else df


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores before it as long as df has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def crc_fold(key: str | Column, folds: int) -> Column:
    """crc32 of the key as text, modulo folds."""
    return F.pmod(F.crc32(F.encode(F.col(key).cast("string") if isinstance(key, str) else key, "UTF-8")), F.lit(folds))


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about limit bytes of the text column each; a longer single text has its own slice."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


def to_copies(rows: DataFrame, classes: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """rows joined on key with classes, which have one row a key and its number of rows in copies.

    The classes with more than one of share rows, of which there are fewer than share, are broadcast, so no task gets a large
    class; the rest is shuffled. rows and classes should be written tables.
    """
    total = classes.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    large = F.col("copies") * share > total
    often = rows.join(F.broadcast(classes.where(large)), key)
    rest = rows.join(F.broadcast(classes.where(large).select(key)), key, "left_anti").join(classes.where(~large), key)
    return often.unionByName(rest)
