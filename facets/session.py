"""Session helpers: durable lineage cuts and size-checked small tables."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A table is broadcast only when it was counted and has at most this many rows.
SMALL_ROWS = 20_000


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent
        target = f"{tempfile.mkdtemp(prefix='facets-package-')}/{package.name}"
        context.addPyFile(shutil.make_archive(target, "zip", package.parent, package.name))
        _shipped.add(context.applicationId)


def use_checkpoint_dir(spark: SparkSession) -> str:
    """Name the shared checkpoint folder, taking it from the session where it is configured."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is not None:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor shares")
        configured = tempfile.mkdtemp(prefix="facets-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


def cut(df: DataFrame) -> DataFrame:
    """Write the table to the shared checkpoint folder and continue from the written copy.

    Unlike a cache, the copy survives the loss of executors. Unlike a checkpointed plan, it carries
    no constraints of its past, which would grow from round to round of an iteration, and its size
    is known to the planner.
    """
    spark = df.sparkSession
    path = f"{use_checkpoint_dir(spark)}/facets-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_rows(df: DataFrame, max_rows: int = SMALL_ROWS):
    """Rows of ``df`` if there are at most ``max_rows`` of them, else None."""
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None


def attach(df: DataFrame, other: DataFrame, on, how: str = "inner",
           max_rows: int = SMALL_ROWS) -> DataFrame:
    """Join ``other`` to ``df``: broadcast when its counted size allows, else a shuffle join.

    The check reads at most ``max_rows + 1`` rows. The shuffle join leaves skewed keys of ``df`` to
    adaptive execution, which splits them.
    """
    rows = small_rows(other, max_rows)
    if rows is None:
        return df.join(other, on, how)
    fixed = df.sparkSession.createDataFrame(rows, other.schema)
    return df.join(F.broadcast(fixed), on, how)
