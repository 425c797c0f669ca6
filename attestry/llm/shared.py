"""Reliable storage between stages, safe column names and row maps."""

from __future__ import annotations

import ctypes
import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from attestry.session import ship


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the shared folder that the cluster names. Only a local master gets a temporary one where none is set (tests); elsewhere executors wouldn't share it."""
    if spark.conf.get("spark.checkpoint.dir", None) is None and not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="attestry-"))


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared checkpoint folder and reads from there: later stages survive lost executors and Spark's cleaner drops the files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


#: glibc's call that returns free pages of its heap, where there is one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Returns memory that was freed to the system; else a process keeps what its largest batch took."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def column(name: str) -> Column:
    """A column by its literal name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores appended until no column is called so (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def text_map(make: Callable[[], Callable[[pa.Array], pa.Array]], kind: str):
    """A column function over Arrow batches of one string column.

    ``make`` runs once in each task and returns the function applied to every
    batch. Only that column travels to Python; the other columns of the row
    wait in the JVM. Nulls arrive as empty text.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        apply = make()
        for batch in batches:
            yield apply(batch)
            give_back()

    ship()
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    udf = arrow_udf(run, kind)
    return lambda text: udf(F.coalesce(text.cast("string"), F.lit("")))
