"""Helpers shared by the text operators: cut points, text bytes, stable row numbers."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorgrid.session import shared_dir

#: Rows of one Arrow batch; texts may be long, so batches are short.
BATCH_ROWS = 2000
#: White space that separates words, as a Java or Python character class.
SPACE = r"\x20\x09-\x0D"
_ROW_BITS = 33
#: Columns that tell the rows of `located` apart.
PLACE = ["file", "pos"]


def prepare(spark) -> None:
    """Session settings the operators rely on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def cut(frame: DataFrame, purpose: str) -> DataFrame:
    """`frame` written to the shared folder and read again.

    Later steps read the files, so a lost executor costs no recomputation, and values
    such as row numbers are the same in every later read.
    """
    path = shared_dir(frame.sparkSession, purpose)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def give_back() -> None:
    """Return the memory that finished tasks of this Python worker have freed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def text_of(name: str = "text") -> Column:
    """Text column, null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def numbered(frame: DataFrame, name: str) -> DataFrame:
    """A unique long per row: partition and place in it. Stable only behind `cut`."""
    return frame.withColumn(name, F.monotonically_increasing_id())


def located(frame: DataFrame) -> DataFrame:
    """(row, file, pos): each row as a struct, its file, and its position in that file.

    However a scan is split, a row keeps its place, so two jobs may read `frame` and be
    joined on PLACE. What is no scan of Parquet files is written first.
    """
    def places(scan: DataFrame) -> DataFrame:
        own = scan.metadataColumn("_metadata")
        return scan.select(
            F.struct("*").alias("row"),
            own["file_path"].alias("file"), own["row_index"].alias("pos"),
        )

    try:
        return places(frame)
    except AnalysisException:
        return places(cut(frame, "located"))


def part_of(name: str) -> Column:
    """Write partition of a row number."""
    return F.shiftright(F.col(name), _ROW_BITS)


def place_of(name: str) -> Column:
    """Place within its write partition of a row number."""
    return F.col(name).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
