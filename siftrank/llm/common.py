"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from siftrank.session import scratch_path

#: White space between words: the blank and \x09-\x0D, as ``bytes.split()`` has it.
WORD_SPACE = " \t\n\x0b\x0c\r"


def text_of(name: str = "text") -> Column:
    """The text of a row; a null text is an empty one."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A key from what a row holds, so that missing or repeated ids do no harm.

    Rows alike in both columns share the key; whatever an operator finds for one
    of them holds for the others.
    """
    held = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    return F.md5(F.concat_ws("\x00", held, text_of(text)))


def carried(df: DataFrame, names: Sequence[str]) -> Column:
    """Columns of ``df`` as one struct, out of the way of an operator's own names."""
    return F.struct(*[F.col(f"`{name}`") for name in names])


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again.

    Later branches read the files, so a lost executor costs no recomputation of
    what stands before, and Spark knows the size when it picks a join.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _give_back() -> None:
    """Free memory of a task that has ended goes back to the system, not to the next task's worker."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def by_batch(
    df: DataFrame,
    function: Callable[..., pa.RecordBatch | None],
    schema: str | StructType,
    prepare: Callable[[], object] | None = None,
) -> DataFrame:
    """``function`` on every Arrow batch, with what ``prepare`` makes once for a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (prepare(),) if prepare else ()
        for batch in batches:
            made = function(batch, *held)
            if made is not None and made.num_rows:
                yield made
            del made
        del held
        _give_back()

    return df.mapInArrow(run, schema)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
