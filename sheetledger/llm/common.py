"""What the operators of this subpackage share: kept tables, Arrow text views, digests of ids."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shuffles_freed


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor reaches, as spark.checkpoint.dir names it.

    Where the setting is missing on a local master (tests), one is made and set for the session.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    made = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


_SCRATCH: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder of its own for all tables kept inside; ``drop_folder`` removes it when they are not needed any more."""
    _SCRATCH.append(f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}")
    try:
        yield _SCRATCH[-1]
    finally:
        _SCRATCH.pop()


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder through Spark's own file systems."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def forget(*tables: DataFrame) -> None:
    """Remove kept tables that nothing reads any more."""
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            drop_folder(table.sparkSession, folder)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a step's result to the shared folder and read it back: later steps survive lost executors.

    The shuffles behind it are freed.  Texts and ids are not worth a dictionary of values, so none is tried.
    """
    spark = df.sparkSession
    path = f"{_SCRATCH[-1] if _SCRATCH else shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        df.write.option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remainder(key: Column | str, n: int) -> Column:
    """crc32 of the key as text, modulo n: the folds of the held-out splits."""
    col = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and UTF-8 bytes of a string column, without a copy of the bytes; null counts as empty."""
    plain = pc.fill_null(column, "" if not pa.types.is_large_binary(column.type) else b"").cast(pa.large_binary())
    _, offsets, data = plain.buffers()
    if offsets is None or not len(plain):
        return np.zeros(len(plain) + 1, dtype=np.int64), np.empty(0, dtype=np.uint8)
    starts = np.frombuffer(offsets, dtype=np.int64)[plain.offset:plain.offset + len(plain) + 1]
    return starts, np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)


def row_runs(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``limit`` bytes together; a longer text stands alone."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """The texts of a column as UTF-8 bytes, one at a time; null counts as empty."""
    offsets, data = byte_view(column)
    view = memoryview(data)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield bytes(view[a:b])


def filtered(docs: DataFrame, text_col: str, judge: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows whose text ``judge`` says to keep, with all their columns; rows keep their places, nothing is shuffled."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(judge(batch.column(at)), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows whose id is not in ``gone`` (doc_id), a table of its own in the shared folder.

    Spark broadcasts the ids only if the written table is under its limit; else both sides are shuffled.
    """
    ids = keep(gone.select("doc_id"), "gone")
    return docs.join(ids, docs[id_col] == ids["doc_id"], "left_anti")
