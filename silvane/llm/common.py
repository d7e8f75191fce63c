"""Shared Spark plumbing of the operators: input columns, Arrow mapping, checkpoints."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch: a few MB of ordinary documents.
BATCH_ROWS = 1000
#: Bytes of an Arrow batch, where Spark can bound them.
BATCH_BYTES = 16 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, under its own names whatever else the table holds; null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def small_batches(df: DataFrame) -> DataFrame:
    """The same rows; from now on the session makes Arrow batches of a size that suits whole texts."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        known = conf.get(key, None)
        if known is None or not known.isdigit() or int(known) > most:
            conf.set(key, str(most))
    return df


#: What a Python worker keeps from one task to the next: of one operator at a time.
_KEPT: dict[str, tuple[Any, Any]] = {}


def release(but: str = "") -> None:
    """Free what other operators left in this worker, and give the memory back to the system.

    Workers outlive a task; without this, a tokenizer of one stage stays in memory all through the next.
    """
    left = [k for k in _KEPT if k != but]
    for k in left:
        del _KEPT[k]
    if left:
        _trim()


def _trim() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def kept(operator: str, key: Any, make: Callable[[], Any]) -> Any:
    """The value of an operator under the key, made once a worker; other keys and operators are forgotten."""
    release(operator)
    if operator not in _KEPT or _KEPT[operator][0] != key:
        _KEPT.pop(operator, None)
        _KEPT[operator] = (key, make())
        _trim()
    return _KEPT[operator][1]


def map_batches(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, operator: str = "") -> DataFrame:
    """``mapInArrow`` with a function of one batch; what the operator ``kept`` stays in the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(operator)
        for batch in batches:
            if batch.num_rows:
                out = each(batch)
                if out is not None and out.num_rows:
                    yield out

    return small_batches(df).mapInArrow(run, schema)


def row_key(doc_id: Column, text: Column) -> Column:
    """128 bits that stand for a row's id and text: rows of equal keys are repeats of each other."""
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("-")), text)))


def hidden(key: Column) -> Column:
    """The same 128-bit key, as an expression that hides how its rows are dealt out.

    Spark then shuffles a sum by key once more before it is joined, which costs little, and can split the
    other side of the join where one key holds many rows.
    """
    return F.substring(key, 1, 16)


def _folder(spark: SparkSession) -> str:
    """The shared folder for checkpoints and tables; a folder of this machine only in local mode, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="silvane-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    _folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written as a table to the shared folder and read back: for large results, which Parquet holds smaller."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch with the columns of the schema in order, cast where a numpy array or list is given."""
    return pa.RecordBatch.from_arrays([x if isinstance(x := columns[f.name], pa.Array) and x.type == f.type else pa.array(x, f.type) for f in schema], schema=schema)
