"""Small helpers that the corpus operators share."""

from __future__ import annotations

import gc
import pickle
import sys
import types
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where a local session names no shared folder, as in tests on one machine.
FALLBACK_CHECKPOINTS = "/tmp/checkpoints/panelwright"
#: Share of documents (remainder of the id's checksum) that no model may learn labels from.
HELD_OUT_MODULUS, HELD_OUT_REMAINDER = 4, 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or our own where that is unset."""
    set_by_cluster = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(set_by_cluster)
        return set_by_cluster.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: on a cluster it must name a folder that driver and executors share")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(FALLBACK_CHECKPOINTS)
    return FALLBACK_CHECKPOINTS


def share(spark: SparkSession, value: object) -> Callable[[], object]:
    """Broadcasts a value together with the code of its classes, so that executors need not have this package installed."""
    sent, own = spark.sparkContext.broadcast(cloudpickle.dumps(value)), []

    def get() -> object:
        if not own:
            own.append(pickle.loads(sent.value))
        return own[0]

    return get


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computed once, kept in the shared folder, so a lost executor repeats nothing before it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/panelwright-{kind}-{uuid.uuid4().hex}"


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves the reserved remainder; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % HELD_OUT_MODULUS == HELD_OUT_REMAINDER, F.lit(False))


def only(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns, so that extra columns with clashing names never meet ours."""
    return df.select(*[df[n] for n in names])


def bounded_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> None:
    """Smaller Arrow batches for stages that carry whole texts both ways: a batch is held several times, on both sides."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def worker_cache(kind: str) -> dict:
    """A dictionary that this Python worker keeps from task to task. Another kind empties it: a worker holds one at a time."""
    kept = sys.modules.setdefault("_panelwright_cache", types.ModuleType("_panelwright_cache")).__dict__
    if kept.get("kind") != kind:
        kept["kind"], kept["own"] = kind, {}
        gc.collect()
    return kept["own"]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column without a copy, and the n + 1 offsets of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column, wide = column.cast(pa.large_string()), True
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    first = offsets[0] if len(offsets) else 0
    return data[first : offsets[-1] if len(offsets) else 0], offsets - first
