"""Settings that the operators read from the session."""

from __future__ import annotations

import contextlib
import gc
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows in the shared checkpoint folder, without lineage. Only where no folder is set (as in tests) a local one is."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


def settled(df: DataFrame) -> DataFrame:
    """`checkpointed`, and the shuffle files of all that came before may go."""
    out = checkpointed(df)
    del df
    release(out.sparkSession)
    return out


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Bounds the rows of an Arrow batch, as texts are long. It holds for the session, and is never raised."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def slices(batches: Iterator[pd.DataFrame], text: str, limit: int = 2 << 20) -> Iterator[pd.DataFrame]:
    """The same rows in frames of about `limit` characters of text, a longer text alone in its frame."""
    for frame in batches:
        size = frame[text].str.len().fillna(0).cumsum()
        for _, part in frame.groupby((size // limit).astype("int64"), sort=False):
            yield part


def arrow_slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of text, a longer text alone in its batch. Columns stay as they are in
    Arrow, so that integers with nulls keep all digits."""
    for batch in batches:
        if batch.num_rows:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False)) // limit
            cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield batch.slice(a, b - a)


def with_columns(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The batch with columns added, in that order."""
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], [*batch.schema.names, *columns])


def schema_with(df: DataFrame, added: str) -> StructType:
    """The columns of `df`, and added ones that are given as in SQL."""
    return StructType([*df.schema.fields, *StructType.fromDDL(added).fields])


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle and checkpoint files of rows that nothing refers to any more, in the midst of a loop, and
    hands memory that the driver has freed back to the system."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> None:
    """Hands back what the driver's JVM has freed outside its heap. Compiling the code of many plans takes memory from the C
    library by many threads, which it otherwise keeps: some hundreds of MB. Where the JVM lacks the command, nothing is done."""
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm

    def array(kind, *values):
        out = gateway.new_array(kind, len(values))
        for i, x in enumerate(values):
            out[i] = x
        return out

    kinds = [jvm.Class.forName(x) for x in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
    with contextlib.suppress(Py4JJavaError):
        # the server's own class isn't open to calls, its interface is
        call = jvm.Class.forName("javax.management.MBeanServer").getMethod("invoke", array(jvm.Class, *kinds))
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), array(jvm.Object, name, "systemTrimNativeHeap", None, None))
