"""Helpers shared by the operators that run Python on Arrow batches."""

from __future__ import annotations

import gc
import hashlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# odd multipliers of the 64-bit mixer
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Unset, a local one does, but only where driver and executors are one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
    return f"file://{tempfile.gettempdir()}/annalist-shared-{os.getpid()}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written in the shared folder: later reads survive lost executors and recompute nothing."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", str(32 << 20)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``written`` made and that nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for at in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(conf).delete(path, True)


HOT_KEYS = 50_000  # keys that salted_join can treat as hot: a bound of what it broadcasts
HOT_ROWS = 512  # rows that any key may have in one task


def salted_join(rows: DataFrame, one: DataFrame, key: str, by: str, how: str = "inner", counts: DataFrame | None = None, total: int | None = None) -> DataFrame:
    """``rows`` joined on ``key`` with ``one``, which has one row a key, where few keys may hold most of ``rows``.

    A key is hot if it has more than HOT_ROWS rows and more than one in HOT_KEYS of all rows, so at most HOT_KEYS keys are; their
    number of salts is broadcast, their rows are dealt by ``by`` over the salts, and their row of ``one`` is repeated
    for each salt. No task then has to take more than that share of the rows for one key. ``counts`` (key, n) and
    ``total`` spare counting ``rows`` again.
    """
    limit = max(HOT_ROWS, (rows.count() if total is None else total) // HOT_KEYS)
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts
    hot = F.broadcast(counts.where(F.col("n") > limit).select(F.col(key).alias("_hot"), F.ceil(F.col("n") / limit).cast("int").alias("_salts")))
    dealt = rows.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("_salts")).cast("int"), F.lit(0)))
    copies = one.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)))
    return dealt.drop("_hot", "_salts").join(copies.drop("_hot", "_salts"), [key, "_salt"], how).drop("_salt")


BATCH_ROWS = 1000  # rows of an Arrow batch; texts of some KB each make batches of a few MB on both sides


def bounded_batches(spark: SparkSession) -> None:
    """Keep the session's Arrow batches at BATCH_ROWS rows or fewer, for the JVM and the Python workers share the memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of steps whose results are written: its cleaner waits for the driver's collector."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix style), vectorised."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def map_rows(df: DataFrame, columns: list[str], schema: str, make: Callable[[], Callable[..., tuple]], slice_rows: int = 512) -> DataFrame:
    """Map every row of ``df`` to one row of ``schema`` with a Python function.

    ``make`` is called once per task and returns a function of the listed columns (nulls are None)
    that returns the output row. Rows are handled in slices so that output stays bounded.
    """
    names = [f.split()[0] for f in schema.split(",")]
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                part = batch.slice(at, slice_rows)
                rows = [fn(*values) for values in zip(*(part.column(i).to_pylist() for i in range(part.num_columns)))]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=names)

    types = arrow_types(schema)
    return df.select(*[F.col(c) for c in columns]).mapInArrow(run, schema)


_ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()),
    "array<float>": pa.list_(pa.float32()),
}


def arrow_types(schema: str) -> list[pa.DataType]:
    return [_ARROW[f.split()[1]] for f in schema.split(",")]
