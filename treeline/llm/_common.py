"""What the training-data operators share: tables, the shared folder, and a join that hot keys cannot break."""

from __future__ import annotations

import ctypes
import gc
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: At most this many keys can hold more than one HOT_SHARE-th of all rows each, so a table of them has a proven bound.
HOT_SHARE = 1000
#: Pieces that the rows of one hot key are dealt into.
HOT_SALTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table. Executors get this package first, so that functions can be sent by name."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once a context."""
    sc = spark.sparkContext
    if getattr(sc, "_treeline_shipped", False):
        return
    root, data = Path(__file__).resolve().parents[1], io.BytesIO()
    if not root.is_dir():  # already running from a shipped archive
        return
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    folder = tempfile.mkdtemp(prefix="treeline")
    path = os.path.join(os.path.realpath(folder), f"treeline_{uuid.uuid4().hex[:8]}.zip")
    Path(path).write_bytes(data.getvalue())
    sc.addPyFile(path)
    sc._treeline_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset (tests)."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_treeline_shared", None)
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="treeline-shared")
        sc.setCheckpointDir(found)
        sc._treeline_shared = found
    return found.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new name below the shared folder."""
    return f"{shared_dir(spark)}/treeline-{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors. Returns it and its path."""
    path = fresh_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table that materialize() wrote and that no later result reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def lookup(df: DataFrame, small: DataFrame, key: str, weight: str, total: int, salt_by: Column, how: str = "left", few: int = 0) -> DataFrame:
    """Equi-join df with small (one row per key; NULL equals NULL), however df's rows are spread over the keys.

    If small is counted to have at most `few` rows, it is broadcast whole and df stays where it is. Else: small has a column `weight`: the rows of df per key; total: their sum. Keys that hold more than 1/HOT_SHARE of
    them are at most HOT_SHARE, so they are broadcast; such rows are dealt by a hash of salt_by, and the key's row of
    small is repeated for every salt. Other keys are joined on the key alone. The output has df's columns and small's
    others, without weight.
    """
    if few and small.limit(few + 1).count() <= few:
        right = small.withColumnRenamed(key, "__tl_key2").drop(weight)
        return df.join(F.broadcast(right), F.col(key).eqNullSafe(F.col("__tl_key2")), how).drop("__tl_key2")
    hot = small.where(F.col(weight) * HOT_SHARE > F.lit(total))
    flags = hot.select(F.col(key).alias("__tl_hot_key"), F.lit(True).alias("__tl_hot"))
    dealt = df.join(F.broadcast(flags), F.col(key).eqNullSafe(F.col("__tl_hot_key")), "left")
    dealt = dealt.withColumn("__tl_salt", F.when(F.col("__tl_hot"), F.pmod(F.xxhash64(salt_by), F.lit(HOT_SALTS)).cast("int")).otherwise(F.lit(0))).drop("__tl_hot", "__tl_hot_key")
    is_hot = F.col(weight) * HOT_SHARE > F.lit(total)
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(HOT_SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = small.withColumn("__tl_salt2", F.explode(salts)).withColumnRenamed(key, "__tl_key2").drop(weight)
    joined = dealt.join(right, F.col(key).eqNullSafe(F.col("__tl_key2")) & (F.col("__tl_salt") == F.col("__tl_salt2")), how)
    return joined.drop("__tl_salt", "__tl_salt2", "__tl_key2")


def give_back(spark: SparkSession | None = None) -> None:
    """Return freed memory of this Python process to the system, and of the driver's JVM if spark is given."""
    if spark is not None:
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU library: nothing to do
        pass
    if spark is not None:
        spark.sparkContext._jvm.System.gc()


def texts_of(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """A string column's values in UTF-8; NULL as empty."""
    cast = column.cast(pa.binary() if not pa.types.is_large_string(column.type) else pa.large_binary())
    for x in cast:
        yield x.as_py() or b""


def batches(schema: pa.Schema, rows: Iterable[tuple], size: int = 2000) -> Iterator[pa.RecordBatch]:
    """Record batches from tuples, so many rows each."""
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def bounded_batches(it: Iterable[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most about `limit` bytes, so that long texts do not pile up in memory; one row may exceed it alone."""
    for b in it:
        if b.nbytes <= limit or b.num_rows <= 1:
            if b.num_rows:
                yield b
        else:
            half = b.num_rows // 2
            yield from bounded_batches([b.slice(0, half), b.slice(half)], limit)
