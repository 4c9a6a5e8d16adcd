"""Text tables of integers, raw pipe-separated tables, sidecar files, projections, samples."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.operators.access import running_total


class SchemaError(ValueError):
    """A table that is empty or has the wrong columns."""


def read_ints(spark: SparkSession, path: str, columns: Sequence[str], check: bool = True) -> DataFrame:
    """A table of integers between white space of any kind and length, one row a line, blank lines skipped.

    Another number of cells, or what is no integer, is an error when the table is read, whichever columns are asked for.
    """
    cells = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    lines = spark.read.text(path).where(F.col("value").rlike(r"\S")).select("value", cells.alias("_cells"))
    whole = (F.size("_cells") == len(columns)) & F.forall("_cells", lambda x: x.rlike("^[+-]?[0-9]+$"))
    told = F.concat(F.lit(f"a line of {path} is not {len(columns)} integers: "), F.substring("value", 1, 200))
    df = lines.where(F.when(whole, F.lit(True)).otherwise(F.raise_error(told).cast("boolean")))
    df = df.select(*(F.element_at("_cells", k + 1).cast("long").alias(c) for k, c in enumerate(columns)))
    if check and df.isEmpty():
        raise SchemaError(f"{path} has no rows")
    return df


def write_ints(df: DataFrame, path: str) -> None:
    """The counterpart of read_ints(); NULL is written as 0, as the format has no other word for it."""
    df.select(*(F.coalesce(F.col(c).cast("bigint"), F.lit(0)).alias(c) for c in df.columns)).write.mode("overwrite").csv(path, sep=" ")


def read_pipes(spark: SparkSession, path: str, schema: str, trailing: bool = True) -> DataFrame:
    """A raw table between pipes; blank cells are NULL; with a trailing pipe, what follows it is dropped."""
    df = spark.read.csv(path, sep="|", schema=schema + (", _end string" if trailing else ""), nullValue="", emptyValue="")
    return df.drop("_end")


def write_pipes(df: DataFrame, path: str) -> None:
    """The counterpart of read_pipes(), with a trailing pipe."""
    df.withColumn("_end", F.lit(None).cast("string")).write.mode("overwrite").csv(path, sep="|", nullValue="", emptyValue="")


def project(df: DataFrame, columns: Sequence[str], names: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """Key projection under new names; limit keeps so many rows."""
    out = df.select(*(F.col(c).alias(n) for c, n in zip(columns, names or columns, strict=True)))
    return out if limit is None else out.limit(limit)


def read_expected(spark: SparkSession, path: str) -> int:
    """The number in a sidecar file, or -1 if there is none."""
    try:
        rows = spark.read.text(path).collect()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return -1
        raise
    return int(rows[0][0]) if rows else -1


def read_stats(spark: SparkSession, path: str) -> dict[str, str]:
    """key=value lines."""
    return dict(r[0].split("=", 1) for r in spark.read.text(path).collect() if "=" in r[0])


def clean_sample(df: DataFrame, n: int = 2000, seed: int = 1) -> DataFrame:
    """n rows without NULLs, chosen by a seeded hash of all columns, so that the choice can be repeated."""
    return df.na.drop().orderBy(F.xxhash64(F.lit(seed), *df.columns), *df.columns).limit(n)


def pair_ids(df: DataFrame, a: str, b: str, name: str = "pair_id") -> DataFrame:
    """Distinct (a, b) pairs with a dense number from 1 in their order; tables join on the pair itself, this is for export."""
    pairs = df.select(a, b).distinct()
    return running_total(pairs.withColumn("_one", F.lit(1)), "_one", [a, b], "_before").select(a, b, (F.col("_before") + 1).cast("bigint").alias(name))


def load_views(spark: SparkSession, folder: str, names: Sequence[str], schemas: Mapping[str, str] | None = None) -> dict[str, DataFrame]:
    """Tables of a folder, registered as views: <name>.tbl between pipes where a schema is given, else <name>.parquet."""
    out = {}
    for n in names:
        out[n] = read_pipes(spark, f"{folder}/{n}.tbl", schemas[n]) if schemas and n in schemas else spark.read.parquet(f"{folder}/{n}.parquet")
        out[n].createOrReplaceTempView(n)
    return out


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder's name where all executors see it: below spark.checkpoint.dir, or a local one if the master is local."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="treeline-scratch")
    return f"{shared.rstrip('/')}/treeline-{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"


def collect_capped(df: DataFrame, cells: int = 1_000_000) -> list:
    """All rows; an error if they have more cells."""
    n = cells // max(1, len(df.columns))
    rows = df.limit(n + 1).collect()
    if len(rows) > n:
        raise OverflowError(f"the result has over {cells} cells")
    return rows


def dimensions(df: DataFrame) -> tuple[int, int]:
    """(rows, columns)."""
    return df.count(), len(df.columns)


def show(df: DataFrame, n: int = 20) -> str:
    """The first n rows as lines, and how many more there are."""
    rows, total = df.limit(n).collect(), df.count()
    lines = [" ".join("NULL" if x is None else str(x) for x in r) for r in rows]
    return "\n".join([*lines, *([f"... ({total - n} more rows)"] if total > n else [])])
