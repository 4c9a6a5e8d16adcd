"""Relational building blocks as single DataFrame expressions: semi-joins, keyed reduction, segmented scans, expansion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.operators.access import repeat

COUNT = "decimal(38,0)"


def semi_join(r: DataFrame, s: DataFrame, r_key: str, s_key: str) -> DataFrame:
    """Rows of r whose key occurs in s."""
    return r.join(s.select(F.col(s_key).alias("_k")), F.col(r_key) == F.col("_k"), "left_semi")


def count_semi_join(r: DataFrame, s: DataFrame, r_key: str, s_key: str, value: str | None = None, name: str = "n", keep_all: bool = True) -> DataFrame:
    """r with the number of its partners in s, or the sum of their `value`; 0 without any. keep_all=False drops those."""
    counted = s.groupBy(F.col(s_key).alias("_k")).agg((F.count("*") if value is None else F.sum(value)).cast("bigint").alias(name))
    out = r.join(counted, F.col(r_key) == F.col("_k"), "left").drop("_k").withColumn(name, F.coalesce(name, F.lit(0)))
    return out if keep_all else out.where(F.col(name) > 0)


def reduce_by_key(r: DataFrame, key: str, name: str = "n") -> DataFrame:
    """key, number of rows."""
    return r.groupBy(key).agg(F.count("*").alias(name))


def annotate(r: DataFrame, s: DataFrame, r_key: str, s_key: str, value: str, name: str) -> DataFrame:
    """r with s's value of its key (unique in s); rows without are dropped."""
    return r.join(s.select(F.col(s_key).alias("_k"), F.col(value).alias(name)), F.col(r_key) == F.col("_k")).drop("_k")


def augment(r: DataFrame, s: DataFrame, r_key: str, s_key: str, name: str = "n") -> DataFrame:
    """annotate() with reduce_by_key() of s."""
    return annotate(r, reduce_by_key(s, s_key, "_n"), r_key, s_key, "_n", name)


def group_dimensions(r: DataFrame, s: DataFrame, r_key: str, s_key: str) -> DataFrame:
    """tid (1: from r, 2: from s), key, a1, a2: the key's rows on either side, for every row of the tagged union."""
    both = r.select(F.lit(1).alias("tid"), F.col(r_key).alias("key")).union(s.select(F.lit(2).alias("tid"), F.col(s_key).alias("key")))
    sizes = both.groupBy("key").agg(*(F.count(F.when(F.col("tid") == t, 1)).alias(f"a{t}") for t in (1, 2)))
    return both.join(sizes.withColumnRenamed("key", "_k"), F.col("key").eqNullSafe(F.col("_k"))).select("tid", "key", "a1", "a2")


def multi_number(r: DataFrame, key: str, order: Sequence[str], copies: Column | int = 1 << 62, name: str = "number") -> DataFrame:
    """r with a number from 1 within the key, which begins anew after `copies`."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return r.withColumn(name, F.pmod(n - 1, F.lit(copies) if isinstance(copies, int) else copies) + 1)


def align_order(index: Column, a1: Column, a2: Column) -> Column:
    """The strided place of a row in its key's group: index div a1 + (index mod a1) * a2."""
    return ((index - F.pmod(index, a1)) / a1).cast("bigint") + F.pmod(index, a1) * a2


def expand_by_weight(r: DataFrame, weight: str, name: str = "copy") -> DataFrame:
    """Every row as often as its weight (none for 0, less or NULL), with the copy's number from 0."""
    return repeat(r, F.col(weight), name)


def pad_to(r: DataFrame, size: int) -> DataFrame:
    """r with is_dummy, and as many rows of NULLs that are dummies as it lacks of `size`; r's rows are never cut.

    The number is worked out within the plan: one count, no collected rows.
    """
    lacking = r.agg(F.greatest(F.lit(size).cast("bigint") - F.count("*"), F.lit(0)).alias("_lack"))
    dummies = repeat(lacking, F.col("_lack"), "_copy")
    return r.withColumn("is_dummy", F.lit(False)).union(dummies.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in r.schema), F.lit(True).alias("is_dummy")))


def expand_to(r: DataFrame, weight: str, size: int) -> DataFrame:
    """expand_by_weight() with weights of 1 at least, padded to `size` rows."""
    grown = repeat(r, F.greatest(F.coalesce(F.col(weight), F.lit(1)), F.lit(1)), "copy")
    return pad_to(grown, size)


def compact(r: DataFrame, marker: str) -> DataFrame:
    """The marked rows."""
    return r.where(F.col(marker) == 1)


def compact_to(r: DataFrame, marker: str, order: Sequence[str], keep: int) -> DataFrame:
    """The first `keep` marked rows in order, padded to exactly so many."""
    return pad_to(compact(r, marker).orderBy(*order).limit(keep), keep)


def two_way_join(r: DataFrame, s: DataFrame, r_key: str, s_key: str, size: int | None = None) -> DataFrame:
    """The equi-join of two relations with distinct column names; padded to `size` rows if given, never cut."""
    out = r.join(s, F.col(r_key) == F.col(s_key))
    return out if size is None else pad_to(out, size)


# --- segmented scans: seg says which rows belong together, order is a total order within -----------------------------


def _frame(seg: str | Sequence[str], order: Sequence[str], lo: int, hi: int):
    return Window.partitionBy(*([seg] if isinstance(seg, str) else seg)).orderBy(*order).rowsBetween(lo, hi)


def seg_prefix(value: str, seg, order: Sequence[str], inclusive: bool = True) -> Column:
    """Sum over the segment's rows up to this one, or before it."""
    return F.coalesce(F.sum(value).over(_frame(seg, order, Window.unboundedPreceding, 0 if inclusive else -1)), F.lit(0))


def _back(seg: str | Sequence[str], order: Sequence[str], hi: int):
    """The rows from the segment's end to this one; in reverse order, as frames that end at the last row take a pass each."""
    return Window.partitionBy(*([seg] if isinstance(seg, str) else seg)).orderBy(*(F.desc_nulls_last(c) for c in order)).rowsBetween(Window.unboundedPreceding, hi)


def seg_suffix(value: str, seg, order: Sequence[str], inclusive: bool = True) -> Column:
    """Sum over the segment's rows from this one, or after it."""
    return F.coalesce(F.sum(value).over(_back(seg, order, 0 if inclusive else -1)), F.lit(0))


def seg_total(value: str, seg) -> Column:
    """Sum over the segment."""
    return F.sum(value).over(Window.partitionBy(*([seg] if isinstance(seg, str) else seg)))


def with_suffix_product(r: DataFrame, value: str, seg, order: Sequence[str], name: str) -> DataFrame:
    """r with the exact product of integers from each row of the segment on; an error beyond 38 digits.

    Zeros and signs are counted. What is left are factors of two at least, of which more than 127 exceed any decimal, so
    no more are held for a row however long the segment.
    """
    back, v = _back(seg, order, 0), F.col(value).cast(COUNT)
    factor = F.abs(v)
    out = r.withColumn("_zeros", F.count(F.when(v == 0, 1)).over(back)).withColumn("_minus", F.count(F.when(v < 0, 1)).over(back)).withColumn("_big", F.count(F.when(factor > 1, 1)).over(back))
    held = F.collect_list(F.when((factor > 1) & (F.col("_zeros") == 0) & (F.col("_big") <= 128), factor)).over(back)
    sign = F.when(F.col("_minus") % 2 == 0, F.lit(1)).otherwise(F.lit(-1))
    product = F.aggregate(held, F.lit(1).cast(COUNT), lambda a, x: (a * x).cast(COUNT))
    return out.withColumn(name, F.when(F.col("_zeros") > 0, F.lit(0).cast(COUNT)).otherwise((sign * product).cast(COUNT))).drop("_zeros", "_minus", "_big")


def fill_forward(value: str, seg, order: Sequence[str]) -> Column:
    """The last value that is not NULL up to this row of the segment."""
    return F.last(value, ignorenulls=True).over(_frame(seg, order, Window.unboundedPreceding, 0))


def top_k(r: DataFrame, order: Sequence[Column | str], k: int) -> DataFrame:
    """The first k rows in a total order."""
    return r.orderBy(*order).limit(k)


def max_frequency(r: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row, max_frequency: the most rows that share values of cols (all rows, without cols)."""
    n = r.groupBy(*cols).agg(F.count("*").alias("n")) if cols else r.agg(F.count("*").alias("n"))
    return n.agg(F.coalesce(F.max("n"), F.lit(0)).alias("max_frequency"))


def subset_frequencies(r: DataFrame, cols: Sequence[str]) -> DataFrame:
    """subset (bit k: column k is in it), max_frequency of every subset of cols, from one scan."""
    if not cols:
        return r.agg(F.lit(0).cast("bigint").alias("subset"), F.count("*").alias("max_frequency"))
    gid = F.grouping_id()
    counted = r.cube(*cols).agg(F.count("*").alias("n"), gid.alias("gid"))
    last = len(cols) - 1
    subset = sum(((1 - F.shiftright("gid", last - k).bitwiseAND(1)) * (1 << k) for k in range(len(cols))), F.lit(0))
    return counted.groupBy(subset.cast("bigint").alias("subset")).agg(F.max("n").alias("max_frequency"))
