"""Rows in ascending doc_id order over partitions whose borders are known, for operators that need neighbours or offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that one part is to hold about.
PART_BYTES = 24 << 20


def bounds(docs: DataFrame, parts: int) -> list[int]:
    """At most parts - 1 ascending doc_ids that cut the rows into parts of about equal text, whatever their order in files.

    From a fixed number of quantiles of the ids, weighted by nothing: only this list reaches the driver.
    """
    if parts < 2:
        return []
    at = [k / parts for k in range(1, parts)]
    found = docs.select(F.col("doc_id").cast("long").alias("i")).where("i IS NOT NULL").agg(F.percentile_approx("i", at, 10_000)).first()[0]
    return sorted(set(found or []))


def n_parts(docs: DataFrame) -> int:
    """Parts for the text's size; one pass that counts bytes."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-size // PART_BYTES))


def with_part(docs: DataFrame, cuts: list[int], name: str = "part") -> DataFrame:
    """Adds the number of cuts at or below doc_id; NULL ids come first."""
    if not cuts:
        return docs.withColumn(name, F.lit(0))
    array = F.lit(cuts)
    # the place of doc_id among the sorted cuts, by halving: log2(parts) comparisons a row
    steps = max(1, len(cuts).bit_length())
    place = F.aggregate(
        F.sequence(F.lit(steps - 1), F.lit(0), F.lit(-1)),
        F.lit(0),
        lambda at, k: F.when((at + F.call_function("shiftleft", F.lit(1), k) <= len(cuts)) & (F.element_at(array, F.least(at + F.call_function("shiftleft", F.lit(1), k), F.lit(len(cuts)))) <= F.col("doc_id")), at + F.call_function("shiftleft", F.lit(1), k)).otherwise(at),
    )
    return docs.withColumn(name, F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(place).cast("int"))
