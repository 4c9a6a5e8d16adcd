"""Mixing sources to target weights by Poisson replication, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.llm._common import lookup


#: Sources whose rates are broadcast at most; more are joined by exchange.
FEW = 10_000


def uniform(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the seed and the parts as text: 52 bits, the same in any engine. NULL counts as 'null'."""
    text = F.concat_ws("|", F.lit(seed), *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson(rate: Column, u: Callable[[Column], Column]) -> Column:
    """The least k whose Poisson(rate) distribution function exceeds u(0); 0 for a rate of 0 or NULL.

    A large rate is summed from pieces of at most 16, each inverted with a uniform of its own, u(0), u(1) and so on; a sum
    of independent Poisson numbers is one.
    """
    tail = F.sequence(F.lit(1), F.lit(120))  # the mass beyond is under 1e-60 for a rate of 16

    def invert(r: Column, v: Column) -> Column:
        first = F.exp(-r)
        start = F.struct(F.lit(0).alias("k"), first.alias("p"), first.alias("cdf"), v.alias("v"))  # v is worked out once
        step = lambda a, k: F.when(a["cdf"] > a["v"], a).otherwise(F.struct(k.cast("int").alias("k"), (a["p"] * r / k).alias("p"), (a["cdf"] + a["p"] * r / k).alias("cdf"), a["v"].alias("v")))
        return F.aggregate(tail, start, step, lambda a: a["k"])

    pieces = F.ceil(rate / F.lit(16.0)).cast("int")
    many = F.aggregate(F.sequence(F.lit(0), F.greatest(pieces, F.lit(1)) - 1), F.lit(0), lambda a, i: a + invert(rate / pieces, u(i)))
    return F.when(rate.isNull() | (rate <= 0), F.lit(0)).when(pieces == 1, invert(rate, u(F.lit(0)))).otherwise(many)


def _who(docs: DataFrame) -> Column:
    """doc_id as text; rows without one are told apart by their texts."""
    if "text" not in docs.columns:
        return F.col("doc_id")
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), F.md5(F.coalesce("text", F.lit("")))))


def source_rates(docs: DataFrame, weights: Mapping[str | None, float] | None = None, power: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """source, n_docs, rate: how often each document of a source is to occur on average.

    A source's share of the output is its weight's share of all (sources without a weight get 0); without weights, it is
    proportional to its documents to the `power`. The output has `epochs` times as many documents on average. NULL is a
    source of its own, with the weight of None; the empty string is another. Without documents there are no rows.
    """
    sizes = docs.groupBy("source").agg(F.count("*").alias("n_docs"))
    if weights is None:
        weighed = sizes.withColumn("w", F.pow(F.col("n_docs").cast("double"), F.lit(float(power))))
    else:
        if any(w < 0 for w in weights.values()):
            raise ValueError("weights must not be negative")
        pairs = [x for k, w in weights.items() if k is not None for x in (F.lit(k), F.lit(float(w)))]
        named = F.create_map(*pairs)[F.coalesce("source", F.lit(""))] if pairs else F.lit(None).cast("double")
        given = F.when(F.col("source").isNull(), F.lit(float(weights.get(None, 0.0)))).otherwise(named)
        weighed = sizes.withColumn("w", F.coalesce(given, F.lit(0.0)))
    total = weighed.agg(F.sum("w").alias("all_w"), F.sum("n_docs").alias("all_docs"))  # one row
    return weighed.join(F.broadcast(total)).select("source", "n_docs", F.when(F.col("all_w") > 0, F.col("w") / F.col("all_w") * F.col("all_docs") * F.lit(float(epochs)) / F.col("n_docs")).otherwise(F.lit(0.0)).alias("rate"))


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, power: float = 0.5, epochs: float = 1.0, seed: str = "mix") -> DataFrame:
    """docs' rows, each as often as a Poisson number with its source's rate says, in a random order over all of them.

    Adds copy (from 0) and shuffle_key, in place of columns of these names; rows come sorted by it over all partitions. The numbers follow from doc_id
    (or the text, where that is NULL), source and seed alone, so equal rows get equal numbers and a lost task gives the same
    ones again. NULL and empty texts are rows like others, and an empty table gives an empty one. Sources of any
    size are looked up by lookup(): the largest share of rows in one source lands in no single task.
    """
    rates = source_rates(docs, weights, power, epochs)
    total = docs.count()
    rates = rates.withColumnRenamed("rate", "__tl_rate")
    rated = lookup(docs, rates, "source", "n_docs", total, F.col("doc_id"), few=FEW)
    times = rated.withColumn("__tl_n", poisson(F.col("__tl_rate"), lambda i: uniform(seed, _who(docs), F.col("source"), i))).where("__tl_n > 0")
    copies = times.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("__tl_n") - 1))).drop("__tl_n", "__tl_rate")
    keyed = copies.withColumn("shuffle_key", uniform(seed + "-order", _who(docs), F.col("source"), F.col("copy")))
    return keyed.orderBy("shuffle_key", F.col("doc_id"), F.col("copy"))


def mix_sql(power: float = 0.5, epochs: float = 1.0, seed: str = "mix") -> str:
    """DuckDB SQL for mix() with weights by power, as long as all rates are at most 16: doc_id, source, copy, shuffle_key, n_chars."""
    u = "CAST(CAST('0x' || substr(md5({}), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0"
    who = "who || '|' || coalesce(source, 'null')"
    return f"""
WITH RECURSIVE sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, pow(CAST(n AS DOUBLE), {power}) / (SELECT sum(pow(CAST(n AS DOUBLE), {power})) FROM sizes) * (SELECT sum(n) FROM sizes) * {epochs} / n AS rate FROM sizes),
cdf AS (
  SELECT source, rate, CAST(0 AS BIGINT) AS k, exp(-rate) AS p, exp(-rate) AS c FROM rates
  UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf WHERE k < 60),
named AS (SELECT doc_id, source, length(text) AS n_chars, coalesce(CAST(doc_id AS VARCHAR), 'null ' || md5(coalesce(text, ''))) AS who FROM documents),
drawn AS (SELECT doc_id, source, n_chars, who, {u.format(f"'{seed}|' || " + who + " || '|0'")} AS u FROM named),
counted AS (SELECT d.doc_id, d.source, d.n_chars, d.who, (SELECT count(*) FROM cdf c WHERE c.source IS NOT DISTINCT FROM d.source AND c.c <= d.u) AS n FROM drawn d),
copies AS (SELECT doc_id, source, n_chars, who, CAST(unnest(range(n)) AS INTEGER) AS copy FROM counted)
SELECT doc_id, source, copy, {u.format(f"'{seed}-order|' || " + who + " || '|' || CAST(copy AS VARCHAR)")} AS shuffle_key, CAST(n_chars AS BIGINT) AS n_chars FROM copies
"""
