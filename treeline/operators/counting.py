"""Sizes of joins that are never made: multiplicities from the leaves up, contributions from the root down.

Each edge costs one aggregation of the child by its key and one join; what is joined has one row a key. Counts are
decimal(38, 0), so that products cannot wrap; beyond that Spark raises an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.plans.tree import Edge, JoinTree, label

COUNT = "decimal(38,0)"
DELTA = "_delta"


def on(e: Edge, left: str = "", right: str = "") -> Column:
    """The edge's condition over labelled columns."""
    cond = None
    for a, b in zip(e.parent_cols, e.child_cols, strict=True):
        x = F.col(f"{left}{label(e.parent, a)}") == F.col(f"{right}{label(e.child, b)}")
        cond = x if cond is None else cond & x
    return cond


def child_weight(e: Edge) -> str:
    """Name of the parent's column that counts its partners below the edge."""
    return f"_u{e.child}"


def child_block(e: Edge) -> str:
    """Name of the parent's column with the answers below the edge for each of the child's rows of its key, on average."""
    return f"_w{e.child}"


def average(total: Column, rows: Column) -> Column:
    """total / rows, rounded up, at least 1, as a long."""
    n = F.greatest(total.try_cast("bigint"), F.lit(1).cast("bigint")) + rows - 1
    return ((n - F.pmod(n, rows)) / rows).cast("bigint")


def _by_key(child: DataFrame, e: Edge, value: Column, name: str) -> DataFrame:
    keys = [label(e.child, c) for c in e.child_cols]
    return child.groupBy(*keys).agg(F.sum(value).cast(COUNT).alias(name), average(F.sum(value), F.count("*")).alias(child_block(e))).withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})


def _key_match(e: Edge) -> Column:
    cond = None
    for i, c in enumerate(e.parent_cols):
        x = F.col(label(e.parent, c)) == F.col(f"_k{i}")
        cond = x if cond is None else cond & x
    return cond


def up_pass(tree: JoinTree) -> dict[int, DataFrame]:
    """Each relation with, for each child, the answers of the child's subtree that a row meets, and their product _delta.

    A row without partner on a left edge counts one there.
    """
    done: dict[int, DataFrame] = {}
    for r in tree.bottom_up():
        t, delta = tree.labelled(r), F.lit(1).cast(COUNT)
        for e in tree.children(r):
            u = child_weight(e)
            keys = [f"_k{i}" for i in range(len(e.parent_cols))]
            t = t.join(_by_key(done[e.child], e, F.col(DELTA), u), _key_match(e), "left").drop(*keys)
            least = F.coalesce(F.col(u), F.lit(0).cast(COUNT))
            t = t.withColumn(u, F.greatest(least, F.lit(1).cast(COUNT)) if e.how == "left" else least)
            delta = (delta * F.col(u)).cast(COUNT)
        done[r] = t.withColumn(DELTA, delta)
    return done


def join_size(tree: JoinTree) -> DataFrame:
    """One row, n_rows: the exact size of the join."""
    return up_pass(tree)[tree.root].agg(F.coalesce(F.sum(DELTA), F.lit(0)).cast(COUNT).alias("n_rows"))


def size(tree: JoinTree) -> int:
    """join_size() as a number."""
    return int(join_size(tree).first()[0])


def exceeds(tree: JoinTree, threshold: int) -> bool:
    """Whether the join has more rows than the threshold, without making any."""
    return size(tree) > threshold


def contributions(tree: JoinTree) -> dict[int, DataFrame]:
    """Each relation's rows with _n, the answers that a row takes part in."""
    up = up_pass(tree)
    one = F.lit(1).cast(COUNT)
    done = {tree.root: up[tree.root].withColumn("_outside", one)}
    for r in tree.top_down():
        for e in tree.children(r):
            others = F.col("_outside")
            for s in tree.children(r):
                if s.child != e.child:
                    others = (others * F.col(child_weight(s))).cast(COUNT)
            keys = [label(r, c) for c in e.parent_cols]
            given = done[r].groupBy(*keys).agg(F.sum(others).cast(COUNT).alias("_outside")).withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
            cond = None
            for i, c in enumerate(e.child_cols):
                x = F.col(label(e.child, c)) == F.col(f"_k{i}")
                cond = x if cond is None else cond & x
            below = up[e.child].join(given, cond, "left").drop(*(f"_k{i}" for i in range(len(keys))))
            done[e.child] = below.withColumn("_outside", F.coalesce("_outside", F.lit(0).cast(COUNT)))
    return {r: t.select(*(label(r, c) for c in tree.relations[r].columns), (F.col("_outside") * F.col(DELTA)).cast(COUNT).alias("_n")) for r, t in done.items()}


def max_contribution(tree: JoinTree) -> DataFrame:
    """One row, max_contribution: the most answers that any row of any relation takes part in."""
    every = None
    for t in contributions(tree).values():
        most = t.agg(F.max("_n").alias("m"))
        every = most if every is None else every.union(most)
    return every.agg(F.coalesce(F.max("m"), F.lit(0)).cast(COUNT).alias("max_contribution"))
