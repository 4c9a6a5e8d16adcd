"""Direct access: answers by number, without making the join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.operators import counting
from treeline.operators.counting import COUNT, DELTA, average, child_block, child_weight
from treeline.plans.tree import JoinTree, label

#: Pieces that running_total() cuts its rows into, and copies of one row that one array holds at most.
PIECES, COPIES = 64, 100_000
#: Rows of the root that direct access narrows its search down to, and answers whose rows it fetches at most.
NARROW, FEW = 200_000, 100_000
#: Rows of a child that a copy may look through for its own.
HOT = 64


def _piece(here: Column, cuts: Sequence[Column]) -> Column:
    """How many of the sorted cuts are at or below: by halving, so a row is compared a few times."""
    if not cuts:
        return F.lit(0)
    k = len(cuts) // 2
    return F.when(here < cuts[k], _piece(here, cuts[:k])).otherwise(_piece(here, cuts[k + 1 :]) + F.lit(k + 1))


def running_total(df: DataFrame, value: str, order: Sequence[str], name: str) -> DataFrame:
    """Adds the sum of column `value` over all rows before in the order of the columns, as numbered rows would have it.

    The rows are cut at up to PIECES sampled rows, which are literals of the plan, so a row's piece never changes; one
    sum a piece is added up ahead, and each piece has a window of its own. Rows that agree in all the columns get
    positions in any order.
    """
    cols = list(order)
    sample = df.select(*cols).orderBy(F.xxhash64(*cols), *cols).limit(PIECES - 1).distinct().orderBy(*cols).collect()
    types = [df.schema[c].dataType for c in cols]
    cuts = [F.struct(*(F.lit(x).cast(t).alias(c) for x, t, c in zip(row, types, cols, strict=True))) for row in sample]
    placed = df.withColumn("_piece", _piece(F.struct(*cols), cuts))
    sums = placed.groupBy("_piece").agg(F.sum(value).cast(COUNT).alias("_sum"))
    ahead = sums.alias("a").join(sums.alias("b"), F.col("b._piece") < F.col("a._piece"), "left").groupBy("a._piece").agg(F.coalesce(F.sum("b._sum"), F.lit(0)).cast(COUNT).alias("_ahead"))  # PIECES rows
    w = Window.partitionBy("_piece").orderBy(*cols).rowsBetween(Window.unboundedPreceding, -1)
    own = placed.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)).cast(COUNT))
    return own.join(F.broadcast(ahead), "_piece").withColumn(name, (F.col(name) + F.col("_ahead")).cast(COUNT)).drop("_piece", "_ahead")


def repeat(df: DataFrame, times: Column, name: str) -> DataFrame:
    """Every row as often as `times` says (none for 0 or less), with the copy's number from 0; arrays stay short."""
    n = F.coalesce(times.cast("bigint"), F.lit(0))
    some = df.withColumn("_n", n).where("_n > 0")
    blocks = some.withColumn("_from", F.explode(F.expr(f"sequence(0L, greatest(_n, 1L) - 1, {COPIES}L)")))
    return blocks.withColumn(name, F.explode(F.sequence(F.col("_from"), F.greatest(F.least(F.col("_from") + COPIES, F.col("_n")) - 1, F.col("_from"))))).drop("_n", "_from")


def _around(root: DataFrame, rows: DataFrame, cols: Sequence[str], first: int, last: int) -> tuple[DataFrame, int, int]:
    """(rows of root that hold all answers from first to last - 1, and perhaps some others beside; answers before them;
    how many rows at least).

    root has DELTA; rows are those that it was made of. They are cut at sampled rows, and what holds no wanted answer is
    left out by comparisons with those, until at most NARROW are left or a cut no longer halves them: no sort of them all.
    """
    types, ahead, here = [root.schema[c].dataType for c in cols], 0, F.struct(*cols)
    while True:
        sample = rows.select(*cols).orderBy(F.xxhash64(*cols), *cols).limit(PIECES - 1).distinct().orderBy(*cols).collect()
        cuts = [F.struct(*(F.lit(x).cast(t).alias(c) for x, t, c in zip(row, types, cols, strict=True))) for row in sample]
        sums = {r[0]: (int(r[1]), r[2]) for r in root.groupBy(_piece(here, cuts).alias("p")).agg(F.sum(DELTA), F.count("*")).collect()}  # at most PIECES rows
        wanted, before, total = [], ahead, ahead
        for p in sorted(sums):
            if total < last and total + sums[p][0] > first:
                before = before if wanted else total
                wanted.append(p)
            total += sums[p][0]
        if not wanted:
            return root.limit(0), 0, 0
        n, ahead = sum(sums[p][1] for p in wanted), before
        for edge, keep in ((wanted[0] - 1, lambda c: here >= c), (wanted[-1], lambda c: here < c)):
            if 0 <= edge < len(cuts):
                root, rows = root.where(keep(cuts[edge])), rows.where(keep(cuts[edge]))
        if n <= NARROW or 2 * n > sum(c for _, c in sums.values()):
            return root, ahead, n


def _root_copies(tree: JoinTree, root: DataFrame, first: int, last: int) -> DataFrame:
    """A row of the root for each answer from first to last - 1, with answer_id and its number among the row's answers."""
    cols, idx = [label(tree.root, c) for c in tree.relations[tree.root].columns], f"_idx{tree.root}"
    near, ahead, n = _around(root, tree.labelled(tree.root), cols, first, last)
    if n <= NARROW:  # so few that one sort holds them
        w = Window.orderBy(*cols).rowsBetween(Window.unboundedPreceding, -1)
        out = near.withColumn("_start", F.coalesce(F.sum(DELTA).over(w), F.lit(0)).cast(COUNT))
    else:
        out = running_total(near, DELTA, cols, "_start")
    out = out.withColumn("_start", F.col("_start") + F.lit(ahead))
    lo, hi = F.greatest(F.lit(first), F.col("_start")), F.least(F.lit(last), F.col("_start") + F.col(DELTA))
    out = repeat(out.where(hi > lo), hi - lo, idx).withColumn(idx, (F.col(idx) + lo - F.col("_start")).cast("bigint"))
    return out.withColumn("answer_id", (F.col("_start") + F.col(idx)).cast("bigint")).drop("_start")


def _below(tree: JoinTree, root: DataFrame) -> JoinTree:
    """The tree with only those rows below the root that rows of `root` (labelled) lead to: multiplicities stay."""
    kept = {tree.root: root}
    for r in tree.top_down():
        for e in tree.children(r):
            keys = kept[r].select(*(label(r, c) for c in e.parent_cols)).distinct()
            kept[e.child] = tree.labelled(e.child).join(keys, counting.on(e), "left_semi")
    return JoinTree([kept[r].select(*(label(r, c) for c in t.columns)).toDF(*t.columns) for r, t in enumerate(tree.relations)], tree.edges, tree.names)


def _hot_edges(tree: JoinTree) -> set[int]:
    """Children in which some key has over HOT rows: one number a child reaches the driver."""
    every = None
    for e in tree.edges:
        most = tree.relations[e.child].groupBy(*e.child_cols).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).select(F.lit(e.child).alias("c"), "n")
        every = most if every is None else every.union(most)
    return {c for c, n in every.where(F.col("n") > HOT).collect()} if every is not None else set()


def expand(tree: JoinTree, first: int | None = None, last: int | None = None) -> DataFrame:
    """Answers number first to last - 1 (from 0; all, without bounds) with answer_id if bounds are given.

    The root's rows are ordered by all their columns, a child's rows of one key by descending multiplicity, then all
    columns. An answer's number is split among the children by division, and each finds its row by rank and key. For up
    to FEW answers the root's rows are fetched first, and every other relation is cut to the rows below them.

    Where a key has over HOT rows in a child, its positions are cut into as many blocks as it has rows there; a child's row
    is repeated for every block that it reaches into (less than twice as many rows in all), and a copy looks through its
    block alone, so neither a task nor a copy meets a whole group.
    """
    few = first is not None and last - first <= FEW
    hot = set(tree.up) if few else _hot_edges(tree)
    up = counting.up_pass(tree)
    out = up[tree.root].where(f"{DELTA} > 0")
    idx = f"_idx{tree.root}"
    if first is None:
        out = repeat(out, F.col(DELTA), idx)
    else:
        out = _root_copies(tree, out, first, last)
        if few:
            spark = out.sparkSession
            out = spark.createDataFrame(out.collect(), out.schema)
            up = counting.up_pass(_below(tree, out))
    out = out.drop(DELTA)
    optional = {tree.root: False}
    for r in tree.top_down():
        later = F.lit(1).cast("bigint")
        digits = []
        for e in reversed(tree.children(r)):
            u = F.col(child_weight(e)).cast("bigint")
            quotient = (F.col(f"_idx{r}") - F.pmod(F.col(f"_idx{r}"), later)).cast(COUNT) / later
            digits.append((e, F.pmod(quotient.cast("bigint"), u)))
            later = later * u
        for e, digit in digits:
            out = out.withColumn(f"_pc{e.child}", digit)
        for e in tree.children(r):
            c = e.child
            optional[c] = optional[r] or e.how == "left"
            keys = [label(c, x) for x in e.child_cols]
            cols = [label(c, x) for x in tree.relations[c].columns]
            whole = Window.partitionBy(*keys)
            ahead = whole.orderBy(F.col(DELTA).desc(), *cols).rowsBetween(Window.unboundedPreceding, -1)
            ranked, pc, cond = up[c], F.col(f"_pc{c}"), counting.on(e)
            if c in hot:
                ranked = ranked.withColumn(f"_v{c}", average(F.sum(DELTA).over(whole), F.count("*").over(whole)))
            ranked = ranked.withColumn(f"_rank{c}", F.coalesce(F.sum(DELTA).over(ahead), F.lit(0)).cast("bigint")).withColumn(f"_d{c}", F.col(DELTA).cast("bigint")).drop(DELTA).where(f"_d{c} > 0")
            if c in hot:
                block = lambda x, w=f"_v{c}": F.expr(f"({x}) div {w}")
                reach = block(f"_rank{c} + _d{c} - 1") - block(f"_rank{c}") + 1
                ranked = repeat(ranked, reach, f"_b{c}").withColumn(f"_b{c}", F.col(f"_b{c}") + block(f"_rank{c}")).drop(f"_v{c}")
                out = out.withColumn(f"_pb{c}", F.expr(f"_pc{c} div {child_block(e)}"))
                cond = cond & (F.col(f"_pb{c}") == F.col(f"_b{c}"))
            cond = cond & (pc >= F.col(f"_rank{c}")) & (pc < F.col(f"_rank{c}") + F.col(f"_d{c}"))
            out = out.join(ranked, cond, "left" if optional[c] else "inner").withColumn(f"_idx{c}", pc - F.col(f"_rank{c}")).drop(f"_rank{c}", f"_d{c}", f"_b{c}", f"_pc{c}", f"_pb{c}")
    return out


def answers(tree: JoinTree, first: int, last: int) -> DataFrame:
    """answer_id and columns of answers first to last - 1; few of them cost little, however large the join."""
    if first < 0 or last < first:
        raise ValueError("answers are numbered from 0, first to last")
    return expand(tree, first, last).select("answer_id", *tree.columns())


def interval_lookup(queries: DataFrame, ranked: DataFrame, key: str, at: str, start: str, length: str) -> DataFrame:
    """Each query's row of `ranked` with the same key and start <= at < start + length."""
    q, r = queries.alias("q"), ranked.alias("r")
    cond = (F.col(f"q.{key}") == F.col(f"r.{key}")) & (F.col(f"q.{at}") >= F.col(f"r.{start}")) & (F.col(f"q.{at}") < F.col(f"r.{start}") + F.col(f"r.{length}"))
    return q.join(r, cond).select("q.*", *(F.col(f"r.{c}").alias(c) for c in ranked.columns if c != key))
