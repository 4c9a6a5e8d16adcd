"""The acyclic join by four strategies that return the same bag, and the full reducer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.operators import access, counting
from treeline.plans.tree import JoinTree, label


def _chain(tree: JoinTree, r: int, limit: int | None = None) -> DataFrame:
    """Relation r joined with its subtree, edge after edge from the top; what hangs on a left edge is joined first."""
    out, open_edges = tree.labelled(r), list(tree.children(r))
    while open_edges:
        e = open_edges.pop(0)
        if e.how == "left":
            out = out.join(_chain(tree, e.child, limit), counting.on(e), "left")
        else:
            out = out.join(tree.labelled(e.child), counting.on(e))
            open_edges += tree.children(e.child)
        if limit is not None:
            out = out.limit(limit)
    return out


def native(tree: JoinTree) -> DataFrame:
    """A chain of joins from the root down; the optimizer and adaptive execution choose the rest.

    All that hangs on a left edge is optional together: a parent without a whole subtree there gets NULLs once.
    """
    return _chain(tree, tree.root).select(*tree.columns())


def reduce_up(tree: JoinTree) -> JoinTree:
    """Every relation without the rows that have no partner in some inner child's subtree."""
    return _reduced(tree, up_only=True)


def full_reduce(tree: JoinTree) -> JoinTree:
    """Every relation without the rows that take part in no answer: semi-joins up, then down."""
    return _reduced(tree, up_only=False)


def _reduced(tree: JoinTree, up_only: bool) -> JoinTree:
    """Keys are made distinct before they are shuffled: a hot key of the many side moves once a task."""
    kept = {r: tree.labelled(r) for r in range(len(tree.relations))}
    for r in tree.bottom_up():
        for e in tree.children(r):
            if e.how == "inner":
                keys = kept[e.child].select(*(label(e.child, c) for c in e.child_cols)).distinct()
                kept[r] = kept[r].join(keys, counting.on(e), "left_semi")
    if not up_only:
        for r in tree.top_down():
            for e in tree.children(r):
                keys = kept[r].select(*(label(r, c) for c in e.parent_cols)).distinct()
                kept[e.child] = kept[e.child].join(keys, counting.on(e), "left_semi")
    back = [kept[r].toDF(*tree.relations[r].columns) for r in range(len(tree.relations))]
    return JoinTree(back, tree.edges, tree.names)


def reduce_join(tree: JoinTree) -> DataFrame:
    """Full reduction, then pairwise joins from the leaves up: no partial result holds a row that reaches no answer."""
    reduced = full_reduce(tree)
    done: dict[int, DataFrame] = {}
    for r in reduced.bottom_up():
        out = reduced.labelled(r)
        for e in reduced.children(r):
            out = out.join(done.pop(e.child), counting.on(e), e.how)
        done[r] = out
    return done[tree.root].select(*tree.columns())


def serial_yannakakis(tree: JoinTree, limit: int | None = None) -> DataFrame:
    """The reducer one edge after the other, then joins one edge after the other in top-down order.

    limit cuts every partial result to so many rows, for comparison with engines that do; the rows kept are arbitrary.
    """
    return _chain(full_reduce(tree), tree.root, limit).select(*tree.columns())


def count_expand(tree: JoinTree) -> DataFrame:
    """Rows of the root repeated as often as they count, each copy told by arithmetic which row of every child it meets.

    A copy is matched within a block of its key's positions, so a hot key is spread and costs a few comparisons a copy.
    """
    return access.expand(tree).select(*tree.columns())


STRATEGIES = {"native": native, "reduce_join": reduce_join, "serial_yannakakis": serial_yannakakis, "count_expand": count_expand}


def join(tree: JoinTree, strategy: str = "native", cap: int | None = None) -> DataFrame:
    """The join by a strategy; with a cap, its size is counted first and a larger join refused."""
    if strategy not in STRATEGIES:
        raise ValueError(f"no strategy {strategy}; there are {', '.join(STRATEGIES)}")
    if cap is not None and (n := counting.size(tree)) > cap:
        raise OverflowError(f"the join has {n} rows; the cap is {cap}")
    return STRATEGIES[strategy](tree)


def reduced_sizes(tree: JoinTree) -> DataFrame:
    """relation, n_rows after full reduction."""
    out = None
    for r, t in enumerate(full_reduce(tree).relations):
        one = t.agg(F.count("*").alias("n_rows")).select(F.lit(tree.names[r]).alias("relation"), "n_rows")
        out = one if out is None else out.union(one)
    return out
