"""Stage times, comparisons of strategies, and checks of expected sizes."""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from treeline.operators import counting, joins
from treeline.plans.tree import JoinTree


class UnexpectedSize(AssertionError):
    """A result has other than the expected number of rows."""


@dataclass
class StageTimer:
    """Seconds by stage; stages nest as "outer/inner" and show up as Spark job groups."""

    spark: SparkSession
    seconds: dict[str, float] = field(default_factory=dict)
    _open: list[str] = field(default_factory=list)

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        self._open.append(name)
        path, began = "/".join(self._open), time.perf_counter()
        self.spark.sparkContext.setJobDescription(path)
        try:
            yield
        finally:
            self.seconds[path] = self.seconds.get(path, 0.0) + time.perf_counter() - began
            self._open.pop()
            self.spark.sparkContext.setJobDescription("/".join(self._open) or None)


@dataclass(frozen=True)
class Run:
    """One strategy's run: rows and columns of the result and seconds by stage."""

    strategy: str
    rows: int
    columns: int
    seconds: dict[str, float]

    @property
    def join_seconds(self) -> float:
        """Without counting the size."""
        return sum(s for k, s in self.seconds.items() if k != "size")


def execute(df: DataFrame, level: str = "bench") -> int:
    """Run a result fully: "full" collects it (and returns its rows), "bench" writes it nowhere, "count" counts it."""
    if level == "full":
        return len(df.collect())
    if level == "count":
        return df.count()
    if level != "bench":
        raise ValueError(f"no level {level}")
    df.write.format("noop").mode("overwrite").save()
    return -1


def run(tree: JoinTree, strategy: str, expected: int | None = None, level: str = "count") -> Run:
    """Size, then join by a strategy. Expected rows must be met exactly."""
    spark = tree.relations[0].sparkSession
    timer = StageTimer(spark)
    with timer.stage("size"):
        exact = counting.size(tree)
    with timer.stage("join"):
        out = joins.join(tree, strategy)
        got = execute(out, level)
    rows = exact if got < 0 else got
    for wanted in (expected, exact):
        if wanted is not None and wanted >= 0 and rows != wanted:
            raise UnexpectedSize(f"{strategy} gave {rows} rows, not {wanted}")
    return Run(strategy, rows, len(out.columns), timer.seconds)


def compare(tree: JoinTree, strategies: Sequence[str] = tuple(joins.STRATEGIES), expected: int | None = None, level: str = "count") -> list[dict]:
    """Runs of several strategies, each with its join time's ratio to the first one's."""
    runs = [run(tree, s, expected, level) for s in strategies]
    first = max(runs[0].join_seconds, 1e-9)
    return [{"strategy": r.strategy, "rows": r.rows, "columns": r.columns, **{k: round(v, 4) for k, v in r.seconds.items()}, "ratio": round(r.join_seconds / first, 3)} for r in runs]


def sweep(tree: JoinTree, partitions: Sequence[int], strategy: str = "native", level: str = "bench") -> dict[int, float]:
    """Join seconds by number of shuffle partitions; the session's own number is put back."""
    spark, key = tree.relations[0].sparkSession, "spark.sql.shuffle.partitions"
    before, out = spark.conf.get(key), {}
    try:
        for n in partitions:
            spark.conf.set(key, str(n))
            out[n] = run(tree, strategy, level=level).join_seconds
    finally:
        spark.conf.set(key, before)
    return out
