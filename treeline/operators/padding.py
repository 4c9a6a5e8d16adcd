"""Results padded to a protected size with rows that are flagged."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.operators import counting, joins
from treeline.operators.access import repeat
from treeline.operators.privacy import Breakdown, Sensitivity, protected_size
from treeline.plans.tree import JoinTree

#: Rows that a result may have.
CAP = 50_000_000
#: What a dummy's cells hold where NULL is not wanted.
DUMMY = 100_000_007


class ResultTooLarge(OverflowError):
    """A protected or exact size is over the cap."""


@dataclass(frozen=True)
class Sizes:
    """exact and protected sizes; padding is their difference. breakdown is None where a size was given."""

    exact: int
    protected: int
    breakdown: Breakdown | None

    @property
    def padding(self) -> int:
        return self.protected - self.exact


def sizes(tree: JoinTree, epsilon: float = 1.0, delta: float = 1e-9, tau: int = 0) -> Sizes:
    """Sizes of a tree's result. A size given with tau needs no sensitivity."""
    exact = counting.size(tree)
    if tau > 0:
        return Sizes(exact, protected_size(exact, tau=tau), None)
    b = Sensitivity(tree).smooth(epsilon, delta)
    return Sizes(exact, protected_size(exact, b.sensitivity, epsilon, delta), b)


def pad(df: DataFrame, padding: int, literal: int | None = None) -> DataFrame:
    """df with is_dummy and so many dummies more: NULL cells, or `literal` cast to each column's type."""
    one = df.sparkSession.range(1)
    cells = [F.lit(literal).cast(f.dataType).alias(f.name) for f in df.schema]
    dummies = repeat(one, F.lit(max(0, padding)), "_copy").select(*cells, F.lit(True).alias("is_dummy"))
    return df.withColumn("is_dummy", F.lit(False)).union(dummies)


def padded_join(tree: JoinTree, strategy: str = "native", epsilon: float = 1.0, delta: float = 1e-9, tau: int = 0, cap: int = CAP, fall_back: bool = False, literal: int | None = None) -> DataFrame:
    """The join, padded to its protected size. A size over the cap is refused; fall_back gives the exact result instead
    if that is within the cap. Real rows are never cut."""
    s = sizes(tree, epsilon, delta, tau)
    if s.exact > cap or (s.protected > cap and not fall_back):
        raise ResultTooLarge(f"{s.protected} rows ({s.exact} real); the cap is {cap}")
    return pad(joins.join(tree, strategy), s.padding if s.protected <= cap else 0, literal)
