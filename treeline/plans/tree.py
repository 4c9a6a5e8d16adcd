"""Join trees: relations, edges with one or more column pairs, and what can be derived from them on the driver."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


class TreeError(ValueError):
    """A tree that is not one, or that names what is not there."""


@dataclass(frozen=True)
class Edge:
    """child hangs from parent on parent_cols = child_cols; how is "inner", or "left" to keep parents without partner."""

    parent: int
    child: int
    parent_cols: tuple[str, ...]
    child_cols: tuple[str, ...]
    how: str = "inner"


@dataclass
class JoinTree:
    """Relations by number, and the edges that hang all but the root from another one.

    The join is over bags: NULL never matches, 0 is an ordinary key, repeated rows count as often as they occur. Output
    columns are r<relation>_<column>, relations in order of their numbers.
    """

    relations: list[DataFrame]
    edges: list[Edge]
    names: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        n = len(self.relations)
        self.names = self.names or [f"R{k + 1}" for k in range(n)]
        up = {}
        for e in self.edges:
            if not (0 <= e.parent < n and 0 <= e.child < n) or e.parent == e.child:
                raise TreeError(f"an edge names relations {e.parent} and {e.child} of {n}")
            if e.child in up:
                raise TreeError(f"relation {e.child} has two parents")
            if not e.parent_cols or len(e.parent_cols) != len(e.child_cols):
                raise TreeError("an edge needs as many parent as child columns, one at least")
            if e.how not in ("inner", "left"):
                raise TreeError(f"an edge can't be {e.how}")
            for r, cols in ((e.parent, e.parent_cols), (e.child, e.child_cols)):
                if lost := set(cols) - set(self.relations[r].columns):
                    raise TreeError(f"{self.names[r]} has no column {', '.join(sorted(lost))}")
            up[e.child] = e
        roots = [k for k in range(n) if k not in up]
        if len(roots) != 1 or len(self.names) != n:
            raise TreeError(f"a tree has one root; this one has {len(roots)}")
        self.root, self.up = roots[0], up
        if len(self.top_down()) != n:
            raise TreeError("the edges have a cycle")

    @classmethod
    def from_parents(cls, relations: Sequence[DataFrame], parent: Sequence[int], in_parent: Sequence[int], in_child: Sequence[int], names: Sequence[str] = (), left: Sequence[int] = ()) -> JoinTree:
        """From parallel arrays: parent[i] (-1: root) and the positions of the join column in parent and child."""
        edges = [Edge(p, k, (relations[p].columns[in_parent[k]],), (relations[k].columns[in_child[k]],), "left" if k in left else "inner") for k, p in enumerate(parent) if p >= 0]
        return cls(list(relations), edges, list(names))

    def children(self, r: int) -> list[Edge]:
        """Edges down from r, by child."""
        return sorted((e for e in self.edges if e.parent == r), key=lambda e: e.child)

    def top_down(self) -> list[int]:
        """Relations reachable from the root, each after its parent."""
        found = [self.root]
        for r in found:
            found += [e.child for e in self.children(r) if e.child not in found]
        return found

    def bottom_up(self) -> list[int]:
        """Relations, each after its children."""
        return self.top_down()[::-1]

    def labelled(self, r: int) -> DataFrame:
        """Relation r with its output names."""
        return self.relations[r].toDF(*(label(r, c) for c in self.relations[r].columns))

    def columns(self) -> list[str]:
        """The output's columns."""
        return [label(r, c) for r in range(len(self.relations)) for c in self.relations[r].columns]


def label(r: int, column: str) -> str:
    """Output name of a relation's column; relations count from 1."""
    return f"r{r + 1}_{column}"
