"""Result sizes that hide what one tuple changes: smooth sensitivity bounds and the padded size that follows.

Spark works out degrees and boundary counts; what is left are small tables over the subsets of the relations, which the
driver searches with numpy. Subsets are bit masks, bit r for relation r; attributes are the edges, by child.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.operators import counting
from treeline.operators.primitives import subset_frequencies
from treeline.plans.tree import Edge, JoinTree, label

#: Evaluations that a search may take, and the largest protected size told.
BUDGET, MOST = 5e9, (1 << 63) - 1


class TooExpensive(RuntimeError):
    """The search would take more than BUDGET evaluations: raise epsilon, or give the size to pad to."""


def checked(epsilon: float, delta: float) -> tuple[float, float]:
    """Values out of range stand for epsilon 1 and delta 1e-9."""
    return (epsilon if epsilon > 0 else 1.0), (delta if 0 < delta < 1 else 1e-9)


def smoothing(epsilon: float, delta: float) -> float:
    """beta."""
    epsilon, delta = checked(epsilon, delta)
    return epsilon / (2 * math.log(2 * math.exp(epsilon / 2) / delta))


def noise_factor(epsilon: float, delta: float) -> float:
    """What the sensitivity is multiplied with."""
    epsilon, delta = checked(epsilon, delta)
    return 2 * math.e**2 / epsilon * (1 + math.log(1 + (2 * math.exp(epsilon) - 2 * math.exp(epsilon / 2)) / delta))


def search_cost(m: int, beta: float) -> tuple[int, float]:
    """(largest total distance, estimated evaluations)."""
    k = int((m - 1) / beta) + m
    return k, 2.0 * m * (k ** (m - 3) / math.factorial(m - 3) if m > 3 and k > 1 else 1)


def global_sensitivity(rows: list[int]) -> int:
    """The largest product of all relations' rows but one's, however large."""
    return max(math.prod(rows[:i] + rows[i + 1 :]) for i in range(len(rows)))


def residual_sensitivity(m: int, bounds: dict[int, int], beta: float) -> float:
    """max over i and distances s of exp(-beta sum s) * sum over E without i of bounds[E] * prod of s over the rest.

    Distances sum to at most search_cost()'s k. All are enumerated but the last two, whose share of every total has its
    best split in closed form.
    """
    if m <= 1:
        return 1.0
    k, cost = search_cost(m, beta)
    if cost > BUDGET:
        raise TooExpensive(f"about {cost:.3g} evaluations")
    best = 0.0
    total = np.arange(k + 1)
    for i in range(m):
        others = [j for j in range(m) if j != i]
        free, last = others[:-2], others[-2:]
        if len(last) == 1:  # two relations: one distance
            t = bounds.get(1 << last[0], 1) + bounds.get(0, 1) * total
            best = max(best, float((np.exp(-beta * total) * t).max()))
            continue
        full = sum(1 << j for j in others)
        # coefficient of the product of s over `rest` is the bound of the complement
        coefficients = {rest: float(bounds.get(full & ~rest, 1)) for n in range(m) for c in combinations(others, n) for rest in [sum(1 << j for j in c)]}
        x, y = (1 << j for j in last)

        def walk(at: int, used: int, monomials: dict[int, float]) -> None:
            nonlocal best
            if at == len(free) - 1 or not free:
                # the last outer distance is a vector
                s = np.arange(k - used + 1)[:, None] if free else np.zeros((1, 1), int)
                bit = 1 << free[-1] if free else 0
                coef = []
                for pair in (x | y, x, y, 0):
                    c = np.zeros((len(s), 1))
                    for mono, value in monomials.items():
                        c = c + value * (coefficients[mono | pair] + (s * coefficients[mono | bit | pair] if free else 0))
                    coef.append(c)
                a, b, c, d = coef
                t = total[None, :]
                with np.errstate(divide="ignore", invalid="ignore"):
                    mid = np.where(a > 0, (a * t + b - c) / (2 * a), np.where(b >= c, t, 0))
                value = np.zeros((len(s), len(total)))
                for p in (np.floor(mid), np.floor(mid) + 1):
                    p = np.clip(p, 0, t)
                    value = np.maximum(value, a * p * (t - p) + b * p + c * (t - p) + d)
                value = np.where(s + t + used <= k, np.exp(-beta * (s + t + used)) * value, 0)
                best = max(best, float(value.max()))
                return
            bit = 1 << free[at]
            for s in range(k - used + 1):
                more = dict(monomials)
                if s:
                    for mono, value in monomials.items():
                        more[mono | bit] = value * s
                walk(at + 1, used + s, more)

        walk(0, 0, {0: 1.0})
    return best


class Sensitivity:
    """Bounds of how much one tuple can change a join tree's size, and the smooth sensitivity from them."""

    def __init__(self, tree: JoinTree):
        self.tree, self.m = tree, len(tree.relations)
        self.attrs = [0] * self.m  # edges, by child, that a relation is part of
        for e in tree.edges:
            self.attrs[e.parent] |= 1 << e.child
            self.attrs[e.child] |= 1 << e.child
        self._degrees: list[dict[int, int]] | None = None
        self._exact: dict[tuple[int, int], int | None] = {}

    def boundary(self, subset: int) -> int:
        """Edges with one end in the subset."""
        inside = outside = 0
        for r in range(self.m):
            if subset >> r & 1:
                inside |= self.attrs[r]
            else:
                outside |= self.attrs[r]
        return inside & outside

    def _columns(self, r: int, attr: int) -> list[str]:
        e = self.tree.up[attr]
        return list(e.child_cols if r == attr else e.parent_cols)

    def degrees(self) -> list[dict[int, int]]:
        """For each relation and set of its edges: the most rows that share their key values. One scan a relation."""
        if self._degrees is None:
            found = []
            for r in range(self.m):
                attrs = [a for a in range(self.m) if self.attrs[r] >> a & 1]
                keys = [F.struct(*self._columns(r, a)).alias(f"k{a}") for a in attrs]
                d = subset_frequencies(self.tree.relations[r].select(*keys) if keys else self.tree.relations[r], [f"k{a}" for a in attrs])
                found.append({sum(1 << a for i, a in enumerate(attrs) if row[0] >> i & 1): int(row[1] or 0) for row in d.collect()})
                found[-1] = {s: found[-1].get(s, 0) for n in range(len(attrs) + 1) for c in combinations(attrs, n) for s in [sum(1 << a for a in c)]}
            self._degrees = found
        return self._degrees

    def rows(self) -> list[int]:
        return [d[0] for d in self.degrees()]

    def _hop(self, j: int, r: int) -> int:
        """The edge from j towards r."""
        path, at = {}, r
        while at != self.tree.root:
            path[at] = True
            at = self.tree.up[at].parent
        for e in self.tree.children(j):
            if e.child == r or e.child in path:
                return e.child
        return j

    def estimate(self, subset: int) -> int:
        """Degree product: over the relations outside, the largest product of degrees towards it and to the boundary.

        Leaving edges out of the boundary can only raise a degree, so the whole boundary gives the least bound.
        """
        return self._estimate_without(subset, 0)

    def components(self, subset: int) -> list[list[int]]:
        """Connected parts."""
        left, found = {r for r in range(self.m) if subset >> r & 1}, []
        while left:
            part = [left.pop()]
            for r in part:
                near = {s for s in left if self.attrs[r] & self.attrs[s] and any(e.parent in (r, s) and e.child in (r, s) for e in self.tree.edges)}
                left -= near
                part += sorted(near)
            found.append(sorted(part))
        return found

    def exact(self, subset: int, dropped: int) -> int | None:
        """The most answers of the subset's join that share values of its boundary without the dropped edges.

        None if some component's remaining boundary is at several relations. Components of any size are counted by Spark.
        """
        product = 1
        for part in self.components(subset):
            mask = sum(1 << r for r in part)
            keep = self.boundary(subset) & ~dropped & self._attrs_of(part)
            if (mask, keep) not in self._exact:
                self._exact[mask, keep] = self._component(part, keep)
            n = self._exact[mask, keep]
            if n is None:
                return None
            product *= n
        return product

    def _attrs_of(self, part: list[int]) -> int:
        out = 0
        for r in part:
            out |= self.attrs[r]
        return out

    def _component(self, part: list[int], keep: int) -> int | None:
        at = [r for r in part if self.attrs[r] & keep]
        if len(at) > 1:
            return None
        top = at[0] if at else part[0]
        if len(part) == 1:
            return self.degrees()[top][keep]
        # the component as a tree that hangs from `top`
        place = {r: k for k, r in enumerate(part)}
        edges, seen, todo = [], {top}, [top]
        while todo:
            r = todo.pop()
            for e in self.tree.edges:
                other = e.child if e.parent == r else e.parent if e.child == r else None
                if other in place and other not in seen:
                    down = e.parent == r
                    edges.append(Edge(place[r], place[other], e.parent_cols if down else e.child_cols, e.child_cols if down else e.parent_cols))
                    seen.add(other)
                    todo.append(other)
        sub = JoinTree([self.tree.relations[r] for r in part], edges)
        cols = [label(place[top], c) for a in range(self.m) if keep >> a & 1 for c in self._columns(top, a)]
        counted = counting.up_pass(sub)[place[top]]
        grouped = counted.groupBy(*cols).agg(F.sum(counting.DELTA).alias("n")) if cols else counted.agg(F.sum(counting.DELTA).alias("n"))
        return int(grouped.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0])

    def _relaxations(self, subset: int) -> list[int]:
        attrs = [a for a in range(self.m) if self.boundary(subset) >> a & 1]
        return [sum(1 << a for k, a in enumerate(attrs) if n >> k & 1) for n in range(1 << len(attrs))]

    def _least_relaxed(self, subset: int, need: int = 0) -> list[tuple[int, int]]:
        """(count, dropped edges) of the smallest relaxations, `need` among them, that have an exact count.

        Dropping more edges can only raise a count, so what contains one of these is not counted.
        """
        found: list[tuple[int, int]] = []
        for y in self._relaxations(subset):
            if y & need == need and not any(y & z == z for _, z in found) and (x := self.exact(subset, y)) is not None:
                found.append((x, y))
        return found

    def _subsets(self) -> list[int]:
        """Proper ones, large to small, then by mask."""
        return sorted(range(1, (1 << self.m) - 1), key=lambda s: (-s.bit_count(), s))

    def _wider(self, subset: int) -> list[int]:
        whole = (1 << self.m) - 1
        return [w for r in range(self.m) if not subset >> r & 1 and (w := subset | 1 << r) != whole]

    def estimates(self) -> dict[int, int]:
        return {s: self.estimate(s) for s in self._subsets()}

    def exact_where_sound(self) -> dict[int, int]:
        """Exact counts where they are lower and all subsets one relation larger use theirs too; else estimates.

        A join without answers has no most frequent value, so the estimate stands, as in relaxed_together().
        """
        out, used = {}, {}
        for s in self._subsets():
            est = self.estimate(s)
            found = [x for x, _ in self._least_relaxed(s) if x]
            used[s] = bool(found) and min(found) < est and all(used[w] for w in self._wider(s))
            out[s] = min(found) if used[s] else est
        return out

    def relaxed_together(self) -> dict[int, int]:
        """Exact counts or estimates under relaxations that grow from larger subsets to smaller ones."""
        out: dict[int, int] = {}
        chosen: dict[int, tuple[int, bool]] = {}
        for s in self._subsets():
            need, forced = 0, False
            for w in self._wider(s):
                need |= chosen[w][0]
                forced |= not chosen[w][1]
            need &= self.boundary(s)
            options: list[tuple[int, int, bool]] = []
            if not forced and (x := self.exact(s, need)):
                options.append((x, need, True))
            options.append((self._estimate_without(s, need), need, False))
            if not forced:
                options += [(x, y, True) for x, y in self._least_relaxed(s, need) if x]
            value, relaxed, exact = min(options, key=lambda o: o[0])
            out[s], chosen[s] = value, (relaxed, exact)
        return out

    def _estimate_without(self, subset: int, dropped: int) -> int:
        edge, best = self.boundary(subset) & ~dropped, 1
        for r in range(self.m):
            if not subset >> r & 1:
                best = max(best, math.prod(self.degrees()[j][(1 << self._hop(j, r)) | (edge & self.attrs[j])] for j in range(self.m) if subset >> j & 1))
        return best

    def smooth(self, epsilon: float, delta: float) -> Breakdown:
        """The least of the three bounds' smooth sensitivities and the global one; 1 at least."""
        beta = smoothing(epsilon, delta)
        k, cost = search_cost(self.m, beta)
        if cost > BUDGET:
            raise TooExpensive(f"{self.m} relations at epsilon {epsilon:g}: about {cost:.3g} evaluations; raise epsilon or give a size")
        up = lambda b: max(1, math.ceil(residual_sensitivity(self.m, b, beta)))
        est, exact, together = up(self.estimates()), up(self.exact_where_sound()), up(self.relaxed_together())
        total = global_sensitivity(self.rows())
        return Breakdown(beta, k, cost, est, exact, together, total, max(1, min(est, exact, together, total)))


@dataclass(frozen=True)
class Breakdown:
    """Where a sensitivity comes from."""

    beta: float
    max_distance: int
    evaluations: float
    by_estimates: int
    by_exact: int
    by_relaxation: int
    global_bound: int
    sensitivity: int


def protected_size(exact: int, sensitivity: int = 1, epsilon: float = 1.0, delta: float = 1e-9, tau: int = 0) -> int:
    """max(exact, tau) if tau is given, else exact + ceil(factor * sensitivity); 1 at least. No noise is drawn."""
    if tau > 0:
        return max(1, exact, tau)
    return max(1, min(MOST, exact + math.ceil(noise_factor(epsilon, delta) * max(1, sensitivity))))


def degree_table(tree: JoinTree) -> DataFrame:
    """relation, subset of its edges (bit: child), max_frequency."""
    s = Sensitivity(tree)
    rows = [(tree.names[r], k, n) for r, d in enumerate(s.degrees()) for k, n in sorted(d.items())]
    return tree.relations[0].sparkSession.createDataFrame(rows, "relation string, subset long, max_frequency long")
