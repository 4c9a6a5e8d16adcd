"""The join engine on hand-made trees: sizes, contributions, strategies, direct access, padding."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from treeline.operators import access, counting, joins, padding, privacy
from treeline.plans.tree import Edge, JoinTree, TreeError
from treeline.sources import datasets


def bag(df):
    return Counter(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def sample(spark):
    return datasets.sample(spark)


@pytest.fixture(scope="module")
def awkward(spark):
    """Key 0, NULL keys, repeated rows, a child without partner, on both sides."""
    a = spark.createDataFrame([(0, 1), (0, 1), (None, 2), (0, 0), (5, 9), (7, None)], "k long, v long")
    b = spark.createDataFrame([(0, 10), (0, 10), (None, 11), (9, 12), (5, 0)], "k long, w long")
    c = spark.createDataFrame([(10, 1), (10, 2), (0, 3), (12, 4)], "w long, x long")
    return JoinTree([a, b, c], [Edge(0, 1, ("k",), ("k",)), Edge(1, 2, ("w",), ("w",))])


def test_sample_sizes(sample):
    assert counting.size(sample) == 20
    assert counting.exceeds(sample, 19) and not counting.exceeds(sample, 20)
    delta = {tuple(r)[:3]: int(r["_delta"]) for r in counting.up_pass(sample)[0].select("r1_c0", "r1_c1", "r1_c2", "_delta").collect()}
    assert delta == {(15, 10, 3): 6, (8, 7, 5): 0, (9, 10, 1): 2, (8, 9, 3): 12}


def test_sample_contributions(sample):
    assert int(counting.max_contribution(sample).first()[0]) == 12
    found = counting.contributions(sample)
    assert {tuple(r)[:2]: int(r[2]) for r in found[2].collect()} == {(9, 18): 12, (10, 17): 8, (7, 15): 0, (7, 16): 0}
    assert {tuple(r)[:2]: int(r[2]) for r in found[4].collect()} == {(3, 2): 9, (3, 3): 9, (1, 1): 1, (1, 4): 1}


def test_sample_rows(sample):
    rows = sorted(map(tuple, joins.native(sample).collect()))
    assert len(rows) == 20 and len(rows[0]) == 13
    assert rows[0] == (8, 9, 3, 10, 8, 9, 18, 3, 2, 3, 2, 2, 6)
    assert rows[-1] == (15, 10, 3, 13, 15, 10, 17, 3, 4, 3, 3, 4, 8)


@pytest.mark.parametrize("strategy", [s for s in joins.STRATEGIES if s != "native"])
@pytest.mark.parametrize("name", ["sample", "awkward", "random", "left"])
def test_strategies_agree(spark, sample, awkward, strategy, name):
    tree = {
        "sample": lambda: sample,
        "awkward": lambda: awkward,
        "random": lambda: datasets.star(spark, 3, rows=40, key_range=12, seed=3),
        "left": lambda: JoinTree(awkward.relations, [Edge(0, 1, ("k",), ("k",), "left"), Edge(1, 2, ("w",), ("w",))]),
    }[name]()
    want = bag(joins.native(tree))
    assert bag(joins.join(tree, strategy)) == want
    assert counting.size(tree) == sum(want.values())


def test_awkward_rows(awkward):
    want = Counter({(0, 1, 0, 10, 10, 1): 4, (0, 1, 0, 10, 10, 2): 4, (0, 0, 0, 10, 10, 1): 2, (0, 0, 0, 10, 10, 2): 2, (5, 9, 5, 0, 0, 3): 1})
    assert bag(joins.native(awkward)) == want
    reduced = joins.full_reduce(awkward)
    assert [r.count() for r in reduced.relations] == [4, 3, 3]
    assert [r.count() for r in joins.full_reduce(reduced).relations] == [4, 3, 3]


def test_composite_and_empty(spark, awkward):
    a, b = awkward.relations[0], awkward.relations[0].toDF("k2", "v2")
    tree = JoinTree([a, b], [Edge(0, 1, ("k", "v"), ("k2", "v2"))])
    assert counting.size(tree) == 2 * 2 + 1 + 1  # NULL meets nothing
    empty = JoinTree([a, b.limit(0)], tree.edges)
    assert counting.size(empty) == 0 and joins.count_expand(empty).count() == 0
    assert counting.size(JoinTree([a.limit(0), b], tree.edges)) == 0
    assert counting.size(JoinTree([a], [])) == 6 and joins.count_expand(JoinTree([a], [])).count() == 6


def test_trees_are_checked(awkward):
    r = awkward.relations
    for edges in ([], [Edge(0, 1, ("k",), ("k",)), Edge(0, 1, ("k",), ("k",))], [Edge(0, 1, ("k",), ("nope",)), Edge(1, 2, ("w",), ("w",))], [Edge(1, 2, ("w",), ("w",)), Edge(2, 1, ("w",), ("w",))]):
        with pytest.raises(TreeError):
            JoinTree(r, edges)


def test_direct_access(sample):
    every = access.answers(sample, 0, 20).collect()
    assert sorted(r[0] for r in every) == list(range(20))
    assert Counter(tuple(r)[1:] for r in every) == bag(joins.native(sample))
    some = {r[0]: tuple(r) for r in access.answers(sample, 5, 9).collect()}
    assert some == {r[0]: tuple(r) for r in every if 5 <= r[0] < 9}
    assert access.answers(sample, 30, 40).count() == 0


def test_direct_access_narrows_and_a_hot_key_is_spread(spark, monkeypatch):
    """Two thirds of the rows share a key on either side; every slice of the answers is that of the whole order."""
    monkeypatch.setattr(access, "NARROW", 40)
    monkeypatch.setattr(access, "HOT", 3)
    a = spark.createDataFrame([(k, 0 if k % 3 else k) for k in range(400)], "i long, x long")
    b = spark.createDataFrame([(0 if k % 3 else k, k) for k in range(60)], "x long, y long")
    c = spark.createDataFrame([(k % 20, k) for k in range(50)], "y long, z long")
    tree = JoinTree([a, b, c], [Edge(0, 1, ("x",), ("x",)), Edge(1, 2, ("y",), ("y",))])
    want = Counter(map(tuple, joins.join(tree, "native").collect()))
    n = sum(want.values())
    assert n > 9000 and Counter(map(tuple, joins.join(tree, "count_expand").collect())) == want
    every = {r[0]: tuple(r)[1:] for r in access.answers(tree, 0, n).collect()}
    assert len(every) == n and Counter(every.values()) == want
    for lo, hi in ((0, 1), (n // 2, n // 2 + 300), (n - 5, n + 9)):
        assert {r[0]: tuple(r)[1:] for r in access.answers(tree, lo, hi).collect()} == {k: every[k] for k in range(lo, min(hi, n))}
    monkeypatch.setattr(access, "FEW", 10)
    assert {r[0]: tuple(r)[1:] for r in access.answers(tree, 100, 200).collect()} == {k: every[k] for k in range(100, 200)}


def test_privacy_constants():
    assert privacy.smoothing(1, 1e-9) == pytest.approx(0.022814, abs=1e-6)
    assert privacy.noise_factor(1, 1e-9) == pytest.approx(332.2661, abs=1e-4)
    assert privacy.noise_factor(16, 1e-9) == pytest.approx(35.4823, abs=1e-4)
    assert privacy.smoothing(-1, 5) == privacy.smoothing(1, 1e-9)
    assert privacy.search_cost(6, privacy.smoothing(4, 1e-9))[0] == 64
    assert privacy.search_cost(8, privacy.smoothing(1, 1e-9))[1] > privacy.BUDGET
    assert privacy.protected_size(10, tau=5) == 10 and privacy.protected_size(0, tau=3) == 3


def test_sensitivity_of_the_sample(sample):
    s = privacy.Sensitivity(sample)
    est = s.estimates()
    assert max(est.values()) == 32 and privacy.global_sensitivity(s.rows()) == 1024
    assert privacy.residual_sensitivity(6, est, privacy.smoothing(16, 1e-9)) == pytest.approx(60.8959, abs=1e-3)
    assert privacy.residual_sensitivity(6, est, privacy.smoothing(8, 1e-9)) == pytest.approx(301.2419, abs=1e-3)
    exact = {e: x for e in est if (x := s.exact(e, 0)) is not None}
    assert all(x <= est[e] for e, x in exact.items())
    b = s.smooth(16, 1e-9)
    assert 12 <= b.sensitivity <= 61 and b.by_exact <= b.by_estimates == 61


def test_padding(sample):
    out = padding.padded_join(sample, tau=25)
    assert out.where("is_dummy").count() == 5 and out.where("NOT is_dummy").count() == 20
    assert padding.padded_join(sample, tau=5).count() == 20  # real rows are never cut
    assert padding.pad(sample.relations[0], 2, padding.DUMMY).where(f"c0 = {padding.DUMMY}").count() == 2
    with pytest.raises(padding.ResultTooLarge):
        padding.padded_join(sample, tau=25, cap=22)
    assert padding.padded_join(sample, tau=25, cap=22, fall_back=True).count() == 20
    with pytest.raises(OverflowError):
        joins.join(sample, cap=19)


def test_global_sensitivity_is_not_capped():
    rows = [36_000_000, 9_000_000, 900_000, 25]
    assert privacy.global_sensitivity(rows) == 36_000_000 * 9_000_000 * 900_000 > 1 << 63


def test_components_over_a_million_rows_are_counted_exactly(spark):
    """Few rows of b meet those of c, so counts are far below the products of degrees: half the rows of a have one key."""
    a = spark.range(700_000).select((F.col("id") % 2 * F.col("id")).alias("k"), "id")
    b = spark.range(400_000).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("x"))
    c = spark.range(10).select((F.col("id") - 1).alias("x"))
    s = privacy.Sensitivity(JoinTree([a, b, c], [Edge(0, 1, ("k",), ("k",)), Edge(1, 2, ("x",), ("x",))]))
    want = 350_000 + sum(1 for k in range(1, 400_000) if k % 3 == 0 and k % 2)
    assert s.exact(0b011, 0) == want and s.exact(0b110, 0) == 1
    assert s.relaxed_together()[0b011] == s.exact_where_sound()[0b011] == want < s.estimates()[0b011]


def test_a_chain_over_a_million_rows_uses_exact_counts(spark):
    """the counts enter the sensitivity at either epsilon."""
    a, b = spark.range(800_000).select((F.col("id") % 2 * F.col("id")).alias("k")), spark.range(300_000).select(F.col("id").alias("k"), (F.col("id") - F.col("id") % 3).alias("x"))
    s = privacy.Sensitivity(JoinTree([a, b, spark.range(10).select(F.col("id").alias("x"))], [Edge(0, 1, ("k",), ("k",)), Edge(1, 2, ("x",), ("x",))]))
    for epsilon in (1.0, 8.0):
        found = s.smooth(epsilon, 1e-9)
        assert found.by_exact == found.by_relaxation == found.sensitivity < found.by_estimates
