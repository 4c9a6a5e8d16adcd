"""The boosted model learns from every example, wherever its sums are made."""

import numpy as np

from treeline.llm import pii


def texts(n):
    return [f"mail a{k}@b{k % 7}.example.org or +49 {30 + k % 9} {1000 + 37 * k} {2000 + 91 * k} from 10.0.{k % 200}.{k // 200}" for k in range(n)]


def test_no_example_is_left_out(spark, monkeypatch):
    """Each document holds one mail address, phone number and ip address; 1700 of a kind were cut to 1500 before."""
    seen = []
    grow = pii.Boosted.fit_binned
    monkeypatch.setattr(pii.Boosted, "fit_binned", lambda self, b, y, w: (seen.append(w.sum()), grow(self, b, y, w))[1])
    held = []
    tail = pii._tail
    monkeypatch.setattr(pii, "_tail", lambda m, *a: (held.append(a[2].sum()), tail(m, *a))[1])
    docs = spark.createDataFrame([(t,) for t in texts(1700)], "text string")
    pii.fit(docs, pii.Settings(trees=1))
    every = {(*e[:3], pii.binned(e[3]).tobytes()) for t in texts(1700) for e in pii._examples(t)}
    built = {(*e[:3], pii.binned(e[3]).tobytes()) for e in pii._built_in()}
    assert sum(e[:2] == (0, 1) for e in every) == 1700 and seen[0] + held[0] == len(every | built)


def test_tasks_and_driver_give_one_model(spark):
    docs = spark.createDataFrame([(t,) for t in texts(60)], "text string").repartition(3)
    a, b = (pii.fit(docs, pii.Settings(trees=3, local=n)) for n in (100_000, 0))
    assert a.thresholds == b.thresholds and a.boosted.base == b.boosted.base
    for (t, leaf), (u, other) in zip(a.boosted.trees, b.boosted.trees, strict=True):
        assert all((x == y).all() for x, y in zip(t, u, strict=True)) and np.array_equal(leaf, other)
