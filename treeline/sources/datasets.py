"""The built-in join trees: a sample, shapes over decision-support tables, and synthetic ones."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.plans.tree import Edge, JoinTree
from treeline.sources.text import read_expected, read_ints


def sample(spark: SparkSession) -> JoinTree:
    """Six small relations."""
    rows = [
        [(15, 10, 3), (8, 7, 5), (9, 10, 1), (8, 9, 3)],
        [(10, 8), (11, 9), (12, 8), (13, 15)],
        [(7, 15), (7, 16), (10, 17), (9, 18)],
        [(1, 1), (3, 4), (3, 2), (5, 1)],
        [(1, 1), (3, 2), (3, 3), (1, 4)],
        [(1, 5), (2, 6), (4, 7), (4, 8)],
    ]
    frames = [spark.createDataFrame(r, ", ".join(f"c{k} long" for k in range(len(r[0])))) for r in rows]
    return JoinTree.from_parents(frames, [-1, 0, 0, 0, 3, 3], [-1, 0, 1, 2, 0, 1], [-1, 1, 0, 0, 0, 0])


@dataclass(frozen=True)
class Shape:
    """A tree over text tables: (file, cells) of each relation, parents, and the joined cells on both sides."""

    files: tuple[tuple[str, int], ...]
    parent: tuple[int, ...]
    in_parent: tuple[int, ...]
    in_child: tuple[int, ...]
    left: tuple[int, ...] = ()


def _star(root: tuple[str, int], *leaves: str, left: tuple[int, ...] = ()) -> Shape:
    n = len(leaves)
    return Shape((root, *((x, 2) for x in leaves)), (-1, *[0] * n), (-1, *range(n)), (-1, *[0] * n), left)


#: Trees over projected tables of a decision-support benchmark, by name; relations are files R<i>_<name>.tbl.
SHAPES = {
    "q18": Shape((("catalog_sales", 4), ("date_dim", 2), ("item", 2), ("cd1", 2), ("customer", 3), ("cd2", 2), ("customer_address", 2)), (-1, 0, 0, 0, 0, 4, 4), (-1, 0, 1, 2, 3, 1, 2), (-1, 0, 0, 0, 0, 0, 0)),
    "q64": Shape((("customer", 2), ("customer_demographics", 2), ("store_returns", 2)), (-1, 0, 1), (-1, 0, 0), (-1, 0, 0)),
    "q72": _star(("catalog_sales", 7), "item", "customer_demographics", "household_demographics", "date_dim_d1", "date_dim_d3", "promotion", "catalog_returns", left=(6, 7)),
    "q85": Shape((("web_sales", 3), ("web_page", 2), ("date_dim", 2), ("web_returns", 5), ("cd1", 2), ("cd2", 2), ("customer_address", 2), ("reason", 2)), (-1, 0, 0, 0, 3, 3, 3, 3), (-1, 0, 1, 2, 1, 2, 3, 4), (-1, 0, 0, 0, 0, 0, 0, 0)),
    "q85_chain3": Shape((("web_sales", 2), ("web_returns", 2), ("cd1", 2)), (-1, 0, 1), (-1, 0, 1), (-1, 0, 0)),
    "q85_returns_star": _star(("web_returns", 4), "cd1", "cd2", "customer_address", "reason"),
}


def load_shape(spark: SparkSession, name: str, folder: str, check: bool = True) -> JoinTree:
    """A tree of SHAPES from its text tables."""
    s = SHAPES[name]
    frames = [read_ints(spark, f"{folder}/R{k + 1}_{f}.tbl", [f"c{j}" for j in range(n)], check) for k, (f, n) in enumerate(s.files)]
    return JoinTree.from_parents(frames, s.parent, s.in_parent, s.in_child, [f for f, _ in s.files], s.left)


def expected_rows(spark: SparkSession, folder: str) -> int:
    """The expected size beside a tree's tables, or -1."""
    return read_expected(spark, f"{folder}/expected.txt")


# --- trees over the order-processing tables (Parquet) ------------------------------------------------------------------


def _t(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*(F.col(c).cast("long").alias(c) for c in columns))


def partsupp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part and supplier pairs that were ever ordered."""
    return _t(spark, sf_dir, "lineitem", "l_partkey", "l_suppkey").distinct().select(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey"))


def _tree(parts: Sequence[tuple[str, DataFrame]], links: Sequence[tuple]) -> JoinTree:
    edges = []
    for link in links:
        p, c, a, b, *how = link
        one = lambda x: (x,) if isinstance(x, str) else tuple(x)
        edges.append(Edge(p, c, one(a), one(b), *how))
    return JoinTree([d for _, d in parts], edges, [n for n, _ in parts])


def q9(spark: SparkSession, sf_dir: str) -> JoinTree:
    """Line items with orders and part-supplier pairs (a two-column edge), their parts, suppliers and nations."""
    parts = [
        ("lineitem", _t(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey", "l_orderkey")),
        ("orders", _t(spark, sf_dir, "orders", "o_orderkey")),
        ("partsupp", partsupp(spark, sf_dir).select("ps_suppkey", "ps_partkey")),
        ("part", _t(spark, sf_dir, "part", "p_partkey")),
        ("supplier", _t(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")),
        ("nation", _t(spark, sf_dir, "nation", "n_nationkey")),
    ]
    return _tree(parts, [(0, 1, "l_orderkey", "o_orderkey"), (0, 2, ("l_suppkey", "l_partkey"), ("ps_suppkey", "ps_partkey")), (2, 3, "ps_partkey", "p_partkey"), (2, 4, "ps_suppkey", "s_suppkey"), (4, 5, "s_nationkey", "n_nationkey")])


def binary_l3(spark: SparkSession, sf_dir: str) -> JoinTree:
    """A full binary tree of three levels; parts meet suppliers on the part alone, so results grow fast."""
    orders = _t(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    parts = [
        ("lineitem", _t(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey")),
        ("orders", orders),
        ("partsupp", partsupp(spark, sf_dir)),
        ("customer", _t(spark, sf_dir, "customer", "c_custkey", "c_nationkey")),
        ("orders2", orders),
        ("part", _t(spark, sf_dir, "part", "p_partkey", "p_size")),
        ("supplier", _t(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")),
    ]
    return _tree(parts, [(0, 1, "l_orderkey", "o_orderkey"), (0, 2, "l_partkey", "ps_partkey"), (1, 3, "o_custkey", "c_custkey"), (1, 4, "o_custkey", "o_custkey"), (2, 5, "ps_partkey", "p_partkey"), (2, 6, "ps_suppkey", "s_suppkey")])


def ternary_l3(spark: SparkSession, sf_dir: str) -> JoinTree:
    """A full ternary tree of three levels, thirteen relations with repeats."""
    t = lambda name, *c: _t(spark, sf_dir, name, *c)
    parts = [
        ("lineitem", t("lineitem", "l_orderkey", "l_partkey", "l_suppkey")),
        ("orders", t("orders", "o_orderkey", "o_custkey")),
        ("part", t("part", "p_partkey", "p_size")),
        ("supplier", t("supplier", "s_suppkey", "s_nationkey")),
        ("customer", t("customer", "c_custkey", "c_nationkey")),
        ("orders2", t("orders", "o_custkey", "o_orderkey")),
        ("customer2", t("customer", "c_custkey", "c_nationkey")),
        ("part2", t("part", "p_partkey", "p_size")),
        ("partsupp", partsupp(spark, sf_dir)),
        ("part3", t("part", "p_partkey", "p_size")),
        ("nation", t("nation", "n_nationkey", "n_regionkey")),
        ("supplier2", t("supplier", "s_nationkey", "s_suppkey")),
        ("nation2", t("nation", "n_nationkey", "n_regionkey")),
    ]
    links = [(0, 1, "l_orderkey", "o_orderkey"), (0, 2, "l_partkey", "p_partkey"), (0, 3, "l_suppkey", "s_suppkey")]
    links += [(1, k, "o_custkey", c) for k, c in ((4, "c_custkey"), (5, "o_custkey"), (6, "c_custkey"))]
    links += [(2, k, "p_partkey", c) for k, c in ((7, "p_partkey"), (8, "ps_partkey"), (9, "p_partkey"))]
    links += [(3, k, "s_nationkey", c) for k, c in ((10, "n_nationkey"), (11, "s_nationkey"), (12, "n_nationkey"))]
    return _tree(parts, links)


def chain4(spark: SparkSession, sf_dir: str) -> JoinTree:
    """Line items, orders, customers, nations."""
    parts = [
        ("lineitem", _t(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber")),
        ("orders", _t(spark, sf_dir, "orders", "o_orderkey", "o_custkey")),
        ("customer", _t(spark, sf_dir, "customer", "c_custkey", "c_nationkey")),
        ("nation", _t(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")),
    ]
    return _tree(parts, [(0, 1, "l_orderkey", "o_orderkey"), (1, 2, "o_custkey", "c_custkey"), (2, 3, "c_nationkey", "n_nationkey")])


def star3(spark: SparkSession, sf_dir: str) -> JoinTree:
    """Line items with orders, parts and suppliers."""
    parts = [
        ("lineitem", _t(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey")),
        ("orders", _t(spark, sf_dir, "orders", "o_orderkey", "o_custkey")),
        ("part", _t(spark, sf_dir, "part", "p_partkey", "p_size")),
        ("supplier", _t(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")),
    ]
    return _tree(parts, [(0, 1, "l_orderkey", "o_orderkey"), (0, 2, "l_partkey", "p_partkey"), (0, 3, "l_suppkey", "s_suppkey")])


def left_edge(spark: SparkSession, sf_dir: str) -> JoinTree:
    """Customers with their orders, if any, and nations."""
    parts = [
        ("customer", _t(spark, sf_dir, "customer", "c_custkey", "c_nationkey")),
        ("orders", _t(spark, sf_dir, "orders", "o_custkey", "o_orderkey")),
        ("nation", _t(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")),
    ]
    return _tree(parts, [(0, 1, "c_custkey", "o_custkey", "left"), (0, 2, "c_nationkey", "n_nationkey")])


def composite(spark: SparkSession, sf_dir: str) -> JoinTree:
    """Line items and the pairs of part and supplier."""
    parts = [("lineitem", _t(spark, sf_dir, "lineitem", "l_partkey", "l_suppkey")), ("partsupp", partsupp(spark, sf_dir))]
    return _tree(parts, [(0, 1, ("l_partkey", "l_suppkey"), ("ps_partkey", "ps_suppkey"))])


# --- synthetic ---------------------------------------------------------------------------------------------------------


def uniform_table(spark: SparkSession, rows: int, columns: int, key_range: int, seed: int, number: int) -> DataFrame:
    """Integers uniform in 1..key_range, each from a hash of seed, table, row and column: the same on any cluster."""
    return spark.range(rows).select(*((F.pmod(F.xxhash64(F.lit(seed), F.lit(number), "id", F.lit(c)), F.lit(key_range)) + 1).alias(f"c{c}") for c in range(columns)))


def full_ternary(spark: SparkSession, rows: int = 500, key_range: int = 300, seed: int = 1) -> JoinTree:
    """Thirteen random tables in three full levels; child j hangs from its parent's column j."""
    parent = [-1, *(k for k in range(4) for _ in range(3))]
    place = [-1, *(j for _ in range(4) for j in range(3))]
    frames = [uniform_table(spark, rows, 3 if k < 4 else 2, key_range, seed, k) for k in range(13)]
    return JoinTree.from_parents(frames, parent, place, [-1, *[0] * 12])


def star(spark: SparkSession, leaves: int, rows: int = 500, key_range: int = 300, seed: int = 1) -> JoinTree:
    """A random root of one column a leaf."""
    frames = [uniform_table(spark, rows, leaves, key_range, seed, 0), *(uniform_table(spark, rows, 2, key_range, seed, k) for k in range(1, leaves + 1))]
    return JoinTree.from_parents(frames, [-1, *[0] * leaves], [-1, *range(leaves)], [-1, *[0] * leaves])


TREES = {"tpch9": q9, "tpch-binary-l3": binary_l3, "tpch-ternary-l3": ternary_l3, "chain4": chain4, "star3": star3, "left-edge": left_edge, "composite": composite}
