"""Every query of the join engine and the relational suite by name, with the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline import suite
from treeline.functions import encrypted, maintenance
from treeline.operators import access, counting, joins, padding, privacy
from treeline.operators import primitives as prim
from treeline.sources import datasets, text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_PS = "(SELECT DISTINCT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey FROM lineitem)"


def query(sql: str | None = None):
    """Register a function under its name with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _long(df: DataFrame, name: str = "n_rows") -> DataFrame:
    return df.withColumn(name, F.col(name).cast("bigint"))


# --- sizes -------------------------------------------------------------------------------------------------------------

# the sample tree's rows are fixed values
_SAMPLE = """WITH R1(a,b,c) AS (VALUES (15,10,3),(8,7,5),(9,10,1),(8,9,3)), R2(a,b) AS (VALUES (10,8),(11,9),(12,8),(13,15)), R3(a,b) AS (VALUES (7,15),(7,16),(10,17),(9,18)),
R4(a,b) AS (VALUES (1,1),(3,4),(3,2),(5,1)), R5(a,b) AS (VALUES (1,1),(3,2),(3,3),(1,4)), R6(a,b) AS (VALUES (1,5),(2,6),(4,7),(4,8))
"""
_SAMPLE_FROM = " FROM R1, R2, R3, R4, R5, R6 WHERE R1.a = R2.b AND R1.b = R3.a AND R1.c = R4.a AND R4.a = R5.a AND R4.b = R6.a"
_Q9_FROM = f" FROM lineitem, orders, {_PS} ps, part, supplier, nation WHERE l_orderkey = o_orderkey AND l_suppkey = ps_suppkey AND l_partkey = ps_partkey AND ps_partkey = p_partkey AND ps_suppkey = s_suppkey AND s_nationkey = n_nationkey"
_B3_FROM = f" FROM lineitem, orders o1, {_PS} ps, customer, orders o2, part, supplier WHERE l_orderkey = o1.o_orderkey AND l_partkey = ps_partkey AND o1.o_custkey = c_custkey AND o1.o_custkey = o2.o_custkey AND ps_partkey = p_partkey AND ps_suppkey = s_suppkey"
_CHAIN_FROM = " FROM lineitem, orders, customer, nation WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n_nationkey"
_STAR_FROM = " FROM lineitem, orders, part, supplier WHERE l_orderkey = o_orderkey AND l_partkey = p_partkey AND l_suppkey = s_suppkey"


@query(f"SELECT CAST(n_name AS VARCHAR) AS n_name, COUNT(*) AS n_rows{_CHAIN_FROM} GROUP BY n_name")
def tree_count_by_nation(spark, sf_dir):
    tree = datasets.chain4(spark, sf_dir)
    # the same tree, hung from the nations
    flipped = [(3, 2, "n_nationkey", "c_nationkey"), (2, 1, "c_custkey", "o_custkey"), (1, 0, "o_orderkey", "l_orderkey")]
    up = counting.up_pass(datasets._tree(list(zip(tree.names, tree.relations, strict=True)), flipped))[3]
    names = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), "n_name")
    return up.where(f"{counting.DELTA} > 0").join(names, F.col("r4_n_nationkey") == F.col("k")).select("n_name", F.col(counting.DELTA).cast("bigint").alias("n_rows"))


def _count(name: str, builder, frm: str):
    def run(spark, sf_dir):
        return _long(counting.join_size(builder(spark, sf_dir)))

    run.__name__ = name
    query(f"SELECT COUNT(*) AS n_rows{frm}" if not frm.startswith("WITH") else frm)(run)


_count("tree_count_sample", lambda s, d: datasets.sample(s), f"{_SAMPLE}SELECT COUNT(*) AS n_rows{_SAMPLE_FROM}")
_count("tree_count_chain4", datasets.chain4, _CHAIN_FROM)
_count("tree_count_star", datasets.star3, _STAR_FROM)
_count("tree_count_q9", datasets.q9, _Q9_FROM)
_count("tree_count_binary_l3", datasets.binary_l3, _B3_FROM)
# counts by key multiply up the tree, so the statement stays small where the join would not
_count(
    "tree_count_ternary_l3",
    datasets.ternary_l3,
    f"""WITH c5 AS (SELECT c_custkey AS k, COUNT(*) AS n FROM customer GROUP BY c_custkey), c6 AS (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey),
c2 AS (SELECT o_orderkey AS k, SUM(c5.n * c6.n * c5.n) AS n FROM orders, c5, c6 WHERE o_custkey = c5.k AND o_custkey = c6.k GROUP BY o_orderkey),
p AS (SELECT p_partkey AS k, COUNT(*) AS n FROM part GROUP BY p_partkey), ps AS (SELECT ps_partkey AS k, COUNT(*) AS n FROM {_PS} x GROUP BY ps_partkey),
c3 AS (SELECT p.k, SUM(p.n * p.n * ps.n * p.n) AS n FROM p, ps WHERE p.k = ps.k GROUP BY p.k),
n AS (SELECT n_nationkey AS k, COUNT(*) AS n FROM nation GROUP BY n_nationkey), s AS (SELECT s_nationkey AS k, COUNT(*) AS n FROM supplier GROUP BY s_nationkey),
c4 AS (SELECT s_suppkey AS k, SUM(n.n * s.n * n.n) AS n FROM supplier, n, s WHERE s_nationkey = n.k AND s_nationkey = s.k GROUP BY s_suppkey)
SELECT CAST(SUM(c2.n * c3.n * c4.n) AS BIGINT) AS n_rows FROM lineitem, c2, c3, c4 WHERE l_orderkey = c2.k AND l_partkey = c3.k AND l_suppkey = c4.k""",
)
_count("tree_count_left_edge", datasets.left_edge, " FROM customer LEFT JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey")
_count("tree_count_composite", datasets.composite, f" FROM lineitem, {_PS} ps WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey")


@query(f"SELECT COUNT(*) > 50000 AS over{_STAR_FROM}")
def count_over_threshold(spark, sf_dir):
    return counting.join_size(datasets.star3(spark, sf_dir)).select((F.col("n_rows") > 50_000).alias("over"))


def _text_trees() -> None:
    """The shapes over text tables, whose cells are made of order keys, written and read back as text."""

    def made(shape: datasets.Shape, k: int) -> str:
        cells, step = shape.files[k][1], 3 + k
        c = ", ".join(f"CAST((o_orderkey * {step + 2 * j} + o_custkey * {j}) % {23 + 9 * j + k} AS BIGINT) AS c{j}" for j in range(cells))
        return f"SELECT {c} FROM orders WHERE o_orderkey % {2 if k == 0 else 211} = {k % 2} AND o_orderkey < 12000"

    for name, shape in datasets.SHAPES.items():
        frm = "made0"
        for k in range(1, len(shape.files)):
            frm += f" {'LEFT ' if k in shape.left else ''}JOIN made{k} ON made{shape.parent[k]}.c{shape.in_parent[k]} = made{k}.c{shape.in_child[k]}"
        tables = ", ".join(f"made{k} AS ({made(shape, k)})" for k in range(len(shape.files)))

        def run(spark, sf_dir, name=name, shape=shape):
            _t(spark, sf_dir, "orders").createOrReplaceTempView("orders")
            folder = text.scratch(spark, name)
            for k, (f, _) in enumerate(shape.files):
                text.write_ints(spark.sql(made(shape, k)), f"{folder}/R{k + 1}_{f}.tbl")
            return _long(counting.join_size(datasets.load_shape(spark, name, folder)))

        run.__name__ = f"tree_count_text_{name}"
        query(f"WITH {tables} SELECT COUNT(*) AS n_rows FROM {frm}")(run)


_text_trees()


@query("SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_regionkey END AS n_regionkey FROM nation")
def pipe_views(spark, sf_dir):
    folder, odd = text.scratch(spark, "pipes"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_regionkey"))
    text.write_pipes(_t(spark, sf_dir, "nation").select("n_nationkey", "n_name", odd.alias("n_regionkey")), f"{folder}/nation_text.tbl")
    text.load_views(spark, folder, ["nation_text"], {"nation_text": "n_nationkey int, n_name string, n_regionkey int"})
    return spark.sql("SELECT * FROM nation_text")


# --- joins -------------------------------------------------------------------------------------------------------------

_Q9_COLUMNS = "l_suppkey AS r1_l_suppkey, l_partkey AS r1_l_partkey, l_orderkey AS r1_l_orderkey, o_orderkey AS r2_o_orderkey, ps_suppkey AS r3_ps_suppkey, ps_partkey AS r3_ps_partkey, p_partkey AS r4_p_partkey, s_suppkey AS r5_s_suppkey, CAST(s_nationkey AS BIGINT) AS r5_s_nationkey, CAST(n_nationkey AS BIGINT) AS r6_n_nationkey"


def _join_queries() -> None:
    for strategy in joins.STRATEGIES:
        short = {"native": "native", "reduce_join": "reduce", "serial_yannakakis": "serial", "count_expand": "count_expand"}[strategy]

        def on_q9(spark, sf_dir, s=strategy):
            return joins.join(datasets.q9(spark, sf_dir), s)

        def on_sample(spark, sf_dir, s=strategy):
            return joins.join(datasets.sample(spark), s)

        def on_left(spark, sf_dir, s=strategy):
            return joins.join(datasets.left_edge(spark, sf_dir), s)

        on_q9.__name__, on_sample.__name__, on_left.__name__ = f"join_{short}_q9", f"join_{short}_sample", f"join_{short}_left_edge"
        query(f"SELECT {_Q9_COLUMNS}{_Q9_FROM}")(on_q9)
        sample = ", ".join(f"CAST(R{r}.{c} AS BIGINT) AS r{r}_c{k}" for r in range(1, 7) for k, c in enumerate("abc" if r == 1 else "ab"))
        query(f"{_SAMPLE}SELECT {sample}{_SAMPLE_FROM}")(on_sample)
        query("SELECT c_custkey AS r1_c_custkey, CAST(c_nationkey AS BIGINT) AS r1_c_nationkey, o_custkey AS r2_o_custkey, o_orderkey AS r2_o_orderkey, CAST(n_nationkey AS BIGINT) AS r3_n_nationkey, CAST(n_regionkey AS BIGINT) AS r3_n_regionkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey")(on_left)


_join_queries()


def _q9_filtered(spark, sf_dir):
    """The q9 tree where some part and order filters leave dangling rows."""
    t = datasets.q9(spark, sf_dir)
    t.relations[1] = t.relations[1].where("o_orderkey % 3 = 0")
    t.relations[3] = t.relations[3].where("p_partkey % 5 = 0")
    return t


_Q9_SOME = _Q9_FROM + " AND o_orderkey % 3 = 0 AND p_partkey % 5 = 0"


@query(f"SELECT l_suppkey, l_partkey, l_orderkey{_Q9_SOME}")
def reduced_root(spark, sf_dir):
    return joins.full_reduce(_q9_filtered(spark, sf_dir)).relations[0]


@query(f"SELECT DISTINCT p_partkey{_Q9_SOME}")
def reduced_leaf(spark, sf_dir):
    return joins.full_reduce(_q9_filtered(spark, sf_dir)).relations[3]


@query(" UNION ALL ".join(f"SELECT '{n}' AS relation, COUNT(DISTINCT {k}) AS n_rows{_Q9_SOME}" for n, k in (("orders", "o_orderkey"), ("partsupp", "(ps_suppkey, ps_partkey)"), ("part", "p_partkey"), ("supplier", "s_suppkey"), ("nation", "n_nationkey"))) + f" UNION ALL SELECT 'lineitem', COUNT(*){_Q9_SOME}")
def reduced_sizes(spark, sf_dir):
    return joins.reduced_sizes(_q9_filtered(spark, sf_dir))


# --- multiplicities ----------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, COUNT(l_orderkey) AS delta FROM customer LEFT JOIN (orders JOIN lineitem ON o_orderkey = l_orderkey) ON c_custkey = o_custkey GROUP BY c_custkey")
def delta_per_root(spark, sf_dir):
    t = lambda n, *c: _t(spark, sf_dir, n).select(*(F.col(x).cast("long").alias(x) for x in c))
    tree = datasets._tree([("customer", t("customer", "c_custkey")), ("orders", t("orders", "o_orderkey", "o_custkey")), ("lineitem", t("lineitem", "l_orderkey"))], [(0, 1, "c_custkey", "o_custkey"), (1, 2, "o_orderkey", "l_orderkey")])
    return counting.up_pass(tree)[0].select(F.col("r1_c_custkey").alias("c_custkey"), F.col(counting.DELTA).cast("bigint").alias("delta"))


@query("SELECT o_orderkey, COUNT(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND EXISTS (SELECT * FROM customer, nation WHERE o_custkey = c_custkey AND c_nationkey = n_nationkey) GROUP BY o_orderkey")
def contribution_per_tuple(spark, sf_dir):
    return counting.contributions(datasets.chain4(spark, sf_dir))[1].select(F.col("r2_o_orderkey").alias("o_orderkey"), F.col("_n").cast("bigint").alias("n"))


@query("SELECT MAX(n) AS max_contribution FROM (SELECT COUNT(*) AS n FROM lineitem, orders, customer WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey GROUP BY c_nationkey) t")
def max_contribution(spark, sf_dir):
    return _long(counting.max_contribution(datasets.chain4(spark, sf_dir)), "max_contribution")


@query("""SELECT i AS answer_id, l_orderkey, l_linenumber, o_custkey, c_nationkey FROM (
  SELECT ROW_NUMBER() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS i, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, o_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey
  FROM lineitem, orders, customer, nation WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n_nationkey) t WHERE i >= 1000 AND i < 1500""")
def answer_at_index_range(spark, sf_dir):
    found = access.answers(datasets.chain4(spark, sf_dir), 1000, 1500)
    return found.select("answer_id", F.col("r1_l_orderkey").alias("l_orderkey"), F.col("r1_l_linenumber").alias("l_linenumber"), F.col("r2_o_custkey").alias("o_custkey"), F.col("r3_c_nationkey").alias("c_nationkey"))


@query("""WITH r AS (SELECT o_custkey AS k, o_orderkey, CAST(o_orderkey % 4 + 1 AS BIGINT) AS d, SUM(o_orderkey % 4 + 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - (o_orderkey % 4 + 1) AS rank FROM orders)
SELECT c_custkey AS k, c_custkey % 6 AS pc, o_orderkey FROM customer JOIN r ON c_custkey = k AND c_custkey % 6 >= rank AND c_custkey % 6 < rank + d""")
def rank_interval_lookup(spark, sf_dir):
    weighed = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", (F.col("o_orderkey") % 4 + 1).alias("d"))
    ranked = weighed.withColumn("rank", prim.seg_prefix("d", "k", ["o_orderkey"], inclusive=False))
    asked = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 6).alias("pc"))
    return access.interval_lookup(asked, ranked, "k", "pc", "rank", "d").select("k", "pc", "o_orderkey")


# --- primitives --------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_join(spark, sf_dir):
    return prim.semi_join(_t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders"), "c_custkey", "o_custkey").select("c_custkey")


@query("SELECT c_custkey, COUNT(o_custkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def count_semi_join(spark, sf_dir):
    return prim.count_semi_join(_t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders"), "c_custkey", "o_custkey").select("c_custkey", "n")


@query("SELECT o_orderkey, CAST(SUM(l_linenumber) AS BIGINT) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def value_semi_join(spark, sf_dir):
    return prim.count_semi_join(_t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey", "l_linenumber", keep_all=False).select("o_orderkey", "n")


@query("SELECT l_suppkey, COUNT(*) AS n FROM lineitem GROUP BY l_suppkey")
def reduce_by_key(spark, sf_dir):
    return prim.reduce_by_key(_t(spark, sf_dir, "lineitem"), "l_suppkey")


@query("SELECT c_custkey, n_name AS nation FROM customer, nation WHERE c_nationkey = n_nationkey")
def annotate(spark, sf_dir):
    return prim.annotate(_t(spark, sf_dir, "customer"), _t(spark, sf_dir, "nation"), "c_nationkey", "n_nationkey", "n_name", "nation").select("c_custkey", "nation")


@query("SELECT c_custkey, n FROM customer, (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) o WHERE c_custkey = o_custkey")
def augment(spark, sf_dir):
    return prim.augment(_t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders"), "c_custkey", "o_custkey").select("c_custkey", "n")


@query("SELECT tid, key, (SELECT COUNT(*) FROM customer WHERE c_nationkey = key) AS a1, (SELECT COUNT(*) FROM supplier WHERE s_nationkey = key) AS a2 FROM (SELECT 1 AS tid, c_nationkey AS key FROM customer UNION ALL SELECT 2, s_nationkey FROM supplier) t")
def group_dimensions(spark, sf_dir):
    return prim.group_dimensions(_t(spark, sf_dir, "customer"), _t(spark, sf_dir, "supplier"), "c_nationkey", "s_nationkey")


@query("SELECT o_orderkey, CAST((ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) % 3 + 1 AS BIGINT) AS number FROM orders")
def multi_number(spark, sf_dir):
    return prim.multi_number(_t(spark, sf_dir, "orders"), "o_custkey", ["o_orderkey"], 3).select("o_orderkey", F.col("number").cast("bigint"))


@query("""WITH t AS (SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, COUNT(*) OVER (PARTITION BY o_custkey) AS a1 FROM orders)
SELECT o_orderkey, CAST(i // a1 + (i % a1) * 3 AS BIGINT) AS q FROM t""")
def align_order(spark, sf_dir):
    numbered = prim.multi_number(_t(spark, sf_dir, "orders"), "o_custkey", ["o_orderkey"]).withColumn("_one", F.lit(1)).withColumn("a1", prim.seg_total("_one", "o_custkey"))
    return numbered.select("o_orderkey", prim.align_order(F.col("number") - 1, F.col("a1"), F.lit(3)).cast("bigint").alias("q"))


@query("SELECT o_orderkey, copy FROM (SELECT o_orderkey, UNNEST(RANGE(o_orderkey % 4)) AS copy FROM orders) t")
def expand_by_weight(spark, sf_dir):
    weighed = _t(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 4).alias("w"))
    return prim.expand_by_weight(weighed, "w").select("o_orderkey", "copy")


@query("""WITH e AS (SELECT c_custkey, UNNEST(RANGE(GREATEST(1, c_custkey % 3))) AS copy FROM customer), n AS (SELECT COUNT(*) AS n FROM e)
SELECT c_custkey, copy, FALSE AS is_dummy FROM e UNION ALL SELECT NULL, NULL, TRUE FROM (SELECT UNNEST(RANGE(GREATEST(0, 2500 - n))) FROM n) d""")
def expand_to_tau(spark, sf_dir):
    weighed = _t(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 3).alias("w"))
    return prim.expand_to(weighed, "w", 2500).select("c_custkey", "copy", "is_dummy")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 1")
def compact(spark, sf_dir):
    return prim.compact(_t(spark, sf_dir, "orders").withColumn("m", (F.col("o_orderkey") % 7 == 1).cast("int")), "m").select("o_orderkey")


@query("""WITH m AS (SELECT c_custkey FROM customer WHERE c_custkey % 7 = 1 ORDER BY c_custkey LIMIT 300), n AS (SELECT COUNT(*) AS n FROM m)
SELECT c_custkey, FALSE AS is_dummy FROM m UNION ALL SELECT NULL, TRUE FROM (SELECT UNNEST(RANGE(GREATEST(0, 300 - n))) FROM n) d""")
def compact_to_size(spark, sf_dir):
    marked = _t(spark, sf_dir, "customer").withColumn("m", (F.col("c_custkey") % 7 == 1).cast("int"))
    return prim.compact_to(marked, "m", ["c_custkey"], 300).select("c_custkey", "is_dummy")


@query("SELECT c_custkey, s_suppkey FROM customer, supplier WHERE c_nationkey = s_nationkey")
def two_way_join(spark, sf_dir):
    return prim.two_way_join(_t(spark, sf_dir, "customer"), _t(spark, sf_dir, "supplier"), "c_nationkey", "s_nationkey").select("c_custkey", "s_suppkey")


@query("""WITH t AS (SELECT c_custkey, s_suppkey FROM customer, supplier WHERE c_nationkey = s_nationkey), n AS (SELECT COUNT(*) AS n FROM t)
SELECT c_custkey, s_suppkey, FALSE AS is_dummy FROM t UNION ALL SELECT NULL, NULL, TRUE FROM (SELECT UNNEST(RANGE(GREATEST(0, 7000 - n))) FROM n) d""")
def two_way_join_padded(spark, sf_dir):
    return prim.two_way_join(_t(spark, sf_dir, "customer"), _t(spark, sf_dir, "supplier"), "c_nationkey", "s_nationkey", 7000).select("c_custkey", "s_suppkey", "is_dummy")


def _scan(name: str, make, sql: str):
    def run(spark, sf_dir):
        base = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 10 + 1).alias("v"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey")).alias("h"))
        return base.select("o_orderkey", make().cast("bigint").alias("x"))

    run.__name__ = name
    w = "OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN {} AND {})"
    query(f"SELECT o_orderkey, CAST({sql.replace('@', w)} AS BIGINT) AS x FROM (SELECT o_orderkey, o_custkey, o_orderkey % 10 + 1 AS v, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END AS h FROM orders) t")(run)


_P, _C, _N = "UNBOUNDED PRECEDING", "CURRENT ROW", "UNBOUNDED FOLLOWING"
_scan("seg_prefix_excl", lambda: prim.seg_prefix("v", "o_custkey", ["o_orderkey"], False), f"COALESCE(SUM(v) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN {_P} AND 1 PRECEDING), 0)")
_scan("seg_prefix_incl", lambda: prim.seg_prefix("v", "o_custkey", ["o_orderkey"]), f"SUM(v) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN {_P} AND {_C})")
_scan("seg_suffix", lambda: prim.seg_suffix("v", "o_custkey", ["o_orderkey"]), f"SUM(v) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN {_C} AND {_N})")
_scan("seg_suffix_excl", lambda: prim.seg_suffix("v", "o_custkey", ["o_orderkey"], False), f"COALESCE(SUM(v) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 FOLLOWING AND {_N}), 0)")
_scan("seg_total", lambda: prim.seg_total("v", "o_custkey"), "SUM(v) OVER (PARTITION BY o_custkey)")
_scan("fill_forward", lambda: prim.fill_forward("h", "o_custkey", ["o_orderkey"]), f"LAST_VALUE(h IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN {_P} AND {_C})")


@query(f"""SELECT l_orderkey, l_linenumber, CAST(ROUND(PRODUCT(v) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN {_C} AND {_N})) AS BIGINT) AS x
FROM (SELECT l_orderkey, l_linenumber, CAST(MAX(l_partkey) % 3 + 1 AS BIGINT) AS v FROM lineitem GROUP BY l_orderkey, l_linenumber) t""")
def seg_product(spark, sf_dir):
    base = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.max("l_partkey") % 3 + 1).alias("v"))
    return prim.with_suffix_product(base, "v", "l_orderkey", ["l_linenumber"], "x").select("l_orderkey", "l_linenumber", F.col("x").cast("bigint"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey DESC NULLS LAST, o_totalprice, o_orderkey LIMIT 50")
def multi_key_sort_topk(spark, sf_dir):
    return prim.top_k(_t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), [F.desc_nulls_last("o_custkey"), F.asc("o_totalprice"), F.asc("o_orderkey")], 50)


# --- statistics and privacy --------------------------------------------------------------------------------------------


@query("SELECT MAX(n) AS max_frequency FROM (SELECT COUNT(*) AS n FROM lineitem GROUP BY l_partkey) t")
def max_degree_single(spark, sf_dir):
    return prim.max_frequency(_t(spark, sf_dir, "lineitem"), ["l_partkey"])


@query("SELECT subset, MAX(n) AS max_frequency FROM (" + " UNION ALL ".join(f"SELECT CAST({s} AS BIGINT) AS subset, COUNT(*) AS n FROM lineitem{(' GROUP BY ' + ', '.join(c)) if c else ''}" for s in range(8) for c in [[x for k, x in enumerate(('l_orderkey', 'l_partkey', 'l_suppkey')) if s >> k & 1]]) + ") t GROUP BY subset")
def max_degree_subsets(spark, sf_dir):
    return prim.subset_frequencies(_t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey", "l_suppkey"])


@query("SELECT MAX(n) AS max_boundary FROM (SELECT COUNT(*) AS n FROM orders, customer, nation WHERE o_custkey = c_custkey AND c_nationkey = n_nationkey GROUP BY o_orderkey) t")
def max_boundary_component(spark, sf_dir):
    s = privacy.Sensitivity(datasets.chain4(spark, sf_dir))
    n = s.exact(0b1110, 0)  # orders, customers and nations; the edge to the line items is the boundary
    return spark.createDataFrame([(n,)], "max_boundary long")


@query("SELECT CAST(GREATEST(o.n * c.n * n.n, l.n * c.n * n.n, l.n * o.n * n.n, l.n * o.n * c.n) AS VARCHAR) AS bound FROM (SELECT COUNT(*)::HUGEINT AS n FROM lineitem) l, (SELECT COUNT(*)::HUGEINT AS n FROM orders) o, (SELECT COUNT(*)::HUGEINT AS n FROM customer) c, (SELECT COUNT(*)::HUGEINT AS n FROM nation) n")
def global_sensitivity(spark, sf_dir):
    rows = privacy.Sensitivity(datasets.chain4(spark, sf_dir)).rows()
    return spark.createDataFrame([(str(privacy.global_sensitivity(rows)),)], "bound string")


@query(f"SELECT GREATEST(COUNT(*), 100000) AS protected{_STAR_FROM}")
def protected_size_tau(spark, sf_dir):
    return spark.createDataFrame([(padding.sizes(datasets.star3(spark, sf_dir), tau=100_000).protected,)], "protected long")


@query("""WITH f AS (SELECT 2 * EXP(2.0) / 8.0 * (1 + LN(1 + (2 * EXP(8.0) - 2 * EXP(4.0)) / 1e-9)) AS f)
SELECT COUNT(*) + CAST(CEIL((SELECT f FROM f) * 17) AS BIGINT) AS protected FROM lineitem, orders WHERE l_orderkey = o_orderkey""")
def protected_size_formula(spark, sf_dir):
    t = datasets.chain4(spark, sf_dir)
    exact = counting.size(datasets._tree(list(zip(t.names[:2], t.relations[:2], strict=True)), [(0, 1, "l_orderkey", "o_orderkey")]))
    return spark.createDataFrame([(privacy.protected_size(exact, 17, 8.0, 1e-9),)], "protected long")


def _residual_sql(eps: float, delta: float) -> str:
    """Three relations in a chain, by the definition: degrees, counts and every pair of distances."""
    beta = privacy.smoothing(eps, delta)
    k = int(2 / beta) + 3
    most = lambda frm, by: f"(SELECT MAX(n) FROM (SELECT COUNT(*) AS n FROM {frm} GROUP BY {by}) t)"
    d = {"l1": most("lineitem", "l_orderkey"), "o1": most("orders", "o_orderkey"), "o2": most("orders", "o_custkey"), "o12": most("orders", "o_orderkey, o_custkey"), "c2": most("customer", "c_custkey")}
    lo, oc = most("lineitem, orders WHERE l_orderkey = o_orderkey", "o_custkey"), most("orders, customer WHERE o_custkey = c_custkey", "o_orderkey")
    d |= {"lo": lo, "oc": oc}
    cols = ", ".join(f"{v} AS {c}" for c, v in d.items())
    rs = lambda b01, b12: f"(SELECT CAST(CEIL(MAX(EXP(-{beta!r} * (s + t)) * GREATEST({b12} + o12 * t + c2 * s + s * t, l1 * c2 + l1 * t + c2 * s + s * t, {b01} + l1 * s + o12 * t + s * t))) AS BIGINT) FROM two)".replace("o12 * t + c2 * s", "o12 * s + c2 * t")
    return f"""WITH d AS (SELECT {cols}, (SELECT COUNT(*) FROM lineitem) AS nl, (SELECT COUNT(*) FROM orders) AS no, (SELECT COUNT(*) FROM customer) AS nc),
two AS (SELECT d.*, CAST(a.range AS DOUBLE) AS s, CAST(b.range AS DOUBLE) AS t FROM d, RANGE({k + 1}) a, RANGE({k + 1}) b WHERE a.range + b.range <= {k}),
r AS (SELECT {rs("l1 * o2", "o1 * c2")} AS by_estimates, {rs("LEAST(lo, l1 * o2)", "LEAST(oc, o1 * c2)")} AS by_exact, GREATEST(no * nc, nl * nc, nl * no) AS global_bound FROM d)
SELECT by_estimates, by_exact, by_exact AS by_relaxation, global_bound, LEAST(by_estimates, by_exact, global_bound) AS sensitivity,
(SELECT COUNT(*) FROM lineitem, orders, customer WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey) + CAST(CEIL({privacy.noise_factor(eps, delta)!r} * LEAST(by_estimates, by_exact, global_bound)) AS BIGINT) AS protected FROM r"""


def _protected(eps: float):
    def run(spark, sf_dir):
        t = datasets.chain4(spark, sf_dir)
        tree = datasets._tree(list(zip(t.names[:3], t.relations[:3], strict=True)), [(0, 1, "l_orderkey", "o_orderkey"), (1, 2, "o_custkey", "c_custkey")])
        s = padding.sizes(tree, epsilon=eps)
        b = s.breakdown
        return spark.createDataFrame([(b.by_estimates, b.by_exact, b.by_relaxation, b.global_bound, b.sensitivity, s.protected)], "by_estimates long, by_exact long, by_relaxation long, global_bound long, sensitivity long, protected long")

    run.__name__ = f"protected_size_chain3_eps{eps:g}"
    query(_residual_sql(eps, 1e-9))(run)


_protected(1.0)
_protected(8.0)


@query("""SELECT 'lineitem' AS relation, 0 AS edges, COUNT(*) AS max_frequency FROM lineitem UNION ALL SELECT 'lineitem', 1, MAX(n) FROM (SELECT COUNT(*) AS n FROM lineitem GROUP BY l_orderkey) t
UNION ALL SELECT 'orders', 0, COUNT(*) FROM orders UNION ALL SELECT 'orders', 1, MAX(n) FROM (SELECT COUNT(*) AS n FROM orders GROUP BY o_orderkey) t""")
def degree_table(spark, sf_dir):
    t = datasets.chain4(spark, sf_dir)
    two = datasets._tree(list(zip(t.names[:2], t.relations[:2], strict=True)), [(0, 1, "l_orderkey", "o_orderkey")])
    return privacy.degree_table(two).select("relation", F.signum("subset").cast("int").alias("edges"), "max_frequency")


@query()
def protected_size_eps(spark, sf_dir):
    s = padding.sizes(datasets.chain4(spark, sf_dir), epsilon=8.0)
    return spark.createDataFrame([(s.exact, s.protected, s.breakdown.sensitivity)], "exact long, protected long, sensitivity long")


@query(f"SELECT is_dummy, COUNT(*) AS n FROM (SELECT FALSE AS is_dummy{_SAMPLE_FROM} UNION ALL SELECT TRUE FROM RANGE(30)) t GROUP BY is_dummy".replace("SELECT is_dummy", _SAMPLE + "SELECT is_dummy", 1))
def padded_join_flags(spark, sf_dir):
    return padding.padded_join(datasets.sample(spark), tau=50).groupBy("is_dummy").agg(F.count("*").alias("n"))


# --- suite, its encrypted twins, maintenance ---------------------------------------------------------------------------

for _name in suite.SQL:
    query(suite.SQL[_name])(suite.runner(_name))


def _twin(name: str, text: str, plain: str, tables: tuple[str, ...]):
    def run(spark, sf_dir):
        encrypted.register(spark)
        for t in tables:
            _t(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(text)

    run.__name__ = name
    query(plain)(run)


_twin("enc_h6", suite.SQL["h6"].replace("l_quantity < 24", "l_quantity < enc_float4_encrypt('24')").replace("DATE '1997-01-01'", "enc_timestamp_encrypt('1997-01-01')").replace("DATE '1998-01-01'", "enc_timestamp_encrypt('1998-01-01')"), suite.SQL["h6"], ("lineitem",))
_twin("enc_h14", suite.SQL["h14"].replace("'PROMO%'", "enc_text_encrypt('PROMO%')").replace("DATE '1997-09-01'", "enc_timestamp_encrypt('1997-09-01')"), suite.SQL["h14"], ("lineitem", "part"))
_twin("enc_h12", encrypted.rewrite_literals(suite.SQL["h12"].replace("'1-URGENT'", "enc_text_encrypt('1-URGENT')")), suite.SQL["h12"], ("orders", "lineitem"))


@query("SELECT c_custkey, COUNT(*) AS n FROM customer, orders WHERE c_custkey = o_custkey GROUP BY c_custkey")
def enc_cipher_join(spark, sf_dir):
    key = "0123456789abcdef"
    c = _t(spark, sf_dir, "customer").select(encrypted.encrypt(F.col("c_custkey"), key).alias("a"))
    o = _t(spark, sf_dir, "orders").select(encrypted.encrypt(F.col("o_custkey"), key).alias("b"))
    return c.join(o, F.col("a") == F.col("b")).groupBy("a").agg(F.count("*").alias("n")).select(encrypted.decrypt(F.col("a"), key, "bigint").alias("c_custkey"), "n")


@query("SELECT c_custkey, c_acctbal AS balance, c_mktsegment AS segment FROM customer WHERE c_mktsegment = 'BUILDING'")
def enc_decrypt(spark, sf_dir):
    encrypted.register(spark)
    _t(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    return spark.sql("SELECT c_custkey, enc_float4_decrypt(enc_float4_encrypt(CAST(c_acctbal AS STRING))) AS balance, enc_text_decrypt(c_mktsegment) AS segment FROM customer WHERE enable_client_mode() AND c_mktsegment = enc_text_encrypt('BUILDING')")


@query("SELECT COUNT(*) AS n, TRUE AS within FROM orders")
def enc_perturbed(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", encrypted.perturbed(F.col("o_orderkey"), 50).alias("moved"))
    return o.agg(F.count("*").alias("n"), F.min((F.col("moved") - F.col("o_orderkey")).between(1, 50)).alias("within"))


@query('SELECT n_regionkey AS "region key", COUNT(*) AS "number of nations" FROM nation GROUP BY n_regionkey')
def quoted_identifiers(spark, sf_dir):
    _t(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    return suite.quoted(spark, 'SELECT n_regionkey AS "region key", COUNT(*) AS "number of nations" FROM nation GROUP BY n_regionkey')


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment FROM customer UNION ALL SELECT -1, 'NEW'")
def scd_type1(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    new = spark.createDataFrame([(-1, "NEW")], "c_custkey long, c_mktsegment string")
    return maintenance.update_in_place(c, c.where("c_custkey % 10 = 0").select("c_custkey", F.lit("MOVED").alias("c_mktsegment")).union(new), "c_custkey", ["c_mktsegment"])


@query("""SELECT c_custkey, c_mktsegment, 0 AS since, CASE WHEN c_custkey % 10 = 0 THEN 5 END AS until FROM customer UNION ALL SELECT c_custkey, 'MOVED', 5, NULL FROM customer WHERE c_custkey % 10 = 0""")
def scd_type2(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.lit(0).alias("since"), F.lit(None).cast("int").alias("until"))
    return maintenance.close_and_insert(c, c.where("c_custkey % 10 = 0").select("c_custkey", F.lit("MOVED").alias("c_mktsegment")), "c_custkey", "since", "until", F.lit(5))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 11 <> 0 UNION ALL SELECT o_orderkey + 10000000 FROM orders WHERE o_orderkey % 11 = 1")
def refresh(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey")
    kept = maintenance.delete(o, o.where("o_orderkey % 11 = 0"), "o_orderkey")
    return maintenance.insert(kept, o.where("o_orderkey % 11 = 1").select((F.col("o_orderkey") + 10_000_000).alias("o_orderkey")))


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def orphans(spark, sf_dir):
    return maintenance.orphans(_t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer").where("c_custkey % 2 = 0"), "o_custkey", "c_custkey").select("o_orderkey")


@query("SELECT l_partkey, l_suppkey, ROW_NUMBER() OVER (ORDER BY l_partkey, l_suppkey) AS pair_id FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) t")
def pair_ids(spark, sf_dir):
    from treeline.sources.text import pair_ids as number

    return number(_t(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")
