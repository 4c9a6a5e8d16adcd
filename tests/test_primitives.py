"""Building blocks with 0 and NULL keys, repeated rows, weights of 0 and 1, empty sides; files, functions, command line."""

import math

import pytest
from pyspark.sql import functions as F

from treeline import cli, profile
from treeline.functions import encrypted, maintenance
from treeline.operators import access
from treeline.operators import primitives as prim
from treeline.sources import datasets, text


@pytest.fixture(scope="module")
def r(spark):
    return spark.createDataFrame([(0, 1, 0), (0, 1, 0), (None, 2, 1), (3, 3, 2), (4, 4, 3)], "k long, id long, w long")


@pytest.fixture(scope="module")
def s(spark):
    return spark.createDataFrame([(0, 5), (0, 7), (None, 1), (3, None)], "k2 long, v long")


def test_semi_joins(r, s):
    assert sorted(x[1] for x in prim.semi_join(r, s, "k", "k2").collect()) == [1, 1, 3]
    counted = prim.count_semi_join(r, s, "k", "k2", "v").select("id", "n").collect()
    assert sorted(map(tuple, counted)) == [(1, 12), (1, 12), (2, 0), (3, 0), (4, 0)]
    assert prim.count_semi_join(r, s.limit(0), "k", "k2").agg(F.sum("n")).first()[0] == 0


def test_expansion(r):
    out = sorted((x["id"], x["copy"]) for x in prim.expand_by_weight(r, "w").collect())
    assert out == [(2, 0), (3, 0), (3, 1), (4, 0), (4, 1), (4, 2)]
    assert prim.expand_to(r, "w", 12).where("is_dummy").count() == 12 - (1 + 1 + 1 + 2 + 3)
    assert prim.expand_to(r, "w", 3).count() == 8
    marked = r.withColumn("m", (F.col("id") > 2).cast("int"))
    assert prim.compact(marked, "m").count() == 2
    assert prim.compact_to(marked, "m", ["id"], 4).where("is_dummy").count() == 2
    assert prim.pad_to(r.limit(0), 3).count() == 3


def test_scans(spark):
    t = spark.createDataFrame([(1, 1, 2, None), (1, 2, 3, 7), (1, 3, 4, None), (2, 1, 5, None)], "g long, o long, v long, h long")
    cols = [
        prim.seg_prefix("v", "g", ["o"], False).alias("pe"), prim.seg_prefix("v", "g", ["o"]).alias("pi"), prim.seg_suffix("v", "g", ["o"]).alias("si"), prim.seg_suffix("v", "g", ["o"], False).alias("se"),
        prim.seg_total("v", "g").alias("t"), F.col("x"), prim.fill_forward("h", "g", ["o"]).alias("f"),
    ]
    got = [tuple(int(y) if y is not None else None for y in x) for x in prim.with_suffix_product(t, "v", "g", ["o"], "x").select("g", "o", *cols).orderBy("g", "o").collect()]
    assert got == [(1, 1, 0, 2, 9, 7, 9, 24, None), (1, 2, 2, 5, 7, 4, 9, 12, 7), (1, 3, 5, 9, 4, 0, 9, 4, 7), (2, 1, 0, 5, 5, 0, 5, 5, None)]
    total = access.running_total(t, "v", ["g", "o"], "before").orderBy("g", "o").collect()
    assert [int(x["before"]) for x in total] == [0, 2, 5, 9]


def test_suffix_products_are_exact(spark):
    values = [3, -1, 0, 5, -2, 1, -1, 7, *[1] * 40, *[2] * 100]
    t = spark.createDataFrame(list(enumerate(values)), "o long, v long").withColumn("g", F.lit(1))
    got = [int(x["x"]) for x in prim.with_suffix_product(t, "v", "g", ["o"], "x").orderBy("o").collect()]
    assert got == [math.prod(values[k:]) for k in range(len(values))]
    with pytest.raises(Exception, match="OVERFLOW|cannot be represented"):
        prim.with_suffix_product(spark.range(200).selectExpr("id", "2L AS v", "1 AS g"), "v", "g", ["id"], "x").collect()


def test_frequencies(r):
    assert prim.max_frequency(r, ["k"]).first()[0] == 2 and prim.max_frequency(r, []).first()[0] == 5 and prim.max_frequency(r.limit(0), ["k"]).first()[0] == 0
    assert dict(map(tuple, prim.subset_frequencies(r, ["k", "id"]).collect())) == {0: 5, 1: 2, 2: 2, 3: 2}
    assert sorted(map(tuple, prim.group_dimensions(r, r, "k", "k").where("tid = 1").collect()), key=str)[0][2:] == (2, 2)


def test_white_space_and_arity(spark, tmp_path):
    (tmp_path / "a.tbl").write_text("1  2\t3\n\n  4 5   6 \n\t\n-7 8 9\n")
    t = text.read_ints(spark, str(tmp_path / "a.tbl"), ["a", "b", "c"])
    assert sorted(map(tuple, t.collect())) == [(-7, 8, 9), (1, 2, 3), (4, 5, 6)]
    (tmp_path / "b.tbl").write_text("1 2 3\n4 5\n6 7 8 9\n")
    wrong = text.read_ints(spark, str(tmp_path / "b.tbl"), ["a", "b", "c"], check=False)
    for use in (lambda: wrong.count(), lambda: wrong.select("a").collect(), lambda: wrong.collect()):
        with pytest.raises(Exception, match="is not 3 integers"):
            use()


def test_files(spark, tmp_path, r):
    text.write_ints(r.select("id", "w"), str(tmp_path / "a.tbl"))
    back = text.read_ints(spark, str(tmp_path / "a.tbl"), ["id", "w"])
    assert sorted(map(tuple, back.collect())) == [(1, 0), (1, 0), (2, 1), (3, 2), (4, 3)]
    with pytest.raises(Exception):  # noqa: B017
        text.read_ints(spark, str(tmp_path / "a.tbl"), ["id"]).collect()
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "x").write_text("")
    with pytest.raises(text.SchemaError):
        text.read_ints(spark, str(tmp_path / "empty"), ["a"])
    text.write_pipes(r, str(tmp_path / "p"))
    assert text.read_pipes(spark, str(tmp_path / "p"), "k long, id long, w long").exceptAll(r).isEmpty()
    assert text.read_expected(spark, str(tmp_path / "none")) == -1
    (tmp_path / "expected.txt").write_text("20\n")
    assert datasets.expected_rows(spark, str(tmp_path)) == 20
    with pytest.raises(OverflowError):
        text.collect_capped(r, 6)
    assert text.show(r, 2).endswith("... (3 more rows)") and text.dimensions(r) == (5, 3)
    assert text.clean_sample(r, 2).count() == 2
    assert sorted(map(tuple, text.pair_ids(r.na.drop(), "k", "id").collect())) == [(0, 1, 1), (3, 3, 2), (4, 4, 3)]


def test_shapes(spark, tmp_path):
    for n, (f, cells) in enumerate(datasets.SHAPES["q85_chain3"].files):
        text.write_ints(spark.createDataFrame([tuple(range(cells)), tuple([0] * cells)], ", ".join(f"c{k} long" for k in range(cells))), str(tmp_path / f"R{n + 1}_{f}.tbl"))
    tree = datasets.load_shape(spark, "q85_chain3", str(tmp_path))
    assert [r["strategy"] for r in profile.compare(tree, ("native", "reduce_join"))] == ["native", "reduce_join"]
    for name, shape in datasets.SHAPES.items():
        frames = [spark.range(1).select(*(F.col("id").alias(f"c{k}") for k in range(n))) for _, n in shape.files]
        assert len(datasets.JoinTree.from_parents(frames, shape.parent, shape.in_parent, shape.in_child, left=shape.left).top_down()) == len(frames), name
    assert len(datasets.full_ternary(spark, 5, 3).relations) == 13


def test_encrypted(spark, r):
    encrypted.register(spark)
    r.createOrReplaceTempView("r_enc")
    q = spark.sql("SELECT * FROM r_enc WHERE id < enc_int4_encrypt('3') AND enc_int4_decrypt(1) = 1")
    assert q.count() == 3 and "enc_int4" not in q._jdf.queryExecution().optimizedPlan().toString()
    assert encrypted.rewrite_literals("x < enc_int4_encrypt('3')") == "x < CAST('3' AS INT)"
    key = "k" * 16
    pairs = r.select("id", encrypted.encrypt(F.col("id"), key).alias("c")).distinct()
    assert pairs.count() == 4 and pairs.where(encrypted.decrypt(F.col("c"), key, "long") != F.col("id")).count() == 0


def test_maintenance(spark, r):
    new = maintenance.update_in_place(r.where("k > 0"), spark.createDataFrame([(3, 33), (9, 99)], "k long, id long"), "k", ["id"])
    assert {x["k"]: x["id"] for x in new.collect()} == {3: 33, 4: 4, 9: 99}
    assert maintenance.template("a = [YEAR]", year=2000) == "a = 2000"
    with pytest.raises(ValueError):
        maintenance.template("a = [YEAR]")
    assert maintenance.without_duplicates(r, ["k", "id"]).count() == 4


def test_command_line(spark, capsys):
    assert cli.main(["sample", "--count"]) == 0 and capsys.readouterr().out.split()[-1] == "20"
    assert cli.main(["sample", "--threshold", "19"]) == 2
    assert cli.main(["sample", "--stats", "--tau", "30"]) == 0 and '"padding": 10' in capsys.readouterr().out
    assert cli.main(["sample", "--all"]) == 0 and capsys.readouterr().out.count('"rows": 20') == 4
    assert cli.main(["sample", "--print-limit", "1"]) == 0 and "19 more rows" in capsys.readouterr().out
    for bad in (["q18"], ["sample", "x"], ["sample", "--rows", "0"], ["sample", "--seed", "x"], ["sample", "--all", "--strategy", "reduce_join"]):
        with pytest.raises(SystemExit):
            cli.checked(cli.parser().parse_args(bad))
