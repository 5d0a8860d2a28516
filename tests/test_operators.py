"""Predicates, products, rewrites, views and the catalog on small tables, with plain-Python counterparts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from lodestone.functions.comparison import operator
from lodestone.operators.dml import View, affected, delete, insert, update
from lodestone.operators.predicates import Const, Field, where
from lodestone.operators.relational import aggregate, group, order, product, project, select
from lodestone.sources.catalog import Catalog, fields, read, write

ROWS = [(i, "abc"[i % 3] * (i % 4), i % 2 == 0, dt.datetime(2024, 1, 1 + i % 5)) for i in range(-6, 12)]


@pytest.fixture(scope="module")
def types(spark):
    return spark.createDataFrame(ROWS, "i long, s string, b boolean, d timestamp_ntz")


def plain(a, op, b):
    if type(a) is not type(b):
        return op == "<>"
    if isinstance(a, bool) and op not in ("=", "<>"):
        return False
    return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def test_random_conjunctions_match_a_row_loop(types):
    rng, names = random.Random(5), ["i", "s", "b", "d"]
    values = [-5, 0, 3, "a", "bb", "", True, False, dt.datetime(2024, 1, 2)]
    for _ in range(40):
        ts = []
        for _ in range(rng.randint(1, 3)):
            side = lambda: "@" + rng.choice(names) if rng.random() < 0.6 else rng.choice(values)
            ts.append((side(), rng.choice(["=", "<>", "<", "<=", ">", ">="]), side()))
        get = lambda e, r: r[names.index(e[1:])] if isinstance(e, str) and e.startswith("@") else e  # noqa: B023, E731
        want = sorted(r[0] for r in ROWS if all(plain(get(a, r), op, get(b, r)) for a, op, b in ts))
        assert sorted(r["i"] for r in select(types, where(*ts)).collect()) == want, ts


def test_operators_and_text():
    assert operator("!=") == "<>"
    with pytest.raises(ValueError):
        operator("!")
    p = where(("@a", "=", 5), ("@b", "<>", "x"), ("@c", "=", True))
    assert str(p) == "a = 5 and b <> 'x' and c = true"


def test_conjoin():
    p = where(("@a", "=", 5), ("@a", "=", "@b"), (7, "<", "@b"))
    assert len(p.conjoin(where((1, "=", 1))).terms) == 4 and str(p.conjoin(where((1, "=", 1)))).endswith("1 = 1")


def test_unknown_fields_raise(types):
    with pytest.raises(ValueError):
        select(types, where(("@nope", "=", 1)))
    with pytest.raises((ValueError, AnalysisException)):
        project(types, ["nope"])


def test_nulls_drop_out_and_survive_rewrites(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "a long")
    p = where(("@a", "=", 1))
    assert [r["a"] for r in select(df, p).collect()] == [1]
    assert sorted(map(str, (r["a"] for r in delete(df, p).collect()))) == ["2", "None"]
    assert sorted(map(str, (r["a"] for r in update(df, "a", Const(9), p).collect()))) == ["2", "9", "None"]
    assert affected(df, p) == 1


def test_product_left_wins_and_empty_sides(spark):
    left = spark.createDataFrame([(1, 10), (2, 20)], "a long, k long")
    right = spark.createDataFrame([(7, "x"), (8, "y")], "k long, c string")
    got = product(left, right)
    assert got.columns == ["a", "k", "c"] and sorted(map(tuple, got.collect())) == [(1, 10, "x"), (1, 10, "y"), (2, 20, "x"), (2, 20, "y")]
    assert product(left.filter("false"), right).count() == 0 == product(left, right.filter("false")).count()
    assert product(left, left).count() == 4


def test_equality_over_product_is_not_a_nested_loop(spark):
    left, right = spark.range(100).toDF("a"), spark.range(100).toDF("b")
    plan = select(product(left, right), where(("@a", "=", "@b")))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    df = project(select(read(spark, "/root/testdata/sf0.001", "lineitem"), where(("@l_linenumber", ">=", 4))), ["l_orderkey"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_linenumber), GreaterThanOrEqual(l_linenumber,4)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int>" in plan


def test_bags_keep_duplicates(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "a long")
    assert sorted(r["a"] for r in update(df, "a", Const(3), where(("@a", "=", 2))).collect()) == [1, 1, 3]
    assert delete(df, where(("@a", "=", 2))).count() == 2 and delete(df).count() == 0


def test_insert_fills_defaults_and_checks(spark):
    table = Catalog(spark).create("t", fields("i int", "s varchar(3)", "b bool", "d date"))
    row = insert(table, ["i"], [-4]).first()
    assert tuple(row) == (-4, "", False, dt.datetime(1, 1, 1))
    assert insert(table, ["d"], [dt.datetime(2024, 1, 2, 3, 4, 5, 678)]).first()["d"] == dt.datetime(2024, 1, 2, 3, 4, 5)
    for names, values in ((["i", "I"], [1, 2]), (["i"], [1.5]), (["i", "s"], [1]), (["zz"], [1]), (["s"], ["long"]), (["i"], ["x"])):
        with pytest.raises((ValueError, TypeError)):
            insert(table, names, values)
    with pytest.raises(ValueError):
        update(table, "s", Const("long"))
    with pytest.raises(TypeError):
        update(table, "i", Field("s"))


def test_updates_hold_what_inserts_hold(spark):
    schema = Catalog(spark).create("t", fields("i int", "s varchar(3)", "l varchar(20)", "d date")).schema
    table = spark.createDataFrame([(1, "abc", "short", dt.datetime(2024, 1, 1)), (2, None, "eleven chars", None)], schema)
    got = update(table, "d", Const(dt.datetime(2024, 1, 2, 3, 4, 5, 678)), where(("@i", "=", 1))).orderBy("i").collect()
    assert [r["d"] for r in got] == [dt.datetime(2024, 1, 2, 3, 4, 5), None]
    with pytest.raises(ValueError):
        update(table, "i", Const(1.9))
    assert [r["i"] for r in update(table, "i", Const(4.0)).collect()] == [4, 4]
    with pytest.raises(Exception, match="3 characters"):
        update(table, "s", Field("l")).collect()
    assert [r["l"] for r in update(table, "l", Field("s")).orderBy("i").collect()] == ["abc", None]
    halves = table.withColumn("h", F.col("i") / 2)
    with pytest.raises(Exception, match="whole numbers"):
        update(halves, "i", Field("h")).collect()


def test_comparison_across_classes_with_null_is_null(spark):
    df = spark.createDataFrame([(1, "a", True), (2, None, None)], "i long, s string, b boolean")
    rows_of = lambda *t: [r["i"] for r in select(df, where(t)).collect()]
    assert rows_of("@s", "<>", 5) == [1] == rows_of(5, "<>", "@s") and rows_of("@s", "=", 5) == [] == rows_of("@b", "<", True)
    assert rows_of("@s", "<>", "@i") == [1] and sorted(r["i"] for r in delete(df, where(("@s", "<>", 5))).collect()) == [2]


def test_constants_that_look_like_fields(spark):
    df = spark.createDataFrame([("@a",), ("b",)], "a string")
    assert [r["a"] for r in select(df, where((Field("a"), "=", Const("@a")))).collect()] == ["@a"]


def test_writes_through_views(spark):
    left = spark.createDataFrame([(1, 10), (1, 10), (2, 20), (None, 30)], "a long, k long")
    right = spark.createDataFrame([(1, "x", 7), (1, "y", 8), (5, "z", 9)], "b long, c string, k long")
    view = View((left, right), where(("@a", "=", "@b")))
    changed, same = view.update("k", Const(0))
    assert sorted(map(tuple, changed.collect()), key=str) == sorted([(1, 0), (1, 0), (2, 20), (None, 30)], key=str) and same is right
    same, changed = view.update("c", Const("new"))
    assert same is left and sorted(map(tuple, changed.collect())) == [(1, "new", 7), (1, "new", 8), (5, "z", 9)]
    assert sorted(map(tuple, View((left, right)).update("b", Const(3))[1].select("b").collect())) == [(3,)] * 3
    assert View((left, right.filter("false"))).update("a", Const(3))[0].filter("a = 3").count() == 0
    for write in (lambda: view.update("c", Field("a")), lambda: view.update("b", Field("k")), lambda: view.update("none", Const(1))):
        with pytest.raises(ValueError):
            write()
    for write in (view.delete, lambda: view.insert(["a"], [1])):
        with pytest.raises(TypeError):
            write()
    one = View((left,), where(("@a", "=", 1)), ("a",))
    assert one.rows().count() == 2 and one.delete()[0].count() == 2 and one.insert(["a"], [9])[0].filter("a = 9 and k = 0").count() == 1
    for write in (lambda: one.update("k", Const(1)), lambda: one.insert(["k"], [1])):
        with pytest.raises(ValueError):
            write()
    plan = view.update("k", Const(0))[0]._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_groups_and_order(types):
    got = group(types, ["s"], [aggregate("count", "*"), aggregate("max", "i", "top")], where(("@top", ">", 5)))
    assert got.columns == ["s", "countofrows", "top"] and all(r["top"] > 5 for r in got.collect())
    assert group(types, ["b"]).count() == 2
    assert [r["i"] for r in order(types, [("b", True), ("i", False)]).limit(2).collect()] == [-6, -4]
    with pytest.raises(ValueError):
        aggregate("median", "i")


def test_catalog_definitions(spark):
    c = Catalog(spark)
    c.create("t", fields("a int", "b varchar(4)"))
    with pytest.raises(ValueError):
        c.create("T", fields("a int"))
    with pytest.raises(ValueError):
        c.schema("none")
    with pytest.raises(ValueError):
        fields("a float")
    assert c.schema("t")["b"].metadata == {"type_id": 12, "length": 4}
    assert {r["tablename"]: r["slotsize"] for r in c.table_catalog().collect()} == {"table_catalog": 88, "field_catalog": 176, "t": 40}


def test_write_and_read(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "a long, b string")
    write(df, str(tmp_path), "t")
    assert read(spark, str(tmp_path), "t").collect() == df.collect()
    with pytest.raises(AnalysisException):
        write(df, str(tmp_path), "t")
