"""Registered relational queries and their SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators.dml import View, delete, insert, update
from .operators.predicates import Const, Field, Predicate, where
from .operators.relational import aggregate, group, order, product, products, project, select
from .plans.statistics import table_stats
from .sources.catalog import Catalog, fields, read

Query = Callable[[SparkSession, str], DataFrame]
ASIA = where(("@n_regionkey", "=", "@r_regionkey"), ("@r_name", "=", "ASIA"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(select(product(read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")), ASIA), ["n_name", "r_name"])


def _on(table: str, predicate: Predicate | None, *names: str) -> Query:
    """Fields of the rows of a table that meet a predicate."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = select(read(spark, sf_dir, table), predicate)
        return project(found, list(names)) if names else found

    return query


def _changed(table: str, change: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: change(read(spark, sf_dir, table))


def _joined(tables: list[str], predicate: Predicate | None, *names: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = select(products([read(spark, sf_dir, t) for t in tables]), predicate)
        return project(made, list(names)) if names else made

    return query


def _by_segment(fn: str, field: str, name: str) -> Query:
    return lambda spark, sf_dir: group(read(spark, sf_dir, "customer"), ["c_mktsegment"], [aggregate(fn, field, name)])


def _toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = read(spark, sf_dir, "labels").withColumn("is_toxic", F.col("toxic") == 1)
    return project(select(marked, where(("@is_toxic", "=", True))), ["doc_id", "is_toxic"])


def _field_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").withColumn("units", F.col("l_quantity").cast("int"))
    return project(select(lines, where(("@l_linenumber", "=", "@units"))), ["l_orderkey"])


def _empty_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product(select(read(spark, sf_dir, "region"), where((1, "=", 2))), read(spark, sf_dir, "nation"))


def _left_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation")
    return product(nation, nation)


def _mixed_with_nulls(op: str) -> Query:
    """A string, null for one segment, against a number."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        some = read(spark, sf_dir, "customer").withColumn("segment", F.nullif("c_mktsegment", F.lit("BUILDING")))
        return project(select(some, where(("@segment", op, 5))), ["c_custkey"])

    return query


def _through(tables: list[str], change: Callable[[View], tuple[DataFrame, ...]], at: int, predicate: Predicate, *names: str) -> Query:
    """The table at place ``at`` after a write through a view of ``tables``."""
    return lambda spark, sf_dir: change(View(tuple(read(spark, sf_dir, t) for t in tables), predicate, names or None))[at]


def _narrow_types(df: DataFrame) -> DataFrame:
    """Catalog numbers as in their definition: they fit an int in the oracle's literals."""
    return df.select(*[F.col(f.name).cast("int") if isinstance(f.dataType, T.LongType) else F.col(f.name) for f in df.schema.fields])


def _catalog(spark: SparkSession) -> Catalog:
    made = Catalog(spark)
    made.create("people", fields("id int", "name varchar(20)", "active bool", "born date"))
    return made


QUERIES: dict[str, Query] = {
    "table_scan": _on("region", None),
    "project": _on("nation", None, "n_name", "n_regionkey"),
    "select_eq": _on("nation", where(("@n_regionkey", "=", 2)), "n_name"),
    "select_ne": _on("nation", where(("@n_regionkey", "<>", 2)), "n_name"),
    "select_lt": _on("nation", where(("@n_regionkey", "<", 2)), "n_name"),
    "select_le": _on("nation", where(("@n_regionkey", "<=", 2)), "n_name"),
    "select_gt": _on("nation", where(("@n_regionkey", ">", 2)), "n_name"),
    "select_ge": _on("nation", where(("@n_regionkey", ">=", 2)), "n_name"),
    "select_string_lt": _on("customer", where(("@c_mktsegment", "<", "C")), "c_custkey"),
    "select_date_ge": _on("orders", where(("@o_orderdate", ">=", dt.datetime(1997, 1, 1))), "o_orderkey"),
    "select_date_eq": _on("orders", where(("@o_orderdate", "=", dt.datetime(1997, 1, 15))), "o_orderkey"),
    "select_bool": _toxic,
    "select_const_lhs": _on("nation", where((2, "<", "@n_regionkey")), "n_name"),
    "select_field_field": _field_field,
    "select_false": _on("nation", where((1, "=", 2))),
    "select_conjunction": _on("customer", where(("@c_nationkey", ">=", 5), ("@c_nationkey", "<", 10), ("@c_mktsegment", "=", "BUILDING")), "c_custkey"),
    "mismatch_eq": _on("customer", where(("@c_name", "=", 5)), "c_custkey"),
    "mismatch_ne": _on("customer", where(("@c_name", "<>", 5)), "c_custkey"),
    "product": _joined(["region", "nation"], None),
    "product_empty_left": _empty_left,
    "product_left_wins": _left_wins,
    "equi_join": _joined(["region", "nation"], where(("@r_regionkey", "=", "@n_regionkey")), "r_name", "n_name"),
    "theta_join": _joined(["region", "nation"], where(("@r_regionkey", "<", "@n_regionkey")), "r_name", "n_name"),
    "multi_join": _joined(
        ["customer", "orders", "nation"],
        where(("@c_custkey", "=", "@o_custkey"), ("@c_nationkey", "=", "@n_nationkey"), ("@o_orderstatus", "=", "F")),
        "c_name", "n_name", "o_orderkey",
    ),
    "asia": flagship,
    "insert_row": _changed("region", lambda df: insert(df, ["r_regionkey"], [99])),
    "update_const": _changed("nation", lambda df: update(df, "n_name", Const("X"), where(("@n_regionkey", "=", 2)))),
    "update_field": _changed("nation", lambda df: update(df, "n_regionkey", Field("n_nationkey"), where(("@n_regionkey", "=", 2)))),
    "update_all": _changed("nation", lambda df: update(df, "n_name", Const("X"))),
    "delete_where": _changed("nation", lambda df: delete(df, where(("@n_regionkey", "=", 2)))),
    "delete_all": _changed("nation", delete),
    "mismatch_ne_null": _mixed_with_nulls("<>"),
    "mismatch_eq_null": _mixed_with_nulls("="),
    "update_through_product": _through(["nation", "region"], lambda v: v.update("n_name", Const("X")), 0, ASIA),
    "update_through_product_right": _through(["nation", "region"], lambda v: v.update("r_name", Const("X")), 1, where(("@n_regionkey", "=", "@r_regionkey"), ("@n_name", "=", "JAPAN"))),
    "update_through_project": _through(["nation"], lambda v: v.update("n_name", Const("X")), 0, where(("@n_regionkey", "=", 2)), "n_nationkey", "n_name"),
    "insert_through_project": _through(["nation"], lambda v: v.insert(["n_name"], ["X"]), 0, where(("@n_regionkey", "=", 2)), "n_nationkey", "n_name"),
    "delete_through_select": _through(["nation"], View.delete, 0, where(("@n_regionkey", "=", 2)), "n_name"),
    "create_table": lambda spark, _: Catalog(spark).create("people", fields("id int", "name varchar(20)", "active bool", "born date")),
    "table_catalog": lambda spark, _: _narrow_types(_catalog(spark).table_catalog()),
    "field_catalog": lambda spark, _: _narrow_types(_catalog(spark).field_catalog()),
    "table_stats": lambda spark, sf_dir: table_stats(read(spark, sf_dir, "orders")),
    "group_keys": lambda spark, sf_dir: group(read(spark, sf_dir, "customer"), ["c_mktsegment"]),
    "agg_count": _by_segment("count", "*", "cnt"),
    "agg_sum": _by_segment("sum", "c_nationkey", "total"),
    "agg_avg": _by_segment("avg", "c_nationkey", "mean"),
    "agg_min": _by_segment("min", "c_nationkey", "low"),
    "agg_max": _by_segment("max", "c_nationkey", "high"),
    "having": lambda spark, sf_dir: group(read(spark, sf_dir, "customer"), ["c_nationkey"], [aggregate("count", "*", "cnt")], where(("@cnt", ">", 60))),
    "order_by": lambda spark, sf_dir: project(order(read(spark, sf_dir, "customer"), [("c_nationkey", True), ("c_custkey", False)]), ["c_custkey"]),
}

ORACLE_SQL: dict[str, str] = {
    "table_scan": "select * from region",
    "project": "select n_name, n_regionkey from nation",
    **{f"select_{k}": f"select n_name from nation where n_regionkey {op} 2" for k, op in (("eq", "="), ("ne", "<>"), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">="))},
    "select_string_lt": "select c_custkey from customer where c_mktsegment < 'C'",
    "select_date_ge": "select o_orderkey from orders where o_orderdate >= timestamp '1997-01-01'",
    "select_date_eq": "select o_orderkey from orders where o_orderdate = timestamp '1997-01-15'",
    "select_bool": "select doc_id, (toxic = 1) as is_toxic from labels where (toxic = 1) = true",
    "select_const_lhs": "select n_name from nation where 2 < n_regionkey",
    "select_field_field": "select l_orderkey from lineitem where l_linenumber = cast(trunc(l_quantity) as int)",
    "select_false": "select * from nation where 1 = 2",
    "select_conjunction": "select c_custkey from customer where c_nationkey >= 5 and c_nationkey < 10 and c_mktsegment = 'BUILDING'",
    "mismatch_eq": "select c_custkey from customer where false",
    "mismatch_ne": "select c_custkey from customer where true",
    "product": "select * from region, nation",
    "product_empty_left": "select * from (select * from region where false), nation",
    "product_left_wins": "select a.* from nation a, nation b",
    "equi_join": "select r_name, n_name from region, nation where r_regionkey = n_regionkey",
    "theta_join": "select r_name, n_name from region, nation where r_regionkey < n_regionkey",
    "multi_join": "select c_name, n_name, o_orderkey from customer, orders, nation where c_custkey = o_custkey and c_nationkey = n_nationkey and o_orderstatus = 'F'",
    "asia": "select n_name, r_name from nation, region where n_regionkey = r_regionkey and r_name = 'ASIA'",
    "insert_row": "select * from region union all select 99::int, ''",
    "update_const": "select n_nationkey, case when n_regionkey = 2 then 'X' else n_name end as n_name, n_regionkey from nation",
    "update_field": "select n_nationkey, n_name, case when n_regionkey = 2 then n_nationkey else n_regionkey end as n_regionkey from nation",
    "update_all": "select n_nationkey, 'X' as n_name, n_regionkey from nation",
    "delete_where": "select * from nation where not (n_regionkey = 2)",
    "delete_all": "select * from nation where false",
    "mismatch_ne_null": "select c_custkey from customer where c_mktsegment <> 'BUILDING'",
    "mismatch_eq_null": "select c_custkey from customer where false",
    "update_through_product": """select n_nationkey, n_regionkey, case when exists (select 1 from region where r_regionkey = n_regionkey and r_name = 'ASIA')
      then 'X' else n_name end as n_name from nation""",
    "update_through_product_right": """select r_regionkey, case when exists (select 1 from nation where r_regionkey = n_regionkey and n_name = 'JAPAN')
      then 'X' else r_name end as r_name from region""",
    "update_through_project": "select n_nationkey, case when n_regionkey = 2 then 'X' else n_name end as n_name, n_regionkey from nation",
    "insert_through_project": "select * from nation union all select 0::int, 'X', 0::int",
    "delete_through_select": "select * from nation where n_regionkey <> 2",
    "create_table": "select * from (select 1::bigint as id, '' as name, true as active, timestamp '2024-01-01' as born) where false",
    "table_catalog": "select * from (values ('table_catalog', 88::int), ('field_catalog', 176), ('people', 113)) t(tablename, slotsize)",
    "field_catalog": """select * from (values ('table_catalog', 'tablename', 8::int, 12::int, 16::int), ('table_catalog', 'slotsize', 80, 4, 0),
      ('field_catalog', 'tablename', 8, 12, 16), ('field_catalog', 'fieldname', 80, 12, 16), ('field_catalog', 'offset', 152, 4, 0),
      ('field_catalog', 'type', 160, 4, 0), ('field_catalog', 'length', 168, 4, 0), ('people', 'id', 8, 4, 0), ('people', 'name', 16, 12, 20),
      ('people', 'active', 104, 16, 0), ('people', 'born', 105, 91, 0)) t(tablename, fieldname, "offset", "type", "length")""",
    "table_stats": "select count(*) as nrec, 1 + count(*) // 3 as dv from orders",
    "group_keys": "select c_mktsegment from customer group by c_mktsegment",
    "agg_count": "select c_mktsegment, count(*) as cnt from customer group by 1",
    "agg_sum": "select c_mktsegment, sum(c_nationkey)::bigint as total from customer group by 1",
    "agg_avg": "select c_mktsegment, avg(c_nationkey) as mean from customer group by 1",
    "agg_min": "select c_mktsegment, min(c_nationkey) as low from customer group by 1",
    "agg_max": "select c_mktsegment, max(c_nationkey) as high from customer group by 1",
    "having": "select c_nationkey, count(*) as cnt from customer group by 1 having count(*) > 60",
    "order_by": "select c_custkey from customer order by c_nationkey desc, c_custkey",
}
