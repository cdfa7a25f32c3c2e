"""The facts derived from lines and orders: odd rows against SQL, and what their derivation moves."""

import os
import re

import duckdb
import pytest
from compare import assert_same

from tallyforge.plans import catalog
from tallyforge.sources import corpus_tables as src

SF = "/root/testdata/sf0.001"


def test_facts_of_odd_lines_equal_their_sql(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"""create table orders as select o_orderkey, case when o_orderkey % 11 = 0 then null else o_orderdate end as o_orderdate from '{SF}/orders.parquet'""")
    con.execute(f"""create table lineitem as select l_orderkey, l_suppkey, case when l_orderkey % 3 = 0 and l_linenumber > 1 then null else l_partkey % 5 end as l_partkey, l_extendedprice, case when l_orderkey % 13 = 0 then null else l_discount end as l_discount,
      case when l_orderkey % 7 = 0 then null else l_returnflag end as l_returnflag, case when l_orderkey % 17 = 0 then null else l_linestatus end as l_linestatus from '{SF}/lineitem.parquet'""")
    for name in ("orders", "lineitem"):
        con.execute(f"copy {name} to '{tmp_path}/{name}.parquet' (format parquet)")
    assert_same(src.facts(spark, str(tmp_path)), con, f"with {src.FACTS_SQL.strip()} select * from facts")
    assert_same(src.faulty_facts(spark, str(tmp_path)), con, f"with {src.FAULTY_SQL.strip()} select * from faulty")


def test_lines_move_once_to_the_join_and_once_to_their_supplier(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.QUERIES["parse_value"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange ") == 3 and plan.count("lineitem.parquet") == 1, os.linesep + plan


@pytest.mark.parametrize(("name", "moves"), [("fact_conflicts", 3), ("trace_source", 4), ("growth", 3), ("compound_growth", 3), ("quarter_rollup", 3), ("ratios", 3), ("pivot_facts", 3), ("sensitivity_grid", 3), ("project", 3), ("multiple_value", 3)])
def test_facts_stay_where_their_document_was_made(spark, name, moves):
    """Orders and lines move to the join and lines to their document; facts do not move again (of trace_source, suppliers do)."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange ") == moves and plan.count("lineitem.parquet") == 1, os.linesep + plan


def test_fact_files_are_written_compressed(spark):
    files = catalog.QUERIES["fact_scan"](spark, SF).inputFiles()
    files += spark.read.text(catalog._fact_files(spark, src.faulty_facts(spark, SF))).inputFiles()
    assert len(files) > 1 and all(f.endswith(".gz") for f in files), files[:3]


@pytest.mark.parametrize(("name", "columns"), [("unpivot_statement", "document name period amount"), ("entity_report", "document name period amount unit year quarter grain")])
def test_facts_used_several_times_are_stored_without_what_is_not_asked_for(spark, name, columns):
    files = catalog.QUERIES[name](spark, SF).inputFiles()
    assert spark.read.parquet(*files).columns == columns.split()


def moved(spark, sf_dir, name):
    """Columns of what moves to its document and to the join, without the numbers of expressions."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = spark._jvm.PythonSQLUtils.explainString(catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    found = re.findall(r"Exchange\nInput \[\d+\]: \[(.*?)\]\nArguments: hashpartitioning\((\w+)#", plan)
    return {key: re.sub(r"#\d+L?", "", columns) for columns, key in found}


@pytest.mark.parametrize("name", ["parse_value", "fact_quarantine"])
def test_year_and_quarter_move_as_one_number(spark, name):
    assert moved(spark, SF, name) == {"document": "document, yq, l_partkey, parts_of, v", "l_orderkey": "l_orderkey, e, l_partkey, parts_of, v", "o_orderkey": "o_orderkey, yq"}


@pytest.mark.parametrize("name", ["parse_period", "unit_consistency"])
def test_queries_without_values_move_no_amounts(spark, name):
    want = {"document": "document, yq", "l_orderkey": "l_orderkey, e", "o_orderkey": "o_orderkey, yq"}
    assert moved(spark, SF, name).items() >= want.items()


@pytest.mark.parametrize("name", ["parse_value", "parse_period", "fact_quarantine", "unit_consistency"])
def test_odd_lines_read_for_some_columns_only_equal_their_sql(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute(f"""create table orders as select o_orderkey, case when o_orderkey % 11 = 0 then null else o_orderdate end as o_orderdate from '{SF}/orders.parquet'""")
    con.execute(f"""create table lineitem as select l_orderkey, l_suppkey + 10 * (l_orderkey % 90) as l_suppkey, l_partkey, l_extendedprice, case when l_orderkey % 13 = 0 then null else l_discount end as l_discount,
      case when l_orderkey % 7 = 0 then null else l_returnflag end as l_returnflag, case when l_orderkey % 17 = 0 then null else l_linestatus end as l_linestatus from '{SF}/lineitem.parquet'""")
    for table in ("orders", "lineitem"):
        con.execute(f"copy {table} to '{tmp_path}/{table}.parquet' (format parquet)")
    assert_same(catalog.QUERIES[name](spark, str(tmp_path)), con, catalog.ORACLE[name])
