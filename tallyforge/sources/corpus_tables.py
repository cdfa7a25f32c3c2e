"""Readers of manifests, fact files and documents, and corpus tables derived from the driver's ones."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST = "id string, origin string, path string, url string, sha256 string"
FACT_FILE = "description string, pdf_sha256 string, image_sha256 string, url string, upstream_reference array<struct<document: string, name: string, value: string, unit: string, period: string, page: bigint>>"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder all executors share. Where spark.checkpoint.dir is unset, a cluster gets an error and a local session a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tallyforge-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tallyforge/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once in the shared folder and read back, for tables that a query uses several times."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def manifest_scan(spark: SparkSession, path: str, *, multi_line: bool = True) -> DataFrame:
    """The manifest's rows. Rows must have id, origin and path: the first that lacks one fails every read, whatever columns it asks for. Repeated rows stay; an empty manifest gives none."""
    rows = spark.read.schema(MANIFEST).option("multiLine", multi_line).json(path)
    lacks = F.col("id").isNull() | F.col("origin").isNull() | F.col("path").isNull()
    return rows.where(F.when(lacks, F.raise_error(F.lit("a manifest row lacks id, origin or path")).cast("boolean")).otherwise(F.lit(True)))


def read_fact_files(spark: SparkSession, path: str, *, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """(flat facts, each with its file's digest and url; broken files (file, pdf_sha256, reason, record)).

    A file, or a line where multi_line is off, is lost as a whole and listed once with a
    reason: unreadable (no JSON, cut off, or a value of another type; record is its text),
    no_facts (its list of facts is absent or empty) or blank (a file without any record).
    Files of no bytes at all are not listed by Spark and so not seen. An entry null in a
    list is a fact without values, for read_facts() to set aside.
    """
    reader = spark.read.schema(f"{FACT_FILE}, record string").option("multiLine", multi_line).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "record")
    rows = reader.json(path).withColumn("file", F.col("_metadata.file_path"))
    lost = F.when(F.col("record").isNotNull(), "unreadable").when(F.coalesce(F.size("upstream_reference"), F.lit(0)) < 1, "no_facts")
    flat = rows.where(lost.isNull()).select("pdf_sha256", "url", F.inline("upstream_reference")).withColumn("page", F.col("page").cast("int"))
    broken = rows.select("file", F.when(F.col("record").isNull(), F.col("pdf_sha256")).alias("pdf_sha256"), lost.alias("reason"), "record").where("reason is not null")
    listed = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"))
    blank = listed.join(rows.select("file").distinct(), "file", "left_anti")
    none = F.lit(None).cast("string")
    return flat, broken.union(blank.select("file", none.alias("pdf_sha256"), F.lit("blank").alias("reason"), none.alias("record")))


def fact_scan(spark: SparkSession, path: str, *, multi_line: bool = True) -> DataFrame:
    """Nested fact files as flat facts, each with its file's digest and url: the first part of read_fact_files()."""
    return read_fact_files(spark, path, multi_line=multi_line)[0]


def file_scan(spark: SparkSession, path: str) -> DataFrame:
    """Whole files with their content; select path and length alone and no byte is read. Spark lists no files of length 0, so those count as absent."""
    return spark.read.format("binaryFile").load(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Tables derived from documents: a manifest, a store of an earlier run, and landed copies.


def _path() -> F.Column:
    return F.expr("concat(if(doc_id % 101 = 0, '../escape', source), '/', doc_id, '.txt')")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    origin = F.expr("if(doc_id % 5 < 2, 'simulated', 'public_original')")
    return docs.select(F.col("doc_id").cast("string").alias("id"), "source", origin.alias("origin"), _path().alias("path"), F.expr("concat('https://example.org/', doc_id)").alias("url"), F.sha2("text", 256).alias("sha256"))


def store_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content) of the store; some are stale."""
    docs = table(spark, sf_dir, "documents").where("doc_id % 7 <> 0")
    return docs.select(_path().alias("path"), F.expr("if(doc_id % 11 = 0, concat(text, 'x'), text)").cast("binary").alias("content"))


def landed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content) of landed copies; some are damaged."""
    docs = table(spark, sf_dir, "documents").where("doc_id % 17 <> 0")
    return docs.select(_path().alias("path"), F.expr("if(doc_id % 13 = 0, concat(text, 'y'), text)").cast("binary").alias("content"))


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_files(spark, sf_dir).select("path", F.sha2("content", 256).alias("sha256"))


def landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landed_files(spark, sf_dir).select("path", F.sha2("content", 256).alias("sha256"))


CORPUS_SQL = """
manifest as (select doc_id::varchar as id, source, case when doc_id % 5 < 2 then 'simulated' else 'public_original' end as origin,
  (case when doc_id % 101 = 0 then '../escape' else source end) || '/' || doc_id || '.txt' as path, 'https://example.org/' || doc_id as url, sha256(text) as sha256 from documents),
store as (select path, sha256(content) as sha256, content from (select (case when doc_id % 101 = 0 then '../escape' else source end) || '/' || doc_id || '.txt' as path, case when doc_id % 11 = 0 then text || 'x' else text end as content from documents where doc_id % 7 <> 0)),
landed as (select path, sha256(content) as sha256, content from (select (case when doc_id % 101 = 0 then '../escape' else source end) || '/' || doc_id || '.txt' as path, case when doc_id % 13 = 0 then text || 'y' else text end as content from documents where doc_id % 17 <> 0))"""

# Tables derived from lineitem and orders: financial facts of suppliers.

# Quarterly and annual metrics by the lines that make them up.
PARTS = {"revenue": "true", "net_profit_parent": "l_returnflag <> 'R'", "net_profit_parent_adjusted": "l_returnflag = 'N'", "operating_cash_flow": "l_linestatus = 'F'"}
AMOUNTS = tuple(PARTS)


def entity_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with yq, 4 * year + quarter of their order; bit i of parts_of tells whether the i-th of PARTS counts the line. So quarters and flags cost a shuffle one number each."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("4 * year(o_orderdate) + quarter(o_orderdate)").alias("yq"))
    parts_of = " + ".join(f"if({c}, {1 << i}, 0)" for i, c in enumerate(PARTS.values()))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("e"), "l_partkey", F.expr(f"cast({parts_of} as tinyint)").alias("parts_of"), F.expr("cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(4,2)))").alias("v"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("e", "yq", "l_partkey", "parts_of", "v")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document, name, value, unit, period, page): quarters and years of suppliers, with amounts as decimal strings.

    Lines move once, to their supplier's document; quarters, years and running totals are
    all made there, and a year's facts come with those of its first quarter. The facts stay
    dealt by document, so what is grouped by it, alone or with more, moves no more. Names,
    units and periods are told apart from values, so a query that asks for no value moves
    no amounts and parts.
    """
    c = F.col
    # a part counts for a year where it stands first in it
    seen = F.lag("l_partkey").over(Window.partitionBy("document", "y").orderBy("l_partkey"))
    lines = entity_lines(spark, sf_dir).select(F.expr("concat('S', e)").alias("document"), "yq", "l_partkey", "parts_of", "v").repartition("document")
    lines = lines.withColumns({"y": F.expr("(yq - 1) div 4").cast("int"), "q": F.expr("(yq - 1) % 4 + 1")}).withColumn("new", c("l_partkey").isNotNull() & ~c("l_partkey").eqNullSafe(seen))
    sums = [F.coalesce(F.sum(F.when(c("parts_of").bitwiseAND(1 << i) != 0, c("v"))), F.lit(0)).cast("decimal(24,4)").alias(n) for i, n in enumerate(AMOUNTS)]
    quarters = lines.groupBy("document", "y", "q").agg(*sums, F.count_if("new").alias("parts"))
    year, to_year = Window.partitionBy("document", "y"), Window.partitionBy("document").orderBy(F.asc_nulls_last("y")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    total = lambda n, w: F.sum(n).over(w).cast("decimal(24,4)")
    rows = quarters.withColumns({"first": F.row_number().over(year.orderBy("q")) == 1, "parts": F.sum("parts").over(year), **{f"y_{n}": total(n, year) for n in AMOUNTS}, "y_assets_total": total("revenue", to_year), "y_equity_parent": total("net_profit_parent", to_year)})
    eps = F.expr("cast((cast(y_net_profit_parent * 10000 as bigint) div parts) as decimal(20,0)) * cast(0.0001 as decimal(5,4))").cast("decimal(24,4)")
    of_quarter = {n: c(n) for n in AMOUNTS}
    of_year = {n: c(f"y_{n}") for n in (*AMOUNTS, "assets_total", "equity_parent")} | {"eps_basic": eps}

    def told(names: dict[str, Column], period: str, start: int) -> Column:
        return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("name"), F.lit("元/股" if n == "eps_basic" else "元").alias("unit"), F.expr(period).alias("period")) for i, n in enumerate(names, start)])

    def with_year(quarter: Column, of: Column) -> Column:
        return F.when(c("first"), F.concat(quarter, of)).otherwise(quarter)

    heads = with_year(told(of_quarter, "concat(y, '-Q', q)", 0), told(of_year, "cast(y as string)", len(of_quarter)))
    values = with_year(*(F.array(*[v.cast("string") for v in of.values()]) for of in (of_quarter, of_year)))
    told_rows = rows.select("document", values.alias("values"), F.inline(heads))
    return told_rows.select("document", "name", c("values")[c("i")].alias("value"), "unit", "period", F.lit(1).alias("page"))


def _sum_sql(n: str, c: str) -> str:
    return f"cast(coalesce(sum(v) filter (where {c}), 0) as decimal(24,4)) as {n}"


_SUMS = ", ".join(_sum_sql(n, c) for n, c in PARTS.items())
FACTS_SQL = f"""
ln as (select l_suppkey as e, year(o_orderdate) as y, quarter(o_orderdate) as q, l_partkey, l_returnflag, l_linestatus,
  cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(4,2))) as v from lineitem join orders on l_orderkey = o_orderkey),
qf as (select e, y, q, {_SUMS} from ln group by e, y, q),
yg as (select e, y, {_SUMS}, count(distinct l_partkey) as parts from ln group by e, y),
yf as (select *, cast(sum(revenue) over w as decimal(24,4)) as assets_total, cast(sum(net_profit_parent) over w as decimal(24,4)) as equity_parent,
  cast(cast(cast(net_profit_parent * 10000 as bigint) // parts as decimal(20,0)) * cast(0.0001 as decimal(5,4)) as decimal(24,4)) as eps_basic
  from yg window w as (partition by e order by y rows unbounded preceding)),
facts as (
{" union all ".join(f"select 'S' || e as document, '{n}' as name, {n}::varchar as value, '元' as unit, y || '-Q' || q as period, 1 as page from qf" for n in AMOUNTS)}
 union all {" union all ".join(f"select 'S' || e, '{n}', {n}::varchar, '{'元/股' if n == 'eps_basic' else '元'}', y::varchar, 1 from yf" for n in (*AMOUNTS, "assets_total", "equity_parent", "eps_basic"))})"""


def faulty_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts with errors put in: repeated rows, contradicting amounts, another unit, unreadable values and periods."""
    rows = facts(spark, sf_dir).withColumn("e", F.expr("cast(substring(document, 2) as bigint)"))
    # all copies of a fact come from the one row, so that the facts are derived once; copy 0 has the other errors, 2 the contradicting amount
    copies = F.array(F.lit(0), F.when(F.expr("e % 19 = 0"), 1), F.when(F.expr("e % 23 = 0"), 2))
    value = "case when copy = 0 and e % 37 = 0 and period like '%Q2' then 'N/A' when copy = 2 then cast(cast(cast(value as decimal(24,4)) + 1 as decimal(24,4)) as string) else value end as value"
    unit, period = "if(copy = 0 and e % 31 = 0 and name = 'revenue', '%', unit) as unit", "if(copy = 0 and e % 41 = 0 and period like '%Q3', '2024-Q5', period) as period"
    return rows.withColumn("copy", F.explode(F.filter(copies, lambda x: x.isNotNull()))).selectExpr("document", "name", value, unit, period, "page")


FAULTY_SQL = (
    FACTS_SQL
    + """,
fe as (select *, substr(document, 2)::bigint as e from facts),
faulty as (
  select document, name, case when e % 37 = 0 and period like '%Q2' then 'N/A' else value end as value, case when e % 31 = 0 and name = 'revenue' then '%' else unit end as unit, case when e % 41 = 0 and period like '%Q3' then '2024-Q5' else period end as period, page from fe
  union all select document, name, value, unit, period, page from fe where e % 19 = 0
  union all select document, name, cast(value::decimal(24,4) + 1 as decimal(24,4))::varchar, unit, period, page from fe where e % 23 = 0)"""
)
