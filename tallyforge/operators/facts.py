"""Financial facts: (document, name, value, unit, period, page) with exact amounts.

Null values, units and periods are facts that cannot be read; repeated rows are each
returned unless an operator groups them; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import AMOUNT, parsed_amount, period_quarter, period_year, wilson

UNITS = ("元", "%", "元/股")
#: Metrics whose quarters add up to the year.
ADDITIVE = ("revenue", "net_profit_parent", "net_profit_parent_adjusted", "operating_cash_flow")
KEY = ("document", "name", "period")


def parse_value(facts: DataFrame) -> DataFrame:
    """Adds amount and ok; an unreadable value has a null amount."""
    amount = parsed_amount(F.col("value"))
    return facts.withColumn("amount", amount).withColumn("ok", amount.isNotNull())


def parse_period(facts: DataFrame) -> DataFrame:
    """Adds year, quarter, grain and period_index (years, or 4 * year + quarter); all null for another text."""
    year, quarter = period_year(F.col("period")), period_quarter(F.col("period"))
    grain = F.when(year.isNull(), None).when(quarter.isNull(), "annual").otherwise("quarter")
    return facts.withColumns({"year": year, "quarter": quarter, "grain": grain, "period_index": F.coalesce(4 * year + quarter, year)})


def read_facts(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts whose value and period can be read, with both parsed; the others as they came, with reason: value, period or value,period)."""
    both = parse_period(parse_value(facts))
    reason = F.concat_ws(",", F.when(~F.col("ok"), "value"), F.when(F.col("grain").isNull(), "period"))
    return both.where("ok and grain is not null"), both.where("not ok or grain is null").select(*(facts[c] for c in facts.columns), reason.alias("reason"))


def parsed(facts: DataFrame) -> DataFrame:
    """The first part of read_facts()."""
    return read_facts(facts)[0]


def fact_letters(unread: DataFrame) -> DataFrame:
    """The second part of read_facts() as dead letters (id, error): document/name/period, and what cannot be read of value and period."""
    known = lambda c: F.coalesce(F.col(c), F.lit("null"))
    told = F.transform(F.split("reason", ","), lambda r: F.concat(r, F.lit(" "), F.when(r == "value", known("value")).otherwise(known("period"))))
    return unread.select(F.concat_ws("/", *map(known, KEY)).alias("id"), F.concat(F.lit("unreadable "), F.array_join(told, ", ")).alias("error"))


def file_letters(broken: DataFrame) -> DataFrame:
    """The second part of read_fact_files() as dead letters (id, error)."""
    return broken.select(F.col("file").alias("id"), F.concat("reason", F.lit(": "), F.coalesce(F.col("pdf_sha256"), F.lit("no digest"))).alias("error"))


def unit_consistency(facts: DataFrame) -> DataFrame:
    """Metrics with several units or an unknown one."""
    units = facts.groupBy("name").agg(F.sort_array(F.collect_set("unit")).alias("units"))
    bad = (F.size("units") > 1) | (F.size(F.array_except("units", F.array(*map(F.lit, UNITS)))) > 0)
    return units.where(bad).select("name", F.array_join("units", ",").alias("units"))


def fact_conflicts(facts: DataFrame) -> DataFrame:
    """Keys with several rows: kind duplicate if all amounts agree, else conflict."""
    groups = facts.groupBy(*KEY).agg(F.count("*").alias("n"), F.count_distinct("amount").alias("n_amounts")).where("n > 1")
    return groups.withColumn("kind", F.when(F.col("n_amounts") > 1, "conflict").otherwise("duplicate"))


def pivot_facts(facts: DataFrame, metrics: list[str] | tuple[str, ...]) -> DataFrame:
    """A row for each document and period, a column for each metric, null where there is no amount; of repeated facts any one counts, so conflicts must be gone before."""
    return facts.groupBy("document", "period").pivot("name", list(metrics)).agg(F.first("amount", ignorenulls=True))


def unpivot_statement(wide: DataFrame, id_cols: list[str], periods: list[str]) -> DataFrame:
    """A statement with a column a period to long facts; empty cells give none."""
    return wide.unpivot(id_cols, periods, "period", "value").where("value is not null")


def quarter_rollup(facts: DataFrame, tol: float = 0) -> DataFrame:
    """Additive metrics: the sum of four quarters against the year's value. Null amounts add nothing; repeated quarters would be added twice, so fact_conflicts comes first."""
    rows = facts.where(F.col("name").isin(*ADDITIVE)).groupBy("document", "name", "year").agg(
        F.sum(F.when(F.col("grain") == "quarter", F.col("amount"))).cast(AMOUNT).alias("sum_q"),
        F.count_distinct(F.when(F.col("grain") == "quarter", F.col("quarter"))).alias("n_q"),
        F.max(F.when(F.col("grain") == "annual", F.col("amount"))).alias("annual"),
    )
    diff = (F.col("sum_q") - F.col("annual")).cast(AMOUNT)
    status = F.when(F.col("n_q") < 4, "incomplete").when(F.col("annual").isNull(), "no_annual").when(F.abs(diff) > tol, "mismatch").otherwise("ok")
    return rows.withColumn("diff", F.when(F.col("n_q") == 4, diff)).withColumn("status", status)


def trace_source(facts: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts with their document's digest and url, facts without a document, null ones too); a document the manifest has twice is traced to both."""
    known = manifest.select(F.col("id").alias("document"), "sha256", "url")
    return facts.join(known, "document"), facts.join(known, "document", "left_anti")


def verify_facts(extracted: DataFrame, answers: DataFrame, tol: float = 0) -> DataFrame:
    """Extracted facts against independent answers, by key: missing, unexpected, unit_mismatch, match or mismatch. The pages of both are reported, not compared; a table without a page gives null ones.

    Keys are compared null-safe: a null in a key is equal to a null. Equal answers (pages too) count
    once; repeated extracted rows are each judged; several different answers to one key
    are each held against every extracted row of it.
    """
    page = lambda df: F.col("page") if "page" in df.columns else F.lit(None).cast("int")
    x = extracted.select(*(F.col(k).alias(f"x_{k}") for k in KEY), F.col("amount").alias("got"), F.col("unit").alias("got_unit"), page(extracted).alias("got_page"), F.lit(True).alias("in_x"))
    y = answers.select(*(F.col(k).alias(f"y_{k}") for k in KEY), F.col("amount").alias("want"), F.col("unit").alias("want_unit"), page(answers).alias("want_page"), F.lit(True).alias("in_y")).distinct()
    status = (
        F.when(F.col("in_x").isNull(), "missing").when(F.col("in_y").isNull(), "unexpected").when(~F.col("got_unit").eqNullSafe(F.col("want_unit")), "unit_mismatch")
        .when(F.abs(F.col("got") - F.col("want")) <= tol, "match").otherwise("mismatch")
    )
    same = [F.col(f"x_{k}").eqNullSafe(F.col(f"y_{k}")) for k in KEY]
    key = [F.when(F.col("in_x"), F.col(f"x_{k}")).otherwise(F.col(f"y_{k}")).alias(k) for k in KEY]
    return x.join(y, same, "full_outer").select(*key, "got", "want", "got_page", "want_page", status.alias("status"))


def scorecard(results: DataFrame) -> DataFrame:
    """(kind, split, passed boolean) -> counts and pass rates with a 95 % Wilson interval; kinds are never merged, and an unknown outcome counts as not passed."""
    rows = results.groupBy("kind", "split").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col("passed").cast("long"), F.lit(0))).alias("passed"))
    p, n = F.col("passed"), F.col("n")
    return rows.select("kind", "split", "n", "passed", F.round(p / n, 6).alias("rate"), F.round(wilson(p, n, False), 6).alias("lo"), F.round(wilson(p, n, True), 6).alias("hi"))
