"""Growth, ratios and valuation of entities, and one report for each.

Definitions are the textbook ones, given beside each operator. Assumption grids are
parameters, so every operator is narrow over the entities. Facts are as of facts.parsed,
one row a key; null amounts give null results; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio
from .facts import pivot_facts

RATIOS = ("net_margin", "cash_conversion", "equity_ratio", "non_recurring", "mean_equity_return")
RATIO_METRICS = ("revenue", "net_profit_parent", "net_profit_parent_adjusted", "operating_cash_flow", "assets_total", "equity_parent")


def growth(facts: DataFrame, periods: int = 1) -> DataFrame:
    """Change against the period that many before: growth, or the compound rate a period; flag gap, zero_base or negative_base where there is none."""
    w = Window.partitionBy("document", "name", "grain").orderBy("period_index")
    rows = facts.withColumn("prior", F.lag("amount", periods).over(w)).withColumn("gap", F.col("period_index") - F.lag("period_index", periods).over(w) != periods)
    flag = F.when(F.col("prior").isNull(), "first").when(F.col("gap"), "gap").when(F.col("prior") == 0, "zero_base").when(F.col("prior") < 0, "negative_base")
    change = F.col("amount").cast("double") / F.nullif(F.col("prior").cast("double"), F.lit(0.0))
    value = change - 1 if periods == 1 else F.when(change > 0, F.pow(change, 1 / periods)) - 1
    prior = F.when(flag.isNull() | flag.isin("zero_base", "negative_base"), F.col("prior"))
    return rows.select("document", "name", "grain", "period", "amount", prior.alias("prior"), F.when(flag.isNull(), F.round(value, 6)).alias("growth"), flag.alias("flag"))


def ratios(facts: DataFrame) -> DataFrame:
    """Annual ratios: net margin, cash conversion, equity ratio, non-recurring gap and return on mean equity."""
    wide = pivot_facts(facts.where("grain = 'annual'"), RATIO_METRICS).withColumn("year", F.col("period").cast("int"))
    w = Window.partitionBy("document").orderBy("year")
    before = F.when(F.lag("year").over(w) == F.col("year") - 1, F.lag("equity_parent").over(w))
    c = F.col
    return wide.select(
        "document", "period", ratio(c("net_profit_parent"), c("revenue")).alias("net_margin"), ratio(c("operating_cash_flow"), c("net_profit_parent")).alias("cash_conversion"),
        ratio(c("equity_parent"), c("assets_total")).alias("equity_ratio"), (c("net_profit_parent") - c("net_profit_parent_adjusted")).cast("decimal(24,4)").alias("non_recurring"),
        ratio(c("net_profit_parent"), (c("equity_parent").cast("double") + before.cast("double")) / 2).alias("mean_equity_return"),
    )


def project(base: DataFrame, assumptions: list[tuple[str, float]], years: int) -> DataFrame:
    """(document, value) -> document, scenario, g, t, projected = value * (1 + g) ^ t for t = 1..years."""
    cases = F.array(*[F.struct(F.lit(s).alias("scenario"), F.lit(g).alias("g")) for s, g in assumptions])
    rows = base.select("document", "value", F.inline(cases))
    rows = rows.withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(years))))
    return rows.withColumn("projected", F.col("value").cast("double") * F.pow(1 + F.col("g"), F.col("t")))


def _discounted(r: float, g_terminal: float) -> list[Column]:
    last = F.max_by("projected", "t")
    n = F.max("t")
    flows = F.sum(F.col("projected") / F.pow(F.lit(1 + r), F.col("t")))
    if r <= g_terminal:
        return [F.lit(None).cast("double").alias("present_value"), F.lit("r_le_g").alias("flag")]
    end = last * (1 + g_terminal) / (r - g_terminal) / F.pow(F.lit(1 + r), n)
    return [F.round(flows + end, 2).alias("present_value"), F.lit(None).cast("string").alias("flag")]


def present_value(projected: DataFrame, r: float, g_terminal: float) -> DataFrame:
    """Discounted projections with a terminal value v_N (1 + g) / (r - g); null and flag r_le_g if r does not exceed g."""
    return projected.groupBy("document", "scenario").agg(*_discounted(r, g_terminal))


def sensitivity_grid(base: DataFrame, grid: list[tuple[float, float, float]], years: int) -> DataFrame:
    """Every entity's value on every (g, r, terminal g) cell: least, median and greatest, the cells that have a value, and r_le_g, those that have none because r does not exceed the terminal g.

    Every entity has a row; its values are null where no cell has one.
    """
    cells = F.array(*[F.struct(F.lit(g).alias("g"), F.lit(r).alias("r"), F.lit(e).alias("e")) for g, r, e in grid])
    rows = base.select("document", F.col("value").cast("double").alias("value"), F.inline(cells))
    flows = F.aggregate(F.sequence(F.lit(1), F.lit(years)), F.lit(0.0), lambda s, t: s + F.pow((1 + F.col("g")) / (1 + F.col("r")), t))
    end = F.pow((1 + F.col("g")) / (1 + F.col("r")), F.lit(years)) * (1 + F.col("e")) / F.nullif(F.col("r") - F.col("e"), F.lit(0.0))
    rows = rows.withColumn("pv", F.when(F.col("r") > F.col("e"), F.col("value") * (flows + end)))
    return rows.groupBy("document").agg(
        F.round(F.min("pv"), 2).alias("least"), F.round(F.percentile("pv", 0.5), 2).alias("median"), F.round(F.max("pv"), 2).alias("most"),
        F.count("pv").alias("cells"), F.count_if(F.col("r") <= F.col("e")).alias("r_le_g"),
    )


def multiple_value(facts: DataFrame, multiples: list[tuple[str, int]]) -> DataFrame:
    """Implied price a share: annual basic earnings a share times each multiple."""
    cases = F.array(*[F.struct(F.lit(n).alias("multiple_name"), F.lit(m).alias("multiple")) for n, m in multiples])
    rows = facts.where("name = 'eps_basic' and grain = 'annual'").select("document", "period", "amount", F.inline(cases))
    return rows.select("document", "period", "multiple_name", (F.col("amount") * F.col("multiple")).cast("decimal(24,4)").alias("price"))


def entity_report(facts: DataFrame, checks: DataFrame, ratio_rows: DataFrame, values: DataFrame) -> DataFrame:
    """One record an entity, as JSON: its facts, the checks of its quarters, its ratios and its values, each in order.

    Amounts are exact decimals as text; what is null is left out. An entity has at most
    one fact a metric and period, so its lists are bounded by those.
    """

    def part(rows: DataFrame, name: str, *columns: Column) -> DataFrame:
        return rows.groupBy("document").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))

    text = lambda name, kind: F.col(name).cast(kind).cast("string").alias(name)
    f = part(facts, "facts", F.col("name"), F.col("period"), text("amount", "decimal(24,4)"), F.col("unit"))
    c = part(checks, "checks", F.col("name"), F.col("year"), text("diff", "decimal(24,4)"), F.col("status"))
    r = part(ratio_rows, "ratios", F.col("period"), *(text(n, "decimal(24,6)") for n in RATIOS))
    v = part(values, "values", F.col("scenario"), text("present_value", "decimal(24,2)"), F.col("flag"))
    parts = f.join(c, "document", "left").join(r, "document", "left").join(v, "document", "left")
    return parts.select("document", F.to_json(F.struct("facts", "checks", "ratios", "values")).alias("report"))
