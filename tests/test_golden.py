"""Figures of one published annual summary, and what they must give: exact checks of the fact operators."""

from decimal import Decimal

import pytest

from tallyforge.operators import analysis, facts

# Amounts of 2022, 2023 and 2024, then of the four quarters of 2024.
ANNUAL = {
    "assets_total": ("254500826096.02", "272699660092.25", "298944579918.70"),
    "equity_parent": ("197480041239.46", "215668571607.43", "233105984399.47"),
    "revenue": ("124099843771.99", "147693604994.14", "170899152276.34"),
    "net_profit_parent": ("62717467870.12", "74734071550.75", "86228146421.62"),
    "net_profit_parent_adjusted": ("62792896829.57", "74752564425.52", "86240905977.42"),
    "operating_cash_flow": ("36698595830.03", "66593247721.09", "92463692168.43"),
    "roe_weighted": ("30.26", "34.19", "36.02"),
    "eps_basic": ("49.93", "59.49", "68.64"),
    "eps_diluted": ("49.93", "59.49", "68.64"),
}
QUARTERS = {
    "revenue": ("45775517043.29", "36155460624.46", "38845154206.94", "50123020401.65"),
    "net_profit_parent": ("24065262374.15", "17630348609.22", "19131941135.14", "25400594303.11"),
    "net_profit_parent_adjusted": ("24051471185.69", "17618626634.30", "19108543634.77", "25462264522.66"),
    "operating_cash_flow": ("9187422415.09", "27434411397.54", "7799552404.82", "48042305950.98"),
}
UNIT = {"roe_weighted": "%", "eps_basic": "元/股", "eps_diluted": "元/股"}


@pytest.fixture(scope="module")
def rows(spark):
    made = [(n, v, str(2022 + i)) for n, vs in ANNUAL.items() for i, v in enumerate(vs)]
    made += [(n, v, f"2024-Q{i + 1}") for n, vs in QUARTERS.items() for i, v in enumerate(vs)]
    frame = spark.createDataFrame([("summary", n, v, UNIT.get(n, "元"), p, 4) for n, v, p in made], "document string, name string, value string, unit string, period string, page int")
    return facts.parsed(frame).cache()


def test_every_fact_is_read_and_consistent(rows):
    grains = {r["grain"]: r["count"] for r in rows.groupBy("grain").count().collect()}
    assert grains == {"annual": 27, "quarter": 16}
    assert facts.unit_consistency(rows).count() == 0 and facts.fact_conflicts(rows).count() == 0


def test_quarters_add_up_to_the_year(rows):
    got = {(r["name"], r["year"]): r for r in facts.quarter_rollup(rows).collect()}
    for name in QUARTERS:
        assert got[name, 2024]["diff"] == 0 and got[name, 2024]["status"] == "ok" and got[name, 2023]["status"] == "incomplete"
    assert got["revenue", 2024]["sum_q"] == Decimal("170899152276.34")
    assert {n for n, _ in got} == set(QUARTERS)


def test_growth_of_years_and_quarters(rows):
    got = {(r["name"], r["period"]): r["growth"] for r in analysis.growth(rows).collect()}
    assert (got["revenue", "2023"], got["revenue", "2024"]) == (0.190119, 0.157120)
    assert (got["net_profit_parent", "2023"], got["net_profit_parent", "2024"]) == (0.191599, 0.153800)
    assert (got["operating_cash_flow", "2023"], got["operating_cash_flow", "2024"]) == (0.814599, 0.388484)
    assert [got["revenue", f"2024-Q{q}"] for q in (1, 2, 3, 4)] == [None, -0.210157, 0.074392, 0.290329]
    compound = {(r["name"], r["period"]): r["growth"] for r in analysis.growth(rows.where("grain = 'annual'"), 2).collect()}
    assert compound["revenue", "2024"] == 0.173503


def test_ratios_of_three_years(rows):
    got = {r["period"]: r for r in analysis.ratios(rows).collect()}
    years = ("2022", "2023", "2024")
    assert [got[y]["net_margin"] for y in years] == [0.505379, 0.506007, 0.504556]
    assert [got[y]["cash_conversion"] for y in years] == [0.585142, 0.891069, 1.072315]
    assert [got[y]["equity_ratio"] for y in years] == [0.775950, 0.790865, 0.779763]
    assert [got[y]["non_recurring"] for y in years] == [Decimal("-75428959.45"), Decimal("-18492874.77"), Decimal("-12759555.80")]
    assert [got[y]["mean_equity_return"] for y in years] == [None, pytest.approx(0.361778, abs=1e-6), pytest.approx(0.384283, abs=1e-6)]


def test_pivot_and_unpivot_are_inverse(rows):
    annual = rows.where("grain = 'annual'")
    wide = facts.pivot_facts(annual, list(ANNUAL))
    assert wide.count() == 3
    years = ["2022", "2023", "2024"]
    statement = annual.groupBy("document", "name").pivot("period", years).agg({"amount": "first"})
    back = facts.unpivot_statement(statement, ["document", "name"], years)
    assert {(r["name"], r["period"], r["value"]) for r in back.collect()} == {(n, str(2022 + i), Decimal(v)) for n, vs in ANNUAL.items() for i, v in enumerate(vs)}


def test_prices_from_earnings(rows):
    got = {(r["period"], r["multiple_name"]): r["price"] for r in analysis.multiple_value(rows, [("low", 8), ("high", 15)]).collect()}
    assert got["2024", "low"] == Decimal("549.12") and got["2022", "high"] == Decimal("748.95")
