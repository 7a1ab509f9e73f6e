"""Demographics, cases, cost, roll-ups, savings and map tables."""

import pytest
from pyspark.sql import functions as F

from airtoll import schemas as S
from airtoll.operators import demographics as D
from airtoll.operators import impact as I
from airtoll.operators import rollup as U
from tests.conftest import rows

CONC = "GEOID string, NAMELSADCO string, pollutant string, condition string, Final_Conc double, county_fips string"


@pytest.fixture(scope="module")
def risk(spark):
    return spark.createDataFrame([
        ("PM", "All-cause mortality", 1.01), ("PM", "Diabetes", 1.0), ("PM", "Stroke", 0.99), ("NOx", "Asthma", 1.06)],
        "pollutant string, endpoint string, RR double")


@pytest.fixture(scope="module")
def cost(spark):
    return spark.createDataFrame([("All-cause mortality", 1000.0), ("Stroke", 10.0)],
                                 "`Health Endpoint` string, `Economic Cost` double")


@pytest.fixture(scope="module")
def rates(spark):
    names = list(S.ENDPOINT_OF_RATE)
    return spark.createDataFrame(
        [("24001", 2022, *["100"] * 7), ("24001", 2023, "800", "90", "50", "40", "NA", "120", "30"),
         ("24001", None, *["1"] * 7)],
        "county_fips string, year int, " + ", ".join(f"{n} string" for n in names))


@pytest.fixture(scope="module")
def cases(spark, risk, rates):
    air = spark.createDataFrame([
        ("01", "A County", "PM", "Typical Controlled", 1.0, "24001"),
        ("01", "A County", "PM", "Typical Uncontrolled", 2.0, "24001"),
        ("02", "A County", "PM", "Typical Uncontrolled", 3.0, "24001"),
        ("03", "B County", "PM", "Typical Controlled", 1.0, "24003"),
        ("01", "A County", "NOx", "Typical Controlled", 0.0, "24001")], CONC)
    people = spark.createDataFrame([("01", "x", 1000.0), ("02", "y", None), ("03", "z", 500.0)],
                                   "GEOID string, NAME string, total_pop double")
    return I.tract_cases(I.add_rates(D.add_demographics(air, people), I.latest_rates(rates)), risk).cache()


def test_long_to_wide_and_copied_vintage(spark):
    long = spark.createDataFrame([
        ("01", "n", "total_pop", 5.0, 1.0, 2023), ("01", "n", "white", None, 1.0, 2023),
        ("01", "n", "total_pop", 4.0, 1.0, 2020), ("09", "m", "total_pop", 9.0, 1.0, 2024)],
        "GEOID string, NAME string, variable string, estimate double, moe double, year int")
    wide = D.copy_vintage(D.widen_demographics(long))
    assert wide.columns == ["GEOID", "NAME", "year", *S.DEMOGRAPHICS]
    assert [r[:4] for r in rows(wide, "year")] == [("01", "n", 2020, 4.0), ("01", "n", 2023, 5.0), ("01", "n", 2024, 5.0)]
    without = D.copy_vintage(D.widen_demographics(long.filter("year = 2020")))
    assert {r["year"] for r in without.collect()} == {2020}


def test_wide_form_keeps_other_names_ending_in_e(spark):
    wide = spark.createDataFrame([("1", "n", "t", 1.0, 0.1)], "GEOID string, NAME string, TRACTCE string, total_popE double, total_popM double")
    assert D.strip_estimate_suffix(D.drop_margins(wide)).columns == ["GEOID", "NAME", "TRACTCE", "total_pop"]


def test_county_of_a_tract_with_a_leading_zero(spark):
    df = spark.createDataFrame([("01001020100",), ("24510010100",)], "GEOID string")
    assert rows(df.select("GEOID", D.county_of(F.col("GEOID")).alias("c")), "GEOID") == [
        ("01001020100", "01001"), ("24510010100", "24510")]


def test_unmatched_tracts_are_counted(spark):
    air = spark.createDataFrame([("1", 2020), ("1", 2021), ("2", 2021), ("2", 2021)], "GEOID string, year int")
    people = spark.createDataFrame([("1", 2021)], "GEOID string, year int")
    assert rows(D.unmatched_tracts(air, people, ["GEOID", "year"]), "year") == [(2020, 1, 1), (2021, 2, 1)]


def test_latest_rates_ignore_missing_years(rates):
    got = I.latest_rates(rates).collect()
    assert len(got) == 1 and got[0]["mortality_rate"] == "800" and "year" not in got[0].asDict()


def test_left_keeps_and_inner_drops_a_county_without_rates(spark, rates):
    air = spark.createDataFrame([("24001", 1), ("24003", 2)], "county_fips string, k int")
    latest = I.latest_rates(rates)
    assert [r["k"] for r in I.add_rates(air, latest, missing_rates="drop").collect()] == [1]
    assert sorted(r["k"] for r in I.add_rates(air, latest).collect()) == [1, 2]


def test_unpivot_keeps_missing_rates(cases):
    assert cases.count() == 5 * 7
    nothing = cases.filter("GEOID = '03'")
    assert nothing.count() == 7 and nothing.filter("rate is not null or additional_cases is not null").count() == 0
    unreadable = cases.filter("endpoint = 'Asthma' and pollutant = 'NOx'").first()
    assert unreadable["rate"] == "NA" and unreadable["baseline_rate"] is None and unreadable["RR"] == 1.06


def test_summary_is_positive_only(cases):
    got = U.case_summary(cases, "condition").collect()
    # RR 1, RR below 1, no risk, no population and concentration 0 are all left out
    assert {(r["pollutant"], r["endpoint"]) for r in got} == {("PM", "All-cause mortality")}
    total = {r["condition"]: r["total_additional_cases"] for r in got}
    assert total["Typical Controlled"] == pytest.approx(0.008 * 1000 * (1 - 1 / 1.01))


def test_summary_ignores_nan(spark):
    df = spark.createDataFrame([("PM", "e", "c", float("nan")), ("PM", "e", "c", 2.0), ("PM", "f", "c", float("nan"))],
                               "pollutant string, endpoint string, condition string, additional_cases double")
    assert rows(U.case_summary(df, "condition"), "endpoint") == [("PM", "e", "c", 2.0)]


PRICED = "pollutant string, endpoint string, condition string, total_additional_cases double, total_cost double"


@pytest.fixture(scope="module")
def priced(spark):
    return spark.createDataFrame([
        ("PM", "All-cause mortality", "Typical Controlled", 1.5, 2e6),
        ("PM", "Diabetes", "Typical Controlled", 2.0, None),
        ("SO2", "Stroke", "Max Uncontrolled extra", 3.0, 4e6),
        ("Ozone", "Chronic obstructive pulmonary disease", "Typical Controlled", 0.25, 1e5)], PRICED)


def test_cost_join_and_sums(cases, cost):
    got = U.cost_summary(cases, cost, "condition").collect()
    assert all(r["total_cost"] == pytest.approx(1000 * r["total_additional_cases"]) for r in got)


def test_totals_equal_the_parts(priced):
    got = {(r["condition"], r["pollutant"]): r["total_cost"] for r in U.with_scenario_totals(priced).collect()}
    assert got[("Typical Controlled", "Total")] == got[("Typical Controlled", "PM")] + got[("Typical Controlled", "Ozone")]
    assert len(got) == 5


def test_control_ranges_split_names(priced):
    got = {(r["operations"], r["controls"], r["pollutant"]): r for r in U.control_ranges(priced).collect()}
    assert got[("Max", "Uncontrolled", "SO2")]["total_cost_million"] == 4.0
    assert got[("Typical", "Controlled", "Total")]["pollutant_rank"] == 1
    assert got[("Typical", "Controlled", "Ozone")]["pollutant_rank"] is None
    assert got[("Typical", "Controlled", "PM")]["label"] == "2.00"


def test_one_word_condition_has_no_controls(spark):
    df = spark.createDataFrame([("PM", "Stroke", "Typical", 1.0, 1.0)], PRICED)
    assert {r["controls"] for r in U.control_ranges(df).collect()} == {None}


def test_trend_keeps_an_unlisted_endpoint(priced):
    got = {r["endpoint"]: r["endpoint_rank"] for r in U.endpoint_trend(priced, "condition").collect()}
    assert got["All-cause mortality"] == 1 and got["Chronic obstructive pulmonary disease"] is None


def test_wide_table_and_its_text(priced):
    wide = U.damage_wide(priced, "condition", S.CONDITION_ORDER)
    assert wide.columns[:2] == ["endpoint", "pollutant"] and "total_cost_Max Controlled" in wide.columns
    text = {(r["pollutant"], r["endpoint"]): r.asDict() for r in U.damage_display(wide).collect()}
    cell = text[("PM", "All-cause mortality")]
    assert cell["total_additional_cases_Typical Controlled"] == "1.500" and cell["total_cost_Typical Controlled"] == "2.0"
    assert cell["total_cost_Max Controlled"] == "XX"
    order = [r["pollutant"] for r in U.in_display_order(wide, "pollutant_rank").collect()]
    assert order == ["PM", "PM", "SO2", "Ozone"]


def test_savings_need_both_scenarios(spark):
    costs = spark.createDataFrame([
        ("240011", "A County", "24001", "Typical Controlled", 2.0), ("240011", "A County", "24001", "Typical Uncontrolled", 5.0),
        ("240012", "A County", "24001", "Typical Uncontrolled", 7.0), ("240033", "B County", "24003", "Typical Controlled", None),
        ("240033", "B County", "24003", "Typical Uncontrolled", 1.0)],
        "GEOID string, NAMELSADCO string, county_fips string, condition string, economic_cost double")
    savings = U.scenario_savings(costs)
    got = {r["GEOID"]: r["delta_economic_cost"] for r in savings.collect()}
    assert got == {"240011": 3.0, "240012": None, "240033": 1.0}
    back = U.scenario_savings(costs, before="Typical Controlled", after="Typical Uncontrolled")
    assert {r["GEOID"]: r["delta_economic_cost"] for r in back.collect()} == {"240011": -3.0, "240012": None, "240033": -1.0}
    counties = spark.createDataFrame([("24001", "A County"), ("24005", "C County")], "GEOID string, NAMELSAD string")
    fanned = rows(U.county_savings_rows(counties, savings).select("NAMELSAD", "GEOID", "delta_economic_cost"), "NAMELSAD", "GEOID")
    assert fanned == [("A County", "240011", 3.0), ("A County", "240012", None), ("C County", None, None)]
    proper = rows(U.county_savings(counties, savings).select("GEOID", "delta_economic_cost"), "GEOID")
    assert proper == [("24001", 3.0), ("24005", None)]
    county = rows(U.county_damages(counties, costs).select("GEOID", "total_economic_cost"), "GEOID")
    assert county == [("24001", 14.0), ("24005", None)]
    namesake = spark.createDataFrame([("24001", "A County"), ("51001", "A County")], "GEOID string, NAMELSAD string")
    assert rows(U.county_savings(namesake, savings).select("GEOID", "delta_economic_cost"), "GEOID") == [("24001", 3.0), ("51001", None)]
    tracts = spark.createDataFrame([("240011",), ("9",)], "GEOID string")
    assert rows(U.tract_damages(tracts, costs, "24001"), "GEOID") == [("240011", 7.0), ("9", None)]
    assert rows(U.tract_savings(tracts, savings), "GEOID") == [("240011", 3.0)]


def test_an_unlisted_scenario_gets_its_column(spark):
    costs = spark.createDataFrame([("1", "A", "Idle", 2.0), ("1", "A", None, 3.0)],
                                  "GEOID string, NAMELSADCO string, condition string, economic_cost double")
    got = U.scenario_savings(costs).first().asDict()
    assert got["economic_cost_Idle"] == 2.0 and got["economic_cost_NA"] == 3.0 and got["delta_economic_cost"] is None


def test_same_tract_name_in_two_counties_stays_apart(spark):
    costs = spark.createDataFrame([("1", "A County", "Typical Controlled", 1.0), ("2", "B County", "Typical Controlled", 2.0)],
                                  "GEOID string, NAMELSADCO string, condition string, economic_cost double")
    assert U.scenario_savings(costs).count() == 2


def test_map_value(spark):
    df = spark.createDataFrame([(1, 50e6), (2, -1e6), (3, None), (4, 4e6)], "i int, c double")
    got = rows(df.select("i", U.map_value(F.col("c"), 40.0), U.map_value(F.col("c"), None, "log10")), "i")
    assert got[0][1] == pytest.approx(40**0.5) and got[1][1] == 0 and got[2][1:] == (None, None)
    assert got[3] == (4, 2.0, pytest.approx(0.6020599913))
