"""Registered queries: one per operator, over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airtoll import schemas as S
from airtoll.functions.columns import fixed_text, number_text, rank_in
from airtoll.functions.geodesy import utm_to_lon_lat
from airtoll.operators import audits as A
from airtoll.operators import demographics as D
from airtoll.operators import disparity as V
from airtoll.operators import impact as I
from airtoll.operators import inventory as N
from airtoll.operators import receptors as R
from airtoll.operators import regression as M
from airtoll.operators import rollup as U
from airtoll.operators import spatial as G
from airtoll.plans import bindings as B
from airtoll.sources import reports as P
from airtoll.sources import emissions, ordered, sinks, tables
from airtoll.sources.staging import scratch_path, staged

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SCENARIO = ["pollutant", "condition"]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: Mapping[str, int]) -> DataFrame:
    """Result columns at fixed decimals; + 0.0 turns a negative zero into zero."""
    return df.withColumns({c: F.round(F.col(f"`{c}`"), d) + F.lit(0.0) for c, d in digits.items()})


# --- inputs -----------------------------------------------------------------------------


@query
def s4_scenario_keys(spark: SparkSession, folder: str) -> DataFrame:
    items = B.table(spark, folder, "lineitem").select(
        F.year("l_shipdate").cast("string").alias("year"), B.pollutant().alias("p"), B.condition().alias("c"))
    names = items.select(F.explode(F.array(
        F.concat_ws(" ", F.lit("reformatted_Plant"), "year", "p", F.lit("Annual.csv")),
        F.concat_ws(" ", F.lit("reformatted_Plant"), "c", "p", F.lit("Annual.csv")),
        F.concat(F.lit("notes "), F.col("p"), F.lit(".txt")))).alias("file_name")).distinct()
    name = F.col("file_name")
    by_year, by_condition = R.year_keys(name), R.condition_keys(name, "Plant")
    return names.select(
        name, by_year["year"].alias("year"), by_year["pollutant"].alias("year_pollutant"),
        by_condition["condition"].alias("condition"), by_condition["pollutant"].alias("condition_pollutant"),
        F.regexp_replace(name, r"\.[a-z]+$", "").alias("stem"))


@query
def p1_drop_empty_columns(spark: SparkSession, folder: str) -> DataFrame:
    rows = R.drop_empty_columns(B.receptors(spark, folder))
    return rows.groupBy("file_name").agg(
        F.lit(", ".join(rows.columns)).alias("kept_columns"), F.count(F.lit(1)).alias("rows"), F.min("X").alias("min_x"), F.max("Y").alias("max_y"))


@query
def p5_p6_wide_demographics(spark: SparkSession, folder: str) -> DataFrame:
    return B.demographics(spark, folder)


@query
def p11_sentinel_clean(spark: SparkSession, folder: str) -> DataFrame:
    return V.clean_svi(B.svi(spark, folder))


@query
def w1_monitor_ids(spark: SparkSession, folder: str) -> DataFrame:
    rows = R.drop_empty_columns(B.receptors(spark, folder))
    return R.monitor_ids(rows).select("file_name", "X", "Y", F.col("Monitor Name").alias("monitor"),
                                      F.col(f"`{S.CONCENTRATION_HEADING}`").alias("conc"))


@query
def d1_monitor_table(spark: SparkSession, folder: str) -> DataFrame:
    monitors = R.reformat_receptors(
        R.drop_empty_columns(B.receptors(spark, folder)), 32618, B.places(spark, folder))
    return rounded(monitors, {"Latitude": 7, "Longitude": 7})


@query
def g2_utm_to_lonlat(spark: SparkSession, folder: str) -> DataFrame:
    sites = B.receptors(spark, folder).select("X", "Y").distinct()
    lon, lat = utm_to_lon_lat(F.col("X"), F.col("Y"))
    return sites.select("X", "Y", F.round(lon, 8).alias("lon"), F.round(lat, 8).alias("lat"))


@query
def g4_nearest_place(spark: SparkSession, folder: str) -> DataFrame:
    lon, lat = utm_to_lon_lat(F.col("X"), F.col("Y"))
    sites = B.receptors(spark, folder).select("X", "Y").distinct().select(
        "X", "Y", lon.alias("Longitude"), lat.alias("Latitude"))
    return G.nearest_place(sites, B.places(spark, folder), ["X", "Y"])


# --- exchanged files: a table is written out and read back --------------------------------


def _as_csv(df: DataFrame) -> str:
    path = scratch_path(df.sparkSession)
    sinks.write_table(df, path, fmt="csv")
    return path


@query
def s5_incidence_file(spark: SparkSession, folder: str) -> DataFrame:
    return tables.read_incidence(spark, _as_csv(B.rates(spark, folder)))


@query
def s5_risk_file(spark: SparkSession, folder: str) -> DataFrame:
    return tables.read_risk(spark, _as_csv(B.risk_sheet(spark, folder)))


@query
def s5_cost_file(spark: SparkSession, folder: str) -> DataFrame:
    return tables.read_cost(spark, _as_csv(B.cost_sheet(spark, folder)))


@query
def s9_county_file(spark: SparkSession, folder: str) -> DataFrame:
    shapes = tables.read_boundaries(spark, [_as_csv(B.county_texts(spark, folder))], schema=S.COUNTY, vintage=2021)
    corners = F.flatten(F.flatten("polygons"))
    return shapes.select("GEOID", "NAME", "NAMELSAD", "STATEFP", F.array_min(corners["x"]).alias("west"), F.array_max(corners["x"]).alias("east"),
                         F.size("polygons").alias("parts"), F.size(corners).alias("vertices"))


@query
def s11_partitioned_table(spark: SparkSession, folder: str) -> DataFrame:
    """Facilities share a path: writing one of them again replaces its rows alone."""
    rows = B.points(spark, folder).groupBy("pollutant", "condition").agg(F.count("Conc").alias("readings"))
    path = scratch_path(spark)
    sinks.write_table(rows, path, ["pollutant"])
    sinks.write_table(rows.filter(F.col("pollutant") == "PM").withColumn("readings", -F.col("readings")), path, ["pollutant"])
    return spark.read.parquet(path).select("pollutant", "condition", "readings")


@query
def o1_display_order(spark: SparkSession, folder: str) -> DataFrame:
    """The place of every row after sorting, missing ranks last."""
    costs = U.cost_by(U.cost_summary(B.cases(spark, folder), B.cost(spark), "condition"), "condition", "pollutant")
    ranked = costs.withColumn("condition_rank", rank_in(F.col("condition"), S.CONDITION_ORDER)).withColumn(
        "pollutant_rank", rank_in(F.col("pollutant"), S.POLLUTANT_ORDER))
    ordered_rows = U.in_display_order(ranked, "condition_rank", "pollutant_rank").withColumn("at", F.monotonically_increasing_id())
    return ordered_rows.select("condition", "pollutant", F.row_number().over(Window.orderBy("at")).alias("place"))


@query
def s6_demographics_file(spark: SparkSession, folder: str) -> DataFrame:
    return D.widen_demographics(tables.read_demographics_long(spark, _as_csv(B.demographics_long(spark, folder))))


@query
def s7_wide_demographics_file(spark: SparkSession, folder: str) -> DataFrame:
    wide = tables.read_demographics_wide(spark, _as_csv(B.demographics_wide(spark, folder)))
    return D.strip_estimate_suffix(D.drop_margins(wide))


@query
def s8_boundaries_file(spark: SparkSession, folder: str) -> DataFrame:
    shapes = tables.read_boundaries(spark, [_as_csv(B.boundary_texts(spark, folder))], vintage=2021)
    corners = F.flatten(F.flatten("polygons"))
    return shapes.select("GEOID", "STUSPS", F.array_min(corners["x"]).alias("west"), F.array_min(corners["y"]).alias("south"),
                         F.when(F.col("polygons").isNotNull(), F.size(corners)).alias("vertices"), "vintage")


@query
def s10_vulnerability_file(spark: SparkSession, folder: str) -> DataFrame:
    return V.clean_svi(tables.read_svi(spark, _as_csv(B.svi(spark, folder))))


@query
def s12_monitor_files(spark: SparkSession, folder: str) -> DataFrame:
    monitors = rounded(R.reformat_receptors(B.receptors(spark, folder)), {"Latitude": 7, "Longitude": 7})
    path = scratch_path(spark)
    sinks.write_reformatted(monitors, path)
    back = tables.read_monitors(spark, path)
    return back.select("*", *[v.alias(k) for k, v in R.year_keys(F.col("file_name")).items()])


@query
def s12_named_files(spark: SparkSession, folder: str) -> DataFrame:
    """One file per input under its name, read back."""
    monitors = rounded(R.reformat_receptors(B.receptors(spark, folder)), {"Latitude": 7, "Longitude": 7})
    path = scratch_path(spark)
    sinks.write_named_files(monitors, path)
    return tables.read_monitors(spark, path)


def _receptor_folder(spark: SparkSession, folder: str) -> str:
    path = scratch_path(spark)
    for rows in B.receptor_files(spark, folder):
        rows.write.mode("append").partitionBy("stem").option("header", True).option("nullValue", "NA").csv(path)
    return path


BLOCK = 32 << 10  # small blocks, so that files of the test tables are split


@query
def s1_mixed_headings(spark: SparkSession, folder: str) -> DataFrame:
    """Files whose columns differ, each read by its own heading."""
    rows = tables.receptors_of(ordered.read_mixed_folder(spark, _receptor_folder(spark, folder), block_bytes=BLOCK))
    return rows.select("file_name", "X", "Y", F.col(f"`{S.CONCENTRATION_HEADING}`").alias("conc"), "NOTE", "ZELEV")


@query
def p1_kept_columns_by_file(spark: SparkSession, folder: str) -> DataFrame:
    """Empty columns judged per file."""
    rows = ordered.read_mixed_folder(spark, _receptor_folder(spark, folder), block_bytes=BLOCK)
    return ordered.kept_columns(rows).select("file_name", F.array_join("kept", ", ").alias("kept_columns"))


@query
def w1_file_order(spark: SparkSession, folder: str) -> DataFrame:
    """Monitor names by the place of a row in its file, read in several blocks."""
    rows = tables.receptors_of(ordered.read_mixed_folder(spark, _receptor_folder(spark, folder), block_bytes=BLOCK))
    return R.monitor_ids_in_order(rows).select("file_name", "X", "Y", F.col(f"`{S.CONCENTRATION_HEADING}`").alias("conc"),
                                               F.col("Monitor Name").alias("monitor"))


@query
def s13_inventory_file(spark: SparkSession, folder: str) -> DataFrame:
    long = N.unpivot_inventory(emissions.read_inventory(spark, _as_csv(B.inventory(spark, folder))))
    return long.select("registry_id", "pollutant_name", "year", "pounds")


# --- tract concentrations ---------------------------------------------------------------


@query
def j1_points_in_tracts(spark: SparkSession, folder: str) -> DataFrame:
    shapes = staged(G.tract_shapes(B.tracts(spark, folder), geographic=False))
    sites = staged(G.merge_sites(B.points(spark, folder), SCENARIO))
    return rounded(G.tract_means(sites, shapes, SCENARIO), {"Avg_Conc": 8})


@query
def j1_point_matches(spark: SparkSession, folder: str) -> DataFrame:
    matched = G.points_in_tracts(B.points(spark, folder), B.tracts(spark, folder), geographic=False)
    return matched.select("pollutant", "condition", "longitude", "latitude", "Conc", "GEOID")


@query
def j2_nearest_receptor(spark: SparkSession, folder: str) -> DataFrame:
    shapes = staged(G.tract_shapes(B.tracts(spark, folder), geographic=False))
    sites = staged(G.merge_sites(B.points(spark, folder), SCENARIO))
    means = staged(G.tract_means(sites, shapes, SCENARIO))
    near = G.nearest_receptor(shapes, sites, SCENARIO, None, means.select(*SCENARIO, "GEOID"))
    return near.select(*SCENARIO, "GEOID", "distance", "x", "y",
                       F.col("first").alias("Nearest_Conc"))


@query
def j1_outline_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Concave outlines of up to 1,027 vertices, with holes and in two parts."""
    matched = G.points_in_tracts(B.outline_points(spark, folder), B.outlines(spark, folder))
    return matched.select("pollutant", "condition", "longitude", "latitude", "Conc", "GEOID")


@query
def g6_outline_distance(spark: SparkSession, folder: str) -> DataFrame:
    """Great-circle distance from outlines to the nearest receptor, in decimetres."""
    shapes = staged(G.tract_shapes(B.outlines(spark, folder)))
    sites = staged(G.merge_sites(B.outline_points(spark, folder), SCENARIO))
    means = staged(G.tract_means(sites, shapes, SCENARIO))
    near = G.nearest_receptor(shapes, sites, SCENARIO, None, means.select(*SCENARIO, "GEOID"), G.Sphere)
    return rounded(near.select(*SCENARIO, "GEOID", "distance", "x", "y", F.col("first").alias("Nearest_Conc")), {"distance": 1})


@query
def g7_outline_concentration(spark: SparkSession, folder: str) -> DataFrame:
    assigned = G.assign_concentration(B.outline_points(spark, folder), B.outlines(spark, folder), SCENARIO, columns=("TRACTCE",))
    return rounded(assigned, {"Final_Conc": 8})


@query
def g7_assign_concentration(spark: SparkSession, folder: str) -> DataFrame:
    assigned = G.assign_concentration(B.points(spark, folder), B.tracts(spark, folder), SCENARIO,
                                      geographic=False)
    return rounded(assigned, {"Final_Conc": 8})


@query
def g7_map_variant(spark: SparkSession, folder: str) -> DataFrame:
    one_file = B.points(spark, folder).filter((F.col("pollutant") == "PM") & (F.col("condition") == "Typical Controlled"))
    assigned = G.assign_concentration(
        one_file, B.tracts(spark, folder), ["pollutant"], geographic=False,
        columns=("TRACTCE", "NAME", "STUSPS", "NAMELSADCO", "polygons"))
    return rounded(assigned.withColumn("vertices", F.size(F.flatten(F.flatten("polygons")))).drop("polygons"),
                   {"Final_Conc": 8})


# --- demographics and rates -------------------------------------------------------------


@query
def r1_demographics_wide(spark: SparkSession, folder: str) -> DataFrame:
    return B.demographics_by_year(spark, folder)


@query
def j4_conc_demographics(spark: SparkSession, folder: str) -> DataFrame:
    joined = D.add_demographics(B.concentrations(spark, folder, "year"),
                                B.demographics_by_year(spark, folder, gaps=True), ["GEOID", "year"])
    return rounded(joined, {"Final_Conc": 8})


@query
def d3_vintages_as_of(spark: SparkSession, folder: str) -> DataFrame:
    """Releases with gaps of several years: each scenario year takes a tract's latest one not after it."""
    joined = D.add_demographics_as_of(B.concentrations(spark, folder, "year"), B.releases(spark, folder))
    return rounded(joined, {"Final_Conc": 8})


@query
def d3_vintages_within_two_years(spark: SparkSession, folder: str) -> DataFrame:
    joined = D.add_demographics_as_of(B.concentrations(spark, folder, "year"), B.releases(spark, folder), most_years=2)
    return joined.select("GEOID", "pollutant", "year", "vintage", "total_pop")


@query
def j4_unmatched_tracts(spark: SparkSession, folder: str) -> DataFrame:
    return D.unmatched_tracts(B.concentrations(spark, folder, "year"),
                              B.demographics_by_year(spark, folder, gaps=True), ["GEOID", "year"])


@query
def j5_conc_latest_demographics(spark: SparkSession, folder: str) -> DataFrame:
    joined = D.add_demographics(B.concentrations(spark, folder), B.demographics(spark, folder))
    return rounded(joined, {"Final_Conc": 8})


@query
def d2_county_of_tract(spark: SparkSession, folder: str) -> DataFrame:
    return B.tracts(spark, folder).groupBy(D.county_of(F.col("GEOID")).alias("county_fips")).agg(
        F.count(F.lit(1)).alias("tracts"))


@query
def j6_rates_left(spark: SparkSession, folder: str) -> DataFrame:
    air = B.concentrations(spark, folder, "year").withColumn("county_fips", D.county_of(F.col("GEOID")))
    rows = I.add_rates(air, B.rates(spark, folder, gaps=True), ["county_fips", "year"])
    return rounded(rows.select("GEOID", "pollutant", "year", "county_fips", "Final_Conc", *S.ENDPOINT_OF_RATE),
                   {"Final_Conc": 8})


@query
def j7_rates_latest_inner(spark: SparkSession, folder: str) -> DataFrame:
    air = B.concentrations(spark, folder).withColumn("county_fips", D.county_of(F.col("GEOID")))
    rows = I.add_rates(air, I.latest_rates(B.rates(spark, folder, gaps=True)), missing_rates="drop")
    return rounded(rows.select("GEOID", "pollutant", "condition", "county_fips", "Final_Conc", *S.ENDPOINT_OF_RATE),
                   {"Final_Conc": 8})


@query
def r2_unpivot_rates(spark: SparkSession, folder: str) -> DataFrame:
    return I.unpivot_rates(B.exposed(spark, folder).select("GEOID", "pollutant", "condition", *S.ENDPOINT_OF_RATE))


# --- cases and cost ---------------------------------------------------------------------

CASE_DIGITS = {"Final_Conc": 8, "beta": 10, "baseline_rate": 10, "additional_cases": 8}


def _cases(rows: DataFrame, scenario: str) -> DataFrame:
    return rounded(rows.select("county_fips", "GEOID", "TRACTCE", "NAMELSADCO", "pollutant", scenario,
                               "Final_Conc", *S.DEMOGRAPHICS, "endpoint", "rate", "RR", "beta",
                               "baseline_rate", "additional_cases"), CASE_DIGITS)


@query
def d8_tract_cases(spark: SparkSession, folder: str) -> DataFrame:
    return _cases(B.cases(spark, folder), "condition")


@query
def d8_tract_cases_by_year(spark: SparkSession, folder: str) -> DataFrame:
    return _cases(B.cases(spark, folder, "year"), "year")


@query
def d9_case_summary(spark: SparkSession, folder: str) -> DataFrame:
    summary = U.case_summary(B.cases(spark, folder), "condition")
    return U.in_display_order(rounded(summary, {"total_additional_cases": 6}), "pollutant", "endpoint", "condition")


@query
def d9_case_summary_by_year(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(U.case_summary(B.cases(spark, folder, "year"), "year"), {"total_additional_cases": 6})


def _priced(spark: SparkSession, folder: str, scenario: str = "condition") -> DataFrame:
    return U.cost_summary(B.cases(spark, folder, scenario), B.cost(spark), scenario)


@query
def d10_cost_table(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_priced(spark, folder), {"total_additional_cases": 6, "total_cost": 2})


@query
def d10_cost_by_pollutant(spark: SparkSession, folder: str) -> DataFrame:
    costs = U.cost_by(_priced(spark, folder), "pollutant", "condition")
    return U.in_display_order(rounded(costs, {"total_cost": 2}), "pollutant", "condition")


@query
def a4_cost_in_millions(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(U.cost_in_millions(_priced(spark, folder, "year"), "year"),
                   {"total_cost": 2, "total_cost_million": 6})


@query
def a9_subtotals(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(U.with_scenario_totals(_priced(spark, folder)), {"total_cost": 2, "total_cost_million": 6})


@query
def d16_control_ranges(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(U.control_ranges(_priced(spark, folder)), {"total_cost": 2, "total_cost_million": 6})


@query
def d17_endpoint_trend(spark: SparkSession, folder: str) -> DataFrame:
    trend = U.endpoint_trend(_priced(spark, folder, "year"))
    return U.in_display_order(rounded(trend, {"total_cases": 6}), "endpoint_rank", "year")


def _measures(values: list) -> list[str]:
    return [f"total_additional_cases_{v}" for v in values] + [f"total_cost_{v}" for v in values]


@query
def d18_damage_wide(spark: SparkSession, folder: str) -> DataFrame:
    wide = U.damage_wide(_priced(spark, folder), "condition", S.CONDITION_ORDER)
    return U.in_display_order(rounded(wide, {c: 6 for c in _measures(B.CONDITIONS)}), "pollutant_rank")


@query
def d18_damage_wide_by_year(spark: SparkSession, folder: str) -> DataFrame:
    wide = U.damage_wide(_priced(spark, folder, "year"), "year")
    return rounded(wide, {c: 6 for c in wide.columns if c.startswith("total_")})


@query
def r6_damage_display(spark: SparkSession, folder: str) -> DataFrame:
    return U.damage_display(U.damage_wide(_priced(spark, folder), "condition", S.CONDITION_ORDER))


@query
def d11_tract_cost(spark: SparkSession, folder: str) -> DataFrame:
    rows = B.tract_costs(spark, folder).select(
        "GEOID", "pollutant", "condition", "endpoint", "additional_cases", F.col("Economic Cost").alias("unit_cost"),
        "economic_cost")
    return rounded(rows, {"additional_cases": 8, "economic_cost": 2})


@query
def d14_county_damages(spark: SparkSession, folder: str) -> DataFrame:
    chosen = B.tract_costs(spark, folder).filter(F.col("condition") == "Typical Uncontrolled")
    return rounded(U.county_damages(B.counties(spark, folder), chosen), {"total_economic_cost": 2})


@query
def d14_county_damages_of_year(spark: SparkSession, folder: str) -> DataFrame:
    chosen = B.tract_costs(spark, folder, "year").filter(F.col("year") == B.COPIED[1])
    return rounded(U.county_damages(B.counties(spark, folder), chosen), {"total_economic_cost": 2})


def _city_tracts(spark: SparkSession, folder: str) -> DataFrame:
    return B.tracts(spark, folder).filter(F.col("county_fips") == B.CITY).select("GEOID", "NAME", "NAMELSADCO")


@query
def d15_county_tracts(spark: SparkSession, folder: str) -> DataFrame:
    chosen = B.tract_costs(spark, folder).filter(F.col("condition") == "Typical Uncontrolled")
    return rounded(U.tract_damages(_city_tracts(spark, folder), chosen, B.CITY), {"total_economic_cost": 2})


@query
def d12_savings(spark: SparkSession, folder: str) -> DataFrame:
    savings = U.scenario_savings(B.tract_costs(spark, folder))
    return rounded(savings, {f"economic_cost_{c}": 2 for c in B.CONDITIONS} | {"delta_economic_cost": 2})


@query
def d13_savings_map(spark: SparkSession, folder: str) -> DataFrame:
    rows = U.county_savings_rows(B.counties(spark, folder), U.scenario_savings(B.tract_costs(spark, folder)))
    return rounded(rows.select("NAMELSAD", "NAME", "GEOID", "delta_economic_cost"), {"delta_economic_cost": 2})


@query
def d13_county_savings(spark: SparkSession, folder: str) -> DataFrame:
    rows = U.county_savings(B.counties(spark, folder), U.scenario_savings(B.tract_costs(spark, folder)))
    return rounded(rows, {"delta_economic_cost": 2})


@query
def d13_tract_savings(spark: SparkSession, folder: str) -> DataFrame:
    rows = U.tract_savings(_city_tracts(spark, folder), U.scenario_savings(B.tract_costs(spark, folder)))
    return rounded(rows, {"delta_economic_cost": 2})


@query
def k_math4_plot_scales(spark: SparkSession, folder: str) -> DataFrame:
    chosen = B.tract_costs(spark, folder).filter(F.col("condition") == "Typical Uncontrolled")
    costs = U.county_damages(B.counties(spark, folder), chosen)
    total = F.col("total_economic_cost")
    return rounded(costs.select(
        "GEOID", U.map_value(total, 40.0).alias("county_colour"), U.map_value(total, 1.3).alias("tract_colour"),
        F.when(total > 0, U.map_value(total, None, "log10")).alias("log_millions")),
        {"county_colour": 8, "tract_colour": 8, "log_millions": 8})


# --- disparity --------------------------------------------------------------------------


@query
def d19_vulnerability(spark: SparkSession, folder: str) -> DataFrame:
    rows = V.vulnerability_table(B.cases(spark, folder), B.svi(spark, folder))
    return rounded(rows.select("FIPS", "pollutant", "condition", "endpoint", "additional_cases",
                               *S.SVI_RANKS.values(), *S.INDICATORS), {"additional_cases": 8})


@query
def j15_svi_by_tract(spark: SparkSession, folder: str) -> DataFrame:
    return V.svi_by_tract(_city_tracts(spark, folder), V.svi_of_exposed(B.exposed(spark, folder), B.svi(spark, folder)))


@query
def d20_scaled_cases(spark: SparkSession, folder: str) -> DataFrame:
    rows = V.mortality_rows(B.vulnerability(spark, folder))
    return rounded(rows.select("FIPS", "pollutant", "condition", "scaled_cases"), {"scaled_cases": 6})


@query
def a12_tract_condition(spark: SparkSession, folder: str) -> DataFrame:
    pooled = V.pooled_tracts(B.vulnerability(spark, folder))
    return rounded(pooled, {"total_scaled_cases": 3, "Final_Conc": 8, "total_pop": 6} | {c: 6 for c in S.INDICATORS})


FIT_DIGITS = {c: 6 for c in ("estimate", "std_error", "statistic", "conf_low", "conf_high")}


def _univariate(spark: SparkSession, folder: str) -> DataFrame:
    rows = V.mortality_rows(B.vulnerability(spark, folder))
    return M.univariate_fits(rows, SCENARIO, "scaled_cases", S.INDICATORS)


def _theme_rows(spark: SparkSession, folder: str) -> DataFrame:
    return V.mortality_rows(B.vulnerability_themes(spark, folder))


def _themes(spark: SparkSession, folder: str) -> DataFrame:
    """Ratios of the theme ranks, from which formatting, selection and the joint models go on."""
    fits = M.univariate_fits(_theme_rows(spark, folder), SCENARIO, "scaled_cases", S.THEME_RANKS)
    return M.add_interval(fits, exponentiate=True)


def _pooled(spark: SparkSession, folder: str) -> DataFrame:
    return M.univariate_fits(V.pooled_tracts(B.vulnerability(spark, folder)), ["condition"],
                             "total_scaled_cases", S.INDICATORS)


@query
def t1_univariate(spark: SparkSession, folder: str) -> DataFrame:
    fits = M.add_interval(_univariate(spark, folder), with_p=False)
    return rounded(fits, FIT_DIGITS | {"intercept": 6})


@query
def t1_p_values(spark: SparkSession, folder: str) -> DataFrame:
    fits = M.add_interval(_univariate(spark, folder))
    return rounded(fits.select(*SCENARIO, "svi_variable", "p_value", "df"), {"p_value": 9})


@query
def t2_themes(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_themes(spark, folder).select(
        *SCENARIO, "svi_variable", "estimate", "conf_low", "conf_high", "p_value", "df"),
        {"estimate": 7, "conf_low": 7, "conf_high": 7, "p_value": 9})


@query
def t3_unstratified(spark: SparkSession, folder: str) -> DataFrame:
    fits = M.add_interval(_pooled(spark, folder), with_p=False)
    return rounded(fits, {c: 4 for c in FIT_DIGITS} | {"intercept": 4})


@query
def t5_selected(spark: SparkSession, folder: str) -> DataFrame:
    chosen = M.significant(_themes(spark, folder), SCENARIO)
    return M.selected_lists(chosen, SCENARIO).withColumn("svi_variables", F.array_join("svi_variables", " + "))


@query
def t5_selected_indicators(spark: SparkSession, folder: str) -> DataFrame:
    chosen = M.significant(M.add_interval(_univariate(spark, folder)), SCENARIO)
    return M.selected_lists(chosen, SCENARIO).withColumn("svi_variables", F.array_join("svi_variables", " + "))


@query
def a14_selected_map(spark: SparkSession, folder: str) -> DataFrame:
    chosen = M.significant(_themes(spark, folder), SCENARIO)
    maps = M.selection_map(chosen, "pollutant", "condition")
    text = F.transform(F.map_entries("condition_lists"), lambda e: F.concat(
        e["key"], F.lit(": "), F.array_join(e["value"], " + ")))
    return maps.select("pollutant", F.array_join(text, "; ").alias("condition_lists"))


def _joint(rows: DataFrame, variables: list[str]) -> DataFrame:
    rows = staged(rows.select(*SCENARIO, "scaled_cases", *variables, "Final_Conc"))
    fitted = M.univariate_fits(rows, SCENARIO, "scaled_cases", variables)
    chosen = M.selected_lists(M.significant(M.add_interval(fitted), SCENARIO), SCENARIO)
    fits = M.multivariate_fits(rows, SCENARIO, "scaled_cases", variables, ["Final_Conc"], chosen, False)
    return rounded(M.add_interval(fits), FIT_DIGITS | {"p_value": 9})


@query
def t6_multivariate(spark: SparkSession, folder: str) -> DataFrame:
    return _joint(_theme_rows(spark, folder), S.THEME_RANKS)


@query
def t6_multivariate_indicators(spark: SparkSession, folder: str) -> DataFrame:
    return _joint(V.mortality_rows(B.vulnerability(spark, folder)), S.INDICATORS)


def _pooled_multivariate(spark: SparkSession, folder: str) -> DataFrame:
    rows = staged(V.pooled_tracts(B.vulnerability(spark, folder)))
    fitted = M.univariate_fits(rows, ["condition"], "total_scaled_cases", S.INDICATORS)
    chosen = M.selected_lists(M.significant(M.add_interval(fitted), ["condition"]), ["condition"])
    fits = M.multivariate_fits(rows, ["condition"], "total_scaled_cases", S.INDICATORS,
                               ["Final_Conc", "total_pop"], chosen, True)
    return M.add_interval(fits)


@query
def t7_multivariate(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_pooled_multivariate(spark, folder), {c: 4 for c in FIT_DIGITS} | {"p_value": 9})


@query
def t9_coefficient_plot(spark: SparkSession, folder: str) -> DataFrame:
    terms = V.coefficient_table(_pooled_multivariate(spark, folder))
    return rounded(terms.select("condition", "term", "clean_term", "svi_theme", "theme_rank", "term_position",
                                "estimate", "conf_low", "conf_high"),
                   {"estimate": 4, "conf_low": 4, "conf_high": 4})


@query
def t10_formatted(spark: SparkSession, folder: str) -> DataFrame:
    return V.formatted_results(_themes(spark, folder), ["pollutant"])


@query
def t10_formatted_indicators(spark: SparkSession, folder: str) -> DataFrame:
    return V.formatted_results(M.add_interval(_univariate(spark, folder)), ["pollutant"])


@query
def t10_formatted_pooled(spark: SparkSession, folder: str) -> DataFrame:
    return V.formatted_results(M.add_interval(_pooled(spark, folder)), [])


@query
def k_str6_number_text(spark: SparkSession, folder: str) -> DataFrame:
    parts = B.table(spark, folder, "part").select("p_partkey", (F.col("p_retailprice") / 8).alias("v"))
    return parts.select("p_partkey", number_text(F.col("v"), 3).alias("text"),
                        fixed_text(F.when(F.col("p_partkey") % 5 != 0, F.col("v")), 2, "XX").alias("fixed"))


# --- inventory and run audits -----------------------------------------------------------


@query
def x1_inventory_long(spark: SparkSession, folder: str) -> DataFrame:
    return N.unpivot_inventory(B.inventory(spark, folder))


@query
def x2_x3_criteria_tons(spark: SparkSession, folder: str) -> DataFrame:
    return N.criteria_summary(N.unpivot_inventory(B.inventory(spark, folder)))


@query
def x3_particulate_total(spark: SparkSession, folder: str) -> DataFrame:
    return N.particulate_total(N.criteria_summary(N.unpivot_inventory(B.inventory(spark, folder))))


def _manifest(lines: DataFrame) -> DataFrame:
    keys = P.run_keys(F.col("file_name"))
    return lines.select("file_name").distinct().select(
        "file_name", *[value.alias(name) for name, value in keys.items()])


@query
def x4_run_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return _manifest(B.run_lines(spark, folder))


@query
def x5_run_completeness(spark: SparkSession, folder: str) -> DataFrame:
    lines = staged(B.run_lines(spark, folder).unionByName(B.full_year_lines(spark, folder)))
    return A.run_completeness(P.run_days(lines))


@query
def x5_run_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return A.run_gaps(P.run_days(B.run_lines(spark, folder)))


@query
def x6_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return A.missing_runs(_manifest(B.run_lines(spark, folder)))


@query
def x7_site_characteristics(spark: SparkSession, folder: str) -> DataFrame:
    lines = staged(B.site_lines(spark, folder))
    return A.site_characteristics(P.sector_bounds(lines), P.site_values(lines))


@query
def x8_annual_roughness(spark: SparkSession, folder: str) -> DataFrame:
    monthly = P.monthly_roughness(staged(B.month_lines(spark, folder)))
    return rounded(A.annual_roughness(monthly, P.site_values(staged(B.site_lines(spark, folder)))), {"monthly_mean": 6})


@query
def x8_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Two tables of one layout, told apart by the heading above them."""
    path = scratch_path(spark)
    B.section_lines(spark, folder).write.partitionBy("stem").text(path)
    lines = staged(ordered.with_section(ordered.ordered_lines(spark, path, block_bytes=BLOCK), P.SECTION_LINE))
    tables_ = [P.monthly_roughness(lines.filter(F.col("section") == name).drop("section")).withColumn("section", F.lit(name))
               for name in (P.MONTHLY_SECTION, P.FETCH_SECTION)]
    return tables_[0].unionByName(tables_[1]).select("section", "site", "year", "sector", "month", "roughness")


@query
def x9_cover_check(spark: SparkSession, folder: str) -> DataFrame:
    return A.cover_check(P.cover_counts(staged(B.cover_lines(spark, folder))))


@query
def x10_roughness_change(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(A.roughness_change(P.site_values(B.site_lines(spark, folder))), {"change": 6})


@query
def x11_sector(spark: SparkSession, folder: str) -> DataFrame:
    return A.wind_sector(B.readings(spark, folder), B.sectors(spark))


@query
def x12_warnings(spark: SparkSession, folder: str) -> DataFrame:
    return P.warnings(B.warning_lines(spark, folder))


@query
def x13_flow_audit(spark: SparkSession, folder: str) -> DataFrame:
    audit = A.flow_audit(P.downwash_events(B.downwash_lines(spark, folder)))
    return audit.withColumn("missing_flows", F.array_join("missing_flows", ","))


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """What each pollutant costs under each operating condition."""
    return d10_cost_by_pollutant(spark, folder)
