"""Logical tables over the star-schema test tables.

The health tables themselves are not part of the test data, so every query reads them through
these views: customers stand for census tracts, line items for receptor readings, nations for
counties, events for run logs. The values are invented. All arithmetic is on integers or plain
doubles, so that it means the same in any engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airtoll import schemas as S
from airtoll.operators import demographics as D
from airtoll.operators import impact as I
from airtoll.operators.disparity import vulnerability_table
from airtoll.sources import reports as P

YEARS = list(range(1995, 2002))
COPIED = (2000, 2001)
CONDITIONS = [*S.CONDITION_ORDER, "Idle Controlled"]  # the last one is in no display order
CITY = "00003"  # county of the tract-level maps

# (pollutant, endpoint, relative risk); several pairs are left out on purpose
RISKS = [
    ("PM", "All-cause mortality", 1.008), ("PM", "Diabetes", 1.01), ("PM", "Respiratory Tract Cancer", 1.014),
    ("PM", "Stroke", 1.013), ("PM", "Ischemic heart disease", 1.023),
    ("PM", "Chronic obstructive pulmonary disease", 1.018),
    ("NOx", "All-cause mortality", 1.02), ("NOx", "Diabetes", 1.0), ("NOx", "Asthma", 1.06),
    ("NOx", "Chronic obstructive pulmonary disease", 0.99),
    ("SO2", "All-cause mortality", 1.005), ("SO2", "Stroke", 1.01), ("SO2", "Ischemic heart disease", 1.012),
    ("SO2", "Respiratory Tract Cancer", 1.02), ("CO", "All-cause mortality", 1.001),
]
COSTS = [
    ("All-cause mortality", 9500000.0), ("Diabetes", 210000.0), ("Respiratory Tract Cancer", 160000.0),
    ("Stroke", 140000.0), ("Asthma", 38000.0), ("Ischemic heart disease", 120000.0),
]
SVI_PRIMES = [7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59, 61, 67, 71, 73, 79, 83, 89]
INVENTORY_YEARS = [str(year + 24) for year in YEARS]  # partly outside the declared years
INVENTORY_NAMES = [*S.CRITERIA_OF_INVENTORY, "Cadmium", "Nickel"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dealt_customers(spark: SparkSession, folder: str) -> DataFrame:
    """Customers dealt to the configured number of tasks: a table of few bytes is one split, whatever is unfolded from its rows."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return table(spark, folder, "customer").select("c_custkey", "c_nationkey").repartition(parts, "c_custkey")


def padded(column: str, width: int) -> Column:
    return F.lpad(F.col(column).cast("string"), width, "0")


def pollutant() -> Column:
    return F.when(F.col("l_returnflag") == "A", "PM").when(F.col("l_returnflag") == "N", "NOx").otherwise("SO2")


def condition() -> Column:
    operations = F.when(F.col("l_linenumber") % 3 == 0, "Max").otherwise("Typical")
    controls = F.when(F.col("l_linestatus") == "F", "Controlled").otherwise("Uncontrolled")
    return F.concat_ws(" ", operations, controls)


def geoid() -> Column:
    """County and tract number; tracts beyond a million get longer ids."""
    return F.format_string("%05d%06d", "c_nationkey", "c_custkey")


def level() -> Column:
    return F.abs("l_discount") * 100


# --- geography --------------------------------------------------------------------------


def tracts(spark: SparkSession, folder: str) -> DataFrame:
    """One unit square per customer, fifty to a row; every 97th tract has no shape. Some counties share a name."""
    x, y = (F.col("c_custkey") % 50).cast("double"), F.floor(F.col("c_custkey") / 50).cast("double")
    corners = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]
    ring = F.array(*[F.struct((x + dx).alias("x"), (y + dy).alias("y")) for dx, dy in corners])
    return dealt_customers(spark, folder).select(
        geoid().alias("GEOID"), F.format_string("%06d", "c_custkey").alias("TRACTCE"),
        (F.col("c_custkey") % 1000).cast("string").alias("NAME"),
        F.concat(F.lit("County "), (F.col("c_nationkey") % 20).cast("string")).alias("NAMELSADCO"),
        padded("c_nationkey", 2).alias("STATEFP"),
        F.when(F.col("c_nationkey") % 2 == 0, "MD").otherwise("DC").alias("STUSPS"),
        padded("c_nationkey", 5).alias("county_fips"),
        F.when(F.col("c_custkey") % 97 != 0, F.array(F.array(ring))).alias("polygons"), "c_custkey")


#: Outlines: degrees of a tract's cell, cells in a row, corner of the first one, rows.
OUTLINE_CELL, OUTLINE_COLUMNS, OUTLINE_LON, OUTLINE_LAT, OUTLINE_ROWS = 1 / 128, 64, -77.0, 10.0, 8192


def outlines(spark: SparkSession, folder: str) -> DataFrame:
    """Tracts in degrees with outlines as real ones have: combs of 67 and, every fiftieth, of 1,027 vertices, squares
    with a hole, two squares apart; every 97th has no shape."""
    k = F.col("c_custkey")

    def corner(x: Column, y: Column) -> Column:
        return F.struct((F.lit(OUTLINE_LON) + (k % OUTLINE_COLUMNS + x) * OUTLINE_CELL).alias("x"),
                        (F.lit(OUTLINE_LAT) + (F.floor(k / OUTLINE_COLUMNS) % OUTLINE_ROWS + y) * OUTLINE_CELL).alias("y"))

    def box(x0: float, x1: float, y0: float, y1: float) -> Column:
        return F.array(*[corner(F.lit(x), F.lit(y)) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))])

    teeth = F.when(k % 50 == 0, 256).otherwise(16)
    pitch = F.lit(0.75) / teeth
    comb = F.transform(F.sequence(F.lit(0), teeth * 4 - 1), lambda v: corner(
        F.lit(0.125) + F.floor(v / 4) * pitch + v % 4 * pitch / 4, F.when((v % 4).isin(1, 2), 0.875).otherwise(0.5)))
    comb = F.concat(comb, F.array(*[corner(F.lit(x), F.lit(y)) for x, y in ((0.875, 0.5), (0.875, 0.125), (0.125, 0.125))]))
    pierced = F.array(F.array(box(0.125, 0.875, 0.125, 0.875), box(0.375, 0.625, 0.375, 0.625)))
    apart = F.array(F.array(box(0.125, 0.375, 0.125, 0.875)), F.array(box(0.625, 0.875, 0.125, 0.875)))
    shape = F.when(k % 3 == 0, F.array(F.array(comb))).when(k % 3 == 1, pierced).otherwise(apart)
    return dealt_customers(spark, folder).select(
        geoid().alias("GEOID"), F.format_string("%06d", "c_custkey").alias("TRACTCE"), F.when(k % 97 != 0, shape).alias("polygons"))


def outline_points(spark: SparkSession, folder: str) -> DataFrame:
    """Readings in degrees, in every second column of the lower rows of outlines."""
    item = table(spark, folder, "lineitem")
    x = 2 * (F.col("l_partkey") % 32) + (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13) % 1000 / 1000.0 + F.lit(0.0005)
    y = (F.col("l_suppkey") * 3 + F.col("l_partkey")) % 20 + (F.col("l_orderkey") * 11 + F.col("l_suppkey") * 17) % 1000 / 1000.0 + F.lit(0.0005)
    known = (F.col("l_orderkey") + F.col("l_linenumber")) % 37 != 0
    return item.select(pollutant().alias("pollutant"), condition().alias("condition"),
                       (F.lit(OUTLINE_LON) + x * OUTLINE_CELL).alias("longitude"), (F.lit(OUTLINE_LAT) + y * OUTLINE_CELL).alias("latitude"),
                       F.when(known, level()).alias("Conc"))


def boundary_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Tracts as in a boundary file: the shape as well-known text, two vintages."""
    ring = F.array_join(F.transform(F.col("polygons")[0][0], lambda v: F.concat_ws(" ", v["x"], v["y"])), ", ")
    shape = F.when(F.col("polygons").isNotNull(), F.concat(F.lit("POLYGON (("), ring, F.lit("))")))
    return tracts(spark, folder).select(
        "GEOID", "TRACTCE", "NAME", "NAMELSADCO", "STATEFP", "STUSPS", shape.alias("geometry"),
        F.explode(F.array(F.lit(2010), F.lit(2021))).alias("vintage"))


def counties(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").select(
        padded("n_nationkey", 5).alias("GEOID"), F.col("n_name").alias("NAME"),
        F.concat(F.lit("County "), (F.col("n_nationkey") % 20).cast("string")).alias("NAMELSAD"))


def points(spark: SparkSession, folder: str) -> DataFrame:
    """Readings in every second column of the lower rows, so that many tracts stay empty."""
    item = table(spark, folder, "lineitem")
    x = (2 * (F.col("l_partkey") % 20) + (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13) % 1000 / 1000.0
         + F.lit(0.0005))
    y = ((F.col("l_suppkey") * 3 + F.col("l_partkey")) % 20
         + (F.col("l_orderkey") * 11 + F.col("l_suppkey") * 17) % 1000 / 1000.0 + F.lit(0.0005))
    known = (F.col("l_orderkey") + F.col("l_linenumber")) % 37 != 0
    return item.select(pollutant().alias("pollutant"), condition().alias("condition"),
                       x.alias("longitude"), y.alias("latitude"), F.when(known, level()).alias("Conc"))


def receptors(spark: SparkSession, folder: str) -> DataFrame:
    """Raw UTM grids, one file per year and pollutant, with a column that is empty."""
    item = table(spark, folder, "lineitem")
    name = F.concat(F.lit("Plant "), F.year("l_shipdate").cast("string"), F.lit(" "), pollutant(), F.lit(" Annual.csv"))
    return item.select(
        (350000 + F.col("l_partkey") * 37 % 20000 + F.col("l_linenumber") * F.lit(0.25)).alias("X"),
        (4340000 + F.col("l_orderkey") * 13 % 20000 + F.col("l_suppkey") % 2 * F.lit(0.5)).alias("Y"),
        level().alias(S.CONCENTRATION_HEADING), F.lit(None).cast("string").alias("ZELEV"), name.alias("file_name"))


#: Columns of receptor files by year modulo three, in their order.
LAYOUTS = [["X", "Y", S.CONCENTRATION_HEADING, "ZELEV"], [S.CONCENTRATION_HEADING, "ZELEV", "Y", "X", "NOTE"], ["Y", "NOTE", "X"]]


def receptor_files(spark: SparkSession, folder: str) -> list[DataFrame]:
    """Raw grids as files of three layouts, rows in the order of the items: columns in other places, missing, further ones.

    Of the second layout's files, those of one pollutant have notes; the elevation is empty everywhere.
    """
    item = table(spark, folder, "lineitem")
    stem = F.concat(F.lit("Plant "), F.year("l_shipdate").cast("string"), F.lit(" "), pollutant(), F.lit(" Annual"))
    note = F.when((pollutant() == "PM") | (F.year("l_shipdate") % 3 == 2), F.concat(F.lit("row, "), F.col("l_linenumber").cast("string")))
    rows = item.select(
        (350000 + F.col("l_partkey") * 37 % 20000 + F.col("l_linenumber") * F.lit(0.25)).alias("X"),
        (4340000 + F.col("l_orderkey") * 13 % 20000 + F.col("l_suppkey") % 2 * F.lit(0.5)).alias("Y"),
        level().alias(S.CONCENTRATION_HEADING), F.lit(None).cast("string").alias("ZELEV"), note.alias("NOTE"),
        F.year("l_shipdate").alias("year"), F.coalesce(stem, F.lit("")).alias("stem"), "l_orderkey", "l_linenumber")
    order = ["stem", "l_orderkey", "l_linenumber", "X", "Y", F.col(f"`{S.CONCENTRATION_HEADING}`")]
    return [rows.filter(F.col("year") % 3 == i).repartition("stem").sortWithinPartitions(*order).select(
        *[F.col(f"`{c}`") for c in columns], "stem") for i, columns in enumerate(LAYOUTS)]


def places(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").select(
        F.col("s_name").alias("place"),
        (F.lit(-76.9) + F.col("s_suppkey") * 7 % 100 / 250.0).alias("longitude"),
        (F.lit(39.15) + F.col("s_suppkey") * 13 % 100 / 400.0).alias("latitude"))


# --- exposure and health ----------------------------------------------------------------


def concentrations(spark: SparkSession, folder: str, scenario: str = "condition") -> DataFrame:
    """One concentration per customer, pollutant and condition or year; one condition is in no display order."""
    item = table(spark, folder, "lineitem")
    key = F.when(F.col("l_linenumber") % 7 == 0, CONDITIONS[-1]).otherwise(condition()) if scenario == "condition" else F.year("l_shipdate")
    owner = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    readings = item.select("l_orderkey", pollutant().alias("pollutant"), key.alias(scenario), level().alias("Conc"))
    means = readings.join(owner, "l_orderkey").groupBy(
        F.col("o_custkey").alias("c_custkey"), "pollutant", scenario).agg(F.avg("Conc").alias("Final_Conc"))
    attributes = tracts(spark, folder).select("c_custkey", "GEOID", "TRACTCE", "NAME", "NAMELSADCO", "STATEFP")
    # a row per tract, whose size can't be told from the compressed file: not for a broadcast
    return means.join(attributes.hint("merge"), "c_custkey").drop("c_custkey")


def demographics_long(spark: SparkSession, folder: str, gaps: bool = False) -> DataFrame:
    """Long rows for 1995-2000; some tracts have no population and, with gaps, every 101st has no rows."""
    key = F.col("c_custkey")
    estimates = {
        "total_pop": F.when(key % 29 != 0, 1000 + key % 5000 + (F.col("year") - 1995) * 10),
        "white": key * 7 % 3000, "black": key * 11 % 2000, "asian": key * 13 % 500,
        "hispanic": key * 17 % 700, "median_income": 30000 + key * 19 % 90000,
    }
    rows = F.array(*[F.struct(F.lit(name).alias("variable"), value.cast("double").alias("estimate"),
                              F.lit(5.0).alias("moe")) for name, value in estimates.items()])
    customers = dealt_customers(spark, folder)
    customers = customers.filter(key % 101 != 0) if gaps else customers
    vintages = customers.select(
        "c_custkey", "c_nationkey", F.explode(F.array(*[F.lit(y) for y in YEARS[:-1]])).alias("year"))
    return vintages.select(geoid().alias("GEOID"),
                           F.concat(F.lit("Tract "), key.cast("string")).alias("NAME"), "year", F.inline(rows))


def demographics_wide(spark: SparkSession, folder: str) -> DataFrame:
    """The 2000 vintage in the wide form, estimates ending in E and margins in M."""
    wide = D.widen_demographics(demographics_long(spark, folder).filter(F.col("year") == COPIED[0])).drop("year")
    margins = {f"{name}M": F.lit(5.0) for name in S.DEMOGRAPHICS}
    return wide.withColumnsRenamed({name: f"{name}E" for name in S.DEMOGRAPHICS}).withColumns(margins)


def demographics(spark: SparkSession, folder: str) -> DataFrame:
    return D.strip_estimate_suffix(D.drop_margins(demographics_wide(spark, folder)))


def demographics_by_year(spark: SparkSession, folder: str, gaps: bool = False) -> DataFrame:
    return D.copy_vintage(D.widen_demographics(demographics_long(spark, folder, gaps)), *COPIED)


def releases(spark: SparkSession, folder: str) -> DataFrame:
    """Demographics as they are released: of the years of a tract about every third, some tracts from 1998 on only."""
    released = (F.col("key") * 7 + F.col("year") * 11) % 13 < 4
    late = (F.col("key") % 5 != 0) | (F.col("year") >= 1998)
    wide = D.widen_demographics(demographics_long(spark, folder, gaps=True)).withColumn("key", F.substring("NAME", 7, 20).cast("long"))
    return wide.filter(released & late).drop("key")


def rates(spark: SparkSession, folder: str, gaps: bool = False) -> DataFrame:
    """Text rates per nation and year; nation 11 has an unreadable one and, with gaps, nation 7 none."""
    n, step = F.col("n_nationkey"), F.col("year") - 1995
    values = {
        "mortality_rate": 700 + 10 * n + step, "diabetes_rate": 90 + n + step, "cancer_rate": 50 + 2 * n,
        "stroke_rate": 40 + n, "asthma_rate": 60 + n, "ihd_rate": 120 + 3 * n, "copd_rate": 30 + n,
    }
    nations = table(spark, folder, "nation")
    nations = (nations.filter(n != 7) if gaps else nations).select(
        "n_nationkey", F.explode(F.array(*[F.lit(y) for y in YEARS])).alias("year"))
    text = {name: value.cast("string") for name, value in values.items()}
    text["asthma_rate"] = F.when(n == 11, "NA").otherwise(text["asthma_rate"])
    return nations.select(padded("n_nationkey", 5).alias("county_fips"), "year",
                          *[value.alias(name) for name, value in text.items()])


def literal(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """Inline table; unlike a parallelised list its size is known to the optimizer."""
    values = ", ".join("(" + ", ".join(
        f"'{v}'" if isinstance(v, str) else f"{v!r}D" if isinstance(v, float) else str(v) for v in row) + ")"
        for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({names})")


def risk(spark: SparkSession) -> DataFrame:
    return literal(spark, RISKS, "pollutant, endpoint, RR")


def cost(spark: SparkSession) -> DataFrame:
    return literal(spark, COSTS, "`Health Endpoint`, `Economic Cost`")


def _endpoint() -> Column:
    return F.element_at(F.array(*[F.lit(e) for e in S.ENDPOINT_OF_RATE.values()]), (F.col("l_linenumber") % len(S.ENDPOINT_OF_RATE) + 1).cast("int"))


def risk_sheet(spark: SparkSession, folder: str) -> DataFrame:
    """A sheet of relative risks by pollutant and endpoint, some unreadable, as text."""
    rows = table(spark, folder, "lineitem").groupBy(pollutant().alias("pollutant"), _endpoint().alias("Health Endpoint")).agg(F.sum("l_partkey").alias("s"))
    value = F.when(F.col("s") % 7 == 0, "NA").otherwise((1 + F.col("s") % 40 / 1000.0).cast("string"))
    return rows.select("pollutant", "Health Endpoint", value.alias(S.RISK_HEADING), F.concat(F.lit("study, "), (F.col("s") % 9).cast("string")).alias("RR Source"))


def cost_sheet(spark: SparkSession, folder: str) -> DataFrame:
    """A sheet of unit costs by endpoint, columns in another order than declared."""
    rows = table(spark, folder, "lineitem").groupBy(_endpoint().alias("Health Endpoint")).agg(F.sum("l_suppkey").alias("s"))
    return rows.select(F.lit("table").alias("Source"), (F.col("s") % 1000000 / 4.0).alias("Economic Cost"), "Health Endpoint")


def county_texts(spark: SparkSession, folder: str) -> DataFrame:
    """County outlines as well-known text, two parts where the key is odd."""
    n = F.col("n_nationkey")

    def square(x: Column) -> Column:
        corners = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
        return F.concat(F.lit("(("), F.concat_ws(", ", *[F.concat_ws(" ", (x + dx).cast("string"), F.lit(f"{dy}.5")) for dx, dy in corners]), F.lit("))"))

    shape = F.when(n % 2 == 1, F.concat(F.lit("MULTIPOLYGON ("), square(n * 3), F.lit(", "), square(n * 3 + 10), F.lit(")"))).otherwise(
        F.concat(F.lit("POLYGON "), square(n * 3)))
    return table(spark, folder, "nation").select(
        padded("n_nationkey", 5).alias("GEOID"), F.col("n_name").alias("NAME"), F.concat(F.lit("County "), n.cast("string")).alias("NAMELSAD"),
        padded("n_regionkey", 2).alias("STATEFP"), shape.alias("geometry"), F.explode(F.array(F.lit(2010), F.lit(2021))).alias("vintage"))


def sectors(spark: SparkSession) -> DataFrame:
    """Twelve sectors of 30 degrees, turned by 15 so that one passes north."""
    return literal(spark, [(i + 1, (i * 30 + 345.0) % 360, (i * 30 + 15.0) % 360) for i in range(12)],
                   "sector, start_dir, end_dir")


def exposed(spark: SparkSession, folder: str, scenario: str = "condition") -> DataFrame:
    """Concentrations with demographics and baseline rates, for either scenario key."""
    air = concentrations(spark, folder, scenario)
    if scenario == "year":
        people = D.add_demographics(air, demographics_by_year(spark, folder), ["GEOID", "year"])
        return I.add_rates(people, rates(spark, folder), ["county_fips", "year"])
    people = D.add_demographics(air, demographics(spark, folder))
    return I.add_rates(people, I.latest_rates(rates(spark, folder)), missing_rates="drop")


def cases(spark: SparkSession, folder: str, scenario: str = "condition") -> DataFrame:
    return I.tract_cases(exposed(spark, folder, scenario), risk(spark))


def tract_costs(spark: SparkSession, folder: str, scenario: str = "condition") -> DataFrame:
    return I.add_unit_cost(cases(spark, folder, scenario), cost(spark))


# --- vulnerability ----------------------------------------------------------------------


def svi(spark: SparkSession, folder: str) -> DataFrame:
    """Five ranks and sixteen percentages; -999 in one indicator or in the overall rank."""
    key = F.col("c_custkey")
    columns = []
    for i, (name, prime) in enumerate(zip((*S.SVI_RANKS, *S.SVI_INDICATORS), SVI_PRIMES, strict=True)):
        value = key * prime % 1000 / (1000.0 if i < len(S.SVI_RANKS) else 10.0)
        if name == "EP_UNEMP":
            value = F.when(key % 17 == 0, -999.0).otherwise(value)
        if name == "RPL_THEMES":
            value = F.when(key % 23 == 0, -999.0).otherwise(value)
        columns.append(value.alias(name))
    return table(spark, folder, "customer").select(geoid().alias("FIPS"), *columns)


def vulnerability(spark: SparkSession, folder: str) -> DataFrame:
    """Cases with vulnerability; two indicators push the outcome, so that slopes are not noise."""
    rows = vulnerability_table(cases(spark, folder), svi(spark, folder))
    pushed = (F.col("additional_cases") + F.col("Pct_Below_150_Poverty") * 0.001
              + F.col("Pct_Minority") * 0.0005)
    return rows.withColumn("additional_cases", pushed)


def vulnerability_themes(spark: SparkSession, folder: str) -> DataFrame:
    """Cases so small that ratios stay finite; two theme ranks push them."""
    rows = vulnerability_table(cases(spark, folder), svi(spark, folder))
    pushed = F.col("additional_cases") * 0.0001 + F.col("SVI_SES") * 0.0005 + F.col("SVI_HTT") * 0.0003
    return rows.withColumn("additional_cases", pushed)


# --- text reports -----------------------------------------------------------------------


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    """Events with the run they belong to; facility spelling varies in case."""
    user = F.col("user_id")
    site = F.concat(F.when(user % 3 == 0, "SITE").otherwise("Site"), (user % 10).cast("string"))
    scenario = F.element_at(F.array(*[F.lit(c) for c in S.CONDITION_ORDER]), (F.floor(user / 10) % 4 + 1).cast("int"))
    measured = F.element_at(F.array(*[F.lit(p) for p in S.POLLUTANT_ORDER]), (F.floor(user / 40) % 4 + 1).cast("int"))
    return table(spark, folder, "events").withColumn("run", F.concat_ws(" ", site, scenario, measured))


def run_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Dispersion run logs: a day line per event, a closing line per signup."""
    day = F.format_string("+Now Processing Data For Day No. %4d of %d", F.dayofyear("ts"), F.year("ts"))
    closing = F.when(F.col("event_type") == "signup", F.lit("+Now Processing Output Options"))
    lines = F.explode(F.array_compact(F.array(day, closing, F.lit("+Now Processing SETUP Information"))))
    return _runs(spark, folder).select(
        F.concat(F.col("run"), F.lit("_RUN.log")).alias("file_name"), lines.alias("line"))


def full_year_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Logs of a whole year: 366 events in a row are one; every third lacks a day and every second is open."""
    run, day = F.floor(F.col("event_id") / 366), F.col("event_id") % 366 + 1
    line = F.when((run % 3 != 0) | (day != 100), F.format_string("+Now Processing Data For Day No. %4d of 2024", day))
    closing = F.when((day == 366) & (run % 2 == 0), F.lit("+Now Processing Output Options"))
    return table(spark, folder, "events").select(
        F.concat(F.lit("Full"), run.cast("string"), F.lit(" Typical Controlled PM_RUN.log")).alias("file_name"),
        F.explode(F.array_compact(F.array(line, closing))).alias("line"))


def downwash_lines(spark: SparkSession, folder: str) -> DataFrame:
    flow = F.format_string("      Wind flow passing %3d degree direction.", (F.col("event_id") % 36 + 1) * 10)
    grouped = F.when((F.col("event_type") == "click") & (F.col("user_id") % 2 == 0),
                     F.lit("   Calculating group of tiers downwash values."))
    ended = F.when(F.col("event_type") == "purchase", F.lit(" END OF BPIP RUN."))
    return _runs(spark, folder).select(
        F.concat(F.col("run"), F.lit("_FLOW.log")).alias("file_name"),
        F.explode(F.array_compact(F.array(flow, grouped, ended))).alias("line"))


def warning_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A message row per event; only those of error events carry a warning code."""
    kind = F.when(F.col("event_type") == "error", F.lit("W")).otherwise(F.lit("N"))
    message = F.concat(F.lit("Check input value "), (F.col("user_id") % 7).cast("string"))
    line = F.concat(F.lit("CO "), kind, F.lpad((F.col("user_id") % 1000).cast("string"), 3, "0"), F.lit(" "),
                    F.lpad((F.col("event_id") % 100).cast("string"), 5, " "), F.lit(" "),
                    F.rpad(F.upper("event_type"), 15, " "), F.lit(" "), F.rpad(message, 50, " "), F.lit(" "),
                    F.when(F.col("user_id") % 2 == 0, F.lit("HINT")).otherwise(F.lit("")))
    return table(spark, folder, "events").select(
        F.concat((F.year("ts") - F.col("event_id") % 3).cast("string"), F.lit(" site.OUT")).alias("file_name"),
        line.alias("line"))


def readings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", F.col("value").alias("direction"))


def _sector_items(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as cells of a site's sectors; four suppliers are a site."""
    return table(spark, folder, "lineitem").select(
        (F.year("l_shipdate") + 19).alias("year"), F.floor(F.col("l_suppkey") / 4).alias("site"),
        (F.col("l_partkey") % 12 + 1).cast("int").alias("sector"),
        F.month("l_shipdate").alias("month"), "l_linenumber", F.col("l_quantity").cast("int").alias("class"))


def site_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Land-surface characteristics files: sector bounds and values."""
    rows = _sector_items(spark, folder).groupBy("year", "site", "sector").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("s"))
    bounds = F.format_string("   SECTOR  %2d  %6.2f  %6.2f", "sector",
                             (F.col("sector") - 1) * 30.0, F.col("sector") * 30.0)
    values = F.format_string("   SITE_CHAR    1      %2d     %.2f     %.2f     %.3f", "sector",
                             F.col("n") % 100 / 100.0, F.col("s") % 150 / 100.0, F.col("s") % 1000 / 1000.0)
    return rows.select(F.format_string("%d S%d_sfc.TXT", "year", "site").alias("file_name"),
                       F.explode(F.array(bounds, values)).alias("line"))


def month_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly roughness tables of the run logs; at even sites they agree with the annual value."""
    months = list(range(1, 13))
    wide = _sector_items(spark, folder).groupBy("year", "site", "sector").agg(
        F.sum("l_linenumber").alias("s"),
        *[F.sum(F.when(F.col("month") == m, F.col("l_linenumber")).otherwise(0)).alias(f"s{m}") for m in months])
    even = F.col("site") % 2 == 0
    cells = [F.format_string("%9.3f", F.when(even, F.col("s") % 1000 + (4 if m == 1 else 0)).otherwise(F.col(f"s{m}") % 1000)
                             / 1000.0) for m in months]
    head = F.format_string("%4d %7.1f", "sector", (F.col("sector") - 1) * 30.0)
    return wide.select(F.format_string("%d S%d.LOG", "year", "site").alias("file_name"),
                       F.concat(head, *cells).alias("line"))


def section_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Run logs as files (stem, line), in the order of their lines: two tables of one layout under different headings."""
    rows = month_lines(spark, folder).select(
        F.coalesce(F.regexp_replace("file_name", r"\.LOG$", ""), F.lit("")).alias("stem"),
        F.regexp_extract("line", r"^\s*(\d+)", 1).cast("int").alias("sector"), "line")
    tables = F.array(*[F.struct(F.lit(i).alias("table"), line.alias("line")) for i, line in enumerate(
        (F.col("line"), F.regexp_replace("line", r"\.(\d)(\d)(\d)(?=\s|$)", ".$3$2$1")))])
    unfolded = rows.select("stem", "sector", F.inline(tables))
    heads = rows.select("stem").distinct().select("stem", F.lit(0).alias("sector"), F.inline(F.array(*[
        F.struct(F.lit(i).alias("table"), F.lit(f" {name}").alias("line")) for i, name in enumerate((P.MONTHLY_SECTION, P.FETCH_SECTION))])))
    return unfolded.unionByName(heads).repartition("stem").sortWithinPartitions("stem", "table", "sector").select("line", "stem")


def cover_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Land-cover count tables of the run logs, with their Total row, which is wrong at every fifth site."""
    sectors = list(range(1, 13))
    wide = _sector_items(spark, folder).groupingSets(
        [[F.col("year"), F.col("site"), F.col("class")], [F.col("year"), F.col("site")]], F.col("year"), F.col("site"), F.col("class"),
    ).agg(F.grouping("class").alias("total"),
          *[F.count_if(F.col("sector") == s).alias(f"n{s}") for s in sectors])
    wide = wide.withColumn("n1", F.col("n1") + F.when((F.col("total") == 1) & (F.col("site") % 5 == 0), 1).otherwise(0))
    head = F.when(F.col("total") == 1, F.lpad(F.lit("Total:"), 36, " ")).otherwise(
        F.format_string("%3d %31s:", "class", F.concat(F.lit("Class "), F.col("class").cast("string"))))
    return wide.select(F.format_string("%d S%d.LOG", "year", "site").alias("file_name"),
                       F.concat(head, *[F.format_string("%9d", f"n{s}") for s in sectors]).alias("line"))


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Wide text inventory per supplier and pollutant; some sums are the text NA."""
    names = F.array(*[F.lit(n) for n in INVENTORY_NAMES])
    items = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("registry_id"),
        F.element_at(names, (F.col("l_partkey") % len(INVENTORY_NAMES) + 1).cast("int")).alias("pollutant_name"),
        (F.year("l_shipdate") + 24).cast("string").alias("year"), F.col("l_quantity").cast("long").alias("q"))
    wide = items.groupBy("registry_id", "pollutant_name").pivot("year", INVENTORY_YEARS).agg(F.sum("q"))
    cells = [F.when(F.col(f"`{y}`") % 7 == 0, "NA").otherwise(F.col(f"`{y}`").cast("string")).alias(y)
             for y in INVENTORY_YEARS]
    return wide.select("registry_id", "pollutant_name", F.lit("Pounds").alias("unit_of_measure"), *cells)
