"""Table schemas and the category lists the jobs share."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


STRING, DOUBLE, INT = T.StringType(), T.DoubleType(), T.IntegerType()

VERTEX = T.StructType([T.StructField("x", DOUBLE), T.StructField("y", DOUBLE)])
# parts -> rings -> vertices; the first ring of a part is its shell, the others are holes
POLYGONS = T.ArrayType(T.ArrayType(T.ArrayType(VERTEX)))

# --- fixed values: column headings of the exchanged files -------------------------------
CONCENTRATION_HEADING = "Concentration (AVERAGE CONC) [ug/m^3]"
RISK_HEADING = "RR per 1 µg m3"
MONITOR_COLUMNS = [
    "Monitor Name", "Monitor Description", "Latitude", "Longitude",
    "Metric", "Seasonal Metric", "Statistic", "Values",
]
MONITOR_CONSTANTS = {"Metric": "D24HourMean", "Seasonal Metric": "Annual", "Statistic": "Mean"}
UNKNOWN_PLACE = "Unknown"
AVERAGED, NEAREST = "Averaged within Tract", "Nearest Neighbor"

# --- fixed values: endpoints, in the order of the rate columns --------------------------
ENDPOINT_OF_RATE = {
    "mortality_rate": "All-cause mortality",
    "diabetes_rate": "Diabetes",
    "cancer_rate": "Respiratory Tract Cancer",
    "stroke_rate": "Stroke",
    "asthma_rate": "Asthma",
    "ihd_rate": "Ischemic heart disease",
    "copd_rate": "Chronic obstructive pulmonary disease",
}
MORTALITY = "All-cause mortality"

# --- fixed values: display orders -------------------------------------------------------
POLLUTANT_ORDER = ["PM", "NOx", "SO2", "CO"]
LEGEND_ORDER = ["NOx", "PM", "SO2", "CO"]
RANGE_ORDER = ["Total", "CO", "SO2", "NOx", "PM"]
CONTROL_ORDER = ["Controlled", "Uncontrolled"]
CONDITION_ORDER = [
    "Typical Controlled", "Typical Uncontrolled", "Max Controlled", "Max Uncontrolled",
]
TREND_ORDER = [
    "All-cause mortality", "Diabetes", "Asthma", "Stroke",
    "Ischemic heart disease", "Respiratory Tract Cancer",
]

# --- fixed values: demographics and social vulnerability --------------------------------
DEMOGRAPHICS = ["total_pop", "white", "black", "asian", "hispanic", "median_income"]
SVI_RANKS = {
    "RPL_THEMES": "SVI",
    "RPL_THEME1": "SVI_SES",
    "RPL_THEME2": "SVI_HC",
    "RPL_THEME3": "SVI_REMS",
    "RPL_THEME4": "SVI_HTT",
}
SVI_INDICATORS = {
    "EP_POV150": "Pct_Below_150_Poverty",
    "EP_UNEMP": "Pct_Unemployed",
    "EP_HBURD": "Pct_Housing_Cost_Burden",
    "EP_NOHSDP": "Pct_No_HS_Diploma_Age25_Plus",
    "EP_UNINSUR": "Pct_No_Health_Insurance",
    "EP_AGE65": "Pct_Age_65_Plus",
    "EP_AGE17": "Pct_Age_17_Younger",
    "EP_DISABL": "Pct_Disability",
    "EP_SNGPNT": "Pct_Single_Parent_HH",
    "EP_LIMENG": "Pct_Limited_English",
    "EP_MINRTY": "Pct_Minority",
    "EP_MUNIT": "Pct_Multi_Unit_Structures",
    "EP_MOBILE": "Pct_Mobile_Homes",
    "EP_CROWD": "Pct_Crowding",
    "EP_NOVEH": "Pct_No_Vehicle",
    "EP_GROUPQ": "Pct_Group_Quarters",
}
SVI_MISSING = -999
INDICATORS = list(SVI_INDICATORS.values())
THEME_RANKS = [name for name in SVI_RANKS.values() if name != "SVI"]
SVI_THEMES = {
    "Socioeconomic Status (SES)": INDICATORS[0:5],
    "Household Composition & Disability (HC)": INDICATORS[5:10],
    "Minority Status & Language (MSL)": INDICATORS[10:11],
    "Housing Type & Transportation (HTT)": INDICATORS[11:16],
}
OTHER_THEME = "Other SVI Factor"

# --- fixed values: inventory names and their short names --------------------------------
CRITERIA_OF_INVENTORY = {
    "Primary PM2.5 (filterables and condensibles)": "PM2.5",
    "Primary PM10 (filterables and condensibles)": "PM10",
    "Nitrogen oxides": "NOx",
    "Carbon monoxide": "CO",
    "Sulfur dioxide": "SO2",
    "Hydrochloric acid": "HCl",
    "Mercury": "Hg",
    "Lead": "Pb",
    "Arsenic": "As",
    "Volatile organic compounds": "TOC",
}
INVENTORY_YEARS = [str(year) for year in range(2014, 2024)]

# --- schemas ----------------------------------------------------------------------------
RECEPTOR = T.StructType([
    T.StructField("X", DOUBLE), T.StructField("Y", DOUBLE),
    T.StructField(CONCENTRATION_HEADING, DOUBLE),
])
MONITOR = T.StructType([
    T.StructField(name, DOUBLE if name in ("Latitude", "Longitude", "Values") else STRING)
    for name in MONITOR_COLUMNS
])
BOUNDARY = T.StructType([
    *_struct(GEOID=STRING, TRACTCE=STRING, NAME=STRING, NAMELSADCO=STRING, STATEFP=STRING,
             STUSPS=STRING).fields,
    T.StructField("polygons", POLYGONS),
    T.StructField("vintage", INT),
])
COUNTY = T.StructType([
    *_struct(GEOID=STRING, NAME=STRING, NAMELSAD=STRING, STATEFP=STRING).fields,
    T.StructField("polygons", POLYGONS),
    T.StructField("vintage", INT),
])
TRACT_CONCENTRATION = _struct(
    GEOID=STRING, TRACTCE=STRING, NAME=STRING, NAMELSADCO=STRING, STATEFP=STRING,
    pollutant=STRING, condition=STRING, Final_Conc=DOUBLE, Source=STRING,
)
TRACT_CONCENTRATION_BY_YEAR = T.StructType([
    T.StructField("year", INT) if field.name == "condition" else field
    for field in TRACT_CONCENTRATION.fields
])
DEMOGRAPHICS_LONG = _struct(
    GEOID=STRING, NAME=STRING, variable=STRING, estimate=DOUBLE, moe=DOUBLE, year=INT,
)
DEMOGRAPHICS_WIDE = T.StructType([
    T.StructField("GEOID", STRING), T.StructField("NAME", STRING),
    *[T.StructField(name + suffix, DOUBLE) for name in DEMOGRAPHICS for suffix in "EM"],
])
INCIDENCE = T.StructType([
    T.StructField("county_fips", STRING), T.StructField("year", INT),
    T.StructField("County", STRING),
    *[T.StructField(name, STRING) for name in ENDPOINT_OF_RATE],
])
RISK = T.StructType([
    T.StructField("pollutant", STRING), T.StructField("Health Endpoint", STRING),
    T.StructField(RISK_HEADING, DOUBLE), T.StructField("RR Source", STRING),
])
COST = T.StructType([
    T.StructField("Health Endpoint", STRING), T.StructField("Economic Cost", DOUBLE),
    T.StructField("Source", STRING),
])
SVI = T.StructType([
    T.StructField("FIPS", STRING),
    *[T.StructField(name, DOUBLE) for name in (*SVI_RANKS, *SVI_INDICATORS)],
])
INVENTORY = T.StructType([
    T.StructField(name, STRING)
    for name in ("registry_id", "air_program", "pgm_sys_acrnm", "pgm_sys_ids",
                 "pollutant_name", "unit_of_measure", *INVENTORY_YEARS,
                 "nei_type", "nei_hap_voc_flag")
])
