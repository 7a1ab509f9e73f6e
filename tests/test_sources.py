import csv
import os

import pytest
from pyspark.sql import functions as F

from airtoll import schemas as S
from airtoll.operators import inventory as N
from airtoll.operators import receptors as R
from airtoll.operators import spatial as G
from airtoll.sources import emissions, sinks, tables
from airtoll.sources.staging import shared_folder, staged
from tests.conftest import rows


def put(path, *lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_monitor_folder_keeps_the_file_of_each_row(spark, tmp_path):
    head = ",".join(S.MONITOR_COLUMNS)
    put(tmp_path / "reformatted_Plant 2017 PM Annual.csv", head, "M001,Unknown,39.2,-76.6,D24HourMean,Annual,Mean,0.5")
    put(tmp_path / "reformatted_Plant 2020 SO2 Annual.csv", head, "M101,Unknown,39.3,-76.5,D24HourMean,Annual,Mean,NA")
    put(tmp_path / "readme.csv", "a,b", "1,2")
    monitors = tables.read_monitors(spark, str(tmp_path))
    keys = R.year_keys(F.col("file_name"))
    got = rows(monitors.select(keys["year"].alias("year"), keys["pollutant"], "latitude", "longitude", "Conc"), "year")
    assert got == [(2017, "PM", 39.2, -76.6, 0.5), (2020, "SO2", 39.3, -76.5, None)]


def test_files_with_other_headings_are_refused(spark, tmp_path):
    put(tmp_path / "a Annual.csv", "x,y", "1,2")
    put(tmp_path / "b Annual.csv", "y,x", "1,2")
    with pytest.raises(Exception, match="(?i)header"):
        tables.read_folder(spark, str(tmp_path)).collect()


def test_receptor_to_tract_from_files(spark, tmp_path):
    """Raw grid, monitor files, boundaries as text, concentrations: the whole input side."""
    raw, out = tmp_path / "raw", tmp_path / "out"
    raw.mkdir()
    for name, value in (("Plant Typical Controlled PM Annual", 2.0), ("Plant Max Controlled PM Annual", 4.0)):
        put(raw / f"{name}.csv", f"X,Y,{S.CONCENTRATION_HEADING},ZELEV", f"362000.0,4347000.0,{value},", f"362100.0,4347000.0,{value + 1},")
    receptors = R.drop_empty_columns(tables.read_receptors(spark, str(raw)))
    assert receptors.columns == ["X", "Y", S.CONCENTRATION_HEADING, "file_name"]
    sinks.write_reformatted(R.reformat_receptors(receptors), str(out))
    folders = sorted(d for d in os.listdir(out) if d.startswith("stem="))
    assert folders == ["stem=reformatted_Plant Max Controlled PM Annual", "stem=reformatted_Plant Typical Controlled PM Annual"]
    keys = R.condition_keys(F.col("file_name"), "Plant")
    points = tables.read_monitors(spark, str(out)).withColumns(keys)
    wkt = "POLYGON ((-77 39, -76 39, -76 40, -77 40, -77 39))"
    far = "MULTIPOLYGON (((-80 39, -79.5 39, -79.5 39.5, -80 39)), ((-81 39, -80.5 39, -80.5 39.5, -81 39)))"
    path = put(tmp_path / "tracts.csv", "GEOID,TRACTCE,NAME,NAMELSADCO,STATEFP,STUSPS,geometry,vintage",
               f'24001000100,000100,1,A County,24,MD,"{wkt}",2021', f'11001000200,000200,2,B County,11,DC,"{far}",2021',
               f'11001000300,000300,3,B County,11,DC,"{far}",2010')
    tracts = tables.read_boundaries(spark, [path], vintage=2021)
    assert tables.read_boundaries(spark, [path], "24001").count() == 1
    assert tracts.filter("GEOID = '11001000200'").select(F.size("polygons")).first()[0] == 2
    got = G.assign_concentration(points, tracts, ["pollutant", "condition"])
    assert rows(got.select("condition", "GEOID", "Final_Conc", "Source"), "condition", "GEOID") == [
        ("Max Controlled", "11001000200", 4.0, S.NEAREST), ("Max Controlled", "24001000100", 4.5, S.AVERAGED),
        ("Typical Controlled", "11001000200", 2.0, S.NEAREST), ("Typical Controlled", "24001000100", 2.5, S.AVERAGED)]


def test_dimension_tables(spark, tmp_path):
    risk = put(tmp_path / "risk.csv", f"Health Endpoint,pollutant,RR Source,{S.RISK_HEADING}", "Stroke,PM,someone,1.01", "Asthma,PM,x,none")
    assert rows(tables.read_risk(spark, risk), "endpoint") == [("PM", "Asthma", None), ("PM", "Stroke", 1.01)]
    cost = put(tmp_path / "cost.csv", "Health Endpoint,Economic Cost,Source", "Stroke,1000,x")
    assert rows(tables.read_cost(spark, cost), "Health Endpoint") == [("Stroke", 1000.0)]
    names = list(S.ENDPOINT_OF_RATE)
    rates = put(tmp_path / "rates.csv", "county_fips,year,County," + ",".join(names), "01001,2023,A," + ",".join(["NA"] + ["5"] * 6))
    got = tables.read_incidence(spark, rates).first()
    assert got["county_fips"] == "01001" and got["mortality_rate"] is None and got["copd_rate"] == "5"
    svi = put(tmp_path / "svi.csv", "ST,FIPS,EP_POV150,RPL_THEMES,EXTRA", "1,01001020100,12.5,-999,x")
    row = tables.read_svi(spark, svi).first()
    assert (row["FIPS"], row["EP_POV150"], row["RPL_THEMES"], row["EP_UNEMP"]) == ("01001020100", 12.5, -999.0, None)
    long = put(tmp_path / "people.csv", "GEOID,NAME,variable,estimate,moe,year", "01001020100,T,total_pop,10,1,2023")
    assert tables.read_demographics_long(spark, long).first()["estimate"] == 10.0
    wide = put(tmp_path / "wide.csv", "GEOID,NAME,total_popE,total_popM", "01001020100,T,10,1")
    assert tables.read_demographics_wide(spark, wide).first()["total_popE"] == 10.0


def test_facilities_share_a_path(spark, tmp_path):
    path = str(tmp_path / "cases")
    for facility in ("one", "two"):
        df = spark.createDataFrame([(facility, 1.0)], "facility string, v double")
        sinks.write_table(df, path, ["facility"])
    assert rows(spark.read.parquet(path).select("facility", "v"), "facility") == [("one", 1.0), ("two", 1.0)]


def test_staged_tables_live_in_the_shared_folder(spark):
    df = staged(spark.range(5))
    folder = shared_folder(spark).removeprefix("file:")
    assert df.count() == 5 and df.inputFiles() and all(folder in f for f in df.inputFiles())


# invented pounds of three years
POUNDS = [("Primary PM2.5 (filterables and condensibles)", "40000", "50000", "42000"),
          ("Primary PM10 (filterables and condensibles)", "52000", "56000", "46000")]


def test_inventory(spark, tmp_path):
    path = tmp_path / "inventory.csv"
    with open(path, "w", newline="", encoding="utf-8") as out:
        writer = csv.writer(out, lineterminator="\r\n")
        writer.writerow(S.INVENTORY.names)
        for name, a, b, c in [*POUNDS, ("Arsenic", "NA", "12.5", "4.5"), ("Primary PM10, filterable portion only", "1", "", "")]:
            writer.writerow(["1.10E+11", "NEI", "NEI", "1", name, "Pounds", a, "", "", b, "", "", c, "", "", "", "CAP", ""])
        writer.writerow(["", "", "", "", "", "2014", "", "", "2017"] + [""] * 9)
        writer.writerow(["", "", "", "", "PM2.5", "40000", "20", "46"] + [""] * 10)
    table = emissions.read_inventory(spark, str(path))
    assert table.count() == 4
    long = N.unpivot_inventory(table)
    assert long.count() == 9 and long.filter("pollutant_name = 'Arsenic'").agg(F.min("year")).first()[0] == 2017
    summary = N.criteria_summary(long)
    tons = {(r["short_name"], r["year"]): r["tons"] for r in summary.collect()}
    assert tons[("PM2.5", 2014)] == 20 and len(tons) == 8
    total = {r["year"]: r["pm_total_tons"] for r in N.particulate_total(summary).collect()}
    assert total == {2014: 46, 2017: 53, 2020: 44}
