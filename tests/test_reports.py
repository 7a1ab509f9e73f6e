import pytest
from pyspark.sql import functions as F

from airtoll.operators import audits as A
from airtoll.sources import reports as P
from tests.conftest import rows


def lines(spark, **files):
    return spark.createDataFrame([(n, line) for n, text in files.items() for line in text], "file_name string, line string")


def day(n, year=2023):
    return f"+Now Processing Data For Day No. {n:4d} of {year}"


CLOSED = "+Now Processing Output Options               "


def test_run_keys_fold_the_facility(spark):
    df = spark.createDataFrame([("PLant 2020 SO2_RUN.log",), ("Plant Typical Controlled PM_RUN.log",), ("x.txt",)], "file_name string")
    got = rows(df.select(*[v.alias(k) for k, v in P.run_keys(F.col("file_name")).items()]), "scenario")
    assert got == [("PLANT", "2020", "SO2"), ("PLANT", "Typical Controlled", "PM"), (None, None, None)]


def test_run_completeness_and_gaps(spark):
    full = [day(d) for d in range(1, 366)]
    leap = [day(d, 2024) for d in range(1, 367)]
    df = lines(spark, full=["+Now Processing SETUP Information", *full, CLOSED], leap=[*leap, CLOSED], open=full,
               gap=[*full[:9], *full[12:100], *full[101:], CLOSED], twice=[*full, full[0], CLOSED], short=[*leap[:-1], CLOSED])
    days = P.run_days(df)
    got = {r["file_name"]: r for r in A.run_completeness(days).collect()}
    assert {k for k, r in got.items() if r["complete"]} == {"full", "leap"}
    assert got["gap"]["days"] == 361 and got["twice"]["day_lines"] == 366 and not got["open"]["closed"]
    assert rows(A.run_gaps(days), "file_name", "gap_after") == [("gap", 9, 13, 3), ("gap", 100, 102, 1)]


def test_missing_runs(spark):
    manifest = spark.createDataFrame([("P", "s", p) for p in ("PM", "NOx", "SO2", "CO")] + [("P", "t", "PM"), ("P", "t", "SO2")],
                                     "facility string, scenario string, pollutant string")
    assert rows(A.missing_runs(manifest), "pollutant") == [("P", "t", "CO"), ("P", "t", "NOx")]


SITE = ["** Generated", "   FREQ_SECT  ANNUAL 12", "   SECTOR   1    0.00   30.00", "   SECTOR   2   30.00   60.00", "",
        "   SITE_CHAR    1       1     0.21     0.64     0.250", "   SITE_CHAR    1       2     0.21     0.64     0.320"]
MONTHS = ["Sector  Dir       1        2",
          "   1     0.0" + "    0.240" * 6 + "    0.260" * 6,
          "   2    30.0" + "    0.300" * 6 + "    0.340" * 6,
          "   1     0.0" + "   2500.0" * 12]


def test_site_characteristics_and_roughness(spark):
    df = lines(spark, **{"2014 site_sfc.TXT": SITE, "2017 site_sfc.TXT": [s.replace("0.250", "0.275") for s in SITE]})
    values = P.site_values(df)
    got = rows(A.site_characteristics(P.sector_bounds(df), values), "year", "sector")
    assert got[:2] == [("site", 2014, 1, 0.0, 30.0, 0.21, 0.64, 0.25), ("site", 2014, 2, 30.0, 60.0, 0.21, 0.64, 0.32)]
    change = rows(A.roughness_change(values), "sector", "year")
    assert change[0][4:] == (None, None) and change[1][4] == 2014 and change[1][5] == pytest.approx(0.025)
    monthly = P.monthly_roughness(lines(spark, **{"2014 site.LOG": MONTHS}))
    assert monthly.count() == 24
    check = {r["sector"]: r for r in A.annual_roughness(monthly, values.filter("year = 2014")).collect()}
    assert check[1]["agrees"] and check[2]["agrees"] and check[1]["monthly_mean"] == pytest.approx(0.25)
    wrong = A.annual_roughness(monthly, values.withColumn("roughness", F.col("roughness") + 0.01))
    assert not any(r["agrees"] for r in wrong.collect())


def test_cover_counts(spark):
    text = ["Cat              Starting Direction:      0.0    30.0",
            "------------------------------------",
            "  0 Missing, Out-of-Bounds, or Unde:        0       1",
            " 31      Bare Ground (Any Material):        5       6",
            "                              Total:        5       8",
            " Land Cover Counts: Bowen Ratio and Albedo (10km X 10km Domain)",
            " 11                      Wet Ground:       40",
            " 52                       Low Scrub:       60",
            "                              Total:      100"]
    counts = P.cover_counts(lines(spark, **{"2014 site.LOG": text}))
    assert counts.count() == 9
    assert rows(A.cover_check(counts), "sector") == [
        ("site", 2014, 0, 100, 100, 2, True), ("site", 2014, 1, 5, 5, 2, True), ("site", 2014, 2, 7, 8, 2, False)]


def test_warnings(spark):
    text = ["PW CODE   L#  ModNam          MESSAGE                                            HINT",
            "-- ---- ----- --------------- -------------------------------------------------- --------------------",
            f"CO W301 {9:5d} {'FIRSTMOD':15} {'An invented message about the age of a table':50} {'TABLE2014':20}",
            f"CO W302 {30:5d} {'OTHERMOD':15} {'Another invented message':50} {'FIRSTMOD':20}",
            "   E100       MAIN            Something else                                     "]
    got = rows(P.warnings(lines(spark, **{"2014 site.OUT": text})), "code")
    assert got == [
        ("2014 site.OUT", 2014, None, "E100", None, "MAIN", "Something else", None),
        ("2014 site.OUT", 2014, "CO", "W301", 9, "FIRSTMOD", "An invented message about the age of a table", "TABLE2014"),
        ("2014 site.OUT", 2014, "CO", "W302", 30, "OTHERMOD", "Another invented message", "FIRSTMOD")]


def test_flow_audit(spark):
    flows = [f"      Wind flow passing {d:3d} degree direction." for d in range(10, 361, 10)]
    df = lines(spark, single=[*flows, " END OF BPIP RUN."],
               grouped=[*flows, "   Calculating group of tiers downwash values.", " END OF BPIP RUN."], broken=flows[:35])
    got = {r["file_name"]: r for r in A.flow_audit(P.downwash_events(df)).collect()}
    assert got["single"]["complete"] and not got["single"]["grouped"] and got["grouped"]["grouped"]
    assert got["broken"]["missing_flows"] == [360] and not got["broken"]["complete"]


def test_wind_sector(spark):
    sectors = spark.createDataFrame([(1, 345.5, 15.0), (2, 15.0, 200.0)], "sector int, start_dir double, end_dir double")
    wind = spark.createDataFrame([(0.0,), (360.0,), (15.0,), (14.99,), (345.2,), (345.5,), (199.9,), (200.0,), (None,)], "direction double")
    got = {r["direction"]: r["sector"] for r in A.wind_sector(wind, sectors).collect()}
    assert got == {0.0: 1, 360.0: 1, 15.0: 2, 14.99: 1, 345.2: None, 345.5: 1, 199.9: 2, 200.0: None, None: None}


def test_lines_lose_their_carriage_return(spark, tmp_path):
    (tmp_path / "Plant 2023 PM_RUN.log").write_bytes((day(1) + "\r\n" + CLOSED + "\r\n").encode())
    got = P.run_days(P.read_lines(spark, str(tmp_path), "*.log")).collect()
    assert len(got) == 2 and {r["file_name"] for r in got} == {"Plant 2023 PM_RUN.log"}
