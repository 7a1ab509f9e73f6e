import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from airtoll import schemas as S
from airtoll.functions import columns as C
from airtoll.functions import epidemiology as E
from airtoll.functions import geodesy as G
from airtoll.functions.student import t_quantile_975, two_sided_p
from tests.conftest import rows


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def forward(lon, lat, zone=18):
    """Forward transverse Mercator, the check on the inverse series."""
    n = G.FLATTENING / (2 - G.FLATTENING)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    phi, away = math.radians(lat), math.radians(lon - (6.0 * zone - 183.0))
    ecc = 2 * math.sqrt(n) / (1 + n)
    t = math.sinh(math.atanh(math.sin(phi)) - ecc * math.atanh(ecc * math.sin(phi)))
    xi0, eta0 = math.atan2(t, math.cos(away)), math.atanh(math.sin(away) / math.sqrt(1 + t * t))
    xi = xi0 + sum(a * math.sin(2 * j * xi0) * math.cosh(2 * j * eta0) for j, a in enumerate(alpha, 1))
    eta = eta0 + sum(a * math.cos(2 * j * xi0) * math.sinh(2 * j * eta0) for j, a in enumerate(alpha, 1))
    scale = G.UTM_SCALE * G.RECTIFYING_RADIUS
    return G.FALSE_EASTING + scale * eta, scale * xi


def test_number_text(spark):
    cases = [(0.25, "0.25"), (1.0, "1"), (-1.5, "-1.5"), (0.0, "0"), (100000.0, "1e+05"), (123456.0, "123456"),
             (120000.0, "120000"), (12000000.0, "1.2e+07"), (0.1234, "0.123"), (-0.0004, "0"),
             (float("inf"), "Inf"), (float("-inf"), "-Inf"), (float("nan"), "NaN"), (None, "NA"), (2000.0, "2000")]
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(cases)], "i int, v double")
    assert [r[1] for r in rows(df.select("i", C.number_text(F.col("v"))), "i")] == [t for _, t in cases]


def test_categories_outside_the_order_sort_last(spark):
    df = spark.createDataFrame([("SO2",), ("Ozone",), ("PM",), (None,)], "p string")
    ranked = df.withColumn("r", C.rank_in(F.col("p"), S.POLLUTANT_ORDER))
    assert {r["p"]: r["r"] for r in ranked.collect()} == {"SO2": 3, "Ozone": None, "PM": 1, None: None}
    ordered = [r["p"] for r in ranked.orderBy(F.col("r").asc_nulls_last(), F.col("p").asc_nulls_last()).collect()]
    assert ordered == ["PM", "SO2", "Ozone", None]


def test_recode_group_and_clamp(spark):
    assert one(spark, C.recode(F.lit("ihd_rate"), S.ENDPOINT_OF_RATE)) == "Ischemic heart disease"
    assert one(spark, C.recode(F.lit("other_rate"), S.ENDPOINT_OF_RATE)) == "other_rate"
    assert one(spark, C.group_of(F.lit("Pct_Minority"), S.SVI_THEMES, S.OTHER_THEME)).startswith("Minority")
    assert one(spark, C.group_of(F.lit("Final"), S.SVI_THEMES, S.OTHER_THEME)) == S.OTHER_THEME
    assert one(spark, C.clamp(F.lit(50.0), 0, 40)) == 40
    assert one(spark, C.clamp(F.lit(None).cast("double"), 0, 40)) is None
    assert one(spark, C.number(F.lit("NA"))) is None
    assert one(spark, C.fixed_text(F.lit(None).cast("double"), 1, "XX")) == "XX"
    assert one(spark, C.fixed_text(F.lit(12345.678), 1)) == "12345.7"


def test_sum_of_nothing_is_zero_and_null_keys_match(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0)], "k string, v double")
    assert rows(df.groupBy("k").agg(C.sum_or_zero(F.col("v")).alias("s")), "k") == [("a", 0.0), ("b", 1.0)]
    left = spark.createDataFrame([("a", 1), (None, 2)], "k string, l int")
    right = spark.createDataFrame([(None, 3), ("b", 4)], "k string, r int")
    assert rows(C.join_null_safe(left, right, ["k"]), "l") == [(None, 2, 3)]
    assert rows(C.join_null_safe(left, right, ["k"], "left"), "l") == [("a", 1, None), (None, 2, 3)]
    assert rows(C.join_null_safe(left, right, ["k"], "left_anti"), "l") == [("a", 1)]


@pytest.mark.parametrize("rate,pop,rr,conc,expected", [
    ("800", 4000, 1.008, 0.05, 0.012746532106820752),
    ("450.5", 2500, 1.06, 1.2, 0.7606027303764171),
    ("800", 4000, 1.008, 0.0, 0.0),
    ("800", 4000, 1.0, 3.0, 0.0),
    ("NA", 4000, 1.008, 0.05, None),
    ("800", None, 1.008, 0.05, None),
    ("800", 4000, None, 0.05, None),
    ("800", 4000, 1.008, None, None),
])
def test_attributable_cases(spark, rate, pop, rr, conc, expected):
    df = spark.createDataFrame([(rate, pop, rr, conc)], "rate string, pop int, rr double, conc double")
    got = df.select(E.attributable_cases(E.rate_per_person(F.col("rate")), F.col("pop"),
                                         E.response_coefficient(F.col("rr")), F.col("conc"))).first()[0]
    assert got == expected if expected is None else got == pytest.approx(expected, rel=1e-12)


def test_cases_grow_with_concentration(spark):
    df = spark.range(50).select((F.col("id") / 10).alias("c"))
    got = [r[0] for r in df.select(E.attributable_cases(
        F.lit(0.01), F.lit(1000), F.log(F.lit(1.02)), F.col("c"))).collect()]
    assert got == sorted(got) and got[0] == 0


def test_utm_central_meridian_and_round_trip(spark):
    lon, lat = G.utm_to_lon_lat(F.lit(500000.0), F.lit(0.0))
    assert one(spark, lon) == pytest.approx(-75, abs=1e-12) and one(spark, lat) == pytest.approx(0, abs=1e-12)
    places = [(-76.7, 39.2), (-77.9, 25.0), (-72.1, 60.5), (-75.0, 80.0)]
    df = spark.createDataFrame([forward(*p) for p in places], "x double, y double")
    lon, lat = G.utm_to_lon_lat(F.col("x"), F.col("y"))
    for got, want in zip(df.select(lon, lat).collect(), places, strict=True):
        assert tuple(got) == pytest.approx(want, abs=1e-8)


def test_southern_zone_and_codes(spark):
    x, y = forward(-76.0, 10.0)
    lon, lat = G.utm_to_lon_lat(F.lit(x), F.lit(10000000.0 - y), 18, True)
    assert (one(spark, lon), one(spark, lat)) == pytest.approx((-76.0, -10.0), abs=1e-8)
    assert G.zone_of_epsg(32618) == (18, False) and G.zone_of_epsg(32756) == (56, True)
    with pytest.raises(ValueError):
        G.zone_of_epsg(4326)


def even_tail(t, df):
    """Closed form of the two-sided tail for an even number of degrees of freedom."""
    angle = math.atan(t / math.sqrt(df))
    total = term = 1.0
    for k in range(1, df // 2):
        term *= (2 * k - 1) / (2 * k) * math.cos(angle) ** 2
        total += term
    return 1 - math.sin(angle) * total


def test_student_tail_and_quantile():
    assert two_sided_p(np.array([15.0]), np.array([3]))[0] == pytest.approx(0.00064312, abs=1e-8)
    for t, df in [(2.2281, 10), (1.5, 4), (3.3, 20), (0.1, 2), (9.0, 60)]:
        assert two_sided_p(np.array([t]), np.array([df]))[0] == pytest.approx(even_tail(t, df), rel=1e-10, abs=1e-15)
    assert two_sided_p(np.array([0.0]), np.array([5]))[0] == pytest.approx(1)
    assert two_sided_p(np.array([-1.0, 1.0]), np.array([1, 1])) == pytest.approx([0.5, 0.5])
    assert np.isnan(two_sided_p(np.array([1.0, np.nan]), np.array([0, 5]))).all()
    assert two_sided_p(np.array([1.959963984540054]), np.array([10**7]))[0] == pytest.approx(0.05, abs=1e-7)
    assert two_sided_p(np.array([60.0]), np.array([1000]))[0] < 1e-300
    assert t_quantile_975(np.array([3, 10]))[0] == pytest.approx(3.182446305284263, abs=1e-9)


@pytest.mark.parametrize("df", [2e4, 1e6, 1e8, 1e10, 1e12])
@pytest.mark.parametrize("t", [0.01, 1.5, 3.0])
def test_tail_with_many_degrees_of_freedom(t, df):
    """Against the expansion of the tail about the normal one in powers of 1 / df."""
    density = math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
    terms = (t**3 + t) / (4 * df) + (3 * t**7 - 7 * t**5 - 5 * t**3 - 3 * t) / (96 * df * df)
    want = math.erfc(t / math.sqrt(2)) + 2 * density * terms
    assert two_sided_p(np.array([t]), np.array([df]))[0] == pytest.approx(want, rel=1e-9)


def test_missing_value_and_the_text_na_cannot_share_a_heading(spark):
    df = spark.createDataFrame([("a",), ("NA",), (None,)], "c string")
    with pytest.raises(ValueError, match="heading"):
        C.category_values(df, "c")
    assert C.category_values(df.filter("c is not null"), "c") == ["NA", "a"]
