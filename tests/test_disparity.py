import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import functions as F

from airtoll import schemas as S
from airtoll.functions.student import NORMAL_975
from airtoll.operators import disparity as V
from airtoll.operators import regression as M
from tests.conftest import rows


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    n = 240
    a, b = rng.normal(1000, 2, n), rng.normal(size=n)
    table = [("g" if i % 2 else "h", float(a[i]), float(b[i]), float(2 * a[i] + 1), 3.0, float(rng.normal()),
              float(4 + 0.5 * a[i] - 2 * b[i] + rng.normal())) for i in range(n)]
    table[0] = (*table[0][:2], None, *table[0][3:])
    table[1] = (*table[1][:6], None)
    return spark.createDataFrame(table, "k string, a double, b double, twin double, flat double, conc double, y double").cache()


def least_squares(frame, terms):
    clean = frame.dropna(subset=[*terms, "y"])
    x = np.column_stack([np.ones(len(clean)), *[clean[t] for t in terms]])
    beta, *_ = np.linalg.lstsq(x, clean["y"], rcond=None)
    rest = clean["y"] - x @ beta
    df = len(clean) - x.shape[1]
    error = np.sqrt(rest @ rest / df * np.diag(np.linalg.inv(x.T @ x)))
    return beta, error, df


def test_five_points(spark):
    df = spark.createDataFrame([("k", float(i), y) for i, y in enumerate([2.0, 2.9, 4.2, 4.8, 6.3], 1)], "k string, x double, y double")
    fit = M.add_interval(M.univariate_fits(df, ["k"], "y", ["x"])).first()
    assert (fit["estimate"], fit["intercept"], fit["std_error"]) == pytest.approx((1.05, 0.89, 0.07))
    assert fit["df"] == 3 and fit["statistic"] == pytest.approx(15) and fit["p_value"] == pytest.approx(0.00064312, abs=1e-8)
    assert fit["conf_low"] == pytest.approx(1.05 - NORMAL_975 * 0.07)
    student = M.add_interval(M.univariate_fits(df, ["k"], "y", ["x"]), "t").first()
    assert student["conf_high"] == pytest.approx(1.05 + 3.182446305 * 0.07)
    ratio = M.add_interval(M.univariate_fits(df, ["k"], "y", ["x"]), exponentiate=True).first()
    assert ratio["estimate"] == pytest.approx(np.exp(1.05)) and ratio["statistic"] == pytest.approx(15)


def test_univariate_against_least_squares(data):
    got = {(r["k"], r["svi_variable"]): r for r in M.univariate_fits(data, ["k"], "y", ["a", "b", "flat"]).collect()}
    frame = data.toPandas()
    for k in "gh":
        for v in "ab":
            beta, error, df = least_squares(frame[frame.k == k], [v])
            fit = got[(k, v)]
            assert (fit["intercept"], fit["estimate"]) == pytest.approx(tuple(beta), rel=1e-6)
            assert fit["std_error"] == pytest.approx(error[1], rel=1e-9) and fit["df"] == df
        assert got[(k, "flat")]["estimate"] is None and got[(k, "flat")]["std_error"] is None


def test_too_few_rows_and_a_perfect_line(spark):
    df = spark.createDataFrame([("two", 1.0, 1.0), ("two", 2.0, 3.0), ("one", 1.0, 1.0), ("line", 1.0, 2.0),
                                ("line", 2.0, 4.0), ("line", 3.0, 6.0)], "k string, x double, y double")
    got = {r["k"]: r for r in M.add_interval(M.univariate_fits(df, ["k"], "y", ["x"])).collect()}
    assert got["two"]["estimate"] == 2 and got["two"]["std_error"] is None and got["two"]["p_value"] is None
    assert got["one"]["estimate"] is None and got["one"]["p_value"] is None
    assert got["line"]["estimate"] == 2 and got["line"]["p_value"] == pytest.approx(0, abs=1e-6)


def chosen(spark, **lists):
    return spark.createDataFrame(list(lists.items()), "k string, svi_variables array<string>")


def test_multivariate_against_least_squares_and_spark_ml(spark, data):
    fits = M.add_interval(M.multivariate_fits(
        data, ["k"], "y", ["a", "b"], ["conc"], chosen(spark, g=["a", "b"], h=["b"]), False)).collect()
    frame = data.toPandas()
    for k, terms in (("g", ["a", "b", "conc"]), ("h", ["b", "conc"])):
        beta, error, df = least_squares(frame[frame.k == k], terms)
        got = [r for r in fits if r["k"] == k]
        assert [r["term"] for r in got] == ["(Intercept)", *terms]
        assert [r["estimate"] for r in got] == pytest.approx(list(beta), rel=1e-6)
        assert [r["std_error"] for r in got] == pytest.approx(list(error), rel=1e-6)
        assert {r["df"] for r in got} == {df}
    rows_g = data.filter("k = 'g'").dropna()
    model = GeneralizedLinearRegression(labelCol="y").fit(
        VectorAssembler(inputCols=["a", "b", "conc"], outputCol="features").transform(rows_g))
    got = {r["term"]: r for r in fits if r["k"] == "g"}
    for i, term in enumerate(["a", "b", "conc"]):
        assert got[term]["p_value"] == pytest.approx(model.summary.pValues[i], rel=1e-6, abs=1e-12)


def test_aliased_constant_and_unselected_terms(spark, data):
    fits = M.multivariate_fits(data, ["k"], "y", ["a", "twin", "flat"], ["conc"], chosen(spark, g=["a", "twin", "flat"]), False)
    got = {(r["k"], r["term"]): r for r in M.add_interval(fits).collect()}
    for term in ("twin", "flat"):
        assert got[("g", term)]["estimate"] is None and got[("g", term)]["p_value"] is None
    beta, _, df = least_squares(data.filter("k = 'g'").toPandas(), ["a", "conc"])
    assert got[("g", "a")]["estimate"] == pytest.approx(beta[1], rel=1e-6) and got[("g", "a")]["df"] == df
    assert {t for k, t in got if k == "h"} == {"(Intercept)", "conc"}  # nothing selected: concentration alone
    skipped = M.multivariate_fits(data, ["k"], "y", ["a"], ["conc"], chosen(spark, g=["a"]), True)
    assert {r["k"] for r in skipped.collect()} == {"g"}


def test_fewer_rows_than_terms(spark):
    df = spark.createDataFrame([("k", 1.0, 5.0, 2.0), ("k", 2.0, 1.0, 7.0)], "k string, a double, conc double, y double")
    fits = M.multivariate_fits(df, ["k"], "y", ["a"], ["conc"], chosen(spark, k=["a"]), False)
    got = {r["term"]: r for r in M.add_interval(fits).collect()}
    assert got["a"]["estimate"] == pytest.approx(5) and got["conc"]["estimate"] is None
    assert got["a"]["std_error"] is None and got["a"]["p_value"] is None


def test_selection_lists_and_map(spark):
    fits = spark.createDataFrame([
        ("PM", "c1", "b", 0.01), ("PM", "c1", "a", 0.049), ("PM", "c1", "z", 0.05), ("PM", "c2", "a", 0.2),
        ("NOx", "c2", "a", None)], "pollutant string, condition string, svi_variable string, p_value double")
    picked = M.significant(fits, ["pollutant", "condition"])
    assert rows(M.selected_lists(picked, ["pollutant", "condition"]), "condition") == [("PM", "c1", ["a", "b"])]
    assert M.selection_map(picked, "pollutant", "condition").first()["condition_lists"] == {"c1": ["a", "b"]}


@pytest.fixture(scope="module")
def svi(spark):
    values = {name: 10.0 for name in S.SVI_INDICATORS} | {name: 0.5 for name in S.SVI_RANKS}
    table = [("01", values), ("02", values | {"EP_UNEMP": -999.0}), ("03", values | {"RPL_THEMES": -999.0})]
    return spark.createDataFrame([(k, *[v[n] for n in S.SVI.names[1:]]) for k, v in table], S.SVI)


@pytest.fixture(scope="module")
def cases(spark):
    return spark.createDataFrame([
        (tract.rjust(11, "0"), poll, "c", endpoint, 0.5, 100.0, n)
        for tract in ("01", "02", "03", "04") for poll, n in (("PM", 0.25), ("NOx", 0.5), ("CO", None))
        for endpoint in ("All-cause mortality", "Stroke")],
        "GEOID string, pollutant string, condition string, endpoint string, Final_Conc double, total_pop double, "
        "additional_cases double")


def test_vulnerability_table(cases, svi):
    table = V.vulnerability_table(cases, svi)
    assert {r["FIPS"] for r in table.collect()} == {"00000000001", "00000000002"}
    assert table.filter("FIPS = '00000000002'").first()["Pct_Unemployed"] is None
    assert table.filter("FIPS = '00000000002'").first()["Pct_Minority"] == 10


def test_outcomes_and_pooling(spark, cases, svi):
    table = V.vulnerability_table(cases, svi)
    outcome = V.mortality_rows(table)
    assert outcome.count() == 4 and {r["scaled_cases"] for r in outcome.collect()} == {250.0, 500.0}
    pooled = {r["FIPS"]: r for r in V.pooled_tracts(table).collect()}
    assert pooled["00000000001"]["total_scaled_cases"] == 75000 and pooled["00000000002"]["Pct_Unemployed"] is None
    tracts = spark.createDataFrame([("00000000001",), ("00000000003",)], "GEOID string")
    assert rows(V.svi_by_tract(tracts, table), "GEOID") == [("00000000001", 0.5), ("00000000003", None)]


def test_coefficient_table(spark):
    fits = spark.createDataFrame([
        ("c", "(Intercept)", 9.0), ("c", "Final_Conc", 8.0), ("c", "total_pop", 7.0), ("c", "Pct_No_Vehicle", 2.0),
        ("c", "Pct_Minority", -1.0), ("c", "Other_Thing", None), ("d", "Pct_Crowding", 5.0)],
        "condition string, term string, estimate double")
    got = {(r["condition"], r["term"]): r for r in V.coefficient_table(fits).collect()}
    assert len(got) == 4
    assert got[("c", "Pct_Minority")]["term_position"] == 1 and got[("c", "Pct_No_Vehicle")]["term_position"] == 2
    assert got[("c", "Pct_No_Vehicle")]["clean_term"] == "No Vehicle" and got[("c", "Pct_No_Vehicle")]["theme_rank"] == 4
    assert got[("c", "Other_Thing")]["svi_theme"] == S.OTHER_THEME and got[("d", "Pct_Crowding")]["term_position"] == 1


def test_formatted_results(spark):
    fits = spark.createDataFrame([
        ("PM", "v", "Typical Controlled", 1.23456, 1.0, 2.5, 0.0123), ("PM", "v", "Max Controlled", 1.0, -0.5, 2.0, 0.6)],
        "pollutant string, svi_variable string, condition string, estimate double, conf_low double, conf_high double, p_value double")
    got = V.formatted_results(fits, ["pollutant"]).first()
    assert got["Typical Controlled"] == "1.235 (1–2.5), **p = 0.012**"
    assert got["Max Controlled"] == "1 (-0.5–2), p = 0.6" and got["Max Uncontrolled"] is None


def test_statistics_of_a_hot_group_leave_one_row_per_group(spark):
    df = spark.range(20000).select(
        F.when(F.col("id") % 10 < 4, F.lit("hot")).otherwise((F.col("id") % 50).cast("string")).alias("k"),
        (F.col("id") % 101).cast("double").alias("x"), (F.col("id") % 101 * 3.0 + F.col("id") % 7).alias("y"))
    fits = M.univariate_fits(df, ["k"], "y", ["x"])
    assert fits.count() == df.select("k").distinct().count()


def test_nearly_collinear_indicators_agree_with_least_squares(spark):
    """Two indicators with a correlation of 1 - 1e-9, with means far from zero, over many partitions."""
    r = np.random.default_rng(5)
    n = 4000
    a = 50 + r.normal(size=n)
    b = 1000 + a + r.normal(size=n) * np.std(a) * np.sqrt(2e-9)
    assert 1 - 2e-9 < np.corrcoef(a, b)[0, 1] < 1 - 5e-10
    y = 3 + 2 * a - 1.5 * b + r.normal(size=n) * 1e-6
    data = spark.createDataFrame([("k", float(u), float(v), 2 * float(u), float(w)) for u, v, w in zip(a, b, y)],
                                 "k string, a double, b double, twice double, y double").repartition(13)
    selection = spark.createDataFrame([("k", ["a", "b", "twice"])], "k string, svi_variables array<string>")
    fits = {x["term"]: x for x in M.multivariate_fits(data, ["k"], "y", ["a", "b", "twice"], [], selection, True).collect()}
    x = np.column_stack([np.ones(n), a, b])
    want, *_ = np.linalg.lstsq(x, y, rcond=None)
    q, upper = np.linalg.qr(x)
    rest = y - q @ (q.T @ y)
    error = np.sqrt(rest @ rest / (n - 3)) * np.linalg.norm(np.linalg.inv(upper), axis=1)
    for name, b_, e in zip(("(Intercept)", "a", "b"), want, error):
        assert fits[name]["estimate"] == pytest.approx(b_, rel=1e-6) and fits[name]["std_error"] == pytest.approx(e, rel=1e-6)
    assert fits["twice"]["estimate"] is None and fits["a"]["df"] == n - 3 and abs(fits["a"]["estimate"] - 2) < 0.01
