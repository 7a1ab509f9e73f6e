"""Damages against social vulnerability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airtoll import schemas as S
from airtoll.functions.columns import category_values, column_label, group_of, number_text, rank_in, sum_or_zero
from airtoll.operators.regression import INTERCEPT
from airtoll.sources.staging import staged

STRATIFIED_SCALE = 1000
POOLED_SCALE = 100000


def tract_id(fips: Column) -> Column:
    """Tract ids read as numbers get their leading zeros back; longer ones are not cut."""
    text = fips.cast("string")
    return F.when(F.length(text) < 11, F.lpad(text, 11, "0")).otherwise(text)


def clean_svi(svi: DataFrame) -> DataFrame:
    """Descriptive names, the sentinel turned to null, tracts without overall rank dropped."""
    names = S.SVI_RANKS | S.SVI_INDICATORS
    return svi.select(
        tract_id(F.col("FIPS")).alias("FIPS"),
        *[F.nullif(F.col(old), F.lit(float(S.SVI_MISSING))).alias(new) for old, new in names.items()],
    ).filter(F.col("SVI").isNotNull())


def vulnerability_table(cases: DataFrame, svi: DataFrame) -> DataFrame:
    """Case rows with the vulnerability columns of their tract; tracts without SVI are dropped.

    `svi` is the raw table: the filter on the overall rank runs before the join.
    """
    return cases.withColumn("GEOID", F.col("GEOID").cast("string")).withColumnRenamed(
        "GEOID", "FIPS").join(clean_svi(svi), "FIPS")


def svi_by_tract(tracts: DataFrame, vulnerability: DataFrame, measure: str = "SVI") -> DataFrame:
    """Every tract with its vulnerability value; of several the least."""
    values = vulnerability.groupBy(F.col("FIPS").alias("GEOID")).agg(F.min(measure).alias(measure))
    return tracts.join(values, "GEOID", "left")


def svi_of_exposed(exposed: DataFrame, svi: DataFrame) -> DataFrame:
    """The vulnerability columns of the tracts that have exposed rows: no cases are computed for them."""
    return clean_svi(svi).join(exposed.select(F.col("GEOID").cast("string").alias("FIPS")), "FIPS", "left_semi")


def mortality_rows(vulnerability: DataFrame, scale: float = STRATIFIED_SCALE) -> DataFrame:
    """Mortality rows with known cases and `scaled_cases`, cases times a constant.

    The outcome is not divided by the population.
    """
    return vulnerability.filter(
        (F.col("endpoint") == S.MORTALITY) & F.col("additional_cases").isNotNull()
    ).withColumn("scaled_cases", F.col("additional_cases") * scale)


def pooled_tracts(vulnerability: DataFrame, variables: Sequence[str] = tuple(S.INDICATORS),
                  scale: float = POOLED_SCALE) -> DataFrame:
    """One row per (tract, condition): scaled cases over all pollutants, means of the covariates."""
    return mortality_rows(vulnerability, scale).groupBy("FIPS", "condition").agg(
        sum_or_zero(F.col("scaled_cases")).alias("total_scaled_cases"),
        *[F.avg(c).alias(c) for c in (*variables, "Final_Conc", "total_pop")])


def coefficient_table(fits: DataFrame, keys: Sequence[str] = ("condition",)) -> DataFrame:
    """Model terms with theme, clean label and their position by estimate within each group."""
    terms = fits.filter(~F.col("term").isin(INTERCEPT, "Final_Conc", "total_pop"))
    theme = group_of(F.col("term"), S.SVI_THEMES, S.OTHER_THEME)
    label = F.translate(F.regexp_replace("term", "^Pct_", ""), "_", " ")
    # a group holds at most one row per model term
    order = Window.partitionBy(*keys).orderBy(F.col("estimate").asc_nulls_last(), "term")
    return terms.withColumns({"svi_theme": theme, "clean_term": label}).withColumns(
        {"theme_rank": rank_in(F.col("svi_theme"), [*S.SVI_THEMES, S.OTHER_THEME]),
         "term_position": F.row_number().over(order)})


def result_text(level: float = 0.05) -> Column:
    """`estimate (low–high), p = p`, with the p part in bold below the level."""
    estimate, low, high, p = (
        number_text(F.bround(c, 3)) for c in ("estimate", "conf_low", "conf_high", "p_value"))
    bold = F.when(F.bround("p_value", 3) < level, F.lit("**")).otherwise(F.lit(""))
    return F.concat(estimate, F.lit(" ("), low, F.lit("–"), high, F.lit("), "),
                    bold, F.lit("p = "), p, bold)


def formatted_results(fits: DataFrame, keys: Sequence[str],
                      first: Sequence[str] = tuple(S.CONDITION_ORDER)) -> DataFrame:
    """Result text per (keys, variable), one column per condition: those in `first`, then all others.

    `keys` may be empty for pooled fits. The texts, one per fit, are staged, as they are read twice.
    """
    texts = staged(fits.select(*keys, "svi_variable", "condition", result_text().alias("results")))
    cells = [F.first(F.when(F.col("condition").eqNullSafe(F.lit(c)), F.col("results")), ignorenulls=True).alias(column_label(c))
             for c in category_values(texts, "condition", first)]
    return texts.groupBy(*keys, "svi_variable").agg(*cells)
