"""Log-linear concentration response."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from airtoll.functions.columns import number

RATE_BASE = 100000  # rates are per 100,000 persons


def response_coefficient(relative_risk: Column) -> Column:
    return F.ln(relative_risk)


def rate_per_person(rate: Column) -> Column:
    return number(rate) / RATE_BASE


def attributable_cases(baseline: Column, population: Column, beta: Column,
                       concentration: Column) -> Column:
    return baseline * population * (1 - F.exp(-beta * concentration))
