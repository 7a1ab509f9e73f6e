"""Small column expressions: missing values, orders, number text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Bits of a digit of an exact sum, and the power of two that its last digit counts. Five digits reach up to 2 ** 76.
DIGIT, FINEST, DIGITS = 28, -64, 5


def exact_sum(column: Column) -> Column:
    """Sum of doubles that doesn't depend on the order or the partitions in which rows are added; null without values.

    The size of a value is cut into whole digits of 28 bits, from 2 ** 48 down to 2 ** -64, which are summed with its sign as longs: without
    rounding and for 30 billion rows a group. Only what is below 2 ** -64 of a value is cut off. Carries are settled
    once, on the sums, to digits from minus to plus half of 2 ** 28, so that equal totals have equal digits and none
    cancels another; they add up in a fixed order. With a value beyond 2 ** 75,
    infinite or not a number, it is the plain sum.
    """
    powers = [2.0 ** (FINEST + DIGIT * i) for i in reversed(range(DIGITS))]
    beyond = F.isnan(column) | (F.abs(column) >= 2.0 ** 75)
    rest, digits = F.when(beyond, F.lit(0.0)).otherwise(F.abs(column.cast("double"))), []
    sign = F.when(column < 0, F.lit(-1)).otherwise(F.lit(1))
    for power in powers:
        digit = F.floor(rest / power)
        digits.append(F.sum(sign * digit))
        rest = rest - digit * F.lit(power)  # exact: what is left has no more bits than before
    wide = F.count_if(beyond) > 0
    settled, carry, half = [], F.lit(0).cast("long"), F.lit(1 << DIGIT - 1)
    for digit in reversed(digits[1:]):
        whole = digit + carry + half
        settled.append(F.pmod(whole, F.lit(1 << DIGIT)) - half)
        carry = F.shiftright(whole, DIGIT)
    settled.append(digits[0] + carry)
    total = reduce(lambda a, b: a + b, [d.cast("double") * F.lit(p) for d, p in zip(settled, reversed(powers), strict=True)])
    return F.when(wide, F.sum(column.cast("double"))).otherwise(total)


def sum_or_zero(column: Column) -> Column:
    """Sum that skips missing values and is 0 when nothing is left; the same however rows are partitioned."""
    return F.coalesce(exact_sum(column), F.lit(0.0))


def number(column: Column) -> Column:
    """Text to double; anything that is not a number becomes null."""
    return column.try_cast("double")


MAX_COLUMNS = 10_000  # more distinct values than this are not a category


def category_values(df: DataFrame, column: str, first: Sequence = ()) -> list:
    """Values of a category that are to become columns: `first`, then all others in `df`, sorted, null last.

    The distinct values go to the driver; more of them than MAX_COLUMNS are an error, none is left out.
    """
    found = [r[0] for r in df.select(column).distinct().limit(MAX_COLUMNS + 1).collect()]
    if len(found) > MAX_COLUMNS:
        raise ValueError(f"{column} has more than {MAX_COLUMNS} values")
    if None in found and column_label(None) in found:
        raise ValueError(f"{column} has both missing values and the value {column_label(None)}, which would share a heading")
    others = sorted((v for v in found if v is not None and v not in first), key=lambda v: (str(type(v)), v))
    return [*first, *others, *([None] if None in found and None not in first else [])]


def column_label(value: object) -> str:
    """Heading of a category that became a column."""
    return "NA" if value is None else str(value)


def rank_in(column: Column, order: Sequence[str]) -> Column:
    """Position of a category in a display order, null for an unlisted one."""
    positions = F.create_map(*[F.lit(v) for i, name in enumerate(order) for v in (name, i + 1)])
    return F.try_element_at(positions, column)


def recode(column: Column, names: Mapping[str, str]) -> Column:
    """Replace listed values and pass the others through."""
    table = F.create_map(*[F.lit(v) for pair in names.items() for v in pair])
    return F.coalesce(F.try_element_at(table, column), column)


def group_of(column: Column, groups: Mapping[str, Sequence[str]], other: str) -> Column:
    """Name of the first group that lists the value."""
    branches = [F.when(column.isin(list(members)), F.lit(name)) for name, members in groups.items()]
    return F.coalesce(*branches, F.lit(other))


def matched(column: Column, pattern: str, group: int) -> Column:
    """Capture group of the first match; null (not '') when the pattern does not match."""
    return F.when(column.rlike(pattern), F.regexp_extract(column, pattern, group))


def plain_name(file_name: Column) -> Column:
    """File name without the escapes that the file metadata carries (`%20` for a blank)."""
    return F.url_decode(F.regexp_replace(file_name, r"\+", "%2B"))


def clamp(column: Column, low: float, high: float) -> Column:
    """Squeeze into [low, high]; null stays null."""
    return F.when(column.isNotNull(), F.least(F.greatest(column, F.lit(low)), F.lit(high)))


def fixed_text(column: Column, decimals: int, missing: str | None = None) -> Column:
    """Fixed-decimals text without thousands separators."""
    text = F.format_string(f"%.{decimals}f", F.round(column, decimals))
    text = F.when(column.isNotNull(), text)
    return text if missing is None else F.coalesce(text, F.lit(missing))


def number_text(column: Column, decimals: int = 3) -> Column:
    """Shortest text of a rounded number: no trailing zeros, exponent only when shorter.

    100000 prints as 1e+05 but 123456 as 123456; 0.250 prints as 0.25 and 1.000 as 1.
    """
    rounded = F.round(column, decimals)
    fixed = F.regexp_replace(F.format_string(f"%.{decimals}f", F.abs(rounded)), r"\.?0+$", "")
    whole = F.format_string("%.0f", F.abs(rounded))
    integral = F.abs(rounded) == F.floor(F.abs(rounded))
    mantissa = F.rtrim(whole, F.lit("0"))
    digits = F.length(mantissa)
    exponent = F.length(whole) - 1
    scientific = F.concat(
        F.substring(mantissa, 1, 1),
        F.when(digits > 1, F.concat(F.lit("."), F.substring(mantissa, 2, 400))).otherwise(F.lit("")),
        F.lit("e+"), F.lpad(exponent.cast("string"), 2, "0"),
    )
    plain = F.when(
        integral & (F.abs(rounded) > 0),
        F.when(F.length(whole) > F.length(scientific), scientific).otherwise(whole),
    ).otherwise(F.when(rounded == 0, F.lit("0")).otherwise(fixed))
    sign = F.when(rounded < 0, F.lit("-")).otherwise(F.lit(""))
    infinite = F.abs(column) == F.lit(float("inf"))
    return (
        F.when(column.isNull(), F.lit("NA"))
        .when(F.isnan(column), F.lit("NaN"))
        .when(infinite, F.concat(F.when(column < 0, F.lit("-")).otherwise(F.lit("")), F.lit("Inf")))
        .otherwise(F.concat(sign, plain))
    )


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner",
                   condition: Column | None = None) -> DataFrame:
    """Equi-join in which a missing key matches a missing key; key columns come from the left."""
    renamed = right.withColumnsRenamed({key: f"__right_{key}" for key in keys})
    tests = [F.col(key).eqNullSafe(F.col(f"__right_{key}")) for key in keys]
    if condition is not None:
        tests.append(condition)
    joined = left.join(renamed, reduce(lambda a, b: a & b, tests), how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__right_{k}" for k in keys])
