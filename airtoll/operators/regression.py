"""Grouped Gaussian linear models from sufficient statistics.

A group is never collected: facts are reduced to sums, or to the triangle of an orthogonal
decomposition, and a model is solved from the one row that is left of its group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airtoll.functions.columns import join_null_safe
from airtoll.functions.student import half_width_factor, p_value
from airtoll.sources.staging import staged

ALIAS_TOLERANCE = 1e-11  # share of a term's length left after the earlier terms
INTERCEPT = "(Intercept)"


def add_interval(fits: DataFrame, interval: str = "normal", exponentiate: bool = False,
                 with_p: bool = True) -> DataFrame:
    """statistic, p_value and 95 % limits from (estimate, std_error, df).

    The limits use the normal quantile, as a Gaussian GLM does, or Student t; the p-value always
    uses Student t. exponentiate turns the estimate and its limits into ratios.
    """
    df = F.col("df")
    reach = half_width_factor(df, interval) * F.col("std_error")
    out = fits.withColumn("statistic", F.try_divide(F.col("estimate"), F.col("std_error"))).withColumns(
        {"conf_low": F.col("estimate") - reach, "conf_high": F.col("estimate") + reach})
    if with_p:
        exact = (F.col("std_error") == 0) & (F.col("estimate") != 0)
        out = out.withColumn("p_value", F.when(exact, F.lit(0.0)).otherwise(p_value(F.col("statistic"), df)))
    if exponentiate:
        out = out.withColumns({c: F.exp(c) for c in ("estimate", "conf_low", "conf_high")})
    return out


def univariate_fits(data: DataFrame, keys: Sequence[str], outcome: str, variables: Sequence[str]) -> DataFrame:
    """One simple regression per (keys, variable): estimate, intercept, std_error, df, n.

    All models come from one grouped aggregation: a row is unfolded to its variables inside the
    task and combined before the shuffle. Rows with a missing value are left out per variable.
    """
    pairs = F.array(*[F.struct(F.lit(v).alias("svi_variable"), F.col(v).cast("double").alias("x")) for v in variables])
    y, x = F.col("y"), F.col("x")
    rows = data.select(*keys, F.col(outcome).alias("y"), F.inline(pairs)).groupBy(*keys, "svi_variable").agg(
        F.regr_count(y, x).alias("n"), F.regr_avgx(y, x).alias("mx"), F.regr_avgy(y, x).alias("my"),
        F.regr_sxx(y, x).alias("sxx"), F.regr_sxy(y, x).alias("sxy"), F.regr_syy(y, x).alias("syy"))
    slope = F.when(F.col("sxx") > 0, F.col("sxy") / F.col("sxx"))
    rest = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
    return (
        rows.withColumn("slope", slope).withColumn("df", (F.col("n") - 2).cast("long"))
        .select(*keys, "svi_variable", F.col("slope").alias("estimate"),
                (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"),
                F.when(F.col("df") > 0, F.sqrt(rest / F.col("df") / F.when(F.col("sxx") > 0, F.col("sxx"))))
                .alias("std_error"),
                "df", "n")
    )


def significant(fits: DataFrame, keys: Sequence[str], level: float = 0.05) -> DataFrame:
    """(keys, svi_variable) of the fits below the level."""
    return fits.filter(F.col("p_value") < level).select(*keys, "svi_variable").distinct()


def selected_lists(selection: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, svi_variables): the selected variables of every group as a sorted array."""
    return selection.groupBy(*keys).agg(F.array_sort(F.collect_set("svi_variable")).alias("svi_variables"))


def selection_map(selection: DataFrame, key: str, inner: str) -> DataFrame:
    """Per key a map from the inner key to its list of variables."""
    lists = selected_lists(selection, [key, inner])
    return lists.groupBy(key).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(inner, "svi_variables")))).alias("condition_lists"))


FIT_FIELDS = [
    T.StructField("term", T.StringType()), T.StructField("estimate", T.DoubleType()),
    T.StructField("std_error", T.DoubleType()), T.StructField("df", T.LongType()),
    T.StructField("n", T.LongType()),
]


GROUPS_HELD = 2000
BRANCHES = 64  # triangles of a group that are merged in one task, before those are


def triangle(rows: np.ndarray) -> np.ndarray:
    """Upper triangle of an orthogonal decomposition of the rows, square: it has their products, without squaring them."""
    size = rows.shape[1]
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((size - len(r), size))]) if len(r) < size else r


def _triangles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One triangle per group of one partition."""
    held: dict[int, np.ndarray] = {}

    def told() -> pd.DataFrame:
        branch = np.arange(len(held)) + TaskContext.get().partitionId()
        return pd.DataFrame({"group_id": np.asarray(list(held), np.int64), "branch": branch % BRANCHES, "r": [r.tobytes() for r in held.values()]})

    for batch in batches:
        ids, values = batch["group_id"].to_numpy(), batch.drop(columns="group_id").to_numpy(float)
        order = np.argsort(ids, kind="stable")
        names, starts = np.unique(ids[order], return_index=True)
        for name, at in zip(names, np.split(order, starts[1:]), strict=True):
            part = values[at]
            held[name] = triangle(np.vstack([held[name], part]) if name in held else part)
        if len(held) > GROUPS_HELD:
            yield told()
            held.clear()
    yield told()


def _merged(size: int):
    """The triangle of several stacked ones."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(r).reshape(size, size) for r in frame["r"]]
        out = parts[0]
        for part in parts[1:]:
            out = triangle(np.vstack([out, part]))
        return frame.head(1).assign(r=[out.tobytes()])
    return run


def _solve(x: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Least squares of y on the columns of x, in whose span only those are kept that stand out from the ones before.

    x and y are columns of a triangle that stands for n rows. Returns estimates, standard errors (nan
    where a column is left out) and degrees of freedom.
    """
    p = x.shape[1]
    kept: list[int] = []
    basis: list[np.ndarray] = []
    for j in range(p):
        left = x[:, j].copy()
        for _ in range(2):  # the second time takes what rounding left of the first
            for q in basis:
                left -= q * (q @ left)
        norm = np.linalg.norm(left)
        if norm > ALIAS_TOLERANCE * np.linalg.norm(x[:, j]) and len(kept) < n:
            kept.append(j)
            basis.append(left / norm)
    estimate, error = np.full(p, np.nan), np.full(p, np.nan)
    df = n - len(kept)
    if kept:
        q = np.stack(basis, axis=1)
        upper = np.triu(q.T @ x[:, kept])
        estimate[kept] = np.linalg.solve(upper, q.T @ y)
        rest = y - q @ (q.T @ y)
        if df > 0:
            inverse = np.linalg.inv(upper)
            error[kept] = np.sqrt(float(rest @ rest) / df) * np.linalg.norm(inverse, axis=1)
    return estimate, error, df


def multivariate_fits(data: DataFrame, keys: Sequence[str], outcome: str, candidates: Sequence[str],
                      always: Sequence[str], selection: DataFrame, require_selected: bool) -> DataFrame:
    """One linear model per group on its selected variables followed by the `always` terms.

    `selection` holds (keys, svi_variables). A group without selected variables is fitted on the
    `always` terms, or left out when require_selected is set. Rows with a missing outcome or a
    missing model variable are left out of that group's model. Rows of a partition are reduced to a triangle per group, which is
    as well conditioned as the rows themselves; triangles are merged in two steps, the first by branches, and aliased
    terms are left out at the end. `data` is read twice and should be staged.
    """
    terms = [*candidates, *always]
    how = "inner" if require_selected else "left"
    chosen = join_null_safe(data.select(*keys, outcome, *terms), selection, keys, how)
    chosen = chosen.withColumn("svi_variables", F.coalesce("svi_variables", F.array().cast("array<string>")))

    def used(v: str) -> Column:
        return F.lit(True) if v in always else F.array_contains("svi_variables", v)

    complete = F.col(outcome).isNotNull()
    for v in terms:
        complete = complete & (~used(v) | F.col(v).isNotNull())
    rows = chosen.filter(complete).select(
        *keys, F.col(outcome).alias("t0"),
        *[F.when(used(v), F.col(v)).otherwise(F.lit(0.0)).alias(f"t{i}") for i, v in enumerate(terms, 1)],
        "svi_variables")
    columns = [f"t{i}" for i in range(len(terms) + 1)]
    # one row per group; staged, so that the group numbers stay what they are
    groups = staged(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.first("svi_variables").alias("used"))
                    .withColumn("group_id", F.monotonically_increasing_id()))
    named = join_null_safe(rows.select(*keys, *columns), groups.select(*keys, "group_id"), keys)
    size = len(columns) + 1
    found = named.select("group_id", F.lit(1.0).alias("one"), *columns[1:], columns[0]).mapInPandas(_triangles, "group_id long, branch int, r binary")
    for level in (["group_id", "branch"], ["group_id"]):
        found = found.groupBy(*level).applyInPandas(_merged(size), "group_id long, branch int, r binary")
    groups = groups.join(found.drop("branch"), "group_id").drop("group_id")

    schema = T.StructType([*[f for f in data.select(*keys).schema.fields], *FIT_FIELDS])
    keys, candidates, always = list(keys), list(candidates), list(always)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for row in batch.itertuples(index=False):
                group, n = tuple(row[: len(keys)]), int(row.n)
                r = np.frombuffer(row.r).reshape(size, size)
                names = [v for v in candidates if v in set(row.used)] + always
                estimate, error, df = _solve(r[:, [0, *(terms.index(v) + 1 for v in names)]], r[:, -1], n)
                out.extend((*group, v, b, e, df, n) for v, b, e in zip([INTERCEPT, *names], estimate, error, strict=True))
            yield pd.DataFrame(out, columns=schema.names)

    fitted = groups.mapInPandas(solve, schema)
    missing = F.lit(None).cast("double")
    return fitted.withColumns({c: F.nanvl(c, missing) for c in ("estimate", "std_error")})
