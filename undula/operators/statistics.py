"""Group statistics as aggregations: tests, contrasts, multiple comparisons."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from undula.functions.columns import ci95, safe_corr
from undula.functions.dense import contrast_f, contrast_t, signed_rank_p, student_p
from undula.operators.ordering import at_positions, joined, least_from, value_ranks

Keys = Sequence[str]


def summary(rows: DataFrame, value: str, keys: Keys = ()) -> DataFrame:
    """(keys, n, mean, sd, ci): sample deviation and half the 95 % interval."""
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), ci95(F.col(value)).alias("ci"))


def one_sample_t(rows: DataFrame, value: str, keys: Keys = ()) -> DataFrame:
    """(keys, n, t, d): t of the mean against 0 and mean / sd; null for fewer than two values or no spread."""
    x = F.col(value)
    return rows.groupBy(*keys).agg(
        F.count(x).alias("n"),
        F.try_divide(F.avg(x), F.stddev_samp(x) / F.sqrt(F.count(x))).alias("t"),
        F.try_divide(F.avg(x), F.stddev_samp(x)).alias("d"),
    )


def paired_t(rows: DataFrame, unit: str, condition: str, value: str, first, second, keys: Keys = ()) -> DataFrame:
    """(keys, n, t, d) of first minus second over the units that have both; several values of a unit are averaged."""
    mean_of = lambda c: F.avg(F.when(F.col(condition) == c, F.col(value)))
    both = rows.where(F.col(condition).isin(first, second)).groupBy(*keys, unit).agg((mean_of(first) - mean_of(second)).alias("_d"))
    return one_sample_t(both.where("_d is not null"), "_d", keys)


def pooled_t(rows: DataFrame, is_first: str, value: str, keys: Keys = ()) -> DataFrame:
    """(keys, n1, n2, t, d): two samples, equal variances; is_first names a boolean column."""
    a, b = F.when(F.col(is_first), F.col(value)), F.when(~F.col(is_first), F.col(value))
    m = rows.groupBy(*keys).agg(
        F.count(a).alias("n1"), F.count(b).alias("n2"), (F.avg(a) - F.avg(b)).alias("_diff"), F.var_samp(a).alias("_v1"), F.var_samp(b).alias("_v2")
    )
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("_v1") + (F.col("n2") - 1) * F.col("_v2")) / F.nullif(F.col("n1") + F.col("n2") - 2, F.lit(0)))
    d = F.try_divide(F.col("_diff"), pooled)
    return m.select(*keys, "n1", "n2", (d / F.sqrt(1 / F.col("n1") + 1 / F.col("n2"))).alias("t"), d.alias("d"))


def icc(rows: DataFrame, unit: str, rating: str, value: str, form: str = "3,1") -> DataFrame:
    """One row: intraclass correlation (1,1) or (3,1) over units that have every rating, one value each."""
    ratings = rows.select(rating).distinct().agg(F.count("*").alias("k"))
    units = rows.groupBy(unit).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q")).join(F.broadcast(ratings)).where("n = k")
    whole = units.agg(F.count("*").alias("n"), F.max("k").alias("k"), F.sum("s").alias("_all"), F.sum("q").alias("_squares"), F.sum(F.col("s") * F.col("s")).alias("_unit"))
    columns = rows.join(units.select(unit), unit, "left_semi").groupBy(rating).agg(F.sum(value).alias("c")).agg(F.sum(F.col("c") * F.col("c")).alias("_rating"))
    n, k, mean = F.col("n"), F.col("k"), F.col("_all") * F.col("_all") / (F.col("n") * F.col("k"))
    between = (F.col("_unit") / k - mean) / F.nullif(n - 1, F.lit(0))
    if form == "1,1":
        rest = (F.col("_squares") - F.col("_unit") / k) / F.nullif(n * (k - 1), F.lit(0))
    else:
        rest = (F.col("_squares") - F.col("_unit") / k - F.col("_rating") / n + mean) / F.nullif((n - 1) * (k - 1), F.lit(0))
    return whole.join(F.broadcast(columns)).select("n", F.try_divide(between - rest, between + (k - 1) * rest).alias("icc"))


def bh_adjusted(tests: DataFrame, p: str, keys: Keys = (), q: float = 0.05, dependent: bool = False, published_scale: bool = False) -> DataFrame:
    """tests with `adjusted`: Benjamini-Hochberg (or Yekutieli, for dependent tests) p-values within keys.

    published_scale divides by q too, a scaling that a published script of this analysis
    has and that makes adjusted values 1/q times too large. Ties share the largest rank. A
    null p counts as no test.
    """
    m = F.col("total")
    factor = F.aggregate(F.sequence(F.lit(1), m.cast("int")), F.lit(0.0), lambda a, i: a + 1 / i) if dependent else F.lit(1.0)
    return _step_up(tests, p, keys, m * factor / (q if published_scale else 1.0), "adjusted")


def _step_up(tests: DataFrame, p: str, keys: Keys, factor: Column, name: str, ranks: DataFrame | None = None) -> DataFrame:
    """tests with `name`: the least of p times factor / rank over the p-values from its own on, 1 at most; null where p is."""
    ranks = value_ranks(tests, p, keys) if ranks is None else ranks
    scaled = F.col(p) * factor / (F.col("below") + F.col("count"))
    found = least_from(ranks, p, scaled, keys, "_least").select(*keys, p, F.least("_least", F.lit(1.0)).alias(name))
    return tests.join(found, [*keys, p], "left").select(*tests.columns, name)


def q_values(tests: DataFrame, p: str, keys: Keys = ()) -> DataFrame:
    """tests with `q`: Storey's q-values within keys; null where p is.

    The share of true nulls is the least over the grid 0.05 .. 0.9 of mean(p > l) / (1 - l),
    1 at most and one test at least; the counts of the grid are one aggregation.
    """
    grid = [g / 20 for g in range(1, 19)]
    x = F.col(p)
    shares = [F.avg((x > g).cast("double")) / (1 - g) for g in grid]
    nulls = tests.where(x.isNotNull()).groupBy(*keys).agg(F.least(F.lit(1.0), F.greatest(F.least(*shares), 1 / F.count(p))).alias("_nulls"))
    ranks = joined(value_ranks(tests, p, keys), nulls, keys)
    return _step_up(tests, p, keys, F.col("_nulls") * F.col("total"), "q", ranks)


def bonferroni(tests: DataFrame, p: str, keys: Keys = ()) -> DataFrame:
    """tests with `adjusted`: p times the number of tests of its keys, 1 at most."""
    sizes = tests.groupBy(*keys).agg(F.count("*").alias("_m"))
    return joined(tests, sizes, keys).withColumn("adjusted", F.least(F.col(p) * F.col("_m"), F.lit(1.0))).select(*tests.columns, "adjusted")


def signed_rank(rows: DataFrame, difference: str, keys: Keys = ()) -> DataFrame:
    """(keys, n, w, z): Wilcoxon signed-rank sum of positive differences, average ranks on ties, zeros dropped; z by the normal approximation.

    Ranks come from counts of equal magnitudes, so that ties are summed before ordering.
    """
    nonzero = rows.where(F.col(difference) != 0)
    sizes = nonzero.groupBy(*keys, F.abs(difference).alias("m")).agg(F.count("*").alias("c"), F.sum((F.col(difference) > 0).cast("long")).alias("up"))
    below = F.sum("c").over(Window.partitionBy(*keys).orderBy("m").rowsBetween(Window.unboundedPreceding, -1))
    ranked = sizes.withColumn("rank", F.coalesce(below, F.lit(0)) + (F.col("c") + 1) / 2)
    out = ranked.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("w"), F.sum(F.pow(F.col("c"), F.lit(3.0)) - F.col("c")).alias("_t"))
    n = F.col("n")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_t") / 48)
    return out.select(*keys, "n", "w", F.try_divide(F.col("w") - n * (n + 1) / 4, spread).alias("z"))


def signed_rank_tests(rows: DataFrame, difference: str, keys: Keys = ()) -> DataFrame:
    """signed_rank with two-sided `p`: exact for up to 15 differences without ties, else by the normal approximation; null without spread."""
    tests = signed_rank(rows, difference, keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for found in batches:
            yield found.assign(p=[signed_rank_p(int(n), w, z) for n, w, z in zip(found["n"], found["w"], found["z"])])

    kinds = dict(tests.dtypes)
    return tests.mapInPandas(run, ", ".join([f"{c} {kinds[c]}" for c in tests.columns] + ["p double"]))


def with_p(tests: DataFrame, t: str = "t", df: str = "df", name: str = "p") -> DataFrame:
    """tests with the two-sided p of their t and degrees of freedom; null where either is null. One row in, one out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for found in batches:
            known = found[t].notna() & found[df].notna() & (found[df] > 0)
            yield found.assign(**{name: [student_p(x, n) if ok else None for x, n, ok in zip(found[t], found[df], known)]})

    kinds = dict(tests.dtypes)
    return tests.mapInPandas(run, ", ".join([f"{c} {kinds[c]}" for c in tests.columns] + [f"{name} double"]))


def retest(rows: DataFrame, unit: str, rating: str, value: str, first, second, keys: Keys = ()) -> DataFrame:
    """(keys, n, r, icc): correlation and ICC (3,1) of two ratings, over the units that have both; null without spread."""
    of = lambda c: F.avg(F.when(F.col(rating) == c, F.col(value)))
    both = rows.groupBy(*keys, unit).agg(of(first).alias("a"), of(second).alias("b")).where("a is not null and b is not null")
    up, down = F.var_samp(F.col("a") + F.col("b")), F.var_samp(F.col("a") - F.col("b"))
    return both.groupBy(*keys).agg(F.count("*").alias("n"), safe_corr(F.col("a"), F.col("b")).alias("r"), F.try_divide(up - down, up + down).alias("icc"))


def mad_outliers(rows: DataFrame, values: list[str], scaled_mads: float = 3.0) -> DataFrame:
    """rows with `is_outlier`: any value further than so many scaled median deviations from its median."""
    mid = rows.agg(*[F.median(c).alias(f"_m_{c}") for c in values])
    with_mid = rows.join(F.broadcast(mid))
    mad = with_mid.agg(*[F.median(F.abs(F.col(c) - F.col(f"_m_{c}"))).alias(f"_d_{c}") for c in values])
    far = [F.coalesce(F.abs(F.col(c) - F.col(f"_m_{c}")) > scaled_mads * 1.4826 * F.col(f"_d_{c}"), F.lit(False)) for c in values]
    flagged = F.exists(F.array(*far), lambda x: x)
    return with_mid.join(F.broadcast(mad)).withColumn("is_outlier", flagged).drop(*[f"_{k}_{c}" for k in "md" for c in values])


def trend(rows: DataFrame, x: str, y: str, keys: Keys = ()) -> DataFrame:
    """(keys, slope, intercept, r) of the least-squares line."""
    slope = F.try_divide(F.covar_pop(x, y), F.var_pop(x))
    return rows.groupBy(*keys).agg(
        slope.alias("slope"), (F.avg(y) - slope * F.avg(x)).alias("intercept"), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias("r")
    )


def midpoint_percentile(rows: DataFrame, value: str, percent: float, keys: Keys = ()) -> DataFrame:
    """(keys, percentile) with sorted value i of n at 100 (i - 0.5) / n, linear between, clamped at the ends."""
    n = F.col("total")
    place = F.least(F.greatest(F.lit(percent / 100) * n + 0.5, F.lit(1.0)), n.cast("double"))
    return at_positions(value_ranks(rows, value, keys), value, place, keys, "percentile")


def exceedance(observed: DataFrame, permuted: DataFrame, keys: Keys, statistic: str = "t", largest: str = "max_t") -> DataFrame:
    """(keys, p): share of permutations whose largest magnitude exceeds the observed magnitude, without adding one."""
    return observed.join(permuted, list(keys)).groupBy(*keys).agg(F.avg((F.col(largest) > F.abs(statistic)).cast("double")).alias("p"))


def design_moments(rows: DataFrame, x: list[str], y: str) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(X'X, X'y, y'y, n) of the rows without nulls: one aggregation, of which the driver sees the sums."""
    products = [F.sum(F.col(a) * F.col(b)) for a in [*x, y] for b in [*x, y]]
    known = rows.select(*[F.col(c).cast("double").alias(c) for c in [*x, y]]).dropna()
    *sums, n = known.agg(*[F.coalesce(p, F.lit(0.0)).alias(f"p{i}") for i, p in enumerate(products)], F.count("*").alias("n")).first()
    m = np.array(sums).reshape(len(x) + 1, -1)
    return m[:-1, :-1], m[:-1, -1], float(m[-1, -1]), n


def glm_contrast(rows: DataFrame, x: list[str], y: str, contrast: list[float], value: float = 0.0) -> DataFrame:
    """One row (t, p, df): the contrast of a linear model's coefficients against a value; give a column of ones for an intercept."""
    t, p, df = contrast_t(*design_moments(rows, x, y), np.array(contrast, float), value)
    return rows.sparkSession.createDataFrame([(t, p, df)], "t double, p double, df long")


def glm_f(rows: DataFrame, x: list[str], y: str, contrasts: list[list[float]]) -> DataFrame:
    """One row (f, p, df1, df2): all contrasts (one list for each) at once."""
    f, p, df1, df2 = contrast_f(*design_moments(rows, x, y), np.array(contrasts, float).T)
    return rows.sparkSession.createDataFrame([(f, p, df1, df2)], "f double, p double, df1 long, df2 long")


def residualised(rows: DataFrame, x: list[str], y: str) -> DataFrame:
    """rows with `residual`: y less its least-squares fit on the columns x; null where a value is missing."""
    xx, xy, _, _ = design_moments(rows, x, y)
    b = np.linalg.pinv(xx) @ xy
    return rows.withColumn("residual", F.col(y) - sum((F.col(c) * float(v) for c, v in zip(x, b, strict=True)), F.lit(0.0)))
