"""Queries that fit models; those without SQL are tested against numpy and known systems."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from undula.functions.columns import period_seconds, safe_corr
from undula.operators import modes as O
from undula.operators import families as A
from undula.operators import heritability as H
from undula.operators import moments as M
from undula.operators import patterns as C
from undula.operators import series as S
from undula.operators import statistics as T
from undula.operators import templates as Q
from undula.operators.panel import regress_global_signal, split_in_time
from undula.sources.staging import written
from undula.sources.tables import embedding_panel, read

CHANNELS = 64
#: Phases a step of 1.5 s between 0.01 and 0.1 Hz.
LOW, HIGH = 2 * math.pi * 1.5 * 0.01, 2 * math.pi * 1.5 * 0.1
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def labelled_panel(spark: SparkSession, d: str) -> DataFrame:
    """The embedding panel with its label as the session."""
    vectors = read(spark, d, "embeddings").where("vec_id is not null")
    each = vectors.select("label", F.col("vec_id").alias("t"), F.posexplode(F.col("embedding").cast("array<double>")).alias("p", "value"))
    return each.select("label", (F.col("p") + 1).alias("channel"), "t", "value")


def _moments(spark: SparkSession, d: str) -> DataFrame:
    return O.session_moments(labelled_panel(spark, d), ["label"], CHANNELS)


@query
def group_modes(spark: SparkSession, d: str) -> DataFrame:
    """L-05, L-06, B-13, F-02: modes of the group from summed moments."""
    vectors, values, _ = O.fit_group(_moments(spark, d), CHANNELS, LOW, HIGH)
    return O.mode_table(spark, vectors, values)


@query
def group_fit(spark: SparkSession, d: str) -> DataFrame:
    """L-05, L-06: how many eigenvalues the band keeps, and how many are rounding noise."""
    return O.fit_report(_moments(spark, d), CHANNELS, LOW, HIGH)


@query
def subject_metrics(spark: SparkSession, d: str) -> DataFrame:
    """L-07, L-09: eigenvalues refitted for each label."""
    moments = _moments(spark, d)
    vectors, _, _ = O.fit_group(moments, CHANNELS, LOW, HIGH)
    return O.subject_metrics(moments, ["label"], vectors[:, :10], CHANNELS)


@query
def mode_engagement(spark: SparkSession, d: str) -> DataFrame:
    """L-08, D-16."""
    panel = labelled_panel(spark, d)
    vectors, _, _ = O.fit_group(O.session_moments(panel, ["label"], CHANNELS), CHANNELS, LOW, HIGH)
    return O.engagement(panel, ["label"], vectors[:, :10], CHANNELS)


@query
def forecast_cv(spark: SparkSession, d: str) -> DataFrame:
    """L-10 to L-14, E-17: labels in five folds; each label's last fifth is forecast by modes of the other folds.

    1 to 12 pairs of modes, as far as a fold has them, the null, persistence, a sparse
    and a kernel model.
    """
    panel = labelled_panel(spark, d)
    dealt, vectors = O.fold_modes(O.session_moments(panel, ["label"], CHANNELS), "label", CHANNELS, LOW, HIGH)
    return O.forecasts(panel.join(dealt, "label"), ["fold", "label"], vectors, CHANNELS, range(1, 13), sparse=0.01, kernel=20.0)


@query
def forecast_grid(spark: SparkSession, d: str) -> DataFrame:
    """Mean loss of the sparse model by weight and of the kernel model by width, over all labels; it chooses nothing, forecast_choice does."""
    every = O.parameter_scores(labelled_panel(spark, d), ["label"], CHANNELS, (0.005, 0.01, 0.02, 0.05), (5.0, 20.0, 50.0, 100.0))
    return every.groupBy("model", "parameter").agg(F.avg("loss").alias("loss"), F.avg("r2").alias("r2"))


@query
def forecast_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Signed ranks, over labels, of the loss of each model less that of the null; forecast_tests compares models with each other."""
    f = forecast_cv(spark, d).select("label", "model", "n_modes", (F.col("loss") - 1).alias("difference"))
    return T.signed_rank(f.where("model <> 'null'"), "difference", ["model", "n_modes"])


@query
def mode_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Magnitude of the cosine between the modes of largest modulus of every two folds, which may be different modes; mode_matching matches them."""
    _, vectors = O.fold_modes(_moments(spark, d), "label", CHANNELS, LOW, HIGH)
    first = [(f, i + 1, float(x.real), float(x.imag)) for f, v in vectors.items() if v.shape[1] for i, x in enumerate(v[:, 0] / math.sqrt((abs(v[:, 0]) ** 2).sum()))]
    m = spark.createDataFrame(first, "fold int, channel int, re double, im double")
    other = m.select(F.col("fold").alias("other"), "channel", F.col("re").alias("ore"), F.col("im").alias("oim"))
    both = m.join(other, "channel").where("fold < other")
    return both.groupBy("fold", "other").agg(F.hypot(F.sum(F.expr("re * ore + im * oim")), F.sum(F.expr("im * ore - re * oim"))).alias("cosine"))


@query
def test_retest(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of the engagement of two modes between two halves of each label's time: ICC (3,1); retest_eigenvalues has refitted ones."""
    halves = split_in_time(labelled_panel(spark, d), ["label"], 0.5).withColumn("half", F.col("is_fit").cast("int")).drop("is_fit")
    vectors, _, _ = O.fit_group(_moments(spark, d), CHANNELS, LOW, HIGH)
    metrics = O.engagement(halves, ["label", "half"], vectors[:, :4], CHANNELS)
    each = [T.icc(metrics.where(F.col("mode_idx") == k), "label", "half", "b_mean").select(F.lit(k).alias("mode_idx"), "n", "icc") for k in (1, 3)]
    return each[0].unionByName(each[1])


@query
def band_passed(spark: SparkSession, d: str) -> DataFrame:
    """L-01."""
    return O.filtered(labelled_panel(spark, d), ["label"], 1 / 0.72, 0.01, 0.1)


@query
def spline_resampled(spark: SparkSession, d: str) -> DataFrame:
    """L-03."""
    return O.resampled(labelled_panel(spark, d), ["label"], 0.72, 1.5)


@query
def mode_reconstruction(spark: SparkSession, d: str) -> DataFrame:
    """L-28, C-12: twenty frames of the first pair of modes."""
    return O.reconstructed(group_modes(spark, d).where("mode_idx <= 2"), 20)


@query
def phase_fc(spark: SparkSession, d: str) -> DataFrame:
    """L-27, B-14: cosine of phase differences of the first modes."""
    return O.phase_coupling(group_modes(spark, d).where("mode_idx in (1, 3, 5)"))


def _full_fc(spark: SparkSession, d: str) -> DataFrame:
    return M.symmetric(M.correlation_matrix(embedding_panel(spark, d)), diagonal=1.0)


@query
def network_clusters(spark: SparkSession, d: str) -> DataFrame:
    """L-21: seven networks of channels by their rows of correlations."""
    return C.clusters(C.row_vectors(_full_fc(spark, d)), 7).select("i", "cluster")


@query
def network_clusters_17(spark: SparkSession, d: str) -> DataFrame:
    """L-21: seventeen networks of channels."""
    return C.clusters(C.row_vectors(_full_fc(spark, d)), 17).select("i", "cluster")


@query
def mode_periods(spark: SparkSession, d: str) -> DataFrame:
    """L-36, L-09: seconds for a turn of each mode, a step being 1.5 s, and its persistence."""
    m = group_modes(spark, d).select("mode_idx", "lambda_re", "lambda_im").distinct()
    return m.select("mode_idx", period_seconds(F.abs(F.atan2("lambda_im", "lambda_re")), 1.5).alias("period"), F.hypot("lambda_re", "lambda_im").alias("persistence"))


@query
def nuisance_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """L-39: each label's channels less their fit on the global signal, an intercept and a quadratic trend."""
    panel = labelled_panel(spark, d)
    signal = panel.groupBy(F.col("label").alias("label"), F.col("t").alias("t")).agg(F.avg("value").alias("value")).withColumn("name", F.lit("global"))
    return O.nuisance_residual(panel, signal, ["label"])


@query
def fc_gradients(spark: SparkSession, d: str) -> DataFrame:
    """L-19."""
    return C.gradients(C.row_vectors(_full_fc(spark, d)))


@query
def fc_communities(spark: SparkSession, d: str) -> DataFrame:
    """L-30."""
    return C.communities(_full_fc(spark, d))


@query
def fc_communities_spread(spark: SparkSession, d: str) -> DataFrame:
    """L-30, for graphs larger than a machine: edges stay in tasks."""
    return C.spread_communities(_full_fc(spark, d))


@query
def global_signal_coupling(spark: SparkSession, d: str) -> DataFrame:
    """L-18."""
    panel = labelled_panel(spark, d)
    vectors, _, _ = O.fit_group(O.session_moments(panel, ["label"], CHANNELS), CHANNELS, LOW, HIGH)
    return O.global_coupling(panel, ["label"], vectors[:, :10], CHANNELS)


@query
def mode_lag_projection(spark: SparkSession, d: str) -> DataFrame:
    """L-32."""
    return O.lag_projection(group_modes(spark, d).where("mode_idx in (1, 3, 5)"))


@query
def feature_time_course(spark: SparkSession, d: str) -> DataFrame:
    """L-34: a reconstruction's frames against the mean pattern of each label."""
    features = labelled_panel(spark, d).groupBy(F.col("label").alias("feature"), "channel").agg(F.avg("value").alias("weight"))
    return O.feature_course(mode_reconstruction(spark, d), features)


@query
def coactivation_patterns(spark: SparkSession, d: str) -> DataFrame:
    """L-25, B-19."""
    return C.coactivation_patterns(labelled_panel(spark, d), [3, 35], ["label"], k=4, replicates=2)


@query
def glm_contrast(spark: SparkSession, d: str) -> DataFrame:
    """L-41, L-42: price on quantity and discount; the discount's coefficient."""
    x = read(spark, d, "lineitem").withColumn("one", F.lit(1.0))
    return T.glm_contrast(x, ["one", "l_quantity", "l_discount"], "l_extendedprice", [0, 0, 1])


@query
def glm_f_test(spark: SparkSession, d: str) -> DataFrame:
    """L-43: quantity and discount at once."""
    x = read(spark, d, "lineitem").withColumn("one", F.lit(1.0))
    return T.glm_f(x, ["one", "l_quantity", "l_discount"], "l_extendedprice", [[0, 1, 0], [0, 0, 1]])


def covariate_residuals(spark: SparkSession, d: str) -> DataFrame:
    """L-40: prices less their fit on quantity."""
    x = read(spark, d, "lineitem").withColumn("one", F.lit(1.0))
    return T.residualised(x, ["one", "l_quantity"], "l_extendedprice").select("l_orderkey", "l_linenumber", F.round("residual", 2).alias("residual"))


QUERIES["covariate_residuals"] = covariate_residuals
ORACLE["covariate_residuals"] = """WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem)
SELECT l_orderkey, l_linenumber, round(l_extendedprice - a - b * l_quantity, 2) + 0.0 AS residual FROM lineitem CROSS JOIN f"""


#: Frames of a template.
WINDOW = 30


def _pattern_tiles(spark: SparkSession, d: str) -> DataFrame:
    """The embedding panel without its global signal, in tiles."""
    return Q.frame_tiles(regress_global_signal(embedding_panel(spark, d)), CHANNELS, WINDOW)


@query
def qpp_runs(spark: SparkSession, d: str) -> DataFrame:
    """L-26: rounds, peaks and mean correlation of ten runs."""
    reports, _ = Q.quasi_periodic(_pattern_tiles(spark, d), CHANNELS, WINDOW)
    return spark.createDataFrame(reports, "run int, rounds int, converged boolean, peaks long, mean_r double")


@query
def qpp_template(spark: SparkSession, d: str) -> DataFrame:
    """L-26: the template of the run with the largest mean correlation."""
    reports, found = Q.quasi_periodic(_pattern_tiles(spark, d), CHANNELS, WINDOW)
    return Q.template_table(spark, found[Q.best_run(reports)]) if reports else spark.createDataFrame([], "frame int, channel int, value double")


@query
def template_course(spark: SparkSession, d: str) -> DataFrame:
    """C-11, E-07: the panel's first thirty frames against every window."""
    tiles = Q.frame_tiles(embedding_panel(spark, d), CHANNELS, WINDOW)
    first = tiles.where("tile = 0").select(F.slice("x", 1, WINDOW * CHANNELS)).first()[0]
    course = Q.template_course(tiles, {1: np.array(first).reshape(WINDOW, CHANNELS)})
    return course.select("t", (F.round("r", 6) + F.lit(0.0)).alias("r"))


ORACLE["template_course"] = """WITH f AS (SELECT vec_id AS t, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS n FROM embeddings),
x AS (SELECT t, n, unnest(range(1, len(embedding) + 1)) AS c, CAST(unnest(embedding) AS DOUBLE) AS v FROM f)
SELECT w.t, round(corr(a.v, b.v), 6) + 0.0 AS r FROM f AS w JOIN x AS b ON b.n BETWEEN w.n AND w.n + 29 JOIN x AS a ON a.n = b.n - w.n AND a.c = b.c
WHERE w.n <= (SELECT max(n) - 29 FROM f) GROUP BY w.t"""


@query
def template_match(spark: SparkSession, d: str) -> DataFrame:
    """L-33: when the course of each pair of modes, of moduli 1, is most like the template, and how much.

    Courses of 3,000 frames of 0.72 s; modes are per step of 1.5 s.
    """
    reports, found = Q.quasi_periodic(_pattern_tiles(spark, d), CHANNELS, WINDOW)
    course = O.reconstructed(group_modes(spark, d).withColumn("pair", F.floor((F.col("mode_idx") + 1) / 2).cast("int")), 3001, 0.72 / 1.5, unit=True, keys=["pair"])
    tiles = Q.frame_tiles(course, CHANNELS, WINDOW, ["pair"])
    met = Q.template_course(tiles, {1: found[Q.best_run(reports)]}).where(f"t < {3000 - WINDOW}")
    return met.groupBy("pair").agg(F.max_by("t", F.struct("r", -F.col("t"))).alias("frame"), F.max("r").alias("r"))


METRICS, FACTORS = ("engagement", "persistence", "progression"), ("quantity", "discount", "tax", "price")


def behaviour(spark: SparkSession, d: str) -> tuple[DataFrame, list[A.Metric]]:
    """(customers with covariates, metrics and factors, the metrics): order priorities stand for modes, means over lines for factors."""
    orders = read(spark, d, "orders").withColumn("mode", F.substring("o_orderpriority", 1, 1))
    metrics = [(metric, str(mode), f"{metric}_{mode}") for mode in range(1, 6) for metric in METRICS]
    here = lambda mode, c: F.when(F.col("mode") == str(mode), c)
    made = {"engagement": lambda m: F.avg(here(m, F.col("o_totalprice"))), "persistence": lambda m: F.count(here(m, F.lit(1))).cast("double"), "progression": lambda m: F.avg(here(m, F.dayofyear("o_orderdate").cast("double")))}
    each = orders.groupBy("o_custkey").agg(*[made[metric](mode).alias(c) for metric, mode, c in metrics])
    lines = read(spark, d, "lineitem").join(read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    means = lines.groupBy("o_custkey").agg(*[F.avg(c).alias(name) for name, c in zip(FACTORS, ("l_quantity", "l_discount", "l_tax", "l_extendedprice"))])
    customers = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit(1.0).alias("one"), F.col("c_acctbal").alias("balance"))
    return customers.join(each, "o_custkey").join(means, "o_custkey"), metrics


@query
def factor_grid(spark: SparkSession, d: str) -> DataFrame:
    """C-13, L-41, L-44: t and partial-type r of every mode's metrics for every factor, beside intercept and balance."""
    rows, metrics = behaviour(spark, d)
    g = A.factor_grid(rows, ["one", "balance"], metrics, list(FACTORS))
    return g.select("metric", "mode", "factor", "n", "df", (F.round("r", 6) + F.lit(0.0)).alias("r"), (F.round("t", 4) + F.lit(0.0)).alias("t"))


ORACLE["factor_grid"] = """WITH o AS (SELECT o_custkey AS k, substring(o_orderpriority, 1, 1) AS mode, avg(o_totalprice) AS e, CAST(count(*) AS DOUBLE) AS p, avg(dayofyear(o_orderdate)) AS g FROM orders GROUP BY 1, 2),
l AS (SELECT o_custkey AS k, avg(l_quantity) AS q, avg(l_discount) AS d, avg(l_tax) AS t, avg(l_extendedprice) AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
s AS (SELECT c_custkey AS k, c_acctbal AS z FROM customer JOIN l ON l.k = c_custkey WHERE c_custkey IN (SELECT k FROM o GROUP BY 1 HAVING count(*) = 5)),
m AS (SELECT k, mode, 'engagement' AS metric, e AS v FROM o UNION ALL SELECT k, mode, 'persistence', p FROM o UNION ALL SELECT k, mode, 'progression', g FROM o),
f AS (SELECT k, 'quantity' AS factor, q AS v FROM l UNION ALL SELECT k, 'discount', d FROM l UNION ALL SELECT k, 'tax', t FROM l UNION ALL SELECT k, 'price', x FROM l),
mr AS (SELECT m.*, v - regr_intercept(v, z) OVER w - regr_slope(v, z) OVER w * z AS u FROM m JOIN s USING (k) WINDOW w AS (PARTITION BY mode, metric)),
fr AS (SELECT f.*, v - regr_intercept(v, z) OVER w - regr_slope(v, z) OVER w * z AS u FROM f JOIN s USING (k) WINDOW w AS (PARTITION BY factor)),
c AS (SELECT metric, mode, factor, count(*) AS n, sum(mr.u * fr.u) AS mf, sum(mr.u * mr.u) AS mm, sum(fr.u * fr.u) AS ff, corr(fr.u, mr.v) AS r FROM mr JOIN fr USING (k) GROUP BY 1, 2, 3)
SELECT metric, mode, factor, n, n - 3 AS df, round(r, 6) + 0.0 AS r, round(mf / mm / sqrt((ff - mf * mf / mm) / (n - 3) / mm), 4) + 0.0 AS t FROM c"""


@query
def factor_tests(spark: SparkSession, d: str) -> DataFrame:
    """L-45, L-46, D-22, D-27: p, q-value and family-wise p by 1,000 max-T permutations of every test of the grid."""
    rows, metrics = behaviour(spark, d)
    rows = written(rows)
    g = T.q_values(A.factor_grid(rows, ["one", "balance"], metrics, list(FACTORS)), "p")
    return A.exceedance_p(g, A.max_t(rows, "o_custkey", ["one", "balance"], metrics, list(FACTORS), permutations=1000)).select("metric", "mode", "factor", "t", "p", "q", "p_fwe")


@query
def heritability(spark: SparkSession, d: str) -> DataFrame:
    """L-54: customers as people, parents from nation and number, as in kinship_pairs; three measures beside a covariate."""
    k = F.col("c_custkey")
    family = (F.col("c_nationkey") * 200 + F.floor(k / 20)).cast("long")
    people = read(spark, d, "customer").select(k.alias("id"), family.alias("family"), family.alias("m"), (F.col("c_nationkey") * 100000 + F.floor(k / 10)).alias("f"), F.when(k % 3 == 0, "MZ").when(k % 3 == 1, "DZ").otherwise("NT").alias("z"), "c_acctbal")
    orders = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.avg("o_totalprice").alias("spent"), F.avg(F.dayofyear("o_orderdate")).alias("day"), F.count("*").cast("double").alias("orders"))
    return H.ace(people.join(orders, "id"), "id", "family", "m", "f", "z", ["spent", "day", "c_acctbal"], ["orders"])


#: Grids of the sparse model's weight, of which the choice leaves out the first, and of the kernel's width.
WEIGHTS, WIDTHS = tuple(i / 1000 for i in range(1, 11)), tuple(range(2, 21, 2))


def _dealt_panel(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, dict]:
    """(the labelled panel, its folds, modes fitted outside each)."""
    panel = written(labelled_panel(spark, d))
    dealt, vectors = O.fold_modes(O.session_moments(panel, ["label"], CHANNELS), "label", CHANNELS, LOW, HIGH)
    return panel, dealt, vectors


def _choices(panel: DataFrame, dealt: DataFrame) -> dict[str, dict[int, float]]:
    return O.chosen_parameters(O.parameter_curves(panel, ["label"], CHANNELS, WEIGHTS, WIDTHS), dealt, "label", {"sparse": 1})


@query
def forecast_choice(spark: SparkSession, d: str) -> DataFrame:
    """L-15: the weight of the sparse and the width of the kernel model that do best on the labels outside each fold."""
    panel, dealt, _ = _dealt_panel(spark, d)
    rows = [(model, fold, p) for model, each in _choices(panel, dealt).items() for fold, p in each.items()]
    return spark.createDataFrame(rows, "model string, fold int, parameter double")


def _chosen_forecasts(spark: SparkSession, d: str) -> DataFrame:
    panel, dealt, vectors = _dealt_panel(spark, d)
    best = _choices(panel, dealt)
    return O.forecasts(panel.join(dealt, "label"), ["fold", "label"], vectors, CHANNELS, range(1, 13), sparse=best["sparse"], kernel=best["kernel"])


@query
def forecast_chosen(spark: SparkSession, d: str) -> DataFrame:
    """L-10 to L-15: forecast_cv with the parameters that each fold's other labels choose."""
    return _chosen_forecasts(spark, d)


@query
def forecast_tests(spark: SparkSession, d: str) -> DataFrame:
    """L-16: signed-rank tests, over labels, of r2 between numbers of modes, and of each against the null, sparse and kernel models."""
    f = written(_chosen_forecasts(spark, d)).select("label", "n_modes", "model", "r2")
    modes_ = f.where("model = 'modes'").select("label", F.col("n_modes").alias("first"), F.col("r2").alias("_r"))
    others = f.where("model <> 'persistence'").select("label", F.when(F.col("model") == "modes", F.col("n_modes").cast("string")).otherwise(F.col("model")).alias("second"), F.when(F.col("model") == "modes", F.col("n_modes")).alias("_n"), "r2")
    both = modes_.join(others, "label").where("_n is null or first < _n")
    return T.signed_rank_tests(both.withColumn("difference", F.round(F.col("_r") - F.col("r2"), 12)), "difference", ["first", "second"])


@query
def mode_matching(spark: SparkSession, d: str) -> DataFrame:
    """L-17: modes of the folds matched one to one, and how alike those of every two folds are."""
    panel, _, vectors = _dealt_panel(spark, d)
    first, _, _ = O.fit_group(O.session_moments(panel, ["label"], CHANNELS), CHANNELS, LOW, HIGH)
    return O.mode_matches(spark, vectors, first)


@query
def retest_eigenvalues(spark: SparkSession, d: str) -> DataFrame:
    """L-53: correlation and ICC (3,1), over labels, of eigenvalues refitted to the two halves of their time, for the first of each pair of modes."""
    halves = written(split_in_time(labelled_panel(spark, d), ["label"], 0.5).withColumn("half", F.col("is_fit").cast("int")).drop("is_fit"))
    moments = written(O.session_moments(halves, ["label", "half"], CHANNELS))
    vectors, _, _ = O.fit_group(moments, CHANNELS, LOW, HIGH)
    refitted = O.subject_metrics(moments, ["label", "half"], vectors[:, :10], CHANNELS).where("mode_idx % 2 = 1")
    each = refitted.select("label", "half", "mode_idx", F.explode(F.create_map(F.lit("persistence"), F.col("persistence"), F.lit("progression"), F.abs("progression"))).alias("metric", "value"))
    return T.retest(each, "label", "half", "value", 1, 0, ["metric", "mode_idx"])


def _pairs_of(modes_: DataFrame, most: int) -> DataFrame:
    """The modes of the first pairs, with `pair`."""
    return modes_.withColumn("pair", F.floor((F.col("mode_idx") + 1) / 2).cast("int")).where(F.col("pair") <= most)


def cumulative(rows: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """E-14: rows (pair, by, value) with the mean over the pairs up to each, as `value`."""
    w = Window.partitionBy(*by).orderBy("pair").rowsBetween(Window.unboundedPreceding, 0)  # a bounded number of pairs
    return rows.withColumn(value, F.avg(value).over(w))


@query
def reconstructed_fc(spark: SparkSession, d: str) -> DataFrame:
    """L-29, E-14: correlations of the mean reconstruction of the first n pairs of modes, weighted by engagement, against the panel's."""
    panel = written(labelled_panel(spark, d))
    vectors, values, _ = O.fit_group(O.session_moments(panel, ["label"], CHANNELS), CHANNELS, LOW, HIGH)
    weight = O.engagement(panel, ["label"], vectors[:, :10], CHANNELS).groupBy("mode_idx").agg(F.avg("b_mean").alias("weight"))
    courses = O.reconstructed(_pairs_of(O.mode_table(spark, vectors[:, :10], values[:10]), 5), 60, 0.72 / 1.5, keys=["pair"])
    weighted = courses.join(weight.withColumn("pair", F.floor((F.col("mode_idx") + 1) / 2).cast("int")).where("mode_idx % 2 = 1"), "pair").withColumn("value", F.col("value") * F.col("weight"))
    fc = M.correlation_matrix(cumulative(weighted.select("pair", "channel", "t", "value"), ["channel", "t"]), ["pair"])
    observed = M.correlation_matrix(panel.select("channel", "t", "value")).withColumnRenamed("r", "observed")
    return fc.join(observed, ["i", "j"]).groupBy(F.col("pair").alias("n")).agg(safe_corr(F.col("r"), F.col("observed")).alias("r"))


@query
def phase_fc_accumulated(spark: SparkSession, d: str) -> DataFrame:
    """L-27, E-14, B-14: phase coupling of each of the first pairs of modes, and its running mean, against the panel's correlations."""
    first = group_modes(spark, d).where("mode_idx % 2 = 1 and mode_idx <= 10")
    each = O.phase_coupling(first).select(F.floor((F.col("mode_idx") + 1) / 2).cast("int").alias("pair"), "i", "j", "coupling").withColumn("value", F.col("coupling"))
    observed = M.correlation_matrix(embedding_panel(spark, d)).withColumnRenamed("r", "observed")
    both = cumulative(each, ["i", "j"]).join(observed, ["i", "j"])
    return both.groupBy(F.col("pair").alias("n")).agg(safe_corr(F.col("coupling"), F.col("observed")).alias("own"), safe_corr(F.col("value"), F.col("observed")).alias("accumulated"))


@query
def reconstruction_dfc(spark: SparkSession, d: str) -> DataFrame:
    """E-15: sample deviation of correlations over 31 frames of the reconstruction of each of the first two pairs."""
    courses = O.reconstructed(_pairs_of(group_modes(spark, d), 2), 91, 0.72 / 1.5, keys=["pair"])
    sliding = S.sliding_correlation(M.channel_pairs(courses, ["pair"]), 31, ["pair"])
    return sliding.groupBy("pair", "i", "j").agg(F.stddev_samp("rho").alias("deviation"))


@query
def t_tests(spark: SparkSession, d: str) -> DataFrame:
    """L-49 to L-51 with p: quantities under two return flags, paired by part and pooled, by line status; and their difference against 0."""
    x = read(spark, d, "lineitem")
    paired = T.paired_t(x, "l_partkey", "l_returnflag", "l_quantity", "A", "R", ["l_linestatus"]).select(F.lit("paired").alias("test"), "l_linestatus", (F.col("n") - 1).alias("df"), "t", "d")
    pooled = T.pooled_t(x.where("l_returnflag in ('A', 'R')").withColumn("first", F.col("l_returnflag") == "A"), "first", "l_quantity", ["l_linestatus"]).select(F.lit("pooled").alias("test"), "l_linestatus", (F.col("n1") + F.col("n2") - 2).alias("df"), "t", "d")
    one = T.one_sample_t(x.withColumn("v", F.col("l_discount") - 0.05), "v", ["l_linestatus"]).select(F.lit("one").alias("test"), "l_linestatus", (F.col("n") - 1).alias("df"), "t", "d")
    return T.with_p(paired.unionByName(pooled).unionByName(one))
