"""Queries of connectivity profiles, lag structure, regressors and similarity that build on several operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.functions.columns import cosine
from undula.functions.dense import hrf
from undula.operators import modes as O
from undula.operators import moments as M
from undula.operators import panel as P
from undula.operators import patterns as C
from undula.operators import series as S
from undula.operators import statistics as T
from undula.operators import subjects as U
from undula.plans.catalog import LAG, PANEL, r
from undula.plans.models import CHANNELS, group_modes, labelled_panel, mode_reconstruction
from undula.sources.staging import written
from undula.sources.tables import START, embedding_panel, hourly_panel, read, user_sessions

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


#: Samples in a window of sliding correlation, and seconds between samples.
WINDOW, TR = 30, 0.72


@query()
def dfc_std_highpassed(spark: SparkSession, d: str) -> DataFrame:
    """L-02, L-37: deviation of sliding correlations of what is faster than a window."""
    panel = O.filtered(hourly_panel(spark, d), [], 1 / TR, 1 / (TR * WINDOW), 0.5 / TR)
    return S.dfc_std(S.sliding_correlation(M.channel_pairs(panel), WINDOW))


@query(f"""WITH {PANEL}, p AS (SELECT channel, t // 180 AS s, t, value - avg(value) OVER (PARTITION BY channel, t // 180) AS value FROM panel),
lags AS (SELECT unnest(range(-6, 7)) AS lag),
c AS (SELECT a.s, a.channel AS i, b.channel AS j, l.lag, avg(a.value * b.value) AS value FROM lags l JOIN p a ON true JOIN p b ON b.s = a.s AND b.t = a.t + l.lag AND a.channel < b.channel GROUP BY 1, 2, 3, 4),
n AS (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS z FROM c WINDOW w AS (PARTITION BY s, i, j ORDER BY lag)),
b AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY s, i, j ORDER BY abs(value) DESC, lag) = 1),
k AS (SELECT s, i, j, lag + (a - z) / (2 * (a - 2 * value + z)) AS l, value - (a - z) * (a - z) / (8 * (a - 2 * value + z)) AS peak FROM b),
v AS (SELECT s, channel, sqrt(avg(value * value)) AS sd FROM p GROUP BY 1, 2),
o AS (SELECT k.s, k.i, k.j, CASE WHEN abs(l) <= 4 THEN l END AS lag, peak, CASE WHEN abs(l) <= 4 THEN atanh(c.value / x.sd / y.sd) END AS zero FROM k JOIN c ON c.s = k.s AND c.i = k.i AND c.j = k.j AND c.lag = 0 JOIN v x ON x.s = k.s AND x.channel = k.i JOIN v y ON y.s = k.s AND y.channel = k.j)
SELECT i, j, round(avg(lag), 4) + 0.0 AS lag, round(avg(peak), 4) + 0.0 AS peak, round(tanh(avg(zero)), 5) + 0.0 AS zero, round(avg(lag * peak), 3) + 0.0 AS awtd FROM o GROUP BY 1, 2""")
def lag_structure(spark: SparkSession, d: str) -> DataFrame:
    """L-24: lag, peak, correlation at no lag and weighted delay of channels, means over the quarters of the hours."""
    panel = hourly_panel(spark, d).withColumn("s", F.floor(F.col("t") / 180))
    m = S.mean_lag_structure(S.lag_structure(panel, 6, longest=4.0, keys=["s"]))
    return m.select("i", "j", r("lag", 4).alias("lag"), r("peak", 4).alias("peak"), r("zero", 5).alias("zero"), r("awtd", 3).alias("awtd"))


def _group_fc(panel: DataFrame) -> DataFrame:
    """(i, j, r): the Fisher mean over labels of their correlations, both ways round and with ones on the diagonal."""
    return M.symmetric(M.mean_correlation(M.correlation_matrix(panel, ["label"])), diagonal=1.0)


@query()
def fc_gradients_sparse(spark: SparkSession, d: str) -> DataFrame:
    """L-19, B-18: gradients of the group's correlations, of which the largest fifth of magnitudes stays."""
    return C.gradients(C.row_vectors(U.top_share(_group_fc(labelled_panel(spark, d)), "r")))


def _areas(panel: DataFrame) -> DataFrame:
    """(area, channel): the first 48 channels in six areas of eight."""
    return panel.select("channel").distinct().where("channel <= 48").select((F.floor((F.col("channel") - 1) / 8) + 1).cast("int").alias("area"), "channel")


@query()
def area_gradients(spark: SparkSession, d: str) -> DataFrame:
    """L-19, B-16: gradients within six areas, by their correlations with the channels outside."""
    panel = written(labelled_panel(spark, d))
    return C.area_gradients(_group_fc(panel), _areas(panel))


@query()
def area_time_course(spark: SparkSession, d: str) -> DataFrame:
    """L-35: a reconstruction's frames against the first gradient of each area, over the area's channels."""
    first = area_gradients(spark, d).where("component = 1").select(F.col("area").alias("feature"), F.col("i").alias("channel"), F.col("score").alias("weight"))
    return O.feature_course(mode_reconstruction(spark, d), first).withColumnRenamed("feature", "area")


@query()
def network_clusters_gsr(spark: SparkSession, d: str) -> DataFrame:
    """L-20, L-21: seven networks of channels by z-scored rows of correlations without the global signal."""
    fc = _group_fc(P.regress_global_signal(written(labelled_panel(spark, d)), ["label"]))
    scored = P.zscored(fc.select(F.col("i").alias("channel"), F.col("j").alias("t"), F.col("r").alias("value")))
    return C.clusters(C.row_vectors(scored.select(F.col("channel").alias("i"), F.col("t").alias("j"), F.col("value").alias("r"))), 7).select("i", "cluster")


@query()
def coactivation_profiles(spark: SparkSession, d: str) -> DataFrame:
    """L-25, E-13: eight patterns of frames above the 85th percentile of two seeds, clustered in the components that hold 99.9 % of the variance."""
    return C.coactivation_profiles(*C.coactivation_frames(labelled_panel(spark, d), [3, 35], ["label"]))


@query()
def task_regressor(spark: SparkSession, d: str) -> DataFrame:
    """L-38: the response, hour by hour, to events of the first type that last six hours, on a grid of two minutes."""
    e = read(spark, d, "events")
    first = e.agg(F.min("event_type").alias("event_type"))
    hours = (F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lit(START).cast("timestamp"))) / 3600
    on = e.join(F.broadcast(first), "event_type").select("user_id", hours.alias("onset"), F.lit(6.0).alias("duration"))
    sessions = e.select("user_id").distinct().withColumn("samples", F.lit(720))
    return S.task_regressor(sessions, on, ["user_id"], 1.0, hrf(1 / 30))


@query()
def nuisance_motion(spark: SparkSession, d: str) -> DataFrame:
    """L-39: each label's channels less their fit on six motion parameters, their squares, an intercept and a quadratic trend."""
    panel = labelled_panel(spark, d)
    motion = panel.where("channel <= 6").select("label", "t", F.explode(F.array(F.struct(F.concat(F.lit("m"), "channel").alias("name"), F.col("value").alias("value")), F.struct(F.concat(F.lit("q"), "channel").alias("name"), (F.col("value") * F.col("value")).alias("value")))).alias("x")).select(F.col("label").alias("label"), F.col("t").alias("t"), "x.name", "x.value")
    return O.nuisance_residual(panel.where("channel > 6"), motion, ["label"])


_CELLS = """m AS (SELECT user_id % 10 AS subject, CAST(floor((date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 24 + hour(ts)) / 180.0) AS INTEGER) + 1 AS state, event_type AS c, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 24 + hour(ts) AS t, avg(value) AS v FROM events GROUP BY 1, 2, 3, 4),
x AS (SELECT subject, state, c, avg(v) AS v FROM m GROUP BY 1, 2, 3),
s AS (SELECT a.subject = b.subject AS own, sum(a.v * b.v) / sqrt(sum(a.v * a.v)) / sqrt(sum(b.v * b.v)) AS cosine FROM x a JOIN x b ON a.c = b.c AND ((a.subject = b.subject AND a.state < b.state) OR (a.state = b.state AND a.subject < b.subject)) GROUP BY a.subject, a.state, b.subject, b.state)"""


@query(f"""WITH {_CELLS}, g AS (SELECT count(*) FILTER (WHERE own) AS n1, count(*) FILTER (WHERE NOT own) AS n2, avg(cosine) FILTER (WHERE own) AS within, avg(cosine) FILTER (WHERE NOT own) AS across, var_samp(cosine) FILTER (WHERE own) AS v1, var_samp(cosine) FILTER (WHERE NOT own) AS v2 FROM s)
SELECT n1, n2, round(within, 6) + 0.0 AS within, round(across, 6) + 0.0 AS across, round((within - across) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) / sqrt(1.0 / n1 + 1.0 / n2), 4) + 0.0 AS t FROM g""")
def similarity_contrast(spark: SparkSession, d: str) -> DataFrame:
    """L-57: likeness of one subject's patterns across states against that of subjects within one state."""
    x = written(user_sessions(spark, d).groupBy("subject", F.col("session").alias("state"), "channel").agg(F.avg("value").alias("v")))
    other = x.select(F.col("subject").alias("other"), F.col("state").alias("then"), "channel", F.col("v").alias("w"))
    own = x.join(other.withColumn("subject", F.col("other")), ["subject", "channel"]).where("state < then").select("subject", "state", "other", "then", "v", "w")
    across = x.join(other.withColumn("state", F.col("then")), ["state", "channel"]).where("subject < other").select("subject", "state", "other", "then", "v", "w")
    alike = lambda rows, is_own: rows.groupBy("subject", "state", "other", "then").agg(cosine(F.col("v"), F.col("w")).alias("cosine")).withColumn("own", F.lit(is_own))
    every = written(alike(own, True).unionByName(alike(across, False)))
    means = every.agg(F.avg(F.when(F.col("own"), F.col("cosine"))).alias("within"), F.avg(F.when(~F.col("own"), F.col("cosine"))).alias("across"))
    return T.pooled_t(every, "own", "cosine").join(F.broadcast(means)).select("n1", "n2", r("within").alias("within"), r("across").alias("across"), r("t", 4).alias("t"))


_LEFT = "u AS (SELECT l_quantity AS q, l_discount AS x, l_extendedprice AS y FROM lineitem)"


@query(f"""WITH {_LEFT}, k AS (SELECT count(*) AS n, corr(q, x) AS qx, corr(q, y) AS qy, corr(x, y) AS xy FROM u), p AS (SELECT n, (xy - qx * qy) / sqrt((1 - qx * qx) * (1 - qy * qy)) AS r FROM k)
SELECT CAST(n - 3 AS BIGINT) AS df, round(r * sqrt((n - 3) / (1 - r * r)), 4) + 0.0 AS t FROM p""")
def glm_t(spark: SparkSession, d: str) -> DataFrame:
    """L-41, L-42: t of the discount beside quantity, for the price."""
    x = read(spark, d, "lineitem").withColumn("one", F.lit(1.0))
    return T.glm_contrast(x, ["one", "l_quantity", "l_discount"], "l_extendedprice", [0, 0, 1]).select("df", r("t", 4).alias("t"))


@query(f"""WITH {_LEFT}, k AS (SELECT count(*) AS n, corr(q, x) AS qx, corr(q, y) AS qy, corr(x, y) AS xy FROM u), p AS (SELECT n, (qy * qy + xy * xy - 2 * qy * xy * qx) / (1 - qx * qx) AS r2 FROM k)
SELECT CAST(2 AS BIGINT) AS df1, CAST(n - 3 AS BIGINT) AS df2, round(r2 / 2 / ((1 - r2) / (n - 3)), 2) + 0.0 AS f FROM p""")
def glm_f(spark: SparkSession, d: str) -> DataFrame:
    """L-43: F of quantity and discount at once, for the price."""
    x = read(spark, d, "lineitem").withColumn("one", F.lit(1.0))
    return T.glm_f(x, ["one", "l_quantity", "l_discount"], "l_extendedprice", [[0, 1, 0], [0, 0, 1]]).select("df1", "df2", r("f", 2).alias("f"))


@query()
def group_lags(spark: SparkSession, d: str) -> DataFrame:
    """L-24, E-06: mean lag of every pair of channels over labels, up to six samples of 0.72 s, those beyond 4 s left out."""
    each = S.peak_lag(S.framed_covariance(P.demeaned(labelled_panel(spark, d), ["label"]), 6, ["label"]), ["label"], TR, 4.0)
    return each.groupBy("i", "j").agg(F.avg("lag").alias("lag"), F.avg("peak").alias("peak"))


@query()
def mode_lag_agreement(spark: SparkSession, d: str) -> DataFrame:
    """L-32: phase delays of the first of each pair of modes against the group's lags."""
    return O.lag_agreement(group_modes(spark, d).where("mode_idx % 2 = 1"), written(group_lags(spark, d)))


@query(f"""WITH {LAG}, n AS (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS c FROM lc WINDOW w AS (PARTITION BY i, j ORDER BY lag)),
b AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY i, j ORDER BY abs(value) DESC, lag) = 1),
g AS (SELECT i, j, lag + (a - c) / (2 * (a - 2 * value + c)) AS lag FROM b WHERE abs(lag + (a - c) / (2 * (a - 2 * value + c))) <= 4),
o AS (SELECT avg(value) AS m FROM events),
p AS (SELECT CAST(user_id % 3 + 1 AS INTEGER) AS mode_idx, event_type AS channel, atan2(avg(CASE WHEN hour(ts) % 2 = 1 THEN value END) - max(m), avg(value) - max(m)) AS phase FROM events CROSS JOIN o GROUP BY 1, 2),
e AS (SELECT mode_idx, i, j, lag, x.phase - y.phase - 2 * pi() * ceil((x.phase - y.phase - pi()) / (2 * pi())) AS delay FROM g JOIN p x ON x.channel = i JOIN p y USING (mode_idx) WHERE y.channel = j),
k AS (SELECT mode_idx, j AS channel, delay, lag FROM e UNION ALL SELECT mode_idx, i, -delay, -lag FROM e),
z AS (SELECT mode_idx, channel, avg(delay) AS delay, avg(lag) AS lag FROM k GROUP BY 1, 2)
SELECT * FROM (SELECT mode_idx, count(*) AS n, round(corr(delay, lag), 5) + 0.0 AS matrix_r FROM e GROUP BY 1) u JOIN (SELECT mode_idx, round(corr(delay, lag), 5) + 0.0 AS projection_r FROM z GROUP BY 1) v USING (mode_idx)""")
def lag_agreement(spark: SparkSession, d: str) -> DataFrame:
    """L-32 over a mode table: users in three groups, types of events as channels, their means as real and those of odd hours as imaginary parts."""
    e = read(spark, d, "events")
    mean = e.agg(F.avg("value").alias("m"))
    odd = F.when(F.hour("ts") % 2 == 1, F.col("value"))
    parts = e.groupBy((F.col("user_id") % 3 + 1).cast("int").alias("mode_idx"), F.col("event_type").alias("channel")).agg(F.avg("value").alias("re"), F.avg(odd).alias("im"))
    modes_ = parts.join(F.broadcast(mean)).select("mode_idx", "channel", (F.col("re") - F.col("m")).alias("re"), (F.col("im") - F.col("m")).alias("im"))
    lags = S.peak_lag(S.framed_covariance(P.demeaned(hourly_panel(spark, d)), 6), longest=4.0)
    return O.lag_agreement(modes_, written(lags)).select("mode_idx", "n", r("matrix_r", 5).alias("matrix_r"), r("projection_r", 5).alias("projection_r"))
