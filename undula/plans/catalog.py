"""Queries over the given tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.functions.columns import bucketise, predicted_dfc, safe_corr, swap_hemisphere, wrap_phase
from undula.functions.dense import hrf
from undula.operators import moments as M
from undula.operators import panel as P
from undula.operators import series as S
from undula.operators import statistics as T
from undula.operators import subjects as U
from undula.operators.ordering import numbered
from undula.sources.tables import embedding_panel, hour_of, hourly_panel, people, read, user_sessions

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

PANEL = """
cells AS (SELECT event_type AS channel, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 24 + hour(ts) AS t, avg(value) AS v FROM events GROUP BY 1, 2),
chans AS (SELECT DISTINCT event_type AS channel FROM events),
hours AS (SELECT unnest(range(m + 1)) AS t FROM (SELECT max(t) AS m FROM cells) z),
panel AS (SELECT c.channel, h.t, coalesce(x.v, 0.0) AS value FROM chans c CROSS JOIN hours h LEFT JOIN cells x ON x.channel = c.channel AND x.t = h.t)"""
EMB = """
emb AS (SELECT vec_id AS t, unnest(range(1, len(embedding) + 1)) AS channel, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"""
SESS = """
sess AS (SELECT user_id % 10 AS subject, CAST(floor((date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 24 + hour(ts)) / 180.0) AS INTEGER) + 1 AS session,
  event_type AS channel, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 24 + hour(ts) AS t, avg(value) AS value FROM events GROUP BY 1, 2, 3, 4)"""
FC = "fc AS (SELECT a.channel AS i, b.channel AS j, covar_pop(a.value, b.value) / nullif(stddev_pop(a.value) * stddev_pop(b.value), 0) AS r FROM emb a JOIN emb b ON a.t = b.t AND a.channel < b.channel GROUP BY 1, 2)"
PAIRS = "pairs AS (SELECT a.channel AS i, b.channel AS j, a.t, a.value AS vi, b.value AS vj FROM panel a JOIN panel b ON a.t = b.t AND a.channel < b.channel)"
SLIDE = """slide AS (SELECT i, j, t, CASE WHEN s > 1e-12 THEN c / s ELSE 0.0 END AS rho FROM (
  SELECT i, j, t, covar_pop(vi, vj) OVER w AS c, stddev_pop(vi) OVER w * stddev_pop(vj) OVER w AS s, row_number() OVER (PARTITION BY i, j ORDER BY t) AS n FROM pairs
  WINDOW w AS (PARTITION BY i, j ORDER BY t ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) q WHERE n >= 30)"""


def r(x: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison, with no negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"WITH {EMB}, m AS (SELECT label, vec_id FROM embeddings) SELECT m.label AS channel, e.channel AS t, round(avg(e.value), 6) + 0.0 AS value FROM emb e JOIN m ON m.vec_id = e.t WHERE m.label <> 0 GROUP BY 1, 2")
def parcel_mean(spark: SparkSession, d: str) -> DataFrame:
    """D-01, B-01, C-05: vectors as voxels, dimensions as time."""
    labels = read(spark, d, "embeddings").select(F.col("vec_id").alias("voxel"), "label")
    samples = embedding_panel(spark, d).select(F.col("t").alias("voxel"), F.col("channel").alias("t"), "value")
    return P.group_mean(samples, labels).select("channel", "t", r("value").alias("value"))


@query("SELECT n_nationkey AS voxel, round(m, 2) + 0.0 AS value FROM nation LEFT JOIN (SELECT n_regionkey AS k, avg(c_acctbal) AS m FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) q ON q.k = n_regionkey")
def painted_labels(spark: SparkSession, d: str) -> DataFrame:
    """A-12: a region's value on each of its nations."""
    values = people(spark, d).groupBy(F.col("n_regionkey").alias("label")).agg(F.avg("c_acctbal").alias("value"))
    labels = read(spark, d, "nation").select(F.col("n_nationkey").alias("voxel"), F.col("n_regionkey").alias("label"))
    return P.paint(labels, values).select("voxel", r("value", 2).alias("value"))


@query(f"WITH {SESS}, n AS (SELECT subject, session, channel, count(*) AS n FROM sess GROUP BY 1, 2, 3), ok AS (SELECT subject, session FROM n GROUP BY 1, 2 HAVING min(n) >= 3), both_ AS (SELECT subject FROM ok GROUP BY 1 HAVING count(*) >= 2) SELECT o.subject, o.session FROM ok o JOIN both_ b ON o.subject = b.subject")
def complete_sessions(spark: SparkSession, d: str) -> DataFrame:
    """B-03: sessions with enough samples in each channel, of subjects with two or more."""
    counted = user_sessions(spark, d).groupBy("subject", "session", "channel").agg(F.count("*").alias("n"))
    ok = counted.groupBy("subject", "session").agg(F.min("n").alias("n")).where("n >= 3").drop("n")
    return U.complete(P.complete_subjects(ok, "subject"), ["subject"])


@query("""WITH m AS (SELECT o_custkey AS k, max(o_totalprice) AS top, count(*) AS n FROM orders GROUP BY 1),
f AS (SELECT c_custkey, c_nationkey, c_acctbal <= 0 AS low, coalesce(m.top > 400000, true) AS moved FROM customer LEFT JOIN m ON m.k = c_custkey)
SELECT c_custkey, low AS low_score, moved FROM f WHERE NOT moved AND NOT low AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 3)""")
def qc_exclusion(spark: SparkSession, d: str) -> DataFrame:
    """B-04 to B-07: flags, a threshold with missing values excluded, and a deny list."""
    c = read(spark, d, "customer").withColumn("done", F.lit(True)).withColumn("score", F.when(F.col("c_acctbal") <= 0, 0).otherwise(30))
    flagged = U.cognitive_flags(c, "done", "score")
    motion = read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    moved = U.motion_flags(flagged, motion, ["c_custkey"], "o_totalprice", 400000)
    denied = read(spark, d, "nation").where("n_regionkey = 3").select(F.col("n_nationkey").alias("c_nationkey"))
    kept = U.not_denied(U.without_excluded(moved, "c_custkey", flagged.where("low_score"), F.col("moved")), denied, ["c_nationkey"])
    return kept.select("c_custkey", "low_score", "moved")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def semi_join_subjects(spark: SparkSession, d: str) -> DataFrame:
    """C-01, G-04."""
    o = read(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, d, "customer").join(o, "c_custkey", "left_semi").select("c_custkey", "c_mktsegment")


@query("SELECT o_custkey AS subject FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = (SELECT count(DISTINCT o_orderpriority) FROM orders)")
def common_subjects(spark: SparkSession, d: str) -> DataFrame:
    """C-03, G-02: subjects present in every state."""
    return U.in_all(read(spark, d, "orders").withColumnRenamed("o_custkey", "subject"), "subject", "o_orderpriority")


@query("SELECT n_name, count(*) AS n, CAST(sum(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END) AS BIGINT) AS n_f, round(avg(c_acctbal), 4) + 0.0 AS mean_age, round(stddev_samp(c_acctbal), 4) + 0.0 AS sd_age, round(1.96 * stddev_samp(c_acctbal) / sqrt(count(c_acctbal)), 4) + 0.0 AS ci FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def demographic_summary(spark: SparkSession, d: str) -> DataFrame:
    """D-02, D-03, D-14, C-02."""
    x = people(spark, d)
    s = T.summary(x, "c_acctbal", ["n_name"])
    f = x.groupBy("n_name").agg(F.sum((F.col("c_mktsegment") == "BUILDING").cast("long")).alias("n_f"))
    return s.join(f, "n_name").select("n_name", "n", "n_f", r("mean", 4).alias("mean_age"), r("sd", 4).alias("sd_age"), r("ci", 4).alias("ci"))


@query(f"WITH {PANEL} SELECT channel, t, round(value, 6) + 0.0 AS y, round(nxt, 6) + 0.0 AS x FROM (SELECT *, lead(value) OVER (PARTITION BY channel ORDER BY t) AS nxt FROM panel) q WHERE nxt IS NOT NULL")
def lag1_pairs(spark: SparkSession, d: str) -> DataFrame:
    """E-01, C-06, L-04."""
    return P.lag1_pairs(hourly_panel(spark, d)).select("channel", "t", r("y").alias("y"), r("x").alias("x"))


def embedding_pairs(spark: SparkSession, d: str) -> DataFrame:
    return P.lag1_pairs(embedding_panel(spark, d))


_GRAM = f"WITH {EMB}, pr AS (SELECT channel, t, value AS y, lead(value) OVER (PARTITION BY channel ORDER BY t) AS x FROM emb), ok AS (SELECT * FROM pr WHERE x IS NOT NULL) SELECT a.channel AS i, b.channel AS j, round(sum(a.{{0}} * b.y), 6) + 0.0 AS value FROM ok a JOIN ok b ON a.t = b.t GROUP BY 1, 2"


@query(_GRAM.format("y"))
def gram_yy(spark: SparkSession, d: str) -> DataFrame:
    """D-04."""
    return M.gram(embedding_pairs(spark, d), "y", "y").select("i", "j", r("value").alias("value"))


@query(_GRAM.format("x"))
def gram_xy(spark: SparkSession, d: str) -> DataFrame:
    """D-04."""
    return M.gram(embedding_pairs(spark, d), "x", "y").select("i", "j", r("value").alias("value"))


@query(f"WITH {EMB} SELECT channel, round(var_samp(value), 8) + 0.0 AS variance FROM emb GROUP BY 1 HAVING var_samp(value) < 0.0155")
def low_variance_channels(spark: SparkSession, d: str) -> DataFrame:
    """B-09, D-05."""
    return P.low_variance_channels(embedding_panel(spark, d), 0.0155).select("channel", r("variance", 8).alias("variance"))


@query(f"WITH {EMB}, {FC} SELECT i, j, round(r, 6) + 0.0 AS r FROM fc")
def fc_matrix(spark: SparkSession, d: str) -> DataFrame:
    """D-06, C-07, B-15."""
    return M.correlation_matrix(embedding_panel(spark, d)).select("i", "j", r("r").alias("r"))


def state_correlations(spark: SparkSession, d: str) -> DataFrame:
    labels = read(spark, d, "embeddings").select(F.col("vec_id").alias("t"), "label")
    return M.correlation_matrix(embedding_panel(spark, d).join(labels, "t"), ["label"])


@query(f"WITH {EMB}, x AS (SELECT e.*, b.label FROM emb e JOIN embeddings b ON b.vec_id = e.t), s AS (SELECT a.label, a.channel AS i, b.channel AS j, covar_pop(a.value, b.value) / nullif(stddev_pop(a.value) * stddev_pop(b.value), 0) AS r FROM x a JOIN x b ON a.t = b.t AND a.channel < b.channel GROUP BY 1, 2, 3) SELECT i, j, round(tanh(avg(atanh(r))), 6) + 0.0 AS r FROM s WHERE r IS NOT NULL GROUP BY 1, 2")
def fisher_mean_fc(spark: SparkSession, d: str) -> DataFrame:
    """D-07, D-08: mean over states of per-state correlations."""
    return M.mean_correlation(state_correlations(spark, d)).select("i", "j", r("r").alias("r"))


@query(f"WITH {EMB}, {FC}, k AS (SELECT *, row_number() OVER (ORDER BY abs(r) DESC, i, j) AS n, count(*) OVER () AS c FROM fc) SELECT i, j, round(CASE WHEN n < c * 0.2 THEN r ELSE 0.0 END, 6) + 0.0 AS r FROM k")
def top20_sparsify(spark: SparkSession, d: str) -> DataFrame:
    """B-18."""
    return U.top_share(M.correlation_matrix(embedding_panel(spark, d)), "r").select("i", "j", r("r").alias("r"))


@query(f"WITH {EMB}, {FC}, s AS (SELECT i, j, r FROM fc UNION ALL SELECT j, i, r FROM fc) SELECT i, round(avg(r), 6) + 0.0 AS r FROM s WHERE j IN (3, 17, 35) GROUP BY 1")
def seed_fc(spark: SparkSession, d: str) -> DataFrame:
    """L-22."""
    return M.seed_mean(M.symmetric(M.correlation_matrix(embedding_panel(spark, d))), [3, 17, 35]).select("i", r("r").alias("r"))


@query(f"WITH {PANEL}, g AS (SELECT *, avg(value) OVER (PARTITION BY t) AS g FROM panel), b AS (SELECT channel, covar_pop(value, g) / var_pop(g) AS s, avg(value) AS mv, avg(g) AS mg FROM g GROUP BY 1) SELECT g.channel, g.t, round(g.value - b.mv - b.s * (g.g - b.mg), 5) + 0.0 AS value FROM g JOIN b ON g.channel = b.channel")
def gsr_residual(spark: SparkSession, d: str) -> DataFrame:
    """L-20."""
    return P.regress_global_signal(hourly_panel(spark, d)).select("channel", "t", r("value", 5).alias("value"))


def hourly_sliding(spark: SparkSession, d: str) -> DataFrame:
    return S.sliding_correlation(M.channel_pairs(hourly_panel(spark, d)), 30)


@query(f"WITH {PANEL}, {PAIRS}, {SLIDE} SELECT i, j, t, round(rho, 5) + 0.0 AS rho FROM slide")
def sliding_corr(spark: SparkSession, d: str) -> DataFrame:
    """E-02."""
    return hourly_sliding(spark, d).select("i", "j", "t", r("rho", 5).alias("rho"))


@query(f"WITH {PANEL}, {PAIRS}, {SLIDE} SELECT i, j, round(stddev_pop(rho), 6) + 0.0 AS dfc_std FROM slide GROUP BY 1, 2")
def dfc_std(spark: SparkSession, d: str) -> DataFrame:
    """E-03, L-37."""
    return S.dfc_std(hourly_sliding(spark, d)).select("i", "j", r("dfc_std").alias("dfc_std"))


@query(f"""WITH {PANEL}, {PAIRS}, {SLIDE}, near AS (SELECT i, j, t, round(rho, 9) AS rho FROM slide), m AS (SELECT i, j, median(rho) AS m FROM near GROUP BY 1, 2),
s AS (SELECT q.i, q.j, q.t, q.rho, sign(q.rho - m.m) AS s FROM near q JOIN m ON q.i = m.i AND q.j = m.j),
c AS (SELECT *, CASE WHEN s <> lag(s) OVER (PARTITION BY i, j ORDER BY t) THEN 1 ELSE 0 END AS c FROM s),
u AS (SELECT *, sum(c) OVER (PARTITION BY i, j ORDER BY t) AS run FROM c),
e AS (SELECT i, j, run, count(*) AS n, max(rho) AS top FROM u GROUP BY 1, 2, 3)
SELECT i, j, round(sum(pow(n, 0.9) * top), 4) + 0.0 AS excursion FROM e GROUP BY 1, 2""")
def dfc_excursion(spark: SparkSession, d: str) -> DataFrame:
    """E-04, D-11."""
    return S.excursion(hourly_sliding(spark, d)).select("i", "j", r("excursion", 4).alias("excursion"))


@query(f"""WITH {EMB}, p AS (SELECT channel, row_number() OVER (PARTITION BY channel ORDER BY t) - 1 AS t, value FROM emb),
g AS (SELECT t, avg(CASE WHEN channel <= 32 THEN value END) AS l, avg(CASE WHEN channel > 32 THEN value END) AS rr FROM p GROUP BY 1),
k AS (SELECT unnest(range(0, CAST(floor((m - 42) / 14.0) AS BIGINT) + 1)) AS w FROM (SELECT max(t) AS m FROM p) z),
x AS (SELECT p.channel, k.w, corr(p.value, g.l) - corr(p.value, g.rr) AS d FROM p JOIN g ON p.t = g.t JOIN k ON p.t >= k.w * 14 AND p.t < k.w * 14 + 43 GROUP BY 1, 2)
SELECT channel, round(avg(d), 6) + 0.0 AS "index" FROM x GROUP BY 1""")
def lateralization(spark: SparkSession, d: str) -> DataFrame:
    """E-05, L-23."""
    panel = numbered(embedding_panel(spark, d), ["channel"], "n").select("channel", F.col("n").alias("t"), "value")
    return S.lateralisation(panel, F.col("channel") <= 32, 43, 14).select("channel", r("index").alias("index"))


LAG = f"""{PANEL}, dm AS (SELECT channel, t, value - avg(value) OVER (PARTITION BY channel) AS value FROM panel),
lags AS (SELECT unnest(range(-6, 7)) AS lag),
lc AS (SELECT a.channel AS i, b.channel AS j, l.lag, avg(a.value * b.value) AS value FROM lags l JOIN dm a ON true JOIN dm b ON b.t = a.t + l.lag AND a.channel < b.channel GROUP BY 1, 2, 3)"""


@query(f"WITH {LAG} SELECT i, j, CAST(lag AS INTEGER) AS lag, round(value, 4) + 0.0 AS value FROM lc")
def lagged_cov(spark: SparkSession, d: str) -> DataFrame:
    """E-06, E-11."""
    return S.lagged_covariance(P.demeaned(hourly_panel(spark, d)), 6).select("i", "j", "lag", r("value", 4).alias("value"))


@query(f"""WITH {LAG}, n AS (SELECT *, lag(value) OVER (PARTITION BY i, j ORDER BY lag) AS a, lead(value) OVER (PARTITION BY i, j ORDER BY lag) AS c FROM lc),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY abs(value) DESC, lag) AS k FROM n) q WHERE k = 1)
SELECT i, j, round(CASE WHEN abs(lag + (a - c) / (2 * (a - 2 * value + c))) <= 4 THEN lag + (a - c) / (2 * (a - 2 * value + c)) END, 4) + 0.0 AS lag,
round(value - (a - c) * (a - c) / (2 * (a - 2 * value + c)) / 4, 4) + 0.0 AS peak FROM b""")
def peak_lag(spark: SparkSession, d: str) -> DataFrame:
    """L-24, B-17, D-13."""
    return S.peak_lag(S.lagged_covariance(P.demeaned(hourly_panel(spark, d)), 6), longest=4.0).select("i", "j", r("lag", 4).alias("lag"), r("peak", 4).alias("peak"))


@query(f"""WITH {PANEL}, m AS (SELECT channel, t, value, value - lag(value) OVER (PARTITION BY channel ORDER BY t) AS d FROM panel),
k AS (SELECT *, lead(d) OVER (PARTITION BY channel ORDER BY t) AS n FROM m WHERE d IS NULL OR d <> 0)
SELECT channel, t, round(value, 6) + 0.0 AS value FROM k WHERE d > 0 AND n < 0 AND value >= 60""")
def local_maxima(spark: SparkSession, d: str) -> DataFrame:
    """E-08."""
    return S.local_maxima(hourly_panel(spark, d), "value", ["channel"], 60.0).select("channel", "t", r("value").alias("value"))


@query("""WITH w AS (SELECT vec_id AS t, label, embedding AS e FROM embeddings),
s AS (SELECT label, t, CAST(e[1] AS DOUBLE) AS a, CAST(e[2] AS DOUBLE) AS b, CAST(e[3] AS DOUBLE) AS c, CAST(e[4] AS DOUBLE) AS d, CAST(e[5] AS DOUBLE) AS f, CAST(e[6] AS DOUBLE) AS g FROM w),
v AS (SELECT label, abs(a - lag(a) OVER z) + abs(b - lag(b) OVER z) + abs(c - lag(c) OVER z) + abs(radians(d) * 50 - lag(radians(d) * 50) OVER z) + abs(radians(f) * 50 - lag(radians(f) * 50) OVER z) + abs(radians(g) * 50 - lag(radians(g) * 50) OVER z) AS fd FROM s WINDOW z AS (PARTITION BY label ORDER BY t))
SELECT label, round(avg(fd), 6) + 0.0 AS fd FROM v GROUP BY 1""")
def framewise_displacement(spark: SparkSession, d: str) -> DataFrame:
    """E-09: six dimensions of the vectors as motion parameters."""
    e = F.col("embedding").cast("array<double>")
    motion = read(spark, d, "embeddings").select(F.col("vec_id").alias("t"), "label", *[F.element_at(e, i + 1).alias(c) for i, c in enumerate("xyzuvw")])
    return S.framewise_displacement(motion, list("xyz"), list("uvw"), ["label"]).select("label", r("fd").alias("fd"))


@query(f"WITH {PANEL} SELECT channel, t, round((value - avg(value) OVER w) / CASE WHEN coalesce(stddev_samp(value) OVER w, 0) = 0 THEN 1 ELSE stddev_samp(value) OVER w END, 5) + 0.0 AS value FROM panel WINDOW w AS (PARTITION BY channel)")
def zscore_channels(spark: SparkSession, d: str) -> DataFrame:
    """E-10."""
    return P.zscored(hourly_panel(spark, d)).select("channel", "t", r("value", 5).alias("value"))


@query(f"WITH {PANEL} SELECT t, round(avg(value), 6) + 0.0 AS value FROM panel GROUP BY 1")
def global_signal(spark: SparkSession, d: str) -> DataFrame:
    """D-15."""
    return P.global_signal(hourly_panel(spark, d)).select("t", r("value").alias("value"))


@query("""WITH e AS (SELECT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 24 + hour(ts) AS t, event_type FROM events),
on_ AS (SELECT user_id, t AS onset FROM e WHERE event_type = (SELECT min(event_type) FROM events)), s AS (SELECT DISTINCT user_id, t FROM e)
SELECT s.user_id, s.t, CAST(max(CASE WHEN o.onset IS NULL THEN 0 ELSE 1 END) AS INTEGER) AS "on" FROM s LEFT JOIN on_ o ON o.user_id = s.user_id AND s.t >= o.onset AND s.t <= o.onset + 6 GROUP BY 1, 2""")
def event_boxcar(spark: SparkSession, d: str) -> DataFrame:
    """C-10: hours of a user within six hours of an event of the first type."""
    e = read(spark, d, "events").select("user_id", hour_of().alias("t"), "event_type")
    first = e.agg(F.min("event_type").alias("event_type"))
    on = e.join(F.broadcast(first), "event_type").select("user_id", F.col("t").alias("onset"), F.lit(6).alias("duration"))
    return S.boxcar(e.select("user_id", "t").distinct(), on, ["user_id"], 6.0)


_NMI = """SELECT '{name}' AS pair, round(CASE WHEN hx > 0 AND hy > 0 THEN sqrt(greatest(hx + hy - hxy, 0) / hx * greatest(hx + hy - hxy, 0) / hy) END, 6) + 0.0 AS nmi FROM
(SELECT -sum(n * 1.0 / s * log2(n * 1.0 / s)) AS hx FROM (SELECT count(*) AS n, sum(count(*)) OVER () AS s FROM {table} GROUP BY {x}) q) a,
(SELECT -sum(n * 1.0 / s * log2(n * 1.0 / s)) AS hy FROM (SELECT count(*) AS n, sum(count(*)) OVER () AS s FROM {table} GROUP BY {y}) q) b,
(SELECT -sum(n * 1.0 / s * log2(n * 1.0 / s)) AS hxy FROM (SELECT count(*) AS n, sum(count(*)) OVER () AS s FROM {table} GROUP BY {x}, {y}) q) c"""
_NMI_OF = [("lang-source", "documents", "lang", "source"), ("flag-status", "lineitem", "l_returnflag", "l_linestatus"), ("quality-toxic", "labels", "quality", "toxic")]


@query(" UNION ALL ".join(_NMI.format(name=n, table=t, x=x, y=y) for n, t, x, y in _NMI_OF))
def nmi_table(spark: SparkSession, d: str) -> DataFrame:
    """D-18, L-31."""
    each = [M.nmi(read(spark, d, t), x, y).select(F.lit(n).alias("pair"), r("nmi").alias("nmi")) for n, t, x, y in _NMI_OF]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query(f"WITH {EMB}, m AS (SELECT b.label, e.channel, avg(e.value) AS v FROM emb e JOIN embeddings b ON b.vec_id = e.t GROUP BY 1, 2) SELECT a.label AS i, b.label AS j, round(sum(a.v * b.v) / (sqrt(sum(a.v * a.v)) * sqrt(sum(b.v * b.v))), 6) + 0.0 AS cosine FROM m a JOIN m b ON a.channel = b.channel AND a.label < b.label GROUP BY 1, 2")
def cosine_states(spark: SparkSession, d: str) -> DataFrame:
    """D-19, D-20, C-08: cosine between the mean patterns of states."""
    labels = read(spark, d, "embeddings").select(F.col("vec_id").alias("t"), "label")
    means = embedding_panel(spark, d).join(labels, "t").groupBy("label", F.col("channel").alias("t")).agg(F.avg("value").alias("value"))
    pairs = M.channel_pairs(means.withColumnRenamed("label", "channel"))
    return M.cosine_by(pairs, "vi", "vj", ["i", "j"]).select("i", "j", r("cosine").alias("cosine"))


@query("""WITH p AS (SELECT c_custkey AS id, c_nationkey * 200 + c_custkey // 20 AS m, c_nationkey * 100000 + c_custkey // 10 AS f, CASE WHEN c_custkey % 3 = 0 THEN 'MZ' WHEN c_custkey % 3 = 1 THEN 'DZ' ELSE 'NT' END AS z FROM customer)
SELECT a.id AS a, b.id AS b, CASE WHEN a.m = b.m AND a.f = b.f AND a.z = b.z AND a.z = 'MZ' THEN 'MZ' WHEN a.m = b.m AND a.f = b.f AND a.z = b.z AND a.z = 'DZ' THEN 'DZ' ELSE 'Sibling' END AS kinship
FROM p a JOIN p b ON a.id < b.id AND (a.m = b.m OR a.f = b.f)""")
def kinship_pairs(spark: SparkSession, d: str) -> DataFrame:
    """C-08, C-09: customers as people; parents from nation and number."""
    k = F.col("c_custkey")
    p = read(spark, d, "customer").select(
        k.alias("id"), (F.col("c_nationkey") * 200 + F.floor(k / 20)).alias("m"), (F.col("c_nationkey") * 100000 + F.floor(k / 10)).alias("f"),
        F.when(k % 3 == 0, "MZ").when(k % 3 == 1, "DZ").otherwise("NT").alias("z"),
    )
    return U.kinship_pairs(p, "id", "m", "f", "z")


_PR = f"{PANEL}, pr AS (SELECT channel, value AS y, lead(value) OVER (PARTITION BY channel ORDER BY t) AS x FROM panel), ok AS (SELECT * FROM pr WHERE x IS NOT NULL)"


@query(f"WITH {_PR}, a AS (SELECT sum(x * y) / sum(y * y) AS a FROM ok), e AS (SELECT channel, sum((x - a.a * y) * (x - a.a * y)) AS sse, var_pop(x) * count(x) AS sst FROM ok, a GROUP BY 1) SELECT round(avg(1 - sse / sst), 6) + 0.0 AS r2, round(sum(sse), 2) + 0.0 AS sse FROM e")
def null_ar1_r2(spark: SparkSession, d: str) -> DataFrame:
    """L-11, D-23."""
    pairs = P.lag1_pairs(hourly_panel(spark, d))
    fitted = pairs.join(F.broadcast(M.ar1(pairs)))
    return M.forecast_scores(fitted, F.col("a") * F.col("y")).select(r("r2").alias("r2"), r("sse", 2).alias("sse"))


@query(f"WITH {_PR}, e AS (SELECT channel, sum((x - y) * (x - y)) AS sse, var_pop(x) * count(x) AS sst FROM ok GROUP BY 1) SELECT round(avg(1 - sse / sst), 6) + 0.0 AS r2, round(sum(sse), 2) + 0.0 AS sse FROM e")
def persistence_r2(spark: SparkSession, d: str) -> DataFrame:
    """L-12, D-24."""
    return M.forecast_scores(P.lag1_pairs(hourly_panel(spark, d)), F.col("y")).select(r("r2").alias("r2"), r("sse", 2).alias("sse"))


@query("""WITH u AS (SELECT o_custkey, avg(CASE WHEN o_orderpriority LIKE '1%' THEN o_totalprice END) - avg(CASE WHEN o_orderpriority LIKE '5%' THEN o_totalprice END) AS d FROM orders GROUP BY 1)
SELECT count(d) AS n, round(avg(d) / (stddev_samp(d) / sqrt(count(d))), 6) + 0.0 AS t, round(avg(d) / stddev_samp(d), 6) + 0.0 AS d FROM u WHERE d IS NOT NULL""")
def paired_t(spark: SparkSession, d: str) -> DataFrame:
    """L-49: first against last priority within customers."""
    o = read(spark, d, "orders").withColumn("c", F.substring("o_orderpriority", 1, 1))
    return T.paired_t(o, "o_custkey", "c", "o_totalprice", "1", "5").select("n", r("t").alias("t"), r("d").alias("d"))


@query("SELECT event_type, count(value) AS n, round(avg(value - 50) / (stddev_samp(value - 50) / sqrt(count(value))), 5) + 0.0 AS t, round(avg(value - 50) / stddev_samp(value - 50), 6) + 0.0 AS d FROM events GROUP BY 1")
def one_sample_t(spark: SparkSession, d: str) -> DataFrame:
    """L-50."""
    e = read(spark, d, "events").withColumn("x", F.col("value") - 50)
    return T.one_sample_t(e, "x", ["event_type"]).select("event_type", "n", r("t", 5).alias("t"), r("d").alias("d"))


@query("""WITH m AS (SELECT l_linestatus, count(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS n1, count(CASE WHEN l_returnflag <> 'R' THEN l_quantity END) AS n2,
avg(CASE WHEN l_returnflag = 'R' THEN l_quantity END) - avg(CASE WHEN l_returnflag <> 'R' THEN l_quantity END) AS df,
var_samp(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS v1, var_samp(CASE WHEN l_returnflag <> 'R' THEN l_quantity END) AS v2 FROM lineitem GROUP BY 1),
s AS (SELECT *, sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS p FROM m)
SELECT l_linestatus, n1, n2, round(df / p / sqrt(1.0 / n1 + 1.0 / n2), 6) + 0.0 AS t, round(df / p, 8) + 0.0 AS d FROM s""")
def pooled_t(spark: SparkSession, d: str) -> DataFrame:
    """L-51."""
    x = read(spark, d, "lineitem").withColumn("a", F.col("l_returnflag") == "R")
    return T.pooled_t(x, "a", "l_quantity", ["l_linestatus"]).select("l_linestatus", "n1", "n2", r("t").alias("t"), r("d", 8).alias("d"))


def _pvalues(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").groupBy("p_brand").agg((F.avg("p_size") / 1000).alias("p"))


@query("WITH p AS (SELECT p_brand, avg(p_size) / 1000 AS p FROM part GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY p) AS n, count(*) OVER () AS m FROM p) SELECT p_brand, round(least(min(p * m / n) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0), 6) + 0.0 AS adjusted FROM k")
def bh_adjust(spark: SparkSession, d: str) -> DataFrame:
    """L-47, E-12: mean sizes of brands, scaled, as p-values."""
    return T.bh_adjusted(_pvalues(spark, d), "p").select("p_brand", r("adjusted").alias("adjusted"))


@query("WITH p AS (SELECT p_brand, avg(p_size) / 1000 AS p FROM part GROUP BY 1) SELECT p_brand, round(least(p * count(*) OVER (), 1.0), 4) + 0.0 AS adjusted FROM p")
def bonferroni(spark: SparkSession, d: str) -> DataFrame:
    """L-48."""
    return T.bonferroni(_pvalues(spark, d), "p").select("p_brand", r("adjusted", 4).alias("adjusted"))


@query("WITH m AS (SELECT median(s_acctbal) AS m FROM supplier), d AS (SELECT median(abs(s_acctbal - m)) AS d FROM supplier, m) SELECT s_suppkey, abs(s_acctbal - m) > 1.2 * 1.4826 * d AS is_outlier FROM supplier, m, d")
def mad_outliers(spark: SparkSession, d: str) -> DataFrame:
    """B-20."""
    return T.mad_outliers(read(spark, d, "supplier"), ["s_acctbal"], 1.2).select("s_suppkey", "is_outlier")


@query("""WITH x AS (SELECT l_partkey AS u, l_returnflag AS g, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2), q AS (SELECT u FROM x GROUP BY 1 HAVING count(*) = 3), y AS (SELECT x.* FROM x JOIN q ON x.u = q.u),
w AS (SELECT count(DISTINCT u) AS n, avg(v) AS gm, sum(v * v) AS qq FROM y), a AS (SELECT sum(s * s) AS s2 FROM (SELECT sum(v) AS s FROM y GROUP BY u) z), b AS (SELECT sum(c * c) AS c2 FROM (SELECT sum(v) AS c FROM y GROUP BY g) z),
s AS (SELECT n, (s2 / 3 - n * 3 * gm * gm) / (n - 1) AS msr, (qq - s2 / 3 - c2 / n + n * 3 * gm * gm) / ((n - 1) * 2.0) AS mse FROM w, a, b)
SELECT n, round((msr - mse) / (msr + 2 * mse), 6) + 0.0 AS icc FROM s""")
def icc(spark: SparkSession, d: str) -> DataFrame:
    """L-52: mean quantities of parts under the three return flags."""
    x = read(spark, d, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.avg("l_quantity").alias("v"))
    return T.icc(x, "l_partkey", "l_returnflag", "v").select("n", r("icc").alias("icc"))


@query("SELECT p_partkey, round(p_retailprice / sum(p_retailprice) OVER (PARTITION BY p_brand), 9) + 0.0 AS share FROM part")
def share_normalise(spark: SparkSession, d: str) -> DataFrame:
    """D-21."""
    return M.share_of_total(read(spark, d, "part"), "p_retailprice", ["p_brand"]).select("p_partkey", r("share", 9).alias("share"))


@query("SELECT p_brand, round(sum(p_retailprice * p_size) / sum(p_size), 4) + 0.0 AS p_retailprice FROM part GROUP BY 1")
def fold_weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    """D-10."""
    return M.weighted_mean(read(spark, d, "part"), "p_retailprice", "p_size", ["p_brand"]).select("p_brand", r("p_retailprice", 4).alias("p_retailprice"))


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS seg_building, CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 0 END AS seg_machinery, round(c_acctbal * c_nationkey, 4) + 0.0 AS age_sex, round(c_acctbal * c_acctbal, 2) + 0.0 AS age2, round(cbrt(abs(c_acctbal)), 6) + 0.0 AS vol3 FROM customer")
def covariate_dummies(spark: SparkSession, d: str) -> DataFrame:
    """B-21, B-22."""
    x = U.dummies(read(spark, d, "customer"), "c_mktsegment", ["BUILDING", "MACHINERY"], "seg")
    b = F.col("c_acctbal")
    return x.select("c_custkey", "seg_building", "seg_machinery", r(b * F.col("c_nationkey"), 4).alias("age_sex"), r(b * b, 2).alias("age2"), r(F.cbrt(F.abs(b))).alias("vol3"))


@query("""WITH d AS (SELECT c_acctbal - lag(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS d, c_nationkey FROM customer), z AS (SELECT * FROM d WHERE d <> 0),
m AS (SELECT c_nationkey, abs(d) AS m, count(*) AS c, CAST(sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) AS BIGINT) AS up FROM z GROUP BY 1, 2),
k AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY c_nationkey ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (c + 1) / 2.0 AS rank FROM m)
SELECT c_nationkey, CAST(sum(c) AS BIGINT) AS n, round(sum(rank * up), 2) + 0.0 AS w FROM k GROUP BY 1""")
def signed_rank(spark: SparkSession, d: str) -> DataFrame:
    """L-16."""
    from pyspark.sql.window import Window

    x = read(spark, d, "customer").withColumn("d", F.col("c_acctbal") - F.lag("c_acctbal").over(Window.partitionBy("c_nationkey").orderBy("c_custkey")))
    return T.signed_rank(x, "d", ["c_nationkey"]).select("c_nationkey", "n", r("w", 2).alias("w"))


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) + 0.0 AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) + 0.0 AS intercept, round(corr(l_extendedprice, l_quantity), 6) + 0.0 AS r FROM lineitem GROUP BY 1")
def scatter_trend(spark: SparkSession, d: str) -> DataFrame:
    """L-56."""
    return T.trend(read(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]).select("l_returnflag", r("slope", 4).alias("slope"), r("intercept", 2).alias("intercept"), r("r").alias("r"))


@query("""WITH k AS (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events),
p AS (SELECT *, least(greatest(0.85 * n + 0.5, 1.0), n) AS c FROM k) SELECT event_type, round(sum(CASE WHEN abs(i - c) < 1 THEN v * (1 - abs(i - c)) ELSE 0 END), 6) + 0.0 AS percentile FROM p GROUP BY 1""")
def p85_midpoint(spark: SparkSession, d: str) -> DataFrame:
    """D-12, B-19: the 85th percentile with mid-point positions."""
    return T.midpoint_percentile(read(spark, d, "events"), "value", 85, ["event_type"]).select("event_type", r("percentile").alias("percentile"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey <= 50 THEN s_suppkey + 50 ELSE s_suppkey - 50 END AS other, CAST(greatest(ceil((least(greatest(s_acctbal, 0), 5000)) / 5000 * 256), 1) AS INTEGER) AS colour, round(0.13 * sin(2 * (s_acctbal / 1000 - pi() / 4)) + 0.26, 6) + 0.0 AS dfc, round(s_acctbal / 100 - ceil((s_acctbal / 100 - pi()) / (2 * pi())) * 2 * pi(), 6) + 0.0 AS phase FROM supplier")
def scalar_helpers(spark: SparkSession, d: str) -> DataFrame:
    """A-13, B-23, H: hemisphere swap, colour buckets, closed forms and phase wrap."""
    b = F.col("s_acctbal")
    return read(spark, d, "supplier").select(
        "s_suppkey", swap_hemisphere(F.col("s_suppkey"), 50).alias("other"), bucketise(b, 0, 5000).alias("colour"), r(predicted_dfc(b / 1000)).alias("dfc"), r(wrap_phase(b / 100)).alias("phase")
    )


@query(f"WITH {PANEL}, k AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY t) AS n, count(*) OVER (PARTITION BY channel) AS c FROM panel) SELECT channel, CAST(sum(CASE WHEN n <= round(0.8 * c) THEN 1 ELSE 0 END) AS BIGINT) AS n_fit, count(*) AS n FROM k GROUP BY 1")
def temporal_split(spark: SparkSession, d: str) -> DataFrame:
    """E-16."""
    return P.split_in_time(hourly_panel(spark, d)).groupBy("channel").agg(F.sum(F.col("is_fit").cast("long")).alias("n_fit"), F.count("*").alias("n"))


@query("SELECT DISTINCT c_nationkey AS k FROM customer UNION SELECT DISTINCT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    """G-01, G-03, G-05."""
    a = read(spark, d, "customer").select(F.col("c_nationkey").alias("k")).unionByName(read(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))
    return a.distinct().exceptAll(read(spark, d, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("k")))


@query(f"WITH {EMB}, {FC}, x AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY abs(r) DESC, j) AS n FROM fc) SELECT i, j, CAST(n AS INTEGER) AS rank, round(r, 6) + 0.0 AS r FROM x WHERE n <= 3")
def strongest_links(spark: SparkSession, d: str) -> DataFrame:
    """F-01, F-03: the three strongest links of each channel."""
    from pyspark.sql.window import Window

    fc = M.correlation_matrix(embedding_panel(spark, d))
    n = F.row_number().over(Window.partitionBy("i").orderBy(F.abs("r").desc(), "j"))
    return fc.withColumn("rank", n).where("rank <= 3").select("i", "j", "rank", r("r").alias("r"))


@query("WITH x AS (SELECT label AS k, count(*) AS n FROM embeddings GROUP BY 1) SELECT k, n, CAST(sum(n) OVER (ORDER BY k) AS BIGINT) AS upto, round(sum(n) OVER (ORDER BY k) * 1.0 / sum(n) OVER (), 6) + 0.0 AS share FROM x")
def community_sizes(spark: SparkSession, d: str) -> DataFrame:
    """D-26, E-13: sizes, running totals and running shares."""
    from pyspark.sql.window import Window

    x = read(spark, d, "embeddings").groupBy(F.col("label").alias("k")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("k"))  # one row for each label
    return x.select("k", "n", upto.alias("upto"), r(upto / F.sum("n").over(Window.partitionBy(F.lit(1)))).alias("share"))


@query("SELECT o_orderstatus, round(avg(m), 1) + 0.0 AS o_totalprice FROM (SELECT o_orderstatus, o_custkey, avg(o_totalprice) AS m FROM orders GROUP BY 1, 2) q GROUP BY 1")
def mean_of_customer_means(spark: SparkSession, d: str) -> DataFrame:
    """D-09: customers count alike, however many orders they have."""
    out = M.mean_of_means(read(spark, d, "orders"), "o_totalprice", ["o_custkey"], ["o_orderstatus"])
    return out.select("o_orderstatus", r("o_totalprice", 1).alias("o_totalprice"))


@query("SELECT k FROM (SELECT l_orderkey AS k, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2) q GROUP BY 1 HAVING bool_and(n = 2)")
def conforming_sessions(spark: SparkSession, d: str) -> DataFrame:
    """B-02, D-25: orders as sessions, flags as channels, two samples in each."""
    lines = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("channel"))
    return P.conforming(lines, 2, ["k"]).select("k").distinct()


@query(f"""WITH {PANEL}, q AS (SELECT * FROM (SELECT channel, t, value AS y, lead(value) OVER (PARTITION BY channel ORDER BY t) AS x FROM panel) z WHERE x IS NOT NULL),
a AS (SELECT sum(x * y) / sum(y * y) AS a FROM q)
SELECT round(sum((x - y) * (x - y)) / sum((x - a * y) * (x - a * y)), 6) + 0.0 AS loss FROM q CROSS JOIN a""")
def loss_ratio(spark: SparkSession, d: str) -> DataFrame:
    """D-24: squared error of persistence over that of the null model."""
    pairs = P.lag1_pairs(hourly_panel(spark, d))
    null = pairs.join(F.broadcast(M.ar1(pairs)))
    each = M.forecast_scores(pairs, F.col("y")).select(F.col("sse").alias("p")).join(F.broadcast(M.forecast_scores(null, F.col("a") * F.col("y")).select("sse")))
    return each.select(r(F.col("p") / F.col("sse")).alias("loss"))


@query("""WITH m AS (SELECT o_custkey, max(o_totalprice) AS top FROM orders WHERE o_totalprice > 300000 GROUP BY 1)
SELECT c_custkey, coalesce(CASE WHEN top > 400000 THEN 'high' END, 'none') AS band, top IS NOT NULL AND c_acctbal IS NOT NULL AS known FROM customer LEFT JOIN m ON o_custkey = c_custkey""")
def known_covariates(spark: SparkSession, d: str) -> DataFrame:
    """B-11, B-12: a missing category, and rows whose covariates are all known."""
    top = read(spark, d, "orders").where("o_totalprice > 300000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("top"))
    people_ = read(spark, d, "customer").join(top, "c_custkey", "left")
    whole = U.complete(people_.select("c_custkey", "c_acctbal", "top"), ["c_acctbal", "top"]).select("c_custkey", F.lit(True).alias("known"))
    banded = people_.withColumn("band", F.coalesce(F.when(F.col("top") > 400000, "high"), F.lit("none")))
    return banded.join(whole, "c_custkey", "left").select("c_custkey", "band", F.coalesce("known", F.lit(False)).alias("known"))


@query("""WITH n AS (SELECT r_name, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)
SELECT r_name, c_mktsegment, n, round(n / sum(n) OVER (PARTITION BY r_name), 6) + 0.0 AS share FROM n""")
def parent_frequency(spark: SparkSession, d: str) -> DataFrame:
    """D-17: how often each segment occurs under each region."""
    named = people(spark, d).join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    counted = named.groupBy("r_name", "c_mktsegment").agg(F.count("*").alias("n"))
    return M.share_of_total(counted, "n", ["r_name"]).select("r_name", "c_mktsegment", "n", r("share").alias("share"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) ORDER BY 1 LIMIT 100")
def first_subjects(spark: SparkSession, d: str) -> DataFrame:
    """F-06: the first hundred subjects that have data."""
    with_data = read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, d, "customer").join(with_data, "c_custkey", "left_semi").select("c_custkey").orderBy("c_custkey").limit(100)


@query("SELECT o_custkey AS subject, o_orderkey AS folder, CAST(2 * (dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) + CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS BIGINT) AS session FROM orders")
def session_slots(spark: SparkSession, d: str) -> DataFrame:
    """C-15: slots by order of arrival, two to a folder."""
    folders = read(spark, d, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("folder"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(2).alias("direction"))
    return U.session_slots(folders, "subject", by_run=False).select("subject", "folder", F.col("session").cast("long").alias("session"))


@query("SELECT n_nationkey AS i, CASE n_regionkey WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' END AS name FROM nation")
def cluster_names(spark: SparkSession, d: str) -> DataFrame:
    """C-16: names by a fixed assignment; clusters without one have null."""
    clusters = read(spark, d, "nation").select(F.col("n_nationkey").alias("i"), F.col("n_regionkey").alias("cluster"))
    return U.relabelled(clusters, {0: "a", 1: "b", 2: "c"}).select("i", "name")


@query(f"""WITH {EMB}, m AS (SELECT b.label, e.channel, avg(e.value) AS v FROM emb e JOIN embeddings b ON b.vec_id = e.t GROUP BY 1, 2),
c AS (SELECT a.label AS i, b.label AS j, sum(a.v * b.v) / (sqrt(sum(a.v * a.v)) * sqrt(sum(b.v * b.v))) AS cosine FROM m a JOIN m b ON a.channel = b.channel AND a.label <> b.label GROUP BY 1, 2)
SELECT i, round(avg(cosine), 6) + 0.0 AS mean, round(max(cosine), 6) + 0.0 AS "max", count(*) AS n FROM c GROUP BY 1""")
def similarity_summary(spark: SparkSession, d: str) -> DataFrame:
    """D-20, L-57: each state's mean and largest cosine with the other states."""
    labels = read(spark, d, "embeddings").select(F.col("vec_id").alias("t"), "label")
    means = embedding_panel(spark, d).join(labels, "t").groupBy("label", F.col("channel").alias("t")).agg(F.avg("value").alias("value"))
    each = M.cosine_by(M.channel_pairs(means.withColumnRenamed("label", "channel")), "vi", "vj", ["i", "j"])
    return M.symmetric(each, "cosine").groupBy("i").agg(r(F.avg("cosine")).alias("mean"), r(F.max("cosine")).alias("max"), F.count("*").alias("n"))


@query("""WITH m AS (SELECT o_custkey AS u, o_orderpriority AS s, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2),
x AS (SELECT a.s AS first, b.s AS second, a.v - b.v AS d FROM m a JOIN m b ON a.u = b.u AND a.s < b.s)
SELECT first, second, count(*) AS n, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 5) + 0.0 AS t, round(avg(d) / stddev_samp(d), 6) + 0.0 AS d FROM x GROUP BY 1, 2""")
def paired_t_grid(spark: SparkSession, d: str) -> DataFrame:
    """L-49: every two states against one another, over the subjects that have both."""
    means = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("t"), F.col("o_orderpriority").alias("channel")).agg(F.avg("o_totalprice").alias("value"))
    both = M.channel_pairs(means).select(F.col("i").alias("first"), F.col("j").alias("second"), (F.col("vi") - F.col("vj")).alias("_d"))
    return T.one_sample_t(both, "_d", ["first", "second"]).select("first", "second", "n", r("t", 5).alias("t"), r("d").alias("d"))


_RESPONSE = [float(x) for x in hrf(1.0)]


@query(f"""WITH e AS (SELECT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 24 + hour(ts) AS t, event_type FROM events),
on_ AS (SELECT user_id, t AS onset FROM e WHERE event_type = (SELECT min(event_type) FROM events)), s AS (SELECT DISTINCT user_id, t FROM e),
b AS (SELECT s.user_id, s.t, max(CASE WHEN o.onset IS NULL THEN 0 ELSE 1 END) AS v FROM s LEFT JOIN on_ o ON o.user_id = s.user_id AND s.t >= o.onset AND s.t <= o.onset + 6 GROUP BY 1, 2),
h AS (SELECT unnest(range({len(_RESPONSE)})) AS lag, unnest({_RESPONSE!r}) AS w),
c AS (SELECT b.user_id, b.t + h.lag AS t, sum(b.v * h.w) AS x FROM b CROSS JOIN h WHERE b.v <> 0 GROUP BY 1, 2)
SELECT b.user_id, b.t, round(coalesce(c.x, 0.0), 6) + 0.0 AS response FROM b LEFT JOIN c ON c.user_id = b.user_id AND c.t = b.t""")
def task_response(spark: SparkSession, d: str) -> DataFrame:
    """L-38: the boxcar of event_boxcar under a double-gamma response, an hour being a second."""
    return S.convolved(event_boxcar(spark, d), "on", _RESPONSE, ["user_id"]).select("user_id", "t", r("response").alias("response"))


@query(f"""WITH {EMB}, {FC}, s AS (SELECT i, j, r FROM fc UNION ALL SELECT j, i, r FROM fc), n AS (SELECT channel, row_number() OVER (ORDER BY channel % 7, channel) AS k FROM (SELECT DISTINCT channel FROM emb) z)
SELECT a.k AS i, b.k AS j, round(s.r, 6) + 0.0 AS r FROM s JOIN n a ON a.channel = s.i JOIN n b ON b.channel = s.j""")
def reordered_matrix(spark: SparkSession, d: str) -> DataFrame:
    """C-04, F-04: a matrix with its channels in the order of their communities."""
    from pyspark.sql.window import Window

    matrix = M.symmetric(M.correlation_matrix(embedding_panel(spark, d)))
    # one row for each channel
    place = matrix.select(F.col("i").alias("channel")).distinct().withColumn("k", F.row_number().over(Window.orderBy(F.col("channel") % 7, "channel")))
    rows_, columns = (place.select(F.col("channel").alias(c), F.col("k").cast("long").alias(f"_{c}")) for c in ("i", "j"))
    moved = matrix.join(F.broadcast(rows_), "i").join(F.broadcast(columns), "j")
    return moved.select(F.col("_i").alias("i"), F.col("_j").alias("j"), r("r").alias("r"))


@query("SELECT label, count(*) - 1 AS tau FROM embeddings GROUP BY 1 HAVING count(*) - 1 >= 40")
def usable_sessions(spark: SparkSession, d: str) -> DataFrame:
    """B-10: sessions with forty pairs of samples or more."""
    vectors = read(spark, d, "embeddings").groupBy("label").agg((F.count("*") - 1).alias("tau"))
    return vectors.where("tau >= 40")
