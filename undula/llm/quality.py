"""Quality classifier with hierarchical empirical Bayes.

Two logistic regressions give a document's evidence of low quality and of toxicity.
The evidence is summed by host and by path in grouped aggregations; host rates are
shrunk towards the global rate and path rates towards their host's, sparse ones most,
with strengths estimated from how far hosts differ, and paths within hosts. A
document's posterior joins its own evidence with what the others of its path and host
say, so that its own evidence counts once.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.llm.shared import broadcast_if_small, checkpointed, release_memory, table

MARKS, SPACE, DIGITS, UPPER_CASE = string.punctuation.encode(), b" \t\n\x0b\x0c\r", string.digits.encode(), string.ascii_uppercase.encode()
#: All of ASCII but digits and lower-case letters becomes a blank.
NO_MARKS = bytes(c if c > 127 or chr(c) in string.digits + string.ascii_lowercase else 32 for c in range(256))
#: The classifiers are fitted on at most so many labelled documents, those with the smallest hashes.
FIT_ROWS = 12_000
#: Partitions of that bounded table, each round of fitting being a job over them, and rounds at most.
FIT_PARTITIONS, FIT_ROUNDS = 6, 30
#: Signs in the model at most, the commonest of that bounded table, and the labelled documents that a sign must be in.
VOCABULARY, MIN_DOCS = 20_000, 4
#: Texts whose signs are handed on at a time.
SIGNED_ROWS = 256
#: Hosts and paths up to so many are joined by broadcast, more by a shuffle.
BROADCAST_SITES = 200_000
#: The weight of the coefficients' absolute values in fitting, which leaves few signs in the model.
REGULARISATION = 0.002
#: A document is rejected from this posterior on.
REJECT = 0.5


def signs(text: str | None) -> set[bytes]:
    """What the classifiers see: words without their marks, and what marks, case, length and repetition the text has."""
    raw = (text or "").encode()
    words, n = raw.lower().translate(NO_MARKS).split(), max(len(raw), 1)
    each = set(words)
    marks = {t[len(t.rstrip(MARKS)) :] for t in set(raw.split())}
    share = lambda kind: int(math.log2(1 + 255 * (n - len(raw.translate(None, kind))) / n))
    shapes = {"upper": share(UPPER_CASE), "digit": share(DIGITS), "mark": share(MARKS), "space": share(SPACE), "length": int(math.log2(n) / 2), "repeats": min(4, int(math.log2(max(len(words), 1) / max(len(each), 1))))}
    return each | {b"\x01" + m for m in marks if 0 < len(m) <= 4} | {f"\x01{k} {v}".encode() for k, v in shapes.items()}


def _signed(rows: DataFrame) -> DataFrame:
    """rows (text, low, toxic) with _signs in the place of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, SIGNED_ROWS) for i in range(0, batch.num_rows, SIGNED_ROWS)):
                found = pa.array([[x.decode(errors="replace") for x in sorted(signs(t.as_py()))] for t in part.column("text")], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([found, part.column("low"), part.column("toxic")], names=["_signs", "low", "toxic"])
        release_memory()

    return rows.select("text", "low", "toxic").mapInArrow(run, "_signs array<string>, low double, toxic double")


def logit(p: Column) -> Column:
    inner = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.log(inner / (1 - inner))


def labelled(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """(text, low, toxic) of the labelled documents fitted on; of several labels the worst counts, null ones don't."""
    worst = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    picked = worst.orderBy(F.xxhash64("doc_id")).limit(fit_rows)  # a bounded table
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select(
        "text", (F.col("quality") == 0).cast("double").alias("low"), (F.col("toxic") == 1).cast("double").alias("toxic")
    )


def fit_heads(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> dict[str, tuple[float, dict[bytes, float]]]:
    """For low and toxic, the intercept and the weights of signs; heads whose labels show one class only, or too few, are left out."""
    fit = checkpointed(_signed(labelled(docs, labels, fit_rows)))
    if not fit.limit(1).count():
        return {}
    counted = CountVectorizer(inputCol="_signs", outputCol="_v", vocabSize=VOCABULARY, minDF=MIN_DOCS, binary=True).fit(fit)
    if not counted.vocabulary:
        return {}
    fit, heads = checkpointed(counted.transform(fit).drop("_signs").coalesce(FIT_PARTITIONS)), {}
    for name in ("low", "toxic"):
        known = fit.where(F.col(name).isNotNull())
        if known.select(name).distinct().limit(2).count() == 2:
            model = LogisticRegression(featuresCol="_v", labelCol=name, regParam=REGULARISATION, elasticNetParam=1.0, maxIter=FIT_ROUNDS, tol=1e-4, standardization=False).fit(known)
            heads[name] = (float(model.intercept), {w.encode(): float(c) for w, c in zip(counted.vocabulary, model.coefficients.toArray()) if c})
    return heads


def evidence(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, _host, _path, _low, _toxic) for docs (doc_id, text, _host, _path): the probabilities that the classifiers give."""
    heads = fit_heads(docs, labels, fit_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list[float]] = {"low": [], "toxic": []}
            for text in batch.column("text"):
                found = signs(text.as_py())
                for name, column in out.items():
                    if name in heads:
                        start, weights = heads[name]
                        total = start + sum(map(weights.__getitem__, found & weights.keys()))
                        column.append(1 / (1 + math.exp(-max(-700.0, min(700.0, total)))))
                    else:
                        column.append(0.0)
            kept = [batch.column(c) for c in names[:3]]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(out[k], pa.float64()) for k in out)], names=names)
        release_memory()

    names = ["doc_id", "_host", "_path", "_low", "_toxic"]
    kinds = dict(docs.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in names[:3]] + ["_low double", "_toxic double"])
    return docs.select("doc_id", "text", "_host", "_path").mapInArrow(run, schema)


def _strength(within: Column, between: Column) -> Column:
    """Documents that a beta prior is worth whose variance is `between`; 2 to 1000."""
    return F.least(F.greatest(within / F.greatest(between, within / 1000, F.lit(1e-12)) - 1, F.lit(2.0)), F.lit(1000.0))


def site_sums(rows: DataFrame) -> DataFrame:
    """(_host, _path, n, s, hn, hs, global_rate, host_strength, path_strength) for rows (_host, _path, bad).

    n and s are a path's documents and the sum of their probabilities of being bad, hn
    and hs its host's. Strengths come by the method of moments: that of hosts from the
    variance between hosts, that of paths from the variance between the paths of a host,
    each beyond what sampling explains.
    """
    paths = checkpointed(rows.groupBy("_host", "_path").agg(F.count("*").alias("n"), F.sum("bad").alias("s")))
    square = lambda s, n: F.sum(F.col(s) * F.col(s) / F.col(n))
    hosts = paths.groupBy("_host").agg(
        F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.count("*").alias("paths"), square("s", "n").alias("q"), (F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("n2"),
    )
    moments = hosts.agg(
        F.sum("hn").alias("N"), F.sum("hs").alias("S"), F.count("*").alias("H"), square("hs", "hn").alias("Q"), F.sum(F.col("hn") * F.col("hn")).alias("N2"),
        F.sum("paths").alias("P"), F.sum("q").alias("PQ"), F.sum("n2").alias("PN2"),
    )
    m = F.col("S") / F.col("N")
    within = m * (1 - m)
    hosts_vary = (F.col("Q") - F.col("N") * m * m - (F.col("H") - 1) * within) / F.greatest(F.col("N") - F.col("N2") / F.col("N"), F.lit(1.0))
    paths_vary = (F.col("PQ") - F.col("Q") - (F.col("P") - F.col("H")) * within) / F.greatest(F.col("N") - F.col("PN2"), F.lit(1.0))
    overall = moments.select(m.alias("global_rate"), _strength(within, hosts_vary).alias("host_strength"), _strength(within, paths_vary).alias("path_strength"))  # one row
    named = hosts.select(F.col("_host").alias("_h"), "hn", "hs")
    return paths.join(named, paths["_host"].eqNullSafe(named["_h"])).drop("_h").join(F.broadcast(overall))


def prior(own: Column | None = None) -> Column:
    """The shrunk rate of a path from the columns of site_sums, without one of its documents where `own` is its probability."""
    less, one = (F.lit(0.0), 0) if own is None else (own, 1)
    k, j = F.col("host_strength"), F.col("path_strength")
    host = (F.greatest(F.col("hs") - less, F.lit(0.0)) + k * F.col("global_rate")) / (F.col("hn") - one + k)
    return (F.greatest(F.col("s") - less, F.lit(0.0)) + j * host) / (F.col("n") - one + j)


def site_priors(rows: DataFrame) -> DataFrame:
    """(_host, _path, prior, global_rate, n): each path's shrunk rate of bad documents; rows: (_host, _path, bad)."""
    return site_sums(rows).select("_host", "_path", prior().alias("prior"), "global_rate", "n")


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", fit_rows: int = FIT_ROWS, reject: float = REJECT) -> DataFrame:
    """(doc_id, low, toxic, prior, posterior, keep) for every row of docs.

    docs needs doc_id, text, and the host and path columns; labels doc_id, quality (0:
    low) and toxic (1: toxic). Other columns are not read. A null text is an empty one;
    null hosts and paths are sites of their own; labels of other documents count for
    nothing. low and toxic are the classifiers' probabilities, 0 where labels show one
    class only or are too few. prior is the shrunk rate of bad documents among the others
    of its path, posterior the probability that the document is bad; it is kept below
    `reject`. Repeated rows are classified each; an empty table gives no rows.
    """
    named = docs.select("doc_id", "text", F.col(host).alias("_host"), F.col(path).alias("_path"))
    scored = checkpointed(evidence(named, labels, fit_rows).withColumn("bad", F.greatest("_low", "_toxic")))
    sites = checkpointed(site_sums(scored.select("_host", "_path", "bad")))
    s = broadcast_if_small(sites.withColumnsRenamed({"_host": "_h", "_path": "_p"}), BROADCAST_SITES)
    joined = scored.join(s, scored["_host"].eqNullSafe(F.col("_h")) & scored["_path"].eqNullSafe(F.col("_p"))).withColumn("prior", prior(F.col("bad")))
    total = logit(F.col("bad")) + logit(F.col("prior")) - logit(F.col("global_rate"))
    return joined.withColumn("posterior", 1 / (1 + F.exp(-total))).select(
        "doc_id", F.col("_low").alias("low"), F.col("_toxic").alias("toxic"), "prior", "posterior", (F.col("posterior") < reject).alias("keep")
    )


def keep_good(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """docs without the rows that classify rejects; rows without a doc_id stay.

    Rows of one doc_id go together: all of them where one is rejected.
    """
    rejected = classify(docs, labels, fit_rows=fit_rows).where("not keep").select("doc_id").distinct()
    return docs.join(rejected, "doc_id", "left_anti").select(docs.columns)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op4_quality": op4_quality}
