"""The corpus pipeline: its stages take effect, hand on the columns of documents, and equal brute force."""

import collections
import itertools
import math
import re
import zlib

import numpy as np

import corpus_pipeline
from undula.llm import decontaminate, line_dedup, quality, tokens
from undula.llm.shared import fresh_path


def texts_of(df):
    return {r["doc_id"]: r["text"] or "" for r in df.collect()}


def logit(p):
    p = min(max(p, 1e-9), 1 - 1e-9)
    return math.log(p / (1 - p))


def test_quality_stage_equals_plain_formulas(spark, sf_dir):
    """Posteriors from the classifiers' evidence, document by document."""
    d, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(d, labels).join(d.select("doc_id", "source", "lang"), "doc_id").collect()
    bad = {r["doc_id"]: max(r["low"], r["toxic"]) for r in rows}
    rate = sum(bad.values()) / len(bad)
    for r in rows:
        own = bad[r["doc_id"]]
        want = 1 / (1 + math.exp(-(logit(own) + logit(r["prior"]) - logit(rate))))
        assert abs(r["posterior"] - want) < 1e-9 and r["keep"] == (r["posterior"] < 0.5)
    kept = {r["doc_id"] for r in corpus_pipeline.quality_classifier(spark, d, sf_dir).collect()}
    assert kept == {r["doc_id"] for r in rows if r["keep"]}


def test_line_stage_equals_brute_force(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts, found = texts_of(d), collections.defaultdict(set)
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    for i, t in texts.items():
        for line in t.split("\n"):
            found[key(line)].add(i)
    want = {i: "\n".join(x for x in t.split("\n") if not key(x) or len(found[key(x)]) < 10) for i, t in texts.items()}
    got = corpus_pipeline.line_dedup(spark, d, sf_dir)
    assert texts_of(got) == want and all(r["n_chars"] == len(want[r["doc_id"]]) for r in got.collect())


def test_near_stage_equals_brute_force(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = texts_of(d)
    words = {i: re.sub("[A-Z]", lambda m: m[0].lower(), t).split() for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in words.items()}
    root = {i: i for i in texts}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a, b in itertools.combinations(sorted(texts), 2):
        x, y = sets[a], sets[b]
        if words[a] == words[b] or (x and y and 0.8 * max(len(x), len(y)) <= min(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y)):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    assert set(texts_of(corpus_pipeline.near_dedup(spark, d, sf_dir))) == {find(i) for i in texts}


def test_decontamination_stage_equals_brute_force(spark, sf_dir):
    d, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(w[k : k + 10]) for w in (words(r["text"]) for r in items.collect()) for k in range(max(1, len(w) - 9)) if w}
    sizes = {len(w) for w in windows}
    clean = {i for i, t in texts_of(d).items() if not any(tuple(w[k : k + n]) in windows for w in [words(t)] for n in sizes for k in range(len(w) - n + 1))}
    assert set(texts_of(corpus_pipeline.decontamination(spark, d, sf_dir))) == clean


def test_packing_stage_covers_every_id_once(spark, sf_dir):
    from tokenizers import Tokenizer

    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tokenizer, pieces = Tokenizer.from_file(tokens.WORD_BPE), collections.defaultdict(list)
    for r in corpus_pipeline.packing(spark, d, sf_dir).collect():
        pieces[r["doc_id"]].append(r)
    for i, t in texts_of(d).items():
        ids, at = tokenizer.encode(t, add_special_tokens=False).ids + [2], 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)


def test_stages_on_odd_tables(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    rows = [(1, None, "en", "s", 0), (2, "", None, "s", 0), (3, " \n\t", "en", None, None), (4, "a b c d e", "en", "s", 9), (4, "a b c d e", "en", "s", 9), (5, "x " * 9000, "en", "s", 9), (None, "no id", "en", "s", 5)]
    odd = spark.createDataFrame(rows, schema)
    for extra in ("n_lines", "component_id", "_host", "posterior", "node"):
        odd = odd.withColumn(extra, odd["lang"])
    for d in (odd, odd.where("false")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, d, sf_dir)
            assert out.columns == d.columns, name
            n, before = out.count(), d.count()
            assert n <= before and (n > 0) == (before > 0), name
        packed = corpus_pipeline.packing(spark, d, sf_dir)
        assert packed.count() >= d.count()


def test_stages_in_order(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, ids = d.columns, {r["doc_id"] for r in d.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = fresh_path(spark, "test-stage")
        stage(spark, d, sf_dir).write.parquet(path)
        before, d = d, spark.read.parquet(path)
        now = [r["doc_id"] for r in d.select("doc_id").collect()]
        assert d.columns == columns and len(now) == len(set(now)) and set(now) <= ids
        if name == "line dedup":
            want = line_dedup.drop_frequent_lines(before).select("doc_id", "text")
            assert d.select("doc_id", "text").exceptAll(want).count() == 0 and set(now) == ids
        if name == "benchmark decontamination":
            assert decontaminate.contamination(d, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("n_hit > 0").count() == 0
        ids = set(now)
    packed = corpus_pipeline.STAGES[-1][1](spark, d, sf_dir)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == ids


def test_run_on_odd_and_empty_tables(spark, tmp_path):
    """The whole of run(): null, empty, blank and repeated rows, rows without an id, a benchmark passage; tables without labels, items or documents."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    passage = "one two three four five six seven eight nine ten eleven"
    texts = [(1, None), (2, ""), (3, " \n "), (4, "plain words that stay " * 3), (4, "plain words that stay " * 3), (5, f"before {passage} after"), (None, "no id here"), (6, "long " * 9000)]
    docs = spark.createDataFrame([(i, t, "en", None, 0) for i, t in texts], schema)
    tables = {"labels": ("doc_id long, quality int, toxic int", [(4, 1, 0), (5, None, None)]), "benchmark": ("item_id long, text string", [(1, passage), (2, None)])}
    for name, rows in (("odd", docs), ("none", docs.where("false"))):
        rows.write.parquet(str(tmp_path / name / "documents.parquet"))
        for table, (kind, held) in tables.items():
            spark.createDataFrame(held if name == "odd" else [], kind).write.parquet(str(tmp_path / name / f"{table}.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    of = lambda i: [r for r in rows if r["doc_id"] == i]
    assert not of(5) and sum(r["length"] for r in of(6)) == of(6)[0]["doc_tokens"] == 9001
    # a document's pieces hold its ids once, so repeated rows are one; of blank texts, which are copies of one another, one stays
    whole = lambda i: sum(r["length"] for r in of(i)) == of(i)[0]["doc_tokens"]
    assert whole(4) and whole(None) and len(of(1) + of(2) + of(3)) == 1 and of(1)[0]["doc_tokens"] == 1
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_written_tables_leave_no_shuffle_files(spark):
    import time

    from undula.llm.shared import checkpointed, settled

    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in disk.getAllFiles().mkString(" ").split() if "shuffle_" in f}
    before = files()
    rows = spark.range(20_000).selectExpr("id", "id % 7 AS k")
    x = checkpointed(rows.repartition(5, "id"))
    y = settled(lambda first: first.groupBy("k").count())(x)
    until = time.time() + 10
    while files() - before and time.time() < until:
        time.sleep(0.1)
    assert not files() - before
    assert y.count() == 7 and x.count() == 20_000 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
