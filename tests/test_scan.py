"""Folders with either of two runs, with missing, empty and denied sessions."""

import pytest
from pyspark.errors import AnalysisException

from undula.sources import files, scan
from undula.streaming import panels

PATTERN = r"/(\d+)/(REST\d)_(LR|RL)/series\.parquet/part-[^/]*$"


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    """Subjects 1 to 4: REST1 and REST2, REST2 only, RL only, nothing; subject 5 has a broken file."""
    top = tmp_path_factory.mktemp("sessions")
    for subject, run, direction in [(1, 1, "LR"), (1, 2, "LR"), (1, 1, "RL"), (2, 2, "LR"), (2, 2, "RL"), (3, 1, "RL")]:
        rows = spark.createDataFrame([(t, float(100 * subject + 10 * run + t)) for t in range(3)], "t int, value double")
        rows.coalesce(1).write.parquet(str(top / str(subject) / f"REST{run}_{direction}" / "series.parquet"))
    empty = top / "5" / "REST1_LR" / "series.parquet"
    empty.mkdir(parents=True)
    (empty / "part-0.parquet").write_text("x")
    return str(top)


def test_scan_with_either_run_and_report(spark, root):
    found = scan.listing(spark, root, PATTERN, ["subject", "run", "direction"], "part-*")
    keys = ["subject", "direction"]
    chosen = scan.either(found, keys, "run", ["REST1", "REST2"])
    assert {(r["subject"], r["direction"]): r["run"] for r in chosen.collect()} == {("1", "LR"): "REST1", ("1", "RL"): "REST1", ("2", "LR"): "REST2", ("2", "RL"): "REST2", ("3", "RL"): "REST1", ("5", "LR"): "REST1"}
    expected = spark.createDataFrame([(str(s), d) for s in range(1, 6) for d in ("LR", "RL")], "subject string, direction string")
    denied = spark.createDataFrame([("2", "RL"), ("9", "LR")], "subject string, direction string")
    report = scan.left_out(expected, chosen, keys, denied, least=12)
    assert {(r["subject"], r["direction"]): r["reason"] for r in report.collect()} == {("2", "RL"): "denied", ("3", "LR"): "missing", ("4", "LR"): "missing", ("4", "RL"): "missing", ("5", "LR"): "empty", ("5", "RL"): "missing"}
    rows = scan.read_chosen(spark, root, chosen, keys, "t int, value double", report, files="part-*", tolerant=True).collect()
    assert sorted((r["subject"], r["direction"], r["t"], r["value"]) for r in rows) == sorted((s, d, t, v + t) for s, d, v in [("1", "LR", 110.0), ("1", "RL", 110.0), ("2", "LR", 220.0), ("3", "RL", 310.0)] for t in range(3))


def test_label_map_with_fallback(spark, tmp_path):
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    spark.createDataFrame([(1, 5), (2, 6)], "voxel int, label int").write.parquet(one)
    spark.createDataFrame([(1, 50), (2, 60), (3, 70)], "voxel int, label int").write.parquet(two)
    rows = lambda p: sorted(tuple(r) for r in scan.label_map(spark, one, p).collect())
    assert rows(two) == [(1, 5), (2, 6), (3, 70)] and rows(str(tmp_path / "none")) == [(1, 5), (2, 6)]
    with pytest.raises(AnalysisException):
        scan.label_map(spark, str(tmp_path / "none"), two)
    (tmp_path / "odd").mkdir()
    with pytest.raises(AnalysisException):
        scan.label_map(spark, one, str(tmp_path / "odd")).collect()


def test_artifacts(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 2.0), (2, "b", 3.0)], "mode int, state string, value double")
    files.write_artifact(rows, str(tmp_path / "a"), ["state"])
    files.write_artifact(rows.where("mode = 1"), str(tmp_path / "a"), ["state"])
    assert [tuple(r) for r in files.panel(spark, str(tmp_path / "a")).select("mode", "state", "value").collect()] == [(1, "a", 2.0)]


def test_streamed_moments_equal_batch(spark, tmp_path):
    rows = spark.createDataFrame([({"a": 1.0, "b": 2.0},), ({"a": 3.0, "b": -1.0},), ({"a": 0.5},)], "cells map<string,double>")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = panels.second_moments(stream).writeStream.outputMode("complete").format("memory").queryName("sums").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["i"], r["j"]): r["value"] for r in spark.table("sums").collect()}
    assert got == {("a", "a"): 10.25, ("a", "b"): -1.0, ("b", "a"): -1.0, ("b", "b"): 5.0}
