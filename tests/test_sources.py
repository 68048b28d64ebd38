"""Files read back what was written; streams give what batches give."""

from pyspark.sql import functions as F

from undula.sources import files
from undula.streaming import panels


def test_numbers_and_events(spark, tmp_path):
    (tmp_path / "100307_REST1_LR").mkdir()
    f = tmp_path / "100307_REST1_LR" / "motion.txt"
    f.write_text("0.1  0.2\t0.3\n\n 1 x 3\n")
    got = files.numbers(spark, str(f), ["a", "b", "c"]).select("a", "b", "c", files.folder_keys(F.col("file"))[0].alias("s")).collect()
    assert [tuple(r) for r in got] == [(0.1, 0.2, 0.3, "100307"), (1.0, None, 3.0, "100307")]
    for k in ("go", "stop"):
        (tmp_path / f"{k}.txt").write_text("1.5\t2\n")
    assert {r["trial_type"] for r in files.events(spark, {k: str(tmp_path / f"{k}.txt") for k in ("go", "stop")}).collect()} == {"go", "stop"}


def test_attribute_sink(spark, tmp_path):
    files.write_attributes(spark.createDataFrame([(1, "a")], "x int, y string"), str(tmp_path / "t"), {"y": "Name", "x": "Subject"})
    assert [tuple(r) for r in files.attributes(spark, str(tmp_path / "t"), "Name string, Subject int").collect()] == [("a", 1)]


def test_noise_is_standard(spark):
    n = files.noise(spark, 2, 3, 500)
    assert n.groupBy("replicate", "channel").count().where("count = 500").count() == 6
    m = n.agg(F.avg("value"), F.stddev("value")).first()
    assert abs(m[0]) < 0.1 and abs(m[1] - 1) < 0.1


def test_streamed_panel_equals_batch(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/events.parquet").write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = panels.windowed_panel(stream, "event_type", "value").writeStream.outputMode("complete").format("memory").queryName("panel").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("panel").exceptAll(panels.windowed_panel(batch, "event_type", "value")).count() == 0
    assert spark.table("panel").count() > 0


def test_noise_is_the_same_however_it_is_dealt(spark):
    a = files.noise(spark, 3, 4, 500, seed=7)
    b = files.noise(spark, 3, 4, 500, seed=7).repartition(7)
    assert a.exceptAll(b).count() == 0
    x = a.toPandas()["value"]
    assert abs(x.mean()) < 0.05 and abs(x.std() - 1) < 0.05
