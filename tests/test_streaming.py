from pyspark.sql import functions as F

from millrace.models.alternating import ALS
from millrace.sources import matrix as source
from millrace.sources import streams
from millrace.streaming.scoring import score_batches


def test_batches_are_scored(spark, tmp_path):
    rows = spark.createDataFrame([(u, i, 1.0) for u in range(4) for i in range(4) if u != i], "u long, i long, v double")
    model = ALS({"d": 2, "num_iters": 1}).initialize(rows)
    rows.select("u", "i").repartition(2).write.parquet(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema("u long, i long").parquet(str(tmp_path / "in"))
    query = score_batches(stream, model, lambda df, n: got.extend(df.collect()), str(tmp_path / "checkpoint"))
    query.processAllAvailable()
    query.stop()
    want = {(r.u, r.i): r.p for r in model.scores(rows).collect()}
    assert {(r.u, r.i): r.p for r in got} == want and len(want) == 12


def test_lines_and_tsv(spark, tmp_path):
    lines = streams.lines_of(spark.createDataFrame([("a b  c d e",)], "text string"), "text", 2)
    assert sorted(r.value for r in lines.collect()) == ["a b", "c d", "e"]
    source.write_tsv(lines.select("value", F.lit(1).alias("n")), str(tmp_path / "out"))
    assert spark.read.option("sep", "\t").csv(str(tmp_path / "out")).count() == 3
