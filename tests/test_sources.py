import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import matrix, prepro, splits
from millrace.sources import matrix as source
from millrace.sources import streams

#: Small inputs.
MM = "%%MatrixMarket matrix coordinate integer general\n%\n%\n5 3 5\n1 1 1\n2 1 3\n3 3 1\n4 2 1\n5 2 2\n"
STREAM = "apple mango mango apple pie juice coke\npie\njuice coke grape\n"


@pytest.fixture
def mm(spark, tmp_path):
    (tmp_path / "main.mm").write_text(MM)
    return source.matrix_market(spark, str(tmp_path / "main.mm"))


def test_matrix_market(spark, mm, tmp_path):
    assert source.header(spark, str(tmp_path / "main.mm")) == {"num_users": 5, "num_items": 3, "num_nnz": 5}
    assert [(r.u, r.i, r.v) for r in mm.orderBy("u").collect()] == [(0, 0, 1), (1, 0, 3), (2, 2, 1), (3, 1, 1), (4, 1, 2)]
    assert [r.u for r in mm.orderBy("i", "u").collect()] == [0, 1, 3, 4, 2]
    assert [r.indptr for r in matrix.indptr(mm).orderBy("u").collect()] == [1, 2, 3, 4, 5]


def test_prepro(mm):
    values = lambda df: [round(r.v, 6) for r in df.orderBy("u").collect()]
    assert values(prepro.apply(mm, "OneBased")) == [1] * 5
    assert values(prepro.apply(mm, "MinMaxScalar", low=3, high=5)) == [3, 5, 3, 3, 4]
    assert values(prepro.apply(mm, "ImplicitALS", epsilon=0.5))[2] == 1.098612
    with pytest.raises(RuntimeError):
        prepro.apply(mm, "SPPMI")
    assert values(prepro.apply(mm.withColumn("v", F.lit(-2.0)), "MinMaxScalar")) == [1] * 5


def test_arrays_and_ids(spark):
    dense = np.zeros((4, 3))
    dense[1, 2] = 2.5
    assert [tuple(r) for r in source.from_arrays(spark, dense).collect()] == [(1, 2, 2.5)]
    with pytest.raises(TypeError):
        source.from_arrays(spark, [[1, 2]])
    assert [r.key for r in source.ids(spark, None, 3).orderBy("idx").collect()] == ["1", "2", "3"]
    with pytest.raises(TypeError):
        source.ids(spark, ["a", "b"], 3)
    with pytest.raises(RuntimeError):
        source.load(spark, {"type": "csv"})


def test_stream_splits(spark, tmp_path):
    (tmp_path / "main").write_text(STREAM)
    (tmp_path / "uid").write_text("kim\nlee\npark\n")
    users = source.ids(spark, str(tmp_path / "uid"))
    rows = streams.stream(spark, str(tmp_path / "main"), users).select(F.col("user").alias("u"), "pos", F.col("token").alias("i"))
    train, held = splits.newest(rows, 1)
    assert {(r.u, r.i) for r in held.collect()} == {("kim", "coke"), ("park", "grape")}
    assert [r.i for r in train.orderBy("u", "pos").collect()] == "apple mango mango apple pie juice pie juice coke".split()
    assert {(r.u, r.i, r.v) for r in streams.to_matrix(train).collect()} >= {("kim", "apple", 2), ("kim", "mango", 2)}
    assert streams.to_matrix(train).count() == 7


def test_store_and_cache(spark, mm, tmp_path):
    path = str(tmp_path / "db")
    built = []
    for _ in range(2):
        rows = source.cached(spark, path, lambda: built.append(1) or mm)
        assert rows.count() == 5
    assert built == [1]
    rows, head = source.opened(spark, path, "colwise")
    assert head == {"num_nnz": 5, "num_users": 5, "num_items": 3} and rows.count() == 5


def test_a_row_of_a_store_is_in_one_bucket(spark, tmp_path):
    rows = spark.range(2000).select((F.col("id") % 97).alias("u"), (F.col("id") % 31).alias("i"), (F.col("id") * 1.0).alias("v"))
    path = str(tmp_path / "db")
    source.store(rows, path, buckets=8)
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else buckets are read as well, but plans of a scan alone don't say so
    for axis, key in (("rowwise", "u"), ("colwise", "i")):
        found = source.opened(spark, path, axis)[0].where(F.col(key) == 7)
        assert "SelectedBucketsCount: 1 out of 8" in found._jdf.queryExecution().toString()
        assert found.exceptAll(rows.where(F.col(key) == 7)).count() == 0 and found.count() == rows.where(F.col(key) == 7).count()
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    both = source.opened(spark, path)[0].groupBy("u").count()
    assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString() and both.count() == 97


def test_a_store_is_built_again_when_its_source_changes(spark, tmp_path):
    file, path, built = tmp_path / "a.csv", str(tmp_path / "db"), []

    def build():
        built.append(1)
        return spark.read.schema("u long, i long, v double").csv(str(file))

    def rows(**options):
        return source.cached(spark, path, build, {"files": source.fingerprint(spark, str(file)), "options": options}).count()

    file.write_text("0,1,2.0\n")
    assert rows() == rows() == 1 and len(built) == 1
    assert rows(value_prepro="x") == 1 and len(built) == 2
    file.write_text("0,1,2.0\n1,1,1.0\n")
    assert rows(value_prepro="x") == rows(value_prepro="x") == 2 and len(built) == 3


def test_lines_are_numbered_over_files(spark, tmp_path):
    for n in range(5):
        (tmp_path / f"part{n}").write_text("".join(f"{n} {k}\n" for k in range(100 * n)))
    rows = source.numbered_lines(spark, str(tmp_path / "part*")).orderBy("line").collect()
    assert [r.line for r in rows] == list(range(1000))
    for a, b in zip(rows, rows[1:]):
        (n, k), (m, j) = (map(int, r.value.split()) for r in (a, b))
        assert (m, j) == (n, k + 1) or j == 0


def test_ratings(spark, tmp_path):
    table = spark.createDataFrame([("b", 10, 4.0, 3), ("a", 20, 1.0, 9), ("a", 10, 2.0, 5), ("b", 20, 5.0, 1), ("a", 10, 3.0, 9)], "user string, item int, v double, t int")
    names = spark.createDataFrame([(10, "ten"), (20, "twenty"), (30, "thirty")], "key int, name string")
    matrix_, stream, users, items = streams.ratings(table, "user", "item", "v", "t", names)
    assert sorted((r.u, r.i, r.v) for r in matrix_.collect()) == [(0, 0, 2.0), (0, 0, 3.0), (0, 1, 1.0), (1, 0, 4.0), (1, 1, 5.0)]
    assert [r.i for r in stream.orderBy("u", "pos").collect()] == ["ten", "ten", "twenty", "twenty", "ten"]
    assert {r.key for r in users.collect()} == {"a", "b"} and sorted((r.idx, r.key) for r in items.collect()) == [(0, "ten"), (1, "twenty"), (2, "thirty")]
    assert sorted(r.value for r in streams.lines(stream).collect()) == ["ten ten twenty", "twenty ten"]
    source.write_tsv(matrix_, str(tmp_path / "tsv"))
    assert spark.read.option("sep", "\t").csv(str(tmp_path / "tsv")).count() == 5


def test_sampled_places(spark):
    stream = spark.createDataFrame([(u, p, "ab"[(u + p) % 2]) for u in range(10) for p in range(20)], "u long, pos long, i string")
    train, held = splits.sample_stream(stream, 0.1)
    assert held.count() == 20 and train.count() == 180 and train.unionByName(held).exceptAll(stream).count() == 0
    assert splits.filled(held).agg(F.sum("v")).first()[0] == 20 and splits.filled(held, 1.0).agg(F.max("v")).first()[0] == 1
    assert splits.evaluated(held, 3).count() == 3
    assert prepro.identity(stream) is stream


def test_running_sums_of_strings(spark):
    words = [f"same{k:05}" for k in range(3000)]
    rows = spark.createDataFrame([(w, k % 7) for k, w in enumerate(words)], "w string, n int")
    got = {r.w: r.cum for r in matrix.running(rows, "w", "n", "cum").collect()}
    assert [got[w] for w in words] == np.cumsum([k % 7 for k in range(3000)]).tolist()


def test_rating_files(spark, tmp_path):
    (tmp_path / "u.data").write_text("1\t7\t3\t90\n2\t7\t5\t10\n1\t8\t4\t20\n")
    (tmp_path / "ratings.csv").write_text("userId,movieId,rating,timestamp\n1,7,3.5,90\n")
    tabs, commas = streams.rating_file(spark, str(tmp_path / "u.data")), streams.rating_file(spark, str(tmp_path / "ratings.csv"), ",", True)
    assert [tuple(r) for r in commas.collect()] == [("1", "7", 3.5, 90)]
    rows, stream, users, items = streams.ratings(tabs, "user", "item", "value", "time")
    assert sorted(r.value for r in streams.lines(stream).collect()) == ["7", "8 7"] and rows.count() == 3
    assert sorted(r.value for r in streams.lines_of(spark.createDataFrame([("a b c d e",)], "t string"), "t", 2).collect()) == ["a b", "c d", "e"]
    assert prepro.apply(rows, lambda df, by: df.withColumn("v", F.col("v") * by), by=2).agg(F.sum("v")).first()[0] == 24


def test_lines_are_cut_within_rows(spark):
    """No word is shuffled; blank and null rows give no line."""
    rows = ["", None, " \t\n", "a", " a\tb \n c\x0bd\re ", "x " * 7, "\u00a0 é\u3000ß z"]
    lines = streams.lines_of(spark.createDataFrame([(r,) for r in rows], "t string"), "t", 3)
    assert sorted(r.value for r in lines.collect()) == sorted(["a", "a b c", "d e", "x x x", "x x x", "x", "\u00a0 é\u3000ß z"])
    assert "Exchange" not in lines._jdf.queryExecution().executedPlan().toString()
