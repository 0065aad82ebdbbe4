"""Hand-made delimited fixtures (S1-S6) and sinks."""

import os

import pytest
from pyspark.sql import functions as F

from tabfold.sources import delimited, sinks

CONN_NAMES = [f"x{i}" for i in range(41)] + ["label"]


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        fh.write(text)
    return path


def test_multi_header_names_and_body(spark, tmp_dir):
    p = _write(f"{tmp_dir}/features.csv",
               "feature,chroma,chroma,mfcc\nstatistics,mean,std,mean\nnumber,01,01,01\n"
               "track_id,,,\n1,0.5,0.1,3\n2,0.6,0.2,4\n")
    df = delimited.read_multi_header(spark, p)
    assert df.columns == ["track_id", "chroma_mean_01", "chroma_std_01", "mfcc_mean_01"]
    rows = sorted(tuple(r) for r in df.collect())
    assert rows == [(1, 0.5, 0.1, 3.0), (2, 0.6, 0.2, 4.0)]
    assert dict(df.dtypes)["track_id"] == "bigint"


def test_multi_header_bad_cell_keeps_row(spark, tmp_dir):
    p = _write(f"{tmp_dir}/f.csv", "feature,a\nstatistics,m\nnumber,01\ntrack_id,\n1,oops\n2,2.5\n")
    rows = sorted(tuple(r) for r in delimited.read_multi_header(spark, p).collect())
    assert rows == [(1, None), (2, 2.5)]


def test_multi_header_other_join(spark, tmp_dir):
    p = _write(f"{tmp_dir}/f.csv", "feature,a\nstatistics,m\nnumber,01\ntrack_id,\n7,1\n")
    assert delimited.read_multi_header(spark, p, join=".").columns == ["track_id", "a.m.01"]


def _repeated_header_csv():
    head = ",album,track,track,track,track,track,track,track,track,artist\n"
    meta = "title,x,a,b,c,d,e,f,g,genre_top,n\ntrack_id,,,,,,,,,,\n"
    body = "2,al,1,2,3,4,5,6,7,Rock,ar\n3,al,1,2,3,4,5,6,7,,ar\n5,al,1,2,3,4,5,6,7,Folk,ar\n"
    return head + meta + body


def test_positional_scan_eighth_track_and_null(spark, tmp_dir):
    p = _write(f"{tmp_dir}/tracks.csv", _repeated_header_csv())
    df = delimited.read_positional(spark, p, {"track_id": 0, "Genre": ("track", 8)},
                                   types={"track_id": "int"}, key="track_id")
    rows = sorted(tuple(r) for r in df.collect())
    assert rows == [(2, "Rock"), (3, None), (5, "Folk")]   # a true null, not 'nan'
    assert df.dtypes == [("track_id", "int"), ("Genre", "string")]


def test_nth_position_errors():
    with pytest.raises(ValueError):
        delimited.nth_position(["a", "track"], "track", 2)


def _conn_csv(rows):
    return "".join(",".join(str(v) for v in r) + "\n" for r in rows)


def test_headerless_42_columns(spark, tmp_dir):
    rows = [[i] * 41 + ["normal"] for i in range(3)] + [[9] * 41 + ["smurf."]]
    p = _write(f"{tmp_dir}/connections.csv", _conn_csv(rows))
    types = ["double"] * 41 + ["string"]
    df = delimited.read_headerless(spark, p, CONN_NAMES, types)
    assert df.columns == CONN_NAMES and df.count() == 4
    inferred = delimited.read_headerless(spark, p, CONN_NAMES, infer=True)
    assert inferred.columns == CONN_NAMES and dict(inferred.dtypes)["x0"] == "int"


def test_null_feature_raises_or_skips(spark, tmp_dir):
    from tabfold.operators import features
    rows = [[1] * 41 + ["normal"], [""] + [2] * 40 + ["normal"]]
    p = _write(f"{tmp_dir}/connections.csv", _conn_csv(rows))
    df = delimited.read_headerless(spark, p, CONN_NAMES, ["double"] * 41 + ["string"])
    with pytest.raises(Exception):
        features.assemble(df, CONN_NAMES[:-1]).collect()
    assert features.assemble(df, CONN_NAMES[:-1], handle_invalid="skip").count() == 1


def test_header_bz2_and_safe_names(spark, tmp_dir):
    df = spark.createDataFrame([(1, 2.0, "Rock")], "`a.b.1` int, `c.d` double, Genre string")
    path = f"{tmp_dir}/mfa_wrangled.bz2"
    sinks.write_table(df, path, "csv", compression="bzip2", header=True)
    assert any(f.endswith(".bz2") for f in os.listdir(path))
    back = delimited.safe_names(delimited.read_with_header(spark, path, infer=True))
    assert back.columns == ["a_b_1", "c_d", "Genre"]
    assert tuple(back.first()) == (1, 2.0, "Rock")


def test_report_sink_partitioned_and_no_overwrite(spark, tmp_dir):
    rep = spark.createDataFrame([("Train accuracy", 1.0, "tree", 23), ("Test accuracy", 0.5, "tree", 23)],
                                "ValueType string, Value double, model string, seed int")
    out = f"{tmp_dir}/reports"
    sinks.write_report(rep, out, partition_by=("model", "seed"))
    assert os.path.isdir(f"{out}/model=tree/seed=23")
    with pytest.raises(Exception):
        sinks.write_report(rep, out, partition_by=("model", "seed"))
    back = spark.read.schema("ValueType string, Value double").csv(out)
    assert sorted((r.ValueType, r.Value, r.seed) for r in back.collect()) == [
        ("Test accuracy", 0.5, 23), ("Train accuracy", 1.0, 23)]
    # another run lands next to it; re-running a run replaces only its partition
    other = rep.withColumn("seed", F.lit(42))
    sinks.write_report(other, out, partition_by=("model", "seed"), mode="overwrite_partitions")
    sinks.write_report(other, out, partition_by=("model", "seed"), mode="overwrite_partitions")
    back = spark.read.schema("ValueType string, Value double").csv(out)
    assert back.count() == 4 and back.filter("seed = 42").count() == 2


def test_lines_with_header_every_file(spark, tmp_dir):
    lines = spark.range(0, 100, numPartitions=4).select(F.col("id").cast("string"))
    out = f"{tmp_dir}/lines"
    sinks.write_lines_with_header(lines, ["h1", "h2"], out)
    files = [f for f in os.listdir(out) if f.startswith("part-")]
    assert len(files) == 4
    for f in files:
        with open(f"{out}/{f}") as fh:
            assert fh.readline().strip() == "h1"


def test_parse_lines(spark):
    from pyspark.sql import types as T
    lines = spark.createDataFrame([("1,0.5,x",), ("2,,y",), ("3,1e3,z",)], "value string")
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.DoubleType()),
                           T.StructField("s", T.StringType())])
    rows = sorted(tuple(r) for r in delimited.parse_lines(lines, schema).collect())
    assert rows == [(1, 0.5, "x"), (2, None, "y"), (3, 1000.0, "z")]
