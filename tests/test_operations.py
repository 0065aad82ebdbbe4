"""Resumed sweeps, rejected lines, class weights: against brute force."""

import csv
import glob
import os

import pytest
from pyspark.sql import functions as F

from tabfold.operators import models, softmax, weights
from tabfold.plans import experiment as ex
from tabfold.plans import ledger
from tabfold.sources import delimited, rejects

# ------------------------------------------------------------ E7


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(400).select(
        F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("a"),
        (F.col("id") % 11).cast("double").alias("b"),
        ((F.col("id") % 7 > 3) != (F.col("id") % 13 == 0)).cast("int").alias("label"))


SEEDS = (1, 2, 3, 4, 5, 6, 7, 8, 23, 42)


def _sweep(rows, path, attempt, seeds=SEEDS, **more):
    out = ledger.resumable_sweep(rows, ["a", "b"], "label", ["k"], path, seeds=seeds, attempt=attempt, **more)
    return {(r["model"], r["seed"], r["metric"]): (r["value"], r["attempt"]) for r in out.collect()}


def test_a_killed_sweep_fits_only_the_rest(spark, rows, tmp_dir, monkeypatch):
    path = f"{tmp_dir}/ledger"
    fit, seen = ex.fit_and_score, []

    def dies_at_the_fifth(*args, **kw):
        seen.append(1)
        if len(seen) == 5:
            raise RuntimeError("executor lost")
        return fit(*args, **kw)

    monkeypatch.setattr(ex, "fit_and_score", dies_at_the_fifth)
    with pytest.raises(RuntimeError, match="executor lost"):
        _sweep(rows, path, "first")
    assert ledger.finished(ledger.recorded(spark, path)).count() == 4
    seen.clear()
    monkeypatch.setattr(ex, "fit_and_score", lambda *a, **k: (seen.append(1), fit(*a, **k))[1])
    got = _sweep(rows, path, "second")
    assert len(seen) == 6
    assert {s for (_, s, _), (_, a) in got.items() if a == "first"} == set(SEEDS[:4])
    whole = ex.seed_sweep(rows, ["a", "b"], "label", ["k"]).collect()
    assert {k: v for k, (v, _) in got.items()} == {(r["model"], r["seed"], r["metric"]): r["value"] for r in whole}
    seen.clear()
    assert _sweep(rows, path, "third") == got and not seen


def test_half_written_runs_and_other_settings(spark, rows, tmp_dir):
    path = f"{tmp_dir}/ledger"
    got = _sweep(rows, path, "first", (1, 2, 2), parallelism=3)
    assert {s for _, s, _ in got} == {1, 2}
    # a run of which only some rows arrived is no run
    part = ledger.recorded(spark, path).filter("seed = 2 AND metric LIKE 'train%'").collect()
    (spark.createDataFrame(part, ledger.SCHEMA).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("setting", "model", "seed").parquet(path))
    again = _sweep(rows, path, "second", (1, 2))
    assert {k: v for k, (v, _) in again.items()} == {k: v for k, (v, _) in got.items()}
    assert {s: a for (_, s, _), (_, a) in again.items()} == {1: "first", 2: "second"}
    # other parameters, other rows: nothing is shared
    other = _sweep(rows, path, "third", (1,), params={"tree": {"maxDepth": 1}})
    assert {a for _, a in other.values()} == {"third"}
    fewer = _sweep(rows.filter("k <> 5"), path, "fourth", (1,))
    assert {a for _, a in fewer.values()} == {"fourth"}
    assert _sweep(rows.repartition(7), path, "fifth", (1,)) == {k: v for k, v in again.items() if k[1] == 1}


# ------------------------------------------------------------ S4 / S6

HEAD = ["feature,x,x", "statistics,mean,std", "number,01,01", "track_id,,"]
BODY = ["1,2.5,3", "2,abc,4", "", "   ", "x3,1,2", "4,1", "5,1,2,3", '"6","7","8"', "7,,", ",1,2", "8,1e3, 9 ",
        "99999999999999999999,1,2", "9,NaN,2", "1,2.5,3", "10,a,b"]


def _files(tmp_dir, ending="\n"):
    for f in range(3):
        body = [BODY[(i + f) % len(BODY)] for i in range(40 + 30 * f)]
        with open(f"{tmp_dir}/part{f}.csv", "w", newline="") as out:
            out.write(ending.join(HEAD + body) + ending)


def _judge(line, strict):
    if line in HEAD:
        return "header"
    if not line.strip():
        return "blank"
    cells = next(csv.reader([line]))
    try:
        assert abs(int(cells[0])) < 2 ** 63
    except (ValueError, AssertionError):
        return "bad key"
    if strict and len(cells) != 3:
        return "width"

    def bad(c):
        try:
            return bool(c.strip()) and float(c) is None
        except ValueError:
            return True
    return "bad cell" if strict and any(map(bad, cells[1:3])) else None


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_every_line_has_its_number_and_reason(spark, tmp_dir, strict, ending):
    _files(tmp_dir, ending)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")     # several splits a file
    try:
        read = rejects.ingest_multi_header(spark, tmp_dir, strict=strict)
        got = sorted((os.path.basename(r["file"]), r["line_no"], r["line"], r["reason"])
                     for r in read.lines.collect())
        n_blocks = spark.read.text(tmp_dir).select(
            "_metadata.file_path", "_metadata.file_block_start").distinct().count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert n_blocks > 6
    want = []
    for path in glob.glob(f"{tmp_dir}/*.csv"):
        with open(path, newline="") as f:
            lines = f.read().split(ending)[:-1]
        want += [(os.path.basename(path), i, x, _judge(x, strict)) for i, x in enumerate(lines, 1)]
    assert got == sorted(want, key=lambda r: r[:2])
    account = {}
    for r in read.account().collect():
        account[r["reason"]] = account.get(r["reason"], 0) + r["n_lines"]
    assert sum(account.values()) == len(want)
    assert account["good"] == read.good().count() and account["header"] == 12
    assert read.rejected().count() == len(want) - account["good"] - 12


def test_good_rows_are_those_of_the_plain_reader(spark, tmp_dir):
    _files(tmp_dir)
    good = rejects.ingest_multi_header(spark, tmp_dir).good()
    plain = delimited.read_multi_header(spark, tmp_dir)
    assert good.columns == plain.columns
    assert sorted(map(str, good.collect())) == sorted(map(str, plain.collect()))


def test_a_file_of_headers_only(spark, tmp_dir):
    with open(f"{tmp_dir}/a.csv", "w") as out:
        out.write("\n".join(HEAD) + "\n")
    read = rejects.ingest_multi_header(spark, tmp_dir)
    assert read.good().count() == 0 and read.rejected().count() == 0
    assert [(r["reason"], r["n_lines"]) for r in read.account().collect()] == [("header", 4)]


# ------------------------------------------------------------ class weights

def test_weights_balance_the_classes(spark):
    df = spark.createDataFrame([("a",)] * 90 + [("b",)] * 9 + [("c",)] + [(None,)] * 5, "y string")
    table = {r["y"]: (r["n_rows"], r["weight"]) for r in weights.class_weights(df, "y").collect()}
    assert table == {"a": (90, pytest.approx(100 / 270)), "b": (9, pytest.approx(100 / 27)),
                     "c": (1, pytest.approx(100 / 3))}
    out = weights.with_class_weights(df, "y")
    assert out.count() == 105 and out.filter("y IS NULL").agg(F.sum("weight")).first()[0] == 0
    assert out.agg(F.sum("weight")).first()[0] == pytest.approx(100)
    even = weights.class_weights(df, "y", power=0).collect()
    assert {r["weight"] for r in even} == {1.0}
    counted = weights.class_weights(df.groupBy("y").agg(F.count("*").alias("n")), "y", count_col="n")
    assert {r["y"]: (r["n_rows"], r["weight"]) for r in counted.collect()} == table
    # a class that the weights' rows lack
    seen = weights.class_weights(df.filter("y <> 'c'"), "y")
    assert weights.with_class_weights(df, "y", seen).filter("y = 'c'").first()["weight"] == 0
    with pytest.raises(ValueError):
        weights.with_class_weights(df.withColumn("weight", F.lit(1)), "y")
    assert weights.with_class_weights(df.limit(0), "y").count() == 0


@pytest.fixture(scope="module")
def rare(spark):
    """One row in a hundred is of class 1, a fifth of those with a = 9."""
    df = spark.range(4000).select(
        F.col("id").alias("k"), (F.col("id") % 20).cast("double").alias("a"),
        F.when((F.col("id") % 20 == 9) & (F.col("id") % 100 < 20), 1).when(F.col("id") % 20 < 5, 2)
        .otherwise(0).alias("label"))
    return ex.prepare(df, ["a"], "label", ["k"])


@pytest.mark.parametrize("learner", ["ovr_gbt", "softmax", "tree"])
def test_cross_validation_with_balanced_classes(rare, learner):
    more = {} if learner == "tree" else {"max_iter": 2}

    def mean(**kw):
        rows = ex.cross_validate(rare, learner, 3, 1, keys=["k"], **more, **kw).collect()
        return sorted((r["fold"], r["n_rows"], round(r["balanced_accuracy"], 9)) for r in rows)

    plain, balanced = mean(), mean(balance=1.0)
    assert all(b > p + 0.2 for (_, _, p), (_, _, b) in zip(plain, balanced, strict=True))
    if learner != "ovr_gbt":
        assert mean(balance=1.0, collapse=True) == balanced


def test_softmax_counts_weights_as_rows(rare):
    data = rare.category_model.transform(rare.label_model.transform(rare.data))
    train = data.filter("split = 'train'")
    counted = train.groupBy("indexedFeatures", "indexedLabel").agg(F.count("*").cast("double").alias("n"))
    one = softmax.fit(train, n_rounds=3)
    two = softmax.fit(counted, n_rounds=3, weight_col="n")
    stage = models.fit([models.LEARNERS["softmax"](max_iter=3)], train)

    def shares(m):
        return {r["k"]: r["probability"] for r in m.transform(data).select("k", "probability").collect()}
    want = shares(one)
    for got in (shares(two), shares(stage)):
        assert all(got[k] == pytest.approx(p, abs=1e-9) for k, p in want.items())
