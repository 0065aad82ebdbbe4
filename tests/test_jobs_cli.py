"""The job CLI on a headerless connection-style CSV (S1 + E8)."""

import os
import random

from tabfold.plans import jobs


def _write_connections(path, n=600, seed=3):
    rnd = random.Random(seed)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        for _ in range(n):
            row = [rnd.randint(0, 3) for _ in range(41)]
            label = "normal" if row[0] >= 2 else ("smurf." if row[1] >= 2 else "neptune.")
            fh.write(",".join(map(str, row)) + "," + label + "\n")
    return path


def test_cli_boosted_variants_on_bzip2(spark, tmp_dir):
    import bz2
    rnd = random.Random(5)
    rows = [(rnd.randint(0, 9), rnd.randint(0, 9), rnd.randint(0, 2)) for _ in range(400)]
    with bz2.open(f"{tmp_dir}/in.csv.bz2", "wt") as f:
        f.write("a.x,b.y,Genre\n")
        for a, b, g in rows:
            f.write(f"{a},{b},{'Electronic' if g == 0 else 'Rock' if a > 4 else 'Experimental'}\n")
    jobs.main([f"{tmp_dir}/in.csv.bz2", f"{tmp_dir}/out", "7", "--model", "gbt", "--header",
               "--label", "Genre", "--classes", "Rock,Experimental", "--positive", "Rock",
               "--variants", "raw,scaled"])
    back = spark.read.schema("ValueType string, Value double").csv(f"{tmp_dir}/out").collect()
    vals = {(r.variant, r.ValueType): r.Value for r in back}
    assert len(vals) == 6 and all(vals[v, "Test accuracy"] == 1.0 for v in ("raw", "scaled"))


def test_cli_tree_and_binary_logistic(spark, tmp_dir):
    data = _write_connections(f"{tmp_dir}/in/connections.csv")
    jobs.main([data, f"{tmp_dir}/out", "23", "--model", "tree", "--csv"])
    jobs.main([data, f"{tmp_dir}/out", "23", "--model", "logistic", "--csv", "--binary"])
    back = spark.read.schema("ValueType string, Value double").csv(f"{tmp_dir}/out")
    vals = {(r.model, r.ValueType): r.Value for r in back.collect()}
    assert vals[("tree", "Test accuracy")] == 1.0 and vals[("logistic", "Test accuracy")] == 1.0
    assert vals[("tree", "Run time")] > 0
    assert {r.seed for r in back.select("seed").distinct().collect()} == {23}
