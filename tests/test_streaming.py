"""A fitted pipeline scores a file stream; running counts match batch."""

from pyspark.sql import functions as F

from tabfold.plans import catalog as C
from tabfold.plans import experiment as ex
from tabfold.streaming import score_stream, streaming_confusion
from conftest import SF0001


def test_stream_scoring_matches_batch(spark, tmp_dir):
    li = spark.read.parquet(f"{SF0001}/lineitem.parquet")
    prep = ex.prepare(li.withColumn("label", F.expr(C.RULE_TREE)), C.LI_FEATURES, "label", C.LI_KEYS, 23)
    model, scored = ex.fit_and_score(prep, ex.learner_for("tree"))
    src = f"{tmp_dir}/in"
    prep.data.drop("split").write.parquet(src)
    stream = spark.readStream.schema(prep.data.drop("split").schema).parquet(src)
    counts = streaming_confusion(score_stream(model, stream))
    q = (counts.writeStream.outputMode("complete").format("memory").queryName("cm_stream")
         .option("checkpointLocation", f"{tmp_dir}/ckpt").start())
    q.processAllAvailable()
    q.stop()
    got = {(r.indexedLabel, r.prediction): r.n for r in spark.sql("SELECT * FROM cm_stream").collect()}
    want = {(r.indexedLabel, r.prediction): r["count"] for r in
            scored.groupBy("indexedLabel", "prediction").count().collect()}
    assert got == want
