"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

Features of a text: hashed words (frequencies of ``HASHED`` slots, scaled to
unit length), structure statistics (shares of upper case, digits, symbols and
blanks, distinct-word and distinct-line shares, lengths) and the table's
``n_chars`` as metadata. The model adds to the linear terms a rank-``FACTORS``
interaction of every pair of features. Scoring takes time linear in the
features through

    sum over pairs <v_i, v_j> x_i x_j = 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2],

which is how Spark ML's factorisation machine computes it, for fitting and
for scoring. It is fitted on at most about ``train_rows`` labelled rows; all
rows are scored over their whole texts.
"""

from __future__ import annotations

from pyspark.ml.classification import FMClassificationModel, FMClassifier
from pyspark.ml.feature import HashingTF, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder

HASHED = 1 << 12
FACTORS = 4
TRAIN_ROWS = 6_000
ITERATIONS = 80
STEP = 0.05

STATISTICS = {
    "s_upper": "char_length(regexp_replace(_t, '[^A-Z]+', '')) / _len",
    "s_digit": "char_length(regexp_replace(_t, '[^0-9]+', '')) / _len",
    "s_symbol": r"char_length(regexp_replace(_t, r'[^!-/:-@\[-`{-~]+', '')) / _len",
    "s_words": "size(_words) / _len",
    "s_distinct": "size(array_distinct(_words)) / size(_words)",
    "s_lines": r"size(array_distinct(_lines)) / size(_lines)",
    "s_line": "least(size(_lines) / size(_words), 1D)",
    "s_length": "ln(1D + char_length(_t)) / 12",
    "m_chars": "ln(1D + greatest(coalesce(n_chars, 0), 0)) / 12",
}


def features(docs: DataFrame) -> DataFrame:
    """All given columns plus ``features``; null text is empty, null n_chars 0."""
    if "n_chars" not in docs.columns:
        docs = docs.withColumn("n_chars", F.lit(0))
    base = docs.withColumn("_t", F.coalesce("text", F.lit(""))).withColumns({
        "_words": F.split("_t", r"\s+"), "_lines": F.split("_t", "\n"),
        "_len": F.greatest(F.length("_t"), F.lit(1)).cast("double")})
    base = base.withColumns({k: F.expr(v) for k, v in STATISTICS.items()})
    hashed = HashingTF(numFeatures=HASHED, inputCol="_words", outputCol="_tf").transform(base)
    scaled = Normalizer(p=2.0, inputCol="_tf", outputCol="_unit").transform(hashed)
    out = VectorAssembler(inputCols=[*STATISTICS, "_unit"], outputCol="features",
                          handleInvalid="keep").transform(scaled)
    return out.drop("_t", "_words", "_lines", "_len", "_tf", "_unit", *STATISTICS)


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> FMClassificationModel | None:
    """Fit on rows with a label that aren't held out, a hash sample of about ``train_rows``.

    None if there are no such rows. An id in many rows counts once.
    """
    usable = labels.select("doc_id", F.col("quality").cast("double").alias("label")).filter(
        F.col("label").isin(0.0, 1.0) & F.col("doc_id").isNotNull()
        & (remainder(F.col("doc_id")) != 1))
    n = usable.count()
    if n == 0:
        return None
    if n > train_rows:
        share = int(train_rows / n * (1 << 32))
        usable = usable.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(23)),
                                      F.lit(1 << 32)) < share)
    usable = usable.groupBy("doc_id").agg(F.max("label").alias("label")).limit(2 * train_rows)
    columns = ["doc_id", "text"] + [c for c in docs.columns if c == "n_chars"]
    rows = docs.select(*columns).join(F.broadcast(usable), "doc_id")   # at most 2 x train_rows ids
    rows = rows.groupBy("doc_id", "label").agg(*[F.max(c).alias(c) for c in columns[1:]])
    data = features(rows).select("label", "features").coalesce(8).persist()
    try:
        if data.count() == 0:
            return None
        return FMClassifier(factorSize=FACTORS, maxIter=ITERATIONS, stepSize=STEP, regParam=1e-4,
                            initStd=0.05, seed=3, solver="adamW").fit(data)
    finally:
        data.unpersist()


def score(docs: DataFrame, model: FMClassificationModel | None) -> DataFrame:
    """One row per document row: doc_id, held_out, score, predicted.

    Without a model (nothing to learn from) every score is 0.5. Empty and null
    texts are scored by their features, like any other.
    """
    held = (remainder(F.col("doc_id")) == 1).alias("held_out")
    if model is None:
        return docs.select("doc_id", held, F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    columns = ["doc_id", "text"] + [c for c in docs.columns if c == "n_chars"]
    scored = model.transform(features(docs.select(*columns)).select("doc_id", "features"))
    value = F.element_at(vector_to_array("probability"), 2)
    return scored.select("doc_id", held, value.alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))
