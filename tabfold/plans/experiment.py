"""Composed experiments.

One prepared table (features assembled, indexers fitted, split column
attached) is persisted once and reused by every fit of a variant, seed or
fold; the reference re-parsed its input for every action.
"""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabfold.operators import counted as cn
from tabfold.operators import evaluate, features, models, sampling, weights


@dataclass
class Timer:
    """E5: wall-clock per phase, in minutes like the reference report."""
    phases: dict = field(default_factory=dict)

    def run(self, name, fn, *args, **kw):
        t0 = time.time()
        out = fn(*args, **kw)
        self.phases[name] = self.phases.get(name, 0.0) + (time.time() - t0) / 60.0
        return out

    @property
    def total(self) -> float:
        return sum(self.phases.values())


@dataclass
class Prepared:
    data: DataFrame
    label_model: object
    category_model: object
    feature_cols: list
    label_col: str
    known: dict = field(default_factory=dict)

    def rows_repeat(self) -> bool:
        """Whether equal rows are many (one sketch over the table, once)."""
        if "repeat" not in self.known:
            self.known["repeat"] = cn.rows_repeat(self.data, ["features", self.label_col])
        return self.known["repeat"]


def prepare(df: DataFrame, feature_cols: Sequence[str], label_col: str, keys: Sequence,
            seed=23, max_categories: int = 4, train_fraction: float = 0.7,
            fit_on: str = "all", persist: bool = True, handle_invalid: str = "error") -> Prepared:
    """Assemble (F1), split (K1b), index label (F2) and categories.

    ``fit_on='all'`` fits both indexers on every row, as the reference does
    (labels: deliberate; features: leakage). ``fit_on='train'`` fits them on
    train rows and keeps unseen values instead of failing.
    """
    cols = list(dict.fromkeys([*[k for k in keys if isinstance(k, str)], *feature_cols, label_col]))
    data = features.assemble(df.select(*cols), feature_cols, handle_invalid=handle_invalid)
    data = sampling.hash_split(data, keys, seed, train_fraction)
    named = [k for k in keys if isinstance(k, str) and k != label_col]
    data = data.select(*named, label_col, "features", "split")
    if persist:
        data = data.persist(StorageLevel.MEMORY_AND_DISK)
    fit_df = data if fit_on == "all" else data.filter(F.col("split") == "train")
    invalid = "error" if fit_on == "all" else "keep"
    label_model = features.fit_label_index(fit_df, label_col, handle_invalid=invalid)
    cat_model = features.fit_category_index(fit_df, "features", "indexedFeatures",
                                            max_categories, handle_invalid=invalid)
    return Prepared(data, label_model, cat_model, list(feature_cols), label_col)


def balanced(prep: Prepared, power: float = 1.0, out: str = "weight") -> Prepared:
    """``prep`` with the class weights of its train rows, for learners with ``weightCol=out``."""
    train = prep.data.filter(F.col("split") == "train")
    table = weights.class_weights(train, prep.label_col, power)
    return replace(prep, data=weights.with_class_weights(prep.data, prep.label_col, table, out))


def learner_for(name: str, **params):
    if name in ("logistic", "lasso"):
        # the reference trains logistic on the raw vector; it is trained and
        # evaluated on the same (indexed) label column here
        params.setdefault("features_col", "features")
    return models.LEARNERS[name](label_col="indexedLabel", **params)


def fit_and_score(prep: Prepared, learner, data: DataFrame | None = None,
                  category_model=None, split_col: str = "split", count_equal: bool = False,
                  counted: bool = False):
    """Fit on train rows, score every row once (train and test together).

    ``count_equal``: where equal rows are many, a tree learner is fitted on one of
    each with their number as its weight (``operators.counted``); its nodes' raw
    counts are then of distinct rows. ``counted``: the rows of ``data`` are such
    already, with their numbers in ``cn.WEIGHT``.
    """
    data = prep.data if data is None else data
    cat = prep.category_model if category_model is None else category_model
    train = data.filter(F.col(split_col) == "train")
    # the category indexer only runs when the learner reads its output
    # (the reference built it for logistic regression and never used it)
    uses_cat = learner.getOrDefault("featuresCol") == cat.getOrDefault("outputCol")
    before = [prep.label_model, cat] if uses_cat else [prep.label_model]
    if counted:
        model = models.fit([*before, cn.weighted(learner, train)], train)
    elif count_equal and cn.counts_rows(learner) and prep.rows_repeat():
        vector = cat.getOrDefault("inputCol") if uses_cat else learner.getOrDefault("featuresCol")
        with cn.counted_rows(train, [vector, prep.label_col], cn.weight_of(learner)) as rows:
            model = models.fit([*before, cn.weighted(learner)], rows)
    else:
        if cn.is_boosted(learner):
            train = cn.fewer_parts(train, len(prep.feature_cols))
        model = models.fit([*before, learner], train)
    scored = models.predict(model, data)
    scored = features.label_names(prep.label_model).transform(scored)
    return model, scored


def report(scored: DataFrame, spark: SparkSession, run_minutes: float | None = None,
           label_col: str = "indexedLabel") -> DataFrame:
    """The reference's 3-row report ``(ValueType, Value)``."""
    acc = {r["split"]: r["accuracy"] for r in
           evaluate.accuracy(scored, label_col=label_col).collect()}
    rows = [("Train accuracy", float(acc.get("train", float("nan")))),
            ("Test accuracy", float(acc.get("test", float("nan"))))]
    if run_minutes is not None:
        rows.append(("Run time", float(run_minutes)))
    schema = T.StructType([T.StructField("ValueType", T.StringType()),
                           T.StructField("Value", T.DoubleType())])
    return spark.createDataFrame(rows, schema)


def confusion_counts(scored: DataFrame, label_col: str) -> DataFrame:
    """``(split, label, prediction, n_rows)`` in the original label space."""
    ltype = scored.schema[label_col].dataType
    return (scored.groupBy("split", label_col,
                           F.col("predictedLabel").cast(ltype).alias("prediction"))
                  .agg(F.count(F.lit(1)).alias("n_rows")))


# ---------------------------------------------------------------- E6 variants

def variant_data(prep: Prepared, variant: str, k: int | None = None,
                 data: DataFrame | None = None, count_col: str | None = None):
    """Feature column for a variant: raw, scaled (F4), standardised (F5),
    pca (F5 then F7, as the single-machine notebook) or scaled_pca (F4 then
    F7, as the Spark job: no centring anywhere). Scaler and PCA are fitted on
    train rows only; the category indexer over their output is refitted on
    all rows. ``data`` stands in for the prepared table (features, split);
    ``count_col``: how many rows a row of it stands for (scalers, not PCA)."""
    from tabfold.operators import reduce as red
    data = prep.data if data is None else data
    train = data.filter(F.col("split") == "train")
    if variant == "raw":
        return data, prep.category_model
    if variant in ("scaled", "standardised", "pca", "scaled_pca"):
        with_mean = variant in ("standardised", "pca")
        if count_col is None:
            scaler = features.fit_scaler(train, "features", "normFeatures", with_mean=with_mean)
        elif variant in ("pca", "scaled_pca"):
            raise ValueError("PCA takes no counted rows")
        else:
            scaler = features.CountedScaler("features", "normFeatures", with_mean, count_col).fit(train)
        data = scaler.transform(data)
        col = "normFeatures"
        if variant in ("pca", "scaled_pca"):
            d = len(prep.feature_cols)
            pca = red.fit_pca(data.filter(F.col("split") == "train"), "normFeatures", "pca",
                              k or d)
            data = pca.transform(data)
            col = "pca"
        cat = features.fit_category_index(data, col, "indexedFeatures", 4)
        return data, cat
    raise ValueError(variant)


def variant_names(prep: Prepared, variant: str) -> list[str]:
    """Slot names of a variant's vector: scaling keeps the features, PCA makes components."""
    if variant in ("pca", "scaled_pca"):
        return [f"pc_{i + 1}" for i in range(len(prep.feature_cols))]
    return list(prep.feature_cols)


def variant_compare(prep: Prepared, variants: Sequence[str] = ("raw", "scaled", "standardised"),
                    learner: str = "gbt", **params) -> DataFrame:
    """The same learner and split over several preprocessing variants,
    one long table ``(variant, split, label, prediction, n_rows)``."""
    out = None
    for v in variants:
        data, cat = variant_data(prep, v)
        _, scored = fit_and_score(prep, learner_for(learner, **params), data, cat, count_equal=True)
        part = confusion_counts(scored, prep.label_col).withColumn("variant", F.lit(v))
        out = part if out is None else out.unionByName(part)
    return out


# ------------------------------------------------------------ E7 seed sweep

SWEEP_SEEDS = (1, 2, 3, 4, 5, 6, 7, 8, 23, 42)
SWEEP_SCHEMA = "model string, seed int, metric string, value double"


def seed_sweep(df: DataFrame, feature_cols: Sequence[str], label_col: str, keys: Sequence,
               learner: str = "tree", seeds: Sequence[int] = SWEEP_SEEDS,
               parallelism: int = 1, with_time: bool = False, **params) -> DataFrame:
    """One run per seed on one persisted table -> long table
    ``(model, seed, metric, value)`` with train/test accuracy and row counts.
    Seeds run concurrently on one session when ``parallelism`` > 1."""
    [(_, runs)] = seed_sweeps(df, feature_cols, label_col, keys, [learner], seeds, parallelism,
                              with_time, {learner: params})
    return runs


def seed_sweeps(df: DataFrame, feature_cols: Sequence[str], label_col: str, keys: Sequence,
                learners: Sequence[str], seeds: Sequence[int] = SWEEP_SEEDS, parallelism: int = 1,
                with_time: bool = False, params: dict[str, dict] | None = None,
                ) -> Iterator[tuple[str, DataFrame]]:
    """``seed_sweep`` of several learners on one table: each with its runs, as soon as they are over.

    Every row is hashed once for each seed, and its sides are kept as flags. Where a
    sketch finds that rows repeat, equal ones (features, label) are counted once for
    all seeds and learners, with the train rows of each seed; learners that only sum
    rows are fitted and scored on those, with the numbers as weights. ``params`` are a
    learner's own.
    """
    params = params or {}
    spark = df.sparkSession
    sides = [f"_train_{i}" for i in range(len(seeds))]
    # a learner's parameter may name a key (its weights)
    named = {v for own in params.values() for v in own.values() if isinstance(v, str)}
    used = [k for k in keys if isinstance(k, str) and k in named]
    rows = df
    for side, seed in zip(sides, seeds, strict=True):
        rows = sampling.hash_split(rows, keys, seed, out=side).withColumn(side, F.col(side) == "train")
    rows = rows.select(*dict.fromkeys([*used, *feature_cols, label_col]), *sides)
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    kept = [rows]
    made = {name: learner_for(name, **params.get(name, {})) for name in learners}
    whole = features.assemble(rows, feature_cols).select(
        *dict.fromkeys([*(k for k in used if k != label_col), label_col]), "features", *sides)

    def on_counts(name):
        return cn.sums_rows(made[name]) and cn.weight_of(made[name]) is None and base.rows_repeat()

    def one(name, i):
        t0 = time.time()
        train = F.col(sides[i])
        if on_counts(name):
            both = F.array(F.struct(F.lit("train").alias("split"), train.alias(cn.WEIGHT)),
                           F.struct(F.lit("test").alias("split"), (F.col(cn.COUNT) - train).alias(cn.WEIGHT)))
            data = counts.select(label_col, "features", F.inline(both)).filter(F.col(cn.WEIGHT) > 0)
            _, scored = fit_and_score(base, learner_for(name, **params.get(name, {})), data, counted=True)
            acc = evaluate.accuracy(scored, weight_col=cn.WEIGHT)
        else:
            data = whole.withColumn("split", F.when(train, "train").otherwise("test")).drop(*sides)
            _, scored = fit_and_score(base, learner_for(name, **params.get(name, {})), data,
                                      count_equal=True)
            acc = evaluate.accuracy(scored)
        out = []
        for r in acc.collect():
            side = r["split"]
            out.append((name, int(seeds[i]), f"{side}_accuracy", float(r["accuracy"])))
            out.append((name, int(seeds[i]), f"{side}_rows", float(r["n_rows"])))
        if with_time:
            out.append((name, int(seeds[i]), "run_minutes", (time.time() - t0) / 60.0))
        return out

    try:
        base = Prepared(whole, features.fit_label_index(rows, label_col), None, list(feature_cols), label_col)
        if any(cn.sums_rows(m) for m in made.values()):
            # once, before the threads ask
            base.known["repeat"] = cn.rows_repeat(rows, [*feature_cols, label_col])
        counts = None
        if any(on_counts(name) for name in learners):
            counts = rows.groupBy(*dict.fromkeys([*feature_cols, label_col])).agg(
                F.count(F.lit(1)).cast("double").alias(cn.COUNT),
                *[F.sum(F.col(c).cast("long")).cast("double").alias(c) for c in sides])
            counts = cn.merged(features.assemble(counts, feature_cols).select(
                label_col, "features", cn.COUNT, *sides))
            kept.append(counts)
            if all(on_counts(name) for name in learners):
                rows.unpersist()
        # equal rows have equal categories
        base.category_model = features.fit_category_index(whole if counts is None else counts)
        with ThreadPoolExecutor(max(1, parallelism)) as pool:
            for name in learners:
                parts = list(pool.map(one, [name] * len(seeds), range(len(seeds))))
                yield name, spark.createDataFrame([r for p in parts for r in p], SWEEP_SCHEMA)
    finally:
        for table in kept:
            table.unpersist()


# ---------------------------------------------------------- E3 cross-validation

CV_SCHEMA = "variant string, fit_per_fold boolean, repeat int, fold int, n_rows long, balanced_accuracy double"


def cross_validate(prep: Prepared, learner: str = "tree", n_folds: int = 10, n_repeats: int = 3,
                   seed=1, keys: Sequence[str] = (), parallelism: int = 4,
                   variant: str = "raw", fit_per_fold: bool = False,
                   partition_rows: int = 1 << 17, collapse: bool | None = False, balance: float = 0.0,
                   **params) -> DataFrame:
    """Repeated stratified k-fold over the train rows, balanced accuracy
    per held-out fold -> ``(repeat, fold, n_rows, balanced_accuracy)``.

    Fold assignment is K3 (exact, skew-safe). Fits are independent Spark jobs
    run by a bounded thread pool on one session; an error fails the call.
    The scaler and PCA of a ``variant`` are fitted once on all train rows, as
    the reference does; ``fit_per_fold`` fits them without the held-out fold.
    A boosted fit is many short passes, so the cached folds are merged to
    partitions of about ``partition_rows`` rows (only counted ones ever to more).
    ``collapse`` counts equal rows (features, label) of a fold once and fits and
    scores with the counts as weights: the same sums over fewer rows, worth a
    shuffle where features take few values. True is for the raw variant; None
    does it, scalers included, wherever a sketch finds that rows repeat and the
    learner sums rows (no PCA, no linear learner).
    ``balance`` is the power of the class weights of a fit's own rows (0: none, 1:
    every class weighs the same); held-out rows are scored as they are.
    """
    return cross_validate_variants(
        prep, [(variant, fit_per_fold)], learner, n_folds, n_repeats, seed, keys, parallelism,
        partition_rows, collapse, balance, **params).drop("variant", "fit_per_fold")


def cross_validate_variants(prep: Prepared, variants: Sequence[tuple[str, bool]], learner: str = "tree",
                            n_folds: int = 10, n_repeats: int = 3, seed=1, keys: Sequence[str] = (),
                            parallelism: int = 4, partition_rows: int = 1 << 17,
                            collapse: bool | None = False, balance: float = 0.0, **params) -> DataFrame:
    """``cross_validate`` of several ``(variant, fit_per_fold)`` on the same folds.

    The folds of a repeat are ranked once for all variants, which add ``variant``
    and ``fit_per_fold`` to the result's columns.
    """
    if collapse and any(v != "raw" for v, _ in variants):
        raise ValueError("collapsed rows go with the raw variant")
    if collapse is None:
        collapse = (all(v in ("raw", "scaled", "standardised") for v, _ in variants)
                    and cn.counts_rows(learner_for(learner, **params)) and prep.rows_repeat())
    train = prep.data.filter(F.col("split") == "train")
    label_idx = prep.label_model.transform(train)
    n_partitions = 0 if collapse else -(-train.count() // partition_rows) or 1
    spark = train.sparkSession
    if collapse:
        params["weightCol"] = "weight"

    def folds_of(r):
        folds = sampling.stratified_folds(label_idx, list(keys), prep.label_col, n_folds,
                                          1, seed, keep=["features", "indexedLabel"],
                                          repeat_ids=[r])
        if not collapse:
            return folds.coalesce(n_partitions).persist(StorageLevel.MEMORY_AND_DISK)
        return cn.cut(cn.merged(folds.groupBy("fold", "features", "indexedLabel")
                                .agg(F.count("*").cast("double").alias("weight")), partition_rows))

    def seen(folds, variant, is_train):
        return variant_data(prep, variant, data=folds.withColumn(
            "split", F.when(is_train, "train").otherwise("test")),
            count_col="weight" if collapse else None)

    def one(run):
        folds, r, variant, fit_per_fold, shared, f = run
        data, category = shared or seen(folds, variant, F.col("fold") != f)
        fit_rows = data.filter(F.col("fold") != f)
        held = data.filter(F.col("fold") == f)
        own = dict(params)
        if balance:
            table = weights.class_weights(fit_rows, "indexedLabel", balance,
                                          "weight" if collapse else None)
            fit_rows = weights.with_class_weights(fit_rows, "indexedLabel", table, "class_weight")
            if collapse:
                fit_rows = fit_rows.withColumn("class_weight", F.col("class_weight") * F.col("weight"))
            own["weightCol"] = "class_weight"
        model = models.fit([category, learner_for(learner, **own)], fit_rows)
        scored = models.predict(model, held)
        row = evaluate.balanced_accuracy(
            scored, by=(), weight_col="weight" if collapse else None).first()
        return (variant, fit_per_fold, int(r), int(f), int(row["n_rows"]),
                float(row["balanced_accuracy"]))

    rows = []
    # folds that aren't counted: one repeat cached at a time, so that the peak is the train
    # rows, not repeats x rows; counted ones lie in the checkpoint folder and are fitted together
    for batch in [range(n_repeats)] if collapse else [[r] for r in range(n_repeats)]:
        kept, runs = [], []
        try:
            for r in batch:
                kept.append(folds := folds_of(r))
                for variant, fit_per_fold in variants:
                    shared = None if fit_per_fold else seen(folds, variant, F.lit(True))
                    runs += [(folds, r, variant, fit_per_fold, shared, f) for f in range(n_folds)]
            with ThreadPoolExecutor(max(1, parallelism)) as pool:
                rows += list(pool.map(one, runs))
        finally:
            for folds in kept:
                folds.unpersist()
    return spark.createDataFrame(rows, CV_SCHEMA)
