"""Registered queries that check fitted models against a second fit in plain SQL.

The oracles here don't repeat what the planted rule says: they learn the tree
level by level, run Newton's method, or rotate the covariance to a diagonal
in DuckDB, and so know what the learner must have found on data that no
learner fits exactly.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabfold.operators import (
    counted, features, foldwise, model_sql, optimality, reduce as red, sampling, softmax,
)
from tabfold.plans import catalog as C
from tabfold.plans import experiment as ex

_HUNDREDTHS = "CAST(round({} * 100, 0) AS INTEGER)"
# an oblique border, which axis-parallel splits of depth 5 can't follow, and noise
OBLIQUE = (f"CAST(CASE WHEN 10 * l_linenumber + 4 * {_HUNDREDTHS.format('l_discount')} "
           f"+ 3 * {_HUNDREDTHS.format('l_tax')} > 72 THEN 1 ELSE 0 END AS INTEGER)")
LABEL = C._noisy(OBLIQUE)
DEPTH = 5


def _prepared(spark, d, rule=LABEL):
    return C._planted_prep(spark, d, rule)


# ------------------------------------------------------------ M1 / M7 / E4

def _fitted(prep, learner, count_equal=False, **params):
    model, _ = ex.fit_and_score(prep, ex.learner_for(learner, **params), count_equal=count_equal)
    return model


def q_tree_nodes(spark, d):
    """M1, M8: every node of the fitted tree."""
    prep = _prepared(spark, d)
    nodes = model_sql.node_table(spark, _fitted(prep, "tree"))
    labels = F.array(*[F.lit(int(v)) for v in prep.label_model.labels])
    prep.data.unpersist()
    return nodes.select(
        "node", F.when(F.col("feature").isNotNull(), F.element_at(
            F.array(*[F.lit(c) for c in C.LI_FEATURES]), F.col("feature") + 1)).alias("feature"),
        C._r("threshold").alias("threshold"), "left", "right",
        F.element_at(labels, F.col("prediction").cast("int") + 1).alias("prediction"),
        C._r("impurity").alias("impurity"), C._r("gain").alias("gain"), "n_rows")


def q_tree_sql_scores(spark, d):
    """M7: every row's prediction by the model and by the SQL compiled from its nodes."""
    prep = _prepared(spark, d)
    model, scored = ex.fit_and_score(prep, ex.learner_for("tree"))
    sql = model_sql.prediction_sql(spark, model, C.LI_FEATURES, prep.label_model.labels)
    keys = list(C.LI_KEYS)
    # the prepared table has the features as a vector; their columns come back out of it
    from pyspark.ml.functions import vector_to_array
    flat = scored.withColumn("x", vector_to_array("features")).select(
        *keys, "split", "label", F.col("predictedLabel").cast("int").alias("prediction"),
        *[F.col("x")[i].alias(f"x{i}") for i in range(len(C.LI_FEATURES))])
    for i, c in enumerate(C.LI_FEATURES):
        sql = sql.replace(f"CAST({c} AS DOUBLE)", f"x{i}")
    return flat.select(*keys, "split", "label", "prediction",
                       F.expr(sql).cast("int").alias("sql_prediction"))


SQL_LEARNERS = (("gbt", {"max_iter": 5}), ("logistic", {}), ("lasso", {"reg_param": 0.02}))


def q_model_sql_agrees(spark, d):
    """M2-M4, M7: rows that the model and its SQL score alike, per learner and split."""
    prep = _prepared(spark, d)
    li = C._t(spark, d, "lineitem", spread=True)
    out = None
    for name, params in SQL_LEARNERS:
        model = _fitted(prep, name, count_equal=True, **params)
        sql = model_sql.prediction_sql(spark, model, C.LI_FEATURES, prep.label_model.labels)
        part = _compare(prep, li, model, sql).withColumn("learner", F.lit(name))
        out = part if out is None else out.unionByName(part)
    bands = _prepared(spark, d, C.NOISY_BANDS)
    model = _fitted(bands, "ovr_gbt", count_equal=True, max_iter=3, parallelism=3)
    sql = model_sql.prediction_sql(spark, model, C.LI_FEATURES, bands.label_model.labels)
    return out.unionByName(_compare(bands, li, model, sql).withColumn("learner", F.lit("ovr_gbt")))


def _compare(prep, li, model, sql):
    """Counts per split; the SQL reads the raw columns, the model the assembled vector."""
    from tabfold.operators import models
    raw = features.assemble(sampling.hash_split(li, C.LI_KEYS, C.SEED), C.LI_FEATURES)
    scored = features.label_names(prep.label_model).transform(models.predict(
        model, raw.withColumn("label", F.lit(int(prep.label_model.labels[0])))))
    return scored.groupBy("split").agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("predictedLabel") == F.expr(sql)).alias("n_equal"))


SQL_MODEL_SQL_AGREES = " UNION ALL ".join(
    f"SELECT '{name}' AS learner, split, count(*) AS n_rows, count(*) AS n_equal FROM ("
    f"SELECT {C._sql_split(C.LI_KEYS, C.SEED)} AS split FROM lineitem) t GROUP BY split"
    for name in [n for n, _ in SQL_LEARNERS] + ["ovr_gbt"])


def q_tree_gain(spark, d):
    """Unnormalised importances, the sum of gain x rows per feature."""
    prep = _prepared(spark, d)
    gains = model_sql.raw_gain(model_sql.node_table(spark, _fitted(prep, "tree")), C.LI_FEATURES)
    prep.data.unpersist()
    return gains.withColumn("gain", C._r("gain"))


def _sql_learned_tree(depth: int = DEPTH) -> str:
    """CTEs that learn a gini tree as Spark ML does: ``rows``, ``node`` and ``kept`` splits.

    Splits lie half-way between neighbouring values of the train rows; of equal
    gains the first feature and the lowest threshold win; a split whose sides
    end in leaves of one prediction is taken back.
    """
    names = C.LI_FEATURES
    listed = ", ".join(f"CAST({c} AS DOUBLE) AS f{j}" for j, c in enumerate(names))
    cols = ", ".join(f"f{j}" for j in range(len(names)))
    ctes = [
        f"rows AS (SELECT {', '.join(C.LI_KEYS)}, {listed}, {LABEL} AS y, "
        f"{C._sql_split(C.LI_KEYS, C.SEED)} AS split FROM lineitem)",
        f"a0 AS MATERIALIZED (SELECT {cols}, 1::BIGINT AS node, "
        f"count(*) FILTER (split = 'train' AND y = 0)::DOUBLE AS c0, "
        f"count(*) FILTER (split = 'train' AND y = 1)::DOUBLE AS c1 FROM rows GROUP BY {cols})",
        "vals AS MATERIALIZED (SELECT j, v, (v + lead(v) OVER (PARTITION BY j ORDER BY v)) / 2 AS thr FROM ("
        + " UNION ".join(f"SELECT {j} AS j, f{j} AS v FROM rows WHERE split = 'train'"
                         for j in range(len(names))) + "))",
    ]
    gini = "(1 - ({0} / ({0} + {1})) * ({0} / ({0} + {1})) - ({1} / ({0} + {1})) * ({1} / ({0} + {1})))"
    for k in range(depth):
        long = " UNION ALL ".join(f"SELECT node, {j} AS j, f{j} AS v, c0, c1 FROM a{k}"
                                  for j in range(len(names)))
        ctes += [
            f"n{k} AS MATERIALIZED (SELECT node, sum(c0) AS t0, sum(c1) AS t1 FROM a{k} GROUP BY node "
            f"HAVING sum(c0) + sum(c1) > 0)",
            f"h{k} AS (SELECT n{k}.*, vals.j, vals.v, thr, coalesce(x.c0, 0) AS c0, coalesce(x.c1, 0) AS c1 "
            f"FROM n{k} CROSS JOIN vals LEFT JOIN (SELECT node, j, v, sum(c0) AS c0, sum(c1) AS c1 "
            f"FROM ({long}) GROUP BY node, j, v) x ON x.node = n{k}.node AND x.j = vals.j AND x.v = vals.v)",
            f"s{k} AS (SELECT *, sum(c0) OVER w AS l0, sum(c1) OVER w AS l1 FROM h{k} "
            f"WINDOW w AS (PARTITION BY node, j ORDER BY v))",
            f"g{k} AS (SELECT *, {gini.format('t0', 't1')} "
            f"- (l0 + l1) / (t0 + t1) * {gini.format('l0', 'l1')} "
            f"- (t0 + t1 - l0 - l1) / (t0 + t1) * {gini.format('(t0 - l0)', '(t1 - l1)')} AS gain "
            f"FROM s{k} WHERE thr IS NOT NULL AND l0 + l1 > 0 AND l0 + l1 < t0 + t1)",
            f"b{k} AS MATERIALIZED (SELECT node, j, thr, gain, t0, t1 FROM (SELECT *, row_number() OVER ("
            f"PARTITION BY node ORDER BY gain DESC, j, thr) AS r FROM g{k}) "
            f"WHERE r = 1 AND gain > 0 AND node >= {2 ** k})",
            f"a{k + 1} AS MATERIALIZED (SELECT {cols}, c0, c1, CASE WHEN b.node IS NULL THEN a.node "
            f"ELSE 2 * a.node + CASE WHEN (CASE b.j {' '.join(f'WHEN {j} THEN f{j}' for j in range(len(names)))} "
            f"END) <= b.thr THEN 0 ELSE 1 END END AS node FROM a{k} a LEFT JOIN b{k} b ON a.node = b.node)",
        ]
    ctes.append("most AS (SELECT CASE WHEN sum(c1) > sum(c0) THEN 1 ELSE 0 END AS y FROM "
                "(SELECT count(*) FILTER (y = 0) AS c0, count(*) FILTER (y = 1) AS c1 FROM rows))")
    ctes.append("node AS MATERIALIZED (SELECT node, t0, t1, CASE WHEN t1 > t0 THEN 1 WHEN t0 > t1 THEN 0 "
                "ELSE (SELECT y FROM most) END AS y FROM ("
                + " UNION ".join(f"SELECT node, t0, t1 FROM n{k}" for k in range(depth))
                + f" UNION SELECT node, sum(c0), sum(c1) FROM a{depth} GROUP BY node "
                  f"HAVING sum(c0) + sum(c1) > 0))")
    for k in range(depth - 1, -1, -1):
        below = f"(SELECT node FROM k{k + 1})" if k < depth - 1 else "(SELECT -1)"
        ctes.append(
            f"k{k} AS MATERIALIZED (SELECT b.* FROM b{k} b JOIN node l ON l.node = 2 * b.node "
            f"JOIN node r ON r.node = 2 * b.node + 1 WHERE l.y <> r.y OR 2 * b.node IN {below} "
            f"OR 2 * b.node + 1 IN {below})")
    ctes.append("kept AS (" + " UNION ALL ".join(f"SELECT * FROM k{k}" for k in range(depth)) + ")")
    return "WITH " + ",\n ".join(ctes) + "\n"


def _case_names(j: str) -> str:
    return f"CASE {j} " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(C.LI_FEATURES)) + " END"


SQL_TREE_NODES = _sql_learned_tree() + f"""
SELECT n.node, {_case_names("k.j")} AS feature, round(k.thr, 9) AS threshold,
       CASE WHEN k.node IS NOT NULL THEN 2 * n.node END AS "left",
       CASE WHEN k.node IS NOT NULL THEN 2 * n.node + 1 END AS "right", n.y AS prediction,
       round(1 - (n.t0 / (n.t0 + n.t1)) * (n.t0 / (n.t0 + n.t1))
               - (n.t1 / (n.t0 + n.t1)) * (n.t1 / (n.t0 + n.t1)), 9) AS impurity,
       round(k.gain, 9) AS gain, CAST(n.t0 + n.t1 AS BIGINT) AS n_rows
FROM node n LEFT JOIN kept k ON k.node = n.node
WHERE n.node = 1 OR n.node // 2 IN (SELECT node FROM kept)"""

SQL_TREE_SQL_SCORES = _sql_learned_tree() + f"""
SELECT {', '.join(C.LI_KEYS)}, split, rows.y AS label, n.y AS prediction, n.y AS sql_prediction
FROM rows JOIN a{DEPTH} a USING ({', '.join(f'f{j}' for j in range(len(C.LI_FEATURES)))})
     JOIN node n ON n.node = a.node"""

SQL_TREE_GAIN = _sql_learned_tree() + f"""
SELECT v.c AS feature, count(k.node) AS n_splits, round(coalesce(sum(gain * (t0 + t1)), 0), 9) AS gain
FROM (VALUES {', '.join(f"({j}, '{c}')" for j, c in enumerate(C.LI_FEATURES))}) v(j, c)
     LEFT JOIN kept k ON k.j = v.j GROUP BY v.c"""


# ------------------------------------------------------------ M2, M3

LASSO = 0.08
# what the L1 penalty leaves of the features, with their signs (towards label 1)
LASSO_SIGNS = {"l_linenumber": 1, "l_discount": 1}
NEWTON_STEPS = 12


def _certificate(spark, d, learner, **params):
    prep = _prepared(spark, d)
    model = _fitted(prep, learner, tol=1e-14, maxIter=500, **params)
    train = prep.label_model.transform(prep.data.filter("split = 'train'"))
    found = optimality.certificate(train, model, C.LI_FEATURES).select(
        "feature", *[(F.round(c, 5) + F.lit(0.0)).alias(c)
                     for c in ("coefficient", "std", "gradient", "slope")], "optimal")
    prep.data.unpersist()
    return found


def q_logit_certificate(spark, d):
    """M2: coefficients on labels that no plane separates, with their gradients."""
    return _certificate(spark, d, "logistic")


def q_lasso_certificate(spark, d):
    """M3: the coefficients that the L1 penalty leaves, and the bounds that hold for the others."""
    return _certificate(spark, d, "lasso", reg_param=LASSO)


def _sql_solved(n: int, source: str) -> str:
    """Gaussian elimination of the n x n system a{i}{j} x{j} = g{i}, as nested SELECTs."""
    sql = source
    for k in range(n):
        rows = [f"a{i}{j} - a{i}{k} / a{k}{k} * a{k}{j} AS a{i}{j}" for i in range(n) if i != k
                for j in range(k + 1, n)]
        rows += [f"g{i} - a{i}{k} / a{k}{k} * g{k} AS g{i}" for i in range(n) if i != k]
        gone = {r.rsplit(" AS ", 1)[1] for r in rows}
        sql = f"SELECT * EXCLUDE ({', '.join(sorted(gone))}), {', '.join(rows)} FROM ({sql})"
    return f"SELECT {', '.join(f'g{i} / a{i}{i} AS x{i}' for i in range(n))} FROM ({sql})"


def _sql_certificate(signs=None, penalty: float = 0.0) -> str:
    """Newton's method on the cells of the three features; ``signs``: the nonzero coefficients'."""
    names = C.LI_FEATURES
    active = list(names) if signs is None else [c for c in names if c in signs]
    n = len(active) + 1
    x = ["1.0", *active]
    margin = " + ".join(f"b{i} * {c}" for i, c in enumerate(x))
    p = f"(1 / (1 + exp(-({margin}))))"
    # the penalty of the scaled coefficient is steady while its sign is
    steady = ["0.0" if signs is None or i == 0 else f"{signs[c] * penalty} * o * s_{c}"
              for i, c in enumerate(x)]
    sums = [f"sum(n * ({p} - y) * {a}) / sum(n) + any_value({t}) AS g{i}"
            for i, (a, t) in enumerate(zip(x, steady, strict=True))]
    sums += [f"sum(n * {p} * (1 - {p}) * {a} * {b}) / sum(n) AS a{i}{j}"
             for i, a in enumerate(x) for j, b in enumerate(x)]
    ctes = [
        f"t AS (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in names)}, {LABEL} AS label, "
        f"{C._sql_split(C.LI_KEYS, C.SEED)} AS split FROM lineitem)",
        # class index 0 is the label that has more rows
        "one AS (SELECT CASE WHEN sum(label) * 2 > count(*) THEN 0 ELSE 1 END AS y1 FROM t)",
        f"cells AS MATERIALIZED (SELECT {', '.join(names)}, CASE WHEN label = y1 THEN 1.0 ELSE 0.0 END AS y, "
        f"count(*)::DOUBLE AS n FROM t, one WHERE split = 'train' GROUP BY ALL)",
        "sd AS MATERIALIZED (SELECT " + ", ".join(
            f"sqrt((sum(n * {c} * {c}) - sum(n * {c}) * sum(n * {c}) / sum(n)) / (sum(n) - 1)) AS s_{c}"
            for c in names) + ", any_value(o) AS o FROM cells, (SELECT 2 * y1 - 1 AS o FROM one))",
        "b0 AS MATERIALIZED (SELECT " + ", ".join(f"0.0::DOUBLE AS b{i}" for i in range(n)) + ")"]
    for k in range(NEWTON_STEPS):
        step = _sql_solved(n, f"SELECT {', '.join(sums)} FROM cells, b{k}, sd")
        ctes.append(f"b{k + 1} AS MATERIALIZED (SELECT "
                    + ", ".join(f"b{i} - x{i} AS b{i}" for i in range(n)) + f" FROM b{k}, ({step}))")
    grads = ", ".join(f"sum(n * ({p} - y) * {c}) / sum(n) / any_value({'1.0' if c == '1.0' else 's_' + c}) "
                      f"AS d{i}" for i, c in enumerate(["1.0", *names]))
    ctes.append(f"d AS (SELECT {grads} FROM cells, b{NEWTON_STEPS}, sd)")
    rows = [f"SELECT '{optimality.INTERCEPT}' AS feature, b0 AS coefficient, NULL::DOUBLE AS std, d0 AS gradient, "
            f"0.0 AS slope, abs(d0) AS violation FROM b{NEWTON_STEPS}, d"]
    for i, c in enumerate(names):
        if c in active:
            slope = "0.0" if signs is None else f"o * {signs[c] * penalty}"
            rows.append(f"SELECT '{c}', b{active.index(c) + 1}, s_{c}, d{i + 1}, {slope}, "
                        f"abs(d{i + 1} + {slope}) FROM b{NEWTON_STEPS}, d, sd")
        else:
            rows.append(f"SELECT '{c}', 0.0, s_{c}, d{i + 1}, {penalty}, "
                        f"greatest(abs(d{i + 1}) - {penalty}, 0) FROM d, sd")
    return ("WITH " + ",\n ".join(ctes) + "\nSELECT feature, round(coefficient, 5) AS coefficient, "
            "round(std, 5) AS std, round(gradient, 5) AS gradient, "
            "round(CAST(slope AS DOUBLE), 5) AS slope, "
            "violation <= 1e-5 AS optimal FROM (" + " UNION ALL ".join(rows) + ")")


# ------------------------------------------------------------ M5

def q_softmax_bands(spark, d):
    """M5: three classes in one softmax; noisy bands, so every row's likeliest class is the clean
    one, and the probabilities of each row sum to 1."""
    prep = _prepared(spark, d, C.NOISY_BANDS)
    data = prep.category_model.transform(prep.label_model.transform(prep.data))
    train = data.filter("split = 'train'")
    if prep.rows_repeat():
        with counted.counted_rows(train, ["indexedFeatures", "indexedLabel"]) as rows:
            model = softmax.fit(rows, n_rounds=5, max_depth=2, weight_col=counted.WEIGHT)
    else:
        model = softmax.fit(train, n_rounds=5, max_depth=2)
    scored = features.label_names(prep.label_model).transform(model.transform(data))
    total = F.aggregate("probability", F.lit(0.0), lambda a, p: a + p)
    found = scored.groupBy("split", "label", F.col("predictedLabel").cast("int").alias("prediction")).agg(
        F.count("*").alias("n_rows"), F.count_if(F.abs(total - 1) < 1e-9).alias("n_whole"))
    return found


SQL_SOFTMAX_BANDS = (
    f"SELECT split, label, prediction, count(*) AS n_rows, count(*) AS n_whole FROM ("
    f"SELECT {C._sql_split(C.LI_KEYS, C.SEED)} AS split, {C.NOISY_BANDS} AS label, "
    f"{C.RULE_BANDS} AS prediction FROM lineitem) t GROUP BY split, label, prediction")


# ------------------------------------------------------------ F7-F10

SUBSPACE = 8     # components of the compared subspace
SWEEPS = 8       # rounds of all rotations; a few more than double precision needs


def _fitted_pca(spark, d):
    e = C._emb_vectors(spark, d).filter(F.col("split") == "train")
    scaled = features.fit_scaler(e, "features", "normFeatures", with_mean=True).transform(e)
    return scaled, red.fit_pca(scaled, "normFeatures", "pca", C._width(spark, d))


def q_pca_certificate(spark, d):
    """Every component is an eigenpair of the covariance, and orthogonal to the others."""
    scaled, pca = _fitted_pca(spark, d)
    found = red.eigen_certificate(red.covariance(scaled, "normFeatures"), pca,
                                  red.total_variance(scaled, "normFeatures"))
    return found.select("component", C._r("eigenvalue").alias("eigenvalue"),
                        (F.col("residual") < 1e-9).alias("is_pair"),
                        (F.col("overlap") < 1e-9).alias("is_orthogonal"))


def q_pca_subspace(spark, d):
    """the subspace of the leading components, as its projection matrix."""
    _, pca = _fitted_pca(spark, d)
    return red.projector(spark, pca, SUBSPACE).withColumn("value", F.round("value", 7) + F.lit(0.0))


# the covariance rotated to a diagonal by Jacobi's method: a round turns all pairs of a
# round-robin tournament at once; v is the matrix, w the rotations' product
_JACOBI = f"""WITH RECURSIVE e AS (
  SELECT vec_id, embedding FROM embeddings WHERE {C._sql_split(['vec_id'], C.SEED)} = 'train'),
 u AS (SELECT vec_id, unnest(generate_series(0, len(embedding) - 1)) AS i,
              unnest(embedding)::DOUBLE AS x FROM e),
 z AS (SELECT vec_id, i, (x - avg(x) OVER (PARTITION BY i)) / stddev_samp(x) OVER (PARTITION BY i) AS x
       FROM u),
 dim AS MATERIALIZED (SELECT max(i) + 1 AS d FROM u),
 cov AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.x * b.x) / (count(*) - 1) AS v
                      FROM z a JOIN z b USING (vec_id) GROUP BY a.i, b.i),
 m AS (
  SELECT 0 AS it, i, j, v, (CASE WHEN i = j THEN 1.0 ELSE 0.0 END)::DOUBLE AS w FROM cov
  UNION ALL
  SELECT it + 1, i, j, sum(v), sum(w) FROM (
   WITH cur AS (SELECT * FROM m),
    pair AS (SELECT cur.i, cur.j AS b, cur.v AS ab FROM cur, dim
             WHERE cur.j = CASE WHEN cur.i = d - 1 THEN it % (d - 1) WHEN cur.i = it % (d - 1) THEN d - 1
                           ELSE (2 * (it % (d - 1)) - cur.i + 2 * (d - 1)) % (d - 1) END),
    diag AS (SELECT i, v FROM cur WHERE i = j),
    turn AS (SELECT pair.i, b, CASE WHEN ab = 0 THEN 0
                    WHEN x.v = y.v THEN CASE WHEN pair.i < b THEN pi() / 4 ELSE -pi() / 4 END
                    ELSE atan(2 * ab / (x.v - y.v)) / 2 END AS phi
             FROM pair JOIN diag x ON x.i = pair.i JOIN diag y ON y.i = b),
    k AS (SELECT i, i AS a, cos(phi) AS c FROM turn UNION ALL SELECT i, b, sin(phi) FROM turn)
   SELECT cur.it, k1.i, k2.i AS j, k1.c * cur.v * k2.c AS v, 0.0::DOUBLE AS w
   FROM cur JOIN k k1 ON k1.a = cur.i JOIN k k2 ON k2.a = cur.j
   UNION ALL
   SELECT cur.it, k1.i, cur.j, 0.0, k1.c * cur.w FROM cur JOIN k k1 ON k1.a = cur.i), dim
  WHERE it < {SWEEPS} * (d - 1) GROUP BY it, i, j),
 last AS MATERIALIZED (SELECT i, j, v, w FROM m, dim WHERE it = {SWEEPS} * (d - 1)),
 pairs AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY v DESC) AS INTEGER) AS component, i, v AS eigenvalue
                        FROM last WHERE i = j)
"""

SQL_PCA_VARIANCE = _JACOBI + """
SELECT component, round(eigenvalue / sum(eigenvalue) OVER (), 9) AS ratio,
       round(sum(eigenvalue) OVER (ORDER BY component ROWS UNBOUNDED PRECEDING)
             / sum(eigenvalue) OVER (), 9) AS cumulative,
       round(eigenvalue, 9) AS eigenvalue FROM pairs"""

SQL_PCA_CERTIFICATE = _JACOBI + """
, vec AS (SELECT component, eigenvalue, last.j AS slot, w FROM pairs JOIN last USING (i)),
 image AS (SELECT component, eigenvalue, cov.i AS slot, sum(cov.v * w) AS y
           FROM vec JOIN cov ON cov.j = vec.slot GROUP BY component, eigenvalue, cov.i),
 res AS (SELECT component, image.eigenvalue, sqrt(sum(power(y - image.eigenvalue * w, 2))) AS r
         FROM image JOIN vec USING (component, slot) GROUP BY component, image.eigenvalue),
 dots AS (SELECT a.component, b.component AS other, sum(a.w * b.w) AS dot
          FROM vec a JOIN vec b USING (slot) GROUP BY a.component, b.component)
SELECT component, round(eigenvalue, 9) AS eigenvalue, r < 1e-9 AS is_pair, o < 1e-9 AS is_orthogonal
FROM res JOIN (SELECT component, max(abs(dot - CASE WHEN component = other THEN 1 ELSE 0 END)) AS o
               FROM dots GROUP BY component) USING (component)"""

SQL_PCA_SUBSPACE = _JACOBI + f"""
SELECT CAST(a.j AS INTEGER) AS i, CAST(b.j AS INTEGER) AS j, round(sum(a.w * b.w), 7) AS value
FROM pairs JOIN last a USING (i) JOIN last b ON b.i = a.i WHERE component <= {SUBSPACE} GROUP BY a.j, b.j"""


# ------------------------------------------------------------ E3 with F4-F8

FOLDS, REPEATS = 10, 3


def _fold_moments(spark, d):
    """Folds of the embeddings by class, and the moments of all of them from one pass."""
    e = C._t(spark, d, "embeddings").select("vec_id", "label", "embedding")
    folds = sampling.stratified_folds(e, ["vec_id"], "label", FOLDS, REPEATS, 1, keep=["embedding"])
    return foldwise.fold_moments(folds, "embedding")


def q_fold_scalers(spark, d):
    """F4, F5 for each of the 3 x 10 fits: mean and deviation without the held-out fold."""
    found = foldwise.fold_scalers(spark, _fold_moments(spark, d))
    return found.withColumns({c: C._r(c) for c in ("mean", "std")})


def q_fold_correlations(spark, d):
    """F8 for each fit: the matrix whose eigenpairs its PCA takes."""
    return foldwise.fold_correlations(spark, _fold_moments(spark, d)).withColumn("value", C._r("value"))


_SQL_FOLDS = f"""WITH f AS (
  SELECT vec_id, embedding, CAST(r.rep AS INTEGER) AS repeat, CAST((row_number() OVER (
         PARTITION BY label, r.rep ORDER BY md5(concat_ws(':', vec_id, '1', r.rep)), vec_id) - 1) % {FOLDS}
         AS INTEGER) AS fold FROM embeddings, range({REPEATS}) r(rep)),
 h AS (SELECT DISTINCT repeat, fold FROM f),
 u AS (SELECT vec_id, unnest(generate_series(0, len(embedding) - 1)) AS i, unnest(embedding)::DOUBLE AS x
       FROM embeddings),
 t AS (SELECT h.repeat, h.fold, f.vec_id FROM h JOIN f ON f.repeat = h.repeat AND f.fold <> h.fold)
"""
SQL_FOLD_SCALERS = _SQL_FOLDS + """
SELECT repeat, fold, count(*) AS n_rows, CAST(i AS INTEGER) AS slot, round(avg(x), 9) AS mean,
       round(stddev_samp(x), 9) AS std FROM t JOIN u USING (vec_id) GROUP BY repeat, fold, i"""
SQL_FOLD_CORRELATIONS = _SQL_FOLDS + """
, p AS (SELECT a.vec_id, a.i, b.i AS j, a.x AS x, b.x AS y FROM u a JOIN u b ON a.vec_id = b.vec_id AND a.i < b.i)
SELECT repeat, fold, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(corr(x, y), 9) AS value
FROM t JOIN p USING (vec_id) GROUP BY repeat, fold, i, j"""


# ------------------------------------------------------------ K2

def _copied_orders(spark, d):
    """Half the rows are copies of few."""
    return C._t(spark, d, "orders").select(
        F.when(F.col("o_orderkey") % 2 == 0, F.lit("copy")).otherwise(F.col("o_orderkey").cast("string"))
        .alias("k"), "o_orderstatus")


def q_exact_split(spark, d):
    """K2: exactly ceil(0.3 n) test rows, of a table whose rows repeat."""
    return sampling.exact_split(_copied_orders(spark, d), 2342)


SQL_EXACT_SPLIT = """WITH o AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'copy'
  ELSE CAST(o_orderkey AS VARCHAR) END AS k, o_orderstatus FROM orders),
 n AS (SELECT *, row_number() OVER (PARTITION BY k, o_orderstatus) - 1 AS _copy FROM o)
SELECT *, CASE WHEN row_number() OVER (ORDER BY md5(concat_ws(':', k, o_orderstatus, _copy, '2342')))
          <= ceil(0.3 * count(*) OVER () - 1e-9) THEN 'test' ELSE 'train' END AS split FROM n"""


QUERIES = {
    "tree_nodes": q_tree_nodes,
    "tree_sql_scores": q_tree_sql_scores,
    "model_sql_agrees": q_model_sql_agrees,
    "tree_gain": q_tree_gain,
    "logit_certificate": q_logit_certificate,
    "lasso_certificate": q_lasso_certificate,
    "softmax_bands": q_softmax_bands,
    "pca_certificate": q_pca_certificate,
    "pca_subspace": q_pca_subspace,
    "fold_scalers": q_fold_scalers,
    "fold_correlations": q_fold_correlations,
    "exact_split": q_exact_split,
}

ORACLES = {
    "tree_nodes": SQL_TREE_NODES,
    "tree_sql_scores": SQL_TREE_SQL_SCORES,
    "model_sql_agrees": SQL_MODEL_SQL_AGREES,
    "tree_gain": SQL_TREE_GAIN,
    "logit_certificate": _sql_certificate(),
    "lasso_certificate": _sql_certificate(LASSO_SIGNS, LASSO),
    "softmax_bands": SQL_SOFTMAX_BANDS,
    "pca_variance": SQL_PCA_VARIANCE,
    "pca_certificate": SQL_PCA_CERTIFICATE,
    "pca_subspace": SQL_PCA_SUBSPACE,
    "fold_scalers": SQL_FOLD_SCALERS,
    "fold_correlations": SQL_FOLD_CORRELATIONS,
    "exact_split": SQL_EXACT_SPLIT,
}
ORACLES = {k: C._plus_zero_rounds(C._sig_rounds(v)) for k, v in ORACLES.items()}
