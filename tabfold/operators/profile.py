"""Class histograms, feature profile, low-spread report, row count
(SURVEY A1-A4, A8).

The profile (``describe().T``) is computed on the long form
``(feature, value)`` with one grouped aggregation for the moments, not one
pass per column. Quartiles are *exact* with linear interpolation (as
pandas and ``quantile_cont``), without ever holding a whole feature in one
task. Each wanted rank has a cell, at first the whole feature:

1. while a cell holds more than ``max_candidates`` rows, a mergeable bounded
   sketch (``percentile_approx``) proposes two cut values around the rank, and
   a counting pass gives the exact sizes of the five cells they make: below,
   at the first cut, between, at the second, above. The rank moves to the
   cell that holds it. A cut is a value of the cell, so every round narrows,
   whatever the sketch's error; a cell of one value is the answer;
2. rows of the remaining cells are pre-aggregated to ``(value, count)`` and an
   exact running count over those few distinct values yields the order
   statistics.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabfold.operators.wrangle import broadcast_if_small


def class_histogram(df: DataFrame, col: str, keep_null: bool = True) -> DataFrame:
    """A1 / A2: rows per class, most frequent first (null kept as a group
    unless ``keep_null=False``)."""
    src = df if keep_null else df.filter(F.col(col).isNotNull())
    return (src.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
               .orderBy(F.col("count").desc(), F.col(col).asc_nulls_last()))


def row_count(df: DataFrame) -> DataFrame:
    """A8 as a one-row table."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def _number(col: str):
    """A NaN counts as null: aggregates skip it, as describe() does."""
    value = F.col(col).cast("double")
    return F.when(~F.isnan(value), value)


def long_format(df: DataFrame, cols: Sequence[str], ids: Sequence[str] = ()) -> DataFrame:
    """``(feature, value)`` rows for the given numeric columns. Null values
    stay, so a feature without any value still has its profile row."""
    wide = df.select(*ids, *[_number(c).alias(c) for c in cols])
    return wide.unpivot(list(ids), list(cols), "feature", "value")


def array_long_format(df: DataFrame, col: str, names: Sequence[str] | None = None,
                      prefix: str = "f") -> DataFrame:
    """Long form of an array column: ``feature`` = name of the slot."""
    pos = df.select(F.posexplode(F.col(col)).alias("_i", "value"))
    if names is not None:
        feat = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_i") + 1)
    else:
        feat = F.concat(F.lit(prefix), F.col("_i").cast("string"))
    return pos.select(feat.alias("feature"), _number("value").alias("value"))


# --------------------------------------------------------------- quantiles

GRID = 200
MAX_CANDIDATES = 1 << 20


@dataclass
class _Cell:
    """Open interval (lo, hi) of values, None without end, that holds a rank."""
    n: int                      # rows inside
    lo: float | None = None
    hi: float | None = None
    below: int = 0              # rows of the feature at or before lo
    value: float | None = None  # the order statistic, once known


def _inside():
    return ((F.col("lo").isNull() | (F.col("value") > F.col("lo")))
            & (F.col("hi").isNull() | (F.col("value") < F.col("hi"))))


def _rows_of(long: DataFrame, cells: list[tuple], extra: str = "") -> DataFrame:
    """Values of ``long`` with the cells (feature, id, lo, hi, ...) they lie in."""
    schema = "feature string, id int, lo double, hi double" + extra
    small = long.sparkSession.createDataFrame(cells, schema)
    return long.join(broadcast_if_small(small), "feature").filter(_inside())


def _distinct_cells(items) -> dict:
    """(feature, lo, hi) -> number; ranks in the same cell share it."""
    ids: dict = {}
    for (feature, _), c in items:
        ids.setdefault((feature, c.lo, c.hi), len(ids))
    return ids


def _narrow(long: DataFrame, items: list, accuracy: int) -> None:
    """One round: every given rank moves to a smaller cell that holds it."""
    ids = _distinct_cells(items)
    grids = {r["id"]: r["grid"] for r in
             _rows_of(long, [(f, i, lo, hi) for (f, lo, hi), i in ids.items()])
             .groupBy("id").agg(F.percentile_approx(
                 "value", [i / GRID for i in range(GRID + 1)], accuracy).alias("grid")).collect()}
    cuts = []
    for at, ((feature, rank), c) in enumerate(items):
        grid = grids[ids[feature, c.lo, c.hi]]
        place = (rank - c.below) / c.n * GRID
        cuts.append((feature, at, c.lo, c.hi, grid[max(math.floor(place) - 1, 0)],
                     grid[min(math.ceil(place) + 1, GRID)]))
    v, a, b = F.col("value"), F.col("a"), F.col("b")
    sizes = (_rows_of(long, cuts, ", a double, b double").groupBy("id", "a", "b")
             .agg(F.count_if(v < a).alias("under"), F.count_if(v == a).alias("first"),
                  F.count_if((v > a) & (v < b)).alias("between"),
                  F.count_if((v == b) & (a < b)).alias("second"), F.count_if(v > b).alias("over"))
             .collect())
    for r in sizes:
        (_, rank), c = items[r["id"]]
        for lo, hi, n, value in ((c.lo, r["a"], r["under"], None), (None, None, r["first"], r["a"]),
                                 (r["a"], r["b"], r["between"], None),
                                 (None, None, r["second"], r["b"]), (r["b"], c.hi, r["over"], None)):
            if rank < c.below + n:
                c.lo, c.hi, c.n, c.value = lo, hi, n, value
                break
            c.below += n


def _order_statistics(long: DataFrame, items: list) -> None:
    """Exact values of ranks whose cells are small enough for one window."""
    ids = _distinct_cells(items)
    cand = (_rows_of(long, [(f, i, lo, hi) for (f, lo, hi), i in ids.items()])
            .groupBy("id", "value").agg(F.count(F.lit(1)).alias("c")))
    w = Window.partitionBy("id").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    wanted = long.sparkSession.createDataFrame(
        [(ids[f, c.lo, c.hi], at, rank - c.below) for at, ((f, rank), c) in enumerate(items)],
        "id int, at int, place long")
    ranked = cand.withColumn("end", F.sum("c").over(w)).join(broadcast_if_small(wanted), "id")
    found = ranked.filter((F.col("end") - F.col("c") <= F.col("place"))
                          & (F.col("place") < F.col("end")))
    for r in found.select("at", "value").collect():
        items[r["at"]][1].value = r["value"]


def exact_quantiles(long: DataFrame, probs: Sequence[float] = (0.25, 0.5, 0.75),
                    accuracy: int = 10000, max_candidates: int = MAX_CANDIDATES,
                    counts: dict[str, int] | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles ``(feature, q, quantile)`` over
    ``long`` = ``(feature, value)``; ``q`` indexes ``probs``. Nulls don't
    count; a feature without values has no rows.

    No window holds more than ``max_candidates`` distinct values. The driver
    keeps two ranks per feature and quantile. ``counts`` may carry the values
    per feature, saving one scan.
    """
    spark = long.sparkSession
    long = long.select("feature", "value").filter(F.col("value").isNotNull())
    if counts is None:
        counts = {r["feature"]: r["n"] for r in
                  long.groupBy("feature").agg(F.count("value").alias("n")).collect()}
    cells: dict[tuple, _Cell] = {}
    wanted = []
    for feature, n in counts.items():
        for q, p in enumerate(probs if n else ()):
            k = math.floor((n - 1) * p)
            lower, upper = (feature, k), (feature, min(k + 1, n - 1))
            cells.setdefault(lower, _Cell(n))
            cells.setdefault(upper, _Cell(n))
            wanted.append((feature, q, lower, upper, (n - 1) * p - k))
    while large := [(key, c) for key, c in cells.items()
                    if c.value is None and c.n > max_candidates]:
        _narrow(long, large, accuracy)
    if rest := [(key, c) for key, c in cells.items() if c.value is None]:
        _order_statistics(long, rest)
    rows = []
    for feature, q, lower, upper, share in wanted:
        a, b = cells[lower].value, cells[upper].value
        rows.append((feature, q, a if a == b else a + share * (b - a)))
    return spark.createDataFrame(rows, "feature string, q int, quantile double")


def moments(long: DataFrame, *more) -> DataFrame:
    """Per feature ``count, mean, std (n-1), min, max`` (and more aggregates), one pass."""
    return long.groupBy("feature").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"), *more)


def feature_profile(long: DataFrame, probs: Sequence[float] = (0.25, 0.5, 0.75),
                    approx: bool = False, accuracy: int = 10000,
                    max_candidates: int = MAX_CANDIDATES) -> DataFrame:
    """A3: per feature ``count, mean, std (n-1), min, p25, p50, p75, max``,
    sorted by std ascending. A feature without values has count 0 and nulls.

    Exact quartiles by default, by one method at every size
    (``exact_quantiles``). ``approx=True`` returns the sketch quartiles (one
    pass) instead. The driver holds one row per feature.
    """
    names = [f"p{int(round(p * 100))}" for p in probs]
    if approx:
        grid = F.percentile_approx("value", list(probs), accuracy).alias("grid")
        out = moments(long, grid).select(
            "feature", "count", "mean", "std", "min",
            *[F.col("grid")[i].alias(nm) for i, nm in enumerate(names)], "max")
    else:
        rows = moments(long).collect()
        found = exact_quantiles(long, probs, accuracy, max_candidates,
                                {r["feature"]: r["count"] for r in rows}).collect()
        at = {(r["feature"], r["q"]): r["quantile"] for r in found}
        out = long.sparkSession.createDataFrame(
            [(r["feature"], r["count"], r["mean"], r["std"], r["min"],
              *[at.get((r["feature"], i)) for i in range(len(names))], r["max"]) for r in rows],
            "feature string, count long, " + ", ".join(
                f"{c} double" for c in ("mean", "std", "min", *names, "max")))
    return out.orderBy(F.col("std").asc_nulls_first(), "feature")


def low_spread(profile: DataFrame, a: str = "p25", b: str = "p75") -> DataFrame:
    """A4: features whose inter-quartile range is zero, by std ascending."""
    return profile.filter(F.col(a) == F.col(b)).orderBy(F.col("std").asc_nulls_first(), "feature")
