"""Row splits and stratified folds.

The default split is a *hash* split: a row's side is a function of its key
and the seed only, so it is the same after repartitioning, on recompute after
an executor is lost, and in DuckDB. ``random_split`` keeps Spark's
``randomSplit`` for callers who want the library behaviour.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabfold.functions.exprs import HASH_SPACE, hash_hex
from tabfold.operators.wrangle import broadcast_if_small


def split_column(keys: Sequence, seed, weights: Sequence[float] = (0.7, 0.3),
                 names: Sequence[str] = ("train", "test")):
    """Column naming the side of each row; weights are normalised."""
    if len(weights) != len(names):
        raise ValueError("one name per weight")
    total = float(sum(weights))
    # ``unit < bound`` on the 32-bit unit equals ``prefix <= hex(last unit
    # below bound)`` on the 8-digit lowercase hex prefix (fixed width, so text
    # order is numeric order) - the same rows, without a text->number conv
    prefix = F.substring(hash_hex(keys, seed), 1, 8)
    bounds, acc = [], 0.0
    for w in weights[:-1]:
        acc += w / total
        bounds.append(acc * HASH_SPACE)
    expr = F.lit(names[-1])
    for bound, name in reversed(list(zip(bounds, names[:-1]))):
        last = math.ceil(bound) - 1                  # largest unit with unit < bound
        if last < 0:
            continue
        cond = F.lit(True) if last >= HASH_SPACE - 1 else prefix <= F.lit(f"{last:08x}")
        expr = F.when(cond, F.lit(name)).otherwise(expr)
    return expr


def hash_split(df: DataFrame, keys: Sequence, seed, train_fraction: float = 0.7,
               out: str = "split") -> DataFrame:
    """K1(b)/K2: add ``split`` in {'train','test'}; one pass, no sort."""
    return df.withColumn(out, split_column(keys, seed, (train_fraction, 1.0 - train_fraction)))


def train_test(df: DataFrame, split_col: str = "split"):
    return df.filter(F.col(split_col) == "train"), df.filter(F.col(split_col) == "test")


def random_split(df: DataFrame, weights: Sequence[float] = (0.7, 0.3), seed=None):
    """K1(a): Spark's ``randomSplit``; accepts the seed as text like the CLI."""
    return df.randomSplit(list(weights), int(seed) if seed is not None else None)


def numbered_copies(df: DataFrame, out: str = "_copy", chunk: int = 1 << 16) -> DataFrame:
    """Number equal rows 0, 1, 2, ... so that a split by all columns and
    ``out`` deals copies to both sides (K1 for tables without a key).

    Equal rows are counted (map-side combined), then spread out again in
    chunks of ``chunk`` copies that are dealt separately: a row with a third
    of the table never meets in one task. The same whatever the layout.
    """
    cols = df.columns
    last = F.floor((F.col("_n") - 1) / chunk).cast("long")
    chunks = (df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), last)))
              .repartition(*cols, "_chunk"))
    first = F.col("_chunk") * chunk
    return chunks.withColumn(out, F.explode(F.sequence(
        first, F.least(first + chunk, F.col("_n")) - 1))).drop("_n", "_chunk")


def exact_split(df: DataFrame, seed, test_fraction: float = 0.3, keys: Sequence[str] | None = None,
                out: str = "split", digits: int = 3) -> DataFrame:
    """K2 to the row: exactly ceil(test_fraction x n) rows are 'test', the others 'train'.

    The test rows are those with the smallest hashes of their key. The border
    is found without a sort: a round counts the rows by the next ``digits`` hex
    digits of the hash, inside the range that holds the border, until that
    range holds one row; n rows take about log n / log 4096 rounds of one
    map-side-combined aggregation, with at most 16^digits counts to the driver.
    ``keys`` must be unique; without them equal rows are numbered (``_copy``)
    and all columns are the key, so that copies are dealt to the row, too.
    """
    if keys is None:
        df = numbered_copies(df)
        keys = df.columns
    hashed = hash_hex(list(keys), seed)
    n_rows = df.count()
    wanted = math.ceil(test_fraction * n_rows - 1e-9)
    if wanted <= 0 or n_rows == 0:
        return df.withColumn(out, F.lit("train"))
    prefix, left, space = "", wanted, 32
    while True:
        inside = df.select(hashed.alias("h")).filter(F.col("h").startswith(prefix))
        part = F.substring("h", len(prefix) + 1, digits)
        counts = sorted(inside.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
        for p, n in counts:
            if n >= left:
                break
            left -= n
        prefix += p
        if n == left or len(prefix) >= space:
            break
    side = F.when(F.substring(hashed, 1, len(prefix)) <= prefix, "test").otherwise("train")
    return df.withColumn(out, side)


def _hex_digits(n_rows: int, rows_per_bucket: int) -> int:
    if n_rows <= rows_per_bucket:
        return 1
    return max(1, min(8, math.ceil(math.log(n_rows / rows_per_bucket, 16))))


def stratified_folds(df: DataFrame, keys: Sequence[str], label_col: str, n_folds: int = 10,
                     n_repeats: int = 3, seed=1, rows_per_bucket: int = 1 << 14,
                     keep: Sequence[str] = (), repeat_ids: Sequence[int] | None = None,
                     hot_factor: int = 4) -> DataFrame:
    """K3: repeated stratified k-fold, one output row per (row, repeat).

    Inside each class, rows are ranked by ``md5(key:seed:repeat)`` (key as the
    tie-break) and ``fold = (rank - 1) % n_folds``; every class is spread over
    the folds with sizes differing by at most one.

    A plain ``row_number() over (partition by class ...)`` would put a whole
    class - possibly a third of the table - in one task. Instead the rank is
    ``offset(bucket) + row_number() over (bucket)``, where buckets are
    contiguous ranges of the rank order: the leading hex digits of the hash,
    uniform in size (about ``rows_per_bucket``). The offset table has one row
    per bucket, small and size-checked before broadcast.

    Copies of one key share their hash, so a key copied many times makes its
    bucket hot. Buckets over ``hot_factor * rows_per_bucket`` rows are split
    further, by ranges of the rows' content hash, which is the rank order
    within a key anyway: folds don't depend on the layout or on the bucket
    size. Only rows that are equal in every column are cut by a position id
    (checkpointed), and those are interchangeable.
    ``repeat_ids`` computes only the given repeats (same folds as in the full
    run), e.g. one at a time.
    """
    n_rows = df.count()
    digits = _hex_digits(n_rows, rows_per_bucket)
    cols = list(dict.fromkeys([*keys, label_col, *keep]))
    ids = list(repeat_ids) if repeat_ids is not None else list(range(n_repeats))
    # content hash of the row: ties between copies of a key are broken by
    # what the rows hold, so a recomputed task ranks them the same way
    reps = (df.select(*cols)
              .withColumn("_t", F.xxhash64(*cols))
              .withColumn("repeat", F.explode(F.array(*[F.lit(int(i)) for i in ids])))
              .withColumn("_h", hash_hex(keys, seed, F.col("repeat")))
              .withColumn("_b", F.substring("_h", 1, digits)))
    # the bucket leads: a sort then compares short prefixes before whole rows
    grp = ["_b", label_col, "repeat"]
    counts = reps.groupBy(*grp).agg(F.count(F.lit(1)).alias("_n")).persist()
    hot_limit = max(hot_factor * rows_per_bucket, 1)
    chunk_bits = max(1, int(rows_per_bucket).bit_length() - 1)   # chunks <= rows_per_bucket
    hot = counts.filter(F.col("_n") > hot_limit).select(*grp)
    # rank order is (_b, _h, _t) on every path; pieces are ranges of it
    none, position = {}, []
    piece = grp
    if hot.limit(1).count() == 0:
        pieces, rows = counts, reps
    else:
        from tabfold.session import ensure_checkpoint_dir
        ensure_checkpoint_dir(df.sparkSession)
        none = {"_sh": F.lit(""), "_sm": F.lit(0).cast("long"), "_st": F.lit(0).cast("long"),
                "_sp": F.lit(0).cast("long")}
        piece, position = [*grp, *none], ["_m"]
        hot = broadcast_if_small(hot.persist())
        cold_rows = null_safe_join(reps, hot, grp, "left_anti")
        hot_rows = (null_safe_join(reps, hot, grp, "left_semi")
                    .withColumn("_m", F.monotonically_increasing_id())
                    .checkpoint(eager=True))
        # rows of one key: by ranges of the content hash
        hot_rows = (hot_rows.withColumn("_sh", F.col("_h"))
                            .withColumn("_sm", F.shiftright("_t", 48)))
        ranges = [*grp, "_sh", "_sm"]
        full = (hot_rows.groupBy(*ranges).agg(F.count(F.lit(1)).alias("_n"))
                        .filter(F.col("_n") > hot_limit)
                        .select(*ranges, F.lit(True).alias("_full")))
        # a range that is still full holds equal rows: those alone are cut by position
        hot_rows = null_safe_join(hot_rows, broadcast_if_small(full), ranges, "left",
                                  right_cols=["_full"])
        hot_rows = (hot_rows
                    .withColumn("_st", F.when(F.col("_full"), F.col("_t")).otherwise(F.lit(0)))
                    .withColumn("_sp", F.when(F.col("_full"), F.shiftright("_m", chunk_bits))
                                .otherwise(F.lit(0)))
                    .drop("_full"))
        hot_pieces = hot_rows.groupBy(*piece).agg(F.count(F.lit(1)).alias("_n"))
        cold_pieces = null_safe_join(counts, hot, grp, "left_anti").withColumns(none)
        pieces = cold_pieces.unionByName(hot_pieces)
        rows = cold_rows.withColumns({**none, "_m": F.lit(0).cast("long")}).unionByName(hot_rows)
    before = (Window.partitionBy(label_col, "repeat").orderBy("_b", *none)
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = (pieces.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
                     .drop("_n").persist())
    joined = null_safe_join(rows, broadcast_if_small(offsets), piece, "inner",
                            right_cols=["_off"])
    within = Window.partitionBy(*piece).orderBy("_h", "_t", *keys, *position)
    rank = F.row_number().over(within) + F.col("_off")
    return (joined.withColumn("fold", ((rank - 1) % n_folds).cast("int"))
                  .drop("_h", "_b", *none, *position, "_off", "_t"))


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str,
                    right_cols: Sequence[str] = ()) -> DataFrame:
    """Equi-join on ``on`` where null equals null (a null class is a class)."""
    a, b = left.alias("_l"), right.alias("_r")
    cond = None
    for c in on:
        e = F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}"))
        cond = e if cond is None else cond & e
    out = a.join(b, cond, how)
    if how in ("left_semi", "left_anti"):
        return out
    return out.select("_l.*", *[F.col(f"_r.{c}") for c in right_cols])
