"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabfold.session import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
# a word: no ASCII character but digits and lower-case letters (fixed by contract)
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKET_ROWS = 1 << 18   # rows that one ranking window holds, at most about
MIN_BUCKETS = 256       # so that a hot group is spread on small inputs too


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0))


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3 (1 marks held-out rows); a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared scratch folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def bound(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``name`` standing for ``value``, evaluated once however often it is named."""
    return f"transform(array({value}), {name} -> {body})[0]"


def in_blocks(array: str) -> str:
    """SQL: the array cut into about as many blocks as a block has items; [] of an empty one.

    A lambda that appends to an array copies it for each item: work over blocks
    grows with n times the root of n, not with the square of n. ``array`` is named
    often, so it should be a name (``bound``).
    """
    size = f"greatest(cast(ceil(sqrt(size({array}))) as int), 1)"
    return (f"if(size({array}) > 0, transform(sequence(0, (size({array}) - 1) div {size}), "
            f"b -> slice({array}, cast(b as int) * {size} + 1, {size})), array())")


def running(array: str, length: str, span: str, keep: str, item: str = "x") -> str:
    """SQL: array of ``span`` for the kept items of ``array``; {at} in it is the total ``length`` of
    all items before. ``length``, ``span`` and ``keep`` are SQL over the ``item``.
    """
    each = (f"transform({in_blocks('whole')}, b -> named_struct('b', b, "
            f"'n', aggregate(b, 0, (a, {item}) -> a + {length})))")
    # the blocks' starts, carried along in a list as long as a block
    placed = ("aggregate(blocks, named_struct('at', 0, 'out', "
              "filter(transform(slice(blocks, 1, 1), z -> named_struct('b', z.b, 'at', 0)), z -> false)), "
              "(a, z) -> named_struct('at', a.at + z.n, 'out', concat(a.out, "
              "array(named_struct('b', z.b, 'at', a.at)))), a -> a.out)")
    one = span.replace("{at}", "a.at")
    empty = f"filter(transform(slice(z.b, 1, 1), {item} -> {span.replace('{at}', '0')}), y -> false)"
    inner = (f"aggregate(z.b, named_struct('at', z.at, 'out', {empty}), (a, {item}) -> named_struct("
             f"'at', a.at + {length}, 'out', if({keep}, concat(a.out, array({one})), a.out)), a -> a.out)")
    return bound(array, "whole", bound(each, "blocks", f"flatten(transform({placed}, z -> {inner}))"))


def with_rank(df: DataFrame, part: list[str], order: list[str], uid: str, n_rows: int,
              name: str = "rank") -> DataFrame:
    """Gapless 0-based rank inside each ``part`` group, never holding a group in one task.

    Rows are dealt to hash buckets of ``uid`` (unique, frozen in a written
    table), ranked inside (part, bucket), and moved up by the sizes of the
    buckets before theirs. ``order`` rules inside a bucket only.
    """
    n_buckets = max(MIN_BUCKETS, math.ceil(n_rows / BUCKET_ROWS))
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(uid), F.lit(n_buckets)).cast("int"))
    cell = [*part, "_bucket"]
    before = Window.partitionBy(*part).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = (df.groupBy(*cell).agg(F.count("*").alias("_n"))
               .select(*cell, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")))
    inside = Window.partitionBy(*cell).orderBy(*order, uid)
    ranked = df.withColumn("_inside", F.row_number().over(inside) - 1)
    same = [ranked[c].eqNullSafe(offsets[c]) for c in cell]
    joined = ranked.join(offsets, same, "left")
    for c in cell:
        joined = joined.drop(offsets[c])
    return (joined.withColumn(name, (F.col("_inside") + F.col("_offset")).cast("long"))
            .drop("_inside", "_offset", "_bucket"))


def in_ranges(df: DataFrame, part: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` written in sorted ranges of (part, order); equal rows are dealt too.

    ``cell`` numbers the ranges and ``at`` the rows, in order and without gaps
    inside a range.
    """
    keyed = df.withColumn("uid", F.monotonically_increasing_id())
    keys = [*part, *order, "uid"]
    ranged = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("uid")
    return written(ranged.withColumn("cell", F.spark_partition_id())
                   .withColumn("at", F.monotonically_increasing_id()), name)


def numbered(df: DataFrame, part: list[str], cell: str, at: str, name: str = "pos",
             total: str = "n_part") -> DataFrame:
    """``df`` with each row's 1-based place in its ``part`` group, and the group's size.

    ``cell`` and ``at`` as ``in_ranges`` writes them: the rows of a group fill
    consecutive cells, and have consecutive numbers ``at`` inside each. A cell's
    place comes from the sizes of the group's cells before. Nulls are values.
    """
    cells = [*part, cell]
    group = Window.partitionBy(*part)
    before = group.orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(*cells).agg(F.count("*").alias("_n"), F.min(at).alias("_first")).select(
        *cells, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(group).alias(total))
    joined = df.join(starts, [df[c].eqNullSafe(starts[c]) for c in cells])
    for c in cells:
        joined = joined.drop(starts[c])
    return (joined.withColumn(name, F.col(at) - F.col("_first") + F.col("_offset") + 1)
            .drop("_first", "_offset"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def anti_rows(docs: DataFrame, losers: DataFrame) -> DataFrame:
    """Documents without the rows that ``losers`` (doc_id, text_hash) names; columns unchanged."""
    gone_id, gone_hash = unused(docs, "gone_id"), unused(docs, "gone_hash")
    gone = losers.select(F.col("doc_id").alias(gone_id), F.col("text_hash").alias(gone_hash)).distinct()
    return docs.join(gone, gone[gone_id].eqNullSafe(docs["doc_id"])
                     & gone[gone_hash].eqNullSafe(text_hash(docs["text"])), "left_anti")


def text_hash(text: Column) -> Column:
    """With doc_id, the key that leads a result back to its row (repeated rows share results)."""
    return F.xxhash64(F.coalesce(text, F.lit("")))
