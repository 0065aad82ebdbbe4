"""Chat formatting by perspective rotation (DataFrame functions only).

For every participant of a conversation the dialogue is rendered once with
that speaker as ``assistant`` and all others as named users; the loss mask
covers what the assistant says, its end mark included. ``system`` turns keep
their role and are nobody's perspective.

A dialogue is rendered in segments of ``segment_turns`` turn numbers; a usual
conversation is one segment (0). A segment may hold any number of rows (null
or repeated turn numbers): over ``part_bytes`` it is cut into several rows, its
parts, so that neither a conversation nor a segment of any length meets in one
task. Mask positions are code points of the row's text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import MIN_BUCKETS, running, written

SEGMENT_TURNS = 256
PART_BYTES = 64 << 20
TURN_BYTES = 64    # what a turn counts besides its role and text
PREFIX = 1024      # characters of a text that rule the cuts between parts
UNKNOWN = "unknown"
END = "<|im_end|>\n"


def _weight() -> Column:
    return (F.octet_length("role") + F.octet_length("text") + F.lit(TURN_BYTES)).cast("long")


def _with_part(turns: DataFrame, part_bytes: int) -> DataFrame:
    """``turns`` with the part of its segment: 0, unless the segment is over ``part_bytes``.

    Turns of a cut segment are dealt to ranges in order, equal ones too, and
    the bytes before each are summed inside its range and over the ranges
    before. Texts that agree in ``PREFIX`` characters go by hash between parts.
    """
    key = ["conv_id", "segment"]
    large = written(turns.groupBy(*key).agg(F.sum(_weight()).alias("bytes"))
                    .filter(F.col("bytes") > part_bytes), "segments")
    total = large.agg(F.sum("bytes")).first()[0]
    if total is None:
        return turns.withColumn("part", F.lit(0).cast("long"))

    def among(how):
        return turns.join(large, [turns[c].eqNullSafe(large[c]) for c in key], how)

    cut = written(among("left_semi").withColumn("uid", F.monotonically_increasing_id()), "cut")
    order = ["turn", "role", F.left("text", F.lit(PREFIX)), F.xxhash64("text"), "uid"]
    cut = written(cut.repartitionByRange(max(MIN_BUCKETS, math.ceil(total / part_bytes)), *key, *order)
                  .withColumn("range", F.spark_partition_id()), "ranges")
    cell = [*key, "range"]
    before = Window.partitionBy(*key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (cut.groupBy(*cell).agg(F.sum(_weight()).alias("n"))
               .select(*cell, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    inside = Window.partitionBy(*cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = cut.withColumn("inside", F.coalesce(F.sum(_weight()).over(inside), F.lit(0)))
    placed = summed.join(offsets, [summed[c].eqNullSafe(offsets[c]) for c in cell]).select(
        *[summed[c] for c in turns.columns],
        F.floor((F.col("inside") + F.col("offset")) / part_bytes).cast("long").alias("part"))
    return among("left_anti").withColumn("part", F.lit(0).cast("long")).unionByName(placed)


def rotated(conversations: DataFrame, segment_turns: int = SEGMENT_TURNS,
            part_bytes: int = PART_BYTES) -> DataFrame:
    """Rows (conv_id, perspective, segment, part, n_turns, n_trained, text, masks).

    Turns go by turn number, then role and text; a null turn comes first, in
    segment -1. A null role is the speaker 'unknown', a null text is empty.
    Repeated rows are repeated turns. A conversation with system turns only
    gives no rows. ``masks`` is start:end (end exclusive), comma-joined.
    """
    turns = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit(UNKNOWN)).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / segment_turns), F.lit(-1)).cast("long").alias("segment"))
    people = (turns.filter(F.col("role") != "system")
              .select("conv_id", F.col("role").alias("perspective")).distinct())
    segments = _with_part(turns, part_bytes).groupBy("conv_id", "segment", "part").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    pairs = segments.join(people, segments["conv_id"].eqNullSafe(people["conv_id"])).drop(
        people["conv_id"])
    parts = pairs.withColumn("parts", F.expr(f"""transform(turns, t -> named_struct(
        'mine', t.role = perspective,
        'head', concat('<|im_start|>', case when t.role = perspective then 'assistant'
                       when t.role = 'system' then 'system'
                       else concat('user name=', t.role) end, '\\n'),
        'body', concat(t.text, '{END.strip()}\\n')))"""))
    # a part of a million short turns has as many spans: positions run in blocks
    spans = F.array_join(F.expr(running(
        "parts", "(char_length(p.head) + char_length(p.body))",
        "concat({at} + char_length(p.head), ':', {at} + char_length(p.head) + char_length(p.body))",
        "p.mine", "p")), ",")
    return parts.select(
        "conv_id", "perspective", "segment", "part", F.size("turns").cast("long").alias("n_turns"),
        F.expr("size(filter(parts, p -> p.mine))").cast("long").alias("n_trained"),
        F.expr("array_join(transform(parts, p -> concat(p.head, p.body)), '')").alias("text"),
        spans.alias("masks"))


ORACLE = rf"""
WITH t0 AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
                  coalesce(CAST(floor(turn / 256.0) AS BIGINT), -1) AS segment
            FROM conversations),
 t AS (SELECT *, CAST(floor(coalesce(sum(strlen(role) + strlen(text) + {TURN_BYTES}) OVER (
                PARTITION BY conv_id, segment ORDER BY turn NULLS FIRST, role, left(text, {PREFIX}), text
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / {PART_BYTES}) AS BIGINT) AS part
       FROM t0),
 p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
 x AS (SELECT t.conv_id, p.perspective, t.segment, t.part, t.turn, t.role, t.text AS body0,
              t.role = p.perspective AS mine,
              '<|im_start|>' || CASE WHEN t.role = p.perspective THEN 'assistant'
                WHEN t.role = 'system' THEN 'system' ELSE 'user name=' || t.role END
                || chr(10) AS head,
              t.text || '<|im_end|>' || chr(10) AS body
       FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
 y AS (SELECT *, row_number() OVER w AS nth,
              sum(length(head) + length(body)) OVER (w ROWS UNBOUNDED PRECEDING) AS upto
       FROM x WINDOW w AS (PARTITION BY conv_id, perspective, segment, part
                           ORDER BY turn NULLS FIRST, role, body0))
SELECT conv_id, perspective, segment, part, count(*) AS n_turns,
       CAST(sum(CAST(mine AS INT)) AS BIGINT) AS n_trained,
       string_agg(head || body, '' ORDER BY nth) AS text,
       coalesce(string_agg(CAST(upto - length(body) AS VARCHAR) || ':' || CAST(upto AS VARCHAR),
                           ',' ORDER BY nth) FILTER (mine), '') AS masks
FROM y GROUP BY conv_id, perspective, segment, part"""
