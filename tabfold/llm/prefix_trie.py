"""Prefix trie of conversations with subtree totals by parallel tree contraction.

Conversations that begin alike share nodes. A node is known by its depth's
prefix: two 64-bit hashes, each the exclusive-or of the hashes of (place, turn
digest) over the prefix, so that prefixes of a conversation of any length are
found by running sums over bounded segments, and a node's parent follows from
its own row.

Totals over subtrees come from rounds of joins. A round rakes and compresses:

- rake: nodes without children are final; they are summed into their parents;
- compress: of the nodes with one child, an independent set (of two neighbours
  the one at the odder depth goes) is taken out, and the child, which now hangs
  on the grandparent, carries the node's weight.

Both halve what is left of long chains, so a few rounds more than the binary
logarithm of the depth do. The compressed nodes are then put back, last round
first: a node's total is its own weight and its child's total.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_ranges, numbered, written

BLOCK = 100          # conversations that share the first turns of one (fixed by contract)
HEADS = 6            # so many first turns at most, exclusive (fixed by contract)
SEGMENT = 4096       # turns of a conversation that one running sum covers
CELL = 1 << 16       # conversation numbers that one piece of a digest covers
TEXT_ORDER = 64      # characters of a text that rule the order of equal turn numbers
ORDER = ["turn", "role", "head", "digest"]


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) after the exchange of first turns.

    Conversation c begins with the first h turns of conversation c - c % 100
    (all if it has fewer, none if there is no such one), h = crc32(c) % 6, and
    goes on with its own turns after its first h. conversations: conv_id, n
    (turns rebuilt); turns: conv_id, n, d (place from 1), digest, chars.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"),
        F.left(text, F.lit(TEXT_ORDER)).alias("head"),
        F.sha2(F.concat_ws(":", F.char_length(role), role, text), 256).alias("digest"),
        F.char_length(text).cast("long").alias("chars"))
    placed = numbered(in_ranges(turns, ["conv_id"], ORDER, "turns"), ["conv_id"], "cell", "at")
    placed = written(placed.select("conv_id", "pos", "digest", "chars"), "placed")
    lengths = placed.groupBy("conv_id").agg(F.count("*").alias("own"))
    first = lengths.select(F.col("conv_id").alias("first_id"), F.col("own").alias("n_first"))
    taken = (F.crc32(F.col("conv_id").cast("string")) % HEADS).alias("h")
    convs = lengths.withColumn("first_id", F.col("conv_id") - F.col("conv_id") % BLOCK).join(
        first, "first_id", "left").select("conv_id", "first_id", "own", "n_first", taken)
    convs = convs.withColumn("k", F.least("h", F.coalesce("n_first", F.lit(0)))).withColumn(
        "n", F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    convs = written(convs.select("conv_id", "first_id", "h", "k", "n"), "convs")
    heads = placed.filter(F.col("pos") < HEADS).withColumnRenamed("conv_id", "first_id")
    head_turns = convs.filter("k > 0").join(heads, "first_id").filter("pos <= k").select(
        "conv_id", "n", F.col("pos").alias("d"), "digest", "chars")
    own_turns = placed.join(convs, "conv_id").filter("pos > h").select(
        "conv_id", "n", (F.col("pos") - F.col("h") + F.col("k")).alias("d"), "digest", "chars")
    return convs.select("conv_id", "n"), head_turns.unionByName(own_turns)


def prefixes(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, n, d, chars, id, parent): the node of every prefix and its parent's."""
    lanes = turns.withColumn("a", F.xxhash64("d", "digest")).withColumn(
        "b", F.xxhash64("digest", "d")).withColumn(
        "segment", F.floor((F.col("d") - 1) / SEGMENT).cast("long"))
    lanes = written(lanes, "lanes")
    before = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = (lanes.groupBy("conv_id", "segment").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
               .select("conv_id", "segment", F.bit_xor("a").over(before).alias("oa"),
                       F.bit_xor("b").over(before).alias("ob")).filter("segment > 0"))
    upto = Window.partitionBy("conv_id", "segment").orderBy("d").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    inside = lanes.withColumn("pa", F.bit_xor("a").over(upto)).withColumn(
        "pb", F.bit_xor("b").over(upto))
    whole = inside.join(offsets, ["conv_id", "segment"], "left")
    pa = F.col("pa").bitwiseXOR(F.coalesce("oa", F.lit(0)))
    pb = F.col("pb").bitwiseXOR(F.coalesce("ob", F.lit(0)))
    return whole.select("conv_id", "n", "d", "chars", F.struct(pa.alias("a"), pb.alias("b")).alias("id"),
                        F.struct(pa.bitwiseXOR(F.col("a")).alias("a"),
                                 pb.bitwiseXOR(F.col("b")).alias("b")).alias("parent"))


def _root() -> Column:
    return F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))


def subtree_totals(nodes: DataFrame, weights: list[str]) -> DataFrame:
    """(id, weights): each weight summed over the node's subtree, itself included.

    ``nodes``: a forest as id, parent (null: a root), depth (rises towards the
    leaves), and the weights, longs. Ids are unique and of any type that joins.
    """
    carried = [f"carried_{w}" for w in weights]
    kids = nodes.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(
        F.count("*").alias("kids"))
    state = nodes.join(kids, "id", "left").select(
        "id", "parent", "depth", F.coalesce("kids", F.lit(0)).alias("kids"), *weights,
        *[F.lit(0).cast("long").alias(c) for c in carried])
    finals, rounds = [], []
    while True:
        state = written(state, "active")
        done, rest = state.filter("kids = 0"), state.filter("kids > 0")
        finals.append(done.select("id", *weights))
        if rest.isEmpty():
            break
        state, removed = _compressed(_raked(done, rest, weights, carried), weights, carried)
        rounds.append((removed, len(finals)))
    # the nodes taken out come back, last round first: each finds its child's total
    restored: list[DataFrame] = []
    for removed, at in reversed(rounds):
        later = reduce(DataFrame.unionByName, finals[at:] + restored)
        child = later.select(F.col("id").alias("kid"), *[F.col(w).alias(f"kid_{w}") for w in weights])
        restored.append(written(removed.join(child, "kid").select(
            "id", *[(F.col(w) + F.col(f"kid_{w}")).alias(w) for w in weights]), "restored"))
    return reduce(DataFrame.unionByName, finals + restored)


def _raked(done: DataFrame, rest: DataFrame, weights: list[str], carried: list[str]) -> DataFrame:
    """The nodes with children, after those without have been summed into them."""
    sums = done.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(
        F.count("*").alias("gone"),
        *[F.sum(F.col(w) + F.col(c)).alias(f"more_{w}") for w, c in zip(weights, carried, strict=True)])
    zero = F.lit(0)
    return rest.join(sums, "id", "left").select(
        "id", "parent", "depth", (F.col("kids") - F.coalesce("gone", zero)).alias("kids"),
        *[(F.col(w) + F.coalesce(f"more_{w}", zero)).alias(w) for w in weights], *carried)


def _compressed(nodes: DataFrame, weights: list[str],
                carried: list[str]) -> tuple[DataFrame, DataFrame]:
    """(nodes without an independent set of those with one child, that set).

    The set's rows: id, kid, and per weight what the node has besides its
    child's total.
    """
    unary = (F.col("kids") == 1) & F.col("parent").isNotNull()
    # of two neighbours the larger goes; odd depths first, then 2 mod 4 and so on
    rank = F.struct((-F.col("depth").bitwiseAND(-F.col("depth"))).alias("bit"),
                    F.xxhash64("id").alias("hash"))
    marked = nodes.withColumn("unary", unary).withColumn("rank", rank)
    kid = marked.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(
        F.count("*").alias("n"),
        F.max(F.struct("unary", "rank", F.col("id").alias("kid"), *carried)).alias("k")).filter(
        "n = 1").select("id", "k")
    chain = marked.filter("unary").join(kid, "id")
    lost = chain.filter("k.unary and rank > k.rank").select(F.col("k.kid").alias("id"))
    removed = written(
        chain.filter("not (k.unary and k.rank > rank)").join(lost, "id", "left_anti").select(
            "id", "parent", F.col("k.kid").alias("kid"),
            *[(F.col(w) + F.col(f"k.{c}")).alias(w) for w, c in zip(weights, carried, strict=True)],
            *[(F.col(w) + F.col(c)).alias(f"add_{c}") for w, c in zip(weights, carried, strict=True)]),
        "removed")
    moved = removed.select(F.col("kid").alias("id"), F.col("parent").alias("new_parent"),
                           *[f"add_{c}" for c in carried])
    left = nodes.join(removed.select("id"), "id", "left_anti").join(moved, "id", "left").select(
        "id", F.coalesce("new_parent", "parent").alias("parent"), "depth", "kids", *weights,
        *[(F.col(c) + F.coalesce(f"add_{c}", F.lit(0))).alias(c) for c in carried])
    return left, removed.select("id", "kid", *weights)


def _ends(members: DataFrame) -> DataFrame:
    """(id, ends_sha256) of the nodes at which conversations (id, conv_id) end.

    The decimal numbers are joined per cell of numbers, in parallel; a node's
    pieces then run through one digest in order, never held together.
    """
    pieces = members.groupBy("id", F.floor(F.col("conv_id") / CELL).alias("cell")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")),
                                 lambda c: c.cast("string")), ",").alias("piece"))

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, digest = None, None
        for batch in batches:
            out = []
            for a, b, piece in zip(batch["a"], batch["b"], batch["piece"], strict=True):
                if at == (a, b):
                    digest.update(b"," + piece.encode())
                    continue
                if at is not None:
                    out.append((*at, digest.hexdigest()))
                at, digest = (a, b), hashlib.sha256(piece.encode())
            yield pd.DataFrame(out, columns=["a", "b", "sha"])
        if at is not None:
            yield pd.DataFrame([(*at, digest.hexdigest())], columns=["a", "b", "sha"])

    dealt = pieces.select("id.a", "id.b", "cell", "piece").repartition("a", "b").sortWithinPartitions(
        "a", "b", "cell")
    return dealt.mapInPandas(digests, "a long, b long, sha string").select(
        F.struct("a", "b").alias("id"), F.col("sha").alias("ends_sha256"))


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    ``conversations``: conv_id, turn, role, text (other columns are ignored).
    Turns go by turn number, nulls first; equal numbers by role, the text's
    first characters and its digest, so that repeated rows are turns of their
    own. Null roles and texts are empty; rows without a conv_id belong to no
    conversation and are left out. No conversations: no rows, no root either.
    """
    convs, turns = rebuilt(conversations)
    paths = written(prefixes(turns), "paths")
    inner = paths.groupBy("id").agg(
        F.first("parent").alias("parent"), F.first("d").alias("depth"), F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"), F.first("chars").alias("chars"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter(
        "n_convs > 0").select(
        _root().alias("id"), F.lit(None).cast("struct<a:long,b:long>").alias("parent"),
        F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("chars"))
    plain = written(inner.unionByName(root), "nodes")
    kids = plain.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(
        F.count("*").alias("n_children"))
    nodes = written(plain.join(kids, "id", "left").select(
        "id", "parent", "depth", "conv_id", "n_convs",
        F.coalesce("n_children", F.lit(0)).alias("n_children"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens")), "nodes")
    totals = subtree_totals(nodes.select(
        "id", "parent", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
        "saved_tokens"), ["n_leaves", "saved_tokens"])
    ends = _ends(paths.filter("d = n").select("id", "conv_id").unionByName(
        convs.filter("n = 0").select(_root().alias("id"), "conv_id")))
    above = nodes.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return (nodes.drop("saved_tokens").join(totals, "id").join(ends, "id", "left")
            .join(above, "parent", "left").select(
                "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                "saved_tokens",
                F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")))


# crc32 of a short ASCII text, bit by bit (SQL has no such function)
CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT],
    list_transform(range(1, length({0}) + 1), lambda i: unicode(substr({0}, i, 1))::BIGINT)),
    lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)),
    4294967295)"""

ORACLE = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                                     coalesce(role, ''), coalesce(text, '')) AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
 c AS (SELECT conv_id, conv_id - conv_id % 100 AS first_id,
              {CRC32.format("CAST(conv_id AS VARCHAR)")} % 6 AS h
       FROM (SELECT DISTINCT conv_id FROM t)),
 k AS (SELECT c.*, (SELECT count(*) FROM t WHERE t.conv_id = c.first_id AND pos <= h) AS k FROM c),
 r AS (SELECT k.conv_id, pos AS d, role, text FROM k JOIN t ON t.conv_id = k.first_id AND pos <= k.h
       UNION ALL
       SELECT k.conv_id, pos - h + k.k, role, text FROM k JOIN t USING (conv_id) WHERE pos > h),
 p AS (SELECT conv_id, d, text, string_agg(sha256(length(role) || ':' || role || text), ',') OVER (
              PARTITION BY conv_id ORDER BY d) AS key FROM r
       UNION ALL SELECT conv_id, 0, '', '' FROM c),
 e AS (SELECT conv_id, max(d) AS n FROM p GROUP BY conv_id),
 node AS (SELECT key, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(length(text)) AS chars,
                 coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (d = n), '')
                     AS ends
          FROM p JOIN e USING (conv_id) GROUP BY key, d),
 edge AS (SELECT DISTINCT x.key AS up, y.key AS down
          FROM p x JOIN p y ON x.conv_id = y.conv_id AND y.d = x.d + 1),
 kid AS (SELECT up, count(*) AS n FROM edge GROUP BY up),
 below AS (SELECT DISTINCT x.key AS top, y.key AS key
           FROM p x JOIN p y ON x.conv_id = y.conv_id AND y.d >= x.d),
 total AS (SELECT top, CAST(sum((n_convs - 1) * chars) AS BIGINT) AS saved,
                  count(*) FILTER (kid.n IS NULL) AS leaves
           FROM below JOIN node ON node.key = below.key LEFT JOIN kid ON kid.up = below.key GROUP BY top)
SELECT node.conv_id, CAST(node.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, node.n_convs,
       coalesce(kid.n, 0) AS n_children, total.leaves AS n_leaves, total.saved AS saved_tokens,
       sha256(node.ends) AS ends_sha256
FROM node JOIN total ON total.top = node.key LEFT JOIN kid ON kid.up = node.key
     LEFT JOIN edge ON edge.down = node.key LEFT JOIN node up ON up.key = edge.up"""
