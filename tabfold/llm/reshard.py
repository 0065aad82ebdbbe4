"""Resharding by minimum-cost flow.

Given the shard that each row is in now and the capacity of each new shard (row counts at
most one apart), choose which rows move so that the fewest bytes do. Rows of a
shard with about the same size make a block. The flow network:

    source -> block (its rows) -> its own shard, cost 0      (the row stays)
                               -> moving, cost mean bytes    (the row moves)
              moving -> any shard, cost 0
    shard -> sink: capacity floor(n / shards); one more for n mod shards of them

Since a row's cost to move doesn't depend on where it goes, the middle node
stands for all block-to-shard edges; the flow through it is dealt to the
shards that lack rows. The network has shards x size classes blocks, however
many rows there are. Ranks within blocks turn the flow into rows; only moved
rows change shard.
"""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unused, with_rank, written

SHARDS = 40
OLD_SHARDS = 32
ROW_BYTES = 16
SIZE_CLASSES = 24


class Flow:
    """Minimum-cost flow by successive shortest paths."""

    def __init__(self, n: int):
        self.edges: list[list] = []            # to, room, cost
        self.out: list[list[int]] = [[] for _ in range(n)]

    def add(self, a: int, b: int, room: int, cost: float) -> int:
        self.out[a].append(len(self.edges))
        self.edges.append([b, room, cost])
        self.out[b].append(len(self.edges))
        self.edges.append([a, 0, -cost])
        return len(self.edges) - 2

    def sent(self, edge: int) -> int:
        return self.edges[edge ^ 1][1]

    def run(self, s: int, t: int) -> None:
        while True:
            dist, via, queued = {s: 0.0}, {}, {s}
            todo = deque([s])
            while todo:
                a = todo.popleft()
                queued.discard(a)
                for e in self.out[a]:
                    b, room, cost = self.edges[e]
                    if room > 0 and dist[a] + cost < dist.get(b, float("inf")) - 1e-9:
                        dist[b], via[b] = dist[a] + cost, e
                        if b not in queued:
                            queued.add(b)
                            todo.append(b)
            if t not in dist:
                return
            path, at = [], t
            while at != s:
                path.append(via[at])
                at = self.edges[via[at] ^ 1][0]
            room = min(self.edges[e][1] for e in path)
            for e in path:
                self.edges[e][1] -= room
                self.edges[e ^ 1][1] += room


def solve(blocks: list[tuple[int, int, int, int]], shards: int) -> tuple[dict, list[tuple[int, int]]]:
    """blocks: (old shard, size class, rows, bytes). An old shard number below ``shards`` is that
    new shard as well; rows of any other old shard all move.

    Returns rows that stay by (old shard, size class), and how many moved rows
    each shard takes [(shard, rows)].
    """
    total = sum(b[2] for b in blocks)
    low, extra = divmod(total, shards)
    middle, first_shard, source, sink = len(blocks), len(blocks) + 1, len(blocks) + 1 + shards, \
        len(blocks) + 3 + shards
    spare = sink - 1                     # shards with one row more
    flow = Flow(sink + 1)
    stay = {}
    for i, (old, size_class, rows, size) in enumerate(blocks):
        flow.add(source, i, rows, 0)
        if 0 <= old < shards:
            stay[old, size_class] = flow.add(i, first_shard + old, rows, 0)
        flow.add(i, middle, rows, size / rows)
    take = [flow.add(middle, first_shard + j, total, 0) for j in range(shards)]
    for j in range(shards):
        flow.add(first_shard + j, sink, low, 0)
        flow.add(first_shard + j, spare, 1, 0)
    flow.add(spare, sink, extra, 0)
    flow.run(source, sink)
    return ({k: flow.sent(e) for k, e in stay.items()},
            [(j, flow.sent(e)) for j, e in enumerate(take) if flow.sent(e)])


def _size():
    return F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES


def old_layout(doc_id, shards: int = OLD_SHARDS):
    """The layout that a table without one is taken to have: by hash of the id."""
    return F.pmod(F.xxhash64(doc_id), F.lit(shards)).cast("int")


def reshard(docs: DataFrame, shards: int = SHARDS, old_shard=None) -> DataFrame:
    """One row per document row: doc_id, size, text_crc32, law, old_shard, shard, slot, grown_shard.

    ``old_shard`` is a column of the present shard (null: in none, so it
    moves). A null text has no bytes; its crc32 is that of the empty string.
    Repeated rows are placed one by one; an empty table gives no rows.
    """
    old = old_layout(F.col("doc_id")) if old_shard is None else old_shard
    size = _size()
    narrow = written(docs.select(
        F.monotonically_increasing_id().alias("uid"), "doc_id", size.cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.coalesce(old.cast("int"), F.lit(-1)).alias("old_shard"),
        F.least(F.floor(F.log2(size)), F.lit(SIZE_CLASSES)).cast("int").alias("size_class")), "rows")
    blocks = [tuple(r) for r in narrow.groupBy("old_shard", "size_class").agg(
        F.count("*").alias("n"), F.sum("size").alias("b")).orderBy("old_shard", "size_class").collect()]
    stays, takes = solve(blocks, shards)
    total = sum(b[2] for b in blocks)
    spark = docs.sparkSession

    # within a block the first ranks stay; all movers are ranked and dealt to shards in order
    keep = spark.createDataFrame([(o, c, stays.get((o, c), 0)) for o, c, _, _ in blocks],
                                 "old_shard int, size_class int, stay long")
    ranked = with_rank(narrow, ["old_shard", "size_class"], [], "uid", total)
    marked = ranked.join(F.broadcast(keep), ["old_shard", "size_class"]).withColumn(
        "moves", F.col("rank") >= F.col("stay"))
    # a mover's place among all: its block's first mover, then its rank
    first, at = [], 0
    for o, c, n, _ in blocks:
        first.append((o, c, at - stays.get((o, c), 0)))
        at += n - stays.get((o, c), 0)
    firsts = spark.createDataFrame(first, "old_shard int, size_class int, first long") if first else \
        spark.createDataFrame([], "old_shard int, size_class int, first long")
    ends = np.cumsum([n for _, n in takes]).tolist()
    target = F.lit(None).cast("int")
    for (j, _), end in reversed(list(zip(takes, ends, strict=True))):
        target = F.when(F.col("first") + F.col("rank") < end, F.lit(j)).otherwise(target)
    placed = marked.join(F.broadcast(firsts), ["old_shard", "size_class"]).withColumn(
        "shard", F.when(F.col("moves"), target).otherwise(F.col("old_shard")))
    placed = written(placed.select("uid", "doc_id", "size", "text_crc32", "old_shard", "shard"), "placed")
    return with_rank(placed, ["shard"], [], "uid", total, "slot").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "old_shard", "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def rewrite(docs: DataFrame, placed: DataFrame, path: str) -> list[int]:
    """Rewrite, under ``path`` (partitioned by shard), the shards that gain or lose rows.

    ``placed``: what ``reshard`` gives for ``docs``; ids may be null or repeated. Shards that keep
    their rows are left as they are, but one without a folder is written, and a folder that
    ends without rows is deleted. Returns the rewritten shards.

    A row is found by id, size and crc32 of its text. Rows that share these are
    interchangeable inside one old shard; if they lie in several, these are
    rewritten together. Only those with several targets are ranked.
    """
    spark = docs.sparkSession
    key = ["doc_id", "size", "text_crc32"]
    placed = written(placed.select(F.monotonically_increasing_id().alias("uid"), *key,
                                   "old_shard", "shard"), "moves")
    total = placed.count()
    pairs = placed.groupBy("old_shard", "shard").count().collect()
    targets = {r["shard"] for r in pairs}
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())

    def folder(name):
        return spark._jvm.org.apache.hadoop.fs.Path(at, f"shard={name}")

    touched = {s for r in pairs if r["old_shard"] != r["shard"] for s in (r["old_shard"], r["shard"])}
    touched |= {s for s in targets if not fs.exists(folder(s))}
    both = F.array_union(F.collect_set("old_shard"), F.collect_set("shard"))
    tied = placed.groupBy(*key).agg(both.alias("s"), F.min("old_shard").alias("a"),
                                    F.max("old_shard").alias("b")).filter("a <> b")
    links = [tuple(r) for r in tied.select(F.col("s")[0], F.explode("s")).distinct().collect()]
    while more := {s for e in links if touched & set(e) for s in e} - touched:
        touched |= more

    names = {c: unused(docs, f"_{c}") for c in (*key, "uid", "rank")}
    keyed = docs.drop("shard").withColumns({
        names["doc_id"]: F.col("doc_id"), names["size"]: _size().cast("long"),
        names["text_crc32"]: F.crc32(F.coalesce("text", F.lit("")))})

    def same(left, right, columns):
        on = [left[names[c]].eqNullSafe(right[c]) for c in columns]
        return left.join(right, on).drop(*[right[c] for c in columns])

    goal = placed.groupBy(*key).agg(F.min("shard").alias("shard"), F.max("shard").alias("last"))
    rows = same(keyed, goal.filter((F.col("shard") == F.col("last"))
                                   & F.col("shard").isin(list(touched))).drop("last"), key)
    several = written(goal.filter("shard <> last").select(*key), "several")
    if not several.isEmpty():
        twins = written(same(keyed, several, key).withColumn(
            names["uid"], F.monotonically_increasing_id()), "twins")
        there = [placed[c].eqNullSafe(several[c]) for c in key]
        ranked = with_rank(placed.join(several, there, "left_semi"), key, [], "uid", total)
        own = with_rank(twins.select(names["uid"], *[names[c] for c in key]), [names[c] for c in key],
                        [], names["uid"], total, names["rank"])
        target = same(own, ranked.select(*key, "rank", "shard"), [*key, "rank"]).select(
            names["uid"], "shard").filter(F.col("shard").isin(list(touched)))
        rows = rows.unionByName(twins.join(target, names["uid"]).drop(names["uid"]))
    (rows.drop(*names.values()).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("shard").parquet(path))
    for s in touched - targets:
        fs.delete(folder(s), True)
        if s == -1:
            fs.delete(folder("__HIVE_DEFAULT_PARTITION__"), True)
    return sorted(touched)
