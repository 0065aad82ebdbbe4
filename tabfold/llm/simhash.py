"""SimHash near-duplicates through vantage-point trees.

1. Fingerprints (64 bits) of all documents, reduced to the distinct ones.
2. A vantage-point tree, fitted on a bounded sample, deals the distinct
   fingerprints to shards. At a node with vantage point v and radius m a
   point at distance d goes inside when d <= m and outside when d > m; points
   with m < d <= m + r lie at the boundary and go to both. By the triangle
   inequality two points at most r apart have distances to v at most r apart:
   if one is inside, the other has d <= m + r; so they meet in some shard.
3. Each shard grows its own tree by the same rule down to small leaves, and
   compares all pairs of a leaf. A leaf reports a spanning star of each of its
   components, not its pairs, so a large group of near copies gives as many
   links as it has points.
4. Components are joined across shards by alternating large and small stars
   on DataFrames, each round written to the shared folder.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_hash, written

SHINGLE = 3
MAX_DISTANCE = 2
SEED = 42
SHARD_POINTS = 1 << 13    # distinct fingerprints of a shard, about
SAMPLE_POINTS = 1 << 15   # fingerprints that fit the top tree, at most
LEAF_POINTS = 512
CANDIDATES = 8            # vantage points tried for a node
BLOCK = 1024              # rows of a comparison at once
CHUNK_SHINGLES = 1 << 16


def fingerprint_text(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash; bit i is set when more than half of the shingle hashes have it."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    if len(tokens) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(tokens), SEED)
    ones, n = np.zeros(64, np.int64), len(tokens) - shingle + 1
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, n, CHUNK_SHINGLES):
        part = tokens[at: min(at + CHUNK_SHINGLES, n) + shingle - 1]
        hashes = [digest(join(s), SEED) for s in zip(*(part[i:] for i in range(shingle)))]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1,
                             bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprinter(shingle: int = SHINGLE):
    """Column function text -> fingerprint as signed long."""
    @F.pandas_udf("long")
    def fingerprint(text: pd.Series) -> pd.Series:
        values = np.fromiter((fingerprint_text(t, shingle) for t in text), np.uint64, len(text))
        return pd.Series(values.view(np.int64))
    return fingerprint


def _split(points: np.ndarray, r: int, rng) -> tuple[int, int] | None:
    """Vantage point and radius that send the fewest points to the fuller side, or None.

    Tried on a few of the points; a split that leaves a side (almost) as full
    as the node is none.
    """
    probe = points if len(points) <= 4096 else points[rng.integers(0, len(points), 4096)]
    best = None
    for v in probe[rng.integers(0, len(probe), CANDIDATES)]:
        d = np.bincount(np.bitwise_count(probe ^ v), minlength=66)
        upto = np.cumsum(d)
        m = np.arange(64)
        inside = upto[np.minimum(m + r, 65)]
        outside = len(probe) - upto[m]
        # the whole work below is about the sum of squares of both sides
        cost = inside.astype(np.float64) ** 2 + outside.astype(np.float64) ** 2
        at = int(cost.argmin())
        if best is None or cost[at] < best[0]:
            best = cost[at], int(v), at
    if best is None or best[0] > 0.85 * float(len(probe)) ** 2:
        return None
    return best[1], best[2]


def _sides(points: np.ndarray, v: int, m: int, r: int) -> tuple[np.ndarray, np.ndarray]:
    d = np.bitwise_count(points ^ np.uint64(v))
    return d <= m + r, d > m


def top_tree(sample: np.ndarray, leaves: int, r: int) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage, radius, inside, outside); a negative child -s-1 is shard s."""
    rng = np.random.default_rng(7)
    nodes: list = []
    least = max(2, len(sample) // max(leaves, 1))
    shards = 0

    def grow(points):
        nonlocal shards
        split = _split(points, r, rng) if len(points) > least else None
        if split is None:
            shards += 1
            return -shards
        at = len(nodes)
        nodes.append(None)
        inside, outside = _sides(points, *split, r)
        a, b = grow(points[inside]), grow(points[outside])
        nodes[at] = (*split, a, b)
        return at

    grow(np.unique(sample))
    return nodes


def _deal(nodes, r: int):
    """mapInPandas function: fp -> (shard, fp), boundary points to several shards."""
    def run(batches):
        for b in batches:
            todo = [(0 if nodes else -1, b["fp"].to_numpy(np.int64).view(np.uint64))]
            while todo:
                at, points = todo.pop()
                if not len(points):
                    continue
                if at < 0:
                    yield pd.DataFrame({"shard": -at - 1, "fp": points.view(np.int64)})
                    continue
                v, m, a, c = nodes[at]
                inside, outside = _sides(points, v, m, r)
                todo += [(a, points[inside]), (c, points[outside])]
    return run


def _leaf_stars(points: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
    """(point, its component's smallest point) for the components of the leaf with links."""
    points = np.sort(points)
    label = np.arange(len(points))
    linked = []
    for i in range(0, len(points), BLOCK):
        for j in range(i, len(points), BLOCK):
            near = np.bitwise_count(points[i:i + BLOCK, None] ^ points[None, j:j + BLOCK]) <= r
            if i == j:
                near = np.triu(near, 1)
            a, b = np.nonzero(near)
            if len(a):
                # within a block pair, a spanning subset suffices
                linked.append(_spanning(a + i, b + j, label))
    roots = _roots(label)
    moved = np.flatnonzero(roots != np.arange(len(points)))
    return points[moved], points[roots[moved]]


def _roots(label: np.ndarray) -> np.ndarray:
    while True:
        up = label[label]
        if np.array_equal(up, label):
            return label
        label[:] = up


def _spanning(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> None:
    """Join the components of linked points: labels fall to the smaller until all agree."""
    while True:
        _roots(label)
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))


def shard_links(points: np.ndarray, r: int, leaf: int = LEAF_POINTS):
    """Links (fp, smaller fp) that connect all pairs within r, by a local tree, depth first."""
    rng = np.random.default_rng(11)
    todo = [np.unique(points)]
    while todo:
        now = todo.pop()
        split = _split(now, r, rng) if len(now) > leaf else None
        if split is None:
            yield _leaf_stars(now, r)
            continue
        inside, outside = _sides(now, *split, r)
        todo += [now[inside], now[outside]]


def near_links(fps: DataFrame, r: int = MAX_DISTANCE, shard_points: int = SHARD_POINTS) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect all pairs within r."""
    n = fps.count()
    share = min(1.0, SAMPLE_POINTS / max(n, 1))
    sample = fps.filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = sample.limit(2 * SAMPLE_POINTS).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    nodes = top_tree(sample, math.ceil(n / shard_points), r)
    shards = fps.mapInPandas(_deal(nodes, r), "shard int, fp long")

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        pairs = list(shard_links(rows["fp"].to_numpy(np.int64).view(np.uint64), r))
        a = np.concatenate([p[0] for p in pairs] or [np.empty(0, np.uint64)])
        b = np.concatenate([p[1] for p in pairs] or [np.empty(0, np.uint64)])
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return shards.groupBy("shard").applyInPandas(link, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for the nodes of links (a, b): root is the smallest node reachable.

    Large star and small star by turns; a round moves each node under the
    smallest neighbour. Only rows that combine map-side or that a join can
    split are dealt by node.
    """
    edges = written(links.filter("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u").alias("x"), F.least("u", "m").alias("m"))
        # large star: larger neighbours go under the smallest
        large = (both.join(low, F.col("u") == F.col("x")).filter("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: smaller neighbours and the node itself go under the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.select(F.col("u").alias("x"), "m"), F.col("u") == F.col("x"))
        moved = (small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v")))
                 .filter("u <> v").distinct())
        edges = written(moved, "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, r: int = MAX_DISTANCE,
                    shard_points: int = SHARD_POINTS) -> DataFrame:
    """One row per document row: doc_id, text_hash, fingerprint, component_id, kept.

    Texts without words (null, empty, blanks) have fingerprint zero and link
    like any other. ``component_id`` is the smallest doc_id reachable; a null
    id counts only where a component has no other. ``kept`` marks one row key
    (doc_id, text_hash) per component: the smallest. Other columns are ignored.
    """
    narrow = written(docs.select("doc_id", text_hash(F.col("text")).alias("text_hash"),
                                 fingerprinter(shingle)(F.col("text")).alias("fp")), "simhash")
    lowest = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "text_hash"))
    fps = written(narrow.groupBy("fp").agg(lowest.alias("low")), "distinct")
    roots = components(near_links(fps.select("fp"), r, shard_points))
    # component of each distinct fingerprint, and the component's smallest row key
    placed = fps.join(roots, fps["fp"] == roots["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "low")
    best = placed.groupBy("root").agg(F.min("low").alias("best"))
    members = written(placed.select("fp", "root").join(best, "root").select("fp", "best"), "members")
    return narrow.join(members, "fp").select(
        "doc_id", "text_hash", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("best.doc_id").alias("component_id"),
        (F.col("best.doc_id").eqNullSafe(F.col("doc_id"))
         & (F.col("best.text_hash") == F.col("text_hash"))).alias("kept"))
