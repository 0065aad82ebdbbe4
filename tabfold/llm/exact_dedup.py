"""Exact duplicates by an exchange of Golomb-coded fingerprints.

1. One scan writes a narrow table: doc_id, 64-bit fingerprint and SHA-256 of
   the normalised text.
2. Each block of the narrow table sorts its distinct fingerprints, cuts them
   by owner (ranges of the fingerprint space) and sends every owner one
   Golomb-Rice coded gap list, plus a bitmap of those it holds twice itself.
3. An owner decodes the lists of its range, finds the fingerprints that come
   from two blocks or twice from one, and answers each list with a bitmap.
4. The bitmaps, laid over the lists they answer, give the suspects. Only
   documents with a suspect fingerprint are shuffled; grouping them by the
   text itself is the byte verification (and combines map-side, so a group of
   copies sends one row per task).
5. The row with the largest doc_id stays.

An owner gets one entry per block for a fingerprint, however many copies the
block holds, so a hot text doesn't swell its owner.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, unused, written

OWNER_ROWS = 1 << 17       # documents per owner
FILTER_SLOTS = 1 << 20     # bound of the broadcast pre-filter
MESSAGE = "block long, owner int, n int, k int, codes binary, twice binary"
ANSWER = "block long, owner int, n int, k int, codes binary, bitmap binary"


def rice_encode(sorted_values: np.ndarray) -> tuple[int, bytes]:
    """Golomb code (power-of-two parameter) of the gaps of an ascending uint64 array."""
    if len(sorted_values) == 0:
        return 0, b""
    gaps = np.diff(sorted_values, prepend=np.uint64(0))
    mean = max(1.0, float(sorted_values[-1]) / len(sorted_values))
    k = max(0, int(math.log2(mean)))
    quotient = (gaps >> np.uint64(k)).astype(np.int64)
    # unary part: quotient zeros, then a one; then the low k bits
    ends = np.cumsum(quotient + 1)
    unary = np.zeros(int(ends[-1]), np.uint8)
    unary[ends - 1] = 1
    low = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return k, np.packbits(np.concatenate([unary, low.ravel()])).tobytes()


def rice_decode(n: int, k: int, codes: bytes) -> np.ndarray:
    if n == 0:
        return np.empty(0, np.uint64)
    bits = np.unpackbits(np.frombuffer(codes, np.uint8))
    # the n-th one ends the unary part, which is at most 3n bits or so
    ones = np.flatnonzero(bits)[:n]
    quotient = np.diff(ones, prepend=-1) - 1
    low = bits[ones[-1] + 1: ones[-1] + 1 + n * k].reshape(n, k).astype(np.uint64)
    rest = (low << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum((quotient.astype(np.uint64) << np.uint64(k)) + rest, dtype=np.uint64)


def _owner_starts(owners: int) -> np.ndarray:
    return np.array([(i << 64) // owners for i in range(owners)], np.uint64)


def _messages(owners: int, block_rows: int):
    starts = _owner_starts(owners)

    def one_block(fps: np.ndarray, block: int):
        values, counts = np.unique(fps, return_counts=True)
        cut = np.append(np.searchsorted(values, starts), len(values))
        for o in range(owners):
            part = values[cut[o]:cut[o + 1]]
            if len(part):
                k, codes = rice_encode(part - starts[o])
                yield block, o, len(part), k, codes, np.packbits(counts[cut[o]:cut[o + 1]] > 1).tobytes()

    def run(batches):
        held, n, block = [], 0, None
        for b in batches:
            if not len(b):
                continue
            fps = b["fp"].to_numpy(np.int64).view(np.uint64)
            block = int(b["uid"].iloc[0]) if block is None else block
            held.append(fps)
            n += len(fps)
            if n >= block_rows:
                yield pd.DataFrame(list(one_block(np.concatenate(held), block)), columns=COLUMNS)
                held, n, block = [], 0, None
        if held:
            yield pd.DataFrame(list(one_block(np.concatenate(held), block)), columns=COLUMNS)

    COLUMNS = ["block", "owner", "n", "k", "codes", "twice"]
    return run


def _answers(messages: pd.DataFrame) -> pd.DataFrame:
    """One owner: which entries of each list are held elsewhere or twice."""
    messages = messages.sort_values("block")
    lists = [rice_decode(n, k, c) for n, k, c in
             zip(messages["n"], messages["k"], messages["codes"], strict=True)]
    twice = [np.unpackbits(np.frombuffer(t, np.uint8), count=n).astype(bool)
             for t, n in zip(messages["twice"], messages["n"], strict=True)]
    values, counts = np.unique(np.concatenate(lists), return_counts=True)
    repeated = np.union1d(values[counts > 1], np.concatenate(
        [v[t] for v, t in zip(lists, twice, strict=True)]))
    out = messages[["block", "owner", "n", "k", "codes"]].copy()
    out["bitmap"] = [np.packbits(np.isin(v, repeated, assume_unique=True)).tobytes() for v in lists]
    return out


def _suspects(owners: int):
    starts = _owner_starts(owners)

    def run(batches):
        for b in batches:
            for o, n, k, codes, bitmap in zip(b["owner"], b["n"], b["k"], b["codes"], b["bitmap"],
                                              strict=True):
                hit = np.unpackbits(np.frombuffer(bitmap, np.uint8), count=n).astype(bool)
                if hit.any():
                    fps = rice_decode(n, k, codes)[hit] + starts[o]
                    yield pd.DataFrame({"fp": fps.view(np.int64)})
    return run


def duplicate_groups(docs: DataFrame, narrow: DataFrame, owner_rows: int = OWNER_ROWS,
                     filter_slots: int = FILTER_SLOTS) -> DataFrame:
    """Verified groups of two or more equal texts: (fp, text_sha256, group_size)."""
    n_rows = narrow.count()
    owners = max(1, math.ceil(n_rows / owner_rows))
    sent = narrow.select("uid", "fp").mapInPandas(_messages(owners, owner_rows), MESSAGE)
    answered = sent.groupBy("owner").applyInPandas(_answers, ANSWER)
    suspects = written(answered.mapInPandas(_suspects(owners), "fp long").distinct(), "suspects")
    # at most filter_slots rows by construction: the only thing broadcast
    slots = suspects.select(F.pmod("fp", F.lit(filter_slots)).alias("slot")).distinct()
    keyed = docs.select(lower_ascii(F.col("text")).alias("norm")).withColumn("fp", F.xxhash64("norm"))
    likely = keyed.join(F.broadcast(slots), F.pmod("fp", F.lit(filter_slots)) == F.col("slot"),
                        "left_semi")
    verified = (likely.groupBy("fp", "norm").agg(F.count("*").alias("group_size"))
                .filter("group_size > 1")
                .select("fp", F.sha2(F.col("norm"), 256).alias("text_sha256"), "group_size"))
    return verified.join(suspects, "fp", "left_semi")


def fingerprints(docs: DataFrame) -> DataFrame:
    """The narrow table: uid (frozen row number), doc_id, fp, text_sha256."""
    return written(
        docs.select("doc_id", lower_ascii(F.col("text")).alias("norm"))
        .select(F.monotonically_increasing_id().alias("uid"), "doc_id",
                F.xxhash64("norm").alias("fp"), F.sha2(F.col("norm"), 256).alias("text_sha256")),
        "fingerprints")


def keepers(docs: DataFrame, narrow: DataFrame, **params) -> DataFrame:
    """One row per group of copies: fp, text_sha256, group_size, keep_id, keep_uid, same (rows of
    the kept id).

    Copies are summed up before they meet, so a hot text sends one row per task.
    """
    groups = duplicate_groups(docs, narrow, **params)
    summed = (narrow.groupBy("fp", "text_sha256", "doc_id")
              .agg(F.count("*").alias("n"), F.max("uid").alias("uid")))
    largest = narrow.groupBy("fp", "text_sha256").agg(
        F.count("*").alias("n"), F.max("doc_id").alias("keep_id"))
    repeated = largest.filter("n > 1").drop("n").join(groups, ["fp", "text_sha256"])
    at = repeated.select(F.col("fp").alias("_f"), F.col("text_sha256").alias("_s"), "keep_id",
                         "group_size")
    return (summed.join(at, (F.col("fp") == F.col("_f")) & (F.col("text_sha256") == F.col("_s"))
                        & F.col("doc_id").eqNullSafe(F.col("keep_id")))
            .select("fp", "text_sha256", "group_size", "keep_id", F.col("uid").alias("keep_uid"),
                    F.col("n").alias("same")))


def exact_dedup(docs: DataFrame, **params) -> DataFrame:
    """One row per document row: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty. Texts are equal when identical after
    lower-casing A-Z. The largest doc_id stays (a null id is the smallest);
    of repeated rows with that id one stays. Other columns are ignored.
    """
    narrow = fingerprints(docs)
    groups = written(keepers(docs, narrow, **params), "groups")
    joined = narrow.join(groups, ["fp", "text_sha256"], "left")
    single = F.col("keep_uid").isNull()
    return joined.select(
        "doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("uid") == F.col("keep_uid"))).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame, **params) -> DataFrame:
    """The documents that stay, all columns unchanged."""
    narrow = fingerprints(docs)
    groups = written(keepers(docs, narrow, **params), "groups")
    # a group whose kept id comes in repeated rows is settled row by row below
    fp, sha, keep_id, repeated = (unused(docs, n) for n in ("_fp", "_sha", "_keep", "_repeated"))
    keep = groups.select(F.col("fp").alias(fp), F.col("text_sha256").alias(sha),
                         F.col("keep_id").alias(keep_id), (F.col("same") > 1).alias(repeated))
    norm = lower_ascii(docs["text"])
    tagged = docs.join(keep, (F.xxhash64(norm) == F.col(fp)) & (F.sha2(norm, 256) == F.col(sha)),
                       "left").filter(F.col(fp).isNull() | docs["doc_id"].eqNullSafe(F.col(keep_id)))
    again = F.coalesce(repeated, F.lit(False))
    settled = tagged.filter(again).dropDuplicates([fp, sha])
    return tagged.filter(~again).unionByName(settled).drop(fp, sha, keep_id, repeated)
