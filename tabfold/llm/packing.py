"""Best-fit packing by length patterns and non-negative least squares.

Documents are tokenised once into pieces of at most ``capacity`` tokens; the
pieces' lengths make a histogram of at most ``capacity`` bins, all that the
driver sees. Patterns of few lengths that fill a sequence are enumerated over
it, their repeat counts are fitted to the histogram by non-negative least
squares and rounded, and what remains is packed best-fit, largest first, whole
bins at a time; a plan is never longer than best-fit's alone. The plan - patterns with their
repeat counts - is laid over the pieces by rank within each length.
"""

from __future__ import annotations

import bisect
import math
import re
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_rank, written

CAPACITY = 4096
END_ID = 1
MEMO_WORDS = 400_000
MAX_DOCS = 8            # pieces in a balanced pattern, at most
# shares of the room left that the next pieces of a pattern take
SHARES = ((), (0.3,), (0.5,), (0.7,), (1 / 3, 0.5), (0.5, 0.5), (0.25, 1 / 3, 0.5))
AWAY = (0.0, 0.15, 0.4)
FILLS = (0.999, 0.995, 0.98, 0.0)
ROUNDS = 3
NNLS_STEPS = 300
WASTE = 1.0             # cost of an empty sequence, in mean counts of a length
STOP = 1e-6             # a step's movement, as a share of all pieces, that ends the fit
PIECE = "array<struct<piece:int,start:long,length:long,ids_crc32:long>>"

# the tokenizer's own splitting pattern, for Latin-1 text in lower case
_LETTER = rb"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_NUMBER = rb"0-9\xb2\xb3\xb9\xbc-\xbe"
_SPLIT = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[" + _LETTER + rb"]+|[" + _NUMBER + rb"]|[^ "
                    + _LETTER + _NUMBER + rb"]+")
_PLAIN = re.compile(rb"[^\t\n\r\x20-\x7e\xa1-\xff]")
_LOWER = bytes(32 if b in (9, 10, 13) else ord(chr(b).lower()) if ord(chr(b).lower()) < 256 else b
               for b in range(256))
_SPECIAL = re.compile(rb"<\|(?:startoftext|endoftext)\|>")


class Words(dict):
    """Latin-1 word -> its ids as bytes; starts afresh when full.

    A word is one pre-token, and goes to the tokenizer's model at once, in the
    characters that its pre-tokenizer makes of it: most words are met once or
    twice, and the steps around the model cost more than the model.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.written = {n: "".join(part for part, _ in tokenizer.pre_tokenizer.pre_tokenize_str(chr(n)))
                        for n in range(33, 256) if not 126 < n < 161}

    def __missing__(self, word: bytes) -> bytes:
        ids = [token.id for token in self.model.tokenize(word.decode("latin-1").translate(self.written))]
        if len(self) >= MEMO_WORDS:
            self.clear()
        out = self[word] = struct.pack(f"<{len(ids)}I", *ids)
        return out


def encode(text: str | None, words: Words) -> bytes:
    """The document's ids as little-endian 32-bit, END_ID last.

    The tokenizer works word by word, so words of plain Latin-1 text are
    looked up; any other text goes through the tokenizer whole.
    """
    text = text or ""
    try:
        raw = text.encode("latin-1")
        plain = not _PLAIN.search(raw) and not _SPECIAL.search(raw)
    except UnicodeEncodeError:
        plain = False
    if plain:
        body = b"".join([words[w] for w in _SPLIT.findall(raw.translate(_LOWER))])
    else:
        ids = words.tokenizer.encode(text, add_special_tokens=False).ids
        body = np.array(ids, "<u4").tobytes()
    return body + END_ID.to_bytes(4, "little")


def tokenised(docs: DataFrame, tokenizer_path: str | None = None,
              capacity: int = CAPACITY) -> DataFrame:
    """Rows (uid, doc_id, piece, start, length, ids_crc32), written once.

    ``tokenizer_path`` None: the public word_bpe_49k.json, found on each worker.
    """
    @F.pandas_udf(PIECE)
    def cut(text: pd.Series) -> pd.Series:
        words = _words(tokenizer_path)
        out = []
        for t in text:
            ids = encode(t, words)
            n = len(ids) // 4
            out.append([(i, at, min(capacity, n - at), zlib.crc32(ids[4 * at:4 * (at + capacity)]))
                        for i, at in enumerate(range(0, n, capacity))])
        return pd.Series(out)

    pieces = docs.select("doc_id", cut(F.col("text")).alias("p")).select("doc_id", F.inline_outer("p"))
    return written(pieces.select(F.monotonically_increasing_id().alias("uid"), "*"), "pieces")


_LOADED: dict = {}


def _words(path: str | None) -> Words:
    if path not in _LOADED:
        import os

        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path is None:
            import public_tokenizers
            name = public_tokenizers.path("word_bpe_49k.json")
        else:
            name = path
        _LOADED[path] = Words(Tokenizer.from_file(name))
    return _LOADED[path]


def _enumerate(counts: np.ndarray, capacity: int) -> list[tuple[int, ...]]:
    """Patterns of one to MAX_DOCS present lengths; a few for each first length, none left out after.

    Full ones: the rest of a sequence is cut into even or skewed shares, and each
    share takes the largest present length that fits. Balanced ones: where lengths
    lie close together no pattern is full, and a long piece has to go with one as
    much shorter than the mean, so that a sequence takes as many pieces as the
    mean allows.
    """
    lengths = np.flatnonzero(counts).tolist()
    if not lengths:
        return []
    found: set[tuple[int, ...]] = set()

    def largest(limit):
        at = bisect.bisect_right(lengths, limit) - 1
        return lengths[at] if at >= 0 else None

    def full(a, shares):
        out, room = [a], capacity - a
        for share in shares:
            b = largest(int(room * share))
            if b is None:
                break
            out.append(b)
            room -= b
        while len(out) < MAX_DOCS and (b := largest(room)) is not None:
            out.append(b)
            room -= b
        found.add(tuple(sorted(out, reverse=True)))

    mean = float((counts * np.arange(len(counts))).sum() / counts.sum())
    pieces = int(capacity // mean)

    def nearest(x):
        at = bisect.bisect_left(lengths, x)
        return min(lengths[max(0, at - 1):at + 1], key=lambda n: abs(n - x))

    def balanced(a, others):
        if pieces % 2:
            b, *others = others
            out = [a, b, nearest(3 * mean - a - b)]
        else:
            out = [a, nearest(2 * mean - a)]
        for b in others:
            out += [b, nearest(2 * mean - b)]
        if sum(out) <= capacity:
            found.add(tuple(sorted(out, reverse=True)))

    for i, a in enumerate(lengths):
        for shares in SHARES:
            full(a, shares)
        if 2 <= pieces <= MAX_DOCS:
            # beside it the same pair again, or pairs from so far along the range
            for away in AWAY:
                balanced(a, [lengths[(i + int(away * (j + 1) * len(lengths))) % len(lengths)]
                             for j in range((pieces - 1) // 2)])
    return sorted(found, reverse=True)


def nnls(patterns: list[tuple[int, ...]], counts: np.ndarray, steps: int = NNLS_STEPS,
         waste: np.ndarray | float = 0.0) -> np.ndarray:
    """Repeat counts x >= 0 that bring the patterns' lengths near the histogram.

    Projected gradient (accelerated, started anew when it turns back) on
    |A x - h|^2 / 2 + waste . x with the sparse pattern matrix A; of plans that fit
    alike, the one that wastes least room has the fewest sequences. A's entries aren't negative, so
    a column's row sum in A'A bounds its curvature, and gives each its own step.
    """
    if not patterns:
        return np.empty(0)
    col = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    row = np.fromiter((n for p in patterns for n in p), np.int64, len(col))
    n, k = len(counts), len(patterns)
    step = 1.0 / np.maximum(1.0, np.bincount(col, np.bincount(row, minlength=n)[row], minlength=k))
    h = counts.astype(np.float64)
    x = np.zeros(k)
    y, t, least = x, 1.0, STOP * max(1.0, np.abs(h).sum())
    for _ in range(steps):
        rest = np.bincount(row, y[col], minlength=n) - h
        new = np.maximum(0.0, y - step * (np.bincount(col, rest[row], minlength=k) + waste))
        moved = new - x
        if np.dot((y - new) / step, moved) > 0:
            t = 1.0
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        y = np.maximum(0.0, new + (t - 1) / t_new * moved)
        x, t = new, t_new
        if np.abs(moved).sum() < least:
            break
    return x


def _take(patterns, fitted, counts, capacity, fill) -> tuple[list[tuple[int, tuple[int, ...]]], np.ndarray]:
    """The rounded repeats of the patterns filled to ``fill``, fullest first, and what is left."""
    counts = counts.copy()
    plan = []
    for i in np.flatnonzero(fitted).tolist():
        if sum(patterns[i]) < fill * capacity:
            break
        lens, times = np.unique(patterns[i], return_counts=True)
        # never more than the histogram holds
        r = int(min(fitted[i], (counts[lens] // times).min()))
        if r > 0:
            counts[lens] -= r * times
            plan.append((r, patterns[i]))
    return plan, counts


def pack_histogram(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """A plan [(repeats, lengths)] that uses every piece of the histogram exactly once.

    Each round fits patterns to what is left, and keeps their rounded repeats at
    the least fill whose plan, with the residuals best-fit, has the fewest
    sequences. No round makes the plan longer than best-fit alone.
    """
    counts = counts.astype(np.int64).copy()
    plan: list[tuple[int, tuple[int, ...]]] = []
    full = int(counts[capacity]) if len(counts) > capacity else 0
    if full:
        plan.append((full, (capacity,)))
        counts[capacity] = 0

    def sequences(p):
        return sum(r for r, _ in p)

    rest = _best_fit(counts, capacity)
    for _ in range(ROUNDS):
        used = int((counts * np.arange(len(counts))).sum())
        if sequences(rest) <= -(-used // capacity):
            break       # no plan is shorter
        patterns = sorted(_enumerate(counts, capacity), key=lambda p: (-sum(p), p))
        # rounded so that the running total never strays by one
        waste = WASTE * counts[counts > 0].mean() * (1 - np.array([sum(p) for p in patterns]) / capacity)
        x = nnls(patterns, counts, waste=waste)
        fitted = np.diff(np.floor(np.cumsum(x) + 0.5), prepend=0.0).astype(np.int64)
        tried = []
        for fill in FILLS:
            taken, left = _take(patterns, fitted, counts, capacity, fill)
            tried.append((taken, left, _best_fit(left, capacity)))
        taken, left, after = min(tried, key=lambda c: sequences(c[0]) + sequences(c[2]))
        if sequences(taken) + sequences(after) >= sequences(rest):
            break
        plan += taken
        counts, rest = left, after
    return plan + rest


def _best_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best-fit decreasing over bins of equal pieces; open sequences are kept by free room."""
    open_: dict[int, list[list]] = {}       # room -> [[repeats, lengths]]
    rooms: list[int] = []                   # sorted keys of open_

    def put(room, repeats, lengths):
        if room not in open_:
            open_[room] = []
            bisect.insort(rooms, room)
        open_[room].append([repeats, lengths])

    for length in range(len(counts) - 1, 0, -1):
        left = int(counts[length])
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                whole, part = divmod(left, each)
                if whole:
                    put(capacity - each * length, whole, (length,) * each)
                if part:
                    put(capacity - part * length, 1, (length,) * part)
                break
            room = rooms[at]
            group = open_[room][-1]
            each = min(room // length, left)
            used = min(group[0], left // each)
            if used == group[0]:
                open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
            else:
                group[0] -= used
            put(room - each * length, used, group[1] + (length,) * each)
            left -= used * each
    return [(r, p) for groups in open_.values() for r, p in groups]


def slots(plan: list[tuple[int, tuple[int, ...]]]) -> pd.DataFrame:
    """Per (pattern, length): which ranks of the length it takes, and where they go.

    Columns length, first, last (ranks, end exclusive), times, sequence, offset.
    """
    rows, taken, sequence = [], {}, 0
    for repeats, lengths in plan:
        offset = 0
        runs: dict[int, int] = {}
        for n in lengths:
            runs[n] = runs.get(n, 0) + 1
        for n in sorted(runs, reverse=True):
            first = taken.get(n, 0)
            taken[n] = first + repeats * runs[n]
            rows.append((n, first, taken[n], runs[n], sequence, offset))
            offset += n * runs[n]
        sequence += repeats
    return pd.DataFrame(rows, columns=["length", "first", "last", "times", "sequence", "offset"])


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty: its one piece is the end id alone. Repeated rows are
    packed like any others; an empty table gives no rows.
    """
    pieces = tokenised(docs, tokenizer_path, capacity)
    histogram = pieces.groupBy("length").agg(F.count("*").alias("n")).toPandas()
    counts = np.zeros(capacity + 1, np.int64)
    counts[histogram["length"].to_numpy(np.int64)] = histogram["n"].to_numpy(np.int64)
    plan = slots(pack_histogram(counts, capacity))
    spark = docs.sparkSession
    ranked = with_rank(pieces, ["length"], ["piece"], "uid", int(counts.sum()))
    # plan rows are bounded by patterns x lengths, whatever the corpus
    shared = spark.sparkContext.broadcast({
        int(n): tuple(g[c].to_numpy(np.int64) for c in ("first", "times", "sequence", "offset"))
        for n, g in plan.groupby("length")})

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence = np.zeros(len(length), np.int64)
        offset = np.zeros(len(length), np.int64)
        lens, ranks = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        order = np.argsort(lens, kind="stable")
        values, starts = np.unique(lens[order], return_index=True)
        for n, rows in zip(values, np.split(order, starts[1:]), strict=True):
            first, times, seq, off = shared.value[int(n)]
            at = np.searchsorted(first, ranks[rows], "right") - 1
            nth, item = np.divmod(ranks[rows] - first[at], times[at])
            sequence[rows] = seq[at] + nth
            offset[rows] = off[at] + item * n
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = ranked.withColumn("at", place("length", "rank"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32",
                         "at.sequence_id", "at.offset")
