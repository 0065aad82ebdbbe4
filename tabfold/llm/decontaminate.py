"""Benchmark decontamination by a prefix-filtered join (DataFrame functions only).

An item's windows are its runs of ``window`` consecutive words (an item with
fewer words is one window). A window is a set of word shingles; for exact
containment one necessary shingle is enough as join prefix, and the rarest in
the corpus is taken. Steps:

1. one pass over the documents keeps the shingles that the benchmark may have:
   those whose hash falls on one of ``slots`` slots that a benchmark shingle
   falls on, each with the words around it. The slots are what is broadcast,
   so its size has a bound whatever the benchmark's; a larger benchmark fills
   more of them and lets more shingles through, to be joined by their hash;
2. count what was kept by shingle; per window take its rarest shingle with its
   place in the window. A window with a shingle that no document has can't
   occur and goes;
3. join what was kept to the prefixes; the place of the shingle gives the one
   possible start, which must lie in the document with the whole window
   (positional and length bounds);
4. verify word by word.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_hash, words, written

WINDOW = 10
SHINGLE = 3
SLOTS = 1 << 21     # of the broadcast filter, at most so many rows


def _shingles(column: str, k: int) -> str:
    """SQL: hashes of the k-word shingles of an array column, in order."""
    parts = ", ".join(f"{column}[i + {j}]" for j in range(k))
    return (f"if(size({column}) >= {k}, transform(sequence(0, size({column}) - {k}), "
            f"i -> xxhash64({parts})), cast(array() as array<bigint>))")


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows: (wid, win, items). Items without words have none; a null id reads 'null'."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"),
        words(F.col("text")).alias("w"))
    starts = items.filter("size(w) > 0").select(
        "item", "w", F.explode_outer(F.expr(f"sequence(0, greatest(size(w) - {window}, 0))")).alias("at"))
    return (starts.select("item", F.expr(f"slice(w, at + 1, {window})").alias("win"))
            .groupBy("win").agg(F.collect_set("item").alias("items"))
            .select(F.md5(F.array_join("win", " ")).alias("wid"), "win", "items"))


def _document_shingles(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """One row per document shingle, and one per document (k 0, pos -1, h 0).

    Columns doc_id, text_hash, w, k, pos, h.
    """
    base = docs.select("doc_id", text_hash(F.col("text")).alias("text_hash"),
                       words(F.col("text")).alias("w"))
    arrays = [f"transform({_shingles('w', k)}, (h, i) -> named_struct('k', {k}, 'pos', i, 'h', h))"
              for k in sizes]
    arrays.append("array(named_struct('k', 0, 'pos', -1, 'h', 0L))")
    # outer: else a filter on the array's size is pushed below it and builds it twice
    every = base.withColumn("s", F.expr(f"concat({', '.join(arrays)})"))
    return every.select("doc_id", "text_hash", "w", F.inline_outer("s"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                  slots: int = SLOTS) -> DataFrame:
    """One row per document row: doc_id, text_hash, n_words, n_hit, n_items, items_sha256,
    contaminated.

    Null or wordless texts have no words and no hits; repeated rows each get
    their row; an empty benchmark contaminates nothing; other columns of the
    inputs are ignored. Ties in rarity fall to the smaller hash.
    """
    windows = written(item_windows(benchmark, window)
                      .withColumn("k", F.least(F.size("win"), F.lit(SHINGLE))), "windows")
    sizes = sorted(r["k"] for r in windows.select("k").distinct().collect()) or [SHINGLE]
    one_size = [windows.filter(F.col("k") == k).select(
        "wid", "k", F.posexplode_outer(F.expr(_shingles("win", k))).alias("off", "h")) for k in sizes]
    tokens = written(reduce(DataFrame.unionByName, one_size), "tokens")

    # the only pass over the documents; slot 0 lets the documents' own rows through
    slot = F.pmod("h", F.lit(slots))
    filled = tokens.select(slot.alias("slot")).union(
        docs.sparkSession.range(1).select(F.lit(0).cast("long"))).distinct()
    # from the first word that a window over the shingle can have to the last
    around = F.expr(f"slice(w, greatest(pos - {window - 1}, 0) + 1, {2 * window})")
    met = written(
        _document_shingles(docs, sizes).join(F.broadcast(filled), slot == F.col("slot")).select(
            "doc_id", "text_hash", F.size("w").cast("long").alias("n_words"), "k", "pos", "h",
            F.when(F.col("k") > 0, around).alias("around")), "met")
    found = met.filter("k > 0")

    counts = found.groupBy(F.col("k").alias("tk"), F.col("h").alias("th")).agg(F.count("*").alias("n"))
    weighed = tokens.join(counts, (tokens.h == counts.th) & (tokens.k == counts.tk), "left")
    rarest = (weighed.groupBy("wid").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "off", "k")).alias("p"))
        .filter("p.n > 0"))
    prefixes = rarest.join(windows, "wid").select(
        F.col("p.k").alias("tk"), F.col("p.h").alias("th"), F.col("p.off").alias("off"), "win", "items")

    start, length = F.col("pos") - F.col("off"), F.size("win")
    inside = F.expr(f"""slice(around, greatest(pos - off - greatest(pos - {window - 1}, 0), 0) + 1,
                              size(win)) = win""")
    hits = (found.join(prefixes, (F.col("h") == F.col("th")) & (F.col("k") == F.col("tk")))
            .filter((start >= 0) & (start + length <= F.col("n_words")) & inside)
            .select("doc_id", "text_hash", "n_words", "items",
                    F.struct(start.alias("s"), (start + length).alias("e")).alias("hit"),
                    F.lit(0).cast("long").alias("mark")))
    own = met.filter("k = 0").select(
        "doc_id", "text_hash", "n_words", F.lit(None).cast("array<string>").alias("items"),
        F.lit(None).cast("struct<s:int,e:int>").alias("hit"), F.lit(1).cast("long").alias("mark"))
    per_doc = own.unionByName(hits).groupBy("doc_id", "text_hash").agg(
        F.max("n_words").alias("n_words"), F.sum("mark").alias("copies"),
        F.array_sort(F.collect_set("hit")).alias("hits"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("ids"))
    covered = F.expr(
        "aggregate(hits, named_struct('n', 0L, 'e', 0), (a, x) -> named_struct("
        "'n', a.n + greatest(x.e - greatest(x.s, a.e), 0), 'e', greatest(a.e, x.e)), a -> a.n)")
    return per_doc.select(
        "doc_id", "text_hash", "n_words", covered.alias("n_hit"),
        F.size("ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("ids"), ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy")).drop("_copy")
