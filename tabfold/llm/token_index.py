"""Token-id files with a minimal perfect hash index.

Layout of a folder that ``write`` fills:

- ``payload/``: one file per shard, shards in ascending doc_id order. A file
  holds the raw little-endian ids (``width`` bytes each) of its documents, one
  after the other, each ended by id 0; then a footer: doc_id int64 [n], null
  marks uint8 [n], numbers of ids uint32 [n], shard uint32, n uint64, magic,
  and ``width`` zero bytes. Spark's text writer writes it: a row is a
  document's ids and the line separator is the end id, so any file system that
  Spark writes to will do.
- ``index/``: per bucket of keys a minimal perfect hash in levels (a key's slot
  is the rank of the first level bit that it has to itself) and, by slot, the
  key's fingerprint, shard, offset and number of ids.
- ``meta/``: one row with ``width`` and the number of buckets.

A key is (doc_id, copy): rows that share a doc_id are copies 0, 1, ... in file
order. A null doc_id is a key like any other and comes first; a null text is
empty: its only id is the end id.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabfold.session import scratch_path

from .common import numbered, written

SHARD_BYTES = 16 << 20      # text bytes (and 16 a row) that a shard has, about
BUCKET_KEYS = 1 << 14       # keys that an index bucket has, about
MEMO_PIECES = 300_000       # pieces of text in each of a worker's two generations of memory
CHUNK = 1 << 18             # characters of a text that are encoded at once, about
GAMMA = 2.0                 # bits of a level for each key that is left
MAX_LEVELS = 64
MAGIC = b"IDSHARD1"
DOC = "doc_id long, shard long, offset long, n_tokens long"

# the tokenizer's splitting pattern (fixed by its vocabulary file), for white space and the
# characters up to U+024F, whose classes all versions of Unicode agree on
_LETTER = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPLIT = re.compile(
    rf" ?[{_LETTER}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{_NUMBER}]+| ?[^ \t\n\r{_LETTER}{_NUMBER}]+"
    r"|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+")
_ODD = re.compile("[^\t\n\r\x20-\x7e\xa1-ɏ]")
_WORD = re.compile(f" [{_LETTER}]+")
# between these two a text can be cut without a change of its ids
_CUT = re.compile(r"(?<=[!-~]) (?=[!-~])")


class Encoder:
    """The library's ids of texts, remembered by piece.

    The tokenizer works piece by piece (``_SPLIT``), so pieces are looked up;
    those that a text has and the memo hasn't go to the library together. Text
    with other characters goes through the library as it is.
    """

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.width = 2 if tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.marks = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.memo: dict[str, bytes] = {}    # a new generation when full; the last one is kept
        self.last: dict[str, bytes] = {}

    def encoded(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids,
                        f"<u{self.width}").tobytes()

    def learn(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of new pieces; words with a space before go through the library in one text."""
        out = {p: self.last[p] for p in pieces if p in self.last}
        words = [p for p in pieces if p not in out and _WORD.fullmatch(p)]
        out |= {p: self.encoded(p) for p in pieces if p not in out and not _WORD.fullmatch(p)}
        if words:
            got = self.tokenizer.encode("".join(words), add_special_tokens=False)
            raw = np.array(got.ids, f"<u{self.width}").tobytes()
            ends = np.cumsum(np.bincount(got.word_ids, minlength=len(words))) * self.width
            starts = [0, *ends[:-1].tolist()]
            out |= {w: raw[a:b] for w, a, b in zip(words, starts, ends.tolist(), strict=True)}
        if len(self.memo) + len(out) > MEMO_PIECES:
            self.last, self.memo = self.memo, {}
        self.memo |= out
        return out

    def part(self, text: str) -> bytes:
        if _ODD.search(text) or any(m in text for m in self.marks):
            return self.encoded(text)
        pieces = _SPLIT.findall(text)
        found = list(map(self.memo.get, pieces))
        if None in found:
            new = self.learn(list({p for p, f in zip(pieces, found, strict=True) if f is None}))
            found = [new[p] if f is None else f for p, f in zip(pieces, found, strict=True)]
        return b"".join(found)

    def __call__(self, text: str | None) -> bytes:
        """The ids of the whole text, without the end id."""
        return b"".join([self.part(t) for t in chunks(text)]) if text else b""


def chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """The text cut before single spaces between ASCII signs, about every ``size`` characters."""
    at = 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:] if at else text


_LOADED: dict = {}


def _encoder(path: str | None) -> Encoder:
    """Loaded once a worker; None: the public byte_bpe_50k.json, found on each worker."""
    if path not in _LOADED:
        import os

        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path is None:
            import public_tokenizers
            name = public_tokenizers.path("byte_bpe_50k.json")
        else:
            name = path
        _LOADED[path] = Encoder(Tokenizer.from_file(name))
    return _LOADED[path]


def _footer(ids: list, lengths: list[int], shard: int) -> bytes:
    null = np.array([i is None for i in ids], np.uint8)
    keys = np.array([0 if i is None else i for i in ids], "<i8")
    return b"".join([keys.tobytes(), null.tobytes(), np.array(lengths, "<u4").tobytes(),
                     struct.pack("<IQ", shard, len(ids)), MAGIC])


def read_footer(content: bytes, width: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(shard, doc ids, null marks, numbers of ids) of a payload file."""
    end = len(content) - width
    if content[end - 8:end] != MAGIC:
        raise ValueError("not a shard of token ids")
    shard, n = struct.unpack("<IQ", content[end - 20:end - 8])
    at = end - 20 - 13 * n
    return (shard, np.frombuffer(content, "<i8", n, at),
            np.frombuffer(content, np.uint8, n, at + 8 * n),
            np.frombuffer(content, "<u4", n, at + 9 * n))


def write(docs: DataFrame, root: str | None = None, tokenizer_path: str | None = None,
          shard_bytes: int = SHARD_BYTES, bucket_keys: int = BUCKET_KEYS) -> str:
    """Encode ``docs`` (doc_id, text; other columns are ignored) and write payload and index.

    Returns the folder, by default a new one in the shared scratch folder. An
    empty table makes a folder without shards.
    """
    spark = docs.sparkSession
    root = root or scratch_path(spark, "tokens")
    width = _encoder(tokenizer_path).width
    # the size of an unnamed type is not known before: rows and bytes in one count
    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16)).first()[0]
    n_shards = max(1, math.ceil((total or 0) / shard_bytes))

    def shard_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, ids, lengths = _encoder(tokenizer_path), [], []
        for batch in batches:
            rows = [encoder(t) for t in batch["text"]]
            ids += [None if pd.isna(i) else int(i) for i in batch["doc_id"]]
            lengths += [len(r) // encoder.width + 1 for r in rows]
            yield pd.DataFrame({"value": rows})
        if ids:
            yield pd.DataFrame({"value": [_footer(ids, lengths, TaskContext.get().partitionId())]})

    order = ["doc_id", "uid"]
    dealt = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"),
                         F.monotonically_increasing_id().alias("uid"))
             .repartitionByRange(n_shards, *order).sortWithinPartitions(*order))
    (dealt.mapInPandas(shard_rows, "value binary").select(F.col("value").cast("string"))
     .write.option("lineSep", "\0" * width).option("encoding", "UTF-8").text(f"{root}/payload"))
    build_index(spark, root, width, bucket_keys)
    return root


def _payload(spark: SparkSession, root: str) -> DataFrame:
    return (spark.read.format("binaryFile").option("pathGlobFilter", "part-*")
            .load(f"{root}/payload").filter("length > 0").select("content"))


def documents(spark: SparkSession, root: str, width: int) -> DataFrame:
    """Rows (doc_id, shard, offset, n_tokens, ids_crc32, nth), read from the payload files alone."""
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                shard, keys, null, lengths = read_footer(content, width)
                ends = np.cumsum(lengths, dtype=np.int64)
                starts = ends - lengths
                ids = np.frombuffer(content, f"<u{width}", int(ends[-1]))
                crcs = [zlib.crc32(ids[a:b].astype("<u4").tobytes())
                        for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pd.DataFrame({
                    "doc_id": pd.array(np.where(null, 0, keys), "Int64").copy()
                    if not null.any() else pd.arrays.IntegerArray(keys.copy(), null.astype(bool)),
                    "shard": np.int64(shard), "offset": starts,
                    "n_tokens": lengths.astype(np.int64), "ids_crc32": crcs,
                    "nth": np.arange(len(lengths))})
    return _payload(spark, root).mapInPandas(parse, DOC + ", ids_crc32 long, nth long")


def _hashed(df: DataFrame, n_buckets: int) -> DataFrame:
    """Two hashes, a fingerprint and the bucket of a key (doc_id, copy)."""
    key = [F.col("doc_id").cast("long"), F.col("copy").cast("long")]
    return (df.withColumn("a", F.xxhash64(*key)).withColumn("b", F.xxhash64(F.lit("b"), *key))
            .withColumn("fp", F.xxhash64(F.lit("fp"), *key).bitwiseAND(F.lit(0xFFFFFFFF)))
            .withColumn("bucket", F.pmod(F.xxhash64(F.lit("bucket"), *key), F.lit(n_buckets))))


def _mixed(a: np.ndarray, b: np.ndarray, level: int, n: int) -> np.ndarray:
    """Positions below n: a 64-bit finaliser over a + level * b."""
    with np.errstate(over="ignore"):
        x = a + np.uint64(level + 1) * (b | np.uint64(1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) % np.uint64(n)).astype(np.int64)


def perfect_hash(a: np.ndarray, b: np.ndarray) -> tuple[bytes, np.ndarray]:
    """A minimal perfect hash of the keys (a, b) as bytes, and each key's slot 0..n-1.

    Level by level the keys that are left fall on GAMMA bits each; a bit that
    one key alone falls on is set and is that key's.
    """
    n, place, left = len(a), np.zeros(len(a), np.int64), np.arange(len(a))
    sizes, bits, base = [], [], 0
    while len(left):
        if len(sizes) == MAX_LEVELS:
            raise ValueError("two keys agree in all hash bits")
        size = 64 * math.ceil(max(GAMMA * len(left), 64) / 64)
        at = _mixed(a[left], b[left], len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        own = alone[at]
        place[left[own]] = base + at[own]
        left = left[~own]
        sizes.append(size)
        bits.append(alone)
        base += size
    flat = np.concatenate(bits) if bits else np.zeros(0, bool)
    words = np.packbits(flat, bitorder="little").view("<u8")
    before = np.concatenate([[0], np.cumsum(np.bitwise_count(words))])[:-1].astype("<u4")
    head = struct.pack("<II", n, len(sizes)) + np.array(sizes, "<u8").tobytes()
    return head + words.tobytes() + before.tobytes(), np.cumsum(flat)[place] - 1 if n else place


def slots(blob: bytes, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The slots of keys by a hash that ``perfect_hash`` made; -1 where no level has the key."""
    n, n_levels = struct.unpack_from("<II", blob)
    sizes = np.frombuffer(blob, "<u8", n_levels, 8).astype(np.int64)
    n_words = int(sizes.sum()) // 64
    words = np.frombuffer(blob, "<u8", n_words, 8 + 8 * n_levels)
    before = np.frombuffer(blob, "<u4", n_words, 8 + 8 * (n_levels + n_words))
    out, left, base = np.full(len(a), -1, np.int64), np.arange(len(a)), 0
    for level, size in enumerate(sizes.tolist()):
        at = base + _mixed(a[left], b[left], level, size)
        word, bit = words[at >> 6], (at & 63).astype(np.uint64)
        own = (word >> bit) & np.uint64(1) == 1
        below = word[own] & ((np.uint64(1) << bit[own]) - np.uint64(1))
        out[left[own]] = before[at[own] >> 6] + np.bitwise_count(below)
        left = left[~own]
        base += size
    return out


SLOT = np.dtype([("fp", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("n_tokens", "<u4")])


def build_index(spark: SparkSession, root: str, width: int, bucket_keys: int = BUCKET_KEYS) -> None:
    """Write ``index`` and ``meta`` of a folder from its payload files."""
    docs = written(documents(spark, root, width), "token_docs")
    n_buckets = max(1, math.ceil(docs.count() / bucket_keys))
    copies = numbered(docs, ["doc_id"], "shard", "nth", "copy")
    keyed = _hashed(copies.withColumn("copy", F.col("copy") - 1), n_buckets)

    def one_bucket(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = (rows[c].to_numpy(np.int64).view(np.uint64) for c in "ab")
        blob, slot = perfect_hash(a, b)
        entries = np.zeros(len(rows), SLOT)
        for c in SLOT.names:
            entries[c][slot] = rows[c].to_numpy(np.int64)
        return pd.DataFrame({"bucket": rows["bucket"].iloc[:1], "hash": [blob],
                             "entries": [entries.tobytes()]})

    (keyed.select("bucket", "a", "b", "fp", "shard", "offset", "n_tokens")
     .groupBy("bucket").applyInPandas(one_bucket, "bucket long, hash binary, entries binary")
     .write.parquet(f"{root}/index"))
    (docs.agg(F.lit(width).alias("width"), F.lit(n_buckets).alias("n_buckets"))
     .write.parquet(f"{root}/meta"))


def keys(docs: DataFrame) -> DataFrame:
    """The keys (doc_id, copy) of a table's rows."""
    counts = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("n"))
    return counts.select("doc_id", F.explode(F.expr("sequence(0L, n - 1)")).alias("copy"))


def lookup(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """Where the keys (doc_id, copy) lie: doc_id, copy, shard, offset, n_tokens.

    A key that the index hasn't gives no row; one in 2^32 of those agrees in
    its fingerprint with another key's slot, and would give that one's place.
    """
    meta = spark.read.parquet(f"{root}/meta").first()
    asked = _hashed(wanted.select("doc_id", "copy"), meta["n_buckets"])

    def find(rows: pd.DataFrame, bucket: pd.DataFrame) -> pd.DataFrame:
        names = ["doc_id", "copy", "shard", "offset", "n_tokens"]
        if not len(rows) or not len(bucket):
            return pd.DataFrame({c: pd.Series(dtype="Int64") for c in names})
        a, b = (rows[c].to_numpy(np.int64).view(np.uint64) for c in "ab")
        slot = slots(bucket["hash"].iloc[0], a, b)
        entries = np.frombuffer(bucket["entries"].iloc[0], SLOT)
        got = entries[np.maximum(slot, 0)]
        there = (slot >= 0) & (got["fp"] == rows["fp"].to_numpy(np.int64))
        out = rows.loc[there, ["doc_id", "copy"]].astype("Int64")
        for c in names[2:]:
            out[c] = got[c][there].astype(np.int64)
        return out

    return asked.groupBy("bucket").cogroup(
        spark.read.parquet(f"{root}/index").groupBy("bucket")).applyInPandas(
        find, "doc_id long, copy long, shard long, offset long, n_tokens long")


def digest(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """Per key its place among all ids and the crc32 of its ids as 32-bit integers.

    Rows (doc_id, copy, start, n_tokens, ids_crc32, shard, offset): the index
    says where a key lies, the payload files what lies there.
    """
    meta = spark.read.parquet(f"{root}/meta").first()
    stored = written(documents(spark, root, meta["width"]).drop("doc_id", "nth"), "stored")
    bases = _bases(stored)
    found = lookup(spark, root, wanted).join(stored, ["shard", "offset", "n_tokens"])
    return found.join(F.broadcast(bases), "shard").select(
        "doc_id", "copy", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32",
        "shard", "offset")


def _bases(stored: DataFrame) -> DataFrame:
    """(shard, base): ids before each shard; a row per file, summed on the driver."""
    sizes = stored.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").toPandas()
    base = sizes["n"].cumsum() - sizes["n"]
    return stored.sparkSession.createDataFrame(
        pd.DataFrame({"shard": sizes["shard"].astype("int64"), "base": base.astype("int64")}),
        "shard long, base long")


def fetch(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """The stored ids of the keys (doc_id, copy), end id included: doc_id, copy, ids.

    Each wanted key goes to its shard's file, where its ids are cut out by
    offset; files without a wanted key are dropped before their rows are cut.
    """
    width = spark.read.parquet(f"{root}/meta").first()["width"]

    def tagged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"shard": [read_footer(c, width)[0] for c in batch["content"]],
                                "content": batch["content"].to_list()})

    def cut(rows: pd.DataFrame, files: pd.DataFrame) -> pd.DataFrame:
        content = files["content"].iloc[0] if len(files) else b""
        return pd.DataFrame({
            "doc_id": rows["doc_id"].astype("Int64"), "copy": rows["copy"],
            "ids": pd.Series([np.frombuffer(content, f"<u{width}", n, at * width).astype(np.int32)
                              for at, n in zip(rows["offset"], rows["n_tokens"], strict=True)],
                             index=rows.index, dtype=object)})

    files = _payload(spark, root).mapInPandas(tagged, "shard long, content binary")
    return lookup(spark, root, wanted).groupBy("shard").cogroup(files.groupBy("shard")).applyInPandas(
        cut, "doc_id long, copy long, ids array<int>")
