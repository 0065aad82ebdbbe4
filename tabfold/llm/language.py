"""Language identification by language-bitmask n-gram filters.

One Bloom filter per language, stored bit-sliced: slot ``i`` of an array
holds bit ``l`` when language ``l`` has set its slot ``i``, with one array for
each ``WORD_BITS`` languages. And-ing the slots of an n-gram's hashes returns every language that (probably) contains
the n-gram, all at once. A text is decided by counting, per language, the
n-grams that carry its bit, corrected for the filter's false-positive rate.

Training fits on a sample of at most about ``train_rows`` labelled documents
(``Model.train_rows``), drawn per language so that none is lost: the larger
languages give up rows first, and none falls below ``lang_rows`` for it. Its
n-gram counts are summed by Spark and the filter (``slots`` words) is
broadcast. Prediction runs over whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder, unused

TRAIN_ROWS = 20_000
LANG_ROWS = 200    # documents of a language that its sample keeps at any table size
SLOTS = 1 << 18
HASHES = 3
GRAM = 3
RATIO = 0.3        # a language holds an n-gram at this share of its highest rate, or more
MIN_COUNT = 3
WORD_BITS = 64
CHUNK = 1 << 20    # characters that are taken at once
UNDECIDED = "und"
RESULT = "lang_pred string, score double"

# odd multipliers of the hash family
_MULTIPLIERS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93]


@dataclass
class Model:
    languages: list[str]
    slots: np.ndarray          # uint64 bit masks, a row for each WORD_BITS languages
    false_rate: np.ndarray     # per language
    train_rows: int


def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


_LETTER = _letters()


def _grams(texts: list[str]):
    """(text number, 64-bit gram code) of all n-grams of letters; words are padded by one blank.

    Also which texts have a letter.
    """
    lower = [t.lower() if t else "" for t in texts]
    joined = " " + "".join(t + " " for t in lower)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    # a text owns its characters and the blank after them; the first also the blank before
    owner = np.repeat(np.arange(len(lower)), [len(t) + 1 + (i == 0) for i, t in enumerate(lower)])
    letter = _LETTER[code]
    has = np.bincount(owner[letter], minlength=len(texts)) > 0
    clean = np.where(letter, code, 32).astype(np.uint64)
    if len(clean) < GRAM:
        return owner[:0], clean[:0], has
    gram = clean[:-2] << np.uint64(42) | clean[1:-1] << np.uint64(21) | clean[2:]
    ok = letter[1:-1]            # the middle is a letter; either side may be the word's edge
    return owner[1:-1][ok], gram[ok], has


def _slots(gram: np.ndarray, n_slots: int) -> list[np.ndarray]:
    out = []
    for m in _MULTIPLIERS[:HASHES]:
        h = gram * np.uint64(m)
        h ^= h >> np.uint64(29)
        out.append((h * np.uint64(m) >> np.uint64(33)) % np.uint64(n_slots))
    return out


def _chunks(texts):
    """Runs of texts with at most about CHUNK characters."""
    held, size = [], 0
    for t in texts:
        t = t if isinstance(t, str) else ""
        if held and size + len(t) > CHUNK:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t) + 3
    if held:
        yield held


def _quota(sizes: list[int], train_rows: int, lang_rows: int) -> float:
    """Documents per language so that all languages together give about ``train_rows``."""
    left = train_rows
    for i, n in enumerate(sorted(sizes)):
        level = left / (len(sizes) - i)
        if n > level:
            return max(level, lang_rows)
        left -= n
    return float("inf")


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS, n_slots: int = SLOTS,
          lang_rows: int = LANG_ROWS) -> Model:
    """Fit on labelled, not held-out rows: all of them, or a hash sample of each language."""
    usable = docs.select("doc_id", "lang", "text").filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id")) != 1))
    ids = F.approx_count_distinct(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sizes = sorted(tuple(r) for r in usable.groupBy("lang").agg(ids).collect())
    names = [lang for lang, _ in sizes]
    quota = _quota([n for _, n in sizes], train_rows, lang_rows)
    parts = docs.sparkSession.createDataFrame(
        [(lang, code, int(min(quota / max(n, 1), 1) * (1 << 32))) for code, (lang, n) in enumerate(sizes)],
        "lang string, code int, share long")
    usable = usable.join(F.broadcast(parts), "lang").filter(
        F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(17)), F.lit(1 << 32)) < F.col("share"))
    # an id that comes in many rows counts once per language
    usable = usable.groupBy("doc_id", "code").agg(F.max("text").alias("text"))

    def count(batches):
        sums: dict[int, pd.Series] = {}
        for b in batches:
            for code, rows in b.groupby("code")["text"]:
                for chunk in _chunks(rows):
                    g, c = np.unique(_grams(chunk)[1], return_counts=True)
                    new = pd.Series(c, index=g.view(np.int64))
                    sums[code] = sums[code].add(new, fill_value=0) if code in sums else new
        for code, s in sums.items():
            yield pd.DataFrame({"code": code, "gram": s.index.astype("int64"),
                                "n": s.to_numpy().astype("int64")}).astype({"code": "int32"})

    def counted(rows, least):
        return (rows.select("code", "text").mapInPandas(count, "code int, gram long, n long")
                .groupBy("code", "gram").agg(F.sum("n").alias("n"))
                .filter(F.col("n") >= least).toPandas())

    counts = counted(usable, MIN_COUNT)
    # languages with so little text that no n-gram comes often keep all they have
    rare = sorted(set(range(len(names))) - set(counts["code"]))
    if rare:
        counts = pd.concat([counts, counted(usable.filter(F.col("code").isin(rare)), 1)],
                           ignore_index=True)
    codes = sorted(counts["code"].unique())
    rate = counts["n"] / counts.groupby("code")["n"].transform("sum")
    top = rate.groupby(counts["gram"]).transform("max")
    held = dict(list(counts[rate >= RATIO * top].groupby("code")["gram"]))
    slots = np.zeros((-(-len(codes) // WORD_BITS), n_slots), np.uint64)
    fill = np.zeros(len(codes))
    for i, code in enumerate(codes):
        word, bit = divmod(i, WORD_BITS)
        grams = held[code].to_numpy(np.int64).view(np.uint64) if code in held else np.zeros(0, np.uint64)
        for s in _slots(grams, n_slots):
            np.bitwise_or.at(slots[word], s.astype(np.int64), np.uint64(1 << bit))
        fill[i] = np.mean(slots[word] >> np.uint64(bit) & np.uint64(1))
    return Model([names[c] for c in codes], slots, fill ** HASHES, train_rows)


def predict_texts(texts: list[str], model: Model) -> tuple[list[str], list[float]]:
    """Language and score of each text; ties fall to the first language by name."""
    langs, scores = [], []
    for chunk in _chunks(texts):
        owner, gram, has = _grams(chunk)
        k = len(chunk)
        if not model.languages:
            langs += [UNDECIDED] * k
            scores += [0.0] * k
            continue
        masks = np.full((len(model.slots), len(gram)), np.uint64((1 << WORD_BITS) - 1))
        for s in _slots(gram, model.slots.shape[1]):
            masks &= model.slots[:, s.astype(np.int64)]
        total = np.maximum(np.bincount(owner, minlength=k), 1)
        corrected = np.empty((k, len(model.languages)))
        for i in range(len(model.languages)):
            word, bit = divmod(i, WORD_BITS)
            hits = np.bincount(owner, (masks[word] >> np.uint64(bit) & np.uint64(1)).astype(np.float64),
                               minlength=k)
            f = model.false_rate[i]
            corrected[:, i] = np.clip((hits / total - f) / max(1 - f, 1e-9), 0, 1)
        best = corrected.argmax(axis=1)
        langs += [model.languages[b] if h else UNDECIDED for b, h in zip(best, has, strict=True)]
        scores += [float(corrected[i, b]) if h else 0.0
                   for i, (b, h) in enumerate(zip(best, has, strict=True))]
    return langs, scores


def detector(docs: DataFrame, model: Model):
    """Column function text -> struct(lang_pred, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def detect(text: pd.Series) -> pd.DataFrame:
        langs, scores = predict_texts(text.tolist(), shared.value)
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    return detect


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document row: doc_id, held_out, lang_pred, score.

    A text without a letter, empty or null, is 'und' with score 0. With no
    labelled rows to learn from every text is 'und'. Other columns are ignored.
    """
    found = docs.select("doc_id", detector(docs, model)(F.col("text")).alias("r"))
    return found.select("doc_id", (remainder(F.col("doc_id")) == 1).alias("held_out"),
                        "r.lang_pred", "r.score")


def accepted(docs: DataFrame, model: Model, min_score: float = 0.2) -> DataFrame:
    """Documents whose language is recognised: some letter, and a score of ``min_score`` or more."""
    name = unused(docs, "_language")
    tagged = docs.withColumn(name, detector(docs, model)(docs["text"]))
    return tagged.filter((F.col(name)["lang_pred"] != UNDECIDED)
                         & (F.col(name)["score"] >= min_score)).drop(name)
