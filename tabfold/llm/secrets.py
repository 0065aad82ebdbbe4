"""Secret scans by character Markov models (DataFrame functions only).

Base patterns find assignments, access keys and hex strings. Beyond them,
every other run of 20 or more token characters is scored by the difference of
two first-order character models - random strings and ordinary identifiers -
and reported as kind ``markov`` when the mean log-likelihood ratio per
character pair passes a threshold.

Both models are trained from samples labelled by the base patterns: values
that they catch are random strings, words outside are ordinary. At most about
``train_docs`` documents are taken for that; the scan itself covers all text.
The models are tables over pairs of the fixed alphabet.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, in_blocks, running

TRAIN_DOCS = 5_000
MIN_LENGTH = 20
THRESHOLD = 0.8      # mean log ratio per pair of characters
SMOOTHING = 0.5
BACK_OFF = 4         # weight of the single-character rates in a pair's rate
UNIFORM = 0.5        # share of random strings over the whole alphabet, besides the samples'

# Java patterns (fixed by contract): quotes and blanks in escaped form
ASSIGN = (r"((?i:password|passwd|secret|token|api_?key))[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?"
          r"([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
# a hint that must be in a text before the costly pattern is tried
KINDS = {"assign": (ASSIGN, 2, 12, r"(?i:password|passwd|secret|token|api_?key)[\x22\x27]?\x20*[:=]"),
         "access": (ACCESS, 0, 18, "AKIA[A-Z0-9]{14}"), "hex": (HEX, 0, 16, "[0-9a-f]{16}")}
# all that the base patterns catch, in one pattern; the first group, an assignment's name, is ordinary
CAUGHT = (r"((?i:password|passwd|secret|token|api_?key))[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?"
          r"[A-Za-z0-9+/_.=-]{12,}|AKIA[A-Z0-9]{14,}|[0-9a-f]{16,}")
CANDIDATE = r"[A-Za-z0-9+/_=-]{%d,}" % MIN_LENGTH
ORDINARY = r"[A-Za-z0-9+/_=-]{6,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIZE = len(ALPHABET) + 1     # 0 stands for any other character

_SPAN = "struct<s:int,e:int,v:string>"


def found(text: str, pattern: str, group: int, least: int, hint: str) -> Column:
    """Array of (s, e, v): leftmost non-overlapping matches, code points, end exclusive; ``v`` is
    the group's value, of ``least`` or more characters.

    The text is split at the matches; the lengths of pieces and matches add up
    to positions.
    """
    values = (f"regexp_extract_all({text}, r\"{pattern}\", {group})" if group else
              f"cast(null as array<string>)")
    pieces = (f"arrays_zip(split({text}, r\"{pattern}\", -1), "
              f"regexp_extract_all({text}, r\"{pattern}\", 0), "
              f"coalesce({values}, array()))")
    value = "x.`2`" if group else "x.`1`"
    spans = running(
        pieces, "(char_length(x.`0`) + coalesce(char_length(x.`1`), 0))",
        "named_struct('s', {at} + char_length(x.`0`), "
        f"'e', {{at}} + char_length(x.`0`) + char_length(x.`1`), 'v', {value})",
        f"coalesce(char_length({value}), 0) >= {least}")
    return F.expr(f"""if({text} rlike r"{hint}", {spans}, cast(array() as array<{_SPAN}>))""")


def apart(wide: str, base: str) -> Column:
    """The spans of column ``wide`` that overlap none of column ``base``; ``wide`` in order and apart.

    A block of wide spans is compared with the base spans that reach into it only.
    """
    near = "filter(q.base, y -> y.s < b[size(b) - 1].e and b[0].s < y.e)"
    blocks = f"transform({in_blocks('q.wide')}, b -> named_struct('b', b, 'near', {near}))"
    kept = (f"flatten(transform({blocks}, z -> filter(z.b, x -> "
            f"not exists(z.near, y -> y.s < x.e and x.s < y.e))))")
    return F.expr(bound(f"named_struct('wide', {wide}, 'base', {base})", "q", kept))


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text (null is empty) and one span array per kind."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return text.select("*", *[found("text", *KINDS[k]).alias(k) for k in KINDS])


def _sample(docs: DataFrame, train_docs: int) -> DataFrame:
    """A hash sample of about ``train_docs`` documents; an id in many rows counts once."""
    docs = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    n = docs.count()
    if n > train_docs:
        share = int(train_docs / n * (1 << 32))
        docs = docs.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(5)),
                                  F.lit(1 << 32)) < share)
    return docs.groupBy("doc_id").agg(F.max("text").alias("text"))


def labelled_samples(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """Rows (value, is_secret) as the base patterns label them."""
    spans = base_spans(_sample(docs, train_docs)).withColumn(
        "caught", F.expr("transform(concat(assign, access, hex), x -> x.v)"))
    secret = spans.select(F.explode_outer("caught").alias("value"), F.lit(True).alias("is_secret"))
    # ordinary: what the text holds besides
    outside = F.regexp_replace("text", CAUGHT, "$1 ")
    plain = spans.select(F.explode_outer(F.regexp_extract_all(
        outside, F.lit(ORDINARY), F.lit(0))).alias("value")).filter("value IS NOT NULL")
    return secret.unionByName(plain.select("value", F.lit(False).alias("is_secret")))


def train(samples: DataFrame) -> list[float]:
    """Log ratio P(next | char, random) / P(next | char, ordinary), SIZE x SIZE, row by row.

    From labelled samples (value, is_secret); pair rates back off to single characters. Random
    strings are taken to be of the samples' kind or uniform; a class without samples is uniform. The counts are at most 2 x SIZE^2 rows.
    """
    pairs = samples.filter(F.length("value") > 1).select("is_secret", F.explode_outer(F.expr(
        "transform(sequence(1, char_length(value) - 1), i -> substring(value, i, 2))")).alias("pair"))
    counted = pairs.select(
        "is_secret",
        F.expr(f"instr('{ALPHABET}', substring(pair, 1, 1))").alias("a"),
        F.expr(f"instr('{ALPHABET}', substring(pair, 2, 1))").alias("b"))
    table = {(r["is_secret"], r["a"], r["b"]): r["n"] for r in
             counted.groupBy("is_secret", "a", "b").agg(F.count("*").alias("n")).collect()}

    def rates(label):
        single = [sum(table.get((label, a, b), 0) for a in range(SIZE)) + SMOOTHING
                  for b in range(SIZE)]
        total = sum(single)
        for a in range(SIZE):
            row = [table.get((label, a, b), 0) for b in range(SIZE)]
            seen = sum(row) + BACK_OFF
            for n, one in zip(row, single, strict=True):
                p = (n + BACK_OFF * one / total) / seen
                yield UNIFORM / SIZE + (1 - UNIFORM) * p if label else p

    return [math.log(x / y) for x, y in zip(rates(True), rates(False), strict=True)]


def _score(value: str, model: list[float]) -> str:
    """SQL: mean log ratio over the character pairs of a string."""
    chars = f"split({value}, '')"
    codes = f"transform({chars}, c -> instr('{ALPHABET}', c))"
    model_sql = f"cast(split('{','.join(f'{x:.6f}' for x in model)}', ',') as array<double>)"
    return (f"aggregate({codes}, named_struct('p', -1, 'sum', 0D), (a, c) -> named_struct('p', c, "
            f"'sum', a.sum + if(a.p < 0, 0D, element_at({model_sql}, a.p * {SIZE} + c + 1))), "
            f"a -> a.sum / greatest(char_length({value}) - 1, 1))")


def scan(docs: DataFrame, model: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """One row per document row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov.

    Null and empty texts have no spans. Added spans overlap no base span.
    Equal starts go in the order assign, access, hex, markov. Other columns
    are ignored.
    """
    base = base_spans(docs).withColumn("wide", found(
        "text", CANDIDATE, 0, MIN_LENGTH, CANDIDATE)).drop("text")
    kinds = [*KINDS, "markov"]
    scored = base.withColumn("base", F.concat(*KINDS)).withColumn("free", apart("wide", "base"))
    scored = scored.withColumn("markov", F.expr(
        f"filter(free, x -> {_score('x.v', model)} >= {threshold})"))

    def tagged(names):
        parts = ", ".join(f"transform({k}, x -> named_struct('s', x.s, 'k', {kinds.index(k)}, "
                          f"'t', concat('{k}:', x.s, ':', x.e)))" for k in names)
        return F.expr(f"array_join(transform(array_sort(concat({parts})), x -> x.t), ',')")

    return scored.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(tagged(list(KINDS)), 256).alias("base_sha256"), tagged(kinds).alias("spans"),
        F.size("markov").cast("long").alias("n_markov"))
