"""License scans: exact phrases, and fuzzy search for short notices.

A notice that occurs with at most k edits contains at least one of any k + 1
pieces of it unchanged (pigeonhole). The pieces of all notices are found at
once by an Aho-Corasick automaton; around each hit the ``regex`` library
matches the notice with a bounded number of edits and reports its span. Spans
of a notice don't overlap: those with the fewest edits are taken first, then
what is left between them is searched with one edit more.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# phrases and labels, fixed by contract
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by",
           "mit license": "mit"}
# notices of the fuzzy search: text, label, allowed edits
NOTICES = (
    ("gnu general public license", "gpl", 3),
    ("licensed under the apache license", "apache", 3),
    ("licensed under cc by", "cc-by", 2),
    ("released under the mit license", "mit", 3),
    ("permission is hereby granted, free of charge", "mit", 4),
    ("redistribution and use in source and binary forms", "bsd", 4),
    ("mozilla public license", "mpl", 2),
    ("creative commons attribution", "cc-by", 3),
    ("this work is licensed under", "notice", 2),
    ("all rights reserved", "reserved", 2),
)
RESULT = ("n_words long, n_base long, first_word long, last_word long, base_labels string, "
          "labels string, score double, spans string")

_WORD_BYTE = np.array([b >= 0x80 or chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz"
                       for b in range(256)])
_GAP = rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_EDGE = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"


def _phrase_pattern():
    parts = [_GAP.join(w.encode() for w in p.split()) for p in PHRASES]
    return regex.compile(rb"(?<!" + _EDGE + rb")(?:" + b"|".join(b"(" + p + b")" for p in parts)
                         + rb")(?!" + _EDGE + rb")")


class Scanner:
    """Compiled patterns; one per worker."""

    def __init__(self, notices=NOTICES):
        self.phrases = _phrase_pattern()
        self.labels = list(PHRASES.values())
        # one pattern per number of edits
        self.notices = [(text, label, k, [regex.compile(
            f"(?:{regex.escape(text, literal_spaces=True)}){{e<={e}}}") for e in range(k + 1)])
            for text, label, k in notices]
        self.seeds = ahocorasick.Automaton()
        pieces: dict[str, list] = {}
        for i, (text, _, k, _) in enumerate(self.notices):
            cut = [len(text) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cut, cut[1:], strict=False):
                pieces.setdefault(text[a:b], []).append((i, a))
        for piece, places in pieces.items():
            self.seeds.add_word(piece, (len(piece), places))
        self.seeds.make_automaton()

    def fuzzy(self, text: str) -> list[tuple[int, int, str, int]]:
        """(start, end, label, edits) of the notices in lower-cased text, code points."""
        windows: dict[int, list[tuple[int, int]]] = {}
        for end, (size, places) in self.seeds.iter(text):
            for i, at in places:
                notice, _, k, _ = self.notices[i]
                start = end + 1 - size - at
                windows.setdefault(i, []).append(
                    (max(0, start - k), min(start + len(notice) + k, len(text))))
        out = []
        for i, spans in windows.items():
            merged: list[list[int]] = []
            for a, b in sorted(spans):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            label, patterns = self.notices[i][1], self.notices[i][3]
            left = [(a, b) for a, b in merged if patterns[-1].search(text, a, b)]
            for pattern in patterns:
                stretches, left = left, []
                for a, b in stretches:
                    for m in pattern.finditer(text, a, b):
                        out.append((m.start(), m.end(), label, sum(m.fuzzy_counts)))
                        left.append((a, m.start()))
                        a = m.end()
                    left.append((a, b))
        return sorted(out)

    def scan(self, raw: bytes | None):
        low = (raw or b"").lower()
        inside = _WORD_BYTE[np.frombuffer(low, np.uint8)]
        starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]])) if len(low) else []
        places, base = [], set()
        if b"license" in low or b"cc" in low:
            for m in self.phrases.finditer(low):
                places.append(int(np.searchsorted(starts, m.start())))
                base.add(self.labels[m.lastindex - 1])
        spans = self.fuzzy(low.decode("utf-8", "surrogatepass"))
        labels = base | {s[2] for s in spans}
        score = 1.0 if base else max((1 - e / (end - start) for start, end, _, e in spans), default=0.0)
        return (len(starts), len(places), min(places, default=None), max(places, default=None),
                ",".join(sorted(base)), ",".join(sorted(labels)), score,
                ",".join(f"{label}:{a}:{b}:{e}" for a, b, label, e in spans))


_SCANNER: list[Scanner] = []


def _scanner() -> Scanner:
    if not _SCANNER:
        _SCANNER.append(Scanner())
    return _SCANNER[0]


def scan(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score, spans (label:start:end:edits of the fuzzy search, code points).

    Null and empty texts have no words, no labels and score 0. Score 1 means
    an exact phrase; else 1 - edits / length of the best notice. Other columns
    are ignored.
    """
    names = [c.split()[0] for c in RESULT.split(", ")]

    @F.pandas_udf(RESULT)
    def look(raw: pd.Series) -> pd.DataFrame:
        scanner = _scanner()
        out = pd.DataFrame([scanner.scan(t) for t in raw], columns=names)
        return out.astype({"first_word": "Int64", "last_word": "Int64"})

    return docs.select("doc_id", look(F.col("text").cast("binary")).alias("r")).select(
        "doc_id", *[F.col(f"r.{n}") for n in names])
