"""Prefix trie, conversation repair and token index against brute force on awkward tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabfold.llm import prefix_trie, repair, token_index

WS = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, c int, id string, block int, n int"


def _rows():
    """Nulls in every column, equal turns, repeated rows, copies of conversations, a long one."""
    rnd = random.Random(3)
    rows = []
    for c in [None, -3, *range(30), 100, 101, 107, 205, 300, 301]:
        for _ in range(rnd.choice([1, 2, 5, 9, 20])):
            rows.append((c, rnd.choice([None, *range(10)]),
                         rnd.choice(["system", "user", "assistant", "tool", None, ""]),
                         rnd.choice(["a.", "b", "", "  ", "c!\n", "d? ", None, "é…", "x"])))
    for c in (400, 401, 402, 403, 450):      # copies
        rows += [(c, i, ("user", "assistant")[i % 2], f"turn {i}" + "." * (i % 3)) for i in range(8)]
    rows += [(99, i if i % 7 else None, rnd.choice(["system", "user", "assistant", "tool"]),
              f"{i}" + rnd.choice([".", "", "!"])) for i in range(300)]
    return [(*r, 1, "i", 2, 3) for r in rows]


@pytest.fixture(scope="module")
def conversations(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(5).persist()


def _digest(r, t):
    return hashlib.sha256(f"{len(r)}:{r}:{t}".encode()).hexdigest()


def _order(x):
    turn, role, text = x
    return (turn is not None, turn or 0, role, text[:64], _digest(role, text))


def _trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs[c].append((turn, role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v, key=_order)] for c, v in convs.items()}
    new = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        first = c - int(np.fmod(c, 100))
        new[c] = tuple(own.get(first, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, s in new.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = defaultdict(int)
    for s in members:
        if s:
            kids[s[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for s, m in members.items():
        for d in range(len(s) + 1):
            leaves[s[:d]] += not kids[s]
            saved[s[:d]] += (len(m) - 1) * (len(s[-1][1]) if s else 0)
    return sorted((min(m), len(s), min(members[s[:-1]]) if s else -1, len(m), kids[s], leaves[s], saved[s],
                   hashlib.sha256(",".join(map(str, sorted(c for c in m if new[c] == s))).encode())
                   .hexdigest()) for s, m in members.items())


def test_prefix_trie(conversations, monkeypatch):
    want = _trie(_rows())
    assert max(r[1] for r in want) > 250 and max(r[3] for r in want) > 30

    def got():
        return sorted(tuple(-1 if v is None else v for v in r)
                      for r in prefix_trie.trie(conversations).collect())
    assert got() == want
    monkeypatch.setattr(prefix_trie, "SEGMENT", 3)      # many segments, cells and pieces
    monkeypatch.setattr(prefix_trie, "CELL", 2)
    assert got() == want


def test_prefix_trie_of_nothing(spark):
    assert prefix_trie.trie(spark.createDataFrame([], SCHEMA)).count() == 0
    alone = prefix_trie.trie(spark.createDataFrame([(None, 1, "user", "x", 1, "i", 2, 3)], SCHEMA))
    assert alone.count() == 0


@pytest.mark.parametrize("shape", ["chain", "star", "random", "caterpillar", "forest"])
def test_subtree_totals(spark, shape):
    rnd, n = random.Random(7), 60
    up = {"chain": lambda i: i - 1, "star": lambda i: 0, "random": lambda i: rnd.randrange(i),
          "caterpillar": lambda i: i - 1 if i % 2 else max(0, i - 2),
          "forest": lambda i: None if i % 10 == 0 else i - 1}[shape]
    parent = {0: None} | {i: up(i) for i in range(1, n)}
    depth = {}
    for i in range(n):
        depth[i] = 0 if parent[i] is None else depth[parent[i]] + 1
    want = {i: 0 for i in range(n)}
    for i in range(n):
        at = i
        while at is not None:
            want[at] += i * i
            at = parent[at]
    nodes = spark.createDataFrame([(i, parent[i], depth[i], i * i) for i in range(n)],
                                  "id long, parent long, depth long, w long")
    assert {r["id"]: r["w"] for r in prefix_trie.subtree_totals(nodes, ["w"]).collect()} == want


def _repaired(rows):
    convs = {}
    for c, turn, role, text, *_ in rows:
        convs.setdefault(c, [])
        c_, t_, role, text = (" " if v is None else str(v) for v in (c, turn, role, text))
        kind = zlib.crc32(f"{c_}:{t_}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        convs[c] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    step = {("0", "s"): "1", ("0", "u"): "2", ("1", "u"): "2", ("3", "u"): "2", ("2", "a"): "3"}
    both = (("u", "user:"), ("a", "assistant:"))
    out = {}
    for c, turns in convs.items():
        turns.sort(key=_order)
        seen, faults = set(), []
        for _, role, text in turns:
            s = text.rstrip(WS)
            faults.append("b" if not s else "d" if (role, text) in seen else "" if s[-1] in ".!?" else "t")
            seen.add((role, text))

        @lru_cache(None)
        def best(i, q, inserted, turns=turns, faults=faults):
            ways = [(0, "", ())] if i == len(turns) and q in "03" else []

            def add(cost, letter, i, q, inserted, lines):
                if q:
                    ways.extend((z[0] + cost, letter + z[1], lines + z[2]) for z in best(i, q, inserted))
            if inserted < 3:
                for a, line in both:
                    add(2, "I", i, step.get((q, a)), inserted + 1, (line,))
            if i < len(turns):
                _, role, text = turns[i]
                cut = faults[i] == "t"
                add(3, "D", i + 1, q, 0, ())
                if faults[i] not in ("b", "d"):
                    add(cut, "K", i + 1, step.get((q, role[:1])), 0, (f"{role}:{text}",))
                    for a, line in both:
                        add(2 + cut, "R", i + 1, step.get((q, a)), 0, (line + text,))
            return sorted(ways)[:1]
        for i in range(len(turns), -1, -50):       # keeps the recursion shallow
            for q in "0123":
                best(i, q, 0)
        cost, audit, lines = best(0, "0", 0)[0]
        known = [t for t, _, _ in turns if t is not None]
        initials = [r[:1] for _, r, _ in turns]
        out[c] = (max(known) - min(known) + 1 - len(set(known)) if known else 0,
                  *(faults.count(f) for f in "bdt"),
                  sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
                  cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_repair(conversations, spark, monkeypatch):
    want = _repaired(_rows())
    assert all(any(r[i] for r in want.values()) for i in range(6))
    for block in (repair.BLOCK, 3):
        monkeypatch.setattr(repair, "BLOCK", block)
        got = repair.repair(conversations).collect()
        assert {r[0]: tuple(r)[1:] for r in got} == want and len(got) == len(want)
    assert repair.repair(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repair_without_damage_leaves_sound_conversations_alone(spark):
    rows = [(1, 1, "system", "Be brief."), (1, 2, "user", "Hi!"), (1, 3, "assistant", "Hello."),
            (2, 1, "assistant", "Hello.")]
    sound = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in repair.repair(sound, turns=sound).collect()}
    assert (got[1]["cost"], got[1]["audit"]) == (0, "KKK")
    assert (got[2]["cost"], got[2]["audit"]) == (2, "IK")
    assert got[1]["repaired_sha256"] == hashlib.sha256(
        b"system:Be brief.\nuser:Hi!\nassistant:Hello.").hexdigest()


DOC_SCHEMA = "doc_id long, text string, copy int, shard string, uid int, value string"


def _docs():
    texts = [None, "", " ", "a  b\n\n c", "it's 't !!!", "<|endoftext|> x", "日本語 の 文 \U0001F600", "½ ²2 ªé İ",
             "word " * 30_000, "tab\tand\r\nend ", "Ünï cödé \x85 \xa0 x", "!" * 50]
    docs = [(i * 3 % 11, t) for i, t in enumerate(texts)] + [(None, "no id"), (None, None)]
    return [(i, t, 1, "s", 2, "v") for i, t in docs + [(5, "again"), (5, "again"), (-2, "first")]]


def _ids(text):
    ids = token_index._encoder(None).tokenizer.encode(text or "", add_special_tokens=False).ids
    return np.array([*ids, 0], "<u4")


@pytest.fixture(scope="module")
def token_docs(spark):
    return spark.createDataFrame(_docs(), DOC_SCHEMA).repartition(3).persist()


@pytest.mark.parametrize("sizes", [{}, {"shard_bytes": 60, "bucket_keys": 2}])
def test_token_index(spark, token_docs, sizes):
    root = token_index.write(token_docs, **sizes)
    got = token_index.digest(spark, root, token_index.keys(token_docs)).collect()
    want = defaultdict(list)
    for i, t, *_ in _docs():
        want[i].append((len(_ids(t)), zlib.crc32(_ids(t).tobytes())))
    for i, v in want.items():       # copies of an id in any order
        assert sorted((r["n_tokens"], r["ids_crc32"]) for r in got if r["doc_id"] == i) == sorted(v)
    at = 0
    for r in sorted(got, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["copy"])):
        assert r["start"] == at      # ascending doc_id, nulls first, no gaps
        at += r["n_tokens"]
    assert len(got) == len(_docs())
    # keyed access: the ids themselves; keys that no document has give no row
    asked = spark.createDataFrame([(0, 0), (-2, 0), (None, 1), (7, 5), (1234, 0)], "doc_id long, copy long")
    found = {(r["doc_id"], r["copy"]): list(r["ids"]) for r in token_index.fetch(spark, root, asked).collect()}
    assert found.keys() == {(0, 0), (-2, 0), (None, 1)}
    assert found[-2, 0] == _ids("first").tolist()


def test_token_index_of_nothing(spark):
    none = spark.createDataFrame([], DOC_SCHEMA)
    root = token_index.write(none)
    assert token_index.digest(spark, root, token_index.keys(none)).count() == 0


def test_encoder_equals_library():
    encoder = token_index._encoder(None)
    for t in [x[1] for x in _docs()] + ["a's b'll 12 3x ... ?!\n\n  end", "x" * 300 + " y", "é è\tü"]:
        want = _ids(t).astype("<u2")[:-1].tobytes()
        assert encoder(t) == want
        for size in (1, 7, 50):
            assert b"".join(encoder.part(c) for c in token_index.chunks(t or "", size)) == want
    encoder.memo.clear()
    assert encoder("the end of the end") == _ids("the end of the end").astype("<u2")[:-1].tobytes()


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 3000):
        a, b = (rng.integers(0, 2 ** 64, n, dtype=np.uint64) for _ in range(2))
        blob, slot = token_index.perfect_hash(a, b)
        assert sorted(slot.tolist()) == list(range(n))
        assert np.array_equal(token_index.slots(blob, a, b), slot)
        assert len(blob) * 8 < 10 * n + 1500      # bits a key, besides a small head


def test_queries_match_brute_force(spark):
    from tabfold.llm import queries
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    trie = sorted(tuple(-1 if v is None else v for v in r)
                  for r in queries.op11_prefix_trie(spark, sf).collect())
    assert trie == _trie(rows)
    assert {r[0]: tuple(r)[1:] for r in queries.op12_repair(spark, sf).collect()} == _repaired(rows)
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    at, want = 0, set()
    for i, t in docs:
        ids = _ids(t)
        want.add((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = queries.op13_token_index(spark, sf).select("doc_id", "start", "n_tokens", F.col("ids_crc32"))
    assert set(map(tuple, got.collect())) == want
