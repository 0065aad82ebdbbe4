"""Conversation repair at least cost over a suffix-shared word graph.

A conversation, from its last turn to its first, is cut into blocks of
``BLOCK`` turns. A block's signature has a sign per turn: its role's class (s,
u, a, else o; a capital: truncated), or x where the turn must go. Signatures
are minimised from the end over all conversations: they are made distinct and
sorted by their reverse, so that those with a common suffix meet, and each
suffix - a node of the graph - is worked out once: for every grammar state
before it and every state after it the least cost and, of the audits of that
cost, the least text. (Where two ranges of signatures meet, the few shared
nodes are worked out on both sides.)

States of the grammar (s?(ua)+)?: 0 nothing yet, 1 after s, 2 after u, 3 after
a. A block's audit ends with a turn's own letter, so no audit between two
states is another's beginning, and the least text of the whole is made of
least texts of the blocks.

One pass over a conversation's blocks then gives its states, and per turn its
edit. Turns are numbered by ranges, signatures hold ``BLOCK`` signs, and the
digests run over sorted rows, so no conversation is held whole, save its audit
(four candidates of it, a letter a turn).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_ranges, numbered, written
from .prefix_trie import CRC32

BLOCK = 256
STATES = range(4)
SPACE = " \t\n\x0b\x0c\r"
TEXT_ORDER = 64      # characters of a text that rule the order of equal turn numbers
ORDER = ["turn", "role", "head", "digest"]
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1   # costs (fixed by contract)

Entry = tuple[int, str] | None      # least cost and its audit; None: no way
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
# inserts that lead from a state to another, and those that end a conversation
INSERTS = {(q, q): "" for q in STATES} | {
    (0, 2): "u", (0, 3): "ua", (1, 2): "u", (1, 3): "ua", (2, 3): "a", (3, 2): "u"}
END = {0: "", 1: "ua", 2: "a", 3: ""}


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) after the damage that crc32(conv_id:turn) % 20 rules."""
    def known(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn"))) % 20
    text = (F.when(F.col("kind") == 1, F.lit(""))
            .when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    return conversations.select(
        "conv_id", "turn", known("role").alias("role"), known("text").alias("text"),
        kind.alias("kind")).filter("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
        .alias("copy")).drop("copy")


def _turns(conversations: DataFrame) -> DataFrame:
    """The turns in order, written: c (the conversation's key), turn, role, text, digest, at, cell."""
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))
    rows = conversations.select(
        key.alias("c"), "turn", "role", "text", F.left("text", F.lit(TEXT_ORDER)).alias("head"),
        F.sha2(F.concat_ws(":", F.char_length("role"), "role", "text"), 256).alias("digest"))
    return in_ranges(rows, ["c"], ORDER, "turns").drop("head")


def _signs(turns: DataFrame) -> DataFrame:
    """Per turn (c, block, nth): its role class, fault and sign."""
    stripped = F.expr(f"trim(TRAILING '{SPACE}' FROM text)")
    first = F.left("role", F.lit(1))
    narrow = numbered(turns.select(
        "c", "cell", "at", "digest", (stripped == "").alias("blank"),
        (~F.right(stripped, F.lit(1)).isin(".", "!", "?")).alias("cut"),
        F.when(first.isin("s", "u", "a"), first).otherwise("o").alias("role")), ["c"], "cell", "at")
    firsts = turns.groupBy("c", "digest").agg(F.min("at").alias("at")).select(
        "at", F.lit(True).alias("first"))
    fault = (F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate")
             .when(F.col("cut"), "truncated").otherwise("none"))
    return (_blocked(narrow).join(firsts, "at", "left").withColumn("fault", fault)
            .withColumn("sign", F.when(F.col("fault").isin("blank", "duplicate"), "x")
                        .when(F.col("fault") == "truncated", F.upper("role")).otherwise(F.col("role"))))


def _blocked(placed: DataFrame) -> DataFrame:
    """Blocks from the end (0: the last) and the turn's place inside, from 0."""
    block = F.floor((F.col("n_part") - F.col("pos")) / BLOCK).cast("long")
    begin = F.greatest(F.col("n_part") - (F.col("block") + 1) * BLOCK, F.lit(0))
    return placed.withColumn("block", block).withColumn("nth", (F.col("pos") - 1 - begin).cast("int"))


def _blocks(signs: DataFrame) -> DataFrame:
    """Per block: its signature, role classes at the borders, and counts of faults."""
    def faults(kind):
        return F.sum((F.col("fault") == kind).cast("long")).alias(kind)
    listed = signs.groupBy("c", "block").agg(
        F.array_sort(F.collect_list(F.struct("nth", "sign", "role"))).alias("t"),
        faults("blank"), faults("duplicate"), faults("truncated"))
    whole = listed.withColumn("word", F.expr("array_join(transform(t, x -> x.sign), '')")).withColumn(
        "roles", F.expr("array_join(transform(t, x -> x.role), '')"))
    illegal = F.expr("""if(length(roles) < 2, 0, size(filter(sequence(1, length(roles) - 1),
        i -> substring(roles, i, 2) not in ('su', 'ua', 'au'))))""")
    return whole.select("c", "block", "word", "blank", "duplicate", "truncated",
                        illegal.cast("long").alias("illegal"), F.left("roles", F.lit(1)).alias("head"),
                        F.right("roles", F.lit(1)).alias("tail"))


def sign_entries(sign: str) -> list[Entry]:
    """The 4 x 4 ways through one turn: inserts before it, then its own edit."""
    out: list[Entry] = [None] * 16
    for (q, m), inserted in INSERTS.items():
        ways = [(DELETE, "D", m)]
        if sign != "x":
            extra = TRUNCATED if sign.isupper() else 0
            ways += [(KEEP + extra, "K", STEP.get((m, sign.lower())))]
            ways += [(REROLE + extra, "R", STEP.get((m, to))) for to in "ua"]
        for cost, letter, r in ways:
            if r is not None:
                way = (cost + INSERT * len(inserted), "I" * len(inserted) + letter)
                at = 4 * q + r
                out[at] = way if out[at] is None else min(out[at], way)
    return out


def chained(left: list[Entry], right: list[Entry]) -> list[Entry]:
    """The ways through two stretches, one after the other."""
    out: list[Entry] = [None] * 16
    for q in STATES:
        for s in STATES:
            ways = [(left[4 * q + r][0] + right[4 * r + s][0], left[4 * q + r][1] + right[4 * r + s][1])
                    for r in STATES if left[4 * q + r] and right[4 * r + s]]
            out[4 * q + s] = min(ways, default=None)
    return out


NOTHING: list[Entry] = [(0, "") if at % 5 == 0 else None for at in range(16)]


def _graph(words: DataFrame) -> DataFrame:
    """Per distinct signature its entries (word, costs, audits), nodes shared by suffix."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signs: dict[str, list[Entry]] = {}
        path, nodes = "", [NOTHING]         # the last signature, reversed, and its suffixes' nodes
        for batch in batches:
            costs, audits = [], []
            for back in batch["back"]:
                same = 0
                while same < min(len(path), len(back)) and path[same] == back[same]:
                    same += 1
                del nodes[same + 1:]
                for sign in back[same:]:
                    if sign not in signs:
                        signs[sign] = sign_entries(sign)
                    nodes.append(chained(signs[sign], nodes[-1]))
                path = back
                costs.append([None if e is None else e[0] for e in nodes[-1]])
                audits.append([None if e is None else e[1] for e in nodes[-1]])
            yield pd.DataFrame({"back": batch["back"], "costs": costs, "audits": audits})
    backs = words.select(F.reverse("word").alias("back")).distinct()
    return (backs.repartitionByRange("back").sortWithinPartitions("back")
            .mapInPandas(work, "back string, costs array<int>, audits array<string>")
            .select(F.reverse("back").alias("word"), "costs", "audits"))


def script(word: str, state: int, audit: str) -> list[str]:
    """Per turn of a block the roles (u, a) inserted before it and its edit: K, D, u or a."""
    out, item, at = [], "", 0
    for letter in audit:
        to = "a" if state == 2 else "u"
        if letter == "I":
            item += to
            state = STEP[state, to]
            continue
        if letter == "R":
            state = STEP[state, to]
        elif letter == "K":
            state = STEP[state, word[at].lower()]
        out.append(item + (to if letter == "R" else letter))
        item, at = "", at + 1
    return out


def _choices(blocks: list, costs, audits) -> tuple[list[int], list[int], list]:
    """``blocks``: (costs to go, ranks of audits to go, choices) so far; one block before them."""
    to_go, ranks, _ = blocks[-1]
    best = []
    for q in STATES:
        ways = [(costs[4 * q + r] + to_go[r], audits[4 * q + r], ranks[r], r)
                for r in STATES if audits[4 * q + r] is not None]
        best.append(min(ways))
    order = sorted({(b[1], b[2]) for b in best})
    return ([b[0] for b in best], [order.index((b[1], b[2])) for b in best],
            [(b[3], b[1]) for b in best])


REPAIR = ("c string, block long, script array<string>, illegal long, cost long, audit string, "
          "added string")


def _repaired(blocks: DataFrame, graph: DataFrame) -> DataFrame:
    """Per block its script, and per conversation (block -1) illegal, cost, audit and end inserts."""
    first = ([INSERT * len(END[q]) for q in STATES], [len(END[q]) for q in STATES], None)

    def finished(c, run, illegal) -> Iterator[tuple]:
        state, audit = 0, []
        for back in range(len(run) - 1, 0, -1):
            number, word, choices = run[back][2]
            r, piece = choices[state]
            yield c, number, script(word, state, piece), None, None, None, None
            audit.append(piece)
            state = r
        added = END[state]
        yield (c, -1, None, illegal, int(run[-1][0][0]), "".join(audit) + "I" * len(added), added)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, run, illegal, head = None, [first], 0, ""
        out: list[tuple] = []
        names = [f.split()[0] for f in REPAIR.split(", ")]
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.c != c:
                    if c is not None:
                        out += finished(c, run, illegal)
                    c, run, illegal, head = row.c, [first], 0, ""
                costs, ranks, choices = _choices(run, row.costs, row.audits)
                run.append((costs, ranks, (row.block, row.word, choices)))
                illegal += row.illegal + (head != "" and row.tail + head not in ("su", "ua", "au"))
                head = row.head
            yield pd.DataFrame(out, columns=names)
            out = []
        if c is not None:
            yield pd.DataFrame(list(finished(c, run, illegal)), columns=names)

    known = blocks.join(graph, "word").select(
        "c", "block", "word", "costs", "audits", "illegal", "head", "tail")
    return known.repartition("c").sortWithinPartitions("c", "block").mapInPandas(fold, REPAIR)


def _digests(lines: DataFrame) -> DataFrame:
    """(c, repaired_sha256): each conversation's lines, in order, through one running digest."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, digest = None, None
        for batch in batches:
            out = []
            for key, text in zip(batch["c"], batch["lines"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")[:-1]
                if key == c:
                    digest.update(b"\n" + raw)
                    continue
                if c is not None:
                    out.append((c, digest.hexdigest()))
                c, digest = key, hashlib.sha256(raw)
            yield pd.DataFrame(out, columns=["c", "repaired_sha256"])
        if c is not None:
            yield pd.DataFrame([(c, digest.hexdigest())], columns=["c", "repaired_sha256"])
    return (lines.repartition("c").sortWithinPartitions("c", "pos").select("c", "lines")
            .mapInPandas(run, "c string, repaired_sha256 string"))


def repaired_lines(turns: DataFrame, repairs: DataFrame) -> DataFrame:
    """(c, pos, lines): the repaired ``role:text`` lines that each turn gives, line feeds after each."""
    placed = _blocked(numbered(turns.select("c", "role", "text", "cell", "at"), ["c"], "cell", "at"))
    edited = placed.join(repairs.filter("block >= 0").select("c", "block", "script"),
                         ["c", "block"]).withColumn("edit", F.expr("script[nth]"))
    own = F.expr("""case right(edit, 1) when 'K' then concat(role, ':', text, '\\n')
        when 'u' then concat('user:', text, '\\n') when 'a' then concat('assistant:', text, '\\n')
        else '' end""")

    def inserted(letters):
        return F.replace(F.replace(letters, F.lit("a"), F.lit("assistant:\n")),
                         F.lit("u"), F.lit("user:\n"))
    before = inserted(F.expr("left(edit, length(edit) - 1)"))
    return edited.select("c", "pos", F.concat(before, own).alias("lines")).unionByName(
        repairs.filter("block < 0").select("c", F.lit((1 << 63) - 1).alias("pos"),
                                           inserted(F.col("added")).alias("lines"))).filter("lines <> ''")


def repair(conversations: DataFrame, turns: DataFrame | None = None) -> DataFrame:
    """One row per conv_id of ``conversations``: conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit, repaired_sha256.

    ``turns``: the rows to repair (conv_id, turn, role, text without null role
    or text), by default ``damaged(conversations)``; other columns are ignored.
    Turns go by turn number, nulls first; equal numbers by role, the text's
    first characters and its digest. A null conv_id is a conversation of its
    own. A conversation without rows to repair has zeros, no audit, and the
    digest of the empty string.
    """
    rows = damaged(conversations) if turns is None else turns
    ordered = _turns(rows)
    blocks = written(_blocks(_signs(ordered)), "blocks")
    graph = written(_graph(blocks.select("word")), "graph")
    repairs = written(_repaired(blocks, graph), "repairs")
    counts = blocks.groupBy("c").agg(*[F.sum(k).alias(k) for k in ("blank", "duplicate", "truncated")])
    gaps = ordered.groupBy("c").agg((F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).alias("gaps"))
    sums = repairs.filter("block < 0").select("c", "illegal", "cost", "audit")
    shas = _digests(repaired_lines(ordered, repairs))
    convs = conversations.select("conv_id", F.coalesce(
        F.col("conv_id").cast("string"), F.lit(" ")).alias("c")).distinct()
    whole = convs
    for part in (gaps, counts, sums, shas):
        whole = whole.join(part, "c", "left")
    zeros = [F.coalesce(k, F.lit(0)).cast("long").alias(k)
             for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return whole.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256))
                        .alias("repaired_sha256"))


def _sql_way(state: str, cost: str, letter: str, line: str = "''") -> str:
    return f"{{'c': {state}.c + {cost}, 'a': '{letter}' || {state}.a, 't': {line} || {state}.t}}"


def _sql_best(*ways: str) -> str:
    return f"list_sort([{', '.join(ways)}])[1]"


def _sql_turn(q: str, keeps: str) -> str:
    """The best way from state q over a turn; ``keeps``: what each role class leads to."""
    to, role = ("A", "assistant:") if q == "U" else ("U", "user:")
    ways = [_sql_way(f"dp.{q}", "3", "D")]
    kept = " ".join(f"WHEN k = '{k}' THEN {_sql_way(f'dp.{r}', 'e', 'K', 'own')}"
                    for k, r in (w.split(">") for w in keeps.split()))
    gone = "{'c': 1000000000, 'a': '', 't': ''}"
    ways += [f"CASE WHEN x THEN {gone} {kept} ELSE {gone} END",
             f"CASE WHEN x THEN {gone} ELSE "
             + _sql_way(f"dp.{to}", "2 + e", "R", f"'{role}' || body") + " END"]
    return _sql_best(*ways)


_USER, _ASSISTANT = "'user:' || chr(10)", "'assistant:' || chr(10)"
ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {CRC32.format("key")} % 20 AS kind
  FROM (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')
               AS key FROM conversations)),
 g AS (SELECT coalesce(CAST(conv_id AS VARCHAR), ' ') AS c, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
              CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
              unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
       FROM d WHERE kind <> 0),
 s AS (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS z, left(role, 1) AS k,
              row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS pos FROM g),
 o AS (SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY pos) AS nth FROM s),
 f AS (SELECT *, CASE WHEN z = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate'
                      WHEN right(z, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
              lag(k) OVER (PARTITION BY c ORDER BY pos) AS before FROM o),
 n AS (SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
              count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
              count(*) FILTER (fault = 'truncated') AS truncated,
              count(*) FILTER (before || k NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY c),
 dp AS (
  SELECT c, n + 1 AS i, {{'c': 0, 'a': '', 't': ''}} AS N,
         {{'c': 4, 'a': 'II', 't': {_USER} || {_ASSISTANT}}} AS S,
         {{'c': 2, 'a': 'I', 't': {_ASSISTANT}}} AS U, {{'c': 0, 'a': '', 't': ''}} AS A FROM n
  UNION ALL
  SELECT c, i, {_sql_best("N", _sql_way("V", "2", "I", _USER))},
         {_sql_best("S", _sql_way("V", "2", "I", _USER))}, V,
         {_sql_best("A", _sql_way("U", "2", "I", _USER))}
  FROM (SELECT *, {_sql_best("U", _sql_way("A", "2", "I", _ASSISTANT))} AS V
        FROM (SELECT dp.c, r.pos AS i, {_sql_turn("N", "s>S u>U")} AS N, {_sql_turn("S", "u>U")} AS S,
                     {_sql_turn("U", "a>A")} AS U, {_sql_turn("A", "u>U")} AS A
              FROM dp JOIN (SELECT c, pos, k, fault IN ('blank', 'duplicate') AS x,
                                   CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS e,
                                   text || chr(10) AS body, role || ':' || text || chr(10) AS own FROM f) r
                   ON r.c = dp.c AND r.pos = dp.i - 1)))
SELECT v.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank,
       coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(dp.N.c, 0) AS BIGINT) AS cost,
       coalesce(dp.N.a, '') AS audit,
       sha256(coalesce(left(dp.N.t, greatest(length(dp.N.t) - 1, 0)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) v
     LEFT JOIN n ON n.c = coalesce(CAST(v.conv_id AS VARCHAR), ' ')
     LEFT JOIN dp ON dp.c = n.c AND dp.i = 1"""
