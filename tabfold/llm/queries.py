"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabfold.session import scratch_path

from . import (chat, decontaminate, exact_dedup, language, licenses, packing, prefix_trie, quality,
               repair, reshard, secrets, simhash, token_index)
from .common import table, written


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"),
                                       table(spark, sf_dir, "benchmark")).drop("text_hash")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotated(table(spark, sf_dir, "conversations"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train(secrets.labelled_samples(docs)))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    placed = written(reshard.reshard(docs), "resharded")
    reshard.rewrite(docs, placed, scratch_path(spark, "shards"))
    return placed.drop("old_shard")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash", "kept")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(table(spark, sf_dir, "conversations"))


def op13_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    root = token_index.write(docs)
    return token_index.digest(spark, root, token_index.keys(docs))


QUERIES = {f.__name__: f for f in (
    op1_decontaminate, op2_quality, op3_chat, op4_secrets, op5_exact_dedup, op6_language,
    op7_licenses, op8_reshard, op9_simhash, op10_packing, op11_prefix_trie, op12_repair,
    op13_token_index)}

_NORM = ("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
         "'abcdefghijklmnopqrstuvwxyz')")

ORACLES = {
    "op1_decontaminate": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_NORM}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
           FROM documents),
 b AS (SELECT item_id, regexp_extract_all({_NORM}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
       FROM benchmark),
 win AS (SELECT DISTINCT item_id, w[s:s + least(len(w), 10) - 1] AS x
         FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s
               FROM b WHERE len(w) > 0)),
 sizes AS (SELECT DISTINCT len(x) AS k FROM win),
 place AS (SELECT doc_id, k, s, w[s:s + k - 1] AS x
           FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s
                 FROM d, sizes WHERE len(w) >= k)),
 hit AS (SELECT place.doc_id, place.s, place.k, win.item_id FROM place JOIN win ON place.x = win.x),
 hitword AS (SELECT doc_id, count(DISTINCT p) AS n_hit
             FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hit) GROUP BY doc_id),
 item AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hitword USING (doc_id) LEFT JOIN item USING (doc_id)""",
    "op3_chat": chat.ORACLE,
    "op11_prefix_trie": prefix_trie.ORACLE,
    "op12_repair": repair.ORACLE,
    "op5_exact_dedup": f"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, {_NORM} AS norm FROM documents) WINDOW g AS (PARTITION BY norm)""",
}
