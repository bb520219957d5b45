"""The registered queries over whole tables, and the SQL they must agree with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipmine.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return fn

    return register


@_query("op1_feistel_shards")
def shards(spark: SparkSession, table) -> DataFrame:
    from clipmine.llm.sharding import sharded

    docs = table("documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = sharded(rows, shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@_query("op2_family_svm")
def languages(spark: SparkSession, table) -> DataFrame:
    from clipmine.llm import language

    docs = table("documents")
    labelled = docs.where(~language.held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    out = language.predicted(docs, language.fit(labelled))
    return out.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@_query("op6_golomb_exact_dedup", """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents),
ranked AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM ranked
""")
def exact(spark: SparkSession, table) -> DataFrame:
    from clipmine.llm.exact_dedup import duplicates

    return duplicates(table("documents"))


@_query("op7_grouping_genetic_packing")
def packing(spark: SparkSession, table) -> DataFrame:
    from clipmine.llm.packing import placements

    return placements(table("documents"))


@_query("op10_prefix_target_chat")
def chats(spark: SparkSession, table) -> DataFrame:
    from clipmine.llm.chat import formatted, read_examples, written

    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    turns = table("conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return read_examples(written(formatted(turns)))


@_query("op9_anchor_substring_dedup")
def passages(spark: SparkSession, table) -> DataFrame:
    from clipmine.llm.substring_dedup import report

    return report(table("documents"))


@_query("op8_icws_near_dedup")
def near(spark: SparkSession, table) -> DataFrame:
    from clipmine.llm.near_dedup import classes

    return classes(table("documents"))


@_query("op5_trie_token_counts")
def counts(spark: SparkSession, table) -> DataFrame:
    from clipmine.llm.pieces import model_file
    from clipmine.llm.token_counts import token_counts

    return token_counts(table("documents"), model_file())


@_query("op4_relational_lattice")
def lattice(spark: SparkSession, table) -> DataFrame:
    from clipmine.llm.lattice import encoded
    from clipmine.llm.pieces import model_file

    return encoded(table("documents"), model_file(), keep_ids=False)


@_query("op3_cross_polytope_nearest")
def neighbours(spark: SparkSession, table) -> DataFrame:
    from clipmine.llm.nearest import nearest

    return nearest(table("embeddings"), F.col("id") % 20 == 0, k=20)


_H = "('0x' || substr(sha256('7:' || doc_id), {}, 8))::BIGINT"


@_query("op12_piece_table_middle", f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines,
    {_H.format(1)} AS h1, {_H.format(9)} AS h2, {_H.format(17)} AS h3, {_H.format(25)} AS h4 FROM documents),
c AS (
  SELECT *, len(lines) AS n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS a, greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
      WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (
  SELECT *, array_to_string(lines[1:a], '') AS pre, array_to_string(lines[a + 1:b], '') AS mid, array_to_string(lines[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
""")
def middles(spark: SparkSession, table) -> DataFrame:
    from clipmine.llm.fill_middle import read_back, transformed

    return read_back(transformed(table("documents")))


@_query("op11_integer_weight_repair")
def repairs(spark: SparkSession, table) -> DataFrame:
    from clipmine.llm.repair import damaged, repaired, report, with_empty

    turns = table("conversations")
    return with_empty(turns, report(repaired(damaged(turns))))


@_query("op13_consensus_host_paths")
def texts(spark: SparkSession, table) -> DataFrame:
    from clipmine.llm.pages import main_texts

    return main_texts(table("pages"))
