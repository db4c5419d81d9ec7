"""The queries of this subpackage and, where SQL can state them, their equivalents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bylines.llm.alignment import link_counts
from bylines.llm.bpe import decode, encode
from bylines.llm.exact import exact_dedup
from bylines.llm.fingerprints import as_hex, fingerprint_with_next, likeness
from bylines.llm.html_main import extract_main_text
from bylines.llm.infill import infill, parts, restored
from bylines.llm.jaccard import jaccard_components
from bylines.llm.packing import pack_digests
from bylines.llm.quality import classify
from bylines.llm.secrets import KINDS, find_spans, named
from bylines.llm.shards import shard_records
from bylines.llm.simhash import simhash_components
from bylines.llm.toxicity import held_out, score, train
from bylines.llm.texts import text_or_empty

SHARDS = 24


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint_with_next(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", as_hex(F.col("sig")).alias("fingerprint"), as_hex(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )


def op3_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text_or_empty("text")
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(t) + 8).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.lit("key").alias("law")
    )
    out = shard_records(docs, "doc_id", [1.0] * SHARDS, grown=[1.0] * (SHARDS + 1))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pack_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = decode(encode(read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)
    digits = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(digits.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(read(spark, sf_dir, "documents"))
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long").alias(f"n_{KINDS[i]}")
    return found.select(
        F.col("id").alias("doc_id"), count(0), count(1), count(2),
        F.sha2(named(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        named(F.array_sort(F.concat("base", "linked"))).alias("spans"),
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score(docs, train(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_main_text(read(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = infill(read(spark, sf_dir, "documents"))
    out, form = F.col("output"), F.col("form")
    cut = found.select("doc_id", "n", "form", "output", parts(out, form).alias("x"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    chars = lambda c: F.char_length(c).cast("long")
    return cut.select(
        "doc_id", "n", "form", chars(F.col("x.prefix")).alias("prefix_chars"), chars(F.col("x.middle")).alias("middle_chars"),
        digest(out).alias("output_sha256"), digest(restored(out, form)).alias("restored_sha256"),
    )


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = link_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_weighted_fingerprints": op2_weighted_fingerprints,
    "op3_rendezvous_shards": op3_rendezvous_shards,
    "op4_simhash": op4_simhash,
    "op5_binary_packing": op5_binary_packing,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_secret_scan": op7_secret_scan,
    "op8_toxicity": op8_toxicity,
    "op9_main_text": op9_main_text,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_infill": op11_infill,
    "op12_alignment": op12_alignment,
    "op13_jaccard_join": op13_jaccard_join,
}

ORACLE_SQL = {
    "op10_exact_dedup": """
        WITH d AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
            FROM documents
        ), g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
    """,
    "op11_infill": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h FROM documents),
        l AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS units, t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') AS plain FROM d),
        n AS (SELECT *, len(units) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[25:32])::BIGINT AS h4 FROM l),
        c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN plain THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM n),
        p AS (SELECT doc_id, t, n, form, array_to_string(units[1:a], '') AS x, array_to_string(units[a + 1:b], '') AS y, array_to_string(units[b + 1:], '') AS z FROM c)
        SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(x)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y)::BIGINT END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256, sha256(t) AS restored_sha256
        FROM p
    """,
}
