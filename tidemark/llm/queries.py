"""The corpus operators as registered queries, each over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, counts, decontaminate, encode, quality, rules, simhash, suffix, toxicity, warc
from .common import table
from .labelled import held_out

MODEL_FILE = "piece_bpe_32k.model"


def model_path(name: str = MODEL_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _judged(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), 0.5)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), toxicity.THRESHOLD)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(spark, warc.write(table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _digests(encoded: DataFrame) -> DataFrame:
    return encoded.withColumns({"n_tokens": F.size("ids").cast("long"), "ids_sha256": F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256), "decoded_sha256": F.sha2("decoded", 256)})


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digests(encode.encode(table(spark, sf_dir, "documents"), model_path())).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(table(spark, sf_dir, "documents"), model_path())


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeats(table(spark, sf_dir, "documents")).drop("spans")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def final_tokens(docs: DataFrame) -> DataFrame:
    """The last stage of the corpus pipeline: ids of each document, with digests."""
    return _digests(encode.encode(docs, model_path())).select("doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256")


def queries() -> dict:
    found = {name: f for name, f in globals().items() if name.startswith("op")}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(sha1(html), {5 * (i // 4) + 1}, 5) AS BIGINT) >> {15 - 5 * (i % 4)}) & 31) AS BIGINT), 1)" for i in range(32))

SQL = {
    "op4_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
             o AS (SELECT html, max(page_id) AS owner FROM p GROUP BY html)
        SELECT p.page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, {_BASE32.replace("sha1(html)", "sha1(p.html)")} AS payload_digest,
               CASE WHEN p.page_id = o.owner THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN p.page_id = o.owner THEN NULL ELSE o.owner END AS refers_to
        FROM p JOIN o ON p.html = o.html""",
    "op10_chat_format": """
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
             whole AS (SELECT conv_id, count(*) AS n, list(role || chr(31) || text ORDER BY turn) AS turns,
                              string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) AS text
                       FROM t GROUP BY conv_id),
             shorter AS (SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, n)) AS k FROM whole) x)
        SELECT min(conv_id) AS conv_id, n AS n_turns, count(*) AS n_same, min(text) AS text
        FROM whole WHERE NOT EXISTS (SELECT 1 FROM shorter WHERE shorter.turns = whole.turns) GROUP BY n, turns""",
}
