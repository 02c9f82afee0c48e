"""One registered query for each operator, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.llm import bpe_dp, cdc, collocations, line_dedup, line_rules, oracles, packing, quality_cnn, sharding, simhash, suffix_dedup, token_counts, turn_repair, url_classes
from framewise.llm.common import documents
from framewise.plans.registry import Registry

reg = Registry()


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; every operator takes the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


@reg.add("op1_chunk_fingerprints")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.edited_pairs(documents(spark, sf_dir))


@reg.add("op2_prefix_bpe")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_dp.encode(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), decoded=True)
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@reg.add("op3_sparse_suffixes")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.passages(documents(spark, sf_dir))


@reg.add("op4_byte_cnn")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality_cnn.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_cnn.score(docs, model).select(
        "doc_id", quality_cnn.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@reg.add("op5_gray_simhash")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(documents(spark, sf_dir))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@reg.add("op6_line_rules", oracles.LINE_RULES)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = line_rules.judge(documents(spark, sf_dir))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.length("clean_text").cast("long").alias("clean_chars"),
    )


#: The rules of the query's contract. ``url_classes.RULES``, which the SQL is made of, blocks ``net/de/``.
CONTRACT_RULES = (
    ("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


@reg.add("op7_redirect_classes", oracles.URL_CLASSES)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_classes.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules=CONTRACT_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "class_id")


@reg.add("op8_sampled_splitters")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(documents(spark, sf_dir), 8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@reg.add("op9_binary_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@reg.add("op10_two_tier_counts")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


@reg.add("op11_phrase_growth", oracles.PHRASES)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


@reg.add("op12_line_dedup", oracles.LINE_DEDUP)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_frequent_lines(documents(spark, sf_dir))
    return out.select("input.doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@reg.add("op13_turn_repair", oracles.TURN_REPAIR)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turn_repair.repairs(turn_repair.damage(conversations), conversations)


QUERIES, SQL = reg.queries, reg.sql
