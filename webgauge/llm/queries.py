"""The registered queries of this subpackage: thin calls of the operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from webgauge.llm import chat, decontaminate, jaccard, lattice, mixing, quality, ranking, secrets, sharding, token_files, toxicity, url_filter, whitening

SHARDS = 24
URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Names of hosts whose pages make up the list of blocked URLs.
LISTED_HOSTS = ("spam-farm", "cheap-pills", "casino-win", "free-bets", "ads-track", "adult-x")
CHAT_PROBE = "</s>[INST] ok [/INST]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.similar_vectors(table(spark, sf_dir, "embeddings"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    name = F.regexp_extract(url_filter.host_of(F.col("url")), r"(?:^|\.)([^.]+)\.[^.]+\.[^.]+$", 1)
    listed = pages.where(name.isin(*LISTED_HOSTS)).select("url")
    return url_filter.judge_urls(pages, url_filter.rule_table(spark, URL_RULES), listed)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), details=True)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.grade_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_matches(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "match.n_words", "match.n_hit", "match.n_items", "match.items_sha256", "match.contaminated", "match.longest")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = token_files.new_folder(spark)
    token_files.write_tokens(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.checksums(token_files.read_tokens(spark, folder))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard_rows(table(spark, sf_dir, "documents"), SHARDS)
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return dealt.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten_vectors(table(spark, sf_dir, "embeddings"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CHAT_PROBE).alias("text"))
    turns = turns.unionByName(probe)
    whole = chat.join_turns(chat.format_turns(turns))
    read = whole.select("conv_id", chat.formatted_text(F.col("segments")).alias("formatted"), chat.loss_text(F.col("segments")).alias("loss"))
    read = read.withColumn("turns", chat.read_back(F.col("formatted")))
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    digests = read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    order = chat.check_order(turns).select(F.col("conv_id").alias("checked"), "valid")
    return digests.join(order, F.col("conv_id").eqNullSafe(F.col("checked"))).drop("checked")


QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_quality_discriminant": op1_quality_discriminant,
    "op2_lattice_dedup": op2_lattice_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_mix_sources": op4_mix_sources,
    "op5_toxicity": op5_toxicity,
    "op6_decontamination": op6_decontamination,
    "op7_token_files": op7_token_files,
    "op8_sharding": op8_sharding,
    "op9_secret_scan": op9_secret_scan,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_whitening": op11_whitening,
    "op12_lexical_search": op12_lexical_search,
    "op13_chat_format": op13_chat_format,
}
