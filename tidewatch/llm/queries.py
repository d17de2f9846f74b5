"""The registered queries of this folder: each thin query derives its digest columns from an operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.llm import byte_bpe, decontaminate, lm_scoring, oracles, periodic_runs, quality_rules, sharding, simhash, site_quality, substring_dedup, threshold_topk, token_alignment, toxicity, url_filters
from tidewatch.llm.common import words_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def multilingual_vocabulary() -> byte_bpe.Vocabulary:
    return byte_bpe.load_vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op1_substring_dedup")
def op1_substring_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.without_repeats(docs).select("doc_id", "text", "n_removed_words", "first_ids")


@query("op2_lm_scoring")
def op2_lm_scoring(spark, sf_dir):
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out.alias("held_out"), (~held_out).alias("trains"))
    scored = lm_scoring.score(docs, multilingual_vocabulary(), "trains", ["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op3_sharding")
def op3_sharding(spark, sf_dir):
    """Law ``rows``: the 16 shards differ by one row at most."""
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64("text").alias("_tie")
    )
    placed = sharding.shard_rows(rows, ["doc_id", "_tie", "size", "text_crc32"], 16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number"
    )


@query("op4_url_filters", oracles.URL_FILTERS)
def op4_url_filters(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters.judge_urls(pages).select("page_id", "host", "path", "rule", "verdict", "pattern")


@query("op5_quality_classifier")
def op5_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return site_quality.classify(docs, table(spark, sf_dir, "labels"))


@query("op6_decontamination", oracles.DECONTAMINATION)
def op6_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op7_toxicity")
def op7_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", "severity", "p_toxic", "grade", "toxic")


@query("op8_simhash")
def op8_simhash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    near = simhash.near_duplicates(docs)
    return near.select("doc_id", simhash.hex_digits(F.col("fingerprint")).alias("fingerprint"), "component_id")


@query("op9_quality_rules", oracles.QUALITY_RULES)
def op9_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed", ",").alias("failed")
    )


@query("op10_byte_bpe")
def op10_byte_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vocabulary = multilingual_vocabulary()
    both = byte_bpe.decode(byte_bpe.encode(docs, vocabulary, ["doc_id"], binary=True), vocabulary)
    n_tokens = (F.octet_length("token_ids") / 4).cast("long")
    return both.select("doc_id", n_tokens.alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op11_periodic_runs")
def op11_periodic_runs(spark, sf_dir):
    """A tenth of the texts is made periodic from some word on, as the contract says, before the operator sees it."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(h % 10 == 0, words_of(F.col("text"))).alias("w"), F.floor(h / 10).alias("g"))
    n = F.size("w")
    docs = docs.withColumn("a", F.when(n > 0, (F.col("g") % n).cast("int")))
    docs = docs.withColumn("p", F.when(n > 0, F.lit(1) + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)).cast("int")))
    numbers = F.sequence(F.lit(0), n - 1)
    turned = F.transform(numbers, lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))))
    docs = docs.select("doc_id", F.when(n > 0, F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))
    found = periodic_runs.find_runs(docs)
    # The greatest length, then the smallest start, then the smallest period: the greatest of the negated rest.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("b.start"), F.col("b.length"), -F.col("b.period")
    return found.select(
        "doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


@query("op12_cross_tokenizer")
def op12_cross_tokenizer(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pair = token_alignment.load_pair(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return token_alignment.align_documents(docs, pair).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query("op13_exact_topk")
def op13_exact_topk(spark, sf_dir):
    return threshold_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)
