"""Queries of the training-data operators over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_progressive_jpeg(spark, sf_dir):
    from .media import store_and_read

    out = store_and_read(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "height", "width", "rgb")


def op2_arrow_token_files(spark, sf_dir):
    from .token_files import read, write

    return read(write(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")))


def op3_latent_decontamination(spark, sf_dir):
    from .decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_warc_chains(spark, sf_dir):
    from .warc import read, write

    return read(write(table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_secret_scan(spark, sf_dir):
    from .secret_scan import digest

    return digest(table(spark, sf_dir, "documents"))


def op6_mix_sources(spark, sf_dir):
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_toxicity(spark, sf_dir):
    from .toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")


def op8_suffix_dedup(spark, sf_dir):
    from .suffix_dedup import dedup

    return dedup(table(spark, sf_dir, "documents")).drop("spans")


def op9_token_counts(spark, sf_dir):
    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op10_jaccard_join(spark, sf_dir):
    from .near_join import join

    return join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "copy_id")


def op11_line_runs(spark, sf_dir):
    from .line_runs import dedup

    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_fill_middle(spark, sf_dir):
    from .fill_middle import digest

    return digest(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark, sf_dir):
    from .hard_negatives import mine, quantised

    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(quantised(rows.withColumn("label", label), scale=256), anchor=F.col("id") % 100 == 0)


def queries():
    return {k: v for k, v in globals().items() if k.startswith("op")}
