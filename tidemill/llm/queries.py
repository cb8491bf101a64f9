"""The ten registered queries: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, oracles


def _vocabulary(name: str) -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import minhash

    return minhash.near_duplicates(common.table(spark, sf_dir, "documents"), size=2)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe

    return bpe.round_trip(common.table(spark, sf_dir, "documents"), *_vocabulary("byte_bpe_multi_50k.tiktoken"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    folder = common.new_folder(spark, "warc")
    index = warc.write(common.table(spark, sf_dir, "pages"), folder)
    return warc.read(index, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import tokenfile

    folder = common.new_folder(spark, "tokens")
    return tokenfile.summary(tokenfile.write(common.table(spark, sf_dir, "documents"), folder, _vocabulary("word_bpe_49k.json")[0]), folder)


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lm

    found = lm.score(common.table(spark, sf_dir, "documents"), lambda i: common.fold(i, 7) != 2)
    return found.select("doc_id", (common.fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate

    found = decontaminate.contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"), min_items=2)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import tiff

    return tiff.digests(common.table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    return pii.find(common.table(spark, sf_dir, "documents")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def _scored(found: DataFrame, cut: float, folds: int = 5) -> DataFrame:
    return found.select("doc_id", (common.fold("doc_id", folds) == 0).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = common.table(spark, sf_dir, "documents")
    return _scored(toxicity.score(docs, toxicity.fit(docs, common.table(spark, sf_dir, "labels"))), 0.5)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = common.table(spark, sf_dir, "documents")
    return _scored(quality.score(docs, quality.fit(docs, common.table(spark, sf_dir, "labels"))), 0.3)


QUERIES = {f.__name__: f for f in (op1_minhash, op2_byte_bpe, op3_pii, op4_toxicity, op5_warc, op6_token_files, op7_language_model, op8_decontaminate, op9_tiff, op10_quality)}

ORACLE_SQL: dict[str, str] = {"op1_minhash": oracles.MINHASH, "op5_warc": oracles.WARC, "op8_decontaminate": oracles.DECONTAMINATE}
