"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.llm import ann, bpe, dialogue, langid, linededup, mixing, periodic, pii, quality, repeats, secrets, simhash, token_files

#: Environment variable that names another vocabulary file.
VOCABULARY = "WAVEMILL_VOCABULARY"
#: Entropy of the mixture as a share of the largest possible, and passes over a source at most.
MIXTURE = {"target_entropy": 0.999, "max_repeats": 4.0}


def vocabulary() -> str:
    """Path of the vocabulary; it must be the same on every executor."""
    if VOCABULARY in os.environ:
        return os.environ[VOCABULARY]
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), vocabulary())


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.summary(secrets.find_secrets(table(spark, sf_dir, "documents")), ("assign", "access", "hex"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.summary(pii.find_pii(table(spark, sf_dir, "documents")), pii.KINDS)


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_and_decode(table(spark, sf_dir, "documents"), vocabulary())
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), **MIXTURE, keep=["doc_id", "source"])
    return mixed.select("doc_id", "source", "epoch", "position", "tokens", "weight", "exponent")


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.drop_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs).select("doc_id", "held_out", "lang_pred", "score")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op11_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.repair(dialogue.damaged(table(spark, sf_dir, "conversations")), copies_col="copies")


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic.find_runs(docs, edit=periodic.planted)
    less = lambda x, y: x["length"] * y["period"] < y["length"] * x["period"]
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    # Runs come by start, then period, so the first of equal exponents stays.
    best = F.aggregate("runs", none, lambda x, y: F.when(x.isNull() | less(x, y), y).otherwise(x)).alias("best")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best, F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("1000 * best.length div best.period").alias("exponent_milli")
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli, "runs_sha256", "collapsed_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_simhash, op2_token_files, op3_secrets, op4_pii, op5_nearest, op6_bpe, op7_mixing, op8_lines, op9_language, op10_quality, op11_dialogue, op12_repeats, op13_periodic, pipeline]
    return {f.__name__: f for f in own}
