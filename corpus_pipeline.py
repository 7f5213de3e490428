"""A corpus pipeline: five stages, each one operator over all that its predecessor kept.

Every stage but the last returns the columns it was given, under any names: rows travel whole beside what the
operator needs, so no column of the user's meets one of an operator's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.llm import bpe, jaccard, langid, linededup, mixing
from wavemill.llm.columns import ROW, boxed, unboxed
from wavemill.llm.queries import MIXTURE, vocabulary
from wavemill.llm.store import Store


def _rest(docs: DataFrame) -> Column:
    """All columns of a row but its text, which travels beside them."""
    return boxed(docs, [c for c in docs.columns if c != "text"])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told go on, with that language as theirs.

    Null and empty texts, texts without a letter, and texts whose code is no shorter than they are go.  Repeated
    rows are judged alike, each for itself; an empty table gives no rows.
    """
    found = langid.identify(docs.select(_rest(docs), "doc_id", "text", "lang")).where("lang_pred <> 'und' and bits < 8")
    return found.select(*unboxed(docs.columns, text=F.col("text"), lang=F.col("lang_pred")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them; a document left without words goes.

    ``n_chars``, where there is one, follows the text.  Null texts go; rows with a null id keep all lines; rows
    that share an id count as one document; an empty table gives no rows.
    """
    found = linededup.drop_repeated_lines(docs.select(_rest(docs), "doc_id", "text"))
    found = found.where(F.col("kept").rlike("[^\\x20\\x09-\\x0D]"))
    return found.select(*unboxed(docs.columns, text=F.col("kept"), n_chars=F.length("kept").cast("long")))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, five-word shingles of similarity 0.8 or more, goes on.

    SimHash fingerprints and the covering search link them; links it cannot reach are found exactly.
    The one of the smallest id stays; of rows that share an id the one with the smallest text.  Rows with
    a null id stay; texts without words are one group; an empty table gives no rows.
    """
    return jaccard.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their weights; a repeated document is there once for each pass.

    A null source is a source like any other; sources without words go; repeated rows are separate documents; an
    empty table gives no rows.
    """
    mixed = mixing.mix(docs.select(_rest(docs), "doc_id", "text", "source"), **MIXTURE, keep=[ROW, "text"])
    return mixed.select(*unboxed(docs.columns, text=F.col("text")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document and digests of them and of the decoded text; a null text is empty."""
    coded = bpe.encode_and_decode(docs.select("doc_id", "text"), vocabulary())
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The stages hash with XXH64, code contexts and merge bytes, which SQL does not express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written once and read as the next one's input."""
    docs, store = spark.read.parquet(f"{sf_dir}/documents.parquet"), Store(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = store.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
