"""The corpus pipeline: language ID, near-duplicate removal, mixing, tokenization.

STAGES run in order; each is written as Parquet and read again as the next
one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import jaccard_join, language_id, mixing, sentencepiece_codec
from eventloom.llm.queries import tokenizer_path
from eventloom.llm.scratch import dropped, written

#: Documents that are no closer than this to any language's profile are rejected, with those without letters.
LEAST_SCORE = 0.15


def _own_names(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table under names that no column which a stage computes can have, and what each column is called now."""
    names = [f"own{k}__" for k in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names, strict=True))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no known language, and puts the predicted language where none is given."""
    rows = language_id.profiles(docs.where(~language_id.held_out()))
    base, at = _own_names(docs)
    out = language_id.predict(base, rows, text=at["text"])
    kept = out.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn(at["lang"], F.coalesce(at["lang"], "lang_pred")).select(*base.columns).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies (five-word shingles, Jaccard 0.8 or more) the one with the smallest id."""
    return jaccard_join.deduplicated(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    base, at = _own_names(docs)
    mixed = mixing.mix(base, text=at["text"], source=at["source"], doc_id=at["doc_id"])
    return mixing.repeated(mixed, base.columns).toDF(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of them and of what they decode to."""
    out = sentencepiece_codec.round_trip(docs.select("doc_id", "lang", "source", "text"), tokenizer_path())
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return out.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", sha("ids").alias("ids_sha256"), sha("decoded").alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", tokenize),
]
#: No SQL: rank-order profiles, knapsack tables and merge rounds are no SQL expressions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; the table that a stage read is deleted when the next one is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
            if last is not None:
                dropped(last)
            last = docs
    return docs
