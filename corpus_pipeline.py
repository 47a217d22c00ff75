"""A training-data pipeline over `documents`, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents. An empty table goes
through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillroster.llm.bpe import bpe_encode
from quillroster.llm.common import materialise
from quillroster.llm.decontaminate import drop_contaminated
from quillroster.llm.exact_dedup import drop_copies
from quillroster.llm.language_id import UNKNOWN, fit, identify
from quillroster.llm.near_dups import drop_near_duplicates
from quillroster.llm.queries import vocabulary

#: How far the best language's pooled probability has to lie from chance (0) to certainty (1), whatever the number of languages.
LEAST_SURE = 0.2
#: A column that holds the rest of a row while its text is judged, so that none of its columns can clash.
MARK = "_whole_row"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts in a learned language; those without letters, and those that resemble none, go.

    The document's own lang value stays as it is. Where no language could be learned, texts with letters stay.
    """
    net = fit(docs, "doc_id", "text", "lang")
    if net is None:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    rest = [c for c in docs.columns if c != "text"]
    found = identify(docs.select("text", F.struct(*rest).alias(MARK)), net)
    chance = 1 / len(net.languages) if len(net.languages) > 1 else 0.0
    kept = found.where((F.col("lang_pred") != UNKNOWN) & ((F.col("score") - chance) / (1 - chance) >= LEAST_SURE))
    return kept.select(*["text" if c == "text" else F.col(MARK)[c].alias(c) for c in docs.columns])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of equal texts."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each class of near duplicates."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that overlap with a benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of what is left, with digests of the ids and of the text that they decode to."""
    coded = bpe_encode(docs, vocabulary("byte_bpe_50k.json"), decode=True)
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("decontaminate", decontaminate), ("tokens", tokens)]

#: Learned models, sketches and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
