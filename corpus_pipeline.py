"""From raw documents to token ids: five stages, each an operator of rillwork.llm on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.llm import bpe, jaccard, line_dedup, phrase_index, quality_cnn
from rillwork.llm.common import give_back, materialize, packed, read, small, unpacked
from rillwork.llm.queries import QUALITY_THRESHOLD, vocabulary

#: Lines of more words are dropped from two documents on; a document that would lose this share of its words is a copy.
LONG_WORDS, COPY_SHARE = 50, 0.35


def held(docs: DataFrame) -> DataFrame:
    """The document but for its text as one struct, so that its columns clash with none of an operator, and its text, id, and a key: the id and 128 bits of the text's hash.

    Rows that share a key are alike for all that follows."""
    text = F.col("text").cast("string")
    key = F.struct(F.col("doc_id").alias("id"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))
    return docs.select(packed(_rest(docs)), F.col("doc_id").alias("id"), text.alias("text"), key.alias("key"))


def _rest(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c != "text"]


def given(found: DataFrame, docs: DataFrame, text: Column | None = None) -> DataFrame:
    """The columns of ``docs`` from the struct and the text, or a new text and, if there is n_chars, its length."""
    columns = dict(zip(_rest(docs), unpacked(_rest(docs)), strict=True)) | {"text": (F.col("text") if text is None else text).alias("text")}
    if text is not None and "n_chars" in columns:
        columns["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return found.select(*[columns[c] for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels, scores below the threshold go."""
    scored = quality_cnn.score(held(docs).select("row", "text"), quality_cnn.fit(docs, read(spark, sf_dir, "labels")))
    return given(scored.where(F.col("score") >= QUALITY_THRESHOLD), docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in the first document (by doc_id) only: those of ten documents or more, and those of over 50 words of two or more.

    A document that would lose 35 % of its words or more is taken for a copy: it stays whole, and near_dedup judges it."""
    found = line_dedup.line_dedup(held(docs).select("row", "id", "text"), min_docs=10, min_chars=1, keep_first_by="id", long_words=LONG_WORDS, copy_share=COPY_SHARE)
    return given(found, docs, F.col("kept_text"))


def same_key(left: str = "key", right: str = "of") -> Column:
    """Two keys are equal, null ids being equal to each other."""
    a, b = F.col(left), F.col(right)
    return a["id"].eqNullSafe(b["id"]) & (a["a"] == b["a"]) & (a["b"] == b["b"])


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, a similarity of 0.8 or more) stays: the one of least doc_id."""
    give_back(spark)
    rows = held(docs)
    groups = materialize(jaccard.near_copies(rows.select("key", "text"), "key", width=5, similarity="0.8"))
    stay = materialize(groups.where(F.col("key") == F.col("component_id")).groupBy(F.col("key").alias("of")).agg(F.count("*").alias("n")))
    kept = rows.join(stay.select("of"), same_key(), "left_semi")
    if stay.where("n > 1").limit(1).count():  # repeated rows
        kept = kept.dropDuplicates(["key"])
    return given(kept, docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold passages of two benchmark items or more go; from others a single item's passage is cut."""
    give_back(spark)
    rows = held(docs)
    found = phrase_index.contamination(rows.select("key", "text"), read(spark, sf_dir, "benchmark"), size=8, min_items=2, id_col="key")
    hit = materialize(found.where("n_hit > 0").select(F.col("key").alias("of"), "spans", "contaminated").dropDuplicates(["of"]))
    joined = rows.join(small(hit), same_key(), "left").where("contaminated is null or not contaminated")
    return given(joined, docs, F.when(F.col("spans").isNull(), F.col("text")).otherwise(phrase_index.without_spans(F.col("text"), F.col("spans"))))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids as little-endian 32-bit integers, their count and digest, and the digest of the text decoded from them."""
    give_back(spark)
    return bpe.digests(docs.select("doc_id", "lang", "source", "text"), *vocabulary(), ids_col="ids")


STAGES = [("quality", quality), ("line_dedup", dedup_lines), ("near_dedup", dedup_near), ("decontamination", decontaminate), ("bpe", encode)]

#: SQL cannot express the classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
