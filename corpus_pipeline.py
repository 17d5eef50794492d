"""From raw documents to training ids: quality, exact copies, near copies, mix, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import bpe, exact_dedup, mixing, ngram_join, quality
from tidemill.llm._state import Steps, numbered, prepare, sent_if_few
from tidemill.llm.queries import vocabulary_path

# All stages take rows one by one: what is said of a row holds also if it shares its doc_id with others or has none.
# A null text counts as empty, texts of any length are read whole, an empty table gives an empty one, and columns beside
# doc_id, text and source go along unread, whatever their names.


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the ordinal model holds for well written; equal texts fare alike. Without labelled rows all stay."""
    return quality.select(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text (A-Z lower-cased, null as empty): that with the largest doc_id, null being the smallest; of ties any one."""
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by five-word shingles at 0.8 or more; rows that share a doc_id or have none are judged one by one.

    The smallest doc_id stays, null being the largest, and of equal ones the text with the smallest hash. Texts without
    words link with nothing and stay.
    """
    rows = numbered(Steps(spark, "pipeline-near"), docs)
    groups = ngram_join.link_documents(rows.select("_n", F.col("_row.text").alias("text")), "_n", n=5, threshold_percent=80)
    later = groups.filter("_n != component_id").select("_n", "component_id")
    linked = later.unionByName(later.select(F.col("component_id").alias("_n"), "component_id").distinct())
    known = rows.select("_n", F.col("_row.doc_id").alias("_id"), F.xxhash64("_row.text").alias("_hash")).join(sent_if_few(linked), "_n")
    first = known.groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_hash", "_n"))["_n"].alias("_n"))
    dropped = linked.select("_n").join(first, "_n", "left_anti")
    return rows.join(sent_if_few(dropped), "_n", "left_anti").select("_row.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it (up to three times), also if it shares its doc_id with others or has none.

    A null source is a source of its own. Rows without words are taken as often as their source's rate says, or not at all.
    """
    rows = numbered(Steps(spark, "pipeline-mixing"), docs)
    slim = rows.select("_n", *[F.col(f"_row.{c}").alias(c) for c in ("doc_id", "text", "source")])
    taken = mixing.mix_sources(slim, row_col="_n").filter("copies > 0").select("_n", "copies")
    return rows.join(sent_if_few(taken), "_n").select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian 32-bit integers), and the digest of the decoded text, for each row; repeated rows get a row each."""
    found = bpe.encode_documents(docs, vocabulary_path())
    return found.select("doc_id", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("mixing sources to target weights", mixing_stage),
    ("BPE encoding and decoding", token_stage),
]

#: SQL expresses neither the models nor the cube method nor BPE; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again, and what it wrote on the way is deleted."""
    prepare(spark)
    steps = Steps(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        before, others = docs, list(Steps.opened)
        docs = steps.put(stage(spark, docs, sf_dir), f"stage-{i}")
        Steps.close_since(others)
        steps.drop(before)
    return docs
