"""Exact copies by a heavy-hitter split, in DataFrame operations only.

A frequent-items sketch (Misra-Gries counters, merged from all partitions) names the digests that may be
frequent. Their exact winners and counts are verified by an ordinary aggregate and broadcast: never more than
`max_heavy` digests. Copies of those leave the rows map-side; only the remaining digests are shuffled. Which
digests the sketch names has no influence on the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm._state import Steps, numbered, prepare, sent_if_few

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: str) -> F.Column:
    """The text with A-Z lower-cased; null counts as empty."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)


def digest(text: str) -> F.Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def heavy_winners(digests: DataFrame, id_col: str, max_heavy: int, counters: int, least: int) -> DataFrame:
    """(_digest, _keep, _size) of frequent digests: exact, and at most max_heavy rows but for hash collisions."""
    sketch = digests.select(F.xxhash64("_digest").alias("h")).select(F.expr(f"approx_top_k(h, {max_heavy}, {counters})").alias("top"))
    named = [x["item"] for x in (sketch.first()["top"] or []) if x["count"] >= least]
    return digests.filter(F.xxhash64("_digest").isin(named)).groupBy("_digest").agg(F.max(id_col).alias("_keep"), F.count("*").alias("_size"))


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, max_heavy: int = 1024, counters: int = 65536, least: int = 64) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Of equal texts (null is empty, A-Z lower-cased) the row with the largest id stays; a null id is the
    smallest. Of rows that tie in id and text exactly one stays. An empty table gives no rows; other columns,
    whatever their names, are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    steps = Steps(spark, "exact-dedup")
    slim = steps.put(docs.select(F.col(id_col).alias("_id"), digest(text_col).alias("_digest")), "digests")
    heavy = steps.put(heavy_winners(slim, "_id", max_heavy, counters, least), "winners")
    joined = slim.join(F.broadcast(heavy), "_digest", "left")
    loser = F.col("_size").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_keep"))
    lost = joined.filter(loser).select("_id", "_digest", "_keep", F.col("_size").alias("_n"), F.lit(False).alias("_kept"))
    group = Window.partitionBy("_digest")
    rest = joined.filter(~loser).select(
        "_id",
        "_digest",
        F.max("_id").over(group).alias("_keep"),
        F.coalesce("_size", F.count("*").over(group)).alias("_n"),
        (F.row_number().over(group.orderBy(F.col("_id").desc_nulls_last())) == 1).alias("_kept"),
    )
    result = lost.unionByName(rest).select(
        F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_n").alias("group_size"), F.col("_kept").alias("kept"), F.lower(F.hex("_digest")).alias("text_sha256")
    )
    return steps.finish(result, "result")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, max_heavy: int = 1024, counters: int = 65536, least: int = 64) -> DataFrame:
    """The rows of docs that mark_copies keeps, with all columns as they are, whatever their names; no rows give no rows.

    Rows are numbered and written once; only numbers, ids and digests are shuffled, and the numbers of copies drop rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    steps = Steps(spark, "exact-dedup")
    rows = numbered(steps, docs)
    slim = steps.put(rows.select("_n", F.col(f"_row.`{id_col}`").alias("_id"), digest(f"_row.`{text_col}`").alias("_digest")), "digests")
    heavy = steps.put(heavy_winners(slim, "_id", max_heavy, counters, least), "winners")
    joined = slim.join(F.broadcast(heavy), "_digest", "left")
    loser = F.col("_size").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_keep"))
    rest = joined.filter(~loser).withColumn("_rank", F.row_number().over(Window.partitionBy("_digest").orderBy(F.col("_id").desc_nulls_last(), "_n")))
    dropped = steps.put(joined.filter(loser).select("_n").unionByName(rest.filter("_rank > 1").select("_n")), "dropped")
    return rows.join(sent_if_few(dropped), "_n", "left_anti").select("_row.*")
