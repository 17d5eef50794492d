"""Mixing sources to target weights by balanced sampling with the cube method.

A source with target T and size S takes every document floor(T/S) times; the fraction left is the probability of
one copy more. Which documents get it is decided by the cube method: inclusion probabilities move through the
null space of two constraints (words and documents) until they reach 0 or 1. The flight goes block by block;
what each block leaves (two documents at most) goes to the blocks of the next level, until a source has one
block. The landing problem there (its leftovers and a small reserve of documents held back from the flight) is
solved so that the words come as near to the target as they can.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm._state import Steps, prepare
from tidemill.llm._text import mix, word_counts

#: Documents in one block of the flight.
BLOCK = 4096
#: Documents of a source that are held back for the landing.
RESERVE = 48
#: No document is taken more often.
MOST = 3
EPS = 1e-9


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, row_col: str | None) -> DataFrame:
    """(id, source, row, hash of the text, size): the number of words `[^\\x20\\x09-\\x0D]+` of each text, null counting as none."""

    def count(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(word_counts(b.column(4)), pa.int64())], ["_id", "_source", "_row", "_hash", "_size"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    row = F.col(row_col).cast("long") if row_col else F.lit(None).cast("long")
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), row.alias("_row"), F.xxhash64(text).alias("_hash"), text.alias("_text")).mapInArrow(
        count, f"_id {kinds[id_col]}, _source {kinds[source_col]}, _row long, _hash long, _size long"
    )


def targets(totals: DataFrame, steps: Steps, weights: tuple[float, ...] = (1, 2, 3)) -> DataFrame:
    """Adds _target to (_source, _total, ...), one row a source: weights repeat over sources by code point, null last.

    All sizes are shared by weight; a source stops at MOST times its size and the excess is reshared until none is
    above. Sources are numbered range by range, and the level at which sharing ends rises from one aggregate to the
    next, so that any number of sources needs no task for all of them.
    """
    by_name = F.col("_source").asc_nulls_last()
    ranged = steps.put(totals.repartitionByRange(by_name).withColumn("_range", F.spark_partition_id()), "ranges")
    begins, before = [], 0
    for r in sorted(ranged.groupBy("_range").count().collect()):  # a row for each range, as many as there are tasks
        begins.append((r["_range"], before))
        before += r["count"]
    at = totals.sparkSession.createDataFrame(begins, "_range int, _before long")
    number = F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy(by_name)) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(number, F.lit(len(weights))) + 1).cast("int"))
    weighted = steps.put(ranged.join(F.broadcast(at), "_range").withColumn("_weight", weight).drop("_range", "_before"), "weights")
    cap = MOST * F.col("_total").cast("double")
    every = weighted.agg(F.coalesce(F.sum("_total"), F.lit(0)).alias("total"), F.coalesce(F.sum("_weight"), F.lit(0.0)).alias("weight")).first()
    capped, level = {"total": 0, "weight": 0.0, "n": 0}, 0.0
    while every["weight"] > capped["weight"]:
        level = (every["total"] - MOST * capped["total"]) / (every["weight"] - capped["weight"])
        full = weighted.filter(cap <= F.col("_weight") * level).agg(F.coalesce(F.sum("_total"), F.lit(0)).alias("total"), F.coalesce(F.sum("_weight"), F.lit(0.0)).alias("weight"), F.count("*").alias("n")).first().asDict()
        if full["n"] == capped["n"]:
            break
        capped = full
    return weighted.withColumn("_target", F.least(cap, F.col("_weight") * level)).drop("_weight")


def _uniform(keys: np.ndarray, level: int, seed: int) -> np.ndarray:
    return (mix(keys.astype(np.int64).view(np.uint64) ^ np.uint64((seed * 1_000_003 + level * 7_919 + 1) & (2**64 - 1))) >> np.uint64(11)) * 2.0**-53


def flight(size: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Moves p, three documents at a time, through the null space of (words, documents); two at most stay open."""
    p = p.astype(float).copy()
    x = size.astype(float)
    todo = [i for i in range(len(p)) if EPS < p[i] < 1 - EPS]
    hold: list[int] = []
    at = 0
    for i in todo:
        hold.append(i)
        if len(hold) < 3:
            continue
        a, b, c = hold
        d = [x[b] - x[c], x[c] - x[a], x[a] - x[b]]
        if not any(d):
            d = [1.0, -1.0, 0.0]
        up = min((1 - p[j]) / e if e > 0 else p[j] / -e for j, e in zip(hold, d, strict=True) if e)
        down = min(p[j] / e if e > 0 else (1 - p[j]) / -e for j, e in zip(hold, d, strict=True) if e)
        step = up if u[at % len(u)] * (up + down) < down else -down
        at += 1
        for j, e in zip(hold, d, strict=True):
            p[j] = min(1.0, max(0.0, p[j] + step * e))
        hold = [j for j in hold if EPS < p[j] < 1 - EPS]
    return np.where(p >= 1 - EPS, 1.0, np.where(p <= EPS, 0.0, p))


def landing(size: np.ndarray, p: np.ndarray, want: float) -> np.ndarray:
    """0 or 1 for each document so that the words come near `want`, and then the number of documents near sum(p).

    Starts from a few flights to the end and improves each by changing one or two documents as long as that helps.
    """
    x, n = size.astype(float), float(p.sum())
    open_ = (p > EPS) & (p < 1 - EPS)
    free = np.flatnonzero(open_ & (x > 0))

    def cost(words, docs):
        return np.abs(words - want) * 1e3 + np.abs(docs - n)

    best, least = p > 1 - EPS, np.inf
    for start in range(4):
        take = flight(size, p, _uniform(np.arange(len(p) + 1), start, 17)) > 0.5
        while True:
            words, docs = x[take].sum(), take.sum()
            sign = np.where(take[free], -1.0, 1.0)
            dw = sign * x[free]
            pair_w, pair_n = np.add.outer(dw, dw), np.add.outer(sign, sign)
            np.fill_diagonal(pair_w, dw)
            np.fill_diagonal(pair_n, sign)
            costs = cost(words + pair_w, docs + pair_n)
            now = cost(words, docs)
            if not costs.size or costs.min() >= now - 1e-6:
                break
            i, j = np.unravel_index(costs.argmin(), costs.shape)
            take[free[i]] ^= True
            if i != j:
                take[free[j]] ^= True
        if now < least:
            best, least = take, now
    return best.astype(float)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, row_col: str | None = None, weights: tuple[float, ...] = (1, 2, 3), seed: int = 0) -> DataFrame:
    """One row per row of docs: id, size, source_size, target, copies, taken (words the mix takes, repeats counted).

    With row_col, a column of numbers of the rows, it comes first in the result and tells which row was decided how;
    it has no influence on that.

    A null text has size 0, a null source is a source of its own (the last). Documents without words are taken 0
    words. Rows that repeat an id, or have none, are decided one by one. No rows give no rows; other columns are not
    read, whatever their names; words of texts of any length are counted whole. Reruns on the same rows agree: blocks
    and directions depend on ids and sizes only.
    """
    spark = docs.sparkSession
    prepare(spark)
    steps = Steps(spark, "mixing")
    sizes = steps.put(sized(docs, id_col, text_col, source_col, row_col), "sizes")
    totals = sizes.groupBy("_source").agg(F.sum("_size").alias("_total"), F.count("*").alias("_docs"))
    totals = steps.put(targets(totals, steps, weights), "targets")
    rows = sizes.join(totals, sizes["_source"].eqNullSafe(totals["_source"]), "inner").drop(totals["_source"])
    rate = F.when(F.col("_total") > 0, F.col("_target") / F.col("_total")).otherwise(F.lit(0.0))
    rows = (
        rows.withColumn("_rate", F.least(rate, F.lit(float(MOST))))
        .withColumn("_whole", F.floor(F.col("_rate") + EPS))
        .withColumn("_p", F.greatest(F.col("_rate") - F.col("_whole"), F.lit(0.0)))
        .withColumn("_key", F.xxhash64(F.lit(seed), "_id"))
        # rows alike in id, size and source get numbers (in the order of their texts' hashes), so that each is decided by itself
        .withColumn("_copy", F.row_number().over(Window.partitionBy("_id", "_source", "_size").orderBy("_hash")))
        .withColumn("_key", F.xxhash64("_key", "_copy"))
    )
    rows = steps.put(rows, "rates")
    slim = rows.filter("_size > 0 and _p > 1e-9").select("_id", "_copy", "_source", "_size", "_p", "_key", "_docs")
    held = slim.withColumn("_rank", F.row_number().over(Window.partitionBy("_source").orderBy("_key", "_id", "_size", "_copy"))).filter(F.col("_rank") <= RESERVE).select("_id", "_copy", "_source", "_size", F.lit(True).alias("_held"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("_id", "_copy", "_source", "_size")]
    slim = slim.alias("a").join(held.alias("b"), same, "left").select("a.*", F.coalesce("b._held", F.lit(False)).alias("_held"))
    slim = steps.put(slim, "open")
    kind = {f.name: f.dataType.simpleString() for f in slim.schema}
    shape = f"_id {kind['_id']}, _copy int, _source {kind['_source']}, _size long, _p double, _key long, _docs long, _held boolean, _out double"

    def flying(level: int):
        return lambda pdf: fly(pdf, level)

    def fly(pdf: pd.DataFrame, level: int) -> pd.DataFrame:
        pdf = pdf.drop(columns="_block").sort_values(["_size", "_key", "_copy"], ascending=[False, True, True], kind="stable", ignore_index=True)
        return pdf.assign(_out=flight(pdf["_size"].to_numpy(), pdf["_p"].to_numpy(), _uniform(pdf["_key"].to_numpy(), level, seed)))

    def land(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_size", "_key", "_copy"], ascending=[False, True, True], kind="stable", ignore_index=True)
        size, p, held_ = pdf["_size"].to_numpy(), pdf["_p"].to_numpy(float).copy(), pdf["_held"].to_numpy(bool)
        want = float((size * p).sum())
        p[~held_] = flight(size[~held_], p[~held_], _uniform(pdf["_key"].to_numpy(), -1, seed)) if (~held_).any() else p[~held_]
        return pdf.assign(_out=landing(size, p, want))

    done = []
    open_ = slim.filter("not _held")
    most = int(totals.agg(F.max("_docs")).first()[0] or 0)
    level = 0
    while most > BLOCK:
        blocks = F.pmod(F.xxhash64("_key", F.lit(level)), F.greatest(F.lit(1), F.ceil(F.lit(most) * F.col("_docs") / F.lit(max(1, int(totals.agg(F.max("_docs")).first()[0]))) / BLOCK)).cast("long"))
        flown = steps.put(open_.withColumn("_block", blocks).groupBy("_source", "_block").applyInPandas(flying(level), shape), f"flight-{level}")
        done.append(flown.filter("_out = 0 or _out = 1"))
        open_ = flown.filter("_out > 0 and _out < 1").withColumn("_p", F.col("_out")).drop("_out")
        most = 2 * (most // BLOCK + 1)
        level += 1
    last = open_.unionByName(slim.filter("_held"))
    done.append(last.groupBy("_source").applyInPandas(land, shape))
    decided = done[0]
    for d in done[1:]:
        decided = decided.unionByName(d)
    decided = steps.put(decided.select("_id", "_copy", "_source", "_size", F.col("_out").cast("long").alias("_more")), "decided")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("_id", "_copy", "_source", "_size")]
    result = (
        rows.alias("a")
        .join(decided.alias("b"), same, "left")
        .select(
            *([F.col("a._row").alias(row_col)] if row_col else []),
            F.col("a._id").alias(id_col),
            F.col("a._size").alias("size"),
            F.col("a._total").alias("source_size"),
            F.col("a._target").alias("target"),
            (F.col("a._whole") + F.coalesce("b._more", F.lit(0))).alias("copies"),
            ((F.col("a._whole") + F.coalesce("b._more", F.lit(0))) * F.col("a._size")).cast("long").alias("taken"),
        )
    )
    return steps.finish(result, "result")
