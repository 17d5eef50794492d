"""The fixture lane: rows with given ids, four rules, exact ground truth, snapshots rebuilt as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.contract import TIME_FORMAT
from tidemill.functions.expressions import named
from tidemill.operators.rules import Rule, first_match
from tidemill.sources.generate import FIXTURE_DDL

#: Types once settled: as landed, with times parsed.
SETTLED = {n: "timestamp" if n.startswith("tpep_") else t for n, t in (p.split() for p in FIXTURE_DDL.split(", "))}
LINEAGE = ("_ingest_ts", "_source_file", "_batch_id")

RULES = [
    Rule("INVALID_PICKUP_DATETIME", (), lambda v: v("tpep_pickup_datetime").isNull()),
    Rule("MISSING_LOCATION", (), lambda v: v("PULocationID").isNull() | v("DOLocationID").isNull()),
    # a fare that can't be read isn't rejected in this lane
    Rule("INVALID_FARE", (), lambda v: v("fare_amount") <= 0),
]


def judge(landed: DataFrame) -> DataFrame:
    """Landed rows with a settled struct `_row` and `reject_reason`; of rows that pass, one of each trip_id stays.

    All columns are read from text, so a file whose types differ isn't an error. The survivor is the first by content.
    """
    absent = sorted(set(SETTLED) - set(landed.columns))
    if absent:
        raise ValueError(f"missing columns: {absent}")
    if {"_row", "reject_reason"} & set(landed.columns):
        raise ValueError("the rows have columns with reserved names")
    text = {c: named(c).try_cast("string") for c in SETTLED}
    cells = [(F.try_to_timestamp(text[c], F.lit(TIME_FORMAT)) if t == "timestamp" else text[c].try_cast(t)).alias(c) for c, t in SETTLED.items()]
    rows = landed.withColumn("_row", F.struct(*cells))
    rows = rows.withColumn("reject_reason", first_match(RULES, lambda c: F.col("_row")[c], SETTLED))
    content = F.sha2(F.to_json(F.struct(*[named(c) for c in landed.columns])), 256)
    same = Window.partitionBy(named("trip_id"), F.col("reject_reason").isNull()).orderBy(content)
    place = F.row_number().over(same)
    return rows.withColumn("_place", place).withColumn("reject_reason", F.when(F.col("reject_reason").isNull() & (F.col("_place") > 1), "DUPLICATE_TRIP").otherwise(F.col("reject_reason"))).drop("_place")


def split(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows in settled types with all other columns, rejected rows as landed with the reason)."""
    others = [c for c in judged.columns if c not in SETTLED and c not in ("_row", "reject_reason")]
    landed = [c for c in judged.columns if c not in ("_row", "reject_reason")]
    good = judged.filter("reject_reason is null").select("_row.*", *[named(c) for c in others])
    return good, judged.filter("reject_reason is not null").select(*[named(c) for c in landed], "reject_reason")


def check_manifest(found: dict[str, int], expected: dict[str, int]) -> None:
    """Raise if any count differs from the ground truth."""
    off = {k: (found.get(k, 0), v) for k, v in expected.items() if found.get(k, 0) != v}
    if off:
        raise ValueError(f"counts (found, expected) differ: {off}")
