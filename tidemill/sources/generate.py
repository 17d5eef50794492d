"""Made-up trip files with planted defects, for tests and rehearsals. Rows come from spark.range and hashes of their numbers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Zones of the charged area and the charge's first day.
AREA = (161, 162, 163, 164, 230)
AREA_FROM = "2025-01-05"


def _draw(tag: str, seed: int) -> Column:
    """A number in [0, 1) by row number."""
    return F.pmod(F.xxhash64(F.col("id"), F.lit(tag), F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0


def _priced(df: DataFrame, charged: bool) -> DataFrame:
    """Amounts that follow from distance, payment and place. The tariff."""
    area = ", ".join(map(str, AREA))
    cells = {
        "fare_amount": "round(3.0D + 2.5D * trip_distance, 2)",
        "extra": "1.0D",
        "mta_tax": "0.5D",
        "tolls_amount": "0.0D",
        "improvement_surcharge": "1.0D",
        "congestion_surcharge": "2.5D",
        "airport": "0.0D",
    }
    df = df.withColumns({c: F.expr(e) for c, e in cells.items()}).withColumn("tip_amount", F.expr("if(payment_type = 1, round(fare_amount * 0.2D, 2), 0.0D)"))
    fee = f"if((PULocationID in ({area}) or DOLocationID in ({area})) and tpep_pickup_datetime >= timestamp_ntz '{AREA_FROM} 00:00:00', 0.75D, 0.0D)"
    df = df.withColumn("cbd_congestion_fee", F.expr(fee) if charged else F.lit(0.0))
    return df.withColumn("total_amount", F.expr("round(fare_amount + tip_amount + extra + mta_tax + improvement_surcharge + tolls_amount + congestion_surcharge + airport + cbd_congestion_fee, 2)"))


def clean_trips(spark: SparkSession, month: str, rows: int, seed: int = 7) -> DataFrame:
    """Faultless trips spread over the first 27 days of a month, by row number `id`."""
    step = 27 * 86_400 // (rows + 1)
    area = F.array(*[F.lit(z) for z in AREA])

    def zone(tag: str) -> Column:
        inside = F.element_at(area, (F.floor(_draw(f"{tag}-area", seed) * len(AREA)) + 1).cast("int"))
        return F.when(_draw(f"{tag}-side", seed) < 0.4, inside).otherwise((F.floor(_draw(f"{tag}-zone", seed) * 263) + 1).cast("int"))

    df = spark.range(rows).withColumns(
        {
            "VendorID": (1 + F.col("id") % 2).cast("int"),
            "tpep_pickup_datetime": F.expr(f"timestamp_ntz '{month}-01 00:00:00' + make_dt_interval(0, 0, 0, (id + 1) * {step} + id % 60)"),
            "trip_distance": F.round(0.5 + 11.5 * _draw(f"{month}-distance", seed), 2),
            "passenger_count": F.floor(1 + 3 * _draw("people", seed)),
            "RatecodeID": F.lit(1).cast("long"),
            "store_and_fwd_flag": F.lit("N"),
            "PULocationID": zone("from"),
            "DOLocationID": zone("to"),
            "payment_type": F.when(_draw("pay", seed) < 0.7, 1).otherwise(2).cast("long"),
        }
    )
    seconds = (F.floor(3 * F.col("trip_distance")) + 3) * 60 + F.floor(60 * _draw("seconds", seed))
    df = df.withColumn("_seconds", seconds.cast("int")).withColumn("tpep_dropoff_datetime", F.expr("tpep_pickup_datetime + make_dt_interval(0, 0, 0, _seconds)")).drop("_seconds")
    return _priced(df, month >= "2025-01")


@dataclass(frozen=True)
class Planted:
    """What a month's file holds beside clean rows."""

    rejects: dict[str, int]
    flags: dict[str, int]
    resubmitted: int


#: Planted rows by outcome.
REJECTS = {"INVALID_PICKUP_DATETIME": 2, "INVALID_DROPOFF_DATETIME": 1, "MISSING_LOCATION": 2, "INVALID_FARE": 2, "NEGATIVE_DURATION": 1, "OUT_OF_PERIOD": 1, "DUPLICATE_TRIP": 2, "KEY_COLLISION": 1}
PLANTED_FLAGS = {"LATE_ARRIVAL": 2, "UNKNOWN_RATECODE": 1, "UNKNOWN_ZONE": 1, "PASSENGER_COUNT_MISSING_OR_ZERO": 1, "REVERSED": 1}


def month_file(spark: SparkSession, month: str, rows: int, seed: int = 7, previous: str | None = None) -> tuple[DataFrame, Planted]:
    """One month's trips as delivered: clean rows, planted defects, one trip of the previous month's file again.

    Files before 2025 spell a column differently, count passengers as doubles and have no area fee.
    """
    charged = month >= "2025-01"
    base = clean_trips(spark, month, rows, seed)

    def pick(i: int, **changes: str) -> DataFrame:
        df = base.filter(F.col("id") == i)
        return df.withColumns({c: F.expr(e) for c, e in changes.items()}) if changes else df

    def moved(i: int, seconds: int, **changes: str) -> DataFrame:
        at = {c: f"{c} + interval {seconds} seconds" for c in ("tpep_pickup_datetime", "tpep_dropoff_datetime")}
        return pick(i, **at).withColumns({c: F.expr(e) for c, e in changes.items()}) if changes else pick(i, **at)

    none_time = "cast(null as timestamp_ntz)"
    odd = [
        pick(10, tpep_pickup_datetime=none_time, VendorID="1"),
        pick(11, tpep_pickup_datetime=none_time, VendorID="1"),
        pick(12, tpep_dropoff_datetime=none_time),
        pick(13, PULocationID="cast(null as int)"),
        pick(14, DOLocationID="cast(null as int)"),
        moved(15, 7, fare_amount="0.0D"),
        pick(16, fare_amount="-fare_amount", tip_amount="-tip_amount", total_amount="-total_amount"),
        moved(17, 11, tpep_dropoff_datetime="tpep_pickup_datetime - interval 5 minutes"),
        pick(18, tpep_pickup_datetime="timestamp_ntz '2009-01-01 12:00:00'", tpep_dropoff_datetime="timestamp_ntz '2009-01-01 12:20:00'"),
        pick(19),
        pick(20),
        _priced(pick(21, trip_distance="round(trip_distance + 0.3D, 2)"), charged),
    ]
    early = [_priced(pick(i, tpep_pickup_datetime=f"timestamp_ntz '{month}-01 00:00:00' - interval {h} hours", tpep_dropoff_datetime=f"timestamp_ntz '{month}-01 00:00:00' - interval {h} hours + interval 20 minutes"), charged) for i, h in ((22, 67), (23, 63))]
    late = [clean_trips(spark, previous, rows, seed).filter(F.col("id") == rows - 1), early[1]] if previous else early
    if previous and previous < "2025-01":
        late[0] = late[0].withColumn("cbd_congestion_fee", F.lit(0.0))
    marked = base.withColumns(
        {
            "RatecodeID": F.when(F.col("id") == 30, F.lit(99)).otherwise(F.col("RatecodeID")),
            "PULocationID": F.when(F.col("id") == 31, F.lit(264)).otherwise(F.col("PULocationID")),
            "passenger_count": F.when(F.col("id") == 32, F.lit(0)).otherwise(F.col("passenger_count")),
        }
    )
    df = marked
    for part in [*odd, *late]:
        df = df.unionByName(part)
    df = df.drop("id")
    if charged:
        df = df.withColumnRenamed("airport", "Airport_fee")
    else:
        df = df.withColumnRenamed("airport", "airport_fee").withColumn("passenger_count", F.col("passenger_count").cast("double")).drop("cbd_congestion_fee")
    return df, Planted(dict(REJECTS), dict(PLANTED_FLAGS), int(previous is not None))


def zone_lookup(spark: SparkSession) -> DataFrame:
    """Zones 1 to 265 as text columns, the last two not places."""
    area = ", ".join(map(str, AREA))
    inner = spark.range(1, 264).selectExpr(
        "cast(id as string) as LocationID", f"if(id in ({area}) or id % 3 = 0, 'Manhattan', 'Queens') as Borough", "concat('Zone ', id) as Zone", f"if(id in ({area}) or id % 3 = 0, 'Yellow Zone', 'Boro Zone') as service_zone"
    )
    return inner.unionByName(spark.createDataFrame([("264", "Unknown", "N/A", "N/A"), ("265", "N/A", "Outside of NYC", "N/A")], inner.schema))


def area_members(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(str(z),) for z in AREA], "LocationID string")


#: The fixture lane's columns: an id is given, times are text.
FIXTURE_DDL = (
    "trip_id string, VendorID int, tpep_pickup_datetime string, tpep_dropoff_datetime string, passenger_count int, trip_distance double, RatecodeID int, store_and_fwd_flag string, "
    "PULocationID int, DOLocationID int, payment_type int, fare_amount double, extra double, mta_tax double, tip_amount double, tolls_amount double, improvement_surcharge double, "
    "total_amount double, congestion_surcharge double, Airport_fee double"
)


def fixture_batch(spark: SparkSession, number: int, rows: int = 1000, *, dates: int = 10, starts: int = 10, ends: int = 10, fares: int = 10, copies: int = 20, seed: int = 42) -> tuple[DataFrame, dict[str, int]]:
    """Rows with disjoint defects and `copies` repeated rows; also the counts that processing must find."""
    need = dates + starts + ends + fares + copies
    if need > rows:
        raise ValueError(f"{need} rows with defects don't fit into {rows}")
    trips = clean_trips(spark, "2025-01", rows, seed + number).withColumn("trip_id", F.format_string(f"trip_2025{number:02d}_%06d", F.col("id") + 1))
    trips = trips.withColumnRenamed("airport", "Airport_fee").drop("cbd_congestion_fee")
    # a row's place in a seeded order decides its defect
    cuts = [dates, dates + starts, dates + starts + ends, dates + starts + ends + fares, need]
    order = spark.range(rows).orderBy(F.xxhash64("id", F.lit(seed), F.lit(number)), "id").limit(need).collect()
    place = {r["id"]: i for i, r in enumerate(order)}
    where = F.create_map(*[x for k, v in place.items() for x in (F.lit(k), F.lit(v))])[F.col("id")]
    trips = trips.withColumn("_p", where)
    text = {c: F.date_format(F.col(c).cast("timestamp"), "yyyy-MM-dd HH:mm:ss") for c in ("tpep_pickup_datetime", "tpep_dropoff_datetime")}
    trips = trips.withColumns(text).withColumns(
        {
            "tpep_pickup_datetime": F.when(F.col("_p") < cuts[0], F.when(F.col("_p") % 2 == 0, "not-a-date").otherwise("2024-13-40 25:61:00")).otherwise(F.col("tpep_pickup_datetime")),
            "PULocationID": F.when((F.col("_p") >= cuts[0]) & (F.col("_p") < cuts[1]), F.lit(None)).otherwise(F.col("PULocationID")),
            "DOLocationID": F.when((F.col("_p") >= cuts[1]) & (F.col("_p") < cuts[2]), F.lit(None)).otherwise(F.col("DOLocationID")),
            "fare_amount": F.when((F.col("_p") >= cuts[2]) & (F.col("_p") < cuts[3]), F.when(F.col("_p") % 2 == 0, 0.0).otherwise(-5.0)).otherwise(F.col("fare_amount")),
        }
    )
    twice = trips.filter((F.col("_p") >= cuts[3]) & (F.col("_p") < cuts[4]))
    names = [p.split()[0] for p in FIXTURE_DDL.split(", ")]
    kinds = dict(p.split() for p in FIXTURE_DDL.split(", "))
    out = trips.unionByName(twice).select(*[F.col(c).cast(kinds[c]).alias(c) for c in names])
    expected = {"raw_rows": rows + copies, "expected_silver_rows": rows - dates - starts - ends - fares, "expected_rejected_rows": dates + starts + ends + fares + copies}
    return out, expected | {"DUPLICATE_TRIP": copies, "INVALID_PICKUP_DATETIME": dates, "MISSING_LOCATION": starts + ends, "INVALID_FARE": fares}


def evolution_batch(spark: SparkSession, rows: int = 100) -> DataFrame:
    """Clean fixture rows with one column more."""
    trips = clean_trips(spark, "2025-02", rows, 99).withColumn("trip_id", F.format_string("trip_evolved_%06d", F.col("id") + 1)).withColumnRenamed("airport", "Airport_fee")
    names = [p.split()[0] for p in FIXTURE_DDL.split(", ")]
    kinds = dict(p.split() for p in FIXTURE_DDL.split(", "))
    text = {c: F.date_format(F.col(c).cast("timestamp"), "yyyy-MM-dd HH:mm:ss") for c in ("tpep_pickup_datetime", "tpep_dropoff_datetime")}
    return trips.withColumns(text).select(*[F.col(c).cast(kinds[c]).alias(c) for c in names], F.round(0.5 + (F.col("id") % 10) * 0.25, 2).alias("surcharge_fee"))


def write_fixture(spark: SparkSession, folder: str, batches: int = 3, rows: int = 1000, **defects: int) -> dict[str, int]:
    """Write fixture batches as JSON Lines below a folder; returns the counts that processing must find."""
    total: dict[str, int] = {}
    for n in range(1, batches + 1):
        df, counts = fixture_batch(spark, n, rows, **defects)
        df.coalesce(1).write.option("ignoreNullFields", False).json(f"{folder}/batch_{n}")
        total = {k: total.get(k, 0) + v for k, v in counts.items()}
    return total
