"""What the lakehouse queries keep on disk, and what evolution counts."""

import os

import pytest
from pyspark.sql import DataFrame

from tidemill.plans import lakehouse, trip_queries

SF = "/root/testdata/sf0.001"


def batch(spark, fare: float, fee: float | None = None) -> DataFrame:
    cells = "1 AS VendorID, timestamp'2025-01-10 10:00:00' AS tpep_pickup_datetime, timestamp'2025-01-10 10:30:00' AS tpep_dropoff_datetime, 5L AS PULocationID, 6L AS DOLocationID"
    return spark.sql(f"SELECT {cells}, {fare}D AS fare_amount" + (f", {fee}D AS cbd_congestion_fee" if fee is not None else ""))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_landing_alone_answers_what_landed(spark, monkeypatch):
    monkeypatch.setattr(lakehouse.Lakehouse, "silver", lambda self: pytest.fail("nothing has to be judged"))
    assert trip_queries.lake_landed(spark, SF).count() == 3


def test_a_trip_that_comes_again_is_counted_as_accepted_twice_and_kept_once(spark, tmp_path, monkeypatch):
    kind, cached = type(spark.range(0)), []
    persist = kind.persist
    monkeypatch.setattr(kind, "persist", lambda self, *a: cached.append(self.columns) or persist(self, *a))
    lake = lakehouse.Lakehouse(spark, str(tmp_path / "lake"))
    lake.land(batch(spark, 10), "a", "2025-01", "x", "0")
    lake.land(batch(spark, 12, 0.75), "b", "2025-02", "x", "0")
    assert lake.silver()["totals"] == {"landed_rows": 2, "accepted_rows": 2, "rejected_rows": 0, "inserted": 1, "updated": 1, "noop": 0}
    assert lake.folder.walk("scratch") == [] and all("_times" in c for c in cached)  # no batch is kept but in its files
    found = lake.evolution()
    assert found["by_month"] == [{"pickup_month": "2025-01", "rows": 1, "null__cbd_congestion_fee": 0}]
    assert found["accepted_by_month"] == [{"pickup_month": "2025-01", "rows": 2, "null__cbd_congestion_fee": 1}]
