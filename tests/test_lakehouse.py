import pytest
from pyspark.sql import functions as F

from tidemill.functions.session import settings
from tidemill.plans import lakehouse, layouts
from tidemill.sources import generate, readers
from tidemill.sources.versioned import VersionedTable
from tidemill.streaming import ingest

MONTHS = ["2024-02", "2025-01", "2025-02"]


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    lake = lakehouse.Lakehouse(spark, str(tmp_path_factory.mktemp("lake")))
    do = lakehouse.made_up(lake, MONTHS, rows=120)
    status = lake.run(["reference", "bronze", "silver"], do)
    assert status["ok"], status
    return lake


def test_rows_are_conserved(lake):
    s = lake.summary()
    assert all(s["checks"].values()), s["checks"]
    t = s["totals"]
    assert t["rejected_rows"] == 12 * len(MONTHS) and t["noop"] == 1 and t["updated"] == 0


def test_a_second_run_does_nothing(lake):
    before = lake.trips.version()
    assert lake.silver()["processed"] == [] and lake.trips.version() == before
    df, _ = generate.month_file(lake.spark, "2025-01", 120)
    again = next(b for b in lake.landed.batches() if "2025-01" in b)
    assert lake.land(df, again, "2025-01", "x", "y")["landed"] is False


def test_a_run_that_died_before_the_ledger_is_finished(spark, tmp_path):
    lake = lakehouse.Lakehouse(spark, str(tmp_path / "lake"))
    do = lakehouse.made_up(lake, ["2025-01"], rows=60)
    do["bronze"]()
    lake.silver()
    lake.folder.delete("ops/ledger")
    again = lake.silver()
    assert len(again["processed"]) == 1 and all(again["checks"].values())


def test_corrections(lake):
    got = lake.cdc(updates=6, inserts=2)
    assert (got["updated"], got["inserted"]) == (6, 2) and all(got["checks"].values())
    assert lake.cdc(updates=6, inserts=2)["already_applied"]
    sample = next(s for s in got["samples"] if s["change"] == "changed")
    assert round(sample["after"]["tip_amount"] - sample["before"]["tip_amount"], 2) == 2.0


def test_evolution_time_travel_and_gold(lake):
    e = lake.evolution()
    assert e["present"] and e["absent_before"] and e["operation"] == "MERGE"
    t = lake.time_travel()
    # the correction rewrote files of the version before it, which no later version has; all others only appended
    rewritten = [v for v in lake.trips.log.versions() if lake.trips.log.commit(v)["remove"]]
    gone = set().union(*(lake.trips.log.commit(v)["remove"] for v in rewritten))
    broken = [v for v in lake.trips.log.versions() if gone & set(lake.trips.log.snapshot(v).files)]
    assert rewritten == [lake.trips.version()] and broken and t["vacuum"]["broken_versions"] == broken
    g = lake.gold()
    assert g["check"]["agrees"] and g["zone_hourly_metrics"] > 0 and g["dq_monthly"] > 0
    assert set(lake.profiled()) >= {"values", "keys", "reasons", "flags"}


def test_delivered_files_land(spark, tmp_path):
    """Real files by a manifest: one Parquet file a month, zones and members as published."""
    files = {}
    for month in ("2024-02", "2025-02"):
        generate.month_file(spark, month, 60)[0].coalesce(1).write.parquet(str(tmp_path / month))
        files[month] = str(tmp_path / month)
    told = readers.manifest(spark, files)["files"]
    generate.zone_lookup(spark).coalesce(1).write.option("header", True).csv(str(tmp_path / "zones"))
    (tmp_path / "members.json").write_text('[{"zone": "Zone 161"}, {"zone": "zone 230 "}]')
    manifest = {"trips": {m: {"path": f["path"], "rows": f["rows"], "sha256": f["sha256"]} for m, f in told.items()}, "zones": {"path": str(tmp_path / "zones"), "kind": "csv"}, "members": {"path": str(tmp_path / "members.json"), "kind": "json"}}
    lake = lakehouse.Lakehouse(spark, str(tmp_path / "lake"))
    status = lake.run(["reference", "bronze", "profile", "silver", "gold"], lakehouse.delivered(lake, manifest))
    assert status["ok"], status
    assert lake.zones.read().filter("is_cbd").count() == 2 and lake.landed.read().count() == sum(f["rows"] for f in told.values())
    assert all("row_groups" in f and f["created_by"].startswith("parquet-mr") and "int96" not in f["physical"] for f in told.values())
    assert "## Year over year" in lake.folder.read("evidence/gold.md")
    assert [b["landed"] for b in lakehouse.delivered(lake, manifest)["bronze"]()] == [False, False]
    manifest["trips"]["2025-02"]["rows"] += 1
    with pytest.raises(RuntimeError, match="manifest says"):
        lakehouse.delivered(lake, manifest)["bronze"]()
    sampled = lakehouse.Lakehouse(spark, str(tmp_path / "sampled"))
    del manifest["trips"]["2025-02"], manifest["members"]
    do = lakehouse.delivered(sampled, manifest, percent=50)
    assert do["reference"]()["members"] == 38 and 0 < do["bronze"]()[0]["rows"] < told["2024-02"]["rows"]


def test_wrong_row_counts_are_refused(spark, tmp_path):
    lake = lakehouse.Lakehouse(spark, str(tmp_path / "lake"))
    df, _ = generate.month_file(spark, "2025-01", 60)
    with pytest.raises(RuntimeError, match="manifest"):
        lake.land(df, "b", "2025-01", "f", "s", expected_rows=1)


def test_layout_rounds(lake):
    out = layouts.run(lake, n=3, baseline_files=6, target_bytes=16 << 10)
    assert all(out["same_results"].values())
    assert out["queries"]["zone"]["zorder_1col"]["files"] < out["queries"]["zone"]["baseline"]["files"]
    with pytest.raises(ValueError):
        layouts.rounds({}, {}, 2)


def test_external_reconciliation(lake, tmp_path):
    counts = lake.landed.read().filter("_batch_id not like 'cdc%'").groupBy(F.date_format("tpep_pickup_datetime", "yyyy-MM").alias("m"), "PULocationID").count().filter("m is not null").collect()
    f = tmp_path / "ext.csv"
    f.write_text("﻿Month,Industry,LocationID,Pickups\n" + "".join(f'{r["m"]}-01,Yellow Taxi,{r["PULocationID"] or ""},"{r["count"]}"\n' for r in counts))
    got = lake.reconcile_external(str(f), ["2025-01"])
    assert got["status"] == "DONE" and got["per_month"][0]["ours"] >= got["per_month"][0]["theirs"]
    f.write_text("a,b\n1,2\n")
    assert lake.reconcile_external(str(f), ["2025-01"])["status"] == "SKIPPED"


def test_fixture_lane(spark, tmp_path):
    lake = lakehouse.Lakehouse(spark, str(tmp_path / "lake"))
    batches, expected = {}, {}
    for n in (1, 2, 3):
        batches[f"b{n}"], counts = generate.fixture_batch(spark, n)
        expected = {k: expected.get(k, 0) + v for k, v in counts.items()}
    got = lake.fixture(batches, expected)
    assert (got["raw_rows"], got["expected_silver_rows"], got["expected_rejected_rows"]) == (3060, 2880, 180)
    assert {k: got[k] for k in ("DUPLICATE_TRIP", "INVALID_PICKUP_DATETIME", "MISSING_LOCATION", "INVALID_FARE")} == {"DUPLICATE_TRIP": 60, "INVALID_PICKUP_DATETIME": 30, "MISSING_LOCATION": 60, "INVALID_FARE": 30}
    with pytest.raises(ValueError, match="differ"):
        lake.fixture(batches, expected | {"raw_rows": 1})
    more = lake.fixture(batches | {"evolved": generate.evolution_batch(spark)})
    again = lake.fixture(batches | {"evolved": generate.evolution_batch(spark)})
    assert more["expected_silver_rows"] == again["expected_silver_rows"] == 2980
    assert lake.table("fixture/silver").read().filter("surcharge_fee is null").count() == 2880


def test_published_tables(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"LocationID": 1, "the_geom": "x"}, {"LocationID": 2, "the_geom": "y"}]')
    (tmp_path / "b.geojson").write_text('{"features": [{"properties": {"zone": "Zone 3", "location_id": "3"}, "geometry": {"type": "Point"}}]}')
    (tmp_path / "c.json").write_text('{"meta": {"view": {"columns": [{"name": "sid"}, {"name": "Zone"}]}}, "data": [["r1", " zone 4 "]]}')
    lookup = generate.zone_lookup(spark)
    ids = lambda name, kind: sorted(r[0] for r in readers.ids_of(readers.published_table(spark, str(tmp_path / name), kind), lookup).collect())
    assert ids("a.json", "json") == [1, 2] and ids("b.geojson", "geojson") == [3] and ids("c.json", "portal") == [4]
    assert readers.published_table(spark, "x", "html").count() == 0
    with pytest.raises(ValueError, match="header|among"):
        readers.ids_of(spark.createDataFrame([("x",)], "what string"), lookup)


def test_zone_dimension(spark):
    dim = readers.zone_dimension(generate.zone_lookup(spark), generate.area_members(spark)).cache()
    assert dim.count() == 265 and dim.filter("is_cbd").count() == 5 and dim.filter("is_unknown").count() == 2
    assert not readers.zone_dimension(generate.zone_lookup(spark), None).first()["cbd_reference_available"]


def test_schema_drift(spark):
    a, b = spark.createDataFrame([], "x int, Y string").schema, spark.createDataFrame([], "x long, y string, z int").schema
    assert readers.schema_drift({"a": a, "b": b}) == {"x": {"a": "int", "b": "bigint"}, "z": {"a": "MISSING", "b": "int"}}


def test_files_land_once(spark, tmp_path):
    events = spark.range(40).select("id", F.expr("timestamp_ntz '2025-01-01 00:00:00'").alias("ts"))
    src, t = str(tmp_path / "in"), VersionedTable(spark, str(tmp_path / "t"))
    events.repartition(4).write.parquet(src)
    run = lambda: ingest.land_files(spark, src, events.schema, t, str(tmp_path / "check"), per_batch=2).awaitTermination()
    run()
    assert t.read().count() == 40 and t.version() == 1
    events.write.mode("append").parquet(src)
    run()
    run()
    assert t.read().count() == 80 and t.read().select("_source_file").distinct().count() > 4


def test_windows_on_a_stream_equal_the_batch(spark, tmp_path):
    rows = spark.range(200).select(F.expr("timestamp_ntz '2025-01-01 00:00:00' + make_dt_interval(0, 0, id * 7)").alias("ts"), F.expr("if(id % 2 = 0, 'a', 'b')").alias("event_type"), F.col("id").cast("double").alias("value"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = ingest.windowed_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, ingest.windowed_counts(rows).collect()))


def test_settings_are_restored(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with settings(spark, spark__sql__shuffle__partitions="7"):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "7"
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_manifest_and_fallback_list(spark, tmp_path):
    for name, month in (("a", "2024-02"), ("b", "2025-01")):
        generate.month_file(spark, month, 60)[0].coalesce(1).write.parquet(str(tmp_path / name))
    m = readers.manifest(spark, {n: str(tmp_path / n) for n in "ab"})
    assert m["files"]["a"]["rows"] == 74 and m["drift"]["cbd_congestion_fee"]["a"] == "MISSING" and not m["events"]
    changed = {"files": {"a": m["files"]["a"] | {"sha256": "x"}}}
    assert readers.manifest(spark, {"a": str(tmp_path / "a")}, changed)["events"][0]["type"] == "REPUBLISHED"
    found = {r[0]: r[1] for r in readers.fallback_members(spark).groupBy("source").count().collect()}
    assert sorted(found.values()) == [5, 33]


def test_fixture_files(spark, tmp_path):
    counts = generate.write_fixture(spark, str(tmp_path / "f"), batches=1, rows=100, dates=1, starts=2, ends=3, fares=4, copies=5)
    df = readers.json_lines(spark, str(tmp_path / "f/batch_1"), generate.FIXTURE_DDL)
    lake = lakehouse.Lakehouse(spark, str(tmp_path / "lake"))
    assert lake.fixture({"b": df}, counts)["MISSING_LOCATION"] == 5


def test_diagnose_and_sweeps(lake):
    assert "negative_fares" in lake.diagnose()
    df = lake.trips.read().groupBy("PULocationID").count()
    assert len(layouts.shuffle_sweep(df, [2, 4])) == 4
    small = lake.zones.read().hint("broadcast")
    joined = lake.trips.read().join(small, F.col("PULocationID") == F.col("LocationID"))
    assert layouts.join_kinds(joined) == ["BroadcastHashJoin"]
    merged = lake.trips.read().hint("merge").join(lake.zones.read(), F.col("PULocationID") == F.col("LocationID"))
    assert layouts.join_kinds(merged) == ["SortMergeJoin"]
    sweep = layouts.size_sweep(lake.trips.read().drop("dq_flags"), f"{lake.folder.root}/sweeps", [("PULocationID", "=", 132)], ["PULocationID"], [16 << 10, 64 << 10])
    assert sweep[0]["files"] > sweep[1]["files"] and all(s["selected"] <= s["files"] for s in sweep)
