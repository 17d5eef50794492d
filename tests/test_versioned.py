import os
import threading

import pytest
from pyspark.sql import functions as F

from tidemill.sources.log import ConcurrentWrite
from tidemill.sources.versioned import VersionedTable, may_hold


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def numbers(spark, a, b):
    return spark.range(a, b).select("id", (F.col("id") % 3).cast("int").alias("part"), F.sha2(F.col("id").cast("string"), 256).alias("hash"))


@pytest.fixture
def table(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.create(numbers(spark, 0, 100), partition=["part"], user_metadata={"batch_id": "a"})
    return t


def test_append_overwrite_and_time_travel(spark, table):
    table.append(numbers(spark, 100, 150), user_metadata={"batch_id": "b"})
    table.overwrite(spark.range(5))
    assert [table.read(v).count() for v in (0, 1, 2)] == [100, 150, 5]
    assert table.read().columns == ["id"]
    assert [r["operation"] for r in table.history().orderBy("version").collect()] == ["CREATE", "APPEND", "OVERWRITE"]
    assert table.batches() == {"a": 0, "b": 1}
    assert table.schema_changes()[1]["removed"] == ["hash", "part"]
    with pytest.raises(ValueError):
        table.read(9)


def test_an_empty_append_does_not_claim_a_batch(spark, table):
    table.append(numbers(spark, 0, 0), user_metadata={"batch_id": "c"})
    table.append(numbers(spark, 200, 210), user_metadata={"batch_id": "c"})
    assert table.batches()["c"] == 2


def test_evolution_rewrites_nothing(spark, table):
    before = {f.path for f in table.files()}
    with pytest.raises(ValueError):
        table.append(numbers(spark, 100, 110).withColumn("extra", F.lit(1)))
    table.append(numbers(spark, 100, 110).withColumn("extra", F.lit(1)), evolve=True)
    assert before <= {f.path for f in table.files()}
    assert table.read().filter("extra is null").count() == 100
    assert table.schema_changes()[-1] == {"version": 1, "kind": "SCHEMA_CHANGE", "added": ["extra"], "removed": [], "retyped": []}


def test_merge_equals_a_full_join(spark, table):
    changed = numbers(spark, 10, 20).withColumn("hash", F.lit("new"))
    feed = changed.unionByName(numbers(spark, 30, 35)).unionByName(numbers(spark, 200, 207)).withColumn("note", F.lit("x"))
    plan = table.plan_merge(feed, ["id"], "hash")
    done = table.merge(feed, ["id"], "hash")
    assert plan == {"inserts": 7, "updates": 10, "noop": 5}
    assert (done["inserted"], done["updated"], done["noop"]) == (7, 10, 5)
    got = {r["id"]: (r["hash"], r["note"]) for r in table.read().collect()}
    assert len(got) == 107
    assert all(got[i] == ("new", "x") for i in range(10, 20))
    assert all(got[i][1] is None for i in range(30, 35))  # no change, so lineage stays
    assert all(got[i][1] == "x" for i in range(200, 207))
    again = table.merge(feed, ["id"], "hash")
    assert (again["inserted"], again["updated"], again["noop"], again["files_removed"]) == (0, 0, 22, 0)


def test_merge_keeps_what_the_source_lacks(spark, table):
    table.merge(spark.createDataFrame([(1, "z"), (500, "z")], "id long, hash string"), ["id"], "hash")
    got = {r["id"]: r for r in table.read().filter("hash = 'z'").collect()}
    assert got[1]["part"] == 1 and got[500]["part"] is None


def test_merge_finds_rows_in_other_partitions(spark, table):
    done = table.merge(spark.createDataFrame([(4, 2, "moved")], "id long, part int, hash string"), ["id"], "hash")
    assert (done["inserted"], done["updated"]) == (0, 1) and table.read().filter("id = 4").collect()[0]["part"] == 2


def test_merge_refuses_repeated_keys(spark, table):
    with pytest.raises(ValueError, match="several"):
        table.merge(numbers(spark, 0, 1).unionByName(numbers(spark, 0, 1)), ["id"], "hash")


def test_delete_and_replace(spark, table):
    table.delete([("id", ">=", 90)])
    assert table.read().count() == 90 and table.last_metrics()["rows_deleted"] == 10
    table.replace_where([("part", "=", 1)], numbers(spark, 1000, 1003))
    assert table.read().filter("id < 1000 and part = 1").count() == 0
    assert table.read().filter("id >= 1000").count() == 3
    assert table.read(0).count() == 100


@pytest.mark.parametrize("by", [[], ["id"], ["id", "part"]])
def test_layouts_keep_rows_and_skip_files(spark, tmp_path, by):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.create(numbers(spark, 0, 4000).repartition(8))
    before = rows_of(t.read())
    t.optimize(sum(f.size for f in t.files()) // 6 if by else 1 << 30, by=by)
    assert rows_of(t.read()) == before
    for where in ([("id", "=", 17)], [("id", "<", 100), ("part", "in", [0, 2])], [("hash", ">", "f")]):
        assert rows_of(t.read(where=where)) == rows_of(t.read().filter(" and ".join("id = 17" if w[1] == "=" else f"{w[0]} in (0, 2)" if w[1] == "in" else f"{w[0]} {w[1]} '{w[2]}'" for w in where)))
    if by:
        assert len(t.files(where=[("id", "=", 17)])) < len(t.files())
    else:
        assert len(t.files()) == 1


def test_statistics_never_lose_times(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.create(spark.range(100).select(F.expr("timestamp_ntz '2025-01-01 00:00:00' + make_dt_interval(id)").alias("ts"), "id"))
    f = t.files()[0]
    assert may_hold(f, [("ts", ">=", "2025-01-05")]) and may_hold(f, [("ts", "=", "2025-01-05 00:00:00")])
    assert not may_hold(f, [("ts", "<", "2025-01-01 00:00:00")])


def test_vacuum_breaks_only_old_versions(spark, table):
    table.overwrite(spark.range(3))
    with pytest.raises(ValueError):
        table.vacuum(0)
    listed = table.vacuum(0, dry_run=True)
    assert listed and table.readable(0)
    assert table.vacuum(0, unsafe=True) == listed
    assert not table.readable(0) and table.readable(1)


def test_commits_are_created_once(spark, table):
    assert not table.folder.create("_log/00000000000000000000.json", "{}")
    other = VersionedTable(spark, table.folder.root)
    s = table.log.snapshot()
    other.append(numbers(spark, 100, 101))
    with pytest.raises(ConcurrentWrite):
        table._commit(s.version, "REPLACE", [], [])
    assert table._commit(s.version, "APPEND", [], [], blind=True) == 2
    done = []
    threads = [threading.Thread(target=lambda i=i: done.append(VersionedTable(spark, table.folder.root).append(numbers(spark, i, i + 1)))) for i in range(300, 303)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(done) == [3, 4, 5] and table.read().count() == 104


def test_checkpoints_give_the_same_snapshot(spark, table):
    for i in range(11):
        table.append(numbers(spark, 1000 + i, 1001 + i))
    assert table.log.checkpoints() == [10]
    whole = table.log.snapshot()
    os.remove(table.folder.root.removeprefix("file:") + "/_log/00000000000000000010.checkpoint.json")
    assert VersionedTable(spark, table.folder.root).log.snapshot() == whole and len(table.census()) == 12


def test_diff(spark, table):
    table.merge(numbers(spark, 99, 102).withColumn("hash", F.lit("n")), ["id"], "hash")
    table.delete([("id", "=", 0)])
    got = {r["change"]: r["count"] for r in table.diff(0, 2, ["id"], ["hash"]).groupBy("change").count().collect()}
    assert got == {"added": 2, "changed": 1, "removed": 1}


def test_restore_and_versions_by_time(spark, table):
    import time
    from datetime import UTC, datetime

    table.append(numbers(spark, 100, 110).withColumn("extra", F.lit(1)), evolve=True)
    between = datetime.fromtimestamp(time.time(), UTC).replace(tzinfo=None)
    time.sleep(0.05)
    table.delete([("id", "<", 50)])
    assert table.version_at(between) == 1
    assert table.restore(0) == 3
    assert table.read().columns == ["id", "part", "hash"] and table.read().count() == 100
    table.vacuum(0, unsafe=True)
    with pytest.raises(ValueError, match="vacuumed"):
        table.restore(2)
    with pytest.raises(ValueError):
        table.version_at(datetime(2000, 1, 1))


def test_strings_as_long_as_times_are_strings(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "s"))
    t.create(spark.createDataFrame([("a" * 26,), ("r",)], "name string").coalesce(1))
    assert rows_of(t.read(where=[("name", "=", "r")])) == [("r",)]
    t.delete([("name", "=", "r")])
    assert rows_of(t.read()) == [("a" * 26,)]


def test_marked_rows_are_gone(spark, table):
    """Deletes and merges without a rewrite, twice in the same files, then packing, restoring and vacuuming."""
    before = rows_of(table.read())
    table.delete([("id", "<", 10)], vectors=True)
    assert rows_of(table.read()) == [r for r in before if r[0] >= 10] and table.last_metrics()["rows_deleted"] == 10
    feed = numbers(spark, 8, 14).withColumn("hash", F.lit("new"))
    done = table.merge(feed, ["id"], "hash", vectors=True)
    assert (done["inserted"], done["updated"], done["copied"], done["files_removed"]) == (2, 4, 0, 0)
    got = {r["id"]: r["hash"] for r in table.read().collect()}
    assert sorted(got) == list(range(8, 100)) and {i for i, h in got.items() if h == "new"} == set(range(8, 14))
    assert table.detail()["rows"] == 92 and [c["rows"] for c in table.census()] == [100, 90, 92]
    assert rows_of(table.read(0)) == before and table.read(1).count() == 90
    assert rows_of(table.read(where=[("id", "=", 9)])) == [r for r in rows_of(table.read()) if r[0] == 9]
    changes = {r["change"]: r["count"] for r in table.changes(1, 2).groupBy("change").count().collect()}
    assert changes == {"insert": 6, "delete": 4}
    again = table.merge(feed, ["id"], "hash", vectors=True)
    assert (again["inserted"], again["updated"], again["noop"]) == (0, 0, 6)
    now = rows_of(table.read())
    table.delete([("id", ">=", 90)])  # a rewrite of files with marks
    assert rows_of(table.read()) == [r for r in now if r[0] < 90]
    table.restore(3)
    assert rows_of(table.read()) == now
    table.vacuum(0, unsafe=True)
    assert rows_of(table.read()) == now
    table.optimize(1 << 30)
    assert rows_of(table.read()) == now and not any(f.gone for f in table.files())


def test_files_without_rows_left_go(spark, table):
    table.delete([("id", ">=", 0)], vectors=True)
    assert table.files() == [] and table.read().count() == 0 and table.read(0).count() == 100


def test_null_statistics_count_marked_rows(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "n"))
    t.create(spark.range(10).select("id", F.when(F.col("id") >= 6, F.col("id")).alias("v")).coalesce(1))
    t.delete([("id", "<", 4)], vectors=True)  # six of ten values are null, and six rows are left
    assert t.read(where=[("v", ">=", 6)]).count() == 4


def test_checkpoints_keep_marks(spark, table):
    table.delete([("id", "<", 10)], vectors=True)
    for i in range(10):
        table.append(numbers(spark, 1000 + i, 1001 + i))
    assert table.log.checkpoints() == [10] and VersionedTable(spark, table.folder.root).read().count() == 100
