"""Versioned tables over plain Parquet: append, overwrite, delete, replace, merge, history, time travel, layout, vacuum.

A table is a folder of immutable Parquet files and a log of commits (see log.py). Readers get an explicit list of the
files of a snapshot. Files carry row counts and minima, maxima and null counts of their columns, by which reads and
rewrites skip files; what is skipped never changes a result, as predicates are applied to the rows too.

Deletes and merges rewrite the files that they touch or, with vectors=True, write the numbers of the rows that go beside
them; readers leave those rows out, and packing writes such files anew.
"""

from __future__ import annotations

import calendar
import json
import math
import os
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import replace
from datetime import date, datetime
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions.expressions import named
from tidemill.functions.session import own_shuffles, settings
from tidemill.sources.log import DataFile, Folder, Layout, Log, Snapshot

#: Statistics are kept of the first columns only, as wide tables would make the log large.
STAT_COLUMNS = 32
_ORDERED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)
#: Names of the columns that tell where a row is.
FILE, ROW = "__file", "__row"
MARKS = f"{FILE} string, {ROW} bigint"
#: Deleted rows of the files that are read up to which their numbers are broadcast.
BROADCAST_MARKS = 1_000_000
#: Hashes of keys up to which they are broadcast.
BROADCAST_KEYS = 1_000_000
#: (column, operator, value): =, <, <=, >, >=, in; joined by and.
Predicate = tuple[str, str, Any]


def _plain(value: Any) -> Any:
    """A statistic as JSON keeps it: text of dates, times and decimals sorts or converts back by type."""
    if isinstance(value, datetime):
        return value.strftime("%Y-%m-%d %H:%M:%S.%f")
    if isinstance(value, date):
        return value.isoformat()
    if isinstance(value, Decimal):
        return float(value)
    return value


def as_column(where: Iterable[Predicate]) -> Column:
    test = F.lit(True)
    for c, op, v in where:
        col = named(c)
        test = test & {"=": lambda: col == v, "<": lambda: col < v, "<=": lambda: col <= v, ">": lambda: col > v, ">=": lambda: col >= v, "in": lambda: col.isin(*v)}[op]()
    return test


def _kinds(s: Snapshot) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in T.StructType.fromJson(json.loads(s.layout.schema)).fields}


def may_hold(f: DataFile, where: Iterable[Predicate], kinds: dict[str, T.DataType] | None = None) -> bool:
    """Whether a file's statistics allow a row that meets all predicates.

    kinds are the columns' types; without them, text of 26 characters counts as a time.
    """
    for c, op, v in where:
        if f.rows and f.nulls.get(c) == f.rows + f.gone_rows:
            return False
        low, high = f.low.get(c), f.high.get(c)
        if low is None or high is None:
            continue
        vs = [_plain(x) for x in (v if op == "in" else [v])]
        if isinstance(low, float) and isinstance(high, float) and (math.isnan(low) or math.isnan(high)):
            continue
        if isinstance(low, str) and any(not isinstance(x, str) for x in vs):
            continue
        stamp = isinstance(low, str) and len(low) == 26 if kinds is None else isinstance(kinds.get(c), (T.TimestampType, T.TimestampNTZType))
        if stamp and any(len(x) != 26 for x in vs):
            vs = [x if len(x) == 26 else (x + " 00:00:00.000000")[:26] if len(x) == 10 else (x + ".000000")[:26] for x in vs]
        if op in ("=", "in") and not any(low <= x <= high for x in vs):
            return False
        if (op == "<" and not low < vs[0]) or (op == "<=" and not low <= vs[0]) or (op == ">" and not high > vs[0]) or (op == ">=" and not high >= vs[0]):
            return False
    return True


class VersionedTable:
    """A table at a folder that Spark can reach."""

    def __init__(self, spark: SparkSession, path: str, compression: str | None = None):
        """compression: how files are written from now on (None: as the session says); what is there stays readable."""
        self.spark, self.folder = spark, Folder(spark, path)
        self.options = {"compression": compression} if compression else {}
        self.log = Log(self.folder)

    # ---- reading ----

    def exists(self) -> bool:
        return self.log.latest() >= 0

    def version(self) -> int:
        return self.log.latest()

    def schema(self, version: int | None = None) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.log.snapshot(version).layout.schema))

    def read(self, version: int | None = None, where: Iterable[Predicate] = ()) -> DataFrame:
        """Rows of a version (default: the latest) that meet all predicates; files that can't hold any aren't opened."""
        where = list(where)
        df = self._frame(self.log.snapshot(version), where)
        return df.filter(as_column(where)) if where else df

    def _frame(self, s: Snapshot, where: Iterable[Predicate] = (), only: Iterable[str] | None = None, located: bool = False) -> DataFrame:
        """Rows of files; located adds FILE and ROW, the file's name and the row's number in it."""
        schema = T.StructType.fromJson(json.loads(s.layout.schema))
        where, kinds = list(where), _kinds(s)
        files = [f for f in s.files.values() if may_hold(f, where, kinds)] if only is None else [s.files[p] for p in only]
        cols = [named(f.name) for f in schema.fields]
        place = [F.substring_index("_metadata.file_path", "/data/", -1).alias(FILE), F.col("_metadata.row_index").alias(ROW)]
        parts = []
        for pruned in (False, True):
            paths = [f"{self.folder.root}/{f.path}" for f in files if bool(f.gone) is pruned]
            if not paths:
                continue
            df = self.spark.read.schema(schema).parquet(*paths)
            if pruned or located:
                df = df.select(*cols, *place)
            if pruned:
                marks = self._marks([f for f in files if f.gone])
                df = df.join(F.broadcast(marks) if sum(f.gone_rows for f in files) <= BROADCAST_MARKS else marks, [FILE, ROW], "left_anti")
            parts.append(df if located or not pruned else df.select(*cols))
        if not parts:
            empty = T.StructType([*schema.fields, *([T.StructField(FILE, T.StringType()), T.StructField(ROW, T.LongType())] if located else [])])
            return self.spark.createDataFrame([], empty)
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def _marks(self, files: list[DataFile]) -> DataFrame:
        """(FILE, ROW) of the rows of files that were deleted without a rewrite."""
        if not files:
            return self.spark.createDataFrame([], MARKS)
        folder = F.substring_index(F.substring_index("_metadata.file_path", "/data/", -1), "/", 1)
        marks = self.spark.read.schema(MARKS).parquet(*sorted({f"{self.folder.root}/{f.gone}" for f in files})).select(FILE, ROW, folder.alias("_of"))
        # a folder can hold marks of files that have others by now
        now = self.spark.createDataFrame([(f.path.removeprefix("data/"), f.gone.removeprefix("data/")) for f in files], f"{FILE} string, _of string")
        return marks.join(now, [FILE, "_of"]).select(FILE, ROW)

    def _without(self, s: Snapshot, rows: DataFrame, touched: list[str]) -> list[DataFile]:
        """The touched files (without those that have no row left) after rows (FILE, ROW) went by their numbers only."""
        name = f"data/{uuid.uuid4().hex}-gone"
        rows.unionByName(self._marks([s.files[p] for p in touched if s.files[p].gone])).write.parquet(f"{self.folder.root}/{name}")
        counts = {f"data/{r[FILE]}": r["count"] for r in self.spark.read.schema(MARKS).parquet(f"{self.folder.root}/{name}").groupBy(FILE).count().collect()}
        out = [replace(f, rows=f.rows + f.gone_rows - counts[p], gone=name, gone_rows=counts[p]) for p in touched for f in [s.files[p]]]
        return [f for f in out if f.rows]

    def files(self, version: int | None = None, where: Iterable[Predicate] = ()) -> list[DataFile]:
        where, s = list(where), self.log.snapshot(version)
        kinds = _kinds(s)
        return [f for f in s.files.values() if may_hold(f, where, kinds)]

    # ---- writing ----

    def _write(self, df: DataFrame) -> list[DataFile]:
        """Write rows as new files, with statistics from one more scan of them; shuffle files of what led to them go."""
        name = f"data/{uuid.uuid4().hex}"
        at = f"{self.folder.root}/{name}"
        with own_shuffles(self.spark):
            df.write.options(**self.options).parquet(at)
        sizes = {p: size for p, size, _ in self.folder.walk(name) if p.endswith(".parquet")}
        kept = [f for f in df.schema.fields if isinstance(f.dataType, _ORDERED)][:STAT_COLUMNS]
        aggs = [F.count("*").alias("rows")]
        for i, f in enumerate(kept):
            c = named(f.name)
            lo, hi = F.min(c), F.max(c)
            if isinstance(f.dataType, T.TimestampType):
                lo, hi = lo.cast("timestamp_ntz"), hi.cast("timestamp_ntz")
            aggs += [lo.alias(f"l{i}"), hi.alias(f"h{i}"), F.count_if(c.isNull()).alias(f"n{i}")]
        out = []
        back = self.spark.read.schema(df.schema).parquet(at)
        for r in back.groupBy(F.col("_metadata.file_name").alias("file")).agg(*aggs).collect():
            out.append(
                DataFile(
                    path=f"{name}/{r['file']}",
                    rows=r["rows"],
                    size=sizes[f"{name}/{r['file']}"],
                    low={f.name: _plain(r[f"l{i}"]) for i, f in enumerate(kept) if r[f"l{i}"] is not None},
                    high={f.name: _plain(r[f"h{i}"]) for i, f in enumerate(kept) if r[f"h{i}"] is not None},
                    nulls={f.name: r[f"n{i}"] for i, f in enumerate(kept)},
                )
            )
        return sorted(out, key=lambda f: f.path)

    def _commit(self, base: int, operation: str, add: list[DataFile], remove: Iterable[str], *, layout: Layout | None = None, metrics: dict | None = None, parameters: dict | None = None, user_metadata: dict | None = None, blind: bool = False) -> int:
        remove = list(remove)
        metrics = {"rows_added": sum(f.rows for f in add), "files_added": len(add), "files_removed": len(remove), "bytes_added": sum(f.size for f in add)} | (metrics or {})
        info = {"operation": operation, "parameters": parameters or {}, "metrics": metrics, "user_metadata": user_metadata or {}}
        return self.log.append(base, info, add, remove, layout, blind)

    @staticmethod
    def _spread(df: DataFrame, partition: Iterable[str], mostly: Iterable[Predicate] = ()) -> DataFrame:
        """Rows of one partition value together; large values are split by the optimiser.

        Rows that meet `mostly`, which names one partition value, go to files of their own as they come, without a shuffle.
        """
        cols, mostly = [named(c) for c in partition], list(mostly)
        if not cols:
            return df
        if not mostly:
            return df.hint("rebalance", *cols)
        test = F.coalesce(as_column(mostly), F.lit(False))
        return df.filter(test).unionByName(df.filter(~test).hint("rebalance", *cols))

    def create(self, df: DataFrame, *, partition: Iterable[str] = (), cluster: Iterable[str] = (), properties: dict[str, str] | None = None, user_metadata: dict | None = None, mostly: Iterable[Predicate] = ()) -> int:
        if self.exists():
            raise ValueError(f"{self.folder.root} is a table already")
        layout = Layout(df.schema.json(), tuple(partition), tuple(cluster), properties or {})
        return self._commit(-1, "CREATE", self._write(self._spread(df, partition, mostly)), [], layout=layout, user_metadata=user_metadata)

    def _evolved(self, s: Snapshot, incoming: T.StructType, evolve: bool) -> tuple[Layout | None, T.StructType]:
        """The layout that also has the incoming columns (None: no change), and its schema."""
        schema = T.StructType.fromJson(json.loads(s.layout.schema))
        have = {f.name.lower(): f for f in schema.fields}
        fresh = [T.StructField(f.name, f.dataType, True) for f in incoming.fields if f.name.lower() not in have]
        for f in incoming.fields:
            old = have.get(f.name.lower())
            if old is not None and old.dataType != f.dataType:
                raise ValueError(f"column {f.name} is {f.dataType.simpleString()}; the table has {old.dataType.simpleString()}")
        if not fresh:
            return None, schema
        if not evolve:
            raise ValueError(f"the table has no columns {[f.name for f in fresh]}; pass evolve=True to add them")
        schema = T.StructType([*schema.fields, *fresh])
        return Layout(schema.json(), s.layout.partition, s.layout.cluster, s.layout.properties), schema

    @staticmethod
    def _shaped(df: DataFrame, schema: T.StructType) -> DataFrame:
        have = {c.lower(): c for c in df.columns}
        return df.select(*[(named(have[f.name.lower()]) if f.name.lower() in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])

    def append(self, df: DataFrame, *, evolve: bool = False, user_metadata: dict | None = None, mostly: Iterable[Predicate] = ()) -> int:
        """Add rows. With evolve, new columns join the schema; older rows read null there, and no file is rewritten."""
        s = self.log.snapshot()
        layout, schema = self._evolved(s, df.schema, evolve)
        add = self._write(self._spread(self._shaped(df, schema), s.layout.partition, mostly))
        return self._commit(s.version, "APPEND", add, [], layout=layout, user_metadata=user_metadata, blind=layout is None)

    def overwrite(self, df: DataFrame, *, user_metadata: dict | None = None) -> int:
        """Replace rows and schema; earlier versions stay readable."""
        if not self.exists():
            return self.create(df, user_metadata=user_metadata)
        s = self.log.snapshot()
        partition = tuple(c for c in s.layout.partition if c in df.columns)
        layout = None if df.schema.json() == s.layout.schema else Layout(df.schema.json(), partition, tuple(c for c in s.layout.cluster if c in df.columns), s.layout.properties)
        return self._commit(s.version, "OVERWRITE", self._write(self._spread(df, partition)), s.files, layout=layout, user_metadata=user_metadata)

    def _hit(self, s: Snapshot, condition: Column, where: list[Predicate]) -> list[str]:
        """Files that hold a row that meets the condition."""
        kinds = _kinds(s)
        listed = [p for p, f in s.files.items() if may_hold(f, where, kinds)]
        if not listed:
            return []
        found = self._frame(s, only=listed, located=True).filter(condition).select(FILE).distinct().collect()
        return [f"data/{r[FILE]}" for r in found]

    def delete(self, where: Iterable[Predicate], *, user_metadata: dict | None = None, vectors: bool = False) -> int:
        """Remove rows that meet all predicates; only files that hold one are rewritten, or with vectors get marks of those rows."""
        if not vectors:
            return self._replace(list(where), None, "DELETE", user_metadata, False)
        s, where = self.log.snapshot(), list(where)
        test = F.coalesce(as_column(where), F.lit(False))
        hit = self._hit(s, test, where)
        left = self._without(s, self._frame(s, only=hit, located=True).filter(test).select(FILE, ROW), hit) if hit else []
        gone = sum(s.files[p].rows for p in hit) - sum(f.rows for f in left)
        metrics = {"rows_added": 0, "files_added": 0, "bytes_added": 0, "rows_deleted": gone, "rows_copied": 0, "files_marked": len(left), "files_removed": len(hit) - len(left)}
        return self._commit(s.version, "DELETE", left, hit, metrics=metrics, parameters={"where": [list(map(str, w)) for w in where], "vectors": True}, user_metadata=user_metadata)

    def replace_where(self, where: Iterable[Predicate], df: DataFrame, *, evolve: bool = False, user_metadata: dict | None = None) -> int:
        """Rows of df instead of those that meet all predicates, in one commit."""
        return self._replace(list(where), df, "REPLACE", user_metadata, evolve)

    def _replace(self, where: list[Predicate], df: DataFrame | None, operation: str, user_metadata: dict | None, evolve: bool) -> int:
        s = self.log.snapshot()
        test = F.coalesce(as_column(where), F.lit(False))
        hit = self._hit(s, test, where)
        layout, schema = self._evolved(s, df.schema, evolve) if df is not None else (None, T.StructType.fromJson(json.loads(s.layout.schema)))
        add = self._write(self._spread(self._shaped(df, schema), s.layout.partition)) if df is not None else []
        kept = self._write(self._shaped(self._frame(s, only=hit).filter(~test), schema)) if hit else []
        kept = [f for f in kept if f.rows]
        gone = sum(s.files[p].rows for p in hit) - sum(f.rows for f in kept)
        return self._commit(s.version, operation, [*add, *kept], hit, layout=layout, metrics={"rows_deleted": gone, "rows_copied": sum(f.rows for f in kept)}, parameters={"where": [list(map(str, w)) for w in where]}, user_metadata=user_metadata)

    @contextmanager
    def _shared(self, source: DataFrame, target: DataFrame, keys: list[str]) -> Iterator[Callable[[DataFrame], DataFrame]]:
        """What leaves out rows whose keys' hash neither is on both sides nor comes again in source: such keys are there once.

        Only hashes are shuffled for it; what is left is for a join of the keys themselves.
        """
        one, many = F.xxhash64(*[named(k) for k in keys]), 1 << 32
        sides = source.select(one.alias("_h"), F.lit(1).cast("long").alias("_n")).unionByName(target.select(one.alias("_h"), F.lit(many).alias("_n")))
        met = sides.groupBy("_h").agg(F.sum("_n").alias("_n")).filter((F.col("_n") % many > 1) | (F.col("_n") > many) & (F.col("_n") % many > 0))
        name = f"data/{uuid.uuid4().hex}-keys"
        with own_shuffles(self.spark):
            met.select("_h").write.parquet(f"{self.folder.root}/{name}")
        hashes = self.spark.read.schema("_h bigint").parquet(f"{self.folder.root}/{name}")
        few = hashes.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
        try:
            yield lambda df: df.withColumn("_h", one).join(F.broadcast(hashes) if few else hashes, "_h", "left_semi").drop("_h")
        finally:
            self.folder.delete(name)

    def plan_merge(self, source: DataFrame, keys: list[str], changed: str) -> dict[str, int]:
        """How many rows of source a merge would insert, update and leave, by one join of the keys that may be on both sides."""
        theirs = source.select(*[named(k) for k in keys], named(changed).alias("_s"))
        where = self._bounds(source, [c for c in self.log.snapshot().layout.partition if c in keys])
        ours = self.read(where=where).select(*[named(k) for k in keys], named(changed).alias("_t"), F.lit(True).alias("_found"))
        with self._shared(theirs, ours, keys) as left:
            some = left(theirs)
            joined = some.join(left(ours), keys, "left").agg(
                F.count_if(F.col("_found").isNull()).alias("inserts"),
                F.count_if(F.col("_found") & ~F.col("_s").eqNullSafe(F.col("_t"))).alias("updates"),
                F.count_if(F.col("_found") & F.col("_s").eqNullSafe(F.col("_t"))).alias("noop"),
            )
            row = joined.first().asDict()
            return row | {"inserts": row["inserts"] + theirs.count() - some.count()}

    def merge(self, source: DataFrame, keys: list[str], changed: str, *, evolve: bool = True, user_metadata: dict | None = None, vectors: bool = False, stored: bool = False, mostly: Iterable[Predicate] = ()) -> dict[str, int]:
        """Update rows whose `changed` column differs, insert keys that are new, leave the rest; one commit.

        Only files that hold a row to update are rewritten; with vectors none is: they get marks of such rows, whose new
        values are written beside the inserted ones. Two source rows with one key are an error. Columns that
        the source lacks keep their values in updated rows and are null in inserted ones. Null keys match nothing.
        stored: the source is read from files, so it isn't kept meanwhile; mostly: see _spread, for the rows to insert.
        """
        s = self.log.snapshot()
        layout, schema = self._evolved(s, source.schema, evolve)
        cols = [named(k) for k in keys]
        source, met = source if stored else source.persist(), None
        try:
            where, kinds = self._bounds(source, [c for c in s.layout.partition if c in keys]), _kinds(s)
            listed = [p for p, f in s.files.items() if may_hold(f, where, kinds)]
            target = self._frame(s, only=listed, located=True)
            ours = target.select(*cols, named(changed).alias("_t"), FILE, ROW)
            sure = source.dropna(subset=keys)
            # one join of the keys that may be met tells what is there, where it is, whether it differs, and which the source repeats
            with self._shared(sure.select(*cols), ours.select(*cols), keys) as left:
                theirs = left(sure.select(*cols, named(changed).alias("_s"))).groupBy(*cols).agg(F.count("*").alias("_times"), F.first("_s").alias("_s"))
                met = theirs.join(left(ours), keys, "left").select(*cols, FILE, ROW, "_times", (~F.col("_s").eqNullSafe(F.col("_t"))).alias("_differs")).persist()
                found = met.groupBy(FILE).agg(F.count("*").alias("n"), F.count_if("_differs").alias("u"), F.max("_times").alias("times")).collect()
            if any(r["times"] > 1 for r in found):
                raise ValueError(f"several source rows have the key {met.filter('_times > 1').select(*cols).first().asDict()}")
            there = [r for r in found if r[FILE] is not None]
            touched = [f"data/{r[FILE]}" for r in there if r["u"]]
            few = sum(r["n"] for r in there) <= BROADCAST_KEYS // 10
            held = met.filter(F.col(FILE).isNotNull())
            new = source.join(F.broadcast(held.select(*cols).distinct()) if few else held.select(*cols).distinct(), keys, "left_anti")
            out, marked = self._spread(self._shaped(new, schema), s.layout.partition, mostly if few else ()), []
            if touched:
                # of the source only the rows that differ, if they are few, so that nothing else moves
                u = F.broadcast(source.join(F.broadcast(held.filter("_differs").select(*cols).distinct()), keys, "left_semi")) if few else source
                t, u = self._shaped(self._frame(s, only=touched), schema).alias("t"), u.alias("u")
                joined = t.join(u, [F.col(f"t.`{k}`") == F.col(f"u.`{k}`") for k in keys], "inner" if vectors else "left")
                # the same condition guards rewriting and counting, so rows that don't differ keep their lineage
                take = F.col(f"u.`{keys[0]}`").isNotNull() & ~F.col(f"u.`{changed}`").eqNullSafe(F.col(f"t.`{changed}`"))
                have = {c.lower(): c for c in source.columns}
                changed_rows = joined.filter(take) if vectors else joined
                rewritten = changed_rows.select(*[(F.when(take, F.col(f"u.`{have[f.name.lower()]}`")).otherwise(F.col(f"t.`{f.name}`")) if f.name.lower() in have else F.col(f"t.`{f.name}`")).alias(f.name) for f in schema.fields])
                out = rewritten.unionByName(out)
                if vectors:
                    marked = self._without(s, met.filter(F.col(FILE).isNotNull() & F.col("_differs")).select(FILE, ROW), touched)
            added = [f for f in self._write(out) if f.rows]
        finally:
            source.unpersist()
            if met is not None:
                met.unpersist()
        # rewriting keeps the number of rows, so what is beyond it was inserted
        updated, written = sum(r["u"] for r in there), sum(f.rows for f in added)
        before = updated if vectors else sum(s.files[p].rows for p in touched)
        result = {"inserted": written - before, "updated": updated, "noop": sum(r["n"] for r in there) - updated}
        metrics = result | {"rows_copied": before - updated, "rows_added": written, "files_added": len(added), "bytes_added": sum(f.size for f in added), "files_removed": len(touched) - len(marked), "files_marked": len(marked)}
        version = self._commit(s.version, "MERGE", [*marked, *added], touched, layout=layout, metrics=metrics, parameters={"keys": keys, "changed": changed, "vectors": vectors}, user_metadata=user_metadata)
        return result | {"copied": before - updated, "files_removed": len(touched) - len(marked), "files_added": len(added), "version": version}

    def _bounds(self, source: DataFrame, partition: Iterable[str], most: int = 1000) -> list[Predicate]:
        """Values that the source has in partition columns which are keys, as a predicate on files; none if there are too many."""
        out = []
        for c in partition:
            found = source.select(named(c).alias("v")).distinct().limit(most + 1).collect()
            values = [r["v"] for r in found if r["v"] is not None]
            if values and len(found) <= most:
                out.append((c, "in", values))
        return out

    def version_at(self, when: datetime) -> int:
        """The latest version committed at or before a time (naive: UTC)."""
        limit = calendar.timegm(when.utctimetuple()) * 1000 + when.microsecond // 1000
        found = [v for v in self.log.versions() if self.log.commit(v)["info"]["timestamp"] <= limit]
        if not found:
            raise ValueError(f"{self.folder.root} has no version as of {when}")
        return found[-1]

    def restore(self, version: int, *, user_metadata: dict | None = None) -> int:
        """Make an earlier version the latest again, in one commit that writes no data; its files must still be there."""
        s, old = self.log.snapshot(), self.log.snapshot(version)
        there = {p for p, _, _ in self.folder.walk("data")}
        lost = sorted(p for p, f in old.files.items() if p not in there or (f.gone and not any(x.startswith(f"{f.gone}/") for x in there)))
        if lost:
            raise ValueError(f"version {version} can't be restored; {len(lost)} of its files were vacuumed")
        add = [f for p, f in old.files.items() if s.files.get(p) != f]
        return self._commit(s.version, "RESTORE", add, [p for p, f in s.files.items() if old.files.get(p) != f], layout=None if old.layout == s.layout else old.layout, parameters={"version": version}, user_metadata=user_metadata)

    # ---- layout ----

    def optimize(self, target_bytes: int, *, by: Iterable[str] = (), user_metadata: dict | None = None) -> dict[str, int]:
        """Rewrite into files of about target_bytes: packed as they are, ranged by one column, or along a Z-curve of several."""
        s, by = self.log.snapshot(), list(by)
        total = sum(f.size for f in s.files.values())
        n = max(1, math.ceil(total / target_bytes))
        df = self._frame(s)
        if not by:
            small = [p for p, f in s.files.items() if f.size < target_bytes or f.gone]
            if len(small) < 2 and not any(s.files[p].gone for p in small):
                return {"files_removed": 0, "files_added": 0, "version": s.version}
            # a scan packs whole files into partitions up to a size, and a partition becomes a file: no row is shuffled
            with settings(self.spark, spark__sql__files__maxPartitionBytes=target_bytes, spark__sql__files__openCostInBytes=0, spark__sql__files__minPartitionNum=1):
                add, remove = self._write(self._frame(s, only=small)), small
        else:
            key = named(by[0]) if len(by) == 1 else z_key(df, by)
            laid = df.withColumn("_z", key).repartitionByRange(n, "_z").sortWithinPartitions("_z", *[named(c) for c in by]).drop("_z")
            add, remove = self._write(laid), list(s.files)
        if sum(f.rows for f in add) != sum(s.files[p].rows for p in remove):
            raise RuntimeError("a rewrite changed the number of rows")
        version = self._commit(s.version, "OPTIMIZE", add, remove, parameters={"by": by, "target_bytes": target_bytes}, user_metadata=user_metadata)
        return {"files_removed": len(remove), "files_added": len(add), "version": version}

    def recluster(self, target_bytes: int, *, user_metadata: dict | None = None) -> dict[str, int]:
        """optimize() by the columns that the table was created to be clustered by."""
        return self.optimize(target_bytes, by=self.log.snapshot().layout.cluster, user_metadata=user_metadata)

    def vacuum(self, retain_hours: float = 168.0, *, dry_run: bool = False, unsafe: bool = False) -> list[str]:
        """Delete files that the latest version doesn't use and that are older than the retention; returns their names."""
        if retain_hours < 168 and not (unsafe or dry_run):
            raise ValueError("a retention below 168 hours can break readers and time travel; pass unsafe=True")
        now = self.log.snapshot().files
        used, marks = set(now), {f.gone for f in now.values() if f.gone}
        limit = time.time() * 1000 - retain_hours * 3_600_000
        gone = sorted(p for p, _, changed in self.folder.walk("data") if p not in used and os.path.dirname(p) not in marks and changed <= limit)
        if not dry_run:
            for p in gone:
                self.folder.delete(p)
        return gone

    # ---- looking back ----

    def history(self) -> DataFrame:
        """One row per commit, oldest first."""
        rows = []
        for v in self.log.versions():
            i = self.log.commit(v)["info"]
            rows.append((v, datetime.fromtimestamp(i["timestamp"] / 1000), i["operation"], json.dumps(i["parameters"]), {k: int(x) for k, x in i["metrics"].items()}, json.dumps(i["user_metadata"])))
        return self.spark.createDataFrame(rows, "version long, timestamp timestamp, operation string, parameters string, metrics map<string,bigint>, user_metadata string")

    def last_metrics(self) -> dict[str, int]:
        v = self.version()
        return self.log.commit(v)["info"]["metrics"] | {"version": v}

    def detail(self) -> dict[str, Any]:
        s = self.log.snapshot()
        return {"version": s.version, "num_files": len(s.files), "size_bytes": sum(f.size for f in s.files.values()), "rows": sum(f.rows for f in s.files.values()), "partition": list(s.layout.partition), "cluster": list(s.layout.cluster), "properties": s.layout.properties}

    def describe_commit(self, version: int) -> dict[str, Any]:
        c = self.log.commit(version)
        return {"version": version, **c["info"], "added": len(c["add"]), "removed": len(c["remove"]), "schema_changed": bool(c.get("layout")), "first_file": c["add"][0] if c["add"] else None}

    def schema_changes(self) -> list[dict[str, Any]]:
        """CREATE at the first schema, then what each later one added, removed or retyped."""
        out, before = [], None
        for v in self.log.versions():
            layout = self.log.commit(v).get("layout")
            if not layout:
                continue
            now = {f.name: f.dataType.simpleString() for f in T.StructType.fromJson(json.loads(layout["schema"])).fields}
            if before is None:
                out.append({"version": v, "kind": "CREATE", "columns": list(now)})
            elif now != before:
                out.append({"version": v, "kind": "SCHEMA_CHANGE", "added": sorted(now.keys() - before.keys()), "removed": sorted(before.keys() - now.keys()), "retyped": sorted(c for c in now.keys() & before.keys() if now[c] != before[c])})
            before = now
        return out

    def batches(self, field: str = "batch_id") -> dict[str, int]:
        """Version that first brought rows of each batch named in user metadata."""
        out: dict[str, int] = {}
        for v in self.log.versions():
            i = self.log.commit(v)["info"]
            name = i["user_metadata"].get(field)
            if name and i["metrics"].get("rows_added", 0) and name not in out:
                out[name] = v
        return out

    def census(self) -> list[dict[str, Any]]:
        """Rows, columns and operation of each version, from the log alone."""
        out = []
        for v in self.log.versions():
            s = self.log.snapshot(v)
            out.append({"version": v, "rows": sum(f.rows for f in s.files.values()), "columns": len(json.loads(s.layout.schema)["fields"]), "operation": self.log.commit(v)["info"]["operation"]})
        return out

    def readable(self, version: int) -> bool:
        """Whether all rows of a version can still be read; reads every file, as counts come from statistics."""
        try:
            df = self.read(version)
            df.agg(F.sum(F.crc32(F.concat_ws("|", *[named(c).cast("string") for c, t in df.dtypes if not t.startswith(("map", "array", "struct"))])))).collect()
        except Exception:
            return False
        return True

    def changes(self, before: int, after: int) -> DataFrame:
        """Rows that came and went between two versions, as multisets: all columns of the later one, and change (insert, delete).

        Only files that one of the versions has and the other hasn't are read; rows that were merely rewritten cancel out.
        """
        old, new = self.log.snapshot(before), self.log.snapshot(after)
        schema = T.StructType.fromJson(json.loads(new.layout.schema))
        gone = self._shaped(self._frame(old, only=[p for p, f in old.files.items() if new.files.get(p) != f]), schema)
        come = self._shaped(self._frame(new, only=[p for p, f in new.files.items() if old.files.get(p) != f]), schema)
        return come.exceptAll(gone).withColumn("change", F.lit("insert")).unionByName(gone.exceptAll(come).withColumn("change", F.lit("delete")))

    def diff(self, before: int, after: int, keys: list[str], compare: list[str]) -> DataFrame:
        """Keys that were added, removed or changed between two versions, with the columns compared on both sides."""

        def side(v: int, tag: str) -> DataFrame:
            return self.read(v).select(*[named(k) for k in keys], F.struct(*[named(c) for c in compare]).alias(tag))

        both = side(before, "before").join(side(after, "after"), keys, "full_outer")
        kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
        return both.withColumn("change", kind).filter("change is not null")


def z_key(df: DataFrame, by: list[str], bits: int = 6) -> Column:
    """Interleaved bits of each column's rank among 2^bits approximate quantiles; nulls come first."""
    steps = 1 << bits
    kinds = dict(df.dtypes)

    def number(c: str) -> Column:
        if kinds[c].startswith("timestamp"):
            return F.unix_micros(named(c).cast("timestamp")).cast("double")
        if kinds[c] == "date":
            return F.unix_date(named(c)).cast("double")
        if kinds[c] == "string":  # the first characters keep the order of text
            return F.conv(F.hex(F.rpad(F.substring(named(c), 1, 6), 6, " ")), 16, 10).cast("double")
        return named(c).cast("double")

    numbers = {c: number(c) for c in by}
    grid = [i / steps for i in range(1, steps)]
    cuts = df.agg(*[F.percentile_approx(v, grid, 10_000).alias(f"q{i}") for i, v in enumerate(numbers.values())]).first()
    key = F.lit(0).cast("long")
    for i, v in enumerate(numbers.values()):
        points = sorted(set(cuts[f"q{i}"] or []))
        rank = F.coalesce(_bucket(v, points), F.lit(0))
        for b in range(bits):
            key = key.bitwiseOR(F.shiftleft(F.shiftright(rank, b).bitwiseAND(F.lit(1)).cast("long"), b * len(by) + i))
    return key


def _bucket(value: Column, points: list[float], first: int = 0) -> Column:
    """1 + number of points not above the value, by a balanced tree of comparisons."""
    if not points:
        return F.when(value.isNotNull(), F.lit(first + 1))
    mid = len(points) // 2
    return F.when(value < points[mid], _bucket(value, points[:mid], first)).otherwise(_bucket(value, points[mid + 1 :], first + mid + 1))

