"""The incremental pipeline: landed batches, judged and merged trips, corrections, marts. State lives in tables only.

What has been processed is read from the commits of the trips table itself, so a run that dies between two commits
continues where it stopped: its batch is judged again, and a merge of what is merged already changes nothing.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.contract import TRIPS, Limits
from tidemill.functions.expressions import named
from tidemill.functions.session import own_shuffles
from tidemill.operators import classify, fixture, marts, profile
from tidemill.sources import generate, readers
from tidemill.sources.log import Folder
from tidemill.sources.versioned import VersionedTable

LEDGER = (
    "batch_id string, source_month string, landed_version bigint, landed_rows bigint, accepted_rows bigint, rejected_rows bigint, "
    "inserted bigint, updated bigint, noop bigint, trips_version bigint, reasons string, flags string, accepted string"
)
STEPS = ("reference", "bronze", "profile", "silver", "cdc", "evolution", "time_travel", "gold", "diagnose", "benchmark")


@dataclass
class Lakehouse:
    """Tables below one root folder."""

    spark: SparkSession
    root: str
    limits: Limits = Limits()

    def __post_init__(self):
        self.spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.folder = Folder(self.spark, self.root)

    def table(self, name: str) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.folder.root}/{name}", compression="zstd")

    @property
    def landed(self) -> VersionedTable:
        return self.table("bronze/trips")

    @property
    def trips(self) -> VersionedTable:
        return self.table("silver/trips")

    @property
    def rejected(self) -> VersionedTable:
        return self.table("silver/trips_rejected")

    @property
    def ledger(self) -> VersionedTable:
        return self.table("ops/ledger")

    @property
    def zones(self) -> VersionedTable:
        return self.table("silver/zones")

    def evidence(self, name: str, content: Any) -> None:
        self.folder.write(f"evidence/{name}.json", json.dumps(content, indent=1, default=str, sort_keys=True))

    def report(self, name: str, tables: dict[str, DataFrame | list[dict]]) -> None:
        """Named tables of numbers as one Markdown file."""
        rows = {title: t if isinstance(t, list) else [r.asDict() for r in t.collect()] for title, t in tables.items()}
        self.folder.write(f"evidence/{name}.md", f"# {name}\n\n" + "\n".join(f"## {title}\n\n{render_table(r)}" for title, r in rows.items()))

    # ---- steps ----

    def reference(self, lookup: DataFrame, members: DataFrame | None) -> dict[str, Any]:
        for name, df in (("bronze/zone_lookup", lookup), ("bronze/area_members", members)):
            if df is not None:
                self.table(name).overwrite(df)
        dim = readers.zone_dimension(lookup, members)
        self.zones.overwrite(dim)
        zones = self.zones.read()
        counts = zones.agg(F.count("*").alias("zones"), F.count_if("is_cbd").alias("members"), F.count_if("is_unknown").alias("unknown")).first()
        by_borough = zones.groupBy("borough").agg(F.count("*").alias("zones"), F.count_if("is_cbd").alias("members")).orderBy("borough")
        self.report("zones", {"Zones": [counts.asDict()], "By borough": by_borough, "Members": zones.filter("is_cbd").select("LocationID", "zone", "borough", "cbd_source").orderBy("LocationID")})
        return counts.asDict()

    def land(self, batch: DataFrame, batch_id: str, month: str, source: str, sha256: str, expected_rows: int | None = None) -> dict[str, Any]:
        """Append one file as one commit; a batch that has landed is left alone; a wrong number of rows is an error."""
        if self.landed.exists() and batch_id in self.landed.batches():
            return {"batch_id": batch_id, "landed": False}
        aligned, changes = classify.align(batch)
        lineage = {"_ingest_ts": F.current_timestamp(), "_source_file": F.lit(source), "_batch_id": F.lit(batch_id), "_source_month": F.lit(month), "_file_sha256": F.lit(sha256)}
        rows = aligned.withColumns(lineage)
        told = {"batch_id": batch_id, "source_month": month, "changes": changes}
        # one file is one month, so its rows lie together as they come
        of = [("_source_month", "=", month)]
        if self.landed.exists():
            version = self.landed.append(rows, evolve=True, user_metadata=told, mostly=of)
        else:
            version = self.landed.create(rows, partition=["_source_month"], user_metadata=told, mostly=of)
        written = self.landed.last_metrics()["rows_added"]
        if expected_rows is not None and written != expected_rows:
            raise RuntimeError(f"{batch_id}: {written} rows were written, the manifest has {expected_rows}")
        return {"batch_id": batch_id, "landed": True, "rows": written, "version": version, "changes": changes}

    def pending(self) -> list[tuple[str, int]]:
        """Batches that have landed but not gone through, in the order they landed."""
        done = self._done()
        return sorted(((b, v) for b, v in self.landed.batches().items() if b not in done), key=lambda x: x[1])

    def _done(self) -> set[str]:
        if not self.ledger.exists():
            return set()
        return {r["batch_id"] for r in self.ledger.read().select("batch_id").collect()}

    def process(self, batch_id: str, version: int) -> dict[str, Any]:
        """One batch: judge it in the schema it landed with, quarantine, merge, enter in the ledger."""
        landed = self.landed.read(version, [("_batch_id", "=", batch_id)])
        verdicts = classify.judge(landed, self.limits)
        at = f"scratch/{uuid.uuid4().hex}"
        try:
            # judged once into files, which hold less than a cache and are read by all that follows
            with own_shuffles(self.spark):
                verdicts.write.option("compression", "zstd").parquet(f"{self.folder.root}/{at}")
            judged = self.spark.read.schema(verdicts.schema).parquet(f"{self.folder.root}/{at}")
            good = classify.accepted(judged)
            bad = classify.quarantined(judged, landed.columns)
            tally = judged.groupBy("reject_reason").count().collect()
            reasons = {r["reject_reason"]: r["count"] for r in tally if r["reject_reason"]}
            flags = {r["flag"]: r["count"] for r in judged.filter("reject_reason is null").select(F.explode("dq_flags").alias("flag")).groupBy("flag").count().collect()}
            counted = [c for c in good.columns if c in landed.columns and c not in TRIPS.lineage]
            by_month = {r["pickup_month"]: {"rows": r["rows"], "nulls": {c: r[f"null__{c}"] for c in counted}} for r in profile.null_census(good, ["pickup_month"], counted).collect()}
            total, rejected = sum(r["count"] for r in tally), sum(reasons.values())
            month = self.landed.log.commit(version)["info"]["user_metadata"]["source_month"]
            told, of = {"batch_id": batch_id, "landed_version": version}, [("pickup_month", "=", month)]
            if self.rejected.exists():
                self.rejected.replace_where([("_batch_id", "=", batch_id)], bad, evolve=True, user_metadata=told)
            else:
                self.rejected.create(bad, partition=["_source_month"], user_metadata=told)
            before = self._merged_before(batch_id)
            if not self.trips.exists():
                v = self.trips.create(good, partition=["pickup_month"], mostly=of, user_metadata=told | {"inserted": total - rejected, "updated": 0, "noop": 0})
                result = {"inserted": total - rejected, "updated": 0, "noop": 0, "version": v}
            elif before:
                result = before
            else:
                plan = self.trips.plan_merge(good, ["pickup_month", "trip_key"], "row_hash")
                result = self.trips.merge(good, ["pickup_month", "trip_key"], "row_hash", user_metadata=told, stored=True, mostly=of)
                if (plan["inserts"], plan["updates"], plan["noop"]) != (result["inserted"], result["updated"], result["noop"]):
                    raise RuntimeError(f"{batch_id}: planned {plan}, merged {result}")
        finally:
            self.folder.delete(at)
        entry = {
            "batch_id": batch_id, "source_month": month, "landed_version": version, "landed_rows": total, "accepted_rows": total - rejected, "rejected_rows": rejected,
            "inserted": result["inserted"], "updated": result["updated"], "noop": result["noop"], "trips_version": result["version"],
            "reasons": json.dumps(reasons, sort_keys=True), "flags": json.dumps(flags, sort_keys=True),
            "accepted": json.dumps(by_month, sort_keys=True),
        }
        if total != rejected + result["inserted"] + result["updated"] + result["noop"]:
            raise RuntimeError(f"{batch_id}: rows aren't conserved: {entry}")
        row = self.spark.createDataFrame([entry], LEDGER)
        self.ledger.append(row, evolve=True) if self.ledger.exists() else self.ledger.create(row)
        return entry

    def _merged_before(self, batch_id: str) -> dict[str, int] | None:
        """What a merge of this batch did if it was committed in a run that died before the ledger."""
        if not self.trips.exists():
            return None
        for v in self.trips.log.versions():
            i = self.trips.log.commit(v)["info"]
            if i["user_metadata"].get("batch_id") == batch_id:
                source = i["metrics"] if i["operation"] == "MERGE" else i["user_metadata"]
                return {k: source[k] for k in ("inserted", "updated", "noop")} | {"version": v}
        return None

    def silver(self, rebuild: bool = False) -> dict[str, Any]:
        """All pending batches, then the conservation checks; an unmet one is an error."""
        if rebuild:
            for name in ("silver/trips", "silver/trips_rejected", "ops/ledger"):
                self.folder.delete(name)
        done = [self.process(b, v)["batch_id"] for b, v in self.pending()]
        summary = self.summary() | {"processed": done}
        off = [k for k, ok in summary["checks"].items() if not ok]
        if off:
            raise RuntimeError(f"checks failed: {off}")
        return summary

    def summary(self) -> dict[str, Any]:
        log = [r.asDict() for r in self.ledger.read().orderBy("landed_version").collect()]
        total = {k: sum(e[k] for e in log) for k in ("landed_rows", "accepted_rows", "rejected_rows", "inserted", "updated", "noop")}
        trips, rejected = self.trips.read(), self.rejected.read()
        t = trips.agg(F.count("*").alias("n"), F.count_if("is_late_arrival").alias("late")).first()
        # hashes tell which keys may come twice; few do, and only those are compared
        hashed = trips.select("trip_key", F.xxhash64("trip_key").alias("_h"))
        with own_shuffles(self.spark):
            again = hashed.groupBy("_h").count().filter("count > 1").select("_h")
            unique = hashed.join(again, "_h", "left_semi").groupBy("trip_key").count().filter("count > 1").limit(1).count() == 0
        r = rejected.agg(F.count("*").alias("n"), F.count_if(F.col("reject_reason").isNull()).alias("bare")).first()
        landed = sum(f.rows for f in self.landed.files())
        checks = {
            "all landed rows were processed": total["landed_rows"] == landed,
            "landed = rejected + inserted + updated + noop": total["landed_rows"] == sum(total[k] for k in ("rejected_rows", "inserted", "updated", "noop")),
            "trips = inserted": t["n"] == total["inserted"],
            "quarantine = rejected": r["n"] == total["rejected_rows"],
            "keys are unique": unique,
            "every rejected row has a reason": r["bare"] == 0,
        }
        return {"totals": total, "trips": t["n"], "rejected": r["n"], "landed": landed, "late_arrivals": t["late"], "version": self.trips.version(), "batches": log, "checks": checks}

    def cdc(self, updates: int = 25, inserts: int = 5, seed: int = 42, month: str | None = None) -> dict[str, Any]:
        """Land a correction feed made from real trips and let the ordinary path apply it; running it again does nothing."""
        batch_id = f"cdc_corrections_seed{seed}"
        if batch_id in self._done():
            return {"batch_id": batch_id, "already_applied": True}
        month = month or max(r["source_month"] for r in self.ledger.read().collect() if not r["batch_id"].startswith("cdc_"))
        before = self.trips.version()
        feed = correction_feed(self.trips.read(before), seed, updates, inserts, month)
        name = f"raw/cdc/{batch_id}"
        self.folder.delete(name)
        feed.coalesce(1).write.parquet(f"{self.folder.root}/{name}")
        feed = self.spark.read.parquet(f"{self.folder.root}/{name}")
        n = feed.count()
        if n != updates + inserts:
            raise RuntimeError(f"the feed has {n} rows, {updates + inserts} are needed; too few trips of {month} are eligible")
        digest = readers.fingerprints(self.spark, f"{self.folder.root}/{name}/*.parquet").first()["sha256"]
        self.land(feed, batch_id, month, f"synthetic://{batch_id}", digest, n)
        self.silver()
        entry = self.ledger.read().filter(F.col("batch_id") == batch_id).first().asDict()
        corrected = self.trips.read().filter(F.col("_batch_id") == batch_id).select("trip_key")
        cols = ["trip_key", "fare_amount", "tip_amount", "total_amount", "_batch_id"]
        samples = self.trips.diff(before, self.trips.version(), ["trip_key"], cols[1:]).join(corrected, "trip_key", "left_semi").orderBy("trip_key").limit(5).collect()
        checks = {"updated": entry["updated"] == updates, "inserted": entry["inserted"] == inserts, "nothing else changed": entry["noop"] == 0}
        if not all(checks.values()):
            raise RuntimeError(f"the correction feed was applied wrongly: {entry}")
        return {"batch_id": batch_id, "month": month, "version_before": before, "version_after": entry["trips_version"], "updated": entry["updated"], "inserted": entry["inserted"], "checks": checks, "samples": [r.asDict(True) for r in samples]}

    def evolution(self, column: str = "cbd_congestion_fee") -> dict[str, Any]:
        """Proof that a column joined the trips table without a rewrite: when, its nulls by month, and those of all rows that
        batches had accepted, also of rows that later ones replaced (none if a batch went through before they were counted)."""
        changes = self.trips.schema_changes()
        at = next((c["version"] for c in changes if column in c.get("added", c.get("columns", []))), None)
        if at is None:
            return {"column": column, "present": False}
        commit = self.trips.describe_commit(at)
        nulls = profile.null_census(self.trips.read(), ["pickup_month"], [column]).orderBy("pickup_month").collect()
        before = at > 0 and column not in self.trips.schema(at - 1).names
        return {"column": column, "present": True, "version": at, "absent_before": before, "operation": commit["operation"], "changes": changes, "by_month": [r.asDict() for r in nulls], "accepted_by_month": self._accepted(column)}

    def _accepted(self, column: str) -> list[dict[str, Any]] | None:
        """Rows that batches had accepted and nulls of a column in them, by month, from the ledger."""
        total: dict[str, list[int]] = {}
        if "accepted" not in self.ledger.schema().names:
            return None
        for r in self.ledger.read().select("accepted").collect():
            if r["accepted"] is None:
                return None
            for month, told in json.loads(r["accepted"]).items():
                at = total.setdefault(month, [0, 0])
                at[0] += told["rows"]
                at[1] += told["nulls"].get(column, told["rows"])
        return [{"pickup_month": m, "rows": n, f"null__{column}": nulls} for m, (n, nulls) in sorted(total.items())]

    def time_travel(self, vacuum_copy: bool = True) -> dict[str, Any]:
        """Rows of every version, the last change, and (on a copy) what vacuuming everything breaks."""
        census = self.trips.census()
        last = self.trips.version()
        changed = self.trips.diff(last - 1, last, ["trip_key"], ["row_hash"]).groupBy("change").count().collect() if last > 0 else []
        out = {"census": census, "last_change": {r["change"]: r["count"] for r in changed}, "commit": render_commit(self.trips.describe_commit(last))}
        if vacuum_copy:
            copy = self.copy("silver/trips", "scratch/vacuum")
            listed = copy.vacuum(0, dry_run=True)
            copy.vacuum(0, unsafe=True)
            out["vacuum"] = {"files": len(listed), "broken_versions": [v for v in copy.log.versions() if not copy.readable(v)]}
            self.folder.delete("scratch/vacuum")
        return out

    def copy(self, name: str, to: str) -> VersionedTable:
        self.folder.delete(to)
        jvm = self.spark.sparkContext._jvm
        jvm.org.apache.hadoop.fs.FileUtil.copy(self.folder.fs, self.folder.path(name), self.folder.fs, self.folder.path(to), False, self.folder.conf)
        return self.table(to)

    def profiled(self) -> dict[str, Any]:
        df = self.landed.read()
        month, across, twins = profile.keys(df)
        reasons, flags = profile.rule_preview(df, self.limits)
        tables = {"values": profile.values(df, self.limits), "keys": month, "keys_across": across, "reversals": twins, "reasons": reasons, "flags": flags} | {c: profile.distribution(df, c) for c in ("payment_type", "VendorID", "RatecodeID")}
        found = {name: [r.asDict() for r in t.collect()] for name, t in tables.items()}
        self.report("profile", found)
        return found

    def diagnose(self) -> dict[str, Any]:
        """Why unusual numbers look as they do: gaps of totals, trips without duration, negative fares, blocks of nulls."""
        df = self.landed.read()
        tables = {
            "gaps": profile.gaps_by_month(df), "common_gaps": profile.common_gaps(df), "common_gaps_by_year": profile.common_gaps_by_year(df),
            "zero_durations": profile.zero_durations(df), "negative_fares": profile.negative_fares(df), "null_blocks": profile.null_blocks(df),
        }
        found = {name: [r.asDict() for r in t.collect()] for name, t in tables.items()}
        self.report("findings", found)
        return found

    def gold(self, months: list[str] | None = None) -> dict[str, Any]:
        """The four marts from one pinned version, checked against SQL over the same version."""
        version = self.trips.version()
        trips, zones = self.trips.read(version), self.zones.read()
        months = months or sorted({r["source_month"] for r in self.ledger.read().collect()})
        base = marts.mart_base(trips, zones, months)
        out = {"version": version, "months": months}
        for name, df in (("gold/zone_hourly_metrics", marts.zone_hourly(base)), ("gold/cbd_flow_monthly", marts.cbd_monthly(base))):
            self.table(name).overwrite(df)
        self.table("gold/cbd_flow_yoy").overwrite(marts.cbd_yoy(self.table("gold/cbd_flow_monthly").read()))
        self.table("gold/dq_monthly").overwrite(marts.dq_monthly(self.landed.read(), trips, self.rejected.read()))
        for name in ("zone_hourly_metrics", "cbd_flow_monthly", "cbd_flow_yoy", "dq_monthly"):
            out[name] = self.table(f"gold/{name}").detail()["rows"]
        out["verdicts"] = {r["verdict"]: r["count"] for r in marts.verdicts(trips, zones).groupBy("verdict").count().collect()}
        out["check"] = marts.check_against_sql(self.spark, self.table("gold/zone_hourly_metrics").read(), trips, months)
        busiest = self.table("gold/zone_hourly_metrics").read().orderBy(F.desc("trips"), "pickup_date", "pickup_hour", "PULocationID").limit(10)
        tables = {"Busiest hours": busiest, "By month and flow": self.table("gold/cbd_flow_monthly").read().orderBy("pickup_month", "policy_period", "cbd_flow"), "Year over year": self.table("gold/cbd_flow_yoy").read().orderBy("year", "month_of_year", "cbd_flow")}
        tables |= {"Data quality": self.table("gold/dq_monthly").read().orderBy("_source_month", "outcome", "rule"), "Cells against SQL": out["check"]["cells"], "Totals against SQL": [out["check"]["totals"]]}
        self.report("gold", tables)
        if not out["check"]["agrees"]:
            raise RuntimeError(f"a mart differs from SQL: {out['check']}")
        return out

    def reconcile_external(self, path: str, months: list[str]) -> dict[str, Any]:
        """Pickups by zone and month against a published CSV, whose columns are found by keyword; skipped if they aren't."""
        table = readers.csv_text(self.spark, path)
        find = readers.find_column
        month, kind, zone, n = (find(table.columns, *c) for c in ((("month",), ("date",)), (("industry",), ("license",)), (("location", "id"), ("zone", "id")), (("pickup",),)))
        if not all((month, kind, zone, n)):
            return {"status": "SKIPPED", "header": table.columns}
        theirs = table.filter(F.lower(named(kind)).contains("yellow")).select(
            F.substring(named(month), 1, 7).alias("pickup_month"), named(zone).try_cast("int").alias("zone"), F.regexp_replace(named(n), ",", "").try_cast("long").alias("n")
        )
        ours = self.landed.read().filter(~F.col("_batch_id").startswith("cdc_")).groupBy(F.date_format("tpep_pickup_datetime", "yyyy-MM").alias("pickup_month"), F.col("PULocationID").cast("int").alias("zone")).agg(F.count("*").alias("n"))
        both = marts.reconcile(ours, theirs, ["pickup_month", "zone"], "pickup_month").filter(F.col("pickup_month").isin(months)).orderBy("pickup_month").collect()
        return {"status": "DONE", "columns": [month, kind, zone, n], "per_month": [r.asDict() for r in both], "within_1pct": all(r["within"] for r in both)}

    # ---- fixture lane ----

    def fixture(self, batches: dict[str, DataFrame], expected: dict[str, int] | None = None) -> dict[str, Any]:
        """Land fixture batches (once each), rebuild both outputs as snapshots; counts are checked before anything is written."""
        landed = self.table("fixture/bronze")
        for batch_id, df in batches.items():
            if landed.exists() and batch_id in landed.batches():
                continue
            rows = df.withColumns({"_ingest_ts": F.current_timestamp(), "_source_file": F.lit(f"{batch_id}.jsonl"), "_batch_id": F.lit(batch_id)})
            told = {"batch_id": batch_id}
            landed.append(rows, evolve=True, user_metadata=told) if landed.exists() else landed.create(rows, user_metadata=told)
        version = landed.version()
        df = landed.read(version)
        bare = df.filter(" or ".join(f"{c} is null or cast({c} as string) = ''" for c in fixture.LINEAGE)).limit(1).count()
        if bare:
            raise ValueError("rows lack lineage")
        judged = fixture.judge(df).persist()
        try:
            counts = {r["reject_reason"]: r["count"] for r in judged.groupBy("reject_reason").count().collect()}
            good = counts.pop(None, 0)
            found = counts | {"raw_rows": good + sum(counts.values()), "expected_silver_rows": good, "expected_rejected_rows": sum(counts.values())}
            if found["raw_rows"] != landed.detail()["rows"]:
                raise RuntimeError("rows aren't conserved")
            if expected:
                fixture.check_manifest(found, expected)
            accepted, rejected = fixture.split(judged)
            for name, rows in (("fixture/silver", accepted), ("fixture/rejected", rejected)):
                self.table(name).overwrite(rows)
        finally:
            judged.unpersist()
        return found | {"bronze_version": version}

    # ---- runner ----

    def run(self, steps: list[str], do: dict[str, Callable[[], Any]]) -> dict[str, Any]:
        """Steps in order with times; the first failure stops the run and is kept in the status."""
        status: dict[str, Any] = {"steps": [], "ok": True}
        for name in steps:
            began = time.time()
            try:
                result = do[name]()
                status["steps"].append({"step": name, "ok": True, "seconds": round(time.time() - began, 2)})
                self.evidence(name, result)
            except Exception as e:
                status["steps"].append({"step": name, "ok": False, "seconds": round(time.time() - began, 2), "error": f"{type(e).__name__}: {e}"[:2000]})
                status["ok"] = False
                break
        self.evidence("status", status)
        return status


def correction_feed(trips: DataFrame, seed: int, updates: int, inserts: int, month: str) -> DataFrame:
    """Corrections of real trips in landing types: card trips of a month's first 27 days without flags, in a seeded order.

    The first `updates` of them get 2.00 more tip, every second one 1.50 more fare, and totals that follow; the next
    `inserts` come 3 minutes later, which makes them new trips.
    """
    cols = [c for c in TRIPS.landing if c in trips.columns]
    n = updates + inserts
    eligible = trips.filter(F.col("pickup_month") == month).filter("payment_type = 1 and size(dq_flags) = 0 and day(tpep_pickup_datetime) <= 27")
    order = F.sha2(F.concat_ws("|", "trip_key", F.lit(str(seed))), 256)
    first = eligible.select(*cols, order.alias("_order")).orderBy("_order").limit(n)
    # n rows in one list: their places need no window over a single partition
    placed = first.agg(F.array_sort(F.collect_list(F.struct("_order", *cols))).alias("l")).select(F.posexplode("l").alias("_at", "_r")).select("_at", "_r.*")
    fix = F.col("_at") < updates
    fare = F.when(fix & (F.col("_at") % 2 == 1), 1.50).otherwise(0.0)
    tip = F.when(fix, 2.00).otherwise(0.0)
    later = F.when(fix, F.expr("interval 0 minutes")).otherwise(F.expr("interval 3 minutes"))
    changed = {
        "fare_amount": F.round(F.col("fare_amount") + fare, 2),
        "tip_amount": F.round(F.col("tip_amount") + tip, 2),
        "total_amount": F.round(F.col("total_amount") + fare + tip, 2),
        "tpep_pickup_datetime": F.col("tpep_pickup_datetime") + later,
        "tpep_dropoff_datetime": F.col("tpep_dropoff_datetime") + later,
    }
    return placed.select(*[(changed.get(c, F.col(c))).cast(TRIPS.landing[c]).alias(c) for c in cols])


def render_table(rows: list[dict]) -> str:
    if not rows:
        return "(no rows)\n"
    head = list(rows[0])
    body = ["| " + " | ".join("" if r[h] is None else str(r[h]) for h in head) + " |" for r in rows]
    return "\n".join(["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *body]) + "\n"


def render_commit(c: dict[str, Any]) -> str:
    """One commit in Markdown."""
    lines = [f"# Version {c['version']}: {c['operation']}", "", f"Files added {c['added']}, removed {c['removed']}; schema changed: {c['schema_changed']}.", "", render_table([{"metric": k, "value": v} for k, v in sorted(c["metrics"].items())])]
    if c["first_file"]:
        f = c["first_file"]
        lines += ["", f"First file: {f['path']} ({f['rows']} rows, {f['size']} bytes)", "", render_table([{"column": k, "min": f["low"].get(k), "max": f["high"].get(k), "nulls": n} for k, n in f["nulls"].items()])]
    return "\n".join(lines)


def _month_number(month: str) -> int:
    year, number = month.split("-")
    return int(year) * 12 + int(number)


def _steps(lake: Lakehouse, reference: Callable[[], Any], bronze: Callable[[], Any]) -> dict[str, Callable[[], Any]]:
    from tidemill.plans import layouts

    return {
        "reference": reference,
        "bronze": bronze,
        "profile": lake.profiled,
        "diagnose": lake.diagnose,
        "silver": lake.silver,
        "cdc": lake.cdc,
        "evolution": lake.evolution,
        "time_travel": lake.time_travel,
        "gold": lake.gold,
        "benchmark": lambda: layouts.run(lake),
    }


def made_up(lake: Lakehouse, months: list[str], rows: int = 400) -> dict[str, Callable[[], Any]]:
    """Steps over generated trip files, for rehearsals without downloads."""
    spark = lake.spark

    def bronze():
        out = []
        for i, m in enumerate(months):
            earlier = months[i - 1] if i and _month_number(months[i - 1]) == _month_number(m) - 1 else None
            df, _ = generate.month_file(spark, m, rows, previous=earlier)
            path = f"{lake.folder.root}/raw/trips/{m}"
            lake.folder.delete(f"raw/trips/{m}")
            df.coalesce(1).write.parquet(path)
            sha = readers.fingerprints(spark, f"{path}/*.parquet").first()["sha256"]
            out.append(lake.land(readers.parquet(spark, path), f"yellow_{m}_{sha[:12]}", m, path, sha))
        return out

    return _steps(lake, lambda: lake.reference(generate.zone_lookup(spark), generate.area_members(spark)), bronze)


def delivered(lake: Lakehouse, manifest: dict[str, Any], percent: float | None = None) -> dict[str, Callable[[], Any]]:
    """Steps over files that were delivered, as a manifest names them.

    trips: for each month (yyyy-MM) the path of its Parquet file and, if known, its rows and sha256; zones and members:
    path and kind (see readers.published_table) of the zones and of the area's members, the latter or both may be absent.
    Footers and digests are compared with what the manifest says before anything lands; with percent, a sample lands.
    """
    spark = lake.spark

    def reference():
        lookup = readers.published_table(spark, manifest["zones"]["path"], manifest["zones"]["kind"])
        listed = manifest.get("members")
        members = readers.ids_of(readers.published_table(spark, listed["path"], listed["kind"]), lookup) if listed else readers.fallback_members(spark)
        return lake.reference(lookup, members)

    def bronze():
        out = []
        for month, file in sorted(manifest["trips"].items()):
            path = file["path"]
            parts = path if path.endswith(".parquet") else f"{path}/*.parquet"
            told = readers.manifest(spark, {month: path})["files"][month]
            off = {k: (file[k], told[k]) for k in ("rows", "sha256") if k in file and file[k] != told[k]}
            if off:
                raise RuntimeError(f"{path} isn't what the manifest says (said, found): {off}")
            done = lake.land(readers.parquet(spark, path, percent), f"yellow_{month}_{told['sha256'][:12]}", month, path, told["sha256"], None if percent else told["rows"])
            out.append(done | {"source": parts, "row_groups": told["row_groups"], "created_by": told["created_by"]})
        return out

    return _steps(lake, reference, bronze)
