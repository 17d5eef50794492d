"""Times headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import functions as F

from tidemill.functions.session import session
from tidemill.operators import marts
from tidemill.plans import catalogue, layouts, trip_queries  # noqa: F401  the last registers its queries
from tidemill.sources.versioned import VersionedTable

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
ROUNDS = 5
HEADLINE = ("contract_monthly_mart", "first_match_reject_reason", "duplicate_vs_collision", "reversal_pairs", "flow_classification", "zone_hourly_mart", "full_outer_reconcile", "yoy_self_join", "topk_per_group", "two_level_key_stats")
#: Queries through the trip pipeline's own operators.
TRIPS = ("trip_outcomes", "gold_zone_hourly", "gold_cbd_yoy", "profile_values", "profile_keys")


def timed(f) -> float:
    began = time.perf_counter()
    f()
    return time.perf_counter() - began


def main() -> None:
    spark = session("bench", f"local[{CPUS}]", **{"spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    found: dict[str, float] = {}
    for name in HEADLINE:
        run = lambda n=name: catalogue.QUERIES[n](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        run()
        found[name] = statistics.median(timed(run) for _ in range(3))

    # merge: create, plan and merge a feed
    orders = catalogue._orders(spark, SF_DIR)
    at = catalogue.scratch(spark, SF_DIR)
    for i in range(2):
        t = VersionedTable(spark, f"{at}/merge-{i}")
        t.create(orders.repartition(8, "o_orderkey"))
        found["merge"] = timed(lambda t=t: t.merge(catalogue._feed(orders), ["o_orderkey"], "hash"))

    # the same with eight times the rows, a fiftieth of which change: what a merge copies in a second
    wide = orders.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("o_orderkey", F.col("o_orderkey") * 8 + F.col("_i")).drop("_i")
    more: dict[str, float] = {}
    t = VersionedTable(spark, f"{at}/merge-wide")
    t.create(wide.repartition(16, "o_orderkey"))
    feed = wide.filter("o_orderkey % 50 = 0").withColumns({"o_totalprice": F.col("o_totalprice") + 2, "hash": F.lit("new")})
    done = {}
    more["merge_wide"] = timed(lambda: done.update(t.merge(feed, ["o_orderkey"], "hash")))
    more["merge_wide_rows_copied_per_s"] = done["copied"] / more["merge_wide"]
    for name in TRIPS:
        run = lambda n=name: catalogue.QUERIES[n](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        run()
        more[name] = statistics.median(timed(run) for _ in range(3))

    # layouts: the same lines in four layouts, three queries, interleaved
    lines = catalogue.table(spark, SF_DIR, "lineitem")
    tables, files = {}, {}
    for name, by in (("baseline", None), ("compacted", []), ("range_1col", ["l_suppkey"]), ("zorder_2col", ["l_suppkey", "l_shipdate"])):
        t = VersionedTable(spark, f"{at}/{name}")
        t.create(lines.repartition(48))
        if by is not None:
            t.optimize(1 << 20, by=by)
        tables[name] = t
    queries = {"q1_key": [("l_suppkey", "=", 132)], "q2_key_week": [("l_suppkey", "=", 132), *catalogue.YEAR], "q3_control": [("l_returnflag", "=", "R")]}
    times: dict[str, list[float]] = {}
    for i in range(ROUNDS + 1):
        for q, where in queries.items():
            for name, t in tables.items():
                df = marts.measured(t.read(where=where), [], catalogue.SUMMARY)
                s = timed(df.collect)
                if i:
                    times.setdefault(f"{q}_{name}", []).append(s)
                    files[f"{q}_{name}"] = layouts.scan_metrics(df)["files"]
    found |= {k: statistics.median(v) for k, v in times.items()}
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(found.values()), 3), "unit": "sec", "queries": {k: round(v, 4) for k, v in found.items()}, "more": {k: round(v, 4) for k, v in more.items()}, "files_read": files, "sf": os.path.basename(SF_DIR)}))


if __name__ == "__main__":
    main()
