"""Named queries over the driver's tables, each with the SQL that must give the same rows.

Order lines stand for trips: ordered is picked up, shipped is dropped off; suppliers' and customers' nations are zones.
Money is summed as decimals, so that sums don't depend on the order of rows.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.functions.contract import TIME_FORMAT
from tidemill.functions.expressions import digest_of, sample_by_digest, settle, share, strict_time
from tidemill.operators import marts, profile
from tidemill.operators.rules import Rule, all_matches, first_match
from tidemill.plans import layouts
from tidemill.sources import readers
from tidemill.sources.versioned import VersionedTable
from tidemill.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with its SQL."""

    def register(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql.strip()
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")


def total(c: str | Column) -> Column:
    """Exact sum of an amount, as a double."""
    return F.sum(money(c)).cast("double")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their orders."""
    return table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))


LINES = "lineitem JOIN orders ON l_orderkey = o_orderkey"
D = "CAST({} AS DECIMAL(18,2))"


# ---- scans, casts, parsing ----


@query(
    "scan_project_cast",
    """SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 7 = 0 THEN 'bad' WHEN o_orderkey % 11 = 0 THEN '2147483648' ELSE CAST(o_custkey AS VARCHAR) END AS INTEGER) AS custkey,
  CAST(o_orderdate AS DATE) AS day, o_orderstatus FROM orders WHERE o_totalprice > 1000""",
)
def scan_project_cast(spark, d):
    text = F.when(F.col("o_orderkey") % 7 == 0, "bad").when(F.col("o_orderkey") % 11 == 0, "2147483648").otherwise(F.col("o_custkey").cast("string"))
    rows = table(spark, d, "orders").filter("o_totalprice > 1000").withColumn("_t", text)
    return rows.select("o_orderkey", settle(F.col("_t"), rows.schema["_t"].dataType, "int").alias("custkey"), F.to_date("o_orderdate").alias("day"), "o_orderstatus")


@query(
    "strict_timestamp_parse",
    """WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 2 THEN '2025-02-30 12:00:00'
  WHEN 3 THEN 'not-a-date' ELSE '' END AS txt FROM events)
SELECT event_id, txt, CASE WHEN regexp_full_match(txt, '\\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}:\\d{2}') THEN try_strptime(txt, '%Y-%m-%d %H:%M:%S') END AS parsed FROM t""",
)
def strict_timestamp_parse(spark, d):
    k = F.col("event_id") % 5
    text = F.when(k == 0, F.date_format("ts", TIME_FORMAT)).when(k == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).when(k == 2, "2025-02-30 12:00:00").when(k == 3, "not-a-date").otherwise("")
    rows = table(spark, d, "events").select("event_id", text.alias("txt"))
    return rows.withColumn("parsed", strict_time(F.col("txt"), rows.schema["txt"].dataType).cast("timestamp_ntz"))


@query("csv_json_roundtrip", "SELECT n_nationkey, n_name, n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def csv_json_roundtrip(spark, d):
    at = scratch(spark, d)
    table(spark, d, "nation").write.option("header", True).csv(f"{at}/nation")
    table(spark, d, "region").write.json(f"{at}/region")
    left = readers.csv_text(spark, f"{at}/nation").select(*[F.col(c).try_cast(t).alias(c) for c, t in (("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int"))])
    right = readers.json_lines(spark, f"{at}/region", "r_regionkey int, r_name string")
    return left.join(marts.small(right), F.col("n_regionkey") == F.col("r_regionkey")).drop("r_regionkey")


@query("file_census", "SELECT CAST(count(*) AS BIGINT) AS rows FROM orders")
def file_census(spark, d):
    return readers.file_rows(spark, f"{d}/orders.parquet").agg(F.sum("rows").alias("rows"))


@query("digest_sample", "SELECT o_orderkey FROM orders WHERE substr(sha256(CAST(o_orderkey AS VARCHAR) || '|42'), 1, 1) = '0'")
def digest_sample(spark, d):
    return table(spark, d, "orders").filter(F.substring(digest_of([F.col("o_orderkey").cast("string"), F.lit("42")]), 1, 1) == "0").select("o_orderkey")


@query("hash_sample_rows", "SELECT true AS near_a_twentieth, true AS same_again, true AS in_a_larger_one")
def hash_sample_rows(spark, d):
    """The hash isn't known to other systems, so the sample is known by what holds of it."""
    o = table(spark, d, "orders")
    small, again, large = (sample_by_digest(o, p).select("o_orderkey", F.lit(1).alias(n)) for p, n in ((5, "s"), (5, "a"), (20, "l")))
    both = o.select("o_orderkey").join(small, "o_orderkey", "left").join(again, "o_orderkey", "left").join(large, "o_orderkey", "left")
    size, share_ = F.count("*"), F.count("s") / F.count("*")
    return both.agg((F.abs(share_ - 0.05) < 0.01 + 1 / F.sqrt(size)).alias("near_a_twentieth"), (F.count_if(~F.col("s").eqNullSafe(F.col("a"))) == 0).alias("same_again"), (F.count_if(F.col("s").isNotNull() & F.col("l").isNull()) == 0).alias("in_a_larger_one"))


# ---- rules ----

LINE_RULES = [
    Rule("MISSING_DATE", ("l_shipdate",), lambda v: v("l_shipdate").isNull()),
    Rule("INVALID_AMOUNT", ("l_extendedprice",), lambda v: v("l_extendedprice").isNull() | (v("l_extendedprice") <= 1000)),
    Rule("NEGATIVE_DURATION", ("l_shipdate", "o_orderdate"), lambda v: v("l_shipdate") < v("o_orderdate")),
    Rule("OUT_OF_PERIOD", ("o_orderdate",), lambda v: v("o_orderdate") < F.lit("1993-01-01").cast("timestamp_ntz")),
]
FLAG_RULES = [
    Rule("LATE", ("l_shipdate",), lambda v: v("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")),
    Rule("LARGE", ("l_quantity",), lambda v: v("l_quantity") > 45),
    Rule("DISCOUNTED", ("l_discount",), lambda v: v("l_discount") >= 0.08),
    Rule("ABSENT_COLUMN", ("no_such_column",), lambda v: v("no_such_column").isNull()),
]
LINE_REASON_SQL = """CASE WHEN l_shipdate IS NULL THEN 'MISSING_DATE' WHEN l_extendedprice IS NULL OR l_extendedprice <= 1000 THEN 'INVALID_AMOUNT'
  WHEN l_shipdate < o_orderdate THEN 'NEGATIVE_DURATION' WHEN o_orderdate < TIMESTAMP '1993-01-01' THEN 'OUT_OF_PERIOD' END"""


@query("first_match_reject_reason", f"SELECT {LINE_REASON_SQL} AS reason, count(*) AS n, CAST(sum({D.format('l_extendedprice')}) AS DOUBLE) AS amount FROM {LINES} GROUP BY 1")
def first_match_reject_reason(spark, d):
    rows = lines(spark, d)
    return rows.groupBy(first_match(LINE_RULES, F.col, rows.columns).alias("reason")).agg(F.count("*").alias("n"), total("l_extendedprice").alias("amount"))


@query(
    "soft_flags_array",
    f"""WITH f AS (SELECT unnest(list_filter([CASE WHEN l_shipdate >= TIMESTAMP '1998-01-01' THEN 'LATE' END, CASE WHEN l_quantity > 45 THEN 'LARGE' END, CASE WHEN l_discount >= 0.08 THEN 'DISCOUNTED' END],
  lambda x: x IS NOT NULL)) AS flag, l_returnflag FROM {LINES}) SELECT flag, l_returnflag, count(*) AS n FROM f GROUP BY 1, 2""",
)
def soft_flags_array(spark, d):
    rows = lines(spark, d)
    return rows.select(F.explode(all_matches(FLAG_RULES, F.col, rows.columns)).alias("flag"), "l_returnflag").groupBy("flag", "l_returnflag").agg(F.count("*").alias("n"))


@query(
    "total_range_check",
    """SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE NOT (billed BETWEEN low - 0.05 AND high + 0.05)) AS outside FROM (
  SELECT l_returnflag, l_extendedprice * (1 + CASE WHEN l_linenumber = 1 THEN l_tax ELSE 0 END - CASE WHEN l_linenumber = 2 THEN 0.2 ELSE 0 END) AS billed,
    least(l_extendedprice, l_extendedprice * (1 - l_discount)) AS low, greatest(l_extendedprice, l_extendedprice * (1 - l_discount)) AS high FROM lineitem) GROUP BY 1""",
)
def total_range_check(spark, d):
    price = F.col("l_extendedprice")
    billed = price * (1 + F.when(F.col("l_linenumber") == 1, F.col("l_tax")).otherwise(0) - F.when(F.col("l_linenumber") == 2, 0.2).otherwise(0))
    low, high = F.least(price, price * (1 - F.col("l_discount"))), F.greatest(price, price * (1 - F.col("l_discount")))
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(~billed.between(low - 0.05, high + 0.05)).alias("outside"))


# ---- keys, duplicates, sets ----


LINE_HASH = "sha256(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey % 3 AS VARCHAR)))"


def _hashed_lines(spark, d):
    return table(spark, d, "lineitem").withColumn("hash", digest_of([F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), (F.col("l_partkey") % 3).cast("string")]))


@query("dedup_first_by_hash", f"SELECT l_orderkey, l_linenumber, min({LINE_HASH}) AS hash, count(*) AS copies FROM lineitem GROUP BY 1, 2")
def dedup_first_by_hash(spark, d):
    key = Window.partitionBy("l_orderkey", "l_linenumber")
    rows = _hashed_lines(spark, d).withColumns({"_n": F.row_number().over(key.orderBy("hash", "l_partkey", "l_suppkey")), "copies": F.count("*").over(key)})
    return rows.filter("_n = 1").select("l_orderkey", "l_linenumber", "hash", "copies")


@query(
    "duplicate_vs_collision",
    f"""SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN rn = 1 THEN 'KEPT' WHEN h = f THEN 'DUPLICATE' ELSE 'COLLISION' END AS verdict FROM (
  SELECT h, row_number() OVER w AS rn, first_value(h) OVER w AS f FROM (SELECT *, {LINE_HASH} AS h FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY h))) GROUP BY 1""",
)
def duplicate_vs_collision(spark, d):
    same = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("hash")
    verdict = F.when(F.col("_n") == 1, "KEPT").when(F.col("hash") == F.col("_f"), "DUPLICATE").otherwise("COLLISION")
    rows = _hashed_lines(spark, d).withColumns({"_n": F.row_number().over(same), "_f": F.first("hash").over(same)})
    return rows.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query(
    "reversal_pairs",
    """WITH kept AS (SELECT l_orderkey, l_linenumber, max(l_extendedprice) AS fare FROM lineitem GROUP BY 1, 2),
neg AS (SELECT l_orderkey, l_linenumber, -l_extendedprice AS fare FROM lineitem WHERE l_suppkey % 5 = 0)
SELECT n.l_orderkey, n.l_linenumber, n.fare, CASE WHEN abs(abs(n.fare) - k.fare) < 0.005 THEN 'REVERSAL' ELSE 'UNPAIRED' END AS detail FROM neg n LEFT JOIN kept k USING (l_orderkey, l_linenumber)""",
)
def reversal_pairs(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_extendedprice").alias("fare"))
    both = rows.withColumn("minus", F.lit(False)).unionByName(rows.filter("l_suppkey % 5 = 0").withColumns({"fare": -F.col("fare"), "minus": F.lit(True)}))
    kept = F.max(F.when(~F.col("minus"), F.col("fare"))).over(Window.partitionBy("l_orderkey", "l_linenumber"))
    detail = F.when(F.abs(F.abs("fare") - F.col("_kept")) < 0.005, "REVERSAL").otherwise("UNPAIRED")
    return both.withColumn("_kept", kept).filter("minus").select("l_orderkey", "l_linenumber", "fare", detail.alias("detail"))


@query("multiset_difference", "SELECT o_orderpriority, o_orderstatus FROM orders EXCEPT ALL SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders")
def multiset_difference(spark, d):
    rows = table(spark, d, "orders").select("o_orderpriority", "o_orderstatus")
    return rows.exceptAll(rows.distinct())


@query("union_by_name_missing", "SELECT 'c' AS kind, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 's', s_name, s_acctbal, NULL FROM supplier")
def union_by_name_missing(spark, d):
    c = table(spark, d, "customer").select(F.lit("c").alias("kind"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"), F.lit("s").alias("kind"))
    return c.unionByName(s, allowMissingColumns=True)


@query("distinct_and_counts", "SELECT count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts, count(*) AS n FROM lineitem")
def distinct_and_counts(spark, d):
    return table(spark, d, "lineitem").agg(F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct("l_partkey").alias("parts"), F.count("*").alias("n"))


# ---- joins ----


@query(
    "broadcast_dim_left",
    "SELECT r_name, n_name, count(c_custkey) AS customers, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
)
def broadcast_dim_left(spark, d):
    dim = marts.small(table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left"))
    rows = table(spark, d, "customer").join(dim, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.groupBy("r_name", "n_name").agg(F.count("c_custkey").alias("customers"), total("c_acctbal").alias("balance"))


@query(
    "full_outer_reconcile",
    """WITH a AS (SELECT strftime(o_orderdate, '%Y') AS y, o_orderkey AS k, 1 AS n FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT strftime(o_orderdate, '%Y') AS y, o_orderkey AS k, 1 AS n FROM orders WHERE o_orderkey % 4 <> 0),
j AS (SELECT coalesce(a.y, b.y) AS y, coalesce(a.n, 0) AS ours, coalesce(b.n, 0) AS theirs FROM a FULL JOIN b ON a.y = b.y AND a.k = b.k)
SELECT y, CAST(sum(ours) AS BIGINT) AS ours, CAST(sum(theirs) AS BIGINT) AS theirs, abs(sum(ours) / nullif(sum(theirs), 0) - 1) * 100 <= 10 AS within FROM j GROUP BY 1""",
)
def full_outer_reconcile(spark, d):
    rows = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy").alias("y"), F.col("o_orderkey").alias("k"), F.lit(1).alias("n"))
    return marts.reconcile(rows.filter("k % 3 <> 0"), rows.filter("k % 4 <> 0"), ["y", "k"], "y", slack_pct=10).drop("diff_pct")


@query(
    "null_safe_diff",
    """WITH a AS (SELECT o_orderkey AS k, nullif(o_orderstatus, 'P') AS s FROM orders WHERE o_orderkey % 10 <> 1), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE nullif(o_orderstatus, 'P') END AS s FROM orders WHERE o_orderkey % 10 <> 2)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.s IS DISTINCT FROM b.s""",
)
def null_safe_diff(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("s"))
    a = o.filter("k % 10 <> 1").select("k", F.struct("s").alias("a"))
    b = o.filter("k % 10 <> 2").select("k", F.struct(F.when(F.col("k") % 7 != 0, F.col("s")).alias("s")).alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return a.join(b, "k", "full_outer").select("k", change.alias("change")).filter("change is not null")


@query("join_merge_hint", f"SELECT o_orderpriority, count(*) AS n FROM {LINES} GROUP BY 1")
def join_merge_hint(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority").hint("merge")
    return table(spark, d, "lineitem").select("l_orderkey").join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("semi_anti_keys", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS active FROM customer")
def semi_anti_keys(spark, d):
    c, o = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").withColumn("active", F.lit(True)).unionByName(c.join(o, "c_custkey", "left_anti").withColumn("active", F.lit(False)))


# ---- aggregates ----

YEARLY = "SELECT year(o_orderdate) AS y, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1, 2"


@query("yoy_self_join", f"WITH m AS ({YEARLY}) SELECT CAST(a.y AS INTEGER) AS y, a.p, a.n, b.n AS before, a.n / b.n AS ratio FROM m a JOIN m b ON a.p = b.p AND a.y = b.y + 1")
def yoy_self_join(spark, d):
    m = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y"), F.col("o_orderpriority").alias("p")).agg(F.count("*").alias("n"))
    before = m.select((F.col("y") + 1).alias("y"), "p", F.col("n").alias("before"))
    return m.join(before, ["y", "p"]).withColumn("ratio", share(F.col("n"), F.col("before")))


@query("relative_to_baseline", f"WITH m AS ({YEARLY}) SELECT CAST(m.y AS INTEGER) AS y, m.p, m.n - b.n AS beyond FROM m LEFT JOIN (SELECT y, n FROM m WHERE p = '1-URGENT') b ON m.y = b.y")
def relative_to_baseline(spark, d):
    m = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y"), F.col("o_orderpriority").alias("p")).agg(F.count("*").alias("n"))
    base = m.filter("p = '1-URGENT'").select("y", F.col("n").alias("b"))
    return m.join(base, "y", "left").select("y", "p", (F.col("n") - F.col("b")).alias("beyond"))


@query(
    "zone_hourly_mart",
    """SELECT CAST(ts AS DATE) AS day, CAST(hour(ts) AS INTEGER) AS hour, event_type, count(*) AS n, count(DISTINCT user_id) AS users, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS value FROM events GROUP BY 1, 2, 3""",
)
def zone_hourly_mart(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.to_date("ts").alias("day"), F.hour("ts").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("value"))


@query("windowed_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_counts(spark, d):
    return ingest.windowed_counts(table(spark, d, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query(
    "flow_classification",
    """SELECT CASE WHEN n1.n_nationkey IS NULL OR n2.n_nationkey IS NULL OR n1.n_nationkey = 24 OR n2.n_nationkey = 24 THEN 'UNKNOWN_ZONE' WHEN n1.n_regionkey = 3 AND n2.n_regionkey = 3 THEN 'WITHIN_CBD'
  WHEN n2.n_regionkey = 3 THEN 'INTO_CBD' WHEN n1.n_regionkey = 3 THEN 'OUT_OF_CBD' ELSE 'NON_CBD' END AS flow, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
LEFT JOIN nation n1 ON s_nationkey = n1.n_nationkey LEFT JOIN nation n2 ON c_nationkey = n2.n_nationkey GROUP BY 1""",
)
def flow_classification(spark, d):
    nation = table(spark, d, "nation").select("n_nationkey", (F.col("n_regionkey") == 3).alias("inside"), (F.col("n_nationkey") == 24).alias("unknown"))

    def side(tag: str) -> DataFrame:
        return marts.small(nation.select(*[F.col(c).alias(f"{tag}_{c}") for c in nation.columns]))

    rows = lines(spark, d).select("o_custkey", "l_suppkey").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.join(side("f"), F.col("s_nationkey") == F.col("f_n_nationkey"), "left").join(side("t"), F.col("c_nationkey") == F.col("t_n_nationkey"), "left")
    return rows.groupBy(marts.flow("f_inside", "t_inside", "f_unknown", "t_unknown", F.lit(True)).alias("flow")).agg(F.count("*").alias("n"))


@query(
    "period_days",
    """SELECT DISTINCT m AS pickup_month, p AS policy_period, CAST(CASE WHEN p = 'post_policy' THEN date_diff('day', greatest(f, least(e, DATE '1995-01-05')), e) ELSE date_diff('day', f, greatest(f, least(e, DATE '1995-01-05'))) END AS INTEGER) AS days
FROM (SELECT strftime(o_orderdate, '%Y-%m') AS m, CAST(date_trunc('month', o_orderdate) AS DATE) AS f, CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE) AS e,
  CASE WHEN CAST(o_orderdate AS DATE) < DATE '1995-01-05' THEN 'pre_policy' ELSE 'post_policy' END AS p FROM orders)""",
)
def period_days(spark, d):
    period = F.when(F.to_date("o_orderdate") < F.lit("1995-01-05").cast("date"), "pre_policy").otherwise("post_policy")
    rows = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("pickup_month"), period.alias("policy_period")).distinct()
    return rows.withColumn("days", marts.period_days(policy_start="1995-01-05"))


@query(
    "monthly_flow_mart",
    f"""SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderstatus AS flow, count(*) AS trips, CAST(sum({D.format('l_extendedprice')}) AS DOUBLE) / count(*) AS avg_fare,
  CAST(count(*) FILTER (WHERE l_discount > 0) AS DOUBLE) / count(*) AS share_discounted FROM {LINES} GROUP BY 1, 2""",
)
def monthly_flow_mart(spark, d):
    rows = lines(spark, d).groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderstatus").alias("flow"))
    return rows.agg(F.count("*").alias("trips"), (total("l_extendedprice") / F.count("*")).alias("avg_fare"), share(F.count_if(F.col("l_discount") > 0), F.count("*")).alias("share_discounted"))


@query("weighted_reaggregation", f"WITH m AS ({YEARLY}) SELECT p, CAST(sum(n * y) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS mean_year FROM m GROUP BY 1")
def weighted_reaggregation(spark, d):
    m = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y"), F.col("o_orderpriority").alias("p")).agg(F.count("*").alias("n"))
    return m.groupBy("p").agg(share(F.sum(F.col("n") * F.col("y")), F.sum("n")).alias("mean_year"))


@query(
    "dq_rates",
    f"""WITH r AS (SELECT strftime(o_orderdate, '%Y') AS y, {LINE_REASON_SQL} AS reason FROM {LINES}), b AS (SELECT y, count(*) AS landed FROM r GROUP BY 1)
SELECT r.y, reason, count(*) AS n, landed, CAST(count(*) AS DOUBLE) / CAST(landed AS DOUBLE) AS rate FROM r JOIN b ON r.y = b.y WHERE reason IS NOT NULL GROUP BY 1, 2, 4""",
)
def dq_rates(spark, d):
    rows = lines(spark, d)
    rows = rows.select(F.date_format("o_orderdate", "yyyy").alias("y"), first_match(LINE_RULES, F.col, rows.columns).alias("reason"))
    landed = rows.groupBy("y").agg(F.count("*").alias("landed"))
    return rows.filter("reason is not null").groupBy("y", "reason").agg(F.count("*").alias("n")).join(landed, "y").withColumn("rate", share(F.col("n"), F.col("landed")))


@query(
    "membership_verdicts",
    """SELECT user_id, n, CASE WHEN n < 20 THEN 'TOO_FEW_TRIPS' WHEN user_id % 2 = 0 AND s >= 0.25 THEN 'CONFIRMED_BY_FEES' WHEN user_id % 2 = 0 THEN 'LISTED_BUT_LOW_SHARE' WHEN s >= 0.3 THEN 'NOT_LISTED_HIGH_SHARE' ELSE 'CONSISTENT_NON_CBD' END AS verdict
FROM (SELECT user_id, count(*) AS n, avg(CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN 1.0 ELSE 0.0 END) AS s FROM events GROUP BY 1)""",
)
def membership_verdicts(spark, d):
    e = table(spark, d, "events")
    first = e.agg(F.min("event_type")).first()[0]
    trips = e.select(F.col("user_id").alias("PULocationID"), F.lit("2025-02-01").cast("date").alias("pickup_date"), F.when(F.col("event_type") == first, 0.75).otherwise(0.0).alias("cbd_congestion_fee"))
    zones = e.select(F.col("user_id").alias("LocationID")).distinct().withColumns({"zone": F.lit("z"), "borough": F.lit("b"), "is_cbd": F.col("LocationID") % 2 == 0})
    out = marts.verdicts(trips, zones, least=20, listed_from=0.25, unlisted_from=0.3)
    return out.select(F.col("PULocationID").alias("user_id"), F.col("pickups").alias("n"), "verdict")


@query("conditional_counts", "SELECT l_shipmode, n, cheap, steep FROM (SELECT l_linestatus AS l_shipmode, count(*) AS n, count(*) FILTER (WHERE l_extendedprice < 5000) AS cheap, count(*) FILTER (WHERE l_discount > 0.05) AS steep FROM lineitem GROUP BY 1)")
def conditional_counts(spark, d):
    return marts.measured(table(spark, d, "lineitem"), [F.col("l_linestatus").alias("l_shipmode")], {"n": "count(*)", "cheap": "count_if(l_extendedprice < 5000)", "steep": "count_if(l_discount > 0.05D)"})


@query("null_census", "SELECT l_returnflag, count(*) AS rows, count(*) FILTER (WHERE l_quantity > 40) AS null__q, count(*) FILTER (WHERE l_linenumber = 1) AS null__l FROM lineitem GROUP BY 1")
def null_census(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", F.when(F.col("l_quantity") <= 40, F.col("l_quantity")).alias("q"), F.nullif(F.col("l_linenumber"), F.lit(1)).alias("l"))
    return profile.null_census(rows, ["l_returnflag"], ["q", "l"])


@query(
    "two_level_key_stats",
    """WITH k AS (SELECT l_returnflag, l_orderkey, l_linenumber, count(*) AS n, count(DISTINCT l_partkey) AS c FROM lineitem GROUP BY 1, 2, 3)
SELECT l_returnflag, CAST(sum(n) AS BIGINT) AS rows, count(*) AS keys, CAST(sum(CASE WHEN n > 1 AND c = 1 THEN n - 1 ELSE 0 END) AS BIGINT) AS excess, CAST(sum(CASE WHEN c > 1 THEN 1 ELSE 0 END) AS BIGINT) AS conflicting FROM k GROUP BY 1""",
)
def two_level_key_stats(spark, d):
    k = table(spark, d, "lineitem").groupBy("l_returnflag", "l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.count_distinct("l_partkey").alias("c"))
    return marts.measured(k, ["l_returnflag"], {"rows": "sum(n)", "keys": "count(*)", "excess": "sum(if(n > 1 and c = 1, n - 1, 0))", "conflicting": "count_if(c > 1)"})


@query("exact_quantiles", "SELECT l_returnflag, quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.99) AS p99 FROM lineitem GROUP BY 1")
def exact_quantiles(spark, d):
    return marts.measured(table(spark, d, "lineitem"), ["l_returnflag"], {"p50": "percentile_disc(0.5) within group (order by l_extendedprice)", "p99": "percentile_disc(0.99) within group (order by l_extendedprice)"})


@query(
    "approx_quantiles",
    """SELECT l_returnflag, quantile_disc(l_extendedprice, 0.48) AS low, quantile_disc(l_extendedprice, 0.52) AS high, quantile_disc(l_extendedprice, 0.48) FILTER (WHERE l_discount > 0.05) AS cheap_low,
  quantile_disc(l_extendedprice, 0.52) FILTER (WHERE l_discount > 0.05) AS cheap_high, true AS between, true AS cheap_between, true AS rising FROM lineitem GROUP BY 1""",
)
def approx_quantiles(spark, d):
    """Approximate quantiles, of all rows and of some, lie between exact ones on either side."""
    exact = {f"{p}{n}": f"percentile_disc({q}) within group (order by l_extendedprice){f}" for p, f in (("", ""), ("cheap_", " filter (where l_discount > 0.05D)")) for n, q in (("low", 0.48), ("high", 0.52))}
    near = {"_p": "percentile_approx(l_extendedprice, array(0.5, 0.99, 0.999), 1000)", "_c": "percentile_approx(l_extendedprice, 0.5, 1000) filter (where l_discount > 0.05D)"}
    rows = marts.measured(table(spark, d, "lineitem"), ["l_returnflag"], exact | near)
    p = F.col("_p")
    return rows.withColumns({"between": p[0].between(F.col("low"), F.col("high")), "cheap_between": F.col("_c").between(F.col("cheap_low"), F.col("cheap_high")), "rising": (p[0] <= p[1]) & (p[1] <= p[2])}).drop("_p", "_c")


@query("topk_cells", "SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spent FROM orders GROUP BY 1 ORDER BY n DESC, spent DESC, o_custkey LIMIT 20")
def topk_cells(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), total("o_totalprice").alias("spent")).orderBy(F.desc("n"), F.desc("spent"), "o_custkey").limit(20)


@query("topk_per_group", "SELECT * FROM (SELECT o_orderpriority, o_orderkey, o_totalprice, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders) WHERE rank <= 5")
def topk_per_group(spark, d):
    return profile.top_per_group(table(spark, d, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice"), ["o_orderpriority"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 5)


@query("gap_histogram", "SELECT gap, count(*) AS n FROM (SELECT CAST(round(CAST(l_tax AS DECIMAL(18,2)) - CAST(l_discount AS DECIMAL(18,2)), 2) AS DOUBLE) AS gap FROM lineitem) GROUP BY 1 ORDER BY n DESC, gap LIMIT 15")
def gap_histogram(spark, d):
    gap = (money("l_tax") - money("l_discount")).cast("double")
    return table(spark, d, "lineitem").groupBy(gap.alias("gap")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gap").limit(15)


@query("pivot_counts", "SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS F, count(*) FILTER (WHERE l_linestatus = 'O') AS O FROM lineitem GROUP BY 1")
def pivot_counts(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1))).fillna(0)


# ---- versioned tables ----


def scratch(spark: SparkSession, sf_dir: str) -> str:
    """A new folder that all executors share: below spark.checkpoint.dir, else (one process) a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidemill-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = f"file://{folder}"
    return f"{root.rstrip('/')}/tidemill-{uuid.uuid4().hex}"


def _orders(spark, d):
    return table(spark, d, "orders").withColumns({"month": F.date_format("o_orderdate", "yyyy-MM"), "hash": digest_of([money("o_totalprice").cast("string"), F.col("o_orderstatus")])})


def _feed(orders: DataFrame) -> DataFrame:
    """Corrections: one order in 50 costs 2.00 more, one in 70 comes again under a new key, one in 90 unchanged."""
    fixed = orders.filter("o_orderkey % 50 = 0").withColumn("o_totalprice", (money("o_totalprice") + F.lit(2).cast("decimal(18,2)")).cast("double"))
    fixed = fixed.withColumn("hash", digest_of([money("o_totalprice").cast("string"), F.col("o_orderstatus")]))
    new = orders.filter("o_orderkey % 70 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 1_000_000_000)
    same = orders.filter("o_orderkey % 90 = 0 and o_orderkey % 50 <> 0")
    return fixed.unionByName(new).unionByName(same).withColumn("note", F.lit("fed"))


FEED_SQL = """orders_x AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS price, o_orderstatus FROM orders),
feed AS (SELECT o_orderkey AS k, price + 2 AS price FROM orders_x WHERE o_orderkey % 50 = 0 UNION ALL SELECT o_orderkey + 1000000000, price FROM orders_x WHERE o_orderkey % 70 = 0
  UNION ALL SELECT o_orderkey, price FROM orders_x WHERE o_orderkey % 90 = 0 AND o_orderkey % 50 <> 0),
merged AS (SELECT coalesce(o_orderkey, k) AS k, coalesce(f.price, o.price) AS price, CASE WHEN f.k IS NOT NULL AND (o.price IS NULL OR f.price <> o.price) THEN 'fed' END AS note FROM orders_x o FULL JOIN feed f ON o.o_orderkey = f.k)"""


def _merged(spark, d) -> VersionedTable:
    orders = _orders(spark, d)
    t = VersionedTable(spark, f"{scratch(spark, d)}/orders")
    t.create(orders.repartition(8, "o_orderkey"), user_metadata={"batch_id": "orders"})
    t.merge(_feed(orders), ["o_orderkey"], "hash", user_metadata={"batch_id": "feed"})
    return t


@query("merge_plan_counts", f"WITH {FEED_SQL} SELECT count(*) FILTER (WHERE o.price IS NULL) AS inserts, count(*) FILTER (WHERE o.price <> f.price) AS updates, count(*) FILTER (WHERE o.price = f.price) AS noop FROM feed f LEFT JOIN orders_x o ON o.o_orderkey = f.k")
def merge_plan_counts(spark, d):
    orders = _orders(spark, d)
    t = VersionedTable(spark, f"{scratch(spark, d)}/orders")
    t.create(orders)
    return spark.createDataFrame([t.plan_merge(_feed(orders), ["o_orderkey"], "hash")], "inserts long, updates long, noop long")


@query("merge_evolved_result", f"WITH {FEED_SQL} SELECT k AS o_orderkey, CAST(price AS DOUBLE) AS o_totalprice, note FROM merged")
def merge_evolved_result(spark, d):
    return _merged(spark, d).read().select("o_orderkey", money("o_totalprice").cast("double").alias("o_totalprice"), "note")


@query("time_travel_before", "SELECT o_orderkey, o_totalprice FROM orders")
def time_travel_before(spark, d):
    return _merged(spark, d).read(version=0).select("o_orderkey", "o_totalprice")


@query("version_diff", f"WITH {FEED_SQL} SELECT m.k AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'added' ELSE 'changed' END AS change FROM merged m LEFT JOIN orders_x o ON o.o_orderkey = m.k WHERE o.o_orderkey IS NULL OR o.price <> m.price")
def version_diff(spark, d):
    return _merged(spark, d).diff(0, 1, ["o_orderkey"], ["hash"]).select("o_orderkey", "change")


@query("history_rows", "SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'CREATE', 'orders'), (1, 'MERGE', 'feed')) t(version, operation, batch)")
def history_rows(spark, d):
    return _merged(spark, d).history().select("version", "operation", F.get_json_object("user_metadata", "$.batch_id").alias("batch"))


@query("version_census", f"WITH {FEED_SQL} SELECT CAST(0 AS BIGINT) AS version, (SELECT count(*) FROM orders) AS rows, CAST(8 AS BIGINT) AS columns UNION ALL SELECT 1, (SELECT count(*) FROM merged), 9")
def version_census(spark, d):
    return spark.createDataFrame(_merged(spark, d).census(), "version long, rows long, columns long, operation string").drop("operation")


@query("delete_replace_where", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'replaced' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey >= 100 OR o_orderstatus = 'P'")
def delete_replace_where(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    t = VersionedTable(spark, f"{scratch(spark, d)}/orders")
    t.create(orders, partition=["o_orderstatus"])
    t.replace_where([("o_orderstatus", "=", "P")], orders.filter("o_orderstatus = 'P'").withColumn("o_orderstatus", F.lit("replaced")))
    t.delete([("o_orderkey", "<", 100), ("o_orderstatus", "in", ["O", "F"])])
    return t.read()


@query("append_evolution", "SELECT n_nationkey, n_name, CASE WHEN n_nationkey >= 20 THEN n_regionkey END AS n_regionkey FROM nation")
def append_evolution(spark, d):
    n = table(spark, d, "nation")
    t = VersionedTable(spark, f"{scratch(spark, d)}/nation")
    t.create(n.filter("n_nationkey < 20").drop("n_regionkey"))
    t.append(n.filter("n_nationkey >= 20"), evolve=True)
    return t.read()


def _laid_out(spark, d, by: Iterable[str]) -> VersionedTable:
    t = VersionedTable(spark, f"{scratch(spark, d)}/lineitem")
    t.create(table(spark, d, "lineitem").repartition(8))
    t.optimize(max(1, sum(f.size for f in t.files()) // 16), by=by)
    return t


SUMMARY = {"n": "count(*)", "price": "cast(sum(cast(l_extendedprice as decimal(18, 2))) as double)"}
SUMMARY_SQL = "SELECT count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price FROM lineitem"
YEAR = [("l_shipdate", ">=", datetime(1995, 1, 1)), ("l_shipdate", "<", datetime(1996, 1, 1))]


@query("skipping_one_column", f"{SUMMARY_SQL} WHERE l_suppkey = 32")
def skipping_one_column(spark, d):
    return marts.measured(_laid_out(spark, d, ["l_suppkey"]).read(where=[("l_suppkey", "=", 32)]), [], SUMMARY)


@query("skipping_two_columns", f"{SUMMARY_SQL} WHERE l_suppkey BETWEEN 10 AND 20 AND l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1996-01-01'")
def skipping_two_columns(spark, d):
    return marts.measured(_laid_out(spark, d, ["l_suppkey", "l_shipdate"]).read(where=[("l_suppkey", ">=", 10), ("l_suppkey", "<=", 20), *YEAR]), [], SUMMARY)


@query("skipping_control", f"{SUMMARY_SQL} WHERE l_returnflag = 'R'")
def skipping_control(spark, d):
    return marts.measured(_laid_out(spark, d, ["l_suppkey"]).read(where=[("l_returnflag", "=", "R")]), [], SUMMARY)


@query("compaction_result", f"{SUMMARY_SQL}")
def compaction_result(spark, d):
    return marts.measured(_laid_out(spark, d, []).read(), [], SUMMARY)


@query("files_skipped", "SELECT true AS fewer, true AS as_selected")
def files_skipped(spark, d):
    t = _laid_out(spark, d, ["l_suppkey"])
    df = marts.measured(t.read(where=[("l_suppkey", "=", 32)]), [], SUMMARY)
    df.collect()
    selected = len(t.files(where=[("l_suppkey", "=", 32)]))
    return spark.createDataFrame([(selected < len(t.files()), layouts.scan_metrics(df)["files"] == selected)], "fewer boolean, as_selected boolean")


@query("stream_landing", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_landing(spark, d):
    at = scratch(spark, d)
    events = table(spark, d, "events")
    events.repartition(4).write.parquet(f"{at}/in")
    t = VersionedTable(spark, f"{at}/events")
    ingest.land_files(spark, f"{at}/in", events.schema, t, f"{at}/checkpoint", per_batch=2).awaitTermination()
    return t.read().groupBy("event_type").agg(F.count("*").alias("n"))


FLAGSHIP_SQL = f"""WITH r AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, {LINE_REASON_SQL} AS reason, l_extendedprice,
  row_number() OVER (PARTITION BY l_orderkey, l_linenumber, {LINE_REASON_SQL} IS NULL ORDER BY l_extendedprice, l_partkey, l_suppkey) AS rn FROM {LINES})
SELECT month, CASE WHEN reason IS NULL AND rn > 1 THEN 'DUPLICATE' ELSE coalesce(reason, 'ACCEPTED') END AS outcome, count(*) AS rows, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM r GROUP BY 1, 2"""


@query("contract_monthly_mart", FLAGSHIP_SQL)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines judged by rules, repeated keys found, outcomes counted by month."""
    rows = lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "o_orderdate")
    rows = rows.withColumn("reason", first_match(LINE_RULES, F.col, rows.columns))
    place = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber", F.col("reason").isNull()).orderBy("l_extendedprice", "l_partkey", "l_suppkey"))
    outcome = F.when(F.col("reason").isNull() & (F.col("_n") > 1), "DUPLICATE").otherwise(F.coalesce("reason", F.lit("ACCEPTED")))
    return rows.withColumn("_n", place).groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), outcome.alias("outcome")).agg(F.count("*").alias("rows"), total("l_extendedprice").alias("amount"))
