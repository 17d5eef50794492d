"""URL rules by host-suffix and path-prefix expressions, in DataFrame operations only.

Each distinct (host, path) is expanded into the expressions that a rule could have: host suffixes of as many
labels as some rule's host has, path prefixes of the lengths that some rule's path has. Expressions meet the
rules on the first 32 bits of their digest; full digests then confirm, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm._state import prepare
from tidemill.llm.exact_dedup import LOWER, UPPER

#: Hexadecimal digits of a digest in the first, short join.
SHORT = 8
#: Rules up to this many are broadcast; beyond, both sides are shuffled on the short prefix.
BROADCAST_RULES = 100_000
#: Parts into which pages without a host are dealt.
SALTS = 4096


def host_and_path(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host: between the first `://` and the next `/`, `?`, `#`; path: then up to `?` or `#`. Both empty without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of pages: id, host, path, rule, verdict.

    rules has (host, path, verdict), its path beginning with `/` or empty. A rule fits its host and all
    subdomains if the url's path starts with the rule's path; of fitting rules the longest (host and path
    together, then the longer host, then `block` before `allow`) wins; without one the verdict is `default`.
    Repeated rows and rows without an id get a row each, null urls an empty host and path; an empty table gives no
    rows; other columns are not read, whatever their names. Urls of any length are read whole.

    Pages without a host, which no rule fits, are spread over salts when they meet the rules that were found.
    """
    spark = pages.sparkSession
    prepare(spark)
    rules = rules.select(
        F.col("host").alias("_rhost"),
        F.concat("host", "path").alias("_rule"),
        F.col("verdict").alias("_verdict"),
        F.size(F.split("host", r"\.")).alias("_labels"),
        F.length("path").alias("_plen"),
    ).withColumn("_digest", F.sha2(F.col("_rule").cast("binary"), 256))
    shapes = rules.select(F.collect_set("_labels").alias("l"), F.collect_set("_plen").alias("p"), F.count("*").alias("n")).first()
    parsed = pages.select(F.col(id_col).alias("_id"), F.coalesce(F.col(url_col), F.lit("")).alias("_url"))
    host, path = host_and_path(F.col("_url"))
    parsed = parsed.withColumns({"_host": host, "_path": path})
    if not shapes["n"]:
        best = spark.createDataFrame([], "_host string, _path string, _best struct<_size:int,_hlen:int,_block:boolean,_rule:string,_verdict:string>")
    else:
        hosts = F.array_distinct(F.filter(F.array(*[F.substring_index("_host", ".", -n) for n in sorted(shapes["l"])]), lambda h: h != ""))
        paths = F.array_distinct(F.array(*[F.substring("_path", 1, n) if n else F.lit("") for n in sorted(shapes["p"])]))
        expressions = (
            parsed.select("_host", "_path")
            .filter("_host != ''")
            .distinct()
            .withColumn("_suffix", F.explode(hosts))
            .withColumn("_prefix", F.explode(paths))
            .withColumn("_full", F.sha2(F.concat("_suffix", "_prefix").cast("binary"), 256))
            .withColumn("_short", F.substring("_full", 1, SHORT))
        )
        short = rules.withColumn("_short", F.substring("_digest", 1, SHORT))
        best = (
            expressions.join(F.broadcast(short) if shapes["n"] <= BROADCAST_RULES else short, "_short")
            .filter((F.col("_full") == F.col("_digest")) & (F.col("_suffix") == F.col("_rhost")))
            .groupBy("_host", "_path")
            .agg(F.max(F.struct(F.length("_rule").alias("_size"), F.length("_rhost").alias("_hlen"), (F.col("_verdict") == "block").alias("_block"), "_rule", "_verdict")).alias("_best"))
        )
    salt = F.when(F.col("_host") == "", F.pmod(F.xxhash64("_id", F.monotonically_increasing_id()), F.lit(SALTS))).otherwise(F.lit(-1))
    parsed, best = parsed.withColumn("_salt", salt), best.withColumn("_salt", F.lit(-1).cast("long"))
    return parsed.join(best, ["_host", "_path", "_salt"], "left").select(
        F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_best._rule").alias("rule"), F.coalesce("_best._verdict", F.lit(default)).alias("verdict")
    )
