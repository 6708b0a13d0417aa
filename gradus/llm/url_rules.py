"""URL filter: longest matching (host, path) rule by a sort-merge range sweep.

A rule's host is reversed into a canonical key (``example.org`` becomes
``org.example``); a url is probed once for each of its host suffixes that has
rules, so within one host key a rule's path is a plain prefix and covers the
byte interval [path, path + 0xFF).  Intervals nest or are disjoint.  The sweep
sorts interval bounds and url paths together; after each bound the innermost
open rule, the top of the stack of nested rules, is known: the rule itself after
a start, its parent after an end.  Every url takes the last bound before it.

Only DataFrame functions are used.  Urls are reduced to distinct (host, path)
first; the urls of one host key are dealt over as many sweeps as their count
asks for, each sweep repeating that key's bounds, so no hot host meets in a task.

Defined cases: a null url, or one without ``://``, has empty host and path and
matches nothing; a null page_id is kept; repeated rows give repeated results; of
equal rules the blocking one wins; among rules of different hosts the longest
host + path wins (then the longer host); an empty rule list matches nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ROWS_PER_SWEEP = 20_000
RULES_SCHEMA = "host string, path string, verdict string"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null where there is none."""
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def url_host(url: Column) -> Column:
    host = F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _reversed(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow",
          url: str = "url", rows_per_sweep: int = ROWS_PER_SWEEP) -> DataFrame:
    """``pages`` with columns host, path, rule, verdict added; ``rules`` has
    host, path and verdict ('allow' or 'block').  Columns of ``pages`` that bear
    one of the four names are replaced; ``__top`` is reserved.  ``default`` is the verdict without a rule."""
    pages = pages.drop("host", "path", "rule", "verdict")
    address = F.col(f"`{url}`").cast("string")
    pages = pages.withColumns({"host": url_host(address), "path": url_path(address)})
    rules = (rules.where("host is not null and path is not null and verdict is not null")
             .groupBy(F.translate("host", UPPER, LOWER).alias("host"), "path").agg(F.max("verdict").alias("verdict"))
             .select(_reversed(F.col("host")).alias("hkey"), "path",
                     F.concat("host", "path").alias("rule"), "verdict",
                     F.length("host").alias("hlen"), F.encode("path", "UTF-8").alias("key")))

    # one probe for each (distinct url, host suffix that has rules)
    urls = pages.select("host", "path").distinct()
    labels = F.reverse(F.split("host", r"\.", -1))
    probes = (urls.where("host <> ''")
              .select("host", "path", labels.alias("l"))
              .select("host", "path", F.explode(F.transform(
                  F.sequence(F.lit(1), F.size("l")), lambda n: F.array_join(F.slice("l", 1, n), "."))).alias("hkey"))
              .join(rules.select("hkey").distinct(), "hkey"))
    sweeps = (probes.groupBy("hkey").agg(F.count("*").alias("n"))
              .select("hkey", F.ceil(F.col("n") / rows_per_sweep).cast("int").alias("sweeps")))

    # a rule's parent: the longest other rule of its host key that is a prefix of it
    inner = rules.select("hkey", "key", F.explode(F.transform(
        F.sequence(F.lit(0), F.greatest(F.length("key") - 1, F.lit(0))),
        lambda n: F.substring(F.col("key"), F.lit(1), n))).alias("prefix")).where("length(prefix) < length(key)")
    parents = (inner.join(rules.select("hkey", F.col("key").alias("prefix"), F.struct(
        F.length("rule").alias("len"), "hlen", "rule", "verdict").alias("parent")), ["hkey", "prefix"])
        .groupBy("hkey", "key").agg(F.max(F.struct(F.length("prefix"), "parent")).alias("p"))
        .select("hkey", "key", "p.parent"))
    own = F.struct(F.length("rule").alias("len"), "hlen", "rule", "verdict")
    starts = rules.select("hkey", "key", F.lit(1).alias("kind"), F.length("key").alias("depth"), own.alias("top"))
    ends = (rules.select("hkey", "key").join(parents, ["hkey", "key"], "left")
            .select("hkey", F.concat("key", F.unhex(F.lit("FF"))).alias("key"), F.lit(0).alias("kind"),
                    (-F.length("key")).alias("depth"), F.col("parent").alias("top")))
    bounds = (starts.unionByName(ends).join(sweeps, "hkey")
              .select("hkey", F.explode(F.sequence(F.lit(0), F.col("sweeps") - 1)).alias("sweep"), "key", "kind",
                      "depth", F.struct("top").alias("bound"),
                      F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path")))
    probes = (probes.join(sweeps, "hkey")
              .select("hkey", F.pmod(F.xxhash64("host", "path"), F.col("sweeps")).cast("int").alias("sweep"),
                      F.encode("path", "UTF-8").alias("key"), F.lit(2).alias("kind"), F.lit(0).alias("depth"),
                      F.lit(None).cast(bounds.schema["bound"].dataType).alias("bound"), "host", "path"))
    w = Window.partitionBy("hkey", "sweep").orderBy("key", "kind", "depth")
    best = (bounds.unionByName(probes)
            .withColumn("open", F.last("bound", ignorenulls=True).over(w))
            .where("kind = 2 and open.top is not null")
            .groupBy("host", "path").agg(F.max("open.top").alias("__top")))
    return (pages.join(best, ["host", "path"], "left")
            .withColumns({"rule": F.col("__top.rule"), "verdict": F.coalesce("__top.verdict", F.lit(default))})
            .drop("__top"))


#: fixed values of the registered query
QUERY_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
               ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(QUERY_RULES, RULES_SCHEMA)
    return judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = """
WITH r(rhost, rpath, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
    ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
        FROM pages),
u AS (SELECT page_id, row_number() OVER () AS rid,
             translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
m AS (SELECT u.*, rhost || rpath AS rule, v, row_number() OVER
             (PARTITION BY rid ORDER BY length(rhost || rpath) DESC NULLS LAST, length(rhost) DESC) AS k
      FROM u LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(v, 'allow') AS verdict
FROM m WHERE k = 1
"""
