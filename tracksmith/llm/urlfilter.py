"""URL filters whose lists change over time, in DataFrame expressions only.

Dated list entries become validity intervals: an entry holds for its key from its date until
the next entry of that key. A capture looks up its host, each parent domain and the first
folder of its path, and an as-of join keeps the entries whose interval holds the time of the
fetch. The longest key decides; a capture that no key holds is allowed.

The join is an equi-join on the key with the interval as a condition, so it is a sort-merge
join that Spark splits on hot hosts, and no list is broadcast unless Spark finds it small.

Defined cases: a null or unreadable URL has no key and is allowed; a null fetch time is before
every entry; entries without key, date or action are no entries; of entries with the same key
and date the one with the greatest sequence number holds; repeated captures repeat their row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """The host in lower case without port; null where there is none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]+)", 1))
    return F.when(found != "", found)


def keys_of(url: Column) -> Column:
    """The host, its parent domains of two labels at least, and host/folder."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    parents = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(labels) - 2)),
        lambda i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."),
    )
    folder = F.regexp_extract(url, r"^[^:]+://[^/?#]+/([^/?#]+)/", 1)
    own = F.when(folder != "", F.array(F.concat_ws("/", host, folder))).otherwise(F.array().cast("array<string>"))
    return F.when(host.isNotNull(), F.array_distinct(F.concat(parents, own))).otherwise(F.array().cast("array<string>"))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(key, action, since, until): until is null for entries that still hold."""
    clean = entries.where("key IS NOT NULL AND since IS NOT NULL AND action IS NOT NULL")
    clean = clean.groupBy("key", "since").agg(F.max_by("action", "seq").alias("action"))
    return clean.withColumn("until", F.lead("since").over(Window.partitionBy("key").orderBy("since")))


def filter_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per capture (page_id, url, fetched): the deciding key, its action and since when."""
    rows = captures.groupBy("page_id", "url", "fetched").agg(F.count("*").alias("n"))
    looked = rows.select("page_id", "url", "fetched", "n", F.explode_outer(keys_of(F.col("url"))).alias("key"))
    held = looked.join(validity_intervals(entries), "key", "left").withColumn(
        "hit", F.when((F.col("fetched") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until"))) & (F.col("action") != "remove"), F.struct(F.length("key").alias("n"), "key", "action", "since"))
    )
    best = held.groupBy("page_id", "url", "fetched", "n").agg(F.max("hit").alias("hit"))
    return best.select(
        "page_id",
        "fetched",
        host_of(F.col("url")).alias("host"),
        F.col("hit.key").alias("matched_key"),
        F.coalesce("hit.action", F.lit("allow")).alias("action"),
        F.col("hit.since").alias("since"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("_copy"),
    ).drop("_copy")


def listed_hosts(pages: DataFrame) -> DataFrame:
    """A dated list made from the hosts and folders that the pages have.

    A third of the hosts are blocked from a day in January 2024 that their md5 names, half of
    those are removed from the list ten days later; a sixth of the domains above them are
    blocked all along; folders of a quarter of the hosts are allowed from a day of their own.
    """
    keys = pages.select(F.explode(keys_of(F.col("url"))).alias("key")).distinct()
    digest = lambda at: F.conv(F.substring(F.md5(F.col("key").cast("binary")), at, 2), 16, 10).cast("int")
    day = F.to_timestamp(F.date_add(F.lit("2024-01-01").cast("date"), digest(3) % 28))
    keyed = keys.select("key", digest(1).alias("d"), digest(5).alias("e"), day.alias("day"), F.size(F.split("key", r"\.")).alias("labels"), F.contains("key", F.lit("/")).alias("folder"))
    blocked = keyed.where("NOT folder AND labels > 2 AND d < 85")
    return (
        blocked.select("key", F.lit("block").alias("action"), F.col("day").alias("since"), F.lit(1).alias("seq"))
        .union(blocked.where("e < 128").select("key", F.lit("remove"), F.expr("day + INTERVAL 10 DAYS"), F.lit(2)))
        .union(keyed.where("NOT folder AND labels = 2 AND d < 43").select("key", F.lit("block"), F.expr("TIMESTAMP '2024-01-01 00:00:00'"), F.lit(1)))
        .union(keyed.where("folder AND d < 64").select("key", F.lit("allow"), "day", F.lit(1)))
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages against the list; a page was fetched page_id mod 60000 minutes into 2024."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").cast("long").alias("page_id"), "url")
    fetched = F.timestamp_seconds(F.lit(1704067200) + 60 * F.pmod("page_id", F.lit(60000)))
    found = filter_captures(pages.withColumn("fetched", fetched), listed_hosts(pages))
    return found.select("page_id", "host", "matched_key", "action", F.unix_timestamp("since").alias("since_s"), F.unix_timestamp("fetched").alias("fetched_s"))


OP5_SQL = r"""
WITH p AS (
  SELECT page_id, url, 1704067200 + 60 * (((page_id % 60000) + 60000) % 60000) AS fetched_s,
         nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]+)', 1)), '') AS host,
         nullif(regexp_extract(url, '^[^:]+://[^/?#]+/([^/?#]+)/', 1), '') AS folder
  FROM pages
), k AS (
  SELECT DISTINCT page_id, url, fetched_s, host, key FROM (
    SELECT page_id, url, fetched_s, host,
           unnest(list_transform(range(0, greatest(1, len(string_split(host, '.')) - 1)), lambda i: array_to_string(list_slice(string_split(host, '.'), i + 1, 1000), '.'))) AS key
    FROM p WHERE host IS NOT NULL
    UNION ALL SELECT page_id, url, fetched_s, host, host || '/' || folder FROM p WHERE host IS NOT NULL AND folder IS NOT NULL
  )
), d AS (
  SELECT key, ('0x' || substr(md5(key), 1, 2))::INT AS d, ('0x' || substr(md5(key), 5, 2))::INT AS e,
         1704067200 + 86400 * (('0x' || substr(md5(key), 3, 2))::INT % 28) AS day_s,
         len(string_split(key, '.')) AS labels, contains(key, '/') AS folder
  FROM (SELECT DISTINCT key FROM k)
), l AS (
  SELECT key, 'block' AS action, day_s AS since_s FROM d WHERE NOT folder AND labels > 2 AND d < 85
  UNION ALL SELECT key, 'remove', day_s + 864000 FROM d WHERE NOT folder AND labels > 2 AND d < 85 AND e < 128
  UNION ALL SELECT key, 'block', 1704067200 FROM d WHERE NOT folder AND labels = 2 AND d < 43
  UNION ALL SELECT key, 'allow', day_s FROM d WHERE folder AND d < 64
), v AS (
  SELECT *, lead(since_s) OVER (PARTITION BY key ORDER BY since_s) AS until_s FROM l
), h AS (
  SELECT k.page_id, k.url, v.key, v.action, v.since_s,
         row_number() OVER (PARTITION BY k.page_id, k.url ORDER BY length(v.key) DESC, v.key DESC) AS r
  FROM k JOIN v ON k.key = v.key AND k.fetched_s >= v.since_s AND (v.until_s IS NULL OR k.fetched_s < v.until_s)
  WHERE v.action <> 'remove'
)
SELECT p.page_id, p.host, h.key AS matched_key, coalesce(h.action, 'allow') AS action, h.since_s::BIGINT AS since_s, p.fetched_s::BIGINT AS fetched_s
FROM p LEFT JOIN h ON p.page_id = h.page_id AND p.url = h.url AND h.r = 1
"""
