"""URL filters: a temporal join of captures with dated block lists.

List entries are dated events: a host pattern is added to or removed from a list. The events of a pattern become validity
intervals (each ends where the pattern's next event begins), and an as-of join evaluates every capture against the
entries that were active when it was fetched. A pattern matches its own host and every host below it, so a
capture is looked up under each suffix of its host: an equi-join on (suffix = pattern) with the interval as condition.

Each distinct host is looked up once, under each of its suffixes, so that a suffix that no list has (or that most hosts have) costs a row for each
host, not for each capture. The intervals that a host meets then join its captures.

Skew: a pattern has few intervals, so a host with a third of all captures meets only those; the intervals
are broadcast when counted to be small, and else the joins are sort-merge joins whose hot keys AQE may split.

Defined results: a URL that is null or has no host has host null, no active entry and is not blocked. Events without
pattern, date or list, or with another action than add or remove, are ignored. Of several events of a list's pattern at one time,
a removal wins; repeats change nothing. An entry is active from its own time on, up to and without that of its removal.
Captures with a null fetch time meet no entry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindle.llm.common import small, table

#: Bound under which intervals are broadcast (about 100 bytes each).
BROADCAST_INTERVALS = 200_000


def host(url: str = "url"):
    """The host of a URL in lower case, without user, port and final dot; null if there is none."""
    h = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    h = F.regexp_replace(h, r"\.+$", "")
    return F.when(h == "", None).otherwise(h)


def intervals(events: DataFrame) -> DataFrame:
    """events: list, pattern, at, action. Returns list, pattern, begins, ends (null: still active)."""
    own = events.select("list", F.lower("pattern").alias("pattern"), "at", F.lower("action").alias("action")).where("list is not null and pattern is not null and at is not null and action in ('add', 'remove')")
    own = own.groupBy("list", "pattern", "at").agg(F.max("action").alias("action"))  # remove sorts after add
    w = Window.partitionBy("list", "pattern").orderBy("at")
    return own.withColumn("ends", F.lead("at").over(w)).where("action = 'add'").select("list", "pattern", F.col("at").alias("begins"), "ends")


def active_entries(captures: DataFrame, events: DataFrame, key: str = "page_id") -> DataFrame:
    """captures: key, url, fetched. Returns key, host, fetched, n_active, lists (sorted names of the lists that block it), blocked."""
    span = intervals(events)
    seen = captures.select(F.col(key).alias("_k"), F.monotonically_increasing_id().alias("_row"), host().alias("host"), "fetched")
    parts = F.split("h", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "."))
    hosts = captures.select(host().alias("h")).where("h is not null").distinct().withColumn("suffix", F.explode(suffix))
    met = hosts.join(small(span, BROADCAST_INTERVALS), F.col("suffix") == F.col("pattern")).select("h", "list", "begins", "ends")
    hit = (F.col("host") == F.col("h")) & (F.col("fetched") >= F.col("begins")) & (F.col("ends").isNull() | (F.col("fetched") < F.col("ends")))
    got = seen.join(small(met, BROADCAST_INTERVALS), hit, "left").groupBy("_row").agg(
        F.first("_k").alias(key), F.first("host").alias("host"), F.first("fetched").alias("fetched"), F.count("h").alias("n_active"), F.array_sort(F.collect_set("list")).alias("lists"))
    return got.drop("_row").withColumn("blocked", F.col("n_active") > 0)


def _hex(col, at: int, n: int, mod: int):
    return F.conv(F.substring(F.md5(col.cast("binary")), at, n), 16, 10).cast("int") % mod


def _fixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Captures of the table pages with a fetch day, and lists of its hosts and their parents, both by fixed rules (there are no dated lists here)."""
    pages = table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(365)).cast("int")).alias("fetched"))
    hosts = captures.select(host().alias("h")).where("h is not null").distinct()
    parents = hosts.select(F.regexp_replace("h", r"^[^.]+\.", "").alias("h"))
    names = hosts.select("h", F.lit("hosts").alias("list")).union(parents.select("h", F.lit("domains").alias("list"))).distinct()
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)
    first = _hex(F.col("h"), 1, 4, 300)
    add = names.where(_hex(F.col("h"), 9, 2, 4) < 2).select("list", F.col("h").alias("pattern"), day(first).alias("at"), F.lit("add").alias("action"))
    gone = names.where((_hex(F.col("h"), 9, 2, 4) < 2) & (_hex(F.col("h"), 11, 2, 2) == 0)).select("list", F.col("h").alias("pattern"), day(first + _hex(F.col("h"), 5, 4, 200)).alias("at"), F.lit("remove").alias("action"))
    return captures, add.union(gone)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures, events = _fixture(spark, sf_dir)
    return active_entries(captures, events).select("page_id", "host", "fetched", "n_active", F.array_join("lists", ",").alias("lists"), "blocked")


OP6_SQL = r"""
with c as (select page_id, nullif(regexp_replace(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '\.+$', ''), '') host, (date '2024-01-01' + (page_id % 365)::int)::date fetched from pages),
h as (select distinct host h from c where host is not null),
names as (select h, 'hosts' list from h union select distinct regexp_replace(h, '^[^.]+\.', ''), 'domains' from h),
x as (select h, list, ('0x' || substr(md5(h), 1, 4))::int % 300 d, ('0x' || substr(md5(h), 5, 4))::int % 200 n, ('0x' || substr(md5(h), 9, 2))::int % 4 u, ('0x' || substr(md5(h), 11, 2))::int % 2 v from names),
i as (select h, list, (date '2024-01-01' + d)::date b, case when v = 0 then (date '2024-01-01' + d + n)::date end e from x where u < 2 and not (v = 0 and n = 0)),
m as (select c.page_id, i.list from c join i on (c.host = i.h or c.host like '%.' || i.h) and c.fetched >= i.b and (i.e is null or c.fetched < i.e)),
g as (select page_id, count(*) n_active, string_agg(distinct list, ',' order by list) lists from m group by 1)
select page_id, host, fetched, coalesce(n_active, 0)::bigint n_active, coalesce(lists, '') lists, coalesce(n_active, 0) > 0 blocked from c left join g using (page_id)
"""
