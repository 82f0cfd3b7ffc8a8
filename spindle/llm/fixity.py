"""WARC records, and a Merkle fixity audit of two replicas.

Records become WARC/1.1 bytes, and stand in an archive in the order of their indices without gaps. Each record is hashed with its
index and length. Every `FANOUT` neighbours are hashed again, each with its place and its offset range *within their parent*, level by
level, until an archive has one root. So a root covers the ordered offset ranges of all its records, and yet a lost or longer record changes
the hashes above it alone, not those of the records behind it. Replicas with equal roots are equal; from unequal roots the audit
descends only into the children of nodes that differ, to the records. On its way down it adds up where each node begins in
either replica, so that the ranges of what it finds need no pass over all records.

A tree level is one grouping of the level below by (archive, index div FANOUT): a group never has more than FANOUT rows, whatever an
archive's size, and levels shrink by that factor. Every level is written once and read again. Only hashes and lengths are shuffled, not records.

Defined results: a null payload is an empty one. Records without archive or index are left out. Of records that repeat
an index, all count, in the order of their hashes, and their range is that of all. A record that one replica lacks is
`missing` or `extra`. Empty replicas differ in nothing; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindle.llm.common import table, written

FANOUT = 16
#: Records of an archive in the query.
ARCHIVE = 1000


def warc_records(pages: DataFrame) -> DataFrame:
    """archive, idx, record (bytes): a response record for each page. pages: archive, idx, url, html."""
    body = F.coalesce("html", F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce("url", F.lit("")),
        F.lit("\r\nWARC-Record-ID: <urn:sha256:"), F.sha2(F.concat_ws("|", F.col("archive").cast("string"), F.col("idx").cast("string")).cast("binary"), 256),
        F.lit(">\r\nWARC-Payload-Digest: sha256:"), F.sha2(body.cast("binary"), 256),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return pages.select("archive", "idx", F.concat(head, body, F.lit("\r\n\r\n")).cast("binary").alias("record"))


def leaves(records: DataFrame) -> DataFrame:
    """archive, node, hash, size: one leaf for each index. records: archive, idx, record."""
    size = F.coalesce(F.octet_length("record"), F.lit(0)).cast("long")
    own = F.sha2(F.concat(F.concat_ws("|", F.col("archive").cast("string"), F.col("idx").cast("string"), size.cast("string")).cast("binary"), F.lit("|").cast("binary"), F.coalesce("record", F.lit(b""))), 256)
    one = records.where("archive is not null and idx is not null").select("archive", F.col("idx").cast("long").alias("node"), own.alias("hash"), size.alias("size"))
    return one.groupBy("archive", "node").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("hash")), "").cast("binary"), 256).alias("hash"), F.sum("size").alias("size"))


def parents(level: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The level above: each node's hash covers its children's places, hashes and offset ranges in order."""
    kids = F.array_sort(F.collect_list(F.struct("node", "hash", "size")))
    blank = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("said"))
    line = lambda s, x: F.concat(s["said"], F.concat_ws(":", x["node"].cast("string"), s["at"].cast("string"), (s["at"] + x["size"]).cast("string"), x["hash"]), F.lit(","))
    whole = F.aggregate("kids", blank, lambda s, x: F.struct((s["at"] + x["size"]).alias("at"), line(s, x).alias("said")))
    up = level.groupBy("archive", F.floor(F.col("node") / fanout).alias("node")).agg(kids.alias("kids")).select("archive", "node", whole.alias("whole"))
    return up.select("archive", "node", F.sha2(F.col("whole.said").cast("binary"), 256).alias("hash"), F.col("whole.at").alias("size"))


def tree(records: DataFrame, depth: int, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels from the leaves to the roots, each a written table."""
    levels = [written(leaves(records), "leaves")]
    for _ in range(depth):
        levels.append(written(parents(levels[-1], fanout), "nodes"))
    return levels


def _below(level: DataFrame, bad: DataFrame, begins: str, fanout: int) -> DataFrame:
    """The children of bad nodes, with where they begin."""
    up = bad.where(F.col(begins).isNotNull()).select(F.col("archive").alias("_a"), F.col("node").alias("_up"), F.col(begins).alias("_from"))
    kids = level.join(up, (level["archive"] == up["_a"]) & (F.floor(level["node"] / fanout) == up["_up"]))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("archive", "_up").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # of `fanout` rows at most
    return kids.select("archive", "node", "hash", "size", (F.col("_from") + before).alias(begins))


def findings(primary: DataFrame, replica: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """archive, idx, status (changed, missing, extra), begins, ends of every record in which the replicas differ.

    The byte range is that in the primary, and of extra records that in the replica.
    """
    top = max((x.agg(F.max(F.col("idx").cast("long"))).first()[0] or 0) for x in (primary, replica))
    depth = 0
    while top // fanout**depth:
        depth += 1
    bad = None
    for x, y in zip(reversed(tree(primary, depth, fanout)), reversed(tree(replica, depth, fanout)), strict=True):
        if bad is None:
            x, y = x.withColumn("begins", F.lit(0).cast("long")), y.withColumn("other_begins", F.lit(0).cast("long"))
        else:  # only the children of nodes that differ
            x, y = _below(x, bad, "begins", fanout), _below(y, bad, "other_begins", fanout)
        y = y.withColumnsRenamed({"hash": "other", "size": "other_size"})
        bad = written(x.join(y, ["archive", "node"], "full_outer").where(~F.col("hash").eqNullSafe(F.col("other"))), "differ")
    status = F.when(F.col("other").isNull(), "missing").when(F.col("hash").isNull(), "extra").otherwise("changed")
    at = F.coalesce("begins", "other_begins")
    return bad.select("archive", F.col("node").alias("idx"), status.alias("status"), at.alias("begins"), (at + F.coalesce("size", "other_size")).alias("ends"))


def audit(primary: DataFrame, replica: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """archive, idx, status of every record in which the replicas differ."""
    return findings(primary, replica, fanout).select("archive", "idx", "status")


def _replicas(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The pages as archives, and a replica damaged by a fixed rule (there is no second copy here)."""
    pages = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / ARCHIVE).alias("archive"), (F.col("page_id") % ARCHIVE).alias("idx"), "page_id", "url", "html")
    damaged = pages.where("page_id % 89 <> 7").withColumn("html", F.when(F.col("page_id") % 97 == 5, F.concat(F.coalesce("html", F.lit("")), F.lit("\x00"))).otherwise(F.col("html")))
    return warc_records(pages), warc_records(damaged)


def op9_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(*_replicas(spark, sf_dir))


OP9_SQL = r"""
with r as (select page_id // 1000 archive, page_id % 1000 idx, page_id,
  strlen('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'WARC-Record-ID: <urn:sha256:' || repeat('0', 64) || '>' || chr(13) || chr(10) || 'WARC-Payload-Digest: sha256:' || repeat('0', 64) || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, ''))::varchar || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)) n from pages),
o as (select *, sum(n) over (partition by archive order by idx)::bigint ends from r)
select archive, idx, case when page_id % 89 = 7 then 'missing' else 'changed' end status, (ends - n)::bigint begins, ends from o where page_id % 89 = 7 or page_id % 97 = 5
"""
