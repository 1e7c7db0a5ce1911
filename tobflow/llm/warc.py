"""WARC archives and their Merkle fixity audit.

A page becomes a WARC/1.1 resource record. Records lie in segments of ``segment_ids`` consecutive page ids, in the order
of their ids, each at the sum of the lengths before it; records without an id are dealt over segments of their own by
their digest, so that no segment holds them all. A leaf hashes a record's offset, length and SHA-256; a node
hashes the hashes of up to FANOUT children in order, and so stands for their range of offsets; a segment's
root is its only node of the top level. An audit compares the roots of two replicas and descends only from
nodes that differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tobflow.llm.common import table

FANOUT = 16
KEY = ["segment", "level", "place"]


#: Date of all records: pages have none of their own.
DATE = "2024-01-01T00:00:00Z"
#: The last of the segments of records without an id; the others lie below it.
NO_ID = -(1 << 62)


def warc_record(page_id: Column, url: Column, html: Column, date: str = DATE) -> Column:
    """A WARC/1.1 resource record as text. A page without a URL goes by its record's name; line ends in a URL are escaped."""
    body, name = F.coalesce(html, F.lit("")), F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")))
    uri = F.replace(F.replace(F.coalesce(url, name), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    fields = {
        "WARC-Type": F.lit("resource"),
        "WARC-Record-ID": F.concat(F.lit("<"), name, F.lit(">")),
        "WARC-Date": F.lit(date),
        "WARC-Target-URI": uri,
        "Content-Type": F.lit("text/html; charset=utf-8"),
        "Content-Length": F.octet_length(body).cast("string"),
    }
    lines = [part for k, v in fields.items() for part in (F.lit(f"{k}: "), v, F.lit("\r\n"))]
    return F.concat(F.lit("WARC/1.1\r\n"), *lines, F.lit("\r\n"), body, F.lit("\r\n\r\n"))


def write_replica(pages: DataFrame, name: str, segment_ids: int = 256) -> DataFrame:
    """Write (segment, page_id, record) to the shared folder and read it back."""
    page_id = F.col("page_id").cast("long")
    record = warc_record(page_id, F.col("url"), F.col("html")).cast("binary")
    of_digest = F.conv(F.substring(F.sha2("record", 256), 1, 4), 16, 10).cast("long")
    segment = F.coalesce(F.expr(f"(page_id - pmod(page_id, {segment_ids}L)) div {segment_ids}L"), NO_ID - of_digest)
    rows = pages.select(page_id.alias("page_id"), record.alias("record"))
    return table(rows.select(segment.alias("segment"), "page_id", "record"), name)


def leaves(replica: DataFrame) -> DataFrame:
    """segment, place, page_id, start_offset, n_bytes, record_sha256 and hash of each stored record.

    Records of one page id are ordered by digest. A segment's digests, not its records, are sorted.
    """
    rows = replica.select("segment", "page_id", F.octet_length("record").cast("long").alias("n_bytes"), F.sha2("record", 256).alias("record_sha256"))
    order = Window.partitionBy("segment").orderBy("page_id", "record_sha256")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("place", F.row_number().over(order).cast("long") - 1).withColumn("start_offset", F.coalesce(F.sum("n_bytes").over(before), F.lit(0)))
    return rows.withColumn("hash", F.sha2(F.concat_ws(" ", "start_offset", "n_bytes", "record_sha256").cast("binary"), 256))


def merkle_tree(leaf_rows: DataFrame) -> DataFrame:
    """segment, level, place, hash, n_children: level 0 is the leaves; every segment goes up to the same level."""
    now = leaf_rows.select("segment", F.lit(0).alias("level"), "place", "hash", F.lit(0).alias("n_children"))
    most = leaf_rows.agg(F.max("place")).first()[0] or 0
    out, level = now, 0
    while most > 0 or level == 0:
        level, most = level + 1, most // FANOUT
        children = F.transform(F.array_sort(F.collect_list(F.struct("place", "hash"))), lambda x: x["hash"])
        now = now.groupBy("segment", F.floor(F.col("place") / FANOUT).alias("place")).agg(children.alias("children"))
        now = now.select("segment", F.lit(level).alias("level"), "place", F.sha2(F.array_join("children", "").cast("binary"), 256).alias("hash"), F.size("children").alias("n_children"))
        out = out.unionByName(now)
    return table(out, "merkle")


def differing_leaves(left: DataFrame, right: DataFrame) -> DataFrame:
    """(segment, place) of leaves that differ or that one tree lacks; only children of differing nodes are compared."""
    heights = [t.agg(F.max("level")).first()[0] or 0 for t in (left, right)]
    top = min(heights) if min(heights) else max(heights)

    def compare(a: DataFrame, b: DataFrame) -> DataFrame:
        a, b = a.select("segment", "place", F.col("hash").alias("left_hash")), b.select("segment", "place", F.col("hash").alias("right_hash"))
        return a.join(b, ["segment", "place"], "full").where(~F.col("left_hash").eqNullSafe(F.col("right_hash"))).select("segment", "place")

    bad = compare(left.where(F.col("level") == top), right.where(F.col("level") == top))
    for level in range(top - 1, -1, -1):
        bad = table(bad, "differing").withColumnRenamed("place", "parent")
        sides = []
        for tree in (left, right):
            nodes = tree.where(F.col("level") == level).withColumn("parent", F.floor(F.col("place") / FANOUT))
            sides.append(nodes.join(bad, ["segment", "parent"], "left_semi"))
        bad = compare(*sides)
    return bad


def fixity_audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """The records of replica ``left`` with ``intact``: whether replica ``right`` holds the same bytes at the same place.

    Both are tables of (segment, page_id, record). Null pages are empty, null page ids lie in segments of their own,
    repeated rows are records of their own, records of one id are in the order of their digests, a very long page is
    one record, an empty replica gives no rows; records that only ``right`` has show as differing places, not as rows.
    """
    ours = table(leaves(left), "leaves")
    bad = differing_leaves(merkle_tree(ours), merkle_tree(leaves(right)))
    marked = ours.join(bad.withColumn("differs", F.lit(True)), ["segment", "place"], "left")
    return marked.select("page_id", "segment", "place", "start_offset", "n_bytes", "record_sha256", F.col("differs").isNull().alias("intact"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of two replicas written from pages, the second with a drill: each page_id of 13 modulo 97 loses its first "e"."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    drill = F.when(F.col("page_id") % 97 == 13, F.regexp_replace("html", "(?s)^([^e]*)e", "$1")).otherwise(F.col("html"))
    out = fixity_audit(write_replica(pages, "replica-a"), write_replica(pages.withColumn("html", drill), "replica-b"))
    return out.select("page_id", "segment", "start_offset", "n_bytes", "record_sha256", "intact")


_SQL_RECORD = (
    "concat('WARC/1.1', c, 'WARC-Type: resource', c, 'WARC-Record-ID: <', name, '>', c, 'WARC-Date: " + DATE + "', c, "
    "'WARC-Target-URI: ', replace(replace(coalesce(url, name), chr(13), '%0D'), chr(10), '%0A'), c, "
    "'Content-Type: text/html; charset=utf-8', c, 'Content-Length: ', strlen(coalesce({html}, '')), c, c, coalesce({html}, ''), c, c)"
)
OP7_SQL = f"""
WITH base AS (SELECT *, chr(13) || chr(10) AS c, concat('urn:page:', coalesce(CAST(page_id AS VARCHAR), 'null')) AS name,
  CASE WHEN page_id % 97 = 13 THEN regexp_replace(html, '(?s)^([^e]*)e', '\\1') ELSE html END AS drilled FROM pages),
built AS (SELECT page_id, {_SQL_RECORD.format(html="html")} AS a, {_SQL_RECORD.format(html="drilled")} AS b FROM base),
recs AS (
  SELECT page_id, coalesce((page_id - ((page_id % 256) + 256) % 256) // 256, {NO_ID} - CAST('0x' || substr(sha256(a), 1, 4) AS BIGINT)) AS segment, a, b FROM built),
sized AS (
  SELECT page_id, segment, CAST(strlen(a) AS BIGINT) AS n_bytes, sha256(a) AS record_sha256, sha256(b) AS other, CAST(strlen(b) AS BIGINT) AS other_bytes FROM recs),
placed AS (
  SELECT *, coalesce(sum(n_bytes) OVER w, 0) AS start_offset, coalesce(sum(other_bytes) OVER w, 0) AS other_offset
  FROM sized WINDOW w AS (PARTITION BY segment ORDER BY page_id, record_sha256 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT page_id, segment, CAST(start_offset AS BIGINT) AS start_offset, n_bytes, record_sha256,
       record_sha256 = other AND start_offset = other_offset AS intact FROM placed
"""
