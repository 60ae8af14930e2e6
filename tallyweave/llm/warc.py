r"""WARC archives and their Merkle fixity audit.

Pages become WARC records; an archive holds a range of page ids in order. A record's
offset is the sum of the lengths before it. Record digests are the leaves of a tree: a node
of the lowest level covers ``range_bytes`` of offsets and hashes its records' offsets,
lengths and digests in order; every higher node hashes ``fanout`` nodes. Two replicas are
compared from the roots down: only children of nodes that differ are looked at, and only
records of ranges that differ are compared. Nodes are rows, so a tree of any size is built
by one small aggregation per level, and no task sees more than a range or a fan-out.

Spark's text writer writes the archives: a record ends with CR LF CR LF, so the record
without its last LF is a "line". Reading takes a file as one row, so an archive is
kept small (``pages_per_archive``).
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window

from tallyweave.sources.scratch import materialise

PAGES_PER_ARCHIVE = 2_000
RANGE_BYTES = 1 << 16
FANOUT = 16
_LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*(\d+)", re.I)
_PAGE = re.compile(rb"\r\nwarc-record-id:[ \t]*<urn:page:(-?\d+)>", re.I)


def record_text(page_id: Column, url: Column, body: Column) -> Column:
    """One WARC record; line feeds in urls are dropped."""
    body = F.coalesce(body, F.lit(""))
    uri = F.translate(F.coalesce(url, F.lit("")), "\r\n", "")
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nWARC-Record-ID: <urn:page:"), page_id.cast("string"),
        F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def records(pages: DataFrame, per_archive: int = PAGES_PER_ARCHIVE, body: Column | None = None) -> DataFrame:
    """``(archive, page_id, record)``; rows without an id have no place in an archive and are left out."""
    page = F.col("page_id").cast("bigint")
    return pages.where("page_id is not null").select(
        F.floor(page / per_archive).alias("archive"), page.alias("page_id"),
        record_text(page, F.col("url"), F.col("html") if body is None else body).alias("record"),
    )


def catalogue(rows: DataFrame) -> DataFrame:
    """Leaves ``(archive, offset, length, digest, page_id)`` of records, without writing them."""
    narrow = rows.select("archive", "page_id", F.octet_length("record").cast("bigint").alias("length"), F.sha2("record", 256).alias("digest"))
    # An archive is bounded, and so is its window.
    before = Window.partitionBy("archive").orderBy("page_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return narrow.select("archive", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"), "length", "digest", "page_id")


def write_archives(rows: DataFrame, path: str) -> None:
    """One compressed file per archive, records in page order (equal ids by digest)."""
    ordered = rows.withColumn("digest", F.sha2("record", 256)).repartition("archive").sortWithinPartitions("archive", "page_id", "digest")
    line = F.expr("substring(record, 1, length(record) - 1)").alias("value")
    ordered.select("archive", line).write.partitionBy("archive").option("lineSep", "\n").option("compression", "gzip").text(path)


def inflate(content: bytes) -> bytes:
    """The plain bytes of an archive; of a damaged one, as far as it can be read."""
    out = []
    while content[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(wbits=31)
        try:
            # In steps, so that what precedes the damage is kept.
            for at in range(0, len(content), 1 << 16):
                out.append(member.decompress(content[at : at + (1 << 16)]))
                if member.eof:
                    content = member.unused_data + content[at + (1 << 16) :]
                    break
            else:
                return b"".join(out)
        except zlib.error:
            return b"".join(out)
    return b"".join(out) if out else content


def parse_archive(content: bytes) -> Iterator[tuple[int, int, str, int | None]]:
    """(offset, length, digest, page id) of each record; what cannot be read is one last record."""
    at = 0
    while at < len(content):
        head = content.find(b"\r\n\r\n", at)
        header = content[at:head] if head >= 0 else b""
        size = _LENGTH.search(header) if header.startswith(b"WARC/") else None
        end = head + 4 + int(size[1]) + 4 if size else len(content)
        end = min(end, len(content))
        page = _PAGE.search(header)
        yield at, end - at, hashlib.sha256(content[at:end]).hexdigest(), int(page[1]) if page else None
        at = end


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Leaves ``(archive, offset, length, digest, page_id)`` of written archives."""
    schema = "archive bigint, offset bigint, length bigint, digest string, page_id bigint"
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column("archive").to_pylist(), batch.column("content")):
                found = [(archive, *r) for r in parse_archive(inflate(content.as_buffer().to_pybytes()))]
                columns = list(zip(*found)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["archive", "offset", "length", "digest", "page_id"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    archive = F.regexp_extract("path", r"archive=(-?\d+)", 1).cast("bigint").alias("archive")
    return files.select(archive, "content").mapInArrow(run, schema)


def tree(leaves: DataFrame, levels: int, range_bytes: int, fanout: int) -> list[DataFrame]:
    """Node tables ``(archive, node, hash)``, lowest level first."""

    def hashed(rows: DataFrame, node: Column, order: Column, text: Column) -> DataFrame:
        grouped = rows.groupBy("archive", node.alias("node")).agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), text.alias("t")))).alias("x"))
        return grouped.select("archive", "node", F.sha2(F.array_join(F.transform("x", lambda x: x["t"]), "\n"), 256).alias("hash"))

    line = F.concat_ws(" ", "offset", "length", "digest")
    # Each level is written, so that the next one and the descent start from it.
    out = [materialise(hashed(leaves, F.floor(F.col("offset") / range_bytes), F.col("offset"), line), "merkle")]
    for _ in range(levels - 1):
        above = hashed(out[-1], F.floor(F.col("node") / fanout), F.col("node"), F.concat_ws(" ", "node", "hash"))
        out.append(materialise(above, "merkle"))
    return out


def _levels(top: int, fanout: int) -> int:
    levels, nodes = 1, top + 1
    while nodes > 1:
        nodes, levels = -(-nodes // fanout), levels + 1
    return levels


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    b = b.select(F.col("archive").alias("archive_b"), F.col("node").alias("node_b"), F.col("hash").alias("hash_b"))
    joined = a.join(b, (F.col("archive") == F.col("archive_b")) & (F.col("node") == F.col("node_b")), "full_outer")
    return joined.where(~F.col("hash").eqNullSafe(F.col("hash_b"))).select(
        F.coalesce("archive", "archive_b").alias("archive"), F.coalesce("node", "node_b").alias("node")
    )


def audit(first: DataFrame, second: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """Records that differ: ``(archive, offset, length, page_id, status)``.

    Both tables are leaves, as from ``catalogue`` or ``read_archives``; they are read more
    than once, so give written tables. ``status`` is ``changed``, ``missing`` (not in
    ``second``) or ``extra``; length and page id are those of ``first``, if it has the
    record. Equal replicas and empty tables give no rows. Repeated records are leaves of
    their own, at their own offsets.
    """
    top = first.select("offset").unionAll(second.select("offset")).agg(F.max("offset")).first()[0] or 0
    levels = _levels(top // range_bytes, fanout)
    trees = [tree(x, levels, range_bytes, fanout) for x in (first, second)]
    bad = _differing(trees[0][-1], trees[1][-1])
    for low in range(levels - 2, -1, -1):
        parents = bad.select("archive", F.col("node").alias("parent"))
        below = [
            t[low].withColumn("parent", F.floor(F.col("node") / fanout)).join(parents, ["archive", "parent"], "left_semi").drop("parent")
            for t in trees
        ]
        bad = materialise(_differing(*below), "differing")
    ranges = bad.select("archive", F.col("node").alias("range"))
    near = [x.withColumn("range", F.floor(F.col("offset") / range_bytes)).join(ranges, ["archive", "range"], "left_semi") for x in (first, second)]
    a, b = near[0].alias("a"), near[1].alias("b")
    joined = a.join(b, (F.col("a.archive") == F.col("b.archive")) & (F.col("a.offset") == F.col("b.offset")), "full_outer")
    differs = joined.where(~F.col("a.digest").eqNullSafe(F.col("b.digest")))
    status = F.when(F.col("b.archive").isNull(), "missing").when(F.col("a.archive").isNull(), "extra").otherwise("changed")
    return differs.select(
        *(F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in ("archive", "offset", "length", "page_id")), status.alias("status")
    )
