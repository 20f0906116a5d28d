"""WARC archives: records written by Spark tasks, an index of them, and coalesced byte-range reads of what is selected."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, new_dir, read, small, write_table

INDEX = "page_id long, url string, digest string, record_type string, refers_to long, file string, offset long, length long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _store(uri: str):
    """The store behind a URI of any scheme that pyarrow opens (file, hdfs, s3, gs), and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _qualified(spark: SparkSession, path: str) -> str:
    """path as a URI; one without a scheme lies in the file system that is Spark's default, as for any table."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()


def _header(url: object) -> str:
    """A URL as one header line: blanks and control characters percent-encoded."""
    return "" if url is None else "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in str(url))


def _record(page: int | None, url: object, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record, gzipped on its own. A revisit has the HTTP header only; Content-Length tells its payload's size."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {date}", f"WARC-Target-URI: {_header(url)}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join([*lines, "", ""]).encode() + block + b"\r\n\r\n") + pack.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Header, HTTP header and payload of one gzip member. Raises ValueError where the block is cut short."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"record {fields.get('WARC-Record-ID')} is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def write_archives(pages: DataFrame, out_dir: str, min_payload: int = 0, file_bytes: int = 1 << 30, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes one record per row of pages (page_id, url, html) under out_dir and returns the index, itself a table there.

    Of rows with equal payloads of at least min_payload bytes, that with the smallest page_id becomes a response and
    the others revisits of it. Rows that repeat the smallest page_id are responses too, as are rows without a page_id;
    null html is an empty payload; a null url is an empty one. Extra columns are ignored; an empty table gives an empty
    index. Each task attempt writes files of its own and the index names only those of attempts that ended, so that a
    lost executor costs its tasks, not the archive. Only digests and ids are grouped, never payloads; the table of
    repeated digests is broadcast up to 500,000 rows, of under 100 bytes each, and joined by a shuffle beyond.
    """
    bounded_batches(pages.sparkSession)
    out_dir = _qualified(pages.sparkSession, out_dir)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.withColumn("_hex", F.sha1(F.encode("html", "UTF-8")))
    heads = rows.where(F.octet_length("html") >= min_payload).groupBy("_hex").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    first = F.when(F.octet_length("html") >= min_payload, F.col("_first"))
    heads = write_table(heads.select("_hex", "_first"), "warc-heads")
    rows = rows.join(F.broadcast(heads) if small(heads, 500_000) else heads, "_hex", "left").select("page_id", "url", "html", F.when(first != F.col("page_id"), first).alias("refers_to"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _store(out_dir)
        fs.create_dir(base, recursive=True)
        task, files, sink, at = TaskContext.get(), 0, None, 0
        try:
            for batch in batches:
                out = []
                for page, url, html, to in zip(batch["page_id"], batch["url"], batch["html"], batch["refers_to"], strict=True):
                    page, to = (None if pd.isna(x) else int(x) for x in (page, to))
                    payload = html.encode()
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    if sink is None or at >= file_bytes:
                        if sink is not None:
                            sink.close()
                        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{files:04d}.warc.gz"
                        sink, at, files = fs.open_output_stream(f"{base}/{name}", compression=None), 0, files + 1
                    member = _record(page, url, payload, digest, to, date)
                    sink.write(member)
                    out.append((page, url, digest, "response" if to is None else "revisit", to, name, at, len(member)))
                    at += len(member)
                frame = pd.DataFrame(out, columns=["page_id", "url", "digest", "record_type", "refers_to", "file", "offset", "length"])
                yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})
        finally:
            if sink is not None:
                sink.close()

    return write_table(rows.mapInPandas(write, INDEX), "warc-index")


def read_records(selected: DataFrame, in_dir: str, gap: int = 64 << 10, most: int = 8 << 20, payloads: bool = True, slice_bytes: int = 64 << 20) -> DataFrame:
    """The records of selected rows of an index, read back from the archives in in_dir.

    Index rows are dealt out by slices of slice_bytes of a file, about one to a task, and sorted; a task joins neighbours
    that lie at most gap bytes apart into one read of at most most bytes (or of one larger record). The digest of each
    response is checked. An empty selection gives no rows.
    """
    bounded_batches(selected.sparkSession)
    in_dir = _qualified(selected.sparkSession, in_dir)
    dealt = selected.select("file", "offset", "length", F.floor(F.col("offset") / slice_bytes).alias("_slice"))
    n = dealt.select("file", "_slice").distinct().count()
    order = dealt.repartitionByRange(max(n, 1), "file", "_slice").sortWithinPartitions("file", "offset").drop("_slice")

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _store(in_dir)
        name = source = None
        for batch in batches:
            spans: list[list] = []
            for file, start, length in zip(batch["file"], batch["offset"], batch["length"], strict=True):
                last = spans[-1] if spans else None
                if last and last[0] == file and start - last[2] <= gap and start + length - last[1] <= most:
                    last[2] = start + length
                    last[3].append((start, length))
                else:
                    spans.append([file, start, start + length, [(start, length)]])
            for file, start, end, parts in spans:
                if file != name:
                    name, source = file, fs.open_input_file(f"{base}/{file}")
                data, out = source.read_at(end - start, start), []
                for at, length in parts:
                    fields, http, payload = parse_record(data[at - start : at - start + length])
                    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"{file} at {at}: the payload doesn't match its digest")
                    ids = [fields.get(k, "<urn:page:>")[10:-1] for k in ("WARC-Record-ID", "WARC-Refers-To")]
                    page, to = (int(x) if x else None for x in ids)
                    out.append((page, fields["WARC-Target-URI"], int(http["Content-Length"]), digest, kind, to, payload if payloads else None))
                frame = pd.DataFrame(out, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
                yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})

    return order.mapInPandas(fetch, RECORD)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out_dir = new_dir(spark, "warc")
    index = write_archives(read(spark, sf_dir, "pages"), out_dir)
    return read_records(index, out_dir, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base32 in SQL: 40 hex digits are 32 groups of 5 bits.
OP1_SQL = """
with h as (select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha1(coalesce(html, '')) as x from pages),
b as (select page_id, payload_bytes, list_reduce(list_prepend('', list_transform(range(40), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * ('0x' || substr(x, i + 1, 1))::int + 1, 4))), lambda a, c: a || c) as bits from h),
d as (select page_id, payload_bytes, list_reduce(list_prepend('', list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', list_reduce(list_prepend(0, list_transform(range(5), lambda j: substr(bits, 5 * i + j + 1, 1)::int)), lambda a, c: 2 * a + c) + 1, 1))), lambda a, c: a || c) as payload_digest from b),
f as (select *, min(page_id) over (partition by payload_digest) as first from d)
select page_id, payload_bytes, payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to from f
"""
