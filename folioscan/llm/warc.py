"""WARC 1.1 archives: a writer in DataFrame operations and a salvage reader.

The writer makes a record of each page. Of pages with equal payloads of at least ``revisit_bytes`` the one
with the smallest id is a response; the others are revisits, which carry the digest and refer to it. Records
are text, so Spark's own text sink writes them to any file system, gzip-compressed if asked.

The reader takes whole archive files. Plain files and single gzip streams are read from version line to
version line; archives with a gzip member for each record are read member by member. When a record fails a
check (version line, header, length, closing line ends, digest, gzip checksum), the reader looks for the next
version line or gzip member that does pass, goes on from there, and logs the bytes between as a gap. A payload can
itself hold something that looks like a record: where only the digest is wrong, the reader goes on behind the whole
record, and a record that it finds by searching must name its type and id and, if the archive's headers before it
have digests, a digest that agrees.

A task holds one archive file (at most 2 GB, Spark's limit of a binary file) and what one gzip member of it holds;
the writer's files are of ``FILE_BYTES``.

Defined cases: a url, and with it a header, may have any length; a null html is an empty payload; a null page id is written as an empty one and read as null;
a page without an id is always a response; pages
that share an id and a payload are responses, or revisits of one, together; extra columns are not written.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm.textblocks import column

CRLF = "\r\n"
VERSION = b"WARC/1."
#: Bytes at a file's start by which a damaged gzip archive is told from a plain one.
SNIFFED = 1 << 16
#: Bytes of payloads and urls that a file of an archive should hold, before compression.
FILE_BYTES = 8 << 20
FIELDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
RECORD = "file string, begin long, end long, kind string, reason string, url string, payload binary, " + FIELDS


def records(pages: DataFrame, revisit_bytes: int = 100, parts: int | None = None) -> DataFrame:
    """page_id, bytes, and the record as text without its last four bytes, which the sink adds; in ``parts`` partitions."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), html.alias("html"))
    rows = rows.withColumns({"digest": F.sha2("html", 256), "bytes": F.octet_length("html").cast("long")})
    # Who refers to whom is settled without the payloads; groups are pre-aggregated in each task.
    large = rows.where(F.col("bytes") >= revisit_bytes).select("page_id", "digest")
    firsts = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    again = large.join(firsts, "digest").where("first <> page_id").distinct()
    # The payloads move once, by page, which spreads any group of them.
    named = rows.repartition(parts, "page_id", "digest") if parts else rows
    return named.join(again, ["page_id", "digest"], "left").select("page_id", "bytes", _record().alias("record"))


def _record():
    again = F.col("first").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    own = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "")
    payload = F.when(again, F.lit("")).otherwise(F.col("html"))
    return F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), own, F.lit(">"))),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("X-Payload-Length", F.col("bytes").cast("string")),
        F.when(again, line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.octet_length(payload).cast("string")),
        F.lit(CRLF),
        payload,
    )


def write_archives(pages: DataFrame, path: str, revisit_bytes: int = 100, compression: str = "gzip", file_bytes: int = FILE_BYTES) -> None:
    """The pages as archive files under ``path``, of about ``file_bytes`` each before compression."""
    held = [F.coalesce(F.octet_length(x), F.lit(0)).cast("long") for x in ("html", "url")]
    total = pages.agg(F.coalesce(F.sum(held[0] + held[1]), F.lit(0))).first()[0]
    files = max(int(total // file_bytes) + 1, 1)
    records(pages, revisit_bytes, files).select("record").write.option("lineSep", CRLF + CRLF).option("compression", compression).text(path)


def _header(data: bytes, at: int) -> tuple[dict[str, str] | None, int, str]:
    """(fields or none, where the payload begins, what is wrong) of the header whose version line is at ``at``.

    A header of any length is read, line by line to an empty one; the version line of another record or a line
    without a colon ends the search, so that damage is not read to the end of the file.
    """
    other = data.find(VERSION, at + 1)
    close = data.find(b"\r\n", at, other if other >= 0 else len(data))
    if close < 0:
        return None, at, "no end of header"
    out = {}
    while True:
        begin = close + 2
        close = data.find(b"\r\n", begin)
        if close < 0 or data.startswith(VERSION, begin):
            return None, at, "no end of header"
        if close == begin:
            return out, begin + 2, ""
        name, colon, value = data[begin:close].decode("utf-8", "replace").partition(":")
        if not colon:
            return None, at, "broken header"
        out[name.strip().lower()] = value.strip()


def _urn(text: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", text)
    return int(found[1]) if found else None


def parse_record(data: bytes, at: int) -> tuple[dict | None, int, str]:
    """(record or none, where it ends, what is wrong) of the record that should begin at ``at``.

    Of what is no good record the end is ``at``, or, if its length is borne out and only its digest is not, its end.
    """
    if not data.startswith(VERSION, at):
        return None, at, "no version line"
    head, begin, wrong = _header(data, at)
    if head is None:
        return None, at, wrong
    if not head.get("content-length", "").isdigit():
        return None, at, "broken header"
    end = begin + int(head["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        return None, at, "length does not meet the closing line ends"
    payload, kind = data[begin:end], head.get("warc-type", "")
    digest = head.get("warc-payload-digest", "").removeprefix("sha256:")
    if kind != "revisit" and digest and hashlib.sha256(payload).hexdigest() != digest:
        return None, end + 4, "digest differs"
    size = head.get("x-payload-length", "")
    record = {"url": head.get("warc-target-uri"), "payload": payload, "page_id": _urn(head.get("warc-record-id", "")), "payload_bytes": int(size) if size.isdigit() else len(payload), "payload_digest": digest or hashlib.sha256(payload).hexdigest(), "record_type": kind, "refers_to": _urn(head.get("warc-refers-to", ""))}
    return record, end + 4, ""


def _found(data: bytes, at: int, digests: bool) -> int:
    """Where the next record that identifies itself begins, from ``at`` on; else the end of the data."""
    at = data.find(VERSION, at)
    while at >= 0:
        if parse_record(data, at)[0] is not None:
            head = _header(data, at)[0] or {}
            if head.get("warc-type") and head.get("warc-record-id") and (head.get("warc-payload-digest") or not digests):
                return at
        at = data.find(VERSION, at + 1)
    return len(data)


def salvage(data: bytes) -> Iterator[dict]:
    """Records and gaps of plain WARC bytes, in order; together they cover every byte."""
    at, digests = 0, False
    while at < len(data):
        record, end, wrong = parse_record(data, at)
        if data.startswith(VERSION, at):
            digests |= bool((_header(data, at)[0] or {}).get("warc-payload-digest"))
        if record is not None:
            yield {"kind": "record", "begin": at, "end": end, "reason": None, **record}
        else:
            if end == at:
                end = _found(data, at + 1, digests)
            yield {"kind": "gap", "begin": at, "end": end, "reason": wrong}
        at = end


def _member(data: bytes, at: int) -> tuple[bytes, int, str]:
    """(what a gzip member holds, where it ends, what is wrong). On damage, what came before it."""
    inflate = zlib.decompressobj(wbits=31)
    out = []
    try:
        for k in range(at, len(data), 1 << 16):
            out.append(inflate.decompress(data[k : k + (1 << 16)]))
            if inflate.eof:
                return b"".join(out), min(k + (1 << 16), len(data)) - len(inflate.unused_data), ""
        return b"".join(out), at, "member is cut off"
    except zlib.error as e:
        return b"".join(out), at, f"gzip: {e}"[:80]


def salvage_file(data: bytes) -> Iterator[dict]:
    """Records and gaps of an archive file. Offsets are those of the file; for gzip members, of the member."""
    if data[:2] != b"\x1f\x8b":
        if b"\x1f\x8b\x08" not in data[:SNIFFED] or VERSION in data[:SNIFFED]:
            yield from salvage(data)
            return
    at, bad, why = 0, None, ""
    while at < len(data):
        held, end, wrong = _member(data, at) if data.startswith(b"\x1f\x8b\x08", at) else (b"", at, "no gzip member")
        # Of a damaged member, whole records before the damage are still good.
        found = [x for x in salvage(held) if not wrong or x["kind"] == "record"] if held else []
        good = not wrong or bool(found)
        if good and bad is not None:
            yield {"kind": "gap", "begin": bad, "end": at, "reason": why}
            bad = None
        for x in found:
            yield x | ({"begin": at, "end": end if not wrong else at} if x["kind"] == "record" else {"begin": at, "end": end})
        if not wrong:
            at = end
            continue
        if bad is None:
            bad, why = at, wrong
        at = data.find(b"\x1f\x8b\x08", at + 1)
        at = len(data) if at < 0 else at
    if bad is not None:
        yield {"kind": "gap", "begin": bad, "end": len(data), "reason": why}


def _read(with_payload: bool):
    names = [f.split()[0] for f in RECORD.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(column(batch, "path"), column(batch, "content"), strict=True):
                rows: list[dict] = []
                size = 0

                def out(rows=rows):
                    return pa.record_batch([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types, strict=True)], names)

                for x in salvage_file(data.as_py() or b""):
                    x["file"] = name.as_py()
                    if not with_payload:
                        x.pop("payload", None)
                    size += len(x.get("payload") or b"") + len(x.get("url") or "") + 200
                    rows.append(x)
                    if size > 4 << 20:
                        yield out()
                        rows.clear()
                        size = 0
                if rows:
                    yield out()

    return read


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Rows of kind record or gap: file, begin, end, reason, url, payload and the fields of the record."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(_read(with_payload), RECORD)


def gaps(read: DataFrame) -> DataFrame:
    """The quarantine log: file, begin, end, reason."""
    return read.where("kind = 'gap'").select("file", "begin", "end", "reason")


def round_trip(pages: DataFrame, path: str, revisit_bytes: int = 100) -> DataFrame:
    """The pages written to archives under ``path`` and read back: the fields of each record."""
    write_archives(pages, path, revisit_bytes)
    read = read_archives(pages.sparkSession, path, with_payload=False)
    return read.where("kind = 'record'").select(*[f.split()[0] for f in FIELDS.split(", ")])
