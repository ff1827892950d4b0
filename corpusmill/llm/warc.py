"""Legacy archive converter: ARC records to WARC records.

``arc_archive`` writes pages as ARC version 1 or 2, ``arc_records`` parses
either version by its header line and the declared lengths, and
``convert_pages`` turns them into WARC files: record ids, ISO dates, types and
digests are synthesised. Of records with equal payloads of at least
``min_revisit`` bytes the one with the smallest page_id is a response and the
others revisit it. ``read_warc`` reads the files back.

Nulls: a null html is an empty payload, a null url an empty one; a row with a
null page_id is never referred to and revisits when its payload is that of a
row with an id. Rows that repeat the smallest page_id of a group are all
responses (a record cannot revisit itself). An empty table gives no record.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import common
from corpusmill.llm.common import pick

MIN_REVISIT = 100
ARC_DATE = "20000101000000"        # pages carry no capture time
SLICE = 256                        # pages that one in-memory ARC archive holds
# Fixed values of the two archive formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
WARC_VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_END = "\r\n\r\n"

_UNSAFE = re.compile(r"[\x00-\x20\x7f%]")
WARC_SCHEMA = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
               "record_id string, target_uri string, warc_date string, payload_ok boolean")


# ---------------------------------------------------------------- ARC
def arc_url(url: str | None) -> str:
    """An url as one header field: white space and '%' are percent-encoded."""
    return _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url or "") or "-"


def arc_archive(pages: list[tuple[str | None, bytes]], version: int, name: str = "pages.arc") -> bytes:
    """An ARC archive: the filedesc record, then one record per (url, html)."""
    fields = ARC_FIELDS[version]
    intro = f"{version} 0 corpusmill\n{fields}\n\n".encode()
    extra = "200 - - 0 " + name + " " if version == 2 else ""
    parts = [f"filedesc://{name} 0.0.0.0 {ARC_DATE} text/plain {extra}{len(intro)}\n".encode(), intro, b"\n"]
    for url, html in pages:
        doc = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html) + html
        offset = sum(map(len, parts)) if version == 2 and len(parts) < 8 else 0
        extra = f"200 {zlib.crc32(html):08x} - {offset} {name} " if version == 2 else ""
        parts += [f"{arc_url(url)} 0.0.0.0 {ARC_DATE} text/html {extra}{len(doc)}\n".encode(), doc, b"\n"]
    return b"".join(parts)


def arc_records(data: bytes) -> Iterator[dict]:
    """Records of an ARC archive, by the version that its first record states
    and each record's declared length; raises on anything else."""
    at, version = 0, None
    while at < len(data):
        if data[at:at + 1] == b"\n":           # separator
            at += 1
            continue
        end = data.index(b"\n", at)
        line = data[at:end].decode("utf-8")
        got = line.split(" ")
        if version is None:
            if not line.startswith("filedesc://"):
                raise ValueError("an ARC archive starts with a filedesc record")
            length = int(got[-1])
            block = data[end + 1:end + 1 + length]
            version = int(block.split(b" ", 1)[0])
            names = block.split(b"\n")[1].decode().split(" ")
            if " ".join(names) != ARC_FIELDS.get(version):
                raise ValueError(f"unknown ARC version {version}")
        else:
            if len(got) != len(names):
                raise ValueError(f"{len(got)} fields in a version {version} header of {len(names)}")
            record = dict(zip(names, got))
            length = int(record["Archive-length"])
            if end + 1 + length > len(data):
                raise ValueError("a record is shorter than its declared length")
            record["block"] = data[end + 1:end + 1 + length]
            record["version"] = version
            yield record
        at = end + 1 + length


# ---------------------------------------------------------------- WARC
def warc_date(arc_date: str) -> str:
    d = (arc_date + "00000000000000")[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(page_id, url: str, date: str) -> str:
    """The same identifier whenever the same record is converted again."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {date} {url}')}>"


def warc_record(arc: dict, page_id, refers_to) -> bytes:
    """An ARC record as a WARC record (without the closing empty lines)."""
    head, _, payload = arc["block"].partition(b"\r\n\r\n")
    date, url = warc_date(arc["Archive-date"]), arc["URL"]
    digest = hashlib.sha256(payload).hexdigest()
    kind = "response" if refers_to is None else "revisit"
    block = head + b"\r\n\r\n" + (payload if kind == "response" else b"")
    lines = [WARC_VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, url, date)}", f"WARC-Date: {date}",
             f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha256:{digest}",
             f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"X-Refers-To-Page-Id: {refers_to}",
                  f"WARC-Refers-To: {record_id(refers_to, url, date)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def warc_records(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """(header fields, block) of each record, by the declared lengths; a gzip
    file (also of several members) is unpacked first."""
    if data[:2] == b"\x1f\x8b":
        parts = []
        while data:
            d = zlib.decompressobj(31)
            parts.append(d.decompress(data))
            data = d.unused_data
        data = b"".join(parts)
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *rest = data[at:end].decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(x.split(": ", 1) for x in rest)
        length = int(fields["Content-Length"])
        block = data[end + 4:end + 4 + length]
        if len(block) < length or data[end + 4 + length:end + 8 + length] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut short")
        yield fields, block
        at = end + 8 + length


# ---------------------------------------------------------------- Spark
def _revisits(pages: DataFrame, min_revisit: int) -> DataFrame:
    """(page_id, digest, first): rows whose payload an earlier page has."""
    meta = pages.select("page_id", F.sha2("html", 256).alias("digest"), F.octet_length("html").alias("n")) \
        .where(F.col("n") >= min_revisit)
    first = meta.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("rows")) \
        .where("rows > 1 and first is not null").select("digest", "first")
    return meta.join(first, "digest").where("not (page_id <=> first)").select("page_id", "digest", "first").distinct()


def convert_pages(pages: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url", html: str = "html",
                  min_revisit: int = MIN_REVISIT) -> None:
    """Write all pages as WARC files (gzip) under ``path``, in any store Spark writes to.

    Only (page_id, digest) pairs are grouped; payloads move once, keyed by
    (page_id, digest), so copies of one payload spread over all tasks.
    """
    src = pick(pages, page_id=(page_id, "long"), url=(url, "string"), html=(html, "string")) \
        .withColumn("html", F.coalesce("html", F.lit("")))
    again = _revisits(src, min_revisit)
    both = src.withColumn("digest", F.sha2("html", 256)).alias("p").join(
        again.alias("r"), F.expr("coalesce(p.page_id, -1) = coalesce(r.page_id, -1) and p.page_id <=> r.page_id "
                                 "and p.digest = r.digest"), "left") \
        .select("p.page_id", "p.url", "p.html", F.col("r.first").alias("refers_to"))

    def to_warc(batches):
        info = (f"{WARC_VERSION}\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\n"
                f"WARC-Date: {warc_date(ARC_DATE)}\r\nContent-Type: application/warc-fields\r\nContent-Length: 22\r\n\r\n"
                "software: corpusmill\r\n")
        yield pa.RecordBatch.from_arrays([pa.array([info])], ["value"])
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                ids, to = part["page_id"].to_pylist(), part["refers_to"].to_pylist()
                docs = list(zip(part["url"].to_pylist(), part["html"].cast(pa.binary()).to_pylist()))
                out = []
                for version in ARC_FIELDS:             # every other page as either version
                    own = [i for i, x in enumerate(ids) if (x or 0) % 2 + 1 == version]
                    arcs = arc_records(arc_archive([docs[i] for i in own], version))
                    out += [warc_record(arc, ids[i], to[i]) for i, arc in zip(own, arcs, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], ["value"])

    both.mapInArrow(to_warc, "value string").write.option("lineSep", RECORD_END).option("compression", "gzip").text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per response or revisit record under ``path``; payload_ok tells
    whether a response's payload has the digest and length that it states."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")

    def parse(batches):
        for b in batches:
            for data in b["content"]:
                rows = []
                for f, block in warc_records(data.as_py()):
                    if f["WARC-Type"] == "warcinfo":
                        continue
                    head, _, payload = block.partition(b"\r\n\r\n")
                    declared = int(re.search(rb"(?im)^Content-Length: (\d+)", head)[1])
                    digest = f["WARC-Payload-Digest"].partition(":")[2]
                    whole = f["WARC-Type"] == "response"
                    ok = not whole or hashlib.sha256(payload).hexdigest() == digest and len(payload) == declared
                    rows.append((int(f["X-Page-Id"]) if "X-Page-Id" in f else None, len(payload) if whole else declared, digest,
                                 f["WARC-Type"], int(f["X-Refers-To-Page-Id"]) if not whole else None, f["WARC-Record-ID"],
                                 unquote(f["WARC-Target-URI"]), f["WARC-Date"], ok))
                cols = list(zip(*rows)) or [[] for _ in range(9)]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)],
                                                 [x.split()[0] for x in WARC_SCHEMA.split(", ")])

    return files.mapInArrow(parse, WARC_SCHEMA)


def pages_through_warc(pages: DataFrame, **names) -> DataFrame:
    """Write the pages as WARC in the shared scratch folder and read them back."""
    spark = pages.sparkSession
    path = common.scratch_dir(spark, "warc")
    convert_pages(pages, path, **names)
    common._MADE.append(path)
    return read_warc(spark, path)
