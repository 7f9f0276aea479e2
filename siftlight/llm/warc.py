"""WARC archives: a writer with identical-payload revisits and a reader that salvages what damaged archives still hold.

Each record is one gzip member. Spark's text writer puts bundles of members into files, separated by an empty member, so
archives live wherever Spark can write; whole files come back through the binary file source. Files are bounded by bytes:
``FILE_BUNDLES`` bundles of ``BUNDLE_BYTES`` (a longer member is a bundle of its own).

The reader takes members of one or many records, and archives without compression. It checks every record: version
line, headers, length, end, and its digests if there are any of a known kind. After a failed check it searches for the
next valid member or version line, inside a member too, goes on from there, and logs the bytes between as quarantined;
of a member that breaks off or is damaged it reads what zlib gave before the fault, but for the record at the fault.

Defined results: null html is an empty payload; a page without id is always written as a response; rows that repeat an
id with the same payload are all responses if that id is the smallest; payloads under ``MIN_REVISIT`` bytes are
always responses; an empty table gives an archive without records; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path

MIN_REVISIT = 100
BUNDLE_BYTES, FILE_BUNDLES = 4 << 20, 16
#: A gzip member that holds nothing, and the profile of revisits by digest.
EMPTY_MEMBER = bytes.fromhex("1f8b080000000000000303000000000000000000")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: start, end: bytes of the member (or plain record) in the file; inside_start, inside_end: of a gap in its content.
RECORDS = """file string, start long, end long, kind string, page_id long, refers_to long, payload_bytes long, payload_digest string, payload binary, reason string,
record_id string, target_uri string, inside_start long, inside_end long"""
VERSION = re.compile(rb"WARC/[01]\.\d{1,2}\r\n")


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def record(page_id: int | None, url: str | None, payload: bytes | None, n_bytes: int, digest: str, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for page, url, body, n, digest in zip(*(b.column(c).to_pylist() for c in ("page_id", "url")), b.column("html"), *(b.column(c).to_pylist() for c in ("payload_bytes", "digest")), strict=True):
            out.append(gzip_member(record(page, url, body.as_buffer().to_pybytes(), n, digest, None)))
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), b.column("payload_bytes"), b.column("digest"), pa.array(out, pa.binary())], names=["page_id", "url", "payload_bytes", "digest", "member"])


def _bundles(most: int):
    """Members, revisits made in passing, joined into bundles of at most so many bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        row = lambda: pa.RecordBatch.from_arrays([pa.array([EMPTY_MEMBER.join(held)], pa.binary())], names=["member"])
        for b in batches:
            for page, url, n, digest, member, first in zip(*(b.column(c) for c in ("page_id", "url", "payload_bytes", "digest", "member", "refers_to")), strict=True):
                first = first.as_py()
                member = member.as_py() if first is None else gzip_member(record(page.as_py(), url.as_py(), None, n.as_py(), digest.as_py(), first))
                if held and size + len(member) > most:
                    yield row()
                    held, size = [], 0
                held.append(member)
                size += len(member)
        if held:
            yield row()

    return run


def write_archives(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT, bundle_bytes: int = BUNDLE_BYTES, file_bundles: int = FILE_BUNDLES) -> str:
    """Write a record per row (page_id, url, html) into gzip-per-record archives under ``path``."""
    html = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select("page_id", "url", html.cast("binary").alias("html"), F.octet_length(html).cast("bigint").alias("payload_bytes"), F.sha2(html, 256).alias("digest"))
    slim = p.filter(F.col("payload_bytes") >= min_revisit).select("page_id", "digest")
    # One row per repeated payload (combined before the shuffle), then one per page that is not its first.
    firsts = slim.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = slim.join(firsts, "digest").filter(F.col("page_id") > F.col("refers_to")).distinct()
    members = p.mapInArrow(_members, "page_id long, url string, payload_bytes long, digest string, member binary")
    joined = members.join(later, ["page_id", "digest"], "left").select("page_id", "url", "payload_bytes", "digest", F.when(F.col("refers_to").isNull(), F.col("member")).alias("member"), "refers_to")
    out = joined.mapInArrow(_bundles(bundle_bytes), "member binary").select(F.col("member").cast("string"))
    (out.write.format("text").option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1"))
        .option("maxRecordsPerFile", file_bundles).save(path))
    return path


def _inflate(data: memoryview, at: int) -> tuple[bytes, int | None]:
    """What the gzip member at ``at`` holds, and its end; None if it breaks off or is damaged."""
    unpacker, out, pos, step = zlib.decompressobj(31), [], at, 65536
    while not unpacker.eof and pos < len(data):
        before = unpacker.copy()
        try:
            out.append(unpacker.decompress(data[pos:pos + step]))
            pos = min(pos + step, len(data))
        except zlib.error:
            if step == 1:
                return b"".join(out), None
            unpacker, step = before, 256 if step > 256 else 1  # up to the fault in smaller pieces
    return b"".join(out), pos - len(unpacker.unused_data) if unpacker.eof else None


def _agrees(given: str | None, content: bytes) -> bool | None:
    """Whether a digest (algorithm:value in hex or base32) is that of the content; None if there is none to check."""
    algorithm, _, value = (given or "").partition(":")
    if algorithm.lower() not in ("md5", "sha1", "sha256", "sha512"):
        return None
    real = hashlib.new(algorithm.lower(), content).digest()
    return value.lower() == real.hex() or value.upper().rstrip("=") == base64.b32encode(real).decode().rstrip("=")


def _record_at(data: bytes, at: int) -> tuple[dict, int] | str:
    """The checked record whose version line is at ``at`` and its end, or what is wrong."""
    if not VERSION.match(data, at):
        return "no version line"
    head_end = data.find(b"\r\n\r\n", at)
    if head_end < 0:
        return "headers do not end"
    head, name = {}, None
    for line in data[at:head_end].split(b"\r\n")[1:]:
        if line[:1] in (b" ", b"\t") and name:  # a folded header
            head[name] += " " + line.strip().decode("utf-8", "replace")
            continue
        key, colon, value = line.partition(b":")
        if not colon:
            return "malformed header"
        name = key.strip().lower().decode("latin-1")
        head[name] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch(r"\d{1,18}", head.get("content-length", "")):
        return "no length"
    start = head_end + 4
    end = start + int(head["content-length"])
    if end > len(data):
        return "truncated block"
    block = data[start:end]
    checked = _agrees(head.get("warc-block-digest"), block)
    if checked is False:
        return "block digest differs"
    if data[end:end + 4] != b"\r\n\r\n":
        return "no record end"
    return head | {"block": block, "checked": checked}, end + 4


def _row(head: dict) -> dict | str:
    """The fields of a checked record of any type."""
    urn = re.compile(r"<urn:page:(-?\d*)>")
    own, first = urn.fullmatch(head.get("warc-record-id", "")), urn.fullmatch(head.get("warc-refers-to", ""))
    kind, block, digest = head.get("warc-type"), head["block"], head.get("warc-payload-digest", "")
    if not kind:
        return "no record type"
    page = lambda m: int(m[1]) if m and m[1] else None
    row = {"kind": kind, "page_id": page(own), "record_id": head.get("warc-record-id"), "target_uri": head.get("warc-target-uri"), "refers_to": page(first), "payload_digest": digest.removeprefix("sha256:") or None, "payload_bytes": None, "payload": None}
    if kind == "revisit":
        length = re.search(rb"(?i)\r\ncontent-length:\s*(\d{1,18})", block.partition(b"\r\n\r\n")[0])
        return row | {"payload_bytes": int(length[1]) if length else None}
    payload = block
    if kind in ("response", "request") and head.get("content-type", "application/http").startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2]
    if kind in ("response", "resource", "conversion"):
        # The digest of a payload may be taken before its transfer encoding: it decides only where no block digest did.
        if not head["checked"] and _agrees(digest, payload) is False:
            return "payload digest differs"
        row["payload_digest"] = hashlib.sha256(payload).hexdigest()
    return row | {"payload_bytes": len(payload), "payload": payload}


def _records(content: bytes) -> Iterator[tuple[int, int, dict | str, bool]]:
    """(start, end, record or what is wrong, whether its block digest agreed) over the content of a member; after a fault,
    on at the next good record."""
    at = 0
    while at < len(content):
        got = _record_at(content, at)
        row = got if isinstance(got, str) else _row(got[0])
        if not isinstance(row, str):
            yield at, got[1], row, bool(got[0]["checked"])
            at = got[1]
            continue
        start, why = at, row
        while isinstance(row, str) and at < len(content):
            nxt = VERSION.search(content, at + 1)
            at = nxt.start() if nxt else len(content)
            got = _record_at(content, at) if nxt else ""
            row = got if isinstance(got, str) else _row(got[0])
        yield start, at, why, False


def salvage(data: bytes) -> Iterator[dict]:
    """Records of one archive in order, and a row of kind ``quarantined`` for every gap of unusable bytes."""
    view, at, gap, why, inside = memoryview(data), 0, None, "", {}
    starts = re.compile(rb"\x1f\x8b\x08|WARC/[01]\.")
    while at < len(data):
        rows, end, whole = [], None, True
        if data[at:at + 3] == b"\x1f\x8b\x08":
            content, end = _inflate(view, at)
            whole = end is not None
            rows = list(_records(content)) if whole or VERSION.match(content) else []
            if not whole and rows and rows[-1][1] == len(content) and not rows[-1][3]:
                rows.pop()  # the record at the fault goes with it, unless its own digest vouches for it
            bad = "" if whole or any(isinstance(r[2], dict) for r in rows) else "broken member"
            if whole and len(rows) == 1 and isinstance(rows[0][2], str):
                bad = rows[0][2]  # nothing but a fault: the member itself is the gap
        else:
            got = _record_at(data, at)
            row = got if isinstance(got, str) else _row(got[0])
            bad = row if isinstance(row, str) else ""
            if not bad:
                rows, end = [(0, got[1] - at, row, True)], got[1]
        nxt = starts.search(data, at + 1)
        after = nxt.start() if nxt else len(data)
        if bad:
            gap, why, inside = (at, bad, {}) if gap is None else (gap, why, inside)
            at = after
            continue
        if gap is not None:
            yield {"start": gap, "end": at, "kind": "quarantined", "reason": why} | inside
            gap = None
        upto = 0
        for start, stop, row, _ in rows:
            if isinstance(row, dict):
                yield row | {"start": at, "end": end}
                upto = stop
            elif whole:
                yield {"start": at, "end": end, "kind": "quarantined", "reason": row, "inside_start": start, "inside_end": stop}
        if whole:
            at = end
        else:  # the rest of a broken member is a gap up to where something valid begins
            gap, why, inside, at = at, "broken member", {"inside_start": upto, "inside_end": len(content)}, after
    if gap is not None:
        yield {"start": gap, "end": len(data), "kind": "quarantined", "reason": why} | inside


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records under ``path`` and the quarantined gaps (columns: see ``RECORDS``)."""
    fields = [f.split() for f in RECORDS.replace("\n", " ").split(",")]
    names = [f[0] for f in fields]
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(name, types[kind]) for name, kind in fields])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column("path"), b.column("content"), strict=True):
                rows = []
                for row in salvage(content.as_buffer().to_pybytes()):
                    full = dict.fromkeys(names) | row | {"file": file.as_py()}
                    rows.append(full if payloads else full | {"payload": None})
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(parse, RECORDS)


def op7_warc(spark, sf_dir: str) -> DataFrame:
    path = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch_path(spark, "warc"))
    found = read_archives(spark, path, payloads=False).filter("kind in ('response', 'revisit')")
    return found.select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")


QUERIES = {"op7_warc": op7_warc}
ORACLE = {
    "op7_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to FROM f""",
}
