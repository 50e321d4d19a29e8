"""WARC archives: a writer that stores equal payloads once, and a splittable reader.

Writer. Every page becomes one gzip member of its own. Of the pages whose payloads are equal, the one with
the largest id is stored as a response; the others are revisit records that refer to it. The largest id of
each digest comes from an aggregation that combines before its shuffle; pages are compressed before they
are joined with it, so that the shuffle moves compressed members, and a digest with very many pages is
split by the adaptive skew join. Each task streams one file under a name of its own attempt; the manifest,
rows of tasks that succeeded, says which files count.

Reader. The archives' sizes give byte ranges; a task scans its range for gzip magic, validates each
candidate by decoding the member (header, CRC, length) and owns the records that start inside the range,
reading past the end of the range to finish the last one. A candidate found without a preceding record
must also be followed by another member or the end of the file, so that bytes inside a record which look
like a member are passed over. Damaged stretches are skipped until the next member that decodes.

Defined cases: null html is an empty payload; null urls have no target; control characters and blanks in
urls are percent-encoded; rows without a page_id never are what others refer to unless no row of their
payload has one; rows that repeat the largest page_id are all responses; an empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, new_dir, open_fs

MAGIC = b"\x1f\x8b\x08"
STEP = 1 << 18
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, path string, offset long"


def _base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def member(kind: str, page_id: int | None, url: str | None, sha1_hex: str, size: int, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f-\x9f  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url))
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{_base32(sha1_hex)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n") + pack.flush()


def write_warc(pages: DataFrame, min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Archive pages (page_id, url, html). Returns the manifest: path, n_records, size."""
    folder = new_dir(pages.sparkSession, "warc")
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1("html"))
    keepers = base.groupBy("digest").agg(F.max("page_id").alias("keeper"))

    def compress(batches):
        import pyarrow as pa

        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                b = batch.slice(low, 256)
                sizes, members = [], []
                for i, u, h, d in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                    raw = h.encode()
                    sizes.append(len(raw))
                    members.append(member("response", i, u, d, len(raw), raw, None, date))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(sizes, pa.int64()), pa.array(members, pa.binary())], names=["page_id", "url", "digest", "size", "member"])

    def write(batches):
        import pyarrow as pa

        fs, path = open_fs(folder)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        out, n, size = None, 0, 0
        for b in batches:
            if out is None and b.num_rows:
                fs.create_dir(path, recursive=True)
                out = fs.open_output_stream(f"{path}/{name}", compression=None)
            for i, u, d, s, m, k in zip(*(b.column(c) for c in range(6)), strict=True):
                i, u, s, k = i.as_py(), u.as_py(), s.as_py(), k.as_py()
                if s >= min_revisit_bytes and k is not None and i != k:
                    data = member("revisit", i, u, d.as_py(), s, b"", k, date)
                else:
                    data = m.as_py()
                out.write(data)
                n, size = n + 1, size + len(data)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n_records": [n], "size": [size]})

    packed = base.mapInArrow(compress, "page_id long, url string, digest string, size long, member binary")
    ready = packed.join(keepers, "digest").select("page_id", "url", "digest", "size", "member", "keeper")
    return materialise(ready.mapInArrow(write, "path string, n_records long, size long"), "warc-manifest")


class _Window:
    """Random access to a file through one moving block."""

    def __init__(self, file, size: int) -> None:
        self.file, self.size, self.at, self.block = file, size, 0, b""

    def get(self, at: int, n: int) -> bytes:
        """Up to n bytes from at; at least one where the file goes that far."""
        if not self.at <= at < self.at + len(self.block):
            self.at, self.block = at, self.file.read_at(max(0, min(STEP, self.size - at)), at) if at < self.size else b""
        return self.block[at - self.at : at - self.at + n]

    def find_magic(self, at: int, end: int) -> int:
        """The first offset in [at, end) at which gzip magic begins, or -1."""
        while at < end:
            if not self.get(at, 1):
                return -1
            k = self.block.find(MAGIC, at - self.at)  # where it is; nothing is copied
            if k >= 0:
                return self.at + k if self.at + k < end else -1
            tail = self.at + len(self.block)
            if tail >= self.size:
                return -1
            for edge in range(max(at, tail - len(MAGIC) + 1), tail):  # across two blocks
                if edge < end and self.file.read_at(len(MAGIC), edge) == MAGIC:
                    return edge
            at = tail
        return -1


def _inflate(window: _Window, at: int) -> tuple[bytes, int] | None:
    """(the member's bytes, the offset after it) if a whole WARC record's member begins at `at`."""
    z, out, pos, checked = zlib.decompressobj(31), [], at, False
    while not z.eof:
        data = window.get(pos, 1 << 16)
        if not data:
            return None
        try:
            got = z.decompress(data)
        except zlib.error:
            return None
        pos += len(data) - len(z.unused_data)
        out.append(got)
        if not checked and sum(map(len, out)) >= 5:
            if not b"".join(out).startswith(b"WARC/"):
                return None
            checked = True
    raw = b"".join(out)
    return (raw, pos) if raw.startswith(b"WARC/") else None


def _parse(raw: bytes) -> tuple[dict[str, str], bytes] | None:
    head, gap, rest = raw.partition(b"\r\n\r\n")
    if not gap:
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    size = fields.get("content-length", "")
    if not size.isdigit() or len(rest) < int(size):
        return None
    return fields, rest[: int(size)]


def scan_range(file, size: int, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, block) of each record that starts in [start, end)."""
    window, at, led = _Window(file, size), start, start == 0
    while (at := window.find_magic(at, end)) >= 0:
        found = _inflate(window, at)
        record = _parse(found[0]) if found else None
        if record and not led:
            follows = file.read_at(min(3, size - found[1]), found[1]) if found[1] < size else MAGIC
            record = record if follows == MAGIC else None
        if record:
            yield at, *record
            at, led = found[1], True
        else:
            at, led = at + 1, False


def _page(text: str) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", text)
    return int(m[1]) if m else None


def read_warc(archives: DataFrame, split_bytes: int = 64 << 20, payload: bool = True) -> DataFrame:
    """Records of archives (path, size): columns of RECORD and, if asked for, the payload."""
    splits = archives.where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(split_bytes))).alias("start"))

    def read(batches):
        for b in batches:
            for uri, size, start in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                fs, path = open_fs(uri)
                with fs.open_input_file(path) as file:
                    rows, held = [], 0
                    for offset, fields, block in scan_range(file, size, start, min(size, start + split_bytes)):
                        http, _, body = block.partition(b"\r\n\r\n")
                        kind, told = fields.get("warc-type"), fields.get("warc-payload-digest", "").removeprefix("sha1:")
                        if kind == "response":
                            n, digest = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
                            if told and digest != told:
                                raise ValueError(f"{uri}: the payload at {offset} is damaged")
                        else:
                            m = re.search(rb"(?mi)^content-length:\s*(\d+)", http)
                            n, digest = int(m[1]) if m else None, told or None
                        rows.append((_page(fields.get("warc-record-id", "")), fields.get("warc-target-uri"), kind, _page(fields.get("warc-refers-to", "")), n, digest, uri, offset, *([body if kind == "response" else None] if payload else [])))
                        held += len(body) if payload else 200
                        if held > 8 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows)

    def _batch(rows):
        import pyarrow as pa

        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), *([pa.binary()] if payload else [])]
        names = [c.split()[0] for c in RECORD.split(", ")] + ["payload"] * payload
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    n = max(1, splits.count())
    return splits.repartition(n).select("path", "size", "start").mapInArrow(read, RECORD + ", payload binary" * payload)
