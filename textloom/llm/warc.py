"""WARC 1.1: writing with one gzip member a record, and a sequential reader."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace, q

READ = 256 << 10
PIECE = 1 << 20
BATCH = 4 << 20
#: Bytes of a record's header, its blank line included, and of its block, which is one value of a table row.
MAX_HEADER, MAX_BLOCK = 1 << 20, 1 << 30
#: Digests of one fixed length, by their names in lower case without hyphens.
DIGESTS = ("md5", "sha1", "sha224", "sha256", "sha384", "sha512", "sha3224", "sha3256", "sha3384", "sha3512", "blake2b", "blake2s")
HTTP_HEADER = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORD = "path string, member int, offset long, status string, type string, record_id string, url string, date string, content_type string, content_length long, digest string, headers map<string,string>, http_header binary, payload binary"
_ARROW = pa.schema([("path", pa.string()), ("member", pa.int32()), ("offset", pa.int64()), ("status", pa.string()), ("type", pa.string()), ("record_id", pa.string()), ("url", pa.string()), ("date", pa.string()), ("content_type", pa.string()), ("content_length", pa.int64()), ("digest", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("http_header", pa.binary()), ("payload", pa.binary())])


def digest_of(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(headers: list[tuple[str, str]], block: bytes, level: int = 1) -> bytes:
    """One record as a gzip member of its own."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(head.encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def _fields(raw: bytes) -> dict[str, str] | None:
    """Header fields, names in lower case, values of one name joined by ', '; None if it is no WARC header or has no usable
    Content-Length: ASCII digits, 18 at most, the same wherever it is repeated."""
    lines = raw.decode("utf-8", "replace").split("\r\n")
    if not re.fullmatch(r"WARC/[0-9]+\.[0-9]+", lines[0]):
        return None
    rows: list[list[str]] = []
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and rows:
            rows[-1][1] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            rows.append([name.strip().lower(), value.strip()])
    out: dict[str, str] = {}
    for name, value in rows:
        out[name] = value if name not in out or name == "content-length" and out[name] == value else f"{out[name]}, {value}"
    return out if re.fullmatch(r"[0-9]{1,18}", out.get("content-length", "")) else None


def unchunked(body: bytes) -> bytes | None:
    """A body without the chunked transfer encoding; None if it isn't whole."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = re.match(rb"[ \t]*([0-9A-Fa-f]{1,15})[ \t]*(?:;|$)", body[at:end]) if end >= 0 else None
        if size is None:
            return None
        n = int(size[1], 16)
        if n == 0:
            return b"".join(out)
        if end + 2 + n > len(body):
            return None
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def verify(stated: str, *candidates: bytes) -> bool | None:
    """Whether a digest ``algorithm:value``, value in base 32 or hexadecimal, is that of a candidate; None for an unknown algorithm."""
    name, _, value = stated.partition(":")
    name = re.sub("[-_]", "", name.strip().lower())
    if name not in DIGESTS:
        return None
    name = name.replace("sha3", "sha3_", 1) if name.startswith("sha3") and len(name) == 7 and name != "sha384" else name
    value = value.strip()
    for body in candidates:
        found = hashlib.new(name, body)
        if value.lower() == found.hexdigest() or value.upper().rstrip("=") == base64.b32encode(found.digest()).decode().rstrip("="):
            return True
    return False


class Reader:
    """Records of a stream of gzip members, read front to back in blocks of 256 KiB.

    Each member is inflated incrementally, a mebibyte at a time; within it the header ends at the first blank line and the block is framed
    by Content-Length. A member may hold several records. In a block of type application/http the HTTP header ends at its first blank
    line and the payload is what follows, elsewhere the payload is the block. Every record yields a dict with a status:

    * ``ok``: each stated digest that can be checked is right, the block's over the block and the payload's over the payload, as it is or
      without its chunked encoding. The payload digest of a revisit is that of another record and that of a segment belongs to all of
      them, so these aren't checked.
    * ``digest_mismatch``: one is wrong; the payload is kept.
    * ``unknown_digest``: digests are stated but none has a known algorithm. ``no_digest``: none is there to check.
    * ``bad_header``: no WARC header, no usable Content-Length, or a header of more than ``max_header`` bytes; the rest of the
      member is skipped.
    * ``too_long``: a block of more than ``max_block`` bytes is passed over, without payload.
    * ``truncated``: the member or the stream ends inside the record.
    * ``bad_gzip``: a damaged member; reading resumes at the next gzip magic number.

    No content of a stream raises an exception. An empty stream has no records; equal records are told apart by their offsets.
    """

    def __init__(self, stream, path: str = "", max_header: int = MAX_HEADER, max_block: int = MAX_BLOCK) -> None:
        self.stream, self.path, self.max_header, self.max_block = stream, path, max_header, max_block
        self.buffer, self.base, self.ended = b"", 0, False

    def _more(self) -> bool:
        if not self.ended:
            block = self.stream.read(READ)
            self.ended = not block
            self.buffer += block
        return not self.ended

    def _row(self, number: int, offset: int, status: str, fields: dict[str, str] | None = None, http: bytes | None = None, payload: bytes | None = None) -> dict:
        f = fields or {}
        length = f.get("content-length")
        return {"path": self.path, "member": number, "offset": offset, "status": status, "type": f.get("warc-type"), "record_id": f.get("warc-record-id"), "url": f.get("warc-target-uri"), "date": f.get("warc-date"), "content_type": f.get("content-type"), "content_length": None if length is None else int(length), "digest": f.get("warc-payload-digest") or f.get("warc-block-digest"), "headers": list(f.items()), "http_header": http, "payload": payload}

    def _inflated(self) -> Iterator[bytes]:
        """Pieces of the member at the front of the buffer; raises zlib.error or EOFError."""
        z = zlib.decompressobj(31)
        while not z.eof:
            if not self.buffer and not self._more():
                piece = z.decompress(b"", PIECE)  # what is left inside
                if not piece and not z.eof:
                    raise EOFError
                yield piece
                continue
            taken = self.buffer
            try:
                piece = z.decompress(taken, PIECE)
            except zlib.error:  # the next member may begin in this block
                self.buffer = taken[1:]
                self.base += 1
                raise
            self.buffer = z.unused_data if z.eof else z.unconsumed_tail
            self.base += len(taken) - len(self.buffer)
            if piece:
                yield piece

    def _record(self, number: int, offset: int, fields: dict[str, str], block: bytes) -> dict:
        http, payload = None, block
        if re.match(r"application/http\b", fields.get("content-type", ""), re.I):
            at = block.find(b"\r\n\r\n")
            at = len(block) if at < 0 else at + 4
            http, payload = block[:at], block[at:]
        checks = []
        if fields.get("warc-block-digest"):
            checks.append(verify(fields["warc-block-digest"], block))
        if fields.get("warc-payload-digest") and fields.get("warc-type", "").lower() not in ("revisit", "continuation") and "warc-segment-number" not in fields:
            plain = unchunked(payload) if http and re.search(rb"(?im)^transfer-encoding[ \t]*:.*\bchunked\b", http) else None
            checks.append(verify(fields["warc-payload-digest"], payload, *([] if plain is None else [plain])))
        known = [c for c in checks if c is not None]
        status = "no_digest" if not checks else "unknown_digest" if not known else "ok" if all(known) else "digest_mismatch"
        return self._row(number, offset, status, fields, http, payload)

    def __iter__(self) -> Iterator[dict]:
        number = 0
        while self.buffer or self._more():
            offset, body, fields, need, skip, failed = self.base, bytearray(), None, 0, 0, ""
            pieces = self._inflated()
            while True:
                over = False
                try:
                    body += next(pieces)
                except StopIteration:
                    over = True
                except EOFError:
                    over, failed = True, "truncated"
                except zlib.error:
                    over, failed = True, "bad_gzip"
                while True:
                    if fields is None:
                        while body[:2] == b"\r\n":
                            del body[:2]
                        at = body.find(b"\r\n\r\n", 0, self.max_header)
                        if at < 0:
                            if len(body) >= self.max_header or over and body and not failed:
                                failed = failed or "bad_header"
                            break
                        fields = _fields(bytes(body[:at]))
                        if fields is None:
                            failed = "bad_header"
                            break
                        del body[: at + 4]
                        need = int(fields["content-length"])
                        skip = need if need > self.max_block else 0
                    if skip:
                        gone = min(skip, len(body))
                        del body[:gone]
                        skip -= gone
                        if skip:
                            break
                        yield self._row(number, offset, "too_long", fields)
                    elif len(body) < need:
                        break
                    else:
                        block = bytes(body[:need])
                        del body[:need]
                        yield self._record(number, offset, fields, block)
                    fields = None
                if over or failed:
                    break
            if fields is not None and not failed:
                failed = "truncated"
            if failed:
                yield self._row(number, offset, failed, fields)
                if failed == "bad_header":
                    failed = self._pass_over(pieces)
                if failed == "bad_gzip":
                    self._resume()
            number += 1

    @staticmethod
    def _pass_over(pieces: Iterator[bytes]) -> str:
        try:
            for _ in pieces:
                pass
        except zlib.error:
            return "bad_gzip"
        except EOFError:
            pass
        return ""

    def _resume(self) -> None:
        while True:
            at = self.buffer.find(b"\x1f\x8b\x08")
            if at >= 0:
                self.buffer, self.base = self.buffer[at:], self.base + at
                return
            drop = max(0, len(self.buffer) - 2)
            self.buffer, self.base = self.buffer[drop:], self.base + drop
            if not self._more():
                self.base += len(self.buffer)
                self.buffer = b""
                return


def read_files(paths, max_header: int = MAX_HEADER, max_block: int = MAX_BLOCK) -> Iterator[dict]:
    for path in paths:
        where, at = fs.FileSystem.from_uri(path)
        with where.open_input_stream(at, compression=None) as stream:
            yield from Reader(stream, path, max_header, max_block)


def _batches(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row["payload"] or b"") + 500
        if size >= BATCH:
            yield pa.RecordBatch.from_pylist(held, _ARROW)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, _ARROW)


def read_warc(spark: SparkSession, paths: list[str], max_header: int = MAX_HEADER, max_block: int = MAX_BLOCK) -> DataFrame:
    """All records of WARC files by URI, one row each (see ``Reader`` for ``status``). A file is read by one task,
    front to back with bounded memory beyond its largest record; files are spread evenly over tasks. No files, no rows."""
    if not paths:
        return spark.createDataFrame([], RECORD)
    read = lambda batches: _batches(read_files((p for b in batches for p in b.column(0).to_pylist()), max_header, max_block))
    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths)).mapInArrow(read, RECORD)


def write_warc(df: DataFrame, folder: str, ident: str, url: str, body: str) -> list[str]:
    """Writes a response record a row into ``folder``, a file a partition, and returns their URIs. Other columns of ``df`` take no part.

    A task writes under a name of its own attempt and renames at the end, so a repeated or lost task
    leaves no half file. A null body is marked in the header and has no payload; a null url has no
    target; line breaks in a url become blanks; repeated rows are records of their own."""

    def write(batches):
        task = TaskContext.get()
        where, at = fs.FileSystem.from_uri(folder)
        where.create_dir(at, recursive=True)
        name, draft = f"{at}/part-{task.partitionId():06d}.warc.gz", f"{at}/_part-{task.partitionId():06d}-{task.taskAttemptId()}"
        count = 0
        with where.open_output_stream(draft, compression=None) as out:
            for batch in batches:
                for i, u, b in zip(*(c.to_pylist() for c in batch.columns)):
                    raw = (b or "").encode() if not isinstance(b, bytes) else b
                    block = HTTP_HEADER.encode() + raw
                    headers = [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:record:{i}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest_of(raw)), ("WARC-Block-Digest", digest_of(block))]
                    headers += [("WARC-Target-URI", re.sub(r"[\r\n]+", " ", u))] if u is not None else []
                    headers += [("X-Null-Block", "true")] if b is None else []
                    out.write(member(headers, block))
                    count += 1
        if count:
            where.move(draft, name)
            yield pa.RecordBatch.from_pydict({"path": [f"{folder.rstrip('/')}/{name.rpartition('/')[2]}"]})
        else:
            where.delete_file(draft)

    return sorted({r.path for r in df.select(q(ident), q(url), q(body)).mapInArrow(write, "path string").collect()})


def pages_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Archives every page as WARC in the shared folder, then reads the archive: page_id, url, html, the
    block's length (with its HTTP header) and the reader's status. Null ids, urls and html come back as null, empty and very long ones as they
    are, repeated rows once each; no pages give no rows. The archive stays while the returned rows are used."""
    ws = Workspace(spark, "warc")
    records = read_warc(spark, write_warc(pages, ws.path, "page_id", "url", "html"))
    ident = F.regexp_extract("record_id", r"^<urn:record:(-?\d+)>$", 1)
    return records.select(F.when(ident != "", ident).cast("long").alias("page_id"), "url", F.when(F.col("headers")["x-null-block"].isNull(), F.col("payload").cast("string")).alias("html"), "content_length", "status")
