"""WARC archives: a writer with revisit records and a salvage reader.

The writer gives each record its own gzip member and starts a new archive after ARCHIVE_BYTES. Archives are
written by tasks into the shared folder under names of their own; the written list of archives is the commit, so
what a lost or repeated task leaves behind is never read.

The reader goes through an archive member by member. A member (or, in an archive that is not compressed, a
record) must pass the checks of its gzip trailer, version line, header, block length, record end and digests.
Where one fails, the reader searches byte by byte for the next member or version line that passes, recovers what
follows, and reports the bytes between as a quarantined gap. It reads in pieces and holds one record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.llm.common import small_batches
from heliograph.session import cut_lineage, scratch

ARCHIVE_BYTES = 32 << 20
READ_TASKS = 10_000
READ_BYTES = 1 << 20
MEMBER_BYTES = 1 << 15
# A longer block fails the length check; a cell of a table could not hold it.
BLOCK_BYTES = 1 << 30
LEVEL = 3
# Fixed values of the format.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

RECORD = (
    "archive string, kind string, start long, end long, reason string, record_type string, record_id string, "
    "target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
)
_NAMES = [x.split()[0] for x in RECORD.split(", ")]


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: tuple | None) -> bytes:
    """One WARC record; ``refers_to`` is (page_id,) of the response for a revisit, whose block has the response's
    HTTP header only."""
    url = "".join(c if " " < c else "%20" for c in url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}", f"Content-Length: {len(block)}",
    ]
    if refers_to:
        head[2:2] = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{'' if refers_to[0] is None else refers_to[0]}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict | None, int, str]:
    """(fields, bytes used, reason): the record at the start of ``raw``; fields are None if a check fails. A reason
    of "short" means that more bytes may mend it."""
    if not raw.startswith(VERSION):
        return None, 0, "short" if VERSION.startswith(raw[: len(VERSION)]) else "version line"
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        return None, 0, "short"
    fields = {}
    for line in raw[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None, 0, "header line"
        fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not length.isascii() or not length.isdigit() or int(length) > BLOCK_BYTES:
        return None, 0, "content length"
    stop = end + 4 + int(length)
    if len(raw) < stop + 4:
        return None, 0, "short"
    if raw[stop : stop + 4] != b"\r\n\r\n":
        return None, 0, "record end"
    block = raw[end + 4 : stop]
    digest = fields.get("warc-block-digest", "")
    if digest.startswith("sha1:") and digest[5:] != sha1_base32(block):
        return None, 0, "block digest"
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next((v.strip() for n, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if n.strip().lower() == b"content-length"), b"")
    revisit = fields.get("warc-type") == "revisit"
    wanted = fields.get("warc-payload-digest", "")
    if not revisit and wanted.startswith("sha1:") and wanted[5:] != sha1_base32(payload):
        return None, 0, "payload digest"
    parsed = {
        "record_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri"),
        "refers_to": fields.get("warc-refers-to"), "payload_digest": wanted.removeprefix("sha1:") or sha1_base32(payload),
        "payload_bytes": int(size) if revisit and size.isdigit() else len(payload), "payload": None if revisit else payload,
    }
    return parsed, stop + 4, ""


class _Window:
    """Bytes of a stream from ``start`` on, read in pieces as asked for."""

    def __init__(self, stream):
        self.stream, self.start, self.held, self.over = stream, 0, bytearray(), False

    def more(self) -> bool:
        got = b"" if self.over else self.stream.read(READ_BYTES)
        self.over = not got
        self.held += got
        return bool(got)

    def drop(self, n: int) -> None:
        del self.held[:n]
        self.start += n


def _member(window: _Window, at: int) -> tuple[dict | None, int, str]:
    """The gzip member at ``at`` of the window: (fields, bytes, reason)."""
    engine, out, used = zlib.decompressobj(31), bytearray(), at
    try:
        while not engine.eof:
            if used == len(window.held) and not window.more():
                return None, 0, "truncated member"
            piece = bytes(window.held[used : used + MEMBER_BYTES])
            out += engine.decompress(piece)
            used += len(piece)
            if len(out) >= len(VERSION) and not out.startswith(VERSION):
                return None, 0, "version line"
    except zlib.error:
        return None, 0, "gzip data"
    used -= len(engine.unused_data)
    fields, size, reason = parse_record(bytes(out))
    if fields is not None and size != len(out):
        return None, 0, "member length"
    return fields, used - at, "truncated record" if reason == "short" else reason


def _plain(window: _Window, at: int) -> tuple[dict | None, int, str]:
    """The uncompressed record at ``at`` of the window."""
    need = 0
    while True:
        if len(window.held) - at >= need:
            fields, size, reason = parse_record(bytes(window.held[at:]))
            if reason != "short":
                return fields, size, reason
            need = 2 * (len(window.held) - at)  # parse again only once the window has doubled
        if not window.more():
            fields, size, reason = parse_record(bytes(window.held[at:]))
            return fields, size, "truncated record" if reason == "short" else reason


def salvage(stream) -> Iterator[tuple[str, int, int, str, dict]]:
    """("record" or "gap", start, end, reason, fields) of everything in a stream, in order and without overlap."""
    window, at, bad = _Window(stream), 0, ""
    window.more()
    while True:
        while len(window.held) - at < len(VERSION) and window.more():
            pass
        head = bytes(window.held[at : at + len(VERSION)])
        if not head:
            break
        fields, size, reason = None, 0, "no record start"
        if head.startswith(MAGIC):
            fields, size, reason = _member(window, at)
        elif head == VERSION:
            fields, size, reason = _plain(window, at)
        if fields is not None:
            if at:
                yield "gap", window.start, window.start + at, bad, {}
            start = window.start + at
            yield "record", start, start + size, "", fields
            window.drop(at + size)
            at, bad = 0, ""
            continue
        bad = bad or reason
        # the next place where a member or a version line may start
        at += 1
        while True:
            spots = [i for i in (window.held.find(MAGIC, at), window.held.find(VERSION, at)) if i >= 0]
            if spots:
                at = min(spots)
                break
            at = max(at, len(window.held) - len(VERSION) + 1)
            if not window.more():
                at = len(window.held)
                break
            if at > 4 * READ_BYTES:  # a long gap is reported in parts
                yield "gap", window.start, window.start + at, bad, {}
                window.drop(at)
                at = 0
    if at:
        yield "gap", window.start, window.start + at, bad, {}


def _open(path: str, write: bool = False):
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    if write:
        if isinstance(store, fs.LocalFileSystem):
            store.create_dir(name.rpartition("/")[0], recursive=True)
        return store.open_output_stream(name, compression=None)
    return store.open_input_stream(name, compression=None)


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Writes ``records`` (page_id, url, payload binary, refers_to array of one page_id or null) below the shared ``folder``;
    returns the stored list (archive, records, bytes)."""

    def write(batches):
        sink, path, done, size = None, "", 0, 0
        for batch in batches:
            for page_id, url, payload, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sink is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    sink, done, size = _open(path, True), 0, 0
                engine = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                member = engine.compress(record_bytes(page_id, url, payload, None if refers is None else tuple(refers))) + engine.flush()
                sink.write(member)
                done, size = done + 1, size + len(member)
                if size >= ARCHIVE_BYTES:
                    sink.close()
                    yield pa.record_batch([pa.array([path]), pa.array([done]), pa.array([size])], ["archive", "records", "bytes"])
                    sink = None
        if sink is not None:
            sink.close()
            yield pa.record_batch([pa.array([path]), pa.array([done]), pa.array([size])], ["archive", "records", "bytes"])

    rows = records.select("page_id", "url", "payload", "refers_to")
    return cut_lineage(rows.mapInArrow(write, "archive string, records long, bytes long"))


def read_archives(archives: DataFrame) -> DataFrame:
    """All records and gaps of the archives named in ``archive``, one archive at a time in a task; ``kind`` is record or gap.

    A gap has archive, start, end (bytes) and the first failed check as reason; its other columns are null.
    """

    def read(batches):
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                with _open(archive) as stream:
                    rows, held = [], 0
                    for kind, start, end, reason, fields in salvage(stream):
                        rows.append({"archive": archive, "kind": kind, "start": start, "end": end, "reason": reason} | fields)
                        held += len(fields.get("payload") or b"")
                        if held > READ_BYTES or len(rows) > 5000:
                            yield _batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows)

    def _batch(rows):
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        return pa.record_batch([pa.array([r.get(n) for r in rows], kinds[k]) for n, k in (x.split() for x in RECORD.split(", "))], _NAMES)

    # the list of names is small: without a number, adaptive execution would make one task of it
    named = archives.select("archive").repartition(max(1, min(archives.count(), READ_TASKS)), "archive")
    return named.mapInArrow(read, RECORD)


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to) of each row: of equal payloads of ``least_bytes`` or more, the one with the
    largest page_id (null is smallest) is the response and the others refer to it in an array of one page_id.

    Repeated rows are written as often as they come, and one of them at most is a response. A null html is an empty
    payload. Only page_id, url and html are read. Each html moves once, by its own page, never by its digest.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = small_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    key = F.concat_ws("\x1f", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("\x1e")), F.sha1("payload"))
    rows = rows.withColumn("key", key)
    light = cut_lineage(rows.select("key", "page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("size")))
    some = light.where(F.col("size") >= least_bytes).groupBy("digest").agg(
        F.max(F.struct(F.col("page_id").isNotNull().alias("some"), "page_id", "key")).alias("best")
    )
    best = cut_lineage(some.select("digest", F.col("best.page_id").alias("best_id"), F.col("best.key").alias("best_key")))
    counted = light.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("copies"))
    roles = cut_lineage(counted.join(best, "digest", "left").select(
        "key", "copies", F.when(F.col("best_key").isNotNull(), F.array("best_id")).alias("best"),
        F.coalesce(F.col("best_key") == F.col("key"), F.lit(False)).alias("first"),
    ))
    once = rows.join(roles.where("copies = 1").drop("copies"), "key")
    # rows that come more than once: one of each is kept and laid out again
    often = cut_lineage(roles.where("copies > 1"))
    again = rows.join(often, "key").dropDuplicates(["key"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    again = again.withColumn("first", F.col("first") & (F.col("copy") == 1)).drop("copies", "copy")
    both = once.unionByName(again.select(once.columns))
    return both.select("page_id", "url", "payload", F.when(~F.col("first"), F.col("best")).alias("refers_to"))


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes a record per page and reads the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    archives = write_archives(revisits(pages, least_bytes), scratch(pages.sparkSession, "warc"))
    found = read_archives(archives).where("kind = 'record'")
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("long")
    return found.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
