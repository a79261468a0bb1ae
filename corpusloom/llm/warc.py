"""WARC archives written from and read into a chunked record table (operator 4).

Writing: each task streams its records into one gzip-per-record archive in the shared folder and
returns index rows (file, offset, length) that cover whole records.  Reading: each index row is parsed
as a stream; a payload leaves as rows (record, chunk number) of at most ``chunk_bytes``, each carrying
the digest and byte count up to its end, so a record of any size is never held whole.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.groups import with_group_values
from corpusloom.session import cut, dealt, shared_dir

INDEX = "file string, offset long, length long, records long"
CHUNK = (
    "page_id long, chunk_no int, record_type string, refers_to long, declared_bytes long, declared_digest string, "
    "bytes_upto long, digest_upto string, last boolean, data binary"
)
NAME = "urn:x-page:"
DATE = "2024-01-01T00:00:00Z"
#: Compressed bytes of records that one index row covers at least.
RANGE = 8 << 20
READ = 1 << 18


def file_system(uri: str):
    """File system and path of a shared folder, as pyarrow names them."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file:///" + uri[len("file:/") :].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def record_head(page: int | None, url: str | None, kind: str, refers: int | None, digest: str, size: int) -> bytes:
    """WARC and HTTP header of a record.  A revisit has the HTTP header but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    target = "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or "")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{NAME}{'' if page is None else page}>",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
    ]
    lines += [f"WARC-Target-URI: {target}"] * bool(target)
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{NAME}{refers}>"]
    lines.append(f"Content-Length: {len(http) + (size if kind == 'response' else 0)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def write_archives(pages: DataFrame, folder: str, chunk_bytes: int = 1 << 20) -> DataFrame:
    """Write ``page_id, url, html, digest, size, record_type, refers_to`` rows; index rows of what was written.

    A task that runs again writes a new file; only files that the returned index names are ever read.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, at, begun, count, index = None, "", 0, 0, 0, []
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    store, path = file_system(folder)
                    context = TaskContext.get()
                    name = f"{path}/part-{context.partitionId():05d}-{context.taskAttemptId()}.warc.gz"
                    store.create_dir(path, recursive=True)
                    out = store.open_output_stream(name, compression=None)  # each record is its own gzip member
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                kind = row["record_type"]
                at += out.write(pack.compress(record_head(row["page_id"], row["url"], kind, row["refers_to"], row["digest"], row["size"])))
                if kind == "response":
                    payload = memoryview((row["html"] or "").encode("utf-8", "replace"))
                    for k in range(0, len(payload), chunk_bytes):
                        at += out.write(pack.compress(payload[k : k + chunk_bytes]))
                at += out.write(pack.compress(b"\r\n\r\n") + pack.flush())
                count += 1
                if at - begun >= RANGE:
                    index.append((name, begun, at - begun, count))
                    begun, count = at, 0
        if out is not None:
            out.close()
            if count:
                index.append((name, begun, at - begun, count))
        columns = list(zip(*index, strict=True)) or [[], [], [], []]
        yield pa.record_batch([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["file", "offset", "length", "records"])

    return pages.select("page_id", "url", "html", "digest", "size", "record_type", "refers_to").mapInArrow(write, INDEX)


class Stream:
    """Line and bounded reads over pieces of bytes."""

    def __init__(self, pieces: Iterable[bytes]):
        self.pieces, self.buffer = iter(pieces), b""

    def more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        self.buffer += piece
        return True

    def line(self) -> bytes | None:
        while b"\n" not in self.buffer:
            if not self.more():
                return None
        line, _, self.buffer = self.buffer.partition(b"\n")
        return line.rstrip(b"\r")

    def read(self, most: int) -> bytes:
        if not self.buffer and not self.more():
            raise ValueError("the archive ends within a record")
        part, self.buffer = self.buffer[:most], self.buffer[most:]
        return part

    def fields(self) -> dict[str, str]:
        found = {}
        while line := self.line():
            key, _, value = line.partition(b":")
            found[key.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
        return found


def gunzipped(pieces: Iterable[bytes]) -> Iterator[bytes]:
    unpack = zlib.decompressobj(31)
    for piece in pieces:
        while piece:
            data = unpack.decompress(piece, READ)
            while data:
                yield data
                # What was held back by the bound, even when all input is taken in.
                data = b"" if unpack.eof else unpack.decompress(unpack.unconsumed_tail, READ)
            if unpack.eof:
                piece, unpack = unpack.unused_data, zlib.decompressobj(31)
            else:
                piece = unpack.unconsumed_tail


def page_of(name: str) -> int | None:
    number = name.strip("<>").removeprefix(NAME)
    return int(number) if number else None


def record_chunks(pieces: Iterable[bytes], chunk_bytes: int) -> Iterator[tuple]:
    """Rows of the chunked record table from archive bytes (gzip per record)."""
    stream = Stream(gunzipped(pieces))
    while (line := stream.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = stream.fields()
        kind, page = head["warc-type"], page_of(head["warc-record-id"])
        refers = page_of(head["warc-refers-to"]) if "warc-refers-to" in head else None
        declared = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
        stream.line()  # the HTTP status line
        size = int(stream.fields()["content-length"])
        if kind != "response":
            yield page, 0, kind, refers, size, declared, 0, declared, True, None
            continue
        digest, done, number = hashlib.sha1(), 0, 0
        while True:
            parts, want = [], min(chunk_bytes, size - done)
            while want:
                parts.append(stream.read(want))
                want -= len(parts[-1])
            data = b"".join(parts)
            digest.update(data)
            done += len(data)
            last = done == size
            if last and digest.hexdigest() != declared:
                raise ValueError(f"record {page}: payload differs from its digest")
            yield page, number, kind, refers, size, declared, done, digest.hexdigest(), last, data
            number += 1
            if last:
                break


def read_archives(index: DataFrame, folder: str, chunk_bytes: int = 1 << 20, with_data: bool = True, batch_bytes: int = 16 << 20) -> DataFrame:
    """Chunked record table of the archives that ``index`` names; without data, ``data`` is null."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = file_system(folder)[0]
        types = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]
        names = [x.split()[0] for x in CHUNK.split(", ")]

        def ranges(path: str, offset: int, length: int) -> Iterator[bytes]:
            with store.open_input_file(path) as source:
                source.seek(offset)
                while length:
                    data = source.read(min(READ, length))
                    if not data:
                        raise ValueError(f"{path} ends early")
                    length -= len(data)
                    yield data

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for row in batch.to_pylist():
                rows, held = [], 0
                for chunk in record_chunks(ranges(row["file"], row["offset"], row["length"]), chunk_bytes):
                    rows.append(chunk if with_data else (*chunk[:-1], None))
                    held += 200 + len(chunk[-1] or b"") * with_data
                    if held >= batch_bytes:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return index.select("file", "offset", "length").mapInArrow(read, CHUNK)


def classified(pages: DataFrame, least_bytes: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Add digest, size, record type and the record a revisit refers to; the html of a revisit is null, as its record has none.

    Payloads are equal when SHA-256 and length agree.  Of equal payloads of ``least_bytes`` or more, the
    record with the largest id is the response (all rows that repeat this id are); a row without id
    never is while another has one, and in a group without ids all are responses.

    Groups are settled on narrow rows, by salted parts where a payload is repeated very often; the html then meets the
    decisions by page, where nothing is hot.
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "utf-8")
    same, size = F.sha2(payload, 256).alias("_same"), F.octet_length(payload).cast("long").alias("size")
    page = F.col(id_col).cast("long").alias("page_id")
    narrow = pages.select(page, same, size).where(F.col("size") >= least_bytes)
    groups = with_group_values(
        narrow, ["_same", "size"], F.xxhash64("page_id"), [F.max("page_id").alias("_k"), F.count(F.lit(1)).alias("_c")], [F.max("_k").alias("_kept"), F.sum("_c").alias("_n")], "_n > 1 and _kept is not null"
    )
    again = groups.where(~F.col("page_id").eqNullSafe(F.col("_kept"))).select(F.col("page_id").alias("_page"), F.col("_same").alias("_gsame"), F.col("size").alias("_gsize"), "_kept").distinct()
    rows = pages.select(page, F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.sha1(payload).alias("digest"), size, same)
    joined = rows.join(again.hint("merge"), F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("_same") == F.col("_gsame")) & (F.col("size") == F.col("_gsize")), "left")
    revisit = F.col("_kept").isNotNull()
    return joined.select(
        "page_id", "url", F.when(~revisit, F.col("html")).alias("html"), "digest", "size", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.col("_kept").alias("refers_to")
    )


def archive_pages(pages: DataFrame, least_bytes: int = 1000, chunk_bytes: int = 1 << 20) -> DataFrame:
    """Write a record per page, read the archives back, one row per record.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to, chunks``.  A null html is an empty
    payload, a null or odd url is left out or percent-encoded, repeated rows are records of their own, an empty
    table gives an empty result.  An html of any length is written and read in chunks (it is one value of one row, so a
    task holds it once as a row, but never its record as a whole).  Extra columns are not read.  The archives stay in the
    shared folder.
    """
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    index = cut(write_archives(classified(pages, least_bytes), folder, chunk_bytes))
    chunks = read_archives(dealt(index, index.count()), folder, chunk_bytes, with_data=False)
    # The last chunk of a record carries the digest and size of all of it.
    return chunks.where("last").select(
        "page_id",
        F.col("declared_bytes").alias("payload_bytes"),
        F.col("digest_upto").alias("payload_digest"),
        "record_type",
        "refers_to",
        (F.col("chunk_no") + 1).alias("chunks"),
    )


