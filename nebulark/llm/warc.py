"""WARC archives through a chunked record table.

A payload is cut into rows (record_id, chunk_no, data); each row carries the SHA-1 of all bytes up
to its end, so the last row has the record's digest.  Writing and reading pass one chunk at a time
through a record: no step after the cut holds a whole payload.  A file is written by one task
attempt under a name of its own and counts only once the task's manifest row is committed, so a
lost executor leaves at most a file that nobody reads.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nebulark.llm._common import attach_groups, materialize, work_dir

CHUNK_BYTES = 256 * 1024
BLOCK = 64 * 1024
#: Payload bytes from which records are spread over more archives than there are cores.
ARCHIVE_BYTES = 512 << 20


def _base32(sha: "hashlib._Hash") -> str:
    return base64.b32encode(sha.digest()).decode()


def record_chunks(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table: record_id, page_id, url, chunk_no, last, bytes (up to here), digest, data.

    A null payload is empty and has one empty chunk; every row is a record of its own, also when
    page ids repeat or are null; a null url is empty.
    """
    rows = pages.select(F.monotonically_increasing_id().alias("record_id"), F.col(id_col).cast("long").cast("string").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "utf-8").alias("data"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["record_id", "page_id", "url", "chunk_no", "last", "bytes", "digest", "data"]
        for b in batches:
            out, held = [], 0
            for record, page, url, data in zip(b["record_id"], b["page_id"], b["url"], b["data"], strict=True):
                view, sha, k, at = memoryview(data), hashlib.sha1(), 0, 0
                while True:
                    piece = view[at : at + chunk_bytes]
                    sha.update(piece)
                    at += len(piece)
                    out.append((record, page, url, k, at >= len(view), at, _base32(sha), bytes(piece)))
                    held, k = held + len(piece), k + 1
                    if held > 16 << 20:
                        yield pd.DataFrame(out, columns=names)
                        out, held = [], 0
                    if at >= len(view):
                        break
            if out:
                yield pd.DataFrame(out, columns=names)

    out = rows.mapInPandas(cut, "record_id long, page_id string, url string, chunk_no long, last boolean, bytes long, digest string, data binary")
    return out.withColumn("page_id", F.col("page_id").cast("long"))


def record_types(chunks: DataFrame) -> DataFrame:
    """record_id, page_id, url, bytes, digest, type and refers_to (record and page) of each record.

    Of records with equal payloads the one with the largest page id (then record id) is the response.
    """
    records = chunks.where("last").select("record_id", "page_id", "url", "bytes", "digest", F.concat_ws(":", "digest", "bytes").alias("content"))
    groups = records.groupBy("content").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("page_id", "record_id")).alias("best"))
    groups = materialize(groups.where("n > 1"), "warc-groups")
    out = attach_groups(records, groups, "content", "n")
    revisit = F.col("best.record_id").isNotNull() & (F.col("best.record_id") != F.col("record_id"))
    return out.select("record_id", "page_id", "url", "bytes", "digest", F.when(revisit, "revisit").otherwise("response").alias("type"), F.when(revisit, F.col("best")).alias("refers_to"))


def _urn(page: object, record: object) -> str:
    return f"<urn:record:{'' if page is None else page}:{record}>"


def write_archives(chunks: DataFrame, types: DataFrame, folder: str) -> DataFrame:
    """Write gzip WARC files (a member a record) below ``folder``; returns the manifest (path, records).

    The chunks of a record go to one task by an explicit repartition, which neither a broadcast join nor
    an adaptive plan undoes; a task that still meets a later chunk first fails.
    """
    total = types.where("type = 'response'").agg(F.sum("bytes")).first()[0] or 0
    files = max(chunks.sparkSession.sparkContext.defaultParallelism, -(-total // ARCHIVE_BYTES))
    kinds = types.select(F.col("record_id").alias("rid"), F.col("bytes").alias("total"), F.col("digest").alias("payload_digest"), "type", F.col("refers_to.page_id").cast("string").alias("ref_page"), F.col("refers_to.record_id").cast("string").alias("ref_record"))
    rows = chunks.repartition(files, "record_id").join(kinds, F.col("record_id") == F.col("rid")).where((F.col("type") == "response") | (F.col("chunk_no") == 0))
    rows = rows.select("record_id", F.col("page_id").cast("string").alias("page_id"), "url", "chunk_no", "last", "total", "payload_digest", "type", "ref_page", "ref_record", F.when(F.col("type") == "response", F.col("data")).alias("data"))
    rows = rows.sortWithinPartitions("record_id", "chunk_no")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pafs.FileSystem.from_uri(folder)
        path, out, gz, n, record = "", None, None, 0, None
        for b in batches:
            for r in b.itertuples(index=False):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    path = f"part-{uuid.uuid4().hex}.warc.gz"
                    out = fs.open_output_stream(f"{base}/{path}")
                if r.chunk_no == 0:
                    n, record = n + 1, r.record_id
                    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
                    head = [f"WARC-Type: {r.type}", f"WARC-Record-ID: {_urn(r.page_id, r.record_id)}", f"WARC-Target-URI: {' '.join(r.url.split())}", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: text/html; charset=utf-8", f"WARC-Payload-Digest: sha1:{r.payload_digest}", f"X-Payload-Length: {r.total}"]
                    if r.type == "revisit":
                        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(r.ref_page, r.ref_record)}"]
                    head.append(f"Content-Length: {r.total if r.type == 'response' else 0}")
                    out.write(gz.compress(("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode()))
                elif r.record_id != record:
                    raise ValueError(f"record {r.record_id} begins with chunk {r.chunk_no}")
                if r.data:
                    out.write(gz.compress(r.data))
                if r.last or r.type == "revisit":
                    out.write(gz.compress(b"\r\n\r\n") + gz.flush())
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [f"{folder}/{path}"], "records": [n]})

    return materialize(rows.mapInPandas(write, "path string, records long"), "warc-manifest")


class _Members:
    """A stream of the bytes of all gzip members of a file, read a block at a time."""

    def __init__(self, raw):
        self.raw, self.gz, self.rest, self.buf = raw, zlib.decompressobj(31), b"", b""

    def more(self) -> bool:
        while True:
            block = self.rest or self.raw.read(BLOCK)
            if not block:
                return False
            if self.gz.eof:
                self.gz = zlib.decompressobj(31)
            got = self.gz.decompress(block, CHUNK_BYTES)
            self.rest = self.gz.unconsumed_tail or self.gz.unused_data
            if got:
                self.buf += got
                return True

    def header(self) -> bytes:
        while (end := self.buf.find(b"\r\n\r\n")) < 0:
            if not self.more():
                return b""
        head, self.buf = self.buf[:end], self.buf[end + 4 :]
        return head

    def take(self, n: int) -> bytes:
        """Up to n bytes; all n unless the buffer holds fewer."""
        if not self.buf and not self.more():
            raise EOFError("the archive ends inside a record")
        got, self.buf = self.buf[:n], self.buf[n:]
        return got


def read_archives(manifest: DataFrame, with_data: bool = True, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table read back: page_id, type, ref_page, url, header digest and length, chunk_no, last, bytes, digest, data.

    ``digest`` is computed from the bytes read; a revisit has one empty chunk.  Each archive is a task of
    its own: as many ranges of paths as archives.
    """
    files = manifest.select("path").repartitionByRange(max(1, manifest.count()), "path")

    def page(urn: str | None) -> str | None:
        return urn.strip("<>").split(":")[2] or None if urn else None

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["page_id", "type", "ref_page", "url", "payload_digest", "payload_bytes", "chunk_no", "last", "bytes", "digest", "data"]
        for b in batches:
            for path in b["path"]:
                fs, name = pafs.FileSystem.from_uri(path)
                out, held = [], 0
                with fs.open_input_stream(name) as raw:
                    members = _Members(raw)
                    while head := members.header():
                        h = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
                        left, sha, k, at = int(h["Content-Length"]), hashlib.sha1(), 0, 0
                        while True:
                            piece = b""
                            while left and len(piece) < chunk_bytes:
                                got = members.take(min(left, chunk_bytes - len(piece)))
                                piece, left = piece + got, left - len(got)
                            sha.update(piece)
                            at += len(piece)
                            out.append((page(h["WARC-Record-ID"]), h["WARC-Type"], page(h.get("WARC-Refers-To")), h["WARC-Target-URI"], h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"]), k, not left, at, _base32(sha), piece if with_data else None))
                            held, k = held + len(piece) + 200, k + 1
                            if held > 16 << 20:
                                yield pd.DataFrame(out, columns=names)
                                out, held = [], 0
                            if not left:
                                break
                        gap = 4
                        while gap:
                            gap -= len(members.take(gap))
                if out:
                    yield pd.DataFrame(out, columns=names)

    got = files.mapInPandas(read, "page_id string, type string, ref_page string, url string, payload_digest string, payload_bytes long, chunk_no long, last boolean, bytes long, digest string, data binary")
    return got.withColumns({c: F.col(c).cast("long") for c in ("page_id", "ref_page")})


def archive_pages(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write ``pages`` as WARC files below ``folder`` (shared; a work folder if not given) and return their manifest.

    Empty input writes no file and gives an empty manifest; columns other than the three are ignored.
    """
    folder = folder or f"{work_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    chunks = materialize(record_chunks(pages, id_col, url_col, payload_col), "warc-chunks")
    return write_archives(chunks, record_types(chunks), folder)


def read_records(manifest: DataFrame) -> DataFrame:
    """One row a record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's length and digest come from the bytes read back, a revisit's from its header.
    """
    is_response = F.col("type") == "response"
    ends = read_archives(manifest, with_data=False).where("last")
    return ends.select("page_id", F.when(is_response, F.col("bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), F.when(is_response, F.col("digest")).otherwise(F.col("payload_digest")).alias("payload_digest"), F.col("type").alias("record_type"), F.col("ref_page").alias("refers_to"))
