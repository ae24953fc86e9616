"""WARC records in ZIP packages: a writer, and a reader that takes byte ranges of files.

An archive is one ZIP file in the shared folder, of about ARCHIVE_BYTES of payload, with stored
(uncompressed) members `archive/data.warc.gz`, in which each record is a gzip member of its own, and
`indexes/index.cdx`. The reader opens the file and reads ranges of it alone: the end of the file, the
ZIP64 locator and end record, the central directory (ZIP64 extra fields too), the local headers of
the members, the index, and then each record by its offset and length. Nothing is extracted, and no
archive is loaded whole. Files are written under a temporary name and moved, so a task that is run
again leaves one whole file. The shared folder may be any that pyarrow.fs opens by its URI.

Defined cases: null html is an empty payload; null urls are written as an empty target; rows
with a null or repeated page_id are kept, each with a record of its own (rows that carry the
smallest page_id of a payload are all responses); very long pages make an archive longer than
ARCHIVE_BYTES; empty tables give no archives; extra input columns are ignored, whatever their names.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import struct
import uuid
import zipfile
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shards, shared_dir, table, tasks, text_of, tidy, total_bytes, written

ARCHIVE_BYTES = 8 << 20
LEAST_REVISIT = 100
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record(name: str, url: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC/1.1 record; a revisit carries headers alone."""
    block = HTTP + payload if refers_to is None else HTTP
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}", "WARC-Date: 2000-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def package(records: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP of the records, gzipped one by one, and their index (name, offset, length per line)."""
    out, at, lines = io.BytesIO(), 0, []
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        with z.open(zipfile.ZipInfo(DATA), "w", force_zip64=zip64) as f:
            for name, body in records:
                body = gzip.compress(body, 1, mtime=0)
                f.write(body)
                lines.append(f"{name} {at} {len(body)}")
                at += len(body)
        z.writestr(zipfile.ZipInfo(INDEX), "\n".join(lines))
    return out.getvalue()


def members(read: Callable[[int, int], bytes], size: int) -> dict[str, tuple[int, int]]:
    """Name to (offset, length) of every stored member, from the directories alone.

    `read(offset, length)` gives bytes of the archive; compressed members are left out, as they
    have no byte ranges.
    """
    tail_at = max(0, size - 65557)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":
        at = struct.unpack_from("<Q", tail, end - 12)[0]
        if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
            count, length, start = struct.unpack_from("<QQQ", read(at, 56), 32)
    directory, at, found = read(start, length), 0, {}
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, packed, plain = struct.unpack_from("<H8xII", directory, at + 10)
        n_name, n_extra, n_note = struct.unpack_from("<HHH", directory, at + 28)
        local = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + n_name].decode()
        extra, i = directory[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while i + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, i)
            if tag == 1:
                wide, j = extra[i + 4 : i + 4 + n], 0
                values = []
                for v in (plain, packed, local):
                    if v == 0xFFFFFFFF:
                        v, j = struct.unpack_from("<Q", wide, j)[0], j + 8
                    values.append(v)
                plain, packed, local = values
            i += 4 + n
        if method == 0:
            n1, n2 = struct.unpack_from("<HH", read(local, 30), 26)
            found[name] = (local + 30 + n1 + n2, packed)
        at += 46 + n_name + n_extra + n_note
    return found


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload of one record."""
    head, _, body = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    return fields, body[: int(fields["content-length"])].partition(b"\r\n\r\n")[2]


def records_of(read: Callable[[int, int], bytes], size: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Every record of an archive of `size` bytes, by its index; `read(offset, length)` gives bytes of it."""
    where = members(read, size)
    (data_at, _), (index_at, index_n) = where[DATA], where[INDEX]
    for line in read(index_at, index_n).decode().split("\n"):
        if line:
            _, at, n = line.rsplit(" ", 2)
            yield parse(gzip.decompress(read(data_at + int(at), int(n))))


def file_system(uri: str):
    """The file system of a URI, and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def store(uri: str, content: bytes) -> None:
    """A file with this content; never seen half-written."""
    system, path = file_system(uri)
    folder, name = path.rsplit("/", 1)
    system.create_dir(folder, recursive=True)
    own = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(own) as out:
        out.write(content)
    system.move(own, path)


def _packer(folder: str):
    def pack(key: tuple, pages: pd.DataFrame, roles: pd.DataFrame) -> pd.DataFrame:
        name = lambda x: "null" if pd.isna(x) else str(int(x))
        first = {(name(p), d): f for p, d, f in zip(roles.copy_id, roles.digest, roles["first"])}
        made = []
        for page, url, html in zip(pages.page_id, pages.url, pages.html):
            payload = html.encode("utf-8")
            digest = hashlib.sha256(payload).hexdigest()
            own = name(page)
            to = first.get((own, digest))
            made.append((own, record(own, "" if url is None else url, payload, digest, None if to is None or pd.isna(to) or name(to) == own else name(to))))
        if not made:
            return pd.DataFrame({"archive_id": [], "path": []})
        path = f"{folder}/{int(key[0])}.zip"
        store(path, package(made))
        return pd.DataFrame({"archive_id": [int(key[0])], "path": [path]})

    return pack


def write_archives(pages: DataFrame) -> DataFrame:
    """(archive_id, path) of the files that hold all pages (page_id, url, html), in the shared folder."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of("html").alias("html"))
    n = shards(total_bytes(rows, "html"), ARCHIVE_BYTES)
    keyed = rows.select("page_id", F.sha2("html", 256).alias("digest"), F.octet_length("html").alias("n"))
    firsts = keyed.filter(F.col("n") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"))
    roles = keyed.join(firsts, "digest").filter(~F.col("first").eqNullSafe(F.col("page_id"))).select(F.col("page_id").alias("copy_id"), "digest", "first")
    archive = lambda page: F.pmod(F.xxhash64(page), F.lit(n)).alias("archive_id")
    dealt = lambda df: df.repartition(tasks(n), "archive_id").groupBy("archive_id")
    folder = shared_dir(pages.sparkSession, "warc-zip")
    packed = dealt(rows.select(archive("page_id"), "page_id", "url", "html")).cogroup(dealt(roles.select(archive("copy_id"), "copy_id", "digest", "first"))).applyInPandas(_packer(folder), "archive_id long, path string")
    return written(packed, "warc-list").repartition(tasks(n), "archive_id")


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for uri in batch.path:
            system, path = file_system(uri)
            rows = []
            with system.open_input_file(path) as file:
                for head, payload in records_of(lambda at, n: file.read_at(n, at), file.size()):
                    kind, page = head["warc-type"], head["warc-record-id"][len("<urn:page:") : -1]
                    whole = kind == "response"
                    to = head.get("warc-refers-to")
                    rows.append((None if page == "null" else int(page), len(payload) if whole else int(head["x-payload-length"]), hashlib.sha256(payload).hexdigest() if whole else head["warc-payload-digest"][len("sha256:") :], kind, int(to[len("<urn:page:") : -1]) if to else None, head["warc-target-uri"], payload if whole else None))
            out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])
            yield out.astype({"page_id": "Int64", "refers_to": "Int64"})


def read_archives(archives: DataFrame) -> DataFrame:
    """Every record of the files (path); the payload is null for revisits."""
    return archives.select("path").mapInPandas(tidy(_unpack), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def op7_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, read back."""
    return read_archives(write_archives(table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = {
    "op7_warc_zip": """with p as (select page_id, coalesce(html, '') as html from pages), k as (select page_id, sha256(html) as d, strlen(html) as n from p),
    f as (select d, min(page_id) as first from k where n >= 100 group by 1)
    select k.page_id, k.n as payload_bytes, k.d as payload_digest, case when f.first <> k.page_id then 'revisit' else 'response' end as record_type, case when f.first <> k.page_id then f.first end as refers_to from k left join f using (d)""",
}
QUERIES = {"op7_warc_zip": op7_warc_zip}
