"""Operator 3, WARC archives: written with an index, read back from the index by coalesced byte ranges.

Each task writes gzip records (one member each) to files of its own in a folder all executors reach, and returns for each
record its file, offset, length, URL and payload digest: the index, which is written before anything is read. A file has
its final name only when whole, and a lost task's files are in no index. Payloads that are equal, by SHA-1 digest and
length, and of at least `revisit_bytes` bytes, are stored once: in the record of the smallest id; the others are
revisit records that name it and keep the HTTP header alone, whose Content-Length still tells the full payload's size.
A reader sorts the selected index rows by file and offset and joins neighbours at most `gap` bytes apart to one read of
up to `span` bytes; it takes no more at once, and checks each payload against its digest.

Null html: an empty payload. Null URLs stay null. Null ids: a revisit if any row with an id has the payload, else a
response. Repeated rows with the smallest id are all responses; other repeats are revisits. Other columns are not read.
No rows: no records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrears.llm.trainorder import open_fs

INDEX = "page_id long, url string, payload_digest string, record_type string, refers_to long, file string, offset long, length long"
RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long"
SPLIT = 8 << 20


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None, sha: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{sha}')}>"


def line(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A")


def record(page: int | None, url: str | None, payload: bytes, refers: int | None, is_revisit: bool, date: str) -> tuple[bytes, str]:
    """The record, compressed, and its payload digest."""
    sha = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {record_id(page, sha)}", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {line(url)}"] if url is not None else []
    head += [f"WARC-Payload-Digest: sha1:{sha}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    head += [f"X-Page-Id: {page}"] if page is not None else []
    if is_revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers, sha)}", f"X-Refers-To-Page-Id: {refers}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush(), sha


def parse(raw: bytes) -> dict:
    """Page id, URL, payload (none for a revisit), its full size and digest, and the type, of a decompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    sha, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or digest(payload) != sha):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} does not have its digest")
    whole = lambda x: int(fields[x]) if x in fields else None
    return {
        "page_id": whole("X-Page-Id"), "url": fields.get("WARC-Target-URI"), "payload": payload if kind == "response" else None,
        "payload_bytes": size, "payload_digest": sha, "record_type": kind, "refers_to": whole("X-Refers-To-Page-Id"),
    }


def write(
    pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = 0,
    file_bytes: int = 1 << 30, date: str = "2024-01-01T00:00:00Z",
) -> DataFrame:
    """The index of the archives in `folder`, to be saved before it is used: each evaluation writes archives anew."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string").cast("binary"), F.lit(b"")).alias("html")
    )
    rows = rows.withColumn("sha", F.sha1("html")).withColumn("size", F.octet_length("html"))
    first = rows.where(F.col("size") >= revisit_bytes).groupBy("sha", "size").agg(F.min("page_id").alias("refers_to"))
    keys = rows.where(F.col("size") >= revisit_bytes).select("page_id", "sha", "size").distinct()
    again = keys.join(first, ["sha", "size"]).where("refers_to is not null and not (page_id <=> refers_to)")
    again = again.select(F.col("page_id").alias("_page"), F.col("sha").alias("_sha"), F.col("size").alias("_size"), "refers_to")
    rows = rows.join(again, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("sha") == F.col("_sha")) & (F.col("size") == F.col("_size")), "left")

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        sink = temp = name = None
        names = [x.split()[0] for x in INDEX.split(", ")]
        at = 0
        for batch in batches:
            out: dict[str, list] = {x: [] for x in names}
            for page, url, html, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                if sink is None or at >= file_bytes:
                    if sink:
                        sink.close()
                        fs.move(temp, f"{root}/{name}")
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    temp, at = f"{root}/.{name}.part", 0
                    sink = fs.open_output_stream(temp, compression=None)
                raw, sha = record(page, url, html, refers, refers is not None, date)
                sink.write(raw)
                for x, v in zip(names, (page, url, sha, "response" if refers is None else "revisit", refers, name, at, len(raw)), strict=True):
                    out[x].append(v)
                at += len(raw)
            types = [pa.int64() if x in ("page_id", "refers_to", "offset", "length") else pa.string() for x in names]
            yield pa.RecordBatch.from_arrays([pa.array(out[x], t) for x, t in zip(names, types, strict=True)], names)
        if sink:
            sink.close()
            fs.move(temp, f"{root}/{name}")

    return rows.select("page_id", "url", "html", "refers_to").mapInArrow(archive, INDEX)


def ranges(rows: list[tuple[str, int, int]], gap: int, span: int) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Reads (file, offset, length) and the records in each, from rows sorted by file and offset."""
    file, lo, hi, own = None, 0, 0, []
    for f, offset, length in rows:
        if own and (f != file or offset - hi > gap or offset + length - lo > span):
            yield file, lo, hi - lo, own
            own = []
        if not own:
            file, lo = f, offset
        own.append((offset, length))
        hi = offset + length
    if own:
        yield file, lo, hi - lo, own


def read(index: DataFrame, folder: str, where: Column | None = None, *, payloads: bool = True, gap: int = 1 << 16, span: int = 4 << 20) -> DataFrame:
    """The records of the index rows that `where` selects (all, if None)."""
    chosen = (index if where is None else index.where(where)).select("file", "offset", "length")
    part = F.floor(F.col("offset") / SPLIT)
    dealt = chosen.withColumn("part", part).repartition("file", "part").sortWithinPartitions("file", "offset")
    names = [x.split()[0] for x in RECORD.split(", ") if payloads or not x.startswith("payload binary")]
    kinds = {"payload": pa.binary(), "page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "offset": pa.int64()}

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        opened, source = None, None
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True))
            for file, lo, size, own in ranges(rows, gap, span):
                if file != opened:
                    if source:
                        source.close()
                    opened, source = file, fs.open_input_file(f"{root}/{file}")
                data = source.read_at(size, lo)
                got = [parse(zlib.decompress(data[o - lo : o - lo + n], 31)) | {"file": file, "offset": o} for o, n in own]
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in got], kinds.get(c, pa.string())) for c in names], names)
        if source:
            source.close()

    return dealt.select("file", "offset", "length").mapInArrow(fetch, ", ".join(x for x in RECORD.split(", ") if payloads or not x.startswith("payload binary")))
